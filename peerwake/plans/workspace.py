"""The study tables derived from one directory of driver tables.

Stages that many reports read are written once to the shared folder and read back, the
way the study stores its tables between runs; everything else is lazy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from ..operators import diagnostics as dg
from ..operators import events as ev
from ..operators import mechanism as me
from ..operators import panel as pn
from ..operators import peers as pr
from ..operators import resample as rs
from ..operators import similarity as sm
from ..operators import study as st
from ..params import ECONOMIC, Detection, Inference, Resampling, Study, Universe
from ..sources import driver_tables, market

VERSION = "star_schema_v1"
_MARKETS = tuple(f"NATION_{i}" for i in range(24))
BASE_UNIVERSE = Universe(
    allow_classification_before_as_of=True,  # the test tables have one undated classification
    universe_version=VERSION, allowed_universe_tiers=("core",), min_price=101.0, min_history_days=26,
    min_average_dollar_volume=6600.0, average_dollar_volume_window_days=10,
    allowed_exchange_or_markets=_MARKETS + tuple(f"{m} ADR" for m in _MARKETS),
    eligibility_start_date="1995-05-01", eligibility_end_date="2001-10-01")
EXTENDED_UNIVERSE = Universe(**{**BASE_UNIVERSE.__dict__, "min_history_days": 8,
                                "allowed_universe_tiers": ("core", "extension")})
DETECTION = Detection(minimum_relative_move=0.05, volatility_window=26, threshold_multiplier=2.0, cooldown_period=21,
                      minimum_peer_count=2, minimum_history_requirement=20, cooldown_scope="both")
STUDY = Study()
LONG_STUDY = Study(primary_horizons=(1, 3, 5, 10, 20), descriptive_horizons=(), pre_event_days=5, post_event_days=20)
INFERENCE = Inference(bootstrap_iterations=200)
RESAMPLING = Resampling(random_peer_iterations=20, pseudo_event_iterations=20, null_iterations=10, bootstrap_iterations=200,
                        pseudo_event_exclusion_days=30)
LOOKBACK, OVERLAP, TOP_PEERS = 60, 30, 10
EXTREME_RETURN = 0.15
GROUP = "ASIA"
MULTIPLIERS = (1.5, 2.0, 2.5, 3.0)
PERIODS = [("early_1995_1997", 1995, 1997), ("middle_1998_1999", 1998, 1999), ("recent_2000_2001", 2000, 2001)]
ADJUSTED = "semiconductor_adjusted_return"


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, detection: Detection = DETECTION, keep: bool = True):
        self.spark, self.sf_dir, self.detection, self.keep = spark, sf_dir, detection, keep

    def _stage(self, df: DataFrame, label: str) -> DataFrame:
        return staged(df, label) if self.keep else df

    # Sources -----------------------------------------------------------------
    @cached_property
    def vendor(self) -> DataFrame:
        return driver_tables.vendor_prices(self.spark, self.sf_dir)

    @cached_property
    def prices(self) -> DataFrame:
        return self._stage(market.standardize_prices(self.vendor), "prices")

    @cached_property
    def classification(self) -> DataFrame:
        return market.load_classification(driver_tables.classification_text(self.spark, self.sf_dir))

    @cached_property
    def master(self) -> DataFrame:
        return self._stage(pn.build_security_master(self.classification), "master")

    @cached_property
    def vendor_master(self) -> DataFrame:
        """Vendor-facing mapping: identity plus the vendor's symbol."""
        return self.master.select("security_id", "ticker", F.concat(F.lit("Y-"), "ticker").alias("yahoo_symbol"),
                                  "company_name", "exchange", F.lit("USD").alias("currency"))

    @cached_property
    def view(self) -> DataFrame:
        return pn.classification_view(self.classification, self.master)

    # Panel -------------------------------------------------------------------
    @cached_property
    def panel(self) -> DataFrame:
        panel = pn.assemble_daily_panel(self.prices, self.master, BASE_UNIVERSE, EXTENDED_UNIVERSE, EXTREME_RETURN)
        return self._stage(panel.withColumn("peer_group", driver_tables.peer_group_of(F.col("subsector"), F.col("ticker"))), "panel")

    @cached_property
    def eligibility(self) -> DataFrame:
        verdicts = pn.historical_eligibility(self.prices, self.master, self.view, BASE_UNIVERSE, EXTENDED_UNIVERSE)
        return self._stage(verdicts, "eligibility")

    @cached_property
    def membership(self) -> DataFrame:
        return self.eligibility.select("date", "security_id", "eligible", F.col("reason").alias("exclusion_reason"))

    @cached_property
    def factor(self) -> DataFrame:
        return pr.sector_factor(self.panel)

    @cached_property
    def adjusted(self) -> DataFrame:
        return self._stage(pr.abnormal_returns(self.panel, self.factor, output=ADJUSTED), "adjusted")

    @cached_property
    def relative_abnormal(self) -> DataFrame:
        relative = pr.relative_abnormal_returns(self.adjusted, ADJUSTED)
        return self._stage(relative.where("relative_abnormal_return IS NOT NULL"), "relative")

    @cached_property
    def relative(self) -> DataFrame:
        return pr.relative_returns(self.adjusted)

    # Events and study --------------------------------------------------------
    @cached_property
    def candidates(self) -> DataFrame:
        return ev.candidate_rows(self.relative_abnormal, self.panel)

    @cached_property
    def events(self) -> DataFrame:
        # Each supplier has one region, so the group clock alone decides scope "both".
        return self._stage(ev.detect_events(self.candidates, self.detection, one_group_per_firm=True), "events")

    @cached_property
    def calendar(self) -> DataFrame:
        return self._stage(st.trading_calendar(self.panel), "calendar")

    @cached_property
    def frame(self) -> DataFrame:
        return st.study_frame(self.adjusted, ADJUSTED)

    @cached_property
    def event_panel(self) -> DataFrame:
        return self._stage(st.event_panel(self.events, self.frame, STUDY, ADJUSTED, calendar=self.calendar), "event_panel")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._stage(st.event_outcomes(self.events, self.event_panel, STUDY), "outcomes")


    # Alternative peers --------------------------------------------------------
    @cached_property
    def similarity_inputs(self):
        """Initiators and all eligible candidates per event date, with trailing returns."""
        members = self.panel.where("eligible").select("date", "security_id")
        return sm.prepare(self.events, members, self.panel, self.calendar, ["date"], lookback=LOOKBACK)

    @cached_property
    def correlation_edges(self) -> DataFrame:
        return self._stage(sm.correlation_peers(*self.similarity_inputs, minimum=OVERLAP, top=TOP_PEERS), "correlation_peers")

    @cached_property
    def peer_quality(self) -> DataFrame:
        unit = ["date", "peer_group"]
        members = self.panel.where("eligible").select(*unit, "security_id")
        inputs = sm.prepare(self.events, members, self.panel, self.calendar, unit, lookback=LOOKBACK)
        return self._stage(sm.peer_quality(*inputs, self.calendar, unit, OVERLAP), "peer_quality")

    @cached_property
    def definition_outcomes(self) -> DataFrame:
        return self._stage(dg.definition_outcomes(self.events, self.adjusted, ADJUSTED, self.correlation_edges, STUDY, self.calendar),
                           "definition_outcomes")

    # Characteristics ------------------------------------------------------------
    @cached_property
    def coverage(self) -> DataFrame:
        return dg.peer_coverage(self.events, self.relative_abnormal, self.panel)

    @cached_property
    def quality_detail(self) -> DataFrame:
        return dg.event_quality_detail(self.events, self.master, self.panel, self.relative_abnormal)

    @cached_property
    def characteristics(self) -> DataFrame:
        return self._stage(dg.event_characteristics(self.events, self.panel, self.factor, self.peer_quality, self.coverage), "characteristics")

    @cached_property
    def mechanism(self) -> DataFrame:
        return self._stage(me.mechanism_characteristics(self.events, self.panel, self.factor, GROUP), "mechanism")

    # Specifications ---------------------------------------------------------------
    @cached_property
    def threshold_outcomes(self) -> DataFrame:
        return self._stage(dg.threshold_sweep(self.candidates, self.frame, self.detection, LONG_STUDY, ADJUSTED, self.calendar, MULTIPLIERS), "thresholds")

    @cached_property
    def return_outcomes(self) -> DataFrame:
        columns = {"raw_returns": "return", "semiconductor_factor_adjusted": ADJUSTED}
        return self._stage(dg.return_definition_sweep(self.events, self.adjusted, LONG_STUDY, self.calendar, columns), "return_definitions")

    @cached_property
    def universe_outcomes(self) -> DataFrame:
        variants = {"core": "eligible", "core_plus_extension": "extension_eligible", "excluding_questionable": "eligible"}
        return self._stage(dg.universe_sweep(self.panel, self.detection, LONG_STUDY, ADJUSTED, self.calendar, variants), "universes")

    # Placebos -----------------------------------------------------------------------
    @cached_property
    def portfolios(self) -> DataFrame:
        return pr.peer_portfolios(self.panel)

    @cached_property
    def event_sizes(self) -> DataFrame:
        sizes = self.portfolios.select("date", "security_id", "peer_definition", "portfolio_size", "weight")
        return self._stage(self.events.select("event_id", "date", "security_id", "peer_definition").join(
            sizes, ["date", "security_id", "peer_definition"]).select("event_id", "portfolio_size", "weight"), "event_sizes")

    @cached_property
    def pool(self) -> DataFrame:
        return self.panel.where("eligible").select("date", "security_id")

    @cached_property
    def random_edges(self) -> DataFrame:
        return self._stage(rs.random_peer_edges(self.events, self.event_sizes, self.pool, RESAMPLING.random_peer_iterations,
                                                RESAMPLING.random_seed), "random_edges")

    @cached_property
    def random_outcomes(self) -> DataFrame:
        return self._stage(rs.random_peer_placebo(self.events, self.random_edges, self.frame, STUDY, ADJUSTED, self.calendar,
                                                  RESAMPLING.random_peer_iterations), "random_outcomes")

    @cached_property
    def matching(self) -> DataFrame:
        return self._stage(rs.matching_panel(self.panel, self.factor), "matching")

    @cached_property
    def pseudo_candidates(self) -> DataFrame:
        return rs.pseudo_event_candidates(self.events, self.matching, self.portfolios, RESAMPLING.match_columns,
                                          RESAMPLING.pseudo_event_exclusion_days)

    @cached_property
    def pseudo(self) -> DataFrame:
        # In a large panel some events have no matched date; like in the SQL they draw nothing.
        return self._stage(rs.pseudo_events(self.events, self.pseudo_candidates, RESAMPLING.match_columns,
                                            RESAMPLING.pseudo_event_iterations, RESAMPLING.random_seed, strict=False), "pseudo")

    @cached_property
    def pseudo_outcomes(self) -> DataFrame:
        return self._stage(rs.pseudo_event_placebo(self.pseudo, self.matching, self.frame, STUDY, ADJUSTED, self.calendar), "pseudo_outcomes")

    @cached_property
    def donors(self) -> DataFrame:
        regimes = self.matching.groupBy("date").agg(F.min("market_regime").alias("regime"))
        return self._stage(rs.donor_dates(regimes, RESAMPLING.null_iterations, RESAMPLING.random_seed), "donors")

    @cached_property
    def simulated(self) -> DataFrame:
        return self._stage(rs.null_returns(self.adjusted, self.donors, ADJUSTED), "simulated")

    @cached_property
    def null_input(self) -> DataFrame:
        # Metadata covers every pair the portfolios name, observed that day or not.
        metadata = rs.detection_metadata(self.portfolios, self.panel)
        return rs.null_detection_input(self.adjusted, self.donors, self.panel, metadata, ADJUSTED)

    @cached_property
    def null(self) -> dict[str, DataFrame]:
        out = rs.selection_preserving_null(self.simulated, self.null_input, self.panel, self.donors, self.detection, STUDY,
                                           ADJUSTED, ADJUSTED, self.calendar)
        return {**out, "distribution": self._stage(out["distribution"], "null_distribution")}


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """One workspace per Spark application and directory."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, str(sf_dir))
    return _OPEN[key]


def forget(spark: SparkSession) -> None:
    """Forget the stage tables, so that the next query starts from the source tables."""
    _OPEN.clear()
