"""Event quality, characteristics and the grid of alternative specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from ..functions.exprs import gated, null_safe_on, sample_label, trailing, union_all, unpivot
from ..functions.selection import percentiles
from ..params import BROAD, CORRELATION, ECONOMIC, OUTCOMES, Detection, Study
from . import events as ev
from . import peers as pr
from . import study as st
from .mechanism import date_frame
from .regress import univariate_hc3, with_normal_interval
from .reports import summarize, summarize_outcomes

SPEC_COLUMNS = ("variation_type", "specification", "horizon", "outcome", "event_count", "sample_size", "mean", "median",
                "ci_lower", "ci_upper", "sample_label", "status", "notes")


def observed_before(value: str):
    """Window over earlier rows of the security counted in non-null values.

    Returns (rank column, frame builder): frame(a, b) covers the a-th to b-th most recent
    earlier observed values; null rows take no slot.
    """
    before = Window.partitionBy("security_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return (F.count(value).over(before),
            lambda a, b: Window.partitionBy("security_id").orderBy("__k").rangeBetween(-a, -b))


def trailing_percentile(panel: DataFrame, events: DataFrame, value: str = "volume", window: int = 252, minimum: int = 20) -> DataFrame:
    """Where the event-date value stands among the firm's last observed values before it."""
    rows = panel.select("date", "security_id", F.col(value).alias("__v")).join(
        events.select("security_id").distinct(), "security_id", "left_semi")
    rank, frame = observed_before("__v")
    rows = rows.withColumn("__k", rank)
    past = frame(window, 1)
    rows = rows.select("date", "security_id", "__v", F.collect_list("__v").over(past).alias("__h"),
                       F.percentile("__v", F.lit(0.5)).over(past).alias("__m"),
                       F.max(F.when(F.col("__v").isNotNull(), F.col("date"))).over(past).alias("__d"))
    n = F.size("__h")
    share = F.size(F.filter("__h", lambda h: h <= F.col("__v"))) / F.nullif(n, F.lit(0))
    out = rows.select("date", "security_id", F.when(F.col("__v").isNotNull() & (n >= minimum), share).alias(f"{value}_percentile"),
                      F.when(n >= minimum, F.col("__m")).alias(f"trailing_{value}_median"),
                      n.cast("bigint").alias(f"{value}_history_count"), F.col("__d").alias(f"{value}_history_max_date"))
    return (events.select("event_id", "date", "security_id").join(out, ["date", "security_id"], "left").drop("date", "security_id")
            .withColumn(f"{value}_history_count", F.coalesce(f"{value}_history_count", F.lit(0))))


def peer_coverage(events: DataFrame, relative: DataFrame, panel: DataFrame, eligible: str = "eligible") -> DataFrame:
    """Observed peers against the peers the group could offer on the date."""
    possible = panel.where(F.col(eligible)).groupBy("date", "peer_group").agg(F.count("*").alias("__n"))
    seen = relative.select("date", "security_id", "peer_count", F.col("peer_abnormal_return").alias("peer_return"))
    rows = events.select("event_id", "date", "security_id", "peer_group").join(seen, ["date", "security_id"], "left")
    rows = rows.join(possible, ["date", "peer_group"], "left").withColumn("possible_peer_count", F.col("__n") - 1)
    return rows.select("event_id", "peer_count", "possible_peer_count",
                       F.try_divide("peer_count", F.nullif("possible_peer_count", F.lit(0))).alias("peer_portfolio_coverage"), "peer_return")


def event_quality_detail(events: DataFrame, master: DataFrame, panel: DataFrame, relative: DataFrame) -> DataFrame:
    return (events.join(master.select("security_id", "ticker", "company_name"), "security_id", "left")
            .withColumn("z_score", F.try_divide("relative_return", "relative_volatility"))
            .join(trailing_percentile(panel, events), "event_id", "left").join(peer_coverage(events, relative, panel), "event_id", "left")
            .withColumn("abnormal_volume_ratio", F.try_divide("volume", F.nullif("trailing_volume_median", F.lit(0.0))))
            .select("event_id", "date", "ticker", "company_name", "subsector", "direction", "relative_return", "z_score", "relative_volatility",
                    "volume", "volume_percentile", "abnormal_volume_ratio", "market_cap", "peer_count", "possible_peer_count",
                    "peer_portfolio_coverage", "peer_return", "volume_history_count", "volume_history_max_date"))


def largest_events(detail: DataFrame, n: int = 25) -> DataFrame:
    """Top ``n`` by absolute shock, then date; a top-k plan that never sorts everything."""
    top = detail.orderBy(F.desc(F.abs("relative_return")), "date", "event_id").limit(n)
    return top.select(F.col("date").alias("event_date"), F.col("ticker").alias("initiator"), "company_name", "subsector",
                      F.col("relative_return").alias("relative_shock_magnitude"), "z_score", "market_cap", "volume_percentile",
                      "abnormal_volume_ratio", "peer_return", (F.col("relative_return") + F.col("peer_return")).alias("initiator_return"),
                      "peer_count", "peer_portfolio_coverage")


def event_characteristics(events: DataFrame, panel: DataFrame, factor: DataFrame, quality: DataFrame, coverage: DataFrame) -> DataFrame:
    """Event-level predictors, all from before the event apart from the event day's own shock and volume."""
    dollar = F.col("adj_close") * F.col("volume")
    past = trailing(["security_id"], "date", 20)
    liquid = F.log1p(F.when(F.count(dollar).over(past) >= 10, F.percentile(dollar, F.lit(0.5)).over(past)))
    rows = panel.select("date", "security_id", liquid.alias("log_trailing_dollar_volume"))
    x = F.col("semiconductor_return")
    total = gated(F.sum(x), x, date_frame(126), 60)
    state = factor.select("date", (gated(F.stddev_samp(x), x, date_frame(20), 10) * F.sqrt(F.lit(252.0))).alias("semiconductor_volatility"),
                          total.alias("trailing_semiconductor_return"), F.coalesce((total < 0).cast("double"), F.lit(0.0)).alias("bear_regime"))
    return (events.join(trailing_percentile(panel, events), "event_id", "left").join(rows, ["date", "security_id"], "left")
            .join(F.broadcast(state), "date", "left")
            .join(quality.select("event_id", "average_peer_correlation", "peer_return_similarity"), "event_id", "left")
            .join(coverage.select("event_id", "peer_count", "peer_portfolio_coverage"), "event_id", "left")
            .select("event_id", F.abs("relative_return").alias("shock_magnitude"),
                    (F.abs("relative_return") / F.col("relative_volatility")).alias("standardized_shock"),
                    F.log(F.when(F.col("market_cap") > 0, F.col("market_cap"))).alias("log_market_cap"), "log_trailing_dollar_volume",
                    "volume_percentile", F.try_divide("volume", F.nullif("trailing_volume_median", F.lit(0.0))).alias("abnormal_volume_ratio"),
                    "semiconductor_volatility", F.lit(None).cast("double").alias("market_volatility"), "trailing_semiconductor_return",
                    "bear_regime", (F.col("direction") == "negative").cast("double").alias("negative_event"),
                    F.col("peer_count").cast("double").alias("peer_count"), "average_peer_correlation", "peer_return_similarity",
                    "peer_portfolio_coverage"))


PREDICTORS = ("shock_magnitude", "standardized_shock", "log_market_cap", "log_trailing_dollar_volume", "volume_percentile",
              "abnormal_volume_ratio", "semiconductor_volatility", "market_volatility", "trailing_semiconductor_return", "bear_regime",
              "negative_event", "peer_count", "average_peer_correlation", "peer_return_similarity", "peer_portfolio_coverage")


def characteristic_relationships(outcomes: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Univariate slopes of each outcome on each standardised predictor, HC3 and normal intervals."""
    rows = outcomes.where("valid_horizon").select("event_id", "horizon", *OUTCOMES).join(characteristics, "event_id", "left")
    long = unpivot(rows, ["event_id", "horizon", *PREDICTORS], OUTCOMES, "outcome", "y")
    long = unpivot(long, ["event_id", "horizon", "outcome", "y"], PREDICTORS, "predictor", "x")
    keys = ["horizon", "outcome", "predictor"]
    counts = long.groupBy(*keys).agg(F.count("*").alias("__all"), F.count_if(F.col("y").isNotNull() & F.col("x").isNotNull()).alias("sample_size"))
    fits = with_normal_interval(univariate_hc3(long, keys, "y", "x"), "p_value_exploratory")
    out = counts.join(fits, keys, "left")
    return out.select(*keys, "sample_size", (F.col("sample_size") / F.col("__all")).alias("coverage"),
                      sample_label(F.col("sample_size")).alias("sample_label"), F.col("coefficient").alias("coefficient_per_1sd"),
                      F.col("standard_error").alias("standard_error_hc3"), "ci_lower", "ci_upper", "p_value_exploratory",
                      F.when(F.col("coefficient").isNotNull(), F.lit("estimated_exploratory")).otherwise(F.lit("insufficient_data")).alias("status"))


# --- Peer definitions on the same events ---------------------------------------------------


def definition_outcomes(events: DataFrame, adjusted: DataFrame, value: str, correlation_edges: DataFrame, p: Study,
                        calendar: DataFrame) -> DataFrame:
    """Outcomes of the same events under economic, correlation and broad peers, keyed by ``definition``."""
    frame = st.study_frame(adjusted, value, (ECONOMIC, BROAD))
    base = events.drop("peer_definition", "peer_group")
    grouped = base.join(events.select("event_id", "peer_group"), "event_id").withColumn(
        "__d", F.explode(F.array(F.struct(F.lit(ECONOMIC).alias("peer_definition"), F.col("peer_group").alias("g")),
                                 F.struct(F.lit(BROAD).alias("peer_definition"), F.lit("*").alias("g")))))
    grouped = grouped.select(*base.columns, F.col("__d.peer_definition").alias("peer_definition"), F.col("__d.g").alias("peer_group"))
    similar = base.withColumn("peer_definition", F.lit(CORRELATION)).withColumn("peer_group", F.lit(None).cast("string"))
    key = ("definition",)
    tag = lambda df: df.withColumn("definition", F.col("peer_definition"))
    a = st.event_panel(tag(grouped), frame, p, value, keys=key, calendar=calendar)
    b = st.event_panel(tag(similar), frame, p, value, keys=key, calendar=calendar,
                       edges=tag(correlation_edges).select("definition", "event_id", "date", "peer_id", "weight"))
    panel = staged(a.unionByName(b), "definition_panel")
    return st.event_outcomes(tag(grouped.unionByName(similar)), panel, p, keys=key).drop("definition")


# --- One-at-a-time specifications -----------------------------------------------------------


def detected_outcomes(candidates: DataFrame, frame: DataFrame, detection: Detection, p: Study, value: str, calendar: DataFrame,
                      keys: tuple[str, ...] = (), frame_keys: tuple[str, ...] = (), multipliers=None,
                      one_group_per_firm: bool | None = None) -> DataFrame:
    """Detection and event study for all specifications in one pass, keyed by specification."""
    events = staged(ev.detect_events(candidates, detection, keys=keys, one_group_per_firm=one_group_per_firm, multiplier=multipliers), "spec_events")
    panel = staged(st.event_panel(events, frame, p, value, keys=keys, frame_keys=frame_keys, calendar=calendar), "spec_panel")
    return st.event_outcomes(events, panel, p, keys)


def threshold_sweep(candidates: DataFrame, frame: DataFrame, detection: Detection, p: Study, value: str, calendar: DataFrame,
                    multipliers=(2.0, 2.5, 3.0, 4.0)) -> DataFrame:
    return detected_outcomes(candidates, frame, detection, p, value, calendar, ("multiplier",), (), multipliers)


def return_definition_sweep(events: DataFrame, adjusted: DataFrame, p: Study, calendar: DataFrame,
                            columns: dict[str, str]) -> DataFrame:
    """The same events measured on several return columns, keyed by ``spec``."""
    frame = union_all([st.study_frame(adjusted, c).withColumn("spec", F.lit(label)) for label, c in columns.items()])
    keyed = events.withColumn("spec", F.explode(F.array(*[F.lit(c) for c in columns])))
    panel = staged(st.event_panel(keyed, frame, p, F.col("spec"), keys=("spec",), frame_keys=("spec",), calendar=calendar), "spec_panel")
    return st.event_outcomes(keyed, panel, p, ("spec",))


def universe_sweep(panel: DataFrame, detection: Detection, p: Study, value: str, calendar: DataFrame,
                   variants: dict[str, str]) -> DataFrame:
    """Factor, peers, detection and study rebuilt per eligibility flag, keyed by ``variant``.

    Variants of one flag are the same run: it is made once and its outcomes are given to each of them.
    """
    flags = list(dict.fromkeys(variants.values()))
    choices = F.array(*[F.struct(F.lit(flag).alias("variant"), F.col(flag).alias("on")) for flag in flags])
    rows = panel.withColumn("__v", F.explode(choices))
    rows = rows.withColumn("variant", F.col("__v.variant")).withColumn("eligible", F.col("__v.on")).drop("__v")
    key = ("variant",)
    adjusted = pr.abnormal_returns(rows, pr.sector_factor(rows, keys=key), output=value, keys=key)
    adjusted = staged(adjusted.select(*key, "date", "security_id", "peer_group", "eligible", value), "variant_panel")
    relative = pr.relative_abnormal_returns(adjusted, value, keys=key).where("relative_abnormal_return IS NOT NULL")
    candidates = ev.candidate_rows(relative, panel, key)
    found = detected_outcomes(candidates, st.study_frame(adjusted, value, keys=key), detection, p, value, calendar, key, key)
    labels = F.array(*[F.struct(F.lit(flag).alias("flag"), F.lit(label).alias("label")) for label, flag in variants.items()])
    mine = F.transform(F.filter(labels, lambda v: v["flag"] == F.col("variant")), lambda v: v["label"])
    return found.withColumn("variant", F.explode(mine))


def _tail_bounds(outcomes: DataFrame, named: dict[str, float]) -> DataFrame:
    keys = ["horizon", "return_specification"]
    long = unpivot(outcomes.where("valid_horizon").select(*keys, *OUTCOMES), keys, OUTCOMES, "outcome", "x")
    bounds = percentiles(long, [*keys, "outcome"], "x", named)
    return bounds.groupBy(*keys).agg(*[F.max(F.when(F.col("outcome") == o, F.col(n))).alias(f"__{o}_{n}") for o in OUTCOMES for n in named])


def winsorize_outcomes(outcomes: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Outcomes clipped to their own tails within (horizon, return specification)."""
    rows = outcomes.join(_tail_bounds(outcomes, {"lo": lower, "hi": upper}), ["horizon", "return_specification"], "left")
    clip = lambda o: F.when(F.col("valid_horizon") & F.col(o).isNotNull(), F.least(F.greatest(F.col(o), F.col(f"__{o}_lo")), F.col(f"__{o}_hi")))
    return rows.withColumns({o: F.coalesce(clip(o), F.col(o)) for o in OUTCOMES}).select(*outcomes.columns)


def exclude_outliers(outcomes: DataFrame, width: float = 3.0) -> DataFrame:
    """Convergence outside ``width`` interquartile ranges makes the horizon invalid."""
    rows = outcomes.join(_tail_bounds(outcomes, {"q1": 0.25, "q3": 0.75}), ["horizon", "return_specification"], "left")
    q1, q3 = F.col("__convergence_q1"), F.col("__convergence_q3")
    far = (F.col("convergence") < q1 - width * (q3 - q1)) | (F.col("convergence") > q3 + width * (q3 - q1))
    return rows.withColumn("valid_horizon", F.col("valid_horizon") & ~F.coalesce(far, F.lit(False))).select(*outcomes.columns)


def specification_rows(outcomes: DataFrame, variation: str, specification, notes: str = "", expected: list[str] | None = None) -> DataFrame:
    """Long result rows; a specification without a valid event keeps one placeholder row."""
    spec = F.lit(specification) if isinstance(specification, str) else specification
    rows = outcomes.withColumn("specification", spec)
    found = summarize_outcomes(rows, ["specification", "horizon"])
    found = found.withColumn("status", F.lit("estimated_exploratory")).withColumn("horizon", F.col("horizon").cast("int"))
    names = [specification] if isinstance(specification, str) else (expected or [])
    if names:
        spark = outcomes.sparkSession
        wanted = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("specification"))
        absent = wanted.join(found.select("specification").distinct(), "specification", "left_anti")
        found = found.unionByName(absent.select(
            "specification", F.lit("convergence").alias("outcome"), F.lit(0).cast("bigint").alias("event_count"),
            F.lit(0).cast("bigint").alias("sample_size"), F.lit("small_sample_descriptive_only").alias("sample_label"),
            F.lit("no_valid_events").alias("status")), allowMissingColumns=True)
    return found.withColumn("variation_type", F.lit(variation)).withColumn("notes", F.lit(notes)).select(*SPEC_COLUMNS)


def unavailable_rows(spark, variation: str, specification: str, horizons, notes: str, label: str = "small_sample_descriptive_only") -> DataFrame:
    """Rows that state a requested specification cannot be computed from the inputs."""
    none = F.lit(None).cast("double")
    zero = F.lit(0).cast("bigint")
    return (spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
            .withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in OUTCOMES])))
            .select(F.lit(variation).alias("variation_type"), F.lit(specification).alias("specification"), "horizon", "outcome",
                    zero.alias("event_count"), zero.alias("sample_size"), none.alias("mean"), none.alias("median"), none.alias("ci_lower"),
                    none.alias("ci_upper"), F.lit(label).alias("sample_label"), F.lit("unavailable").alias("status"), F.lit(notes).alias("notes")))
