"""Sector state, pre-event volume and the mechanism comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import gated, null_safe_on, sample_label, union_all
from ..functions.selection import percentiles
from ..params import BROAD, CORRELATION, ECONOMIC, OUTCOMES
from .inference import bootstrap_means, cumulative_paths
from .regress import fit, with_normal_interval
from .reports import long_outcomes, summarize

HORIZONS = (1, 5, 10)
ADEQUATE = "adequate_analysis_sample"


def date_frame(n: int, lag: int = 1):
    """Trailing frame over a date-level series. Such a series has one row per calendar date."""
    return Window.orderBy("date").rowsBetween(-(n + lag - 1), -lag)


def sector_state(factor: DataFrame) -> DataFrame:
    """Lagged compounded momentum and annualised volatility of the sector factor."""
    x = F.col("semiconductor_return")

    def momentum(n: int, need: int):
        gross = F.collect_list(1 + x).over(date_frame(n))
        product = F.aggregate(gross, F.lit(1.0), lambda a, g: a * g) - 1
        return F.when(F.count(x).over(date_frame(n)) >= need, product)

    vol = gated(F.stddev_samp(x), x, date_frame(21), 15) * F.sqrt(F.lit(252.0))
    return factor.select(
        "date", momentum(21, 15).alias("SectorMomentum"), momentum(21, 15).alias("SectorMomentum_1m"),
        momentum(63, 45).alias("SectorMomentum_3m"), vol.alias("SectorVolatility"),
        F.lit(None).cast("double").alias("MarketVolatility"),
        F.lag("date").over(Window.orderBy("date")).alias("sector_information_max_date"))


def pre_event_volume(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Log of the last five observed volumes' mean over the median of the sixty before them."""
    from .diagnostics import observed_before

    rows = panel.select("date", "security_id", F.col("volume").alias("__v")).join(
        events.select("security_id").distinct(), "security_id", "left_semi")
    rank, frame = observed_before("__v")
    v = F.col("__v")
    rows = rows.withColumn("__k", rank)
    near, far = frame(5, 1), frame(65, 6)
    rows = rows.select("date", "security_id", F.avg(v).over(near).alias("m"), F.percentile(v, F.lit(0.5)).over(far).alias("q"),
                       F.count(v).over(near).alias("volume_recent_count"), F.count(v).over(far).alias("volume_reference_count"),
                       F.max(F.when(v.isNotNull(), F.col("date"))).over(near).alias("volume_information_max_date"))
    ready = (F.col("volume_recent_count") >= 3) & (F.col("volume_reference_count") >= 20) & (F.col("q") > 0)
    return events.select("event_id", "date", "security_id").join(rows, ["date", "security_id"], "left").select(
        "event_id", F.when(ready, F.log(F.col("m") / F.nullif("q", F.lit(0.0)))).alias("VolumeMeasure"), "volume_information_max_date",
        F.coalesce("volume_recent_count", F.lit(0)).alias("volume_recent_count"),
        F.coalesce("volume_reference_count", F.lit(0)).alias("volume_reference_count"))


def mechanism_characteristics(events: DataFrame, panel: DataFrame, factor: DataFrame, group: str) -> DataFrame:
    """Event-level explanatory variables with their information dates."""
    shock = F.try_divide(F.abs("relative_return"), F.nullif("relative_volatility", F.lit(0.0)))
    early = lambda c: F.col(c).isNull() | (F.col(c) < F.col("date"))
    return (events.join(F.broadcast(sector_state(factor)), "date", "left").join(pre_event_volume(panel, events), "event_id", "left")
            .withColumn("EquipmentIndicator", (F.col("subsector") == group).cast("int"))
            .withColumn("EconomicPeerIndicator", (F.col("peer_definition") == ECONOMIC).cast("int"))
            .withColumn("ShockMagnitude", shock).withColumn("ShockMagnitudeSquared", shock * shock)
            .withColumn("EventDirection", (F.col("direction") == "positive").cast("int"))
            .withColumn("no_future_sector_information", early("sector_information_max_date"))
            .withColumn("no_future_volume_information", early("volume_information_max_date")))


PRIMARY = ["EquipmentIndicator", "ShockMagnitude", "SectorMomentum", "VolumeMeasure", "EventDirection"]


def mechanism_regressions(outcomes: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Two model specifications for each outcome and horizon, HC3 with normal intervals."""
    names = [*PRIMARY, "ShockMagnitudeSquared"]
    rows = outcomes.where(F.col("valid_horizon") & F.col("horizon").isin(*HORIZONS) & (F.col("peer_definition") == ECONOMIC))
    rows = rows.select("event_id", "horizon", *OUTCOMES).join(characteristics.select("event_id", *names), "event_id", "left")
    rows = rows.unpivot(["event_id", "horizon", *names], list(OUTCOMES), "dependent_variable", "y")
    keys = ["horizon", "dependent_variable"]
    parts = []
    for label, predictors in (("primary_linear", PRIMARY), ("targeted_shock_quadratic", names)):
        terms, models = fit(rows, keys, "y", predictors)
        out = null_safe_on(models, terms, keys).withColumn("model_specification", F.lit(label))
        parts.append(out.withColumn("term", F.coalesce("term", F.lit("model"))))
    out = with_normal_interval(union_all(parts), "p_value_context_only")
    return out.select("model_specification", *keys, F.col("sample_size"), F.col("sample_size").alias("event_count"), "r_squared",
                      "adjusted_r_squared", F.lit("HC3").alias("covariance_estimator"), sample_label(F.col("sample_size"), ADEQUATE).alias("sample_label"),
                      F.when(F.col("estimated"), F.lit("estimated_confirmatory")).otherwise(F.lit("insufficient_data")).alias("status"),
                      "term", "coefficient", "standard_error", "ci_lower", "ci_upper", "p_value_context_only")


GROUP_OUTCOMES = ("initiator_car", "peer_car", "peer_catchup", "initiator_reversal", "convergence")


def _group_label():
    return F.when(F.col("EquipmentIndicator") == 1, F.lit("equipment")).otherwise(F.lit("all_non_equipment"))


def group_comparison(outcomes: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Five outcomes by horizon for the binary group and for every subsector, from one explode."""
    rows = outcomes.where(F.col("valid_horizon") & F.col("horizon").isin(*HORIZONS)).join(
        characteristics.select("event_id", "EquipmentIndicator"), "event_id")
    rows = rows.withColumn("__g", F.explode(F.array(
        F.struct(F.lit("binary").alias("grouping"), _group_label().alias("group")),
        F.struct(F.lit("subsector_full_disclosure").alias("grouping"), F.col("subsector").alias("group"))))).select("*", "__g.*")
    values = long_outcomes(rows, ["grouping", "group", "horizon", "event_id"], GROUP_OUTCOMES)
    return summarize(values, ["grouping", "group", "horizon", "outcome"], adequate=ADEQUATE).select(
        "grouping", "group", "horizon", "outcome", "event_count", "sample_size", "mean", "median", "ci_lower", "ci_upper", "sample_label")


def group_event_path(panel: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Cumulative paths over days 1-10 by group, cut at the first incomplete day."""
    post = panel.where("relative_day BETWEEN 1 AND 10").join(characteristics.select("event_id", "EquipmentIndicator"), "event_id", "left")
    paths = cumulative_paths(post, {"initiator_car": "initiator_return", "peer_car": "peer_return", "peer_catchup": "signed_peer_return",
                                    "__si": "signed_initiator_return"})
    paths = paths.withColumn("initiator_reversal", -F.col("__si")).withColumn("convergence", F.col("peer_catchup") + F.col("initiator_reversal"))
    paths = paths.withColumn("group", _group_label())
    values = long_outcomes(paths, ["group", "relative_day", "event_id"], GROUP_OUTCOMES, valid_only=False)
    return summarize(values, ["group", "relative_day", "outcome"], adequate=ADEQUATE, median=False).select(
        "group", "relative_day", "outcome", "sample_size", "mean", "ci_lower", "ci_upper", "sample_label")


def common_sample(outcomes: DataFrame, definitions: tuple[str, ...] = (ECONOMIC, CORRELATION, BROAD)) -> DataFrame:
    """Rows under ``definitions`` of the (event, horizon) pairs that are valid under each of them."""
    valid = outcomes.where(F.col("valid_horizon") & F.col("peer_definition").isin(*definitions))
    whole = valid.groupBy("event_id", "horizon").agg(F.count_distinct("peer_definition").alias("n")).where(F.col("n") == len(definitions))
    return valid.join(whole, ["event_id", "horizon"], "left_semi")


def paired_differences(common: DataFrame, left: str = ECONOMIC, right: str = CORRELATION) -> DataFrame:
    """Per-event outcome under one peer definition less the other."""
    values = long_outcomes(common, ["event_id", "horizon", "peer_definition"])
    pick = lambda d: F.max(F.when(F.col("peer_definition") == d, F.col("x")))
    return values.groupBy("event_id", "horizon", "outcome").agg((pick(left) - pick(right)).alias("x")).where("x IS NOT NULL")


def paired_difference(common: DataFrame, replications: int = 10_000, seed: int = 13) -> DataFrame:
    """Mean, median and event-bootstrap interval of the paired differences."""
    diffs = paired_differences(common)
    keys = ["horizon", "outcome"]
    base = summarize(diffs, keys, adequate=ADEQUATE).select(*keys, "event_count", "sample_size", "mean", "median", "sample_label")
    means = bootstrap_means(diffs, keys, "event_id", replications, seed)
    band = percentiles(means, keys, "statistic", {"ci_lower": 0.025, "ci_upper": 0.975})
    enough = F.col("sample_size") > 1
    return base.join(band, keys, "left").withColumn("ci_lower", F.when(enough, F.col("ci_lower"))).withColumn(
        "ci_upper", F.when(enough, F.col("ci_upper"))).withColumn("bootstrap_replications", F.lit(replications))


def peer_definition_comparison(outcomes: DataFrame, replications: int = 10_000, seed: int = 13) -> DataFrame:
    """Levels per definition on the common sample plus the paired test, in one table."""
    common = common_sample(outcomes.where(F.col("horizon").isin(*HORIZONS)))
    levels = summarize(long_outcomes(common, ["peer_definition", "horizon", "event_id"]), ["peer_definition", "horizon", "outcome"], adequate=ADEQUATE)
    columns = ["comparison_type", "peer_definition", "horizon", "outcome", "event_count", "sample_size", "mean", "median", "ci_lower", "ci_upper",
               "bootstrap_replications", "sample_label"]
    levels = levels.withColumn("comparison_type", F.lit("peer_definition_level")).withColumn("bootstrap_replications", F.lit(0))
    paired = (paired_difference(common, replications, seed).withColumn("comparison_type", F.lit("paired_economic_minus_correlation"))
              .withColumn("peer_definition", F.lit("economic_minus_correlation")))
    return levels.select(*columns).unionByName(paired.select(*columns))


CONTROLS = ["ShockMagnitude", "EquipmentIndicator", "EventDirection", "VolumeMeasure"]
MOMENTA = ("SectorMomentum_1m", "SectorMomentum_3m")


def regime_analysis(outcomes: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Momentum regressions with controls, sign splits, and the availability row."""
    rows = outcomes.where(F.col("valid_horizon") & F.col("horizon").isin(*HORIZONS)).select("event_id", "horizon", F.col("convergence").alias("x"))
    rows = rows.join(characteristics.select("event_id", *MOMENTA, "SectorVolatility", *CONTROLS), "event_id", "left")
    rows = rows.unpivot(["event_id", "horizon", "x", "SectorVolatility", *CONTROLS], list(MOMENTA), "momentum_window", "momentum")
    keys = ["horizon", "momentum_window"]
    terms, models = fit(rows, keys, "x", ["momentum", "SectorVolatility", *CONTROLS])
    slopes = null_safe_on(terms.where("term IN ('momentum', 'SectorVolatility')"), models.select(*keys, "sample_size", "r_squared"), keys)
    slopes = with_normal_interval(slopes, "__p").withColumn(
        "term", F.when(F.col("term") == "momentum", F.col("momentum_window")).otherwise(F.col("term")))
    slopes = slopes.select(*keys, F.lit("continuous_regression").alias("analysis_type"), F.lit("continuous").alias("regime"), "term", "sample_size",
                           "coefficient", "standard_error", "ci_lower", "ci_upper", "r_squared", F.lit("estimated_confirmatory").alias("status"))
    regime = F.when(F.col("momentum") <= 0, F.lit("weak_nonpositive")).when(F.col("momentum") > 0, F.lit("strong_positive"))
    split = summarize(rows.withColumn("regime", regime).where("regime IS NOT NULL"), [*keys, "regime"], adequate=ADEQUATE)
    split = split.select(*keys, "regime", F.lit("sign_based_regime_comparison").alias("analysis_type"), F.lit("convergence").alias("term"), "sample_size",
                         "mean", "median", "ci_lower", "ci_upper", F.lit("descriptive_regime_comparison").alias("status"))
    gap = outcomes.sparkSession.range(1).select(
        F.lit("data_availability").alias("analysis_type"), F.lit("not_applicable").alias("momentum_window"), F.lit("not_applicable").alias("regime"),
        F.lit("MarketVolatility").alias("term"), F.lit(0).cast("bigint").alias("sample_size"),
        F.lit("unavailable_frozen_baseline_has_no_market_return_series").alias("status"))
    out = slopes.unionByName(split, allowMissingColumns=True).unionByName(gap, allowMissingColumns=True)
    return out.withColumn("sample_label", sample_label(F.col("sample_size"), ADEQUATE)).withColumn("event_count", F.col("sample_size"))
