"""Distribution statistics, robust mean inference and event-time paths.

A cell is (horizon, return specification, peer definition) x direction x outcome. All
statistics of all cells come from grouped aggregates over one long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn_sums
from ..functions.exprs import digest, null_safe_on
from ..functions.selection import dense_index, order_statistics, percentiles
from ..functions.student import t_critical, t_upper
from ..params import CELL, OUTCOMES, Inference
from .reports import long_outcomes, mean_interval, with_all_direction

# The tested direction of each outcome and the columns of each clustering.
CLUSTERS = {"firm": ("security_id",), "event_date": ("event_date",), "two_way": ("security_id", "event_date")}
CELL_KEYS = [*CELL, "direction", "outcome"]
QUARTILES = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def cell_values(outcomes: DataFrame) -> DataFrame:
    """Valid non-missing outcome values per cell, with their cluster columns."""
    ids = [*CELL, "event_id", "security_id", "event_date", "direction"]
    return with_all_direction(long_outcomes(outcomes, ids)).where("x IS NOT NULL")


def distribution(values: DataFrame, keys: list[str], trim: float = 0.10) -> DataFrame:
    """Moments, quantiles, trimmed mean and bias-corrected shape statistics of ``x``."""
    n = F.col("sample_size")
    base = values.groupBy(*keys).agg(
        F.count("x").alias("sample_size"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("standard_deviation"),
        F.avg((F.col("x") > 0).cast("double")).alias("proportion_positive"), F.min("x").alias("minimum"),
        F.max("x").alias("maximum"), F.skewness("x").alias("__g1"), F.kurtosis("x").alias("__g2"))
    g1, g2 = F.col("__g1"), F.col("__g2")
    base = base.withColumn("skewness", F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))))
    base = base.withColumn("excess_kurtosis", F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * g2 + 6)))
    out = null_safe_on(base.drop("__g1", "__g2"), percentiles(values, keys, "x", QUARTILES), keys)
    return null_safe_on(out, trimmed_mean(values, keys, trim), keys)


def trimmed_mean(values: DataFrame, keys: list[str], trim: float) -> DataFrame:
    """Mean after cutting int(trim * n) values from each tail.

    The two cut values are order statistics; the kept total follows from sums and counts
    around them, so nothing is ranked beyond those two.
    """
    size = F.col("__n")
    cut = F.floor(F.lit(trim) * size)
    ends = order_statistics(values, keys, "x", {"__low": cut, "__high": size - 1 - cut})
    rows = null_safe_on(values.select(*keys, "x").where("x IS NOT NULL"), ends, keys, "inner")
    x, low, high = F.col("x"), F.col("__low"), F.col("__high")
    sums = rows.groupBy(*keys, "__low", "__high").agg(
        F.count("*").alias("__n"), F.sum(F.when((x > low) & (x < high), x)).alias("__mid"),
        F.count_if(x <= low).alias("__below"), F.count_if(x >= high).alias("__above"))
    total = (F.coalesce("__mid", F.lit(0.0)) + low * (F.col("__below") - cut) + high * (F.col("__above") - cut))
    return sums.select(*keys, F.when(low == high, low).otherwise(total / (size - 2 * cut)).alias("trimmed_mean"))


def _cluster_variance(values: DataFrame, keys: list[str], by: tuple[str, ...], tag: str) -> DataFrame:
    """Number of clusters and the small-sample-corrected cluster variance of a mean."""
    means = values.groupBy(*keys).agg(F.avg("x").alias("__m"), F.count("x").alias("__n"))
    sums = values.groupBy(*keys, *by).agg(F.sum("x").alias("__s"), F.count("x").alias("__c"))
    dev = null_safe_on(sums, means, keys, "inner").withColumn("__e", F.col("__s") - F.col("__c") * F.col("__m"))
    g = F.col(f"g_{tag}")
    out = dev.groupBy(*keys).agg(F.count("*").alias(f"g_{tag}"), F.sum(F.col("__e") * F.col("__e")).alias("__q"), F.max("__n").alias("__n"))
    return out.select(*keys, g, (F.when(g > 1, g / F.nullif(g - 1, F.lit(0)) * F.col("__q") / (F.col("__n") * F.col("__n")))).alias(f"v_{tag}"))


def mean_inference(values: DataFrame, keys: list[str], cluster_by: str | None, confidence: float = 0.95,
                   alternative: Column | None = None) -> DataFrame:
    """Mean with iid, one-way or two-way clustered standard error and Student-t inference."""
    alt = F.lit("two-sided") if alternative is None else alternative
    out = values.groupBy(*keys).agg(F.count("x").alias("sample_size"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("__sd"))
    n = F.col("sample_size")
    if cluster_by is None:
        out = (out.withColumn("standard_error", F.col("__sd") / F.sqrt(n))
               .withColumn("cluster_count", F.lit(None).cast("bigint")).withColumn("degrees_of_freedom", F.when(n > 1, n - 1)))
    else:
        columns = CLUSTERS[cluster_by]
        for c in columns:
            out = null_safe_on(out, _cluster_variance(values, keys, (c,), c), keys)
        if len(columns) == 2:
            out = null_safe_on(out, _cluster_variance(values, keys, columns, "both"), keys)
            variance = F.col(f"v_{columns[0]}") + F.col(f"v_{columns[1]}") - F.col("v_both")
            clusters = F.least(*[F.col(f"g_{c}") for c in columns])
        else:
            variance, clusters = F.col(f"v_{columns[0]}"), F.col(f"g_{columns[0]}")
        ready = (n > 1) & (clusters > 1)
        out = (out.withColumn("standard_error", F.when(ready & (variance >= 0), F.sqrt(variance)))
               .withColumn("cluster_count", F.when(n > 1, clusters))
               .withColumn("degrees_of_freedom", F.when(ready, clusters - 1)))
    df, se = F.col("degrees_of_freedom"), F.col("standard_error")
    out = out.withColumn("test_statistic", F.when(se > 0, F.col("mean") / F.nullif(se, F.lit(0.0)))).withColumn("alternative", alt)
    t = F.col("test_statistic")
    out = out.withColumn("__one", t_upper(t, df)).withColumn("__two", 2 * t_upper(F.abs(t), df)).withColumn("__q", t_critical(confidence, df))
    p = (F.when(F.col("alternative") == "greater", F.col("__one")).when(F.col("alternative") == "less", 1 - F.col("__one"))
         .otherwise(F.col("__two")))
    return out.select(*keys, "sample_size", "mean", "standard_error", "test_statistic", p.alias("p_value"),
                      (F.col("mean") - F.col("__q") * se).alias("ci_lower"), (F.col("mean") + F.col("__q") * se).alias("ci_upper"),
                      "degrees_of_freedom", "cluster_count", "alternative")


def alternatives() -> Column:
    return F.when(F.col("outcome") == "convergence", F.lit("greater")).otherwise(F.lit("two-sided"))


def bootstrap_means(values: DataFrame, keys: list[str], unit: str, iterations: int, seed: int) -> DataFrame:
    """Mean of each resample of whole units, one row per (key, iteration).

    Units are numbered by digest; ``drawn_sums`` adds up the sums of the units that an iteration drew.
    """
    units = values.groupBy(*keys, unit).agg(F.sum("x").alias("__s"), F.count("x").alias("__c"))
    units = units.withColumn("__h", digest(F.col(unit))).withColumn("__s", F.coalesce("__s", F.lit(0.0)))
    sums = drawn_sums(dense_index(units, keys, "__h", "__i"), keys, [], ["__s", "__c"], iterations, seed)
    return sums.select(*keys, "iteration", F.try_divide("__s", "__c").alias("statistic"), F.col("__c").cast("bigint").alias("sample_size"))


def bootstrap_interval(values: DataFrame, keys: list[str], p: Inference) -> DataFrame:
    """Percentile interval and deviation of resampled means; fewer than two units give null."""
    unit = "event_id" if p.cluster_by is None else CLUSTERS[p.cluster_by][0]
    means = bootstrap_means(values, keys, unit, p.bootstrap_iterations, p.random_seed)
    tail = (1 - p.confidence_level) / 2
    spread = means.groupBy(*keys).agg(
        F.percentile("statistic", F.array(F.lit(tail), F.lit(1 - tail))).alias("__q"),
        F.stddev_samp("statistic").alias("bootstrap_standard_error"), F.count("*").alias("bootstrap_iterations"))
    units = values.groupBy(*keys).agg((F.min(unit) != F.max(unit)).alias("__many"))
    return null_safe_on(spread, units, keys, "inner").where("__many").select(
        *keys, F.col("__q")[0].alias("ci_lower"), F.col("__q")[1].alias("ci_upper"), "bootstrap_standard_error", "bootstrap_iterations")


def attrition(outcomes: DataFrame) -> DataFrame:
    """Distinct events, valid and invalid horizons and the sorted set of reasons per cell and direction."""
    keys = [*CELL, "direction"]
    rows = with_all_direction(outcomes)
    reasons = rows.where("NOT valid_horizon").select(*keys, F.explode(F.split("missing_reason", ";")).alias("r")).distinct()
    listed = reasons.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("r")), ";").alias("missing_reasons"))
    counts = rows.groupBy(*keys).agg(F.count_distinct("event_id").alias("total_events"),
                                     F.count_if("valid_horizon").alias("valid_horizons"),
                                     F.count_if(~F.col("valid_horizon")).alias("invalid_horizons"))
    return null_safe_on(counts, listed, keys).withColumn("missing_reasons", F.coalesce("missing_reasons", F.lit("")))


def _cells(outcomes: DataFrame) -> DataFrame:
    """Every reported cell, also one without a valid value."""
    rows = with_all_direction(outcomes.select(*CELL, "direction").distinct()).distinct()
    return rows.withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in OUTCOMES])))


def complete_cells(outcomes: DataFrame, stats: DataFrame) -> DataFrame:
    """``stats`` for every reported cell, with the number of valid horizons whose outcome is null."""
    out = null_safe_on(_cells(outcomes), stats, CELL_KEYS)
    rows = with_all_direction(long_outcomes(outcomes, [*CELL, "direction"]))
    gaps = rows.groupBy(*CELL_KEYS).agg(F.count_if(F.col("x").isNull()).alias("missing_outcome_count"))
    return null_safe_on(out, gaps, CELL_KEYS).fillna(0, ["sample_size", "missing_outcome_count"])


def hypothesis_tests(outcomes: DataFrame, p: Inference = Inference()) -> DataFrame:
    values = cell_values(outcomes)
    tests = mean_inference(values, CELL_KEYS, p.cluster_by, p.confidence_level, alternatives())
    tests = complete_cells(outcomes, tests).withColumn("alternative", alternatives())
    spread = values.groupBy(*CELL_KEYS).agg(F.stddev_samp("x").alias("__sd"))
    if p.interval_method == "bootstrap":
        tests = null_safe_on(tests.drop("ci_lower", "ci_upper"),
                             bootstrap_interval(values, CELL_KEYS, p).select(*CELL_KEYS, "ci_lower", "ci_upper"), CELL_KEYS)
    return null_safe_on(tests, spread, CELL_KEYS).select(
        *CELL_KEYS, "sample_size", "missing_outcome_count", F.lit(0.0).alias("null_value"), "alternative", "test_statistic", "p_value", "ci_lower", "ci_upper",
        F.try_divide("mean", F.nullif("__sd", F.lit(0.0))).alias("effect_size"), "standard_error", "degrees_of_freedom",
        F.lit(p.cluster_by or "none").alias("cluster_by"), "cluster_count")


def summarize_event_outcomes(outcomes: DataFrame, p: Inference = Inference()) -> dict[str, DataFrame]:
    """Summary, full distribution, tests and attrition of every cell."""
    values = cell_values(outcomes)
    shape = complete_cells(outcomes, distribution(values, CELL_KEYS, p.trim_proportion))
    tests = hypothesis_tests(outcomes, p)
    summary = null_safe_on(
        shape.select(*CELL_KEYS, "sample_size", "missing_outcome_count", "mean", "median", "standard_deviation", "trimmed_mean", "proportion_positive"),
        tests.select(*CELL_KEYS, "standard_error", "ci_lower", "ci_upper", "p_value"), CELL_KEYS)
    if p.interval_method == "bootstrap":
        summary = null_safe_on(summary, bootstrap_interval(values, CELL_KEYS, p).select(*CELL_KEYS, "bootstrap_standard_error"), CELL_KEYS)
    else:
        summary = summary.withColumn("bootstrap_standard_error", F.lit(None).cast("double"))
    summary = summary.withColumn("confidence_level", F.lit(p.confidence_level)).withColumn("interval_method", F.lit(p.interval_method))
    return {"summary_table": summary, "distribution_summary": shape, "hypothesis_tests": tests, "attrition_table": attrition(outcomes)}


def cumulative_paths(panel: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Running sums per event, null from the first incomplete day on."""
    order = Window.partitionBy(*keys, "event_id").orderBy("relative_day").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.min(F.col("valid_observation").cast("int")).over(order) == 1
    return panel.withColumns({out: F.when(whole, F.sum(c).over(order)) for out, c in columns.items()})


def event_time_statistics(panel: DataFrame, p: Inference = Inference()) -> DataFrame:
    """Post-event cumulative means and intervals by day and direction."""
    paths = cumulative_paths(panel.where("relative_day > 0"), {"initiator_car": "initiator_return", "peer_car": "peer_return"})
    sign = F.when(F.col("direction") == "positive", 1.0).otherwise(-1.0)
    paths = paths.withColumn("convergence", sign * (F.col("peer_car") - F.col("initiator_car")))
    ids = ["relative_day", "return_specification", "peer_definition", "direction", "event_id", "security_id", "event_date"]
    names = ("initiator_car", "peer_car", "convergence")
    values = with_all_direction(paths.select(*ids, *names).unpivot(ids, list(names), "outcome", "x")).where("x IS NOT NULL")
    keys = ["relative_day", "return_specification", "peer_definition", "direction", "outcome"]
    tests = mean_inference(values, keys, p.cluster_by, p.confidence_level)
    if p.interval_method == "bootstrap":
        tests = null_safe_on(tests.drop("ci_lower", "ci_upper"), bootstrap_interval(values, keys, p), keys)
    found = tests.select(*keys, "mean", "ci_lower", "ci_upper", "standard_error", "sample_size")
    # Every cell of the panel is reported, also one whose paths were all cut.
    cells = with_all_direction(panel.where("relative_day > 0").select(*keys[:4]).distinct()).distinct()
    cells = cells.withColumn("outcome", F.explode(F.array(*[F.lit(n) for n in names])))
    return null_safe_on(cells, found, keys).withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))


def event_path_statistics(panel: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Signed cumulative means from the first pre-event day, with iid intervals."""
    paths = cumulative_paths(panel, {"initiator_car": "signed_initiator_return", "peer_car": "signed_peer_return"})
    paths = paths.withColumn("convergence", F.col("peer_car") - F.col("initiator_car"))
    names = ["initiator_car", "peer_car", "convergence"]
    values = paths.select("relative_day", *names).unpivot(["relative_day"], names, "outcome", "x")
    stats = values.groupBy("relative_day", "outcome").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("__sd"),
                                                          F.count("x").alias("sample_size"))
    return mean_interval(stats, "sample_size", "mean", "__sd", confidence).drop("__sd")


def run_statistical_inference(outcomes: DataFrame, panel: DataFrame, characteristics: DataFrame | None = None,
                              p: Inference = Inference()) -> dict[str, DataFrame]:
    from .regress import event_regressions

    tables = summarize_event_outcomes(outcomes, p)
    if characteristics is not None:
        tables["regression_table"] = event_regressions(outcomes, characteristics, p.confidence_level, p.cluster_by)
    tables["event_time_statistics"] = event_time_statistics(panel, p)
    return tables
