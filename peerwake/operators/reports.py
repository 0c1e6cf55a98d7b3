"""Descriptive tables over events, panels and outcomes.

Grouped medians go through ``functions.selection``, so a cell may hold any number of
events. Label lists that are collected are bounded by the rule set or the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from ..functions.exprs import null_safe_on, sample_label, union_all
from ..functions.selection import percentiles
from ..functions.student import t_critical
from ..params import OUTCOMES, Study
from .study import event_outcomes, event_panel, trading_calendar


def long_outcomes(outcomes: DataFrame, ids: list[str], columns=OUTCOMES, valid_only: bool = True) -> DataFrame:
    """One row per (outcome row, outcome name) with its value ``x``."""
    rows = outcomes.where("valid_horizon") if valid_only else outcomes
    return rows.select(*ids, *columns).unpivot(ids, list(columns), "outcome", "x")


def with_all_direction(df: DataFrame) -> DataFrame:
    """Each row under its own direction and under ``all``: one pass instead of two groupings."""
    return df.withColumn("direction", F.explode(F.array(F.lit("all"), F.col("direction"))))


def mean_interval(df: DataFrame, n: str, mean: str, sd: str, confidence: float = 0.95,
                  lower: str = "ci_lower", upper: str = "ci_upper") -> DataFrame:
    """Student interval of a mean from its count and sample deviation; null below two values."""
    width = t_critical(confidence, F.col(n) - 1) * F.col(sd) / F.sqrt(F.col(n))
    return df.withColumn("__w", width).withColumn(lower, F.col(mean) - F.col("__w")).withColumn(
        upper, F.col(mean) + F.col("__w")).drop("__w")


def summarize(values: DataFrame, keys: list[str], confidence: float = 0.95, adequate: str = "adequate_descriptive_sample",
              median: bool = True) -> DataFrame:
    """Count, mean, spread, range, share above zero and interval of ``x`` per key.

    ``values`` has the keys, ``event_id`` and ``x``.
    """
    stats = values.groupBy(*keys).agg(
        F.count_distinct("event_id").alias("event_count"), F.count("x").alias("sample_size"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("standard_deviation"), F.min("x").alias("minimum"), F.max("x").alias("maximum"),
        F.avg((F.col("x") > 0).cast("double")).alias("proportion_positive"))
    if median:
        stats = null_safe_on(stats, percentiles(values, keys, "x", {"median": 0.5}), keys)
    return (mean_interval(stats, "sample_size", "mean", "standard_deviation", confidence)
            .withColumn("confidence_level", F.lit(confidence))
            .withColumn("sample_label", sample_label(F.col("sample_size"), adequate)))


def summarize_outcomes(outcomes: DataFrame, group_columns: list[str], confidence: float = 0.95) -> DataFrame:
    values = long_outcomes(outcomes, [*dict.fromkeys([*group_columns, "event_id"])])
    return summarize(values, [*group_columns, "outcome"], confidence)


# --- Event study bundle -----------------------------------------------------------


def descriptive_summary(outcomes: DataFrame) -> DataFrame:
    """Valid outcomes by horizon for all events and per direction."""
    values = with_all_direction(long_outcomes(outcomes, ["event_id", "horizon", "direction"]))
    keys = ["horizon", "direction", "outcome"]
    cells = values.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"),
                                      F.avg((F.col("x") > 0).cast("double")).alias("share"))
    cells = cells.join(percentiles(values, keys, "x", {"median": 0.5}), keys, "left")
    pick = lambda o, c: F.max(F.when(F.col("outcome") == o, F.col(c)))
    return cells.groupBy("horizon", "direction").agg(
        pick("convergence", "n").alias("event_count"),
        *[pick(o, m).alias(f"{m}_{o}") for o in OUTCOMES for m in ("mean", "median")],
        pick("convergence", "share").alias("proportion_positive_convergence"))


def exploded_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("NOT valid_horizon").withColumn("missing_reason", F.explode(F.split("missing_reason", ";")))


def event_diagnostics(events: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("event_count"))
    return {
        "total_events": events.agg(F.count_distinct("event_id").alias("total_detected_events")),
        "valid_by_horizon": outcomes.groupBy("horizon").agg(F.count_if("valid_horizon").alias("valid_events")),
        "invalid_by_reason": exploded_reasons(outcomes).groupBy("horizon", "missing_reason").agg(
            F.count("*").alias("invalid_events")),
        "events_by_firm": count(events, "security_id"),
        "events_by_date": count(events, "date"),
        "events_by_subsector": count(events, "subsector"),
        "descriptive_summary": descriptive_summary(outcomes),
    }


def run_event_study(events: DataFrame, frame: DataFrame, p: Study, return_specification: str) -> dict[str, DataFrame]:
    panel = staged(event_panel(events, frame, p, return_specification, calendar=trading_calendar(frame)), "event_panel")
    outcomes = staged(event_outcomes(events, panel, p), "outcomes")
    return {"event_panel": panel, "outcomes": outcomes, **event_diagnostics(events, outcomes)}


def cumulative_event_path(panel: DataFrame) -> DataFrame:
    """Average signed cumulative paths by relative day over complete days."""
    order = Window.partitionBy("event_id").orderBy("relative_day").rowsBetween(Window.unboundedPreceding, 0)
    paths = panel.where("valid_observation").select(
        "relative_day", F.sum("signed_initiator_return").over(order).alias("i"), F.sum("signed_peer_return").over(order).alias("p"))
    return paths.groupBy("relative_day").agg(
        F.avg("i").alias("initiator_path"), F.avg("p").alias("peer_path"), F.avg(F.col("p") - F.col("i")).alias("gap_path"),
        F.count("*").alias("event_count"))


# --- Sample and result tables -----------------------------------------------------


def security_sample(master: DataFrame, membership: DataFrame, coverage: DataFrame) -> DataFrame:
    """Ever-eligible flag, status on the last date and the baseline exclusion reason."""
    ever = membership.groupBy("security_id").agg(F.bool_or("eligible").alias("ever_baseline_eligible"))
    last = membership.agg(F.max("date").alias("date"))
    latest = membership.join(F.broadcast(last), "date").select("security_id", "eligible", "exclusion_reason")
    short = coverage.select("security_id", "short_history_company")
    rows = (master.select("security_id", "ticker", "company_name", "subsector", "universe_tier")
            .join(ever, "security_id", "left").join(latest, "security_id", "left").join(short, "security_id", "left"))
    flag = F.coalesce("ever_baseline_eligible", F.lit(False))
    why = (F.when(flag, F.lit("")).when(F.coalesce("short_history_company", F.lit(False)),
                                        F.lit("universe_tier_not_allowed;insufficient_history"))
           .otherwise(F.lit("universe_tier_not_allowed")))
    return rows.select("security_id", "ticker", "company_name", "subsector", "universe_tier",
                       flag.alias("ever_baseline_eligible"), "eligible",
                       F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"),
                       why.alias("baseline_exclusion_reason"))


def sample_report(sample: DataFrame, membership: DataFrame) -> DataFrame:
    counts = sample.agg(F.count("*").alias("total_classified_securities"),
                        F.count_if("ever_baseline_eligible").alias("baseline_eligible_securities"),
                        F.count_if(~F.col("ever_baseline_eligible")).alias("excluded_securities"),
                        F.count_if("eligible").alias("eligible_on_final_global_calendar_date"))
    end = membership.agg(F.date_format(F.max("date"), "yyyy-MM-dd").alias("sample_end"))
    wide = counts.crossJoin(end)
    names = [*counts.columns, "sample_end"]
    return wide.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "metric", "value")


def excluded_securities(sample: DataFrame) -> DataFrame:
    return sample.where("NOT ever_baseline_eligible")


def exclusion_reason_summary(sample: DataFrame) -> DataFrame:
    return (excluded_securities(sample)
            .withColumn("baseline_exclusion_reason", F.explode(F.split("baseline_exclusion_reason", ";")))
            .groupBy("baseline_exclusion_reason").agg(F.count("*").alias("security_count")))


def short_history_exclusions(coverage: DataFrame) -> DataFrame:
    return coverage.where("short_history_company").select(
        "security_id", "ticker", "first_trading_date", "last_trading_date", "number_of_observations", "issues")


def dimension_labels(events: DataFrame, dimensions: dict[str, Column], total: bool = True) -> DataFrame:
    """(event_id, dimension, label) rows: one explode serves every dimension count."""
    entries = [F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("label")) for d, c in dimensions.items()]
    if total:
        entries.insert(0, F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("label")))
    return events.select("event_id", F.inline(F.array(*entries)))


def event_summary(events: DataFrame, dimensions: dict[str, Column] | None = None, share: bool = False) -> DataFrame:
    dims = dimensions or {"direction": F.col("direction"), "year": F.year("date"), "subsector": F.col("subsector")}
    rows = dimension_labels(events, dims).groupBy("dimension", "label").agg(F.count("*").alias("event_count"))
    if share:
        total = events.agg(F.greatest(F.count_distinct("event_id"), F.lit(1)).alias("__n"))
        rows = rows.crossJoin(F.broadcast(total)).withColumn("event_share", F.col("event_count") / F.col("__n")).drop("__n")
    return rows


def company_concentration(events: DataFrame, master: DataFrame) -> DataFrame:
    firms = events.groupBy("security_id").agg(F.count_distinct("event_id").alias("event_count"), F.min("subsector").alias("subsector"))
    total = firms.agg(F.sum("event_count").alias("__n"), F.count("*").alias("__f"))
    share = F.col("event_count") / F.greatest("__n", F.lit(1))
    return (firms.join(master.select("security_id", "ticker", "company_name"), "security_id", "left")
            .crossJoin(F.broadcast(total))
            .select("security_id", "ticker", "company_name", "subsector", "event_count", share.alias("event_share"),
                    (share > F.greatest(F.lit(0.10), 2.0 / F.col("__f"))).alias("dominant_company_flag")))


def date_concentration(events: DataFrame) -> DataFrame:
    return events.groupBy("date").agg(
        F.count_distinct("event_id").alias("event_count"), F.count_distinct("subsector").alias("subsector_count"),
        (F.count_distinct("event_id") >= 3).alias("many_simultaneous_shocks_flag"))


def horizon_missingness(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("horizon").agg(
        F.count_distinct("event_id").alias("total_events"), F.count_if("valid_horizon").alias("complete_horizons"),
        (F.count_distinct("event_id") - F.count_if("valid_horizon")).alias("excluded_horizons"))


def missingness_reasons(outcomes: DataFrame) -> DataFrame:
    return exploded_reasons(outcomes).groupBy("horizon", "missing_reason").agg(F.count("*").alias("excluded_events"))


def mechanism_decomposition(summary: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per horizon with the headline metrics of the three outcomes, long to wide."""
    every = summary.where("direction = 'all'")
    metrics = ("mean", "median", "ci_lower", "ci_upper")
    wide = every.groupBy("horizon").agg(*[F.max(F.when(F.col("outcome") == o, F.col(m))).alias(f"{o}_{m}")
                                          for o in OUTCOMES for m in metrics])
    valid = outcomes.groupBy("horizon").agg(F.count_if("valid_horizon").alias("valid_events"))
    return valid.join(wide, "horizon", "left")


def subsector_summary(events: DataFrame, master: DataFrame) -> DataFrame:
    """Event counts completed to every classified subsector."""
    found = events.groupBy("subsector").agg(
        F.count_distinct("event_id").alias("event_count"), F.count_if(F.col("direction") == "positive").alias("positive_shocks"),
        F.count_if(F.col("direction") == "negative").alias("negative_shocks"),
        F.count_distinct("security_id").alias("initiating_companies"))
    classified = master.groupBy("subsector").agg(F.count_distinct("security_id").alias("classified_securities"))
    counts = ("event_count", "positive_shocks", "negative_shocks", "initiating_companies")
    return found.join(classified, "subsector", "right").fillna(0, list(counts))


def labelled_counts(events: DataFrame, dimensions: dict[str, Column], adequate: str = "adequate_analysis_sample") -> DataFrame:
    """Share and label of each category inside one group of events."""
    total = events.agg(F.greatest(F.count("*"), F.lit(1)).alias("__n"))
    counts = dimension_labels(events, dimensions, total=False).groupBy("dimension", "label").agg(F.count("*").alias("event_count"))
    return (counts.crossJoin(F.broadcast(total))
            .select("dimension", "label", "event_count", (F.col("event_count") / F.col("__n")).alias("event_share_within_group"),
                    sample_label(F.col("event_count"), adequate).alias("sample_label")))


def concentration(events: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Categories, largest share, Herfindahl index and effective number per dimension."""
    counts = dimension_labels(events, dimensions, total=False).groupBy("dimension", "label").agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("__n"))
    shares = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__n"))
    # Ties for the largest category go to the label that sorts first.
    largest = F.min(F.struct((-F.col("n")).alias("k"), F.col("label").alias("label"))).getField("label")
    return shares.groupBy("dimension").agg(
        F.count("*").alias("category_count"), largest.alias("largest_category"),
        F.max("share").alias("largest_category_share"), F.sum(F.col("share") * F.col("share")).alias("herfindahl_index"),
        (1 / F.sum(F.col("share") * F.col("share"))).alias("effective_category_count"), F.max("__n").alias("event_count"))


def bundle_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
                      for n, df in tables.items()])
