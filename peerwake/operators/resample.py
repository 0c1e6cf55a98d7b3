"""Placebos, resampled nulls and stability, with the iteration as a key column.

Draws are digests of (seed, iteration, row key): the same on every retry, on every
executor and in SQL. No iteration loop runs on the driver.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import issue_rows
from ..functions.checkpoints import staged
from ..functions.draws import drawn_sums
from ..functions.exprs import digest, draw_index, gated, null_safe_on, shuffled_places, tagged_id, trailing, union_all
from ..functions.selection import dense_index, percentiles
from ..params import CELL, ECONOMIC, OUTCOMES, Detection, Resampling, Study, signature
from . import events as ev
from . import peers as pr
from . import study as st
from .inference import bootstrap_means
from .mechanism import date_frame
from .reports import long_outcomes, mean_interval

# Display names of the experiments.
METHOD_LABELS = {"observed": "Observed", "random_peers": "Random peers", "pseudo_events": "Pseudo-events",
                 "null_simulation": "Null simulation", "temporal_placebo": "Temporal placebo"}


def _rounds(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


# --- Random peers -----------------------------------------------------------------------------


def random_peer_edges(events: DataFrame, sizes: DataFrame, pool: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """As many random eligible peers as the event had, without replacement, never the event's own firm.

    ``pool`` has (date, security_id) of eligible securities, ``sizes`` (event_id,
    portfolio_size, weight), and in place of equal weights a ``weights`` array of the event's own. The pool
    of a date is numbered once. Each event and iteration takes the first places of its own keyed
    permutation of the other firms, so subsets of one date are independent, and the weights, given out in
    that order, are permuted with them. The work is the size of the output.
    """
    dates = events.select("date").distinct()
    circle = pool.join(dates, "date", "left_semi").select("date", "security_id").withColumn("__h", digest(seed, F.col("date"), F.col("security_id")))
    circle = staged(dense_index(circle, ["date"], "__h", "place").select("date", "security_id", "place", F.col("place_total").alias("pool_size")), "pool_places")
    own = events.select("event_id", "date", "security_id", "peer_definition").join(sizes, "event_id")
    own = own.join(circle.select("date", "security_id", F.col("place").alias("__mine")), ["date", "security_id"], "left")
    own = own.join(circle.groupBy("date").agg(F.max("pool_size").alias("__pool")), "date", "left")
    others = F.coalesce("__pool", F.lit(0)) - F.when(F.col("__mine").isNotNull(), 1).otherwise(0)
    fits = F.when(others >= F.col("portfolio_size"), F.col("portfolio_size")).otherwise(
        F.raise_error(F.concat(F.lit("too few random-peer candidates for "), F.col("event_id"))).cast("bigint"))
    # An event is one short row but many draws, so the number of tasks is given: AQE would join them (it also drops an exchange by event_id alone).
    spark = events.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = own.withColumn("__others", others).withColumn("portfolio_size", fits).repartition(tasks, "event_id", "security_id")
    own = _rounds(own, iterations, "iteration")
    places = shuffled_places(F.col("__others"), F.col("portfolio_size"), seed, F.lit("peers"), F.col("iteration"), F.col("event_id"))
    slots = own.select("*", F.posexplode(places).alias("slot", "step"))
    # Places count the other firms only: step over the event's own one.
    step, mine = F.col("step"), F.col("__mine")
    slots = slots.withColumn("place", F.when(mine.isNotNull() & (step >= mine), step + 1).otherwise(step))
    if "weights" in sizes.columns:
        slots = slots.withColumn("weight", F.get("weights", F.col("slot")))
    peers = circle.select("date", "place", F.col("security_id").alias("peer_id"))
    return slots.join(peers, ["date", "place"]).select("iteration", "event_id", "date", "security_id", "peer_id", "peer_definition", "weight")


def random_peer_rules(edges: DataFrame, sizes: DataFrame, pool: DataFrame) -> DataFrame:
    """Violations of the placebo's promises: self peers, weight sums, counts, eligibility and the weights as a sorted list."""
    name = "random_peers"
    base = issue_rows(edges, {("self_peer", "peer_id"): F.count_if(F.col("security_id") == F.col("peer_id")),
                              ("negative_weight", "weight"): F.count_if(F.col("weight") < 0)}, name)
    held = edges.groupBy("iteration", "event_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.count_distinct("peer_id").alias("d"),
                                                      F.sort_array(F.collect_list("weight")).alias("ws"))
    was = F.sort_array("weights") if "weights" in sizes.columns else F.array_repeat("weight", F.col("portfolio_size").cast("int"))
    held = held.join(sizes.select("event_id", "portfolio_size", was.alias("was")), "event_id", "left")
    changed = F.exists(F.zip_with("ws", "was", lambda x, y: F.coalesce(F.abs(x - y) > 1e-12, F.lit(True))), lambda x: x)
    counts = issue_rows(held, {
        ("invalid_weight_sum", "weight"): F.count_if(F.abs(F.col("w") - 1) > 1e-10),
        ("peer_count_changed", "peer_id"): F.count_if((F.col("n") != F.col("portfolio_size")) | (F.col("d") != F.col("n"))),
        ("weight_rule_changed", "weight"): F.count_if(changed)}, name)
    outside = edges.join(pool.select("date", F.col("security_id").alias("peer_id")), ["date", "peer_id"], "left_anti")
    return union_all([base, counts, issue_rows(outside, {("ineligible_peer", "peer_id"): F.count("*")}, name)])


def random_peer_placebo(events: DataFrame, edges: DataFrame, frame: DataFrame, p: Study, spec: str, calendar: DataFrame,
                        iterations: int) -> DataFrame:
    """The event study on random portfolios, all iterations in one pass."""
    keyed = _rounds(events, iterations, "iteration")
    panel = staged(st.event_panel(keyed, frame, p, spec, keys=("iteration",), edges=edges, calendar=calendar), "random_panel")
    return st.event_outcomes(keyed, panel, p, ("iteration",))


# --- Pseudo-events ----------------------------------------------------------------------------


def with_running_median(rows: DataFrame, value: str, name: str, minimum: int) -> DataFrame:
    """``rows`` with the median of the firm's earlier values, once there are ``minimum`` of them; nulls don't count.

    One pass keeps a firm's earlier values sorted (a skip list), where a window would sort
    all of them anew for each row. A group is one firm, so at most one calendar of rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("date")
        earlier = pd.Series(group.column(value).to_numpy()).expanding(minimum).median().shift(1)
        return group.append_column(name, pa.array(earlier, pa.float64(), from_pandas=True))

    return rows.groupBy("security_id").applyInArrow(run, schema)


def matching_panel(panel: DataFrame, factor: DataFrame) -> DataFrame:
    """Strata known before the date: own volatility regime, liquidity bucket, sector direction."""
    own = lambda n: trailing(["security_id"], "date", n)
    dollar = F.col("adj_close") * F.col("volume")
    rows = panel.select(
        "date", "security_id", "eligible", "subsector", "peer_group", gated(F.stddev_samp("return"), F.col("return"), own(21), 15).alias("__vol"),
        F.when(F.count(dollar).over(own(20)) >= 10, F.percentile(dollar, F.lit(0.5)).over(own(20))).alias("__liq"),
        F.lag("date").over(Window.partitionBy("security_id").orderBy("date")).alias("matching_information_max_date"))
    rows = staged(with_running_median(rows, "__vol", "__typical", 20), "strata")  # read by each step of the median of a date
    depth = percentiles(rows, ["date"], "__liq", {"__middle": 0.5})
    x = F.col("semiconductor_return")
    drift = gated(F.sum(x), x, date_frame(21), 15)
    state = factor.select("date", F.when(drift >= 0, F.lit("sector_up")).otherwise(F.lit("sector_down")).alias("market_regime"))
    return (rows.join(depth, "date", "left").join(F.broadcast(state), "date", "left")
            .select("date", "security_id", "eligible", "subsector", "peer_group",
                    F.when(F.col("__vol") >= F.col("__typical"), F.lit("high")).otherwise(F.lit("normal")).alias("volatility_regime"),
                    "market_regime",
                    F.when(F.col("__liq") >= F.col("__middle"), F.lit("high")).otherwise(F.lit("low")).alias("liquidity_bucket"),
                    "matching_information_max_date"))


def pseudo_event_candidates(events: DataFrame, matching: DataFrame, portfolios: DataFrame, match: tuple[str, ...],
                            exclusion_days: int) -> DataFrame:
    """Eligible dates of the same firm in the same strata, away from all of its events, with peers that date.

    The exclusion is a per-firm window test on sorted dates: the nearest event before and
    after each date decides, so events and dates are never paired.
    """
    firms = events.select("security_id").distinct()
    marks = events.select("security_id", "date").distinct().withColumn("__e", F.col("date"))
    rows = matching.join(firms, "security_id", "left_semi").join(marks, ["security_id", "date"], "full_outer")
    order = Window.partitionBy("security_id").orderBy("date")
    last = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min("__e").over(order.rowsBetween(0, Window.unboundedFollowing))
    near = (F.coalesce(F.datediff("date", last), F.lit(1 << 30)) <= exclusion_days) | (
        F.coalesce(F.datediff(following, F.col("date")), F.lit(1 << 30)) <= exclusion_days)
    free = rows.withColumn("__near", near).where("NOT __near AND eligible").drop("__e", "__near")
    free = free.join(portfolios.select("date", "security_id", "peer_definition"), ["date", "security_id"])
    source = events.select("event_id", F.col("date").alias("real_date"), "security_id", "peer_definition").join(
        matching.select(F.col("date").alias("real_date"), "security_id", *match), ["real_date", "security_id"])
    return source.join(free.select("date", "security_id", "peer_definition", *match), ["security_id", "peer_definition", *match])


def pseudo_events(events: DataFrame, candidates: DataFrame, match: tuple[str, ...], iterations: int, seed: int = 42,
                  strict: bool = True) -> DataFrame:
    """One candidate date per event and iteration; an event without one raises unless ``strict`` is off.

    The pool of one event is at most the calendar, so its dates are held as one array and
    an iteration is an index draw into it.
    """
    pools = candidates.groupBy("event_id").agg(F.array_sort(F.collect_list("date")).alias("__dates"))
    base = events.withColumnRenamed("date", "__real").join(pools, "event_id", "left" if strict else "inner")
    pool = F.col("__dates")
    if strict:
        pool = F.when(F.size("__dates") > 0, pool).otherwise(
            F.raise_error(F.concat(F.lit("no matched pseudo-date for "), F.col("event_id"))).cast("array<date>"))
    base = _rounds(base.withColumn("__dates", pool), iterations, "iteration")
    pick = draw_index(F.size("__dates").cast("bigint"), seed, F.col("iteration"), F.col("event_id"))
    out = base.withColumn("date", F.element_at("__dates", (pick + 1).cast("int")))
    return (out.withColumn("source_event_id", F.col("event_id"))
            .withColumn("event_id", tagged_id("pseudo_", F.col("source_event_id"), F.col("date")))
            .withColumn("simultaneous_event_group", F.lit(None).cast("string")).drop("__dates", "__real"))


def pseudo_event_rules(pseudo: DataFrame, events: DataFrame, matching: DataFrame, match: tuple[str, ...], exclusion_days: int) -> DataFrame:
    real = events.select(F.col("event_id").alias("source_event_id"), F.col("security_id").alias("__firm"), F.col("date").alias("__real"))
    strata = matching.select("date", "security_id", "eligible", *match)
    rows = pseudo.select("iteration", "source_event_id", "date", "security_id").join(real, "source_event_id", "left")
    rows = rows.join(strata, ["date", "security_id"], "left").join(
        strata.select(F.col("date").alias("__real"), F.col("security_id").alias("__firm"), *[F.col(c).alias(f"__{c}") for c in match]),
        ["__real", "__firm"], "left")
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    return issue_rows(rows, {
        ("company_changed", "security_id"): bad(F.col("security_id") == F.col("__firm")),
        ("inside_exclusion_window", "date"): F.count_if(F.abs(F.datediff("date", "__real")) <= exclusion_days),
        ("ineligible", "date"): bad(F.col("eligible")),
        **{("stratum_changed", c): bad(F.col(c) == F.col(f"__{c}")) for c in match}}, "pseudo_events")


def pseudo_event_placebo(pseudo: DataFrame, matching: DataFrame, frame: DataFrame, p: Study, spec: str, calendar: DataFrame) -> DataFrame:
    """The event study on matched non-event dates, keyed by iteration."""
    keys = ("iteration", "source_event_id")
    panel = staged(st.event_panel(pseudo, frame, p, spec, keys=keys, calendar=calendar), "pseudo_panel")
    # Overlap is judged among the events of one iteration.
    flags = st.overlap_flags(panel.withColumn("event_id", F.col("source_event_id")), p, ("iteration",)).withColumnRenamed(
        "event_id", "source_event_id")
    out = st.event_outcomes(pseudo, panel, p, keys).drop("overlapping_post_event_window").join(flags, ["iteration", "source_event_id"], "left")
    return out.withColumn("overlapping_post_event_window", F.coalesce("overlapping_post_event_window", F.lit(False)))


def temporal_placebo(events: DataFrame, panel: DataFrame, p: Study) -> DataFrame:
    return st.event_outcomes(events, st.reverse_time(panel), p).withColumn("method", F.lit("temporal_placebo"))


# --- Resampled returns --------------------------------------------------------------------------


def donor_dates(regimes: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """For each iteration and date, a donor date of the same regime that is not later.

    The k-th date of a regime draws uniformly among its first k, itself included. One row
    per date and iteration. A date whose regime is null has no donor: ``source_date`` is null.
    """
    order = Window.partitionBy("regime").orderBy("date")
    ranked = regimes.select("date", "regime", F.row_number().over(order).cast("bigint").alias("rank"))
    drawn = _rounds(ranked, iterations, "null_iteration")
    drawn = drawn.withColumn("__pick", draw_index(F.col("rank"), seed, F.col("null_iteration"), F.col("date")) + 1)
    donors = ranked.select("regime", F.col("rank").alias("__pick"), F.col("date").alias("source_date"))
    return drawn.join(F.broadcast(donors), ["regime", "__pick"], "left").select(
        "null_iteration", F.col("date").alias("target_date"), "source_date", "regime",
        F.coalesce(F.col("source_date") > F.col("date"), F.lit(False)).alias("future_data_used"))


def null_returns(returns: DataFrame, donors: DataFrame, value: str) -> DataFrame:
    """Own-date mean plus the donor date's residual: one row per input row and iteration.

    The value is null where a date has no donor or the security was not observed on it; a
    date that the donors don't name at all is an error. The work is the size of the output:
    rows meet their date's draws and then the one residual of (security, donor date).
    """
    mean = returns.groupBy("date").agg(F.avg(value).alias("__m"))
    rows = returns.select("date", "security_id", F.col(value).alias("__x")).join(F.broadcast(mean), "date")
    residuals = rows.where("__x IS NOT NULL").select("security_id", F.col("date").alias("source_date"), (F.col("__x") - F.col("__m")).alias("__r"))
    dated = donors.select("null_iteration", F.col("target_date").alias("date"), "source_date")
    wide = rows.select("date", "security_id", "__m").join(dated, "date", "left").join(residuals, ["security_id", "source_date"], "left")
    named = F.when(F.col("null_iteration").isNull(), F.raise_error(F.lit("a return date has no row among the donors")).cast("int"))
    return wide.select(F.coalesce("null_iteration", named).alias("null_iteration"), "date", "security_id",
                       (F.col("__m") + F.col("__r")).alias(value), "source_date")


def detection_metadata(relative: DataFrame, panel: DataFrame) -> DataFrame:
    """Labels every simulated candidate keeps from the observed panel."""
    action = F.when(F.coalesce("extreme_return_flag", F.lit(False)), F.lit("unknown")).otherwise(F.lit("none"))
    return relative.select("date", "security_id", "peer_definition").join(
        panel.select("date", "security_id", "subsector", "peer_group", "volume", "extreme_return_flag"), ["date", "security_id"], "left").select(
        "date", "security_id", "peer_definition", "subsector", "volume", "extreme_return_flag", "peer_group",
        action.alias("corporate_action_type"), F.lit(None).cast("double").alias("market_cap"), F.lit(False).alias("earnings_flag"),
        F.lit(False).alias("news_identified_flag"))


def _draws_of_rows(returns: DataFrame, donors: DataFrame, value: str) -> DataFrame:
    """``null_returns`` as one row for each row of ``returns``: ``draws``, an array by iteration, the same iterations for all rows of a date.

    A security's rows meet as one row (at most one calendar of them), so no row is moved once for each iteration.
    """
    mean = returns.groupBy("date").agg(F.avg(value).alias("__m"))
    rows = returns.select("date", "security_id", F.col(value).alias("__x")).join(F.broadcast(mean), "date")
    days = donors.groupBy(F.col("target_date").alias("date")).agg(F.sort_array(F.collect_list(F.struct("null_iteration", "source_date"))).alias("__donors"))
    held = rows.groupBy("security_id").agg(F.collect_list(F.struct("date", F.col("__m").alias("m"), (F.col("__x") - F.col("__m")).alias("r"))).alias("__rows"))
    placed = held.select("security_id", F.col("__rows.date").alias("__dates"), F.col("__rows.r").alias("__past"),
                         F.inline(F.transform("__rows", lambda e: F.struct(e["date"], e["m"].alias("__m")))))
    past = lambda d: F.get("__past", (F.array_position("__dates", d["source_date"]) - 1).cast("int"))
    draws = F.transform("__donors", lambda d: F.struct(d["null_iteration"].alias("null_iteration"), (F.col("__m") + past(d)).alias("x")))
    named = F.when(F.col("__donors").isNull(), F.raise_error(F.lit("a return date has no row among the donors")).cast("array<struct<null_iteration:int,x:double>>"))
    return placed.join(F.broadcast(days), "date", "left").select("date", "security_id", F.coalesce(draws, named).alias("draws"))


def null_detection_input(returns: DataFrame, donors: DataFrame, panel: DataFrame, metadata: DataFrame, value: str) -> DataFrame:
    """Relative returns of the simulated panel, unobservable rows dropped, labels joined.

    A row keeps its iterations in one array until it has met its peers and labels. A group's sums are an array by
    iteration too; the iterations of a date are the same for all rows, so arrays meet by place.
    """
    cell = ["date", "peer_group"]
    rows = _draws_of_rows(returns, donors, value).join(panel.where("eligible").select("date", "security_id", "peer_group"), ["date", "security_id"])
    labels = metadata.where(F.col("peer_definition") == ECONOMIC).withColumnRenamed("peer_group", "__label")
    # Written once, as rows and sums below read it: the draws are looked up once.
    moved = staged(rows.join(labels.drop("peer_definition"), ["date", "security_id"], "left"), "null_draws").repartition(*cell)
    spread = moved.select(*cell, F.posexplode("draws").alias("at", "e"))
    sums = spread.groupBy(*cell, "at").agg(F.sum("e.x").alias("s"), F.count("e.x").alias("n"), F.count("*").alias("members"))
    sums = sums.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("at", "s", "n", "members"))).alias("__sums"))
    both = moved.join(sums, cell).where(F.col("__sums")[0]["members"] > 1)
    extra = [c for c in labels.columns if c not in ("date", "security_id", "peer_definition", "__label")]
    met = both.select("date", "security_id", F.lit(ECONOMIC).alias("peer_definition"), "__label", *extra, F.inline(F.arrays_zip("draws", "__sums")))
    own, count = F.col("draws.x"), F.col("__sums.n") - 1
    known = F.when(F.col("__label").isNotNull(), F.col("__label")).otherwise(
        F.raise_error(F.lit("detection metadata does not cover every simulated return")).cast("string"))
    peer = (F.col("__sums.s") - own) / count
    return met.where(own.isNotNull() & (count > 0)).select(
        F.col("draws.null_iteration").alias("null_iteration"), "date", "security_id", "peer_definition", count.alias("peer_count"),
        own.alias("stock_abnormal_return"), peer.alias("peer_abnormal_return"), (own - peer).alias("relative_abnormal_return"),
        *extra, known.alias("peer_group"))


def selection_preserving_null(simulated: DataFrame, detection_input: DataFrame, panel: DataFrame, donors: DataFrame, detection: Detection,
                              p: Study, value: str, spec: str, calendar: DataFrame,
                              one_group_per_firm: bool | None = None) -> dict[str, DataFrame]:
    """Redetect and rerun the event study in every iteration; selection is part of the null."""
    key = ("null_iteration",)
    events = staged(ev.detect_events(detection_input, detection, keys=key, one_group_per_firm=one_group_per_firm), "null_events")
    frame = st.study_frame(simulated.join(panel.select("date", "security_id", "eligible", "peer_group"), ["date", "security_id"]), value, keys=key)
    epanel = staged(st.event_panel(events, frame, p, spec, keys=key, frame_keys=key, calendar=calendar), "null_panel")
    outcomes = staged(st.event_outcomes(events, epanel, p, key), "null_outcomes")
    counts = events.groupBy(*key).agg(F.count("*").alias("detected_event_count"))
    distribution = iteration_means(outcomes, "null_iteration").join(counts, "null_iteration", "left")
    future = donors.groupBy(*key).agg(F.bool_or("future_data_used").alias("future_data_used"))
    valid = outcomes.groupBy(*key).agg(F.count_if("valid_horizon").alias("valid_outcome_count"))
    diagnostics = future.join(counts, "null_iteration", "left").join(valid, "null_iteration", "left").select(
        "null_iteration", F.coalesce("detected_event_count", F.lit(0)).alias("detected_event_count"),
        F.coalesce("valid_outcome_count", F.lit(0)).alias("valid_outcome_count"),
        F.lit(signature(detection)).alias("detection_config_signature"), F.lit(signature(p)).alias("event_study_config_signature"), "future_data_used")
    return {"event_results": outcomes, "distribution": distribution, "diagnostics": diagnostics, "resampling_audit": donors}


def iteration_means(outcomes: DataFrame, iteration: str) -> DataFrame:
    values = long_outcomes(outcomes, [iteration, *CELL])
    return values.groupBy(iteration, *CELL, "outcome").agg(F.avg("x").alias("statistic"), F.count("x").alias("sample_size"))


def observed_cells(outcomes: DataFrame) -> DataFrame:
    return long_outcomes(outcomes, list(CELL)).groupBy(*CELL, "outcome").agg(
        F.avg("x").alias("observed_statistic"), F.count("x").alias("observed_sample_size"))


def empirical_p_value(outcomes: DataFrame, distribution: DataFrame) -> DataFrame:
    """Finite-simulation p-value and percentile location of each observed mean."""
    keys = [*CELL, "outcome"]
    seen = observed_cells(outcomes)
    joined = null_safe_on(seen, distribution.select(*keys, "statistic"), keys)
    s, o = F.col("statistic"), F.col("observed_statistic")
    stats = joined.groupBy(*keys, "observed_statistic", "observed_sample_size").agg(
        F.avg("statistic").alias("null_mean"), F.stddev_samp("statistic").alias("null_standard_deviation"),
        F.count("statistic").alias("null_iterations"), F.count_if(s >= o).alias("__ge"), F.count_if(s < o).alias("__lt"), F.count_if(s == o).alias("__eq"))
    n = F.col("null_iterations")
    ready = (n > 0) & o.isNotNull()
    return stats.select(
        *keys, "observed_statistic", "observed_sample_size", "null_mean", "null_standard_deviation", "null_iterations",
        F.when(ready, (1 + F.col("__ge")) / (n + 1)).alias("empirical_p_value"),
        F.when(ready, 100 * (F.col("__lt") + 0.5 * F.col("__eq")) / F.nullif(n, F.lit(0))).alias("percentile_location"), F.lit("greater").alias("alternative"))


# --- Bootstraps ---------------------------------------------------------------------------------


def dependence_bootstrap(outcomes: DataFrame, method: str, iterations: int, seed: int = 42, block: int = 5) -> DataFrame:
    """Cell means when whole firms, or circular runs of event dates, are drawn with replacement.

    A draw is a table of (iteration, unit, times); cell means follow from per-unit sums.
    """
    if method not in ("firm", "date"):
        raise ValueError("method must be firm or date")
    unit = "security_id" if method == "firm" else "event_date"
    keys = [*CELL, "outcome"]
    values = long_outcomes(outcomes, [*CELL, unit])
    sums = values.groupBy(*keys, unit).agg(F.sum("x").alias("__s"), F.count("x").alias("__c"))
    units = outcomes.where("valid_horizon").select(unit).distinct()
    if method == "firm":
        numbered = dense_index(units.withColumn("__h", digest(F.col(unit))), [], "__h", "__i").withColumnRenamed("__i_total", "__n").drop("__h")
        rows = sums.join(numbered, unit).select(*keys, "__i", "__n", F.coalesce("__s", F.lit(0.0)).alias("__s"), "__c", F.lit(1).alias("__u"))
        drawn = drawn_sums(rows, [], keys, ["__s", "__c", "__u"], iterations, seed, total="__n")
        out = drawn.where("__u > 0").select(F.col("iteration").alias("bootstrap_iteration"), *keys, F.try_divide("__s", "__c").alias("statistic"),
                                            F.col("__c").cast("bigint").alias("sample_size"))
    else:
        # Event dates are bounded by the calendar: one small ordered list.
        numbered = units.select(unit, (F.row_number().over(Window.orderBy(unit)) - 1).cast("bigint").alias("__i"))
        numbered = numbered.crossJoin(F.broadcast(numbered.agg(F.count("*").alias("__n"))))
        slots = _rounds(numbered.select(F.col("__i").alias("__slot"), "__n"), iterations, "bootstrap_iteration")
        start = draw_index(F.col("__n"), seed, F.col("bootstrap_iteration"), F.floor(F.col("__slot") / block))
        draws = slots.withColumn("__i", F.pmod(start + F.pmod(F.col("__slot"), F.lit(block)), F.col("__n")))
        times = draws.groupBy("bootstrap_iteration", "__i").agg(F.count("*").alias("__t")).join(numbered.drop("__n"), "__i")
        out = times.join(sums, unit).groupBy("bootstrap_iteration", *keys).agg(
            F.try_divide(F.sum(F.col("__t") * F.col("__s")), F.nullif(F.sum(F.col("__t") * F.col("__c")), F.lit(0))).alias("statistic"),
            F.sum(F.col("__t") * F.col("__c")).alias("sample_size"))
    return out.withColumn("bootstrap_method", F.lit(method))


def event_bootstrap(outcomes: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """Cell means of events drawn with replacement inside the cell; the outcomes of a draw stay together."""
    valid = outcomes.where("valid_horizon").withColumn("__h", F.col("event_id"))
    numbered = dense_index(valid.withColumn("__h", digest(F.col("event_id"))).select(*CELL, "__h", *OUTCOMES), list(CELL), "__h", "__i")
    values = {f"__s{i}": F.coalesce(o, F.lit(0.0)) for i, o in enumerate(OUTCOMES)} | {f"__c{i}": F.col(o).isNotNull().cast("int") for i, o in enumerate(OUTCOMES)}
    sums = drawn_sums(numbered.withColumns(values), list(CELL), [], list(values), iterations, seed)
    each = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"__s{i}").alias("s"), F.col(f"__c{i}").alias("c")) for i, o in enumerate(OUTCOMES)])
    out = sums.select(F.col("iteration").alias("bootstrap_iteration"), *CELL, F.inline(each)).where("c > 0").select(
        "bootstrap_iteration", *CELL, "outcome", (F.col("s") / F.col("c")).alias("statistic"), F.col("c").cast("bigint").alias("sample_size"))
    return out.withColumn("bootstrap_method", F.lit("event"))


def bootstrap_summary(distribution: DataFrame) -> DataFrame:
    keys = ["bootstrap_method", *CELL, "outcome"]
    distribution = staged(distribution, "bootstrap")  # one row an iteration, read by each step below
    base = distribution.groupBy(*keys).agg(F.avg("statistic").alias("estimate"), F.count("statistic").alias("bootstrap_iterations"),
                                           F.avg("sample_size").alias("sample_size"))
    return null_safe_on(base, percentiles(distribution, keys, "statistic", {"ci_lower": 0.025, "ci_upper": 0.975}), keys)


def method_comparison(experiments: dict[str, DataFrame], null_distribution: DataFrame, p: Resampling) -> DataFrame:
    """Mean and interval per method: iteration means where there are iterations, a firm bootstrap elsewhere.

    ``experiments`` maps a method to its outcomes; frames with an ``iteration`` column are
    repeated experiments.
    """
    keys = [*CELL, "outcome"]
    tail = (1 - p.confidence_level) / 2
    parts = []
    for method, frame in experiments.items():
        base = long_outcomes(frame, list(CELL)).groupBy(*keys).agg(F.avg("x").alias("mean"), F.count("x").alias("__n"))
        if "iteration" in frame.columns:
            means = iteration_means(frame, "iteration")
            extra = means.groupBy(*keys).agg(F.bround(F.avg("sample_size"), 0).cast("bigint").alias("sample_size"))
        else:
            means = staged(dependence_bootstrap(frame, "firm", p.bootstrap_iterations, p.random_seed, p.date_block_length), "bootstrap")
            extra = base.select(*keys, F.col("__n").alias("sample_size"))
        parts.append(_method_rows(method, base, means, extra, keys, tail))
    base = null_distribution.groupBy(*keys).agg(F.avg("statistic").alias("mean"))
    extra = null_distribution.groupBy(*keys).agg(F.bround(F.avg("sample_size"), 0).cast("bigint").alias("sample_size"))
    parts.append(_method_rows("null_simulation", base, null_distribution, extra, keys, tail))
    return union_all(parts)


def _method_rows(method: str, base: DataFrame, means: DataFrame, extra: DataFrame, keys: list[str], tail: float) -> DataFrame:
    counts = means.groupBy(*keys).agg(F.count("statistic").alias("experiment_iterations"))
    bands = percentiles(means, keys, "statistic", {"ci_lower": tail, "ci_upper": 1 - tail})
    out = null_safe_on(null_safe_on(null_safe_on(base, extra, keys), counts, keys), bands, keys)
    return out.select(*keys, F.lit(method).alias("method"), F.lit(METHOD_LABELS.get(method, method)).alias("method_label"), "mean",
                      "ci_lower", "ci_upper", "sample_size", "experiment_iterations")


# --- Stability ------------------------------------------------------------------------------------


def time_period_stability(outcomes: DataFrame, periods: list[tuple[str, int, int]]) -> DataFrame:
    """Fixed calendar-year periods, declared before any outcome is summarised."""
    year = F.year("event_date")
    label = F.lit("outside_frozen_sample")
    for name, lo, hi in reversed(periods):
        label = F.when(year.between(lo, hi), F.lit(name)).otherwise(label)
    rows = outcomes.withColumn("group", label)
    values = long_outcomes(rows, ["group", "horizon", "event_id"])
    stats = values.groupBy("group", "horizon", "outcome").agg(F.count_distinct("event_id").alias("event_count"), F.count("x").alias("sample_size"),
                                                              F.avg("x").alias("mean"), F.stddev_samp("x").alias("__sd"))
    return mean_interval(stats, "sample_size", "mean", "__sd").withColumn("analysis", F.lit("time_period")).drop("__sd")


def contribution_analysis(outcomes: DataFrame, master: DataFrame, horizon: int = 5) -> DataFrame:
    """Each initiator's and each subsector's part of the full-sample catch-up mean."""
    rows = outcomes.where(F.col("valid_horizon") & (F.col("horizon") == horizon)).join(master.select("security_id", "ticker"), "security_id", "left")
    total = rows.agg(F.count("*").alias("__n"))
    spread = rows.select("event_id", "peer_catchup", F.inline(F.array(
        F.struct(F.lit("initiator_contribution").alias("analysis"), F.col("ticker").alias("group")),
        F.struct(F.lit("peer_group_contribution").alias("analysis"), F.col("subsector").alias("group")))))
    out = spread.groupBy("analysis", "group").agg(F.count_distinct("event_id").alias("event_count"), F.count("peer_catchup").alias("sample_size"),
                                                  F.avg("peer_catchup").alias("mean"), F.sum("peer_catchup").alias("__s"))
    return out.crossJoin(F.broadcast(total)).select(
        "analysis", "group", F.lit(horizon).alias("horizon"), F.lit("peer_catchup").alias("outcome"), "event_count", "sample_size", "mean",
        (F.col("__s") / F.col("__n")).alias("contribution_to_full_sample_mean"), (F.col("sample_size") / F.col("__n")).alias("event_share"))


def event_dependence(outcomes: DataFrame, horizon: int = 5) -> DataFrame:
    """Ten measures of overlap and concentration among the complete events of one horizon."""
    rows = outcomes.where(F.col("valid_horizon") & (F.col("horizon") == horizon))
    n = rows.agg(F.count("*").alias("n"), F.avg(F.col("overlapping_post_event_window").cast("double")).alias("overlap"))

    def spread(column: str, tag: str) -> DataFrame:
        counts = rows.groupBy(column).agg(F.count("*").alias("c"))
        return counts.agg(F.count("*").alias(f"u_{tag}"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias(f"r_{tag}"),
                          F.max("c").alias(f"m_{tag}"), F.sum(F.col("c") * F.col("c")).alias(f"q_{tag}"))

    wide = n.crossJoin(spread("security_id", "f")).crossJoin(spread("event_date", "d"))
    share = lambda c: F.try_divide(c, "n")
    effective = lambda c: F.try_divide(F.col("n") * F.col("n"), c)
    metrics = {
        "valid_five_day_events": F.col("n"), "unique_initiators": F.col("u_f"), "unique_event_dates": F.col("u_d"),
        "overlapping_window_share": F.col("overlap"), "same_day_event_share": share("r_d"), "repeated_initiator_share": share("r_f"),
        "largest_initiator_share": share("m_f"), "largest_date_share": share("m_d"), "herfindahl_effective_firms": effective("q_f"),
        "herfindahl_effective_dates": effective("q_d")}
    return wide.select(*[c.cast("double").alias(m) for m, c in metrics.items()]).unpivot([], list(metrics), "metric", "value")
