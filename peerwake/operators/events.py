"""Detection of unusually large moves relative to peers, from trailing information only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from ..functions.exprs import gated, null_safe_on, tagged_id, trailing, union_all
from ..contracts import NUMERIC_TYPES
from ..params import COOLDOWN_SCOPES, Detection

EVENT_COLUMNS = (
    "event_id", "date", "security_id", "direction", "relative_return", "relative_volatility", "threshold_used",
    "peer_definition", "subsector", "volume", "market_cap", "simultaneous_event_group", "corporate_action_type",
    "earnings_flag", "news_identified_flag")
DEFAULTS = {"volume": "double", "market_cap": "double", "earnings_flag": "boolean", "news_identified_flag": "boolean"}


def candidate_rows(relative: DataFrame, panel: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Detector input: relative returns with labels, volume and the action label."""
    extra = panel.select("date", "security_id", "subsector", "volume", "extreme_return_flag")
    action = F.when(F.coalesce("extreme_return_flag", F.lit(False)), F.lit("unknown")).otherwise(F.lit("none"))
    return (relative.join(extra, ["date", "security_id"], "left")
            .select(*keys, "date", "security_id", "peer_definition", "peer_group", "peer_count", "relative_abnormal_return",
                    "subsector", "volume", action.alias("corporate_action_type"),
                    F.lit(None).cast("double").alias("market_cap"),
                    F.lit(False).alias("earnings_flag"), F.lit(False).alias("news_identified_flag")))


def checked_candidates(rows: DataFrame, value: str = "relative_abnormal_return", keys: tuple[str, ...] = ()) -> DataFrame:
    """The same rows; what the detector can't read stops it.

    Absent columns and wrong types are refused at once. Holes, endless numbers, negative peer counts and a second row
    of a (security, definition, date) stop the run that meets them: the test is part of ``value`` and shares the
    trailing windows' sort, so it costs no pass of its own.
    """
    needed = ("date", "security_id", "peer_definition", "peer_group", "subsector", "peer_count", "corporate_action_type", value)
    types = dict(rows.dtypes)
    numeric = lambda c: types[c] in NUMERIC_TYPES or types[c].startswith("decimal")
    if absent := [c for c in needed if c not in types]:
        raise ValueError(f"event candidates lack {absent}")
    if types["date"] != "date" or not (numeric("peer_count") and numeric(value)):
        raise ValueError(f"event candidates need a date without time, and numbers as peer_count and {value}")
    before = F.lag("date").over(Window.partitionBy(*keys, "security_id", "peer_definition").orderBy("date"))
    endless = reduce(lambda a, b: a | b, [F.abs(F.col(c).cast("double")).isin(float("inf"), float("nan")) for c in ("peer_count", value)])
    fault = (F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed]), F.lit("null value"))
             .when(endless, F.lit("number that isn't finite")).when(F.col("peer_count") < 0, F.lit("negative peer_count"))
             .when(before == F.col("date"), F.lit("second row of one date")))
    told = F.concat_ws(" ", F.lit("event candidates:"), F.col("__fault"), F.lit("at"), "security_id", F.col("date").cast("string"))
    return (rows.withColumn("__fault", fault)
            .withColumn(value, F.when(F.col("__fault").isNotNull(), F.raise_error(told).cast("double")).otherwise(F.col(value))).drop("__fault"))


def _usable(p: Detection):
    return (F.col("peer_count") >= p.minimum_peer_count) & ~F.col("corporate_action_type").isin(
        *p.exclude_corporate_action_types)


def trailing_volatility(rows: DataFrame, p: Detection, value: str = "relative_abnormal_return",
                        keys: tuple[str, ...] = ()) -> DataFrame:
    """Sample deviation of the previous rows; an unusable row is null but keeps its slot."""
    x = F.when(_usable(p), F.col(value))
    past = trailing([*keys, "security_id", "peer_definition"], "date", p.volatility_window)
    return rows.withColumn("relative_volatility", gated(F.stddev_samp(x), x, past, p.minimum_history_requirement))


def threshold_candidates(scored: DataFrame, p: Detection, value: str = "relative_abnormal_return",
                         multiplier=None) -> DataFrame:
    """Rows whose move strictly exceeds the larger of the floor and the volatility band."""
    k = F.lit(p.threshold_multiplier) if multiplier is None else multiplier
    known = scored.where(F.col("relative_volatility").isNotNull() & _usable(p))
    banded = known.withColumn("threshold_used", F.greatest(F.lit(p.minimum_relative_move), k * F.col("relative_volatility")))
    return banded.where(F.abs(value) > F.col("threshold_used"))


def _accepted_dates(candidates: DataFrame, unit: list[str], period: int) -> DataFrame:
    """Greedy acceptance over the distinct candidate dates of a unit.

    Acceptance depends on dates alone, so each unit is reduced to its distinct dates (at
    most one calendar) before the fold. A hot group cannot grow past that bound.
    """
    dates = F.array_sort(F.collect_set("date"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept"))

    def step(acc, d):
        free = acc["last"].isNull() | (F.datediff(d, acc["last"]) > period)
        return F.when(free, F.struct(d.alias("last"), F.concat(acc["kept"], F.array(d)).alias("kept"))).otherwise(acc)

    folded = candidates.groupBy(*unit).agg(dates.alias("__d")).select(
        *unit, F.aggregate("__d", start, step, lambda acc: acc["kept"]).alias("__k"))
    return folded.select(*unit, F.explode("__k").alias("date"))


def _one_group_per_firm(candidates: DataFrame, keys: tuple[str, ...]) -> bool:
    pair = F.struct("peer_definition", "peer_group")
    mixed = candidates.groupBy(*keys, "security_id").agg((F.min(pair) != F.max(pair)).alias("m")).where("m").limit(1)
    return mixed.count() == 0


def _settle_jointly(candidates: DataFrame, period: int, keys: tuple[str, ...]) -> DataFrame:
    """Firm and group clocks together, for firms that sit in several groups.

    A candidate is blocked when an accepted one of its firm or group lies 1..period days
    before it, and accepted once nothing undecided does. Each round settles the front of
    every chain at once; rounds end when no candidate is open. Only names and days go through the rounds,
    blocked rows leave them at once and accepted ones when nothing open follows within the period.
    """
    name = [*keys, "security_id", "peer_definition", "peer_group", "date"]
    rows = candidates.select(*name).distinct().withColumn("__state", F.lit("open")).withColumn("__day", F.datediff("date", F.lit("1970-01-01")))
    rows, kept = staged(rows, "cooldown"), []
    group = [*keys, "peer_definition", "peer_group"]
    while True:
        found = lambda flag, unit, first, last: F.coalesce(
            F.max(flag).over(Window.partitionBy(*unit).orderBy("__day").rangeBetween(first, last)), F.lit(False))
        # A group may be very large, so its clock runs over its days only.
        days = rows.groupBy(*group, "__day").agg(*[F.max(F.col("__state") == s).alias(f"__{s}") for s in ("kept", "open")])
        days = days.select(*group, "__day", found("__kept", group, -period, -1).alias("__hit"), found("__open", group, -period, -1).alias("__wait"),
                           found("__open", group, 1, period).alias("__ahead"))
        firm = [*keys, "security_id"]
        kept_, open_ = F.col("__state") == "kept", F.col("__state") == "open"
        rows = null_safe_on(rows, days.hint("merge"), [*group, "__day"], "inner")  # not through the driver in each round
        state = (F.when(kept_, F.lit("kept")).when(F.col("__hit") | found(kept_, firm, -period, -1), F.lit("blocked"))
                 .when(~(F.col("__wait") | found(open_, firm, -period, -1)), F.lit("kept")).otherwise(F.lit("open")))
        rows = rows.select("*", state.alias("__next"), (F.col("__ahead") | found(open_, firm, 1, period)).alias("__awaited"))
        rows = rows.where("__next <> 'blocked'").drop("__hit", "__wait", "__ahead")
        rows = staged(rows.drop("__state").withColumnRenamed("__next", "__state"), "cooldown")
        if rows.where("__state = 'open'").limit(1).count() == 0:
            kept = union_all([*kept, rows.select(*name)])
            return null_safe_on(candidates, kept, name, "left_semi")
        kept.append(rows.where("__state = 'kept' AND NOT __awaited").select(*name))
        rows = rows.where("__state = 'open' OR __awaited").drop("__awaited")


def apply_cooldown(candidates: DataFrame, period: int, scope: str, keys: tuple[str, ...] = (),
                   one_group_per_firm: bool | None = None) -> DataFrame:
    """Keep all unblocked movers of a day; later ones wait ``period`` calendar days.

    ``both`` equals ``peer_group`` when every firm has one group, since the group clock is
    then never behind the firm clock. Pass ``one_group_per_firm`` to skip that check.
    """
    if scope not in COOLDOWN_SCOPES:
        raise ValueError(f"cooldown_scope must be one of {COOLDOWN_SCOPES}")
    if scope == "none" or period == 0:
        return candidates
    if scope == "both":
        single = _one_group_per_firm(candidates, keys) if one_group_per_firm is None else one_group_per_firm
        if not single:
            return _settle_jointly(candidates, period, keys)
    unit = [*keys, "security_id"] if scope == "firm" else [*keys, "peer_definition", "peer_group"]
    return candidates.join(_accepted_dates(candidates, unit, period), [*unit, "date"], "left_semi")


def mark_simultaneous(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Shared id where two or more securities of a group moved on one date."""
    on = [*keys, "date", "peer_definition", "peer_group"]
    shared = (events.groupBy(*on).agg((F.min("security_id") != F.max("security_id")).alias("__many")).where("__many")
              .withColumn("simultaneous_event_group", tagged_id("sim_", F.col("date"), F.col("peer_definition"), F.col("peer_group")))
              .drop("__many"))
    return events.join(shared, on, "left")


def finish_events(accepted: DataFrame, value: str = "relative_abnormal_return", keys: tuple[str, ...] = ()) -> DataFrame:
    """Direction, ids, simultaneous groups and contract column names."""
    named = accepted
    for column, kind in DEFAULTS.items():
        if column not in named.columns:
            named = named.withColumn(column, F.lit(None if kind == "double" else False).cast(kind))
    named = named.withColumn("event_id", tagged_id("evt_", F.col("date"), F.col("security_id"), F.col("peer_definition")))
    named = named.withColumn("direction", F.when(F.col(value) > 0, F.lit("positive")).otherwise(F.lit("negative")))
    named = mark_simultaneous(named.withColumnRenamed(value, "relative_return"), keys)
    return named.select(*keys, *EVENT_COLUMNS, "peer_group")


def detect_events(candidates: DataFrame, p: Detection, value: str = "relative_abnormal_return",
                  keys: tuple[str, ...] = (), one_group_per_firm: bool | None = None, multiplier=None) -> DataFrame:
    """Volatility, threshold, cooldown and labelling in one plan.

    ``keys`` are leading columns (specification, iteration) under which the detection runs apart.
    """
    present = tuple(k for k in keys if k in candidates.columns)
    scored = trailing_volatility(checked_candidates(candidates, value, present), p, value, present)
    if multiplier is not None:
        scored = scored.withColumn(keys[-1], F.explode(F.array(*[F.lit(float(m)) for m in multiplier])))
        movers = threshold_candidates(scored, p, value, F.col(keys[-1]))
    else:
        movers = threshold_candidates(scored, p, value)
    # Threshold passers are rare and read several times below; the trailing windows run once.
    movers = staged(movers, "movers")
    accepted = apply_cooldown(movers, p.cooldown_period, p.cooldown_scope, keys, one_group_per_firm)
    return finish_events(accepted, value, keys)
