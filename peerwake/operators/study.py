"""Event panels and outcomes with peers frozen at the event date.

``frame`` is the return panel every function here reads: one row per (date,
security_id) with ``value`` and, for eligible rows, ``groups`` - an array of
(peer_definition, peer_group). Every member of a portfolio must have a row on the
membership date (its value may be null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from ..functions.exprs import joined_labels, null_if_empty, sign_of, when_label
from ..params import BROAD, ECONOMIC, EVERYONE, Study

MEMBERS_PER_PART = 1024  # members of a portfolio that are summed together

PANEL_COLUMNS = (
    "event_id", "event_date", "security_id", "relative_day", "calendar_date", "direction", "peer_definition",
    "return_specification", "initiator_return", "peer_return", "signed_initiator_return", "signed_peer_return",
    "valid_observation", "event_date_peer_membership_valid")
OUTCOME_COLUMNS = (
    "event_id", "event_date", "security_id", "direction", "peer_definition", "subsector", "horizon",
    "return_specification", "initiator_car", "peer_car", "peer_catchup", "initiator_reversal", "convergence",
    "initial_relative_shock", "relative_volatility", "simultaneous_event_group", "earnings_flag",
    "overlapping_post_event_window", "valid_horizon", "missing_reason")


def study_frame(panel: DataFrame, value: str, definitions=(ECONOMIC,), eligible: str = "eligible",
                keys: tuple[str, ...] = ()) -> DataFrame:
    group = {ECONOMIC: F.col("peer_group"), BROAD: F.lit(EVERYONE)}
    groups = F.array(*[F.struct(F.lit(d).alias("peer_definition"), group[d].alias("peer_group")) for d in definitions])
    return panel.select(*keys, "date", "security_id", F.col(value).alias("value"),
                        F.when(F.col(eligible), groups).alias("groups"))


def trading_calendar(returns: DataFrame) -> DataFrame:
    """Distinct dates with their position. One row per date, so one small task orders it."""
    return returns.select("date").distinct().select(
        "date", F.row_number().over(Window.orderBy("date")).cast("int").alias("position"))


def _neighbours(wanted: DataFrame, frame: DataFrame, calendar: DataFrame, p: Study, keys: tuple[str, ...]) -> DataFrame:
    """``wanted`` rows of the frame with the returns of their own security around them: ``near``, a value for each relative day.

    The frame moves once, as one series a security (at most one calendar of rows) with a place for
    each position, so a wanted row cuts its window out; only wanted rows get an array of their own.
    """
    owner = [*keys, "security_id"]
    placed = frame.select(*owner, "date", "value").join(F.broadcast(calendar), "date")
    held = placed.groupBy(*owner).agg(F.sort_array(F.collect_list(F.struct(F.col("position").alias("at"), F.col("value").alias("x")))).alias("__held"))
    twice = F.raise_error(F.concat(F.lit("a second row of one date in the study frame for "), F.col("security_id"))).cast("int")

    def places(value, none: Column) -> Column:
        def place(e: Column, i: Column) -> Column:
            gap = F.coalesce(F.get("__held", i + 1)["at"] - e["at"], F.lit(1))
            return F.concat(F.array(value(e)), F.array_repeat(none, F.when(gap > 0, gap - 1).otherwise(twice)))
        return F.flatten(F.transform("__held", place))

    series = held.select(*owner, F.col("__held")[0]["at"].alias("__first"), places(lambda e: e["x"], F.lit(None).cast("double")).alias("__x"),
                         places(lambda e: F.lit(True), F.lit(False)).alias("__on"))
    rows = wanted.join(F.broadcast(calendar), "date").join(series, owner)
    at, width = F.col("position") - F.col("__first"), p.pre_event_days + p.post_event_days + 1
    rows = rows.where(F.coalesce(F.get("__on", at), F.lit(False)))
    none, low = F.lit(None).cast("double"), at - p.pre_event_days
    inside = F.slice("__x", F.greatest(low, F.lit(0)) + 1, F.lit(width) + F.least(low, F.lit(0)))
    near = F.concat(F.array_repeat(none, -F.least(low, F.lit(0))), inside)
    return rows.withColumn("near", F.concat(near, F.array_repeat(none, F.lit(width) - F.size(near)))).drop("__first", "__x", "__on", "position")


def _event_days(events: DataFrame, calendar: DataFrame, p: Study, arrays: dict[str, str]) -> DataFrame:
    """Event rows repeated over relative days with the calendar date, null past either end; ``arrays`` hold a value for each day."""
    last = calendar.agg(F.max("position").alias("__last"))
    dates = F.broadcast(calendar.select(F.col("position").alias("__at"), F.col("date").alias("calendar_date")))
    placed = events.join(F.broadcast(calendar), "date", "left").crossJoin(F.broadcast(last))
    width = p.pre_event_days + p.post_event_days + 1
    full = [F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast(kind), width)).alias(c) for c, kind in arrays.items()]
    days = placed.select(*[c for c in placed.columns if c not in arrays], F.inline(F.arrays_zip(
        F.sequence(F.lit(-p.pre_event_days), F.lit(p.post_event_days)).alias("relative_day"), *full)))
    days = days.withColumn("__at", F.col("position") + F.col("relative_day"))
    return days.join(dates, "__at", "left").drop("__at", "__last", "position")


def _baskets(rows: DataFrame, cell: list[str], p: Study, weighted: bool) -> DataFrame:
    """One row a portfolio: its members, their weight, and for each relative day the sum and number of the values seen.

    Members meet with their arrays; a large portfolio is summed in parts (``__part``) first.
    """
    days = range(p.pre_event_days + p.post_event_days + 1)
    x = [F.get("near", F.lit(d)) for d in days]
    met = rows.repartition(*cell, "__part")
    return met.groupBy(*cell).agg(
        F.array(*[F.sum(F.col("weight") * v if weighted else v) for v in x]).alias("__sum"), F.array(*[F.count(v).cast("int") for v in x]).alias("__seen"),
        F.count("*").alias("__members"), F.sum("weight" if weighted else F.lit(1.0)).alias("__w"))


def event_panel(events: DataFrame, frame: DataFrame, p: Study, return_specification=None,
                keys: tuple[str, ...] = (), frame_keys: tuple[str, ...] = (), edges: DataFrame | None = None,
                calendar: DataFrame | None = None) -> DataFrame:
    """(event, relative day) rows for equal-weight groups, or for explicit ``edges``.

    Grouped portfolios are aggregated once per (event date, group) and shared by all of
    its events: the portfolio of one event is that basket less its own return. ``edges``
    rows are (keys, event_id, date, peer_id, weight).
    """
    calendar = trading_calendar(frame) if calendar is None else calendar
    row_key = [*frame_keys, "date", "security_id"]
    starters = events.select(*row_key).distinct()
    spec = F.lit(return_specification) if isinstance(return_specification, str) else (
        F.col("return_specification") if return_specification is None else return_specification)
    ids = [*keys, "event_id"]
    # Only rows of portfolios or initiators on event dates get their neighbours; they are written
    # once, as both sides below read them.
    if edges is None:
        cell = [*frame_keys, "date", "peer_definition", "peer_group"]
        spread = frame.select(*row_key, F.inline("groups"))
        hot = staged(spread.join(events.select(*cell).distinct(), cell, "left_semi"), "event_members")
        sizes = hot.groupBy(*cell).agg(F.count("*").alias("__n"))
        split = F.pmod(F.xxhash64("security_id"), F.ceil(F.col("__n") / MEMBERS_PER_PART)).cast("int")
        members = hot.join(sizes, cell).select(*row_key, "peer_definition", "peer_group", split.alias("__part"))
        wanted = members.unionByName(starters, allowMissingColumns=True)
    else:
        cell = ids
        wanted = starters.unionByName(edges.select(*frame_keys, "date", F.col("peer_id").alias("security_id"))).distinct()
    used = staged(_neighbours(wanted, frame, calendar, p, frame_keys), "event_neighbours")
    own = (used.where("__part IS NULL") if edges is None else used).select(*row_key, F.col("near").alias("initiator_return"))
    ev = events.join(own, row_key, "left")
    if edges is None:
        inside = hot.withColumn("__in", F.lit(1))
        ev = ev.join(inside, [*row_key, "peer_definition", "peer_group"], "left").fillna(0, ["__in"])
        baskets = _baskets(used.where("__part IS NOT NULL"), cell, p, weighted=False)
    else:
        held = used.select(*frame_keys, "date", F.col("security_id").alias("peer_id"), "near")
        drawn = edges.select(*ids, "date", "peer_id", "weight", *[k for k in frame_keys if k not in keys])
        drawn = drawn.join(held, [*frame_keys, "date", "peer_id"], "left").withColumn("__part", F.lit(0))
        baskets = _baskets(drawn, cell, p, weighted=True)
    # Events meet their portfolio as one row each and are spread over days last.
    rows = _event_days(ev.join(baskets, cell, "left"), calendar, p, {"initiator_return": "double", "__sum": "double", "__seen": "int"})
    if edges is None:
        peers = F.coalesce("__members", F.lit(0)) - F.col("__in")
        seen = F.coalesce("__seen", F.lit(0)) - F.when(F.col("initiator_return").isNotNull(), F.col("__in")).otherwise(0)
        joined = (F.col("__in") == 1) | (F.col("peer_definition") == BROAD)
        valid = joined & (peers > 0)
        total = F.col("__sum") - F.when(F.col("__in") == 1, F.coalesce("initiator_return", F.lit(0.0))).otherwise(0.0)
        peer = F.when(valid & (seen == peers), total / peers)
    else:
        valid = F.coalesce(F.abs(F.col("__w") - 1) <= 1e-5, F.lit(False))
        peer = F.when(valid & (F.col("__seen") == F.col("__members")), F.col("__sum"))
    sign = sign_of(F.col("direction"))
    both = F.col("initiator_return").isNotNull() & F.col("peer_return").isNotNull()
    rows = rows.withColumn("peer_return", F.when(F.col("calendar_date").isNotNull(), peer)).withColumn("__valid", valid)
    return rows.select(
        *keys, "event_id", F.col("date").alias("event_date"), "security_id", "relative_day", "calendar_date", "direction",
        "peer_definition", spec.alias("return_specification"), "initiator_return", "peer_return",
        (sign * F.col("initiator_return")).alias("signed_initiator_return"),
        (sign * F.col("peer_return")).alias("signed_peer_return"), both.alias("valid_observation"),
        F.col("__valid").alias("event_date_peer_membership_valid"))


def overlap_flags(panel: DataFrame, p: Study, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whether another event's post window shares a calendar date.

    Windows are contiguous on one calendar, so they intersect exactly when some date is
    covered twice; covers are counted per date, never per pair of events, and sent as one row a date.
    """
    post = panel.where(F.col("relative_day").between(1, p.post_event_days) & F.col("calendar_date").isNotNull())
    covers = post.groupBy(*keys, "calendar_date").agg(F.count("*").alias("__c"))
    return (post.select(*keys, "event_id", "calendar_date").join(F.broadcast(covers), [*keys, "calendar_date"])
            .groupBy(*keys, "event_id").agg((F.max("__c") > 1).alias("overlapping_post_event_window")))


def missing_reason(horizon: Column) -> Column:
    """Ordered reasons from the aggregates of one (event, horizon) window."""
    member = F.coalesce("__members_ok", F.lit(True))
    return null_if_empty(joined_labels([
        when_label((F.coalesce("__days", F.lit(0)) != horizon) | F.coalesce("__no_date", F.lit(False)), "end_of_sample"),
        when_label(F.coalesce("__no_own", F.lit(False)), "missing_initiator_observation"),
        F.when(~member, F.lit("missing_event_date_peer_membership"))
        .when(F.coalesce("__no_peer", F.lit(False)), F.lit("missing_peer_observation"))]))


def event_outcomes(events: DataFrame, panel: DataFrame, p: Study, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums over days 1..h, null unless every day is complete, signed by the shock.

    An event is one row with its horizons in an array until its facts and overlap have met it.
    """
    ids = [*keys, "event_id"]
    specs = ["return_specification"]

    def window(h: int) -> Column:
        inside = lambda c: F.when(F.col("relative_day").between(1, h), c)
        return F.struct(
            F.lit(h).alias("horizon"), F.count(inside(F.lit(1))).alias("__days"), F.bool_or(inside(F.col("calendar_date").isNull())).alias("__no_date"),
            F.bool_or(inside(F.col("initiator_return").isNull())).alias("__no_own"),
            F.bool_or(inside(F.col("peer_return").isNull())).alias("__no_peer"),
            F.bool_and(inside(F.col("event_date_peer_membership_valid"))).alias("__members_ok"),
            F.sum(inside(F.col("initiator_return"))).alias("__own"), F.sum(inside(F.col("peer_return"))).alias("__peer"))

    windows = panel.groupBy(*ids, *specs).agg(F.array(*[window(h) for h in p.horizons]).alias("__windows"))
    facts = events.select(*ids, F.col("date").alias("event_date"), "security_id", "direction", "peer_definition", "subsector",
                          F.col("relative_return").alias("initial_relative_shock"), "relative_volatility",
                          "simultaneous_event_group", "earnings_flag")
    rows = (windows.join(facts, ids).join(overlap_flags(panel, p, keys), ids, "left")
            .select("*", F.inline("__windows")).drop("__windows")
            .withColumn("missing_reason", missing_reason(F.col("horizon"))))
    valid = F.col("missing_reason").isNull()
    sign = sign_of(F.col("direction"))
    rows = rows.withColumn("initiator_car", F.when(valid, F.col("__own"))).withColumn("peer_car", F.when(valid, F.col("__peer")))
    rows = (rows.withColumn("peer_catchup", sign * F.col("peer_car"))
            .withColumn("initiator_reversal", -sign * F.col("initiator_car"))
            .withColumn("convergence", F.col("peer_catchup") + F.col("initiator_reversal"))
            .withColumn("valid_horizon", valid)
            .withColumn("overlapping_post_event_window", F.coalesce("overlapping_post_event_window", F.lit(False))))
    return rows.select(*keys, *OUTCOME_COLUMNS)


def reverse_time(panel: DataFrame) -> DataFrame:
    return panel.withColumn("relative_day", -F.col("relative_day"))
