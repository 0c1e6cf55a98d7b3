"""Trailing return correlations between event initiators and sets of securities.

A *unit* is one candidate set on one event date. A security's history is one row for all dates
(``series``); a candidate row names only its unit and takes its part of the series on the way to a
block. Initiators and candidates meet in blocks of bounded size: each task multiplies initiator with
candidate vectors and returns only the best k (or sums), so pairs are neither joined nor written
out, and a unit of any size spreads over many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from ..params import CORRELATION

INITIATORS_PER_BLOCK = 16384
CANDIDATES_PER_BLOCK = 32768
DATES_PER_BLOCK = 16  # neighbouring dates share one copy of a candidate's series
_CELLS_AT_ONCE = 1 << 20  # entries of a correlation matrix that is held at once


class Inputs(NamedTuple):
    """``initiators`` and ``candidates`` carry their unit and its window of positions (``__from`` to ``__last``)."""

    initiators: DataFrame
    candidates: DataFrame
    series: DataFrame


def _series(returns: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """(security_id, past, seen): observed values by position, and the positions of all rows as 64-bit words."""
    placed = returns.select("date", "security_id", F.col(value).alias("__x")).join(F.broadcast(calendar), "date")
    one = F.expr("shiftleft(1L, position % 64)")
    words = placed.groupBy("security_id", F.floor(F.col("position") / 64).cast("int").alias("k")).agg(
        F.bit_or(one).alias("bits"),
        F.collect_list(F.when(F.col("__x").isNotNull(), F.struct(F.col("position").alias("at"), F.col("__x").alias("x")))).alias("part"))
    return words.groupBy("security_id").agg(
        F.flatten(F.collect_list("part")).alias("past"), F.collect_list(F.struct("k", "bits")).alias("seen"))


def prepare(events: DataFrame, members: DataFrame, returns: DataFrame, calendar: DataFrame, unit: list[str],
            value: str = "return", lookback: int = 252, span: int | None = None) -> Inputs:
    """Initiators and candidates with a window of the last ``lookback`` dates the unit traded.

    ``unit`` starts with ``date``. ``span`` bounds the fetched history in calendar
    positions; a unit that needs more raises instead of returning a shorter history.
    """
    series = staged(_series(returns, calendar, value), "series")
    units = events.select(*unit).distinct()
    traded = returns.select("date", "security_id").join(F.broadcast(calendar), "date")
    sets = members.select(*unit, "security_id").join(units, unit, "left_semi").join(traded, ["date", "security_id"])
    starters = events.select(*unit, "event_id", "security_id").join(traded, ["date", "security_id"])
    # Positions at which anybody of a unit had a row, as words: bits before the date, and within the span.
    seen = sets.select(*unit, "security_id", "position").unionByName(starters.select(*unit, "security_id", "position")).join(
        series.select("security_id", F.explode("seen").alias("w")), "security_id")
    bits = seen.where(F.col("w.k") * 64 < F.col("position")).groupBy(*unit, F.col("w.k").alias("k")).agg(
        F.bit_or("w.bits").alias("bits"), F.max("position").alias("position"))
    at = bits.select(*unit, "position", F.explode(F.expr("transform(filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1) = 1), b -> k * 64 + b)")).alias("at"))
    at = at.where(F.col("at") < F.col("position") if span is None else (F.col("at") < F.col("position")) & (F.col("at") >= F.col("position") - span))
    recent = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("at")))
    cut = at.withColumn("__r", recent).where(F.col("__r") <= lookback).groupBy(*unit).agg(
        F.min("at").alias("__from"), F.max("at").alias("__last"), F.count("*").alias("__dates"), F.max("position").alias("position"))
    if span is not None:
        short = (F.col("__dates") < lookback) & (F.col("position") > span + 1)
        cut = cut.withColumn("__from", F.when(short, F.raise_error(F.lit("span is too short for the lookback")).cast("int"))
                             .otherwise(F.col("__from")))
    cut = staged(cut.drop("position"), "windows")
    return Inputs(starters.join(cut, unit, "left"), sets.join(cut, unit, "left"), series)


def _slice(low: Column | str, high: Column | str) -> list[Column]:
    """The part of a series from ``low`` to ``high`` as two flat arrays."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    part = F.filter("past", lambda e: (e["at"] >= low) & (e["at"] <= high))
    return [part["at"].alias("at"), part["x"].alias("x")]


def _dense(table: pa.Table, base: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and marks of what was observed, a row for each of ``table`` and a column for each position."""
    at, values = (table.column(c).combine_chunks() for c in ("at", "x"))
    row = np.repeat(np.arange(len(table)), np.diff(at.offsets.to_numpy()))
    column = at.flatten().to_numpy() - base
    x, seen = np.zeros((len(table), width)), np.zeros((len(table), width))
    x[row, column], seen[row, column] = values.flatten().to_numpy(), 1.0
    return x, seen


def pairwise_correlation(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pearson correlation over jointly observed columns, and the overlap counts."""
    return _correlation(ma @ mb.T, a @ mb.T, ma @ b.T, a @ b.T, (a * a) @ mb.T, ma @ (b * b).T)


def _paired_correlation(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of each row of ``a`` with the row of ``b`` beside it."""
    total = lambda x, y: np.einsum("ij,ij->i", x, y)
    return _correlation(total(ma, mb), total(a, mb), total(ma, b), total(a, b), total(a * a, mb), total(ma, b * b))


def _correlation(n, sa, sb, sab, saa, sbb) -> tuple[np.ndarray, np.ndarray]:
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    flat = (va <= 1e-13 * np.maximum(n * saa, 1e-300)) | (vb <= 1e-13 * np.maximum(n * sbb, 1e-300))
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = (n * sab - sa * sb) / np.sqrt(va * vb)
    return np.where(flat | (n < 2), np.nan, corr), n


def _blocks(initiators: DataFrame, candidates: DataFrame, cell: list[str]):
    """Both sides, rows with ``cell``, spread over (cell, chunk, block) of bounded size."""
    sizes = candidates.groupBy(*cell).agg(F.count("*").alias("__nc")).join(initiators.groupBy(*cell).agg(F.count("*").alias("__ne")), cell)
    blocks = F.ceil(F.col("__nc") / CANDIDATES_PER_BLOCK).cast("int")
    chunks = F.ceil(F.col("__ne") / INITIATORS_PER_BLOCK).cast("int")
    left = initiators.join(sizes, cell).withColumn("chunk", F.pmod(F.xxhash64("event_id"), chunks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__nc", "__ne")
    right = candidates.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("security_id"), blocks).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("__nc", "__ne")
    return left.groupBy(*cell, "chunk", "block").cogroup(right.groupBy(*cell, "chunk", "block"))


_ROWS, _COLUMNS = 512, 4096  # initiators and candidates that are bounded together
_MUCH = 0.15  # of the pairs of a block; with more of them the block is computed whole


def _shape(x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Series about their own mean and of length one, the numbers of places not seen, and the largest share of the variance that any m places hold."""
    n = seen.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        about = np.where(seen > 0, x - (x.sum(axis=1) / n)[:, None], 0.0)
        about /= np.abs(about).max(axis=1, initial=0.0)[:, None]
        about /= np.sqrt((about * about).sum(axis=1))[:, None]
    about = np.where(np.isfinite(about), about, 0.0)  # a constant or endless series has no correlation
    share = np.cumsum(-np.sort(-about * about, axis=1), axis=1)
    return about, (x.shape[1] - n).astype(int), np.hstack([np.zeros((len(x), 1)), share])


def best_correlations(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray, other, minimum: int, top: int):
    """Rows, columns and values of the ``top`` highest correlations of each row of ``a`` with ``b``; equal ones from the left.

    All pairs are judged. The product of two series about their own means bounds their correlation: places that only one
    of them has can add no more than its largest values there. Only pairs whose bound reaches the row's ``top``-th best so
    far are computed, with ``pairwise_correlation``'s formula. ``other(rows, columns)`` tells pairs of two securities.
    """
    least = max(minimum, 2)
    left, right = (np.flatnonzero(m.sum(axis=1) >= least) for m in (ma, mb))
    out = []
    if not (len(left) and len(right)):
        return [np.empty(0, int), np.empty(0, int), np.empty(0)]
    (ua, gone_a, share_a), (ub, gone_b, share_b) = _shape(a[left], ma[left]), _shape(b[right], mb[right])
    by_a, by_b = np.argsort(gone_a, kind="stable"), np.argsort(gone_b, kind="stable")
    edges = {*range(0, len(left), _ROWS), *(np.flatnonzero(np.diff(gone_a[by_a]) > 0) + 1).tolist()}
    for rows in np.split(by_a, sorted(edges - {0})):
        i, ga = left[rows], int(gone_a[rows].max())
        # What is left of a candidate's variance, whichever places the initiators of the block lack.
        held_b = share_b[:, ga] * (1 + ga / least)
        room_b = np.sqrt(np.maximum(1 - held_b, 0.01))
        loose = (1 - held_b < 0.01)
        lost_b = np.sqrt(ga * share_b[:, ga]) / room_b
        found = [np.empty((3, 0))]
        level = np.full(len(rows), -np.inf)
        x = ua[rows].astype(np.float32)
        start, wide = 0, 512
        while start < len(by_b):
            cols = by_b[start:start + wide]
            start, wide = start + wide, min(_COLUMNS, 2 * wide)
            j, gb = right[cols], int(gone_b[cols].max())
            held_a = share_a[rows, gb] * (1 + gb / least)
            lost_a = np.sqrt(gb * share_a[rows, gb])
            bar = level * np.sqrt(np.maximum(1 - held_a, 0.0)) - lost_a * lost_b[cols].max() / least - 1e-4
            bar = np.where((level > 0) & (1 - held_a > 0.01), bar, -np.inf)
            y = (ub[cols] / room_b[cols, None]).astype(np.float32)
            passed = x @ y.T >= bar[:, None].astype(np.float32)
            if loose[cols].any():
                passed |= loose[cols]
            if np.count_nonzero(passed) > _MUCH * passed.size:
                step = max(1, _CELLS_AT_ONCE // len(cols))
                got = []
                for k in range(0, len(i), step):
                    corr, n = pairwise_correlation(a[i[k:k + step]], ma[i[k:k + step]], b[j], mb[j])
                    corr = np.where((n >= minimum) & (corr > -np.inf) & other(i[k:k + step][:, None], j[None, :]), corr, -np.inf)
                    floor = np.partition(corr, -top, axis=1)[:, -top] if len(j) > top else np.full(len(corr), -np.inf)
                    r, c = np.nonzero((corr > -np.inf) & (corr >= np.maximum(floor, level[k:k + step])[:, None] - 1e-9))
                    got.append(np.stack([r + k, j[c], corr[r, c]]))
                got = np.concatenate(got, axis=1)
            else:
                r, c = np.divmod(np.flatnonzero(passed), len(cols))
                parts = []
                for k in range(0, len(r), 8192):
                    rr, jj = r[k:k + 8192], j[c[k:k + 8192]]
                    corr, n = _paired_correlation(a[i[rr]], ma[i[rr]], b[jj], mb[jj])
                    good = (n >= minimum) & (corr > -np.inf) & other(i[rr], jj)
                    parts.append(np.stack([rr[good], jj[good], corr[good]]))
                got = np.concatenate(parts, axis=1) if parts else np.empty((3, 0))
            if got.shape[1]:
                got = got[:, got[2] >= level[got[0].astype(int)] - 1e-9]
                met = np.concatenate([*found, got], axis=1)
                # Rounding noise must not break ties.
                met = met[:, np.lexsort((met[1], -np.round(met[2], 10), met[0]))]
                place = np.arange(met.shape[1]) - np.searchsorted(met[0], met[0])
                found = [met[:, place < top]]
                last = met[:, place == top - 1]
                level[last[0].astype(int)] = last[2] - 1e-9
        met = found[0]
        out.append(np.stack([i[met[0].astype(int)], met[1], met[2]]))
    row, column, value = np.concatenate(out, axis=1)
    return [row.astype(int), column.astype(int), value]


def correlation_peers(initiators: DataFrame, candidates: DataFrame, series: DataFrame, minimum: int = 60, top: int = 10) -> DataFrame:
    """Best ``top`` peers per event by trailing correlation, equal weights; ties go to the lower id."""
    schema = "event_id string, peer_id string, correlation double"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            right = right.sort_by("security_id")
            base = left.column("base")[0].as_py()
            width = left.column("end")[0].as_py() - base + 1
            (a, ma), (b, mb) = _dense(left, base, width), _dense(right, base, width)
            mine, ids = (t.column("security_id").to_numpy() for t in (left, right))
            events, date, first, last = (left.column(c).to_numpy() for c in ("event_id", "position", "__from", "__last"))
            on = right.column("days").combine_chunks()
            owner, day = np.repeat(np.arange(len(right)), np.diff(on.offsets.to_numpy())), on.flatten().to_numpy()
            for d in np.unique(date):
                here, there = np.flatnonzero(date == d), owner[day == d]
                span = slice(first[here[0]] - base, last[here[0]] - base + 1)
                i, j, value = best_correlations(a[here, span], ma[here, span], b[there, span], mb[there, span],
                                                lambda r, c: mine[here[r]] != ids[there[c]], minimum, top)
                out.append((events[here[i]], ids[there[j]], value))
        event, peer, value = (np.concatenate([o[k] for o in out]) if out else [] for k in range(3))
        return pa.table([pa.array(event, pa.string()), pa.array(peer, pa.string()), pa.array(value, pa.float64())], names=["event_id", "peer_id", "correlation"])

    near = F.floor(F.col("position") / DATES_PER_BLOCK).cast("int").alias("near")
    starts = initiators.where("__from IS NOT NULL").select("*", near)
    range_ = starts.groupBy("near").agg(F.min("__from").alias("base"), F.max("__last").alias("end"))
    left = starts.join(range_, "near").join(series.select("security_id", "past"), "security_id").select(
        "near", "base", "end", "position", "__from", "__last", "event_id", "security_id", *_slice("base", "end"))
    days = candidates.where("__from IS NOT NULL").groupBy(near, "security_id").agg(F.collect_list("position").alias("days"))
    right = days.join(range_, "near").join(series.select("security_id", "past"), "security_id").select(
        "near", "security_id", "days", *_slice("base", "end"))
    local = _blocks(left, right, ["near"]).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc(F.round("correlation", 10)), "peer_id"))
    chosen = local.withColumn("rank", rank).where(F.col("rank") <= top)
    size = F.count("*").over(Window.partitionBy("event_id"))
    keys = initiators.select("event_id", "date", "security_id")
    return chosen.withColumn("weight", 1 / size).join(keys, "event_id").select(
        "event_id", "date", "security_id", "peer_id", F.lit(CORRELATION).alias("peer_definition"), "weight", "correlation", "rank")


def correlation_audit(initiators: DataFrame, calendar: DataFrame, peers: DataFrame) -> DataFrame:
    """Number of selected peers and the last date that informed them, per event."""
    last = F.broadcast(calendar.select(F.col("position").alias("__last"), F.col("date").alias("correlation_information_max_date")))
    counts = peers.groupBy("event_id").agg(F.count("*").alias("correlation_peer_count"))
    rows = initiators.select("event_id", F.col("date").alias("event_date"), "__last").join(last, "__last", "left").join(counts, "event_id", "left")
    seen = F.col("correlation_information_max_date")
    return rows.select("event_id", "event_date", F.coalesce("correlation_peer_count", F.lit(0)).alias("correlation_peer_count"),
                       "correlation_information_max_date", (seen.isNull() | (seen < F.col("event_date"))).alias("no_future_information_check"))


def peer_quality(initiators: DataFrame, candidates: DataFrame, series: DataFrame, calendar: DataFrame, unit: list[str], minimum: int = 60) -> DataFrame:
    """Mean pairwise correlation with the peers and correlation with their equal-weight basket."""
    schema = "event_id string, total double, pairs long, at array<int>, x array<double>, s array<double>, c array<long>"

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            base, last = left.column("__from")[0].as_py(), left.column("__last")[0].as_py()
            (a, ma), (b, mb) = _dense(left, base, last - base + 1), _dense(right, base, last - base + 1)
            mine, ids = (t.column("security_id").to_numpy() for t in (left, right))
            step = max(1, _CELLS_AT_ONCE // max(1, len(right)))
            for k in range(0, len(left), step):
                rows = slice(k, k + step)
                other = (mine[rows][:, None] != ids[None, :]).astype(float)
                corr = np.where(other > 0, pairwise_correlation(a[rows], ma[rows], b, mb)[0], np.nan)
                total, pairs = np.nansum(corr, axis=1), (~np.isnan(corr)).sum(axis=1)
                s, c = other @ b, np.rint(other @ mb).astype(np.int64)
                for i, event in enumerate(left.column("event_id")[rows].to_pylist()):
                    at = np.flatnonzero(ma[k + i])
                    out.append((event, float(total[i]), int(pairs[i]), at + base, a[k + i, at], s[i, at], c[i, at]))
        return pa.table({n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate([
            ("event_id", pa.string()), ("total", pa.float64()), ("pairs", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())),
            ("s", pa.list_(pa.float64())), ("c", pa.list_(pa.int64()))])})

    held = series.select("security_id", "past")
    left = initiators.where("__from IS NOT NULL").join(held, "security_id").select(*unit, "event_id", "security_id", "__from", "__last", *_slice("__from", "__last"))
    right = candidates.where("__from IS NOT NULL").join(held, "security_id").select(*unit, "security_id", *_slice("__from", "__last"))
    parts = staged(_blocks(left, right, unit).applyInArrow(sums, schema), "quality_parts")
    pairs = parts.groupBy("event_id").agg((F.sum("total") / F.nullif(F.sum("pairs"), F.lit(0))).alias("__mean"))
    # The basket of a day: sum and count of the peers seen, over all blocks of the unit.
    joined = (parts.select("event_id", F.inline(F.arrays_zip("at", "x", "s", "c"))).repartition("event_id").groupBy("event_id", "at")
              .agg(F.first("x").alias("x"), F.sum("s").alias("s"), F.sum("c").alias("c")).where("c > 0").withColumn("b", F.col("s") / F.col("c")))
    moments = joined.groupBy("event_id").agg(F.count("*").alias("n"), F.var_samp("x").alias("vx"), F.var_samp("b").alias("vb"),
                                             F.covar_samp("x", "b").alias("cxb"))
    similar = F.when((F.col("vx") > 0) & (F.col("vb") > 0), F.col("cxb") / F.sqrt(F.col("vx") * F.col("vb")))
    last = F.broadcast(calendar.select(F.col("position").alias("__last"), F.col("date").alias("correlation_information_max_date")))
    rows = (initiators.select("event_id", F.col("date").alias("event_date"), "security_id", "__last").join(last, "__last", "left")
            .join(moments.withColumn("__similar", similar), "event_id", "left").join(pairs, "event_id", "left"))
    enough = F.coalesce("n", F.lit(0)) >= minimum
    seen = F.col("correlation_information_max_date")
    return rows.select(
        "event_id", "event_date", "security_id", F.when(enough, F.col("__mean")).alias("average_peer_correlation"),
        F.when(enough, F.col("__similar")).alias("peer_return_similarity"), F.coalesce("n", F.lit(0)).alias("correlation_history_count"),
        "correlation_information_max_date", (seen.isNull() | (seen < F.col("event_date"))).alias("no_future_information_check"))
