"""Small column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(col, digits: int = 8) -> Column:
    """Round and drop negative zero, so that engines agree on the printed value."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double column of a report."""
    return df.select(*[rounded(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def digest(*parts) -> Column:
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def tagged_id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(*parts), 1, 16))


def draw_u60(*parts) -> Column:
    """Uniform 60-bit draw keyed by its arguments; the same value on every retry and engine."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def draw_index(n, *parts) -> Column:
    """Zero-based uniform index below ``n``."""
    return F.pmod(draw_u60(*parts), n)


def shuffled_places(n: Column, k: Column, *parts) -> Column:
    """The first ``k`` of a keyed permutation of 0 .. n - 1, as an array: a sample without replacement in random order.

    A Feistel network of four rounds permutes the least power of four from 64 on that is not below ``n``;
    of the numbers 0, 1, 2, ... in its order those below ``n`` are kept. A prefix of the numbers gives
    enough of them but for rare keys, which go through all. One digest of ``parts`` keys the rounds.
    ``k`` must be at most ``n``; n up to 2^38.
    """
    return _first_places(n.cast("bigint"), k.cast("bigint"), digest(*parts))


_PLACES_AT_ONCE = 1 << 20


def _permuted(j: np.ndarray, half: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers ``j``, a row for each key, through the four rounds."""
    mask, half = ((1 << half) - 1)[:, None], half[:, None]
    left, right = j >> half, j & mask
    for r in range(4):
        mixed = ((right * a[:, r, None] + b[:, r, None]) % ((1 << 31) - 1)) >> 12
        left, right = right, left ^ (mixed & mask)
    return (left << half) | right


@F.arrow_udf(T.ArrayType(T.LongType()))
def _first_places(n: pa.Array, k: pa.Array, h: pa.Array) -> pa.Array:
    known = pc.and_(n.is_valid(), k.is_valid()).to_numpy(zero_copy_only=False)
    n, k = (np.maximum(pc.fill_null(x, 0).to_numpy(), 0) for x in (n, k))
    digits = np.frombuffer("".join(h.to_pylist()).encode(), np.uint8).astype(np.int64).reshape(len(n), 64)
    digits = np.where(digits > 57, digits - 87, digits - 48)
    number = lambda at, size: digits[:, at:at + size] @ (16 ** np.arange(size - 1, -1, -1))
    a, b = (np.stack([number(15 * r + at, size) for r in range(4)], axis=1) for at, size in ((0, 7), (7, 8)))
    bits = np.array([max(x - 1, 0).bit_length() for x in n.tolist()], np.int64)
    half = np.maximum(-(-bits // 2), 3)
    domain = 1 << 2 * half
    # About as many numbers as give k places, then more, then all of them.
    first = np.minimum(domain, np.ceil(1.5 * k * (domain / np.maximum(n, 1))).astype(np.int64) + 16)
    starts = np.concatenate([[0], np.cumsum(np.where(known, k, 0))])
    out, got = np.zeros(starts[-1], np.int64), np.zeros(len(n), np.int64)
    for count in (first, np.minimum(domain, 8 * k + 64), domain):
        todo = np.flatnonzero(known & (got < k))
        todo = todo[np.argsort(count[todo], kind="stable")]
        while len(todo):
            size = count[todo[:max(1, _PLACES_AT_ONCE // int(count[todo[0]]))]]
            rows = todo[:max(1, np.searchsorted(np.arange(1, len(size) + 1) * size, _PLACES_AT_ONCE, "right"))]
            todo = todo[len(rows):]
            j = np.arange(count[rows[-1]])[None, :]
            place = _permuted(j, half[rows], a[rows], b[rows])
            fits = (place < n[rows, None]) & (j < domain[rows, None])
            rank = np.cumsum(fits, axis=1)
            fits &= rank <= k[rows, None]
            at, _ = np.nonzero(fits)
            out[starts[rows[at]] + rank[fits] - 1] = place[fits]
            got[rows] = fits.sum(axis=1)
    if (got[known] < k[known]).any():
        raise ValueError("k is above n")
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, pa.int64()))
    return lists if known.all() else pc.if_else(pa.array(known), lists, pa.nulls(len(n), lists.type))


def when_label(condition: Column, label) -> Column:
    return F.when(condition, label if isinstance(label, Column) else F.lit(label))


def joined_labels(labels: list[Column], separator: str = ";") -> Column:
    """Join the labels that are not null, in order; an empty list gives an empty string."""
    return F.concat_ws(separator, *labels)


def null_if_empty(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def sign_of(direction: Column) -> Column:
    return F.when(direction == "positive", F.lit(1.0)).otherwise(F.lit(-1.0))


def sample_label(n: Column, adequate: str = "adequate_descriptive_sample", threshold: int = 30) -> Column:
    return F.when(n < threshold, F.lit("small_sample_descriptive_only")).otherwise(F.lit(adequate))


def trailing(partition, order: str, n: int, lag: int = 1):
    """Frame of the ``n`` rows that end ``lag`` rows before the current one."""
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(-(n + lag - 1), -lag)


def gated(agg: Column, value: Column, frame, minimum: int) -> Column:
    """A window aggregate, null until ``minimum`` observed values are in the frame."""
    return F.when(F.count(value).over(frame) >= minimum, agg.over(frame))


def weekdays_between(first: Column, last: Column) -> Column:
    """Monday-to-Friday dates in a closed span, by arithmetic (no calendar is generated)."""
    def upto(d: Column) -> Column:
        # 1899-12-31 + 1 is a Monday; whole weeks hold five weekdays.
        k = F.datediff(d, F.lit("1900-01-01").cast("date")) + 1
        return F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)), F.lit(5))
    return (upto(last) - upto(F.date_sub(first, 1))).cast("bigint")


def unpivot(df: DataFrame, ids: list[str], columns, name: str, value: str) -> DataFrame:
    return df.unpivot(ids, list(columns), name, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that may be null."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    cond = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])
