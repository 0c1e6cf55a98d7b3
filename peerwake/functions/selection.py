"""Exact order statistics and dense indexes that never sort one group in one task.

One way at every size. A quantile sketch proposes cuts just below and above each wanted
rank; exact counts between the cuts say which piece holds the rank, and only the rows of
that piece are sorted. Cuts are ranks, not distances, so outliers don't fill a piece, and
rows equal to a cut are a piece of their own that needs no sort, so ties don't either. The
sketch decides how large a piece is (about ``3 / GRID`` of its group), never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import null_safe_on

GRID, ACCURACY = 512, 4096


def percentiles(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """One row per key with linearly interpolated quantiles of the non-null values."""
    return order_statistics(df, keys, value, {n: F.lit(float(p)) * (F.col("__n") - 1) for n, p in named.items()})


def order_statistics(df: DataFrame, keys: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Values at zero-based positions that may depend on the group size ``__n``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    return _interpolate(_ranked(rows, keys, positions), keys, positions)


def _interpolate(hits: DataFrame, keys: list[str], positions: dict[str, Column]) -> DataFrame:
    """Weigh the two neighbours of each position; one output column per position."""
    rank = F.col("__rank")

    def share(pos):
        return (F.when(F.floor(pos) == F.ceil(pos), F.when(rank == F.floor(pos), 1.0))
                .when(rank == F.floor(pos), 1 - (pos - F.floor(pos))).when(rank == F.ceil(pos), pos - F.floor(pos)))

    return hits.groupBy(*keys).agg(*[F.sum(F.col("__x") * share(p)).alias(n) for n, p in positions.items()])


def _ranked(rows: DataFrame, keys: list[str], positions: dict[str, Column]) -> DataFrame:
    """(keys, __n, __rank, __x) for the ranks next to each position."""
    cut, held = _cut(rows, keys, positions)
    even = held.where("__lo = __hi").select(*keys, "__n", F.explode("__ranks").alias("__rank"), F.col("__lo").alias("__x"))
    mixed = held.where("__lo < __hi").select(*keys, "__piece", "__before", "__ranks")
    within = Window.partitionBy(*keys, "__piece").orderBy("__x")
    placed = null_safe_on(cut.select(*keys, "__n", "__piece", "__x"), mixed, [*keys, "__piece"], "inner")
    placed = placed.withColumn("__rank", (F.col("__before") + F.row_number().over(within) - 1).cast("bigint"))
    return even.unionByName(placed.where(F.array_contains("__ranks", F.col("__rank"))).select(*keys, "__n", "__rank", "__x"))


def _cut(rows: DataFrame, keys: list[str], positions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece, and the pieces that hold a wanted rank with those ranks."""
    near = F.array_distinct(F.array(*[f(p).cast("bigint") for p in positions.values() for f in (F.floor, F.ceil)]))
    grid = F.percentile_approx("__x", [k / GRID for k in range(GRID + 1)], ACCURACY)
    sized = rows.groupBy(*keys).agg(F.count("*").alias("__n"), grid.alias("__grid")).withColumn("__near", near)

    def around(rank):
        at = F.floor(rank / F.col("__n") * GRID).cast("int")
        return F.array(*[F.get("__grid", F.greatest(F.lit(0), F.least(F.lit(GRID), at + k))) for k in (-1, 2)])

    cuts = F.array_distinct(F.flatten(F.transform("__near", around)))
    cut = null_safe_on(rows, sized.select(*keys, "__n", "__near", cuts.alias("__cuts")), keys, "inner")
    # Even pieces lie between two cuts, odd pieces are the rows equal to a cut.
    below = F.size(F.filter("__cuts", lambda c: c < F.col("__x")))
    cut = cut.withColumn("__piece", 2 * below + F.array_contains("__cuts", F.col("__x")).cast("int"))
    pieces = cut.groupBy(*keys, "__piece").agg(F.first("__n").alias("__n"), F.first("__near").alias("__near"), F.count("*").alias("__c"),
                                               F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    order = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__c").over(order), F.lit(0)))
    inside = F.filter("__near", lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__c")))
    return cut, pieces.withColumn("__ranks", inside).where(F.size("__ranks") > 0)


def dense_index(df: DataFrame, keys: list[str], order: str, name: str, prefix: int = 4) -> DataFrame:
    """Zero-based position of each row in its key group, ordered by a hex digest column.

    The group is cut by digest prefix; each piece is ranked apart and shifted by the
    rows of the pieces before it. Four digits make 65,536 pieces of a large group.
    """
    cut = df.withColumn("__cut", F.substring(order, 1, prefix))
    counts = cut.groupBy(*keys, "__cut").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__cut", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    total = counts.groupBy(*keys).agg(F.sum("__c").alias(f"{name}_total"))
    local = F.row_number().over(Window.partitionBy(*keys, "__cut").orderBy(order)) - 1
    out = cut.withColumn("__r", local)
    out = null_safe_on(out, offsets, [*keys, "__cut"], "inner")
    out = null_safe_on(out, total, keys, "inner") if keys else out.crossJoin(total)
    return out.withColumn(name, F.col("__off") + F.col("__r")).drop("__cut", "__r", "__off")
