"""Connected components of a link table by alternating stars, wholly in joins and groupings.

Each round replaces a node's links by links to its least neighbour: first of larger
neighbours (large star), then of smaller ones (small star). Rounds grow with the logarithm of
the longest chain; the loop reads one checksum a round, never links. A hub's links are
reduced to one minimum before they are shuffled, and the join that hands the minimum back
can be split by the engine where a hub is large. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` has (a, b) with a > b. Large star: at each node, larger neighbours go to its least neighbour or itself."""
    seen = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = seen.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = seen.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its least node. ``links``: columns a, b."""
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == mark:
            break
        mark = seen
        now = staged(_star(_star(now, True), False), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
