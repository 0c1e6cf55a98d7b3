"""Exact dedup: two Bloom passes find possibly repeated hashes, and only their rows are shuffled.

Texts are equal when they are identical without ASCII blanks. Each row gets a 64-bit hash of that text and its
SHA-256. The first pass puts the hashes into a filter as they come; a hash that is in it already goes
into a second filter. The second pass tests every row against the second filter: rows that fail it
have a text of their own and are done. The others are grouped by SHA-256, which decides.

``memberships`` works on digests written once (about 60 bytes a row), in rounds of ``ROUND`` rows by hash, so that
the filter of a round is at most 64 MB however many rows there are and each round reads its own files only.
``keep_one`` handles whole rows in one pass with one filter of at most 64 MB: beyond 44 million rows more and
more rows that aren't repeated are shuffled too, and the result is the same.

A group may hold a third of all rows: its size and first row come from partial aggregates, groups with a
thousandth of the rows or more (under 1,000) are handed back by broadcast, the others by a join.
In ``keep_one`` each task keeps only its first row of a group before the shuffle.

Defined results: null text counts as empty, and empty and blank texts are equal. Of equal texts the row with the most code
points stays, then the smallest doc_id, null last; of rows that tie, one. ``keep_id`` is null where the row that
stays has no doc_id. Further columns don't matter; ``keep_one`` returns them as they were.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import shared_dir, staged
from . import bloom

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a round; its filter then has ``bloom.MAX_BLOCKS`` blocks.
ROUND = bloom.MAX_BLOCKS * bloom.BLOCK_BITS // bloom.BITS_PER_KEY
HOT_SHARE, HOT_LEAST = 1000, 1000


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _digests(docs: DataFrame, rounds: int) -> DataFrame:
    """(doc_id, sha, chars, key, row, round) of every document, written once."""
    spark = docs.sparkSession
    read = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), normal(F.col("text")).alias("text"))
    made = read.select("doc_id", "chars", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"),
                       F.monotonically_increasing_id().alias("row"))
    made = made.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(rounds)).cast("int"))
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/digests-{uuid.uuid4().hex}"
    made.write.partitionBy("round").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _repeated(keys: DataFrame, rows: int) -> tuple[DataFrame, int]:
    blocks = bloom.blocks_for(rows)
    return staged(bloom.build(keys.select("key"), blocks, repeated=True), "repeated-hashes"), blocks


def _judge(part: DataFrame, rows: int) -> DataFrame:
    """Rows of one round with their group's first row and size."""
    bits, blocks = _repeated(part, rows)
    known = F.broadcast(bits)
    met = (bloom.block_of(F.col("key"), blocks) == F.col("block")) & bloom.passes(F.col("key"), F.col("bits"))
    alone = part.join(known, met, "left_anti").select("doc_id", "sha", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.lit(True).alias("kept"))
    maybe = part.join(known, met, "left_semi").select("doc_id", "sha", "chars", "row")
    order = F.struct((-F.col("chars")).alias("o"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    groups = staged(maybe.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(order).alias("first")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    limit = max(HOT_LEAST, -(-total // HOT_SHARE))
    label = groups.select("sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    hot = F.broadcast(label.where(F.col("group_size") >= limit))  # at most HOT_SHARE rows
    back = maybe.join(hot, "sha").unionByName(maybe.join(hot.select("sha"), "sha", "left_anti").join(label.where(F.col("group_size") < limit), "sha"))
    return alone.unionByName(back.select("doc_id", "sha", "group_size", "keep_id", (F.col("row") == F.col("keep_row")).alias("kept")))


def memberships(docs: DataFrame, round_rows: int = ROUND) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.count()
    rounds = max(1, -(-rows // round_rows))
    digests = _digests(docs, rounds)
    judge = lambda r: _judge(digests.where(F.col("round") == r), -(-rows // rounds))
    # Several rounds are written one after the other, so that one filter is held at a time.
    out = judge(0) if rounds == 1 else reduce(DataFrame.unionByName, [staged(judge(r), "round") for r in range(rounds)])
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they were."""
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(inner).withColumn("text", normal(F.col("doc.text"))).select("doc", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("sha"))
    bits, blocks = _repeated(keyed, docs.count())
    met = (bloom.block_of(F.col("key"), blocks) == F.col("block")) & bloom.passes(F.col("key"), F.col("bits"))
    alone = keyed.join(F.broadcast(bits), met, "left_anti").select("doc")
    order = Window.partitionBy("sha").orderBy(F.length(F.coalesce("doc.text", F.lit(""))).desc(), F.col("doc.doc_id").asc_nulls_last())
    first = keyed.join(F.broadcast(bits), met, "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").select("doc")
    return alone.unionAll(first).select("doc.*")
