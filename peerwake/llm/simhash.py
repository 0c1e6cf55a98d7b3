"""SimHash near-dedup with keys from the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The [23,12,7] Golay code puts
every 23-bit word within 3 bits of one codeword. A segment's keys are the 12-bit indexes of the
codewords nearest to it and to each word one bit away (1 or 6 keys). Two segments that differ in
up to 2 bits have a word between them that is at most one bit from each, so they share a key.

With up to 2 differing bits over three segments one segment is free of errors (pigeonhole) and
the next has at most 2, so a join key is (a segment, a Golay key of the next). Each
fingerprint gives 3 to 18 keys of about 34 bits. Fingerprints that share a key are joined and
verified on all 64 bits.

Only distinct fingerprints are joined, so exact copies cost nothing. Keys with more than
``CROWD`` fingerprints aren't joined in pairs: their fingerprints meet at all words that are at
most one bit away (65 each). Those at one word differ in at most 2 bits from each other, and any
two that differ in up to 2 bits share such a word; a link to the least is exact and linear.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other.
A null doc_id has a fingerprint, never is a component's least id, and gets null where no
doc_id is reachable. Repeated rows stay. Columns named like a result are replaced.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checkpoints import staged
from . import near_copies
from .common import arrow_map, small_batches
from .components import components

SEED, WORDS, CROWD = 42, 3, 64
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit, bits
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the binary Golay code


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each upper half, and the error pattern of up to 3 bits of each remainder."""
    upper = np.array([_remainder(k << 11) for k in range(4096)], np.int32)
    single = [_remainder(1 << k) for k in range(23)]
    errors = np.zeros(2048, np.int32)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            remainder = 0
            for b in bits:
                remainder ^= single[b]
            errors[remainder] = sum(1 << b for b in bits)
    return upper, errors


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within 3 bits of each 23-bit word."""
    upper, errors = golay_tables()
    return (words ^ errors[upper[words >> 11] ^ (words & 2047)]) >> 11


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indexes of each word and its 23 neighbours, and a mask of the first of equal ones."""
    flips = np.array([0, *[1 << k for k in range(23)]], np.int32)
    near = np.sort(nearest_codeword(words.astype(np.int32)[:, None] ^ flips), axis=1)
    return near, np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)


def fingerprint(text: str) -> int:
    """Signed 64-bit value whose bit is set where over half of the shingles' hashes have it set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = zip(*[words[k:] for k in range(WORDS)], strict=False) if len(words) >= WORDS else [words]
    counts, n, hashed = np.zeros(64, np.int64), 0, []
    for shingle in shingles:
        hashed.append(xxhash.xxh64_intdigest(b" ".join(shingle), SEED))
        if len(hashed) == 1 << 16:
            counts, n, hashed = counts + _bits(hashed), n + len(hashed), []
    counts, n = counts + _bits(hashed), n + len(hashed)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def _bits(hashed: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashed, ">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of whole texts."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for batch in small_batches(batches):
            fps = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), run, schema)


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp): for each segment, its bits with each Golay key of the next segment."""
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            parts = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1) for low, bits in SEGMENTS]
            for k, part in enumerate(parts):
                near, first = golay_keys(parts[(k + 1) % 3])
                row, _ = np.nonzero(first)
                key = (np.int64(k) << 34) | (part[row] << 12) | near[first]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[row], pa.int64())], names=["key", "fp"])

    return arrow_map(fps, run, "key long, fp long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect whatever fingerprints differ in up to 2 bits. ``fps``: distinct."""
    keyed = staged(_keyed(fps), "golay-keys")
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    few, many = sizes.where(F.col("n") <= crowd).select("key"), sizes.where(F.col("n") > crowd).select("key")
    shared = keyed.join(few, "key")
    pairs = (shared.alias("x").join(shared.alias("y"), "key").where("x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= 2")
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    crowded = keyed.join(many, "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    near = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = near.join(least, "word").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.unionAll(met).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    marked = staged(fingerprints(docs), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(links(distinct.select("fp")))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = staged(named, "groups")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(least, "component").select("fp", "component_id")
    return marked.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def met_texts(docs: DataFrame) -> DataFrame:
    """(a, b): texts, by ``near_copies.node_of``, whose fingerprints are equal or linked; a fingerprint's texts meet its least."""
    texts = docs.select(near_copies.node_of(F.col("text")).alias("doc_id"), "text").groupBy("doc_id").agg(F.first("text").alias("text"))
    marked = staged(fingerprints(texts), "text-fingerprints")
    least = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    same = marked.join(least, "fp").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    linked = links(least.select("fp")).toDF("x", "y").join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y")
    return same.unionAll(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without later near copies: of each group one row stays, of the least doc_id.

    Texts meet by their fingerprints, and the exact similarity of ``near_copies`` is checked; what is
    over 2 bits apart and still a near copy is found there.
    Rows without doc_id come last in their group and stay if it has no other. Of groups that
    would each keep a row of one doc_id, one keeps it.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(near_copies.node_of(F.col("text")).alias("__node"), "doc_id", F.xxhash64(*map(_hashable, docs.schema)).alias("__row"), F.struct(*whole).alias("__doc"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__node", "__row"))
    nodes = staged(own.groupBy(F.col("__node").alias("node")).agg(first.alias("first")), "texts")
    grouped = nodes.join(near_copies.groups(docs, pairs=met_texts(docs)), "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select("first.*")
    order = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("__node"))).orderBy("__row")
    kept = staged(grouped.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("__node", "__row"), "survivors")
    # Repeated rows are reduced to one before they are shuffled.
    return own.groupBy("__node", "__row").agg(F.first("__doc").alias("__doc")).join(kept, ["__node", "__row"], "left_semi").select("__doc.*")


def _hashable(field: T.StructField) -> Column:
    """A column that can be hashed; maps, which Spark doesn't hash, as JSON."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column
