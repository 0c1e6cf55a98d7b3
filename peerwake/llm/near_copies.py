"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash can't find these. Texts at that similarity differ in up to a dozen of 64 bits, and keys that
bring all fingerprints within a dozen bits together bring everything together. So texts meet by
MinHash: ``BANDS`` keys of ``ROWS`` minima each. A pair at 0.8 misses all keys with a chance of
(1 - 0.8^4)^20, under 3 in 100,000, and a more similar one less often. A pair that meets is linked
only if the exact similarity of its sets is high enough; shingles are 64-bit hashes of their words.

Only distinct texts meet, and a node is the MD5 of a text. In each of ``HUBS`` rounds all texts of a key
meet one of them, its hub, if they aren't in the hub's group yet; a key of like texts so costs a row for
each. A sketch of two bits of 64 minima goes with each text and stops most unlike pairs in the join, before any
set of shingles moves (it stops a pair at 0.8 with a chance under one in a million). What a key still holds apart
after the rounds meets by rare shingles instead of in all pairs: of two sets at 0.8 or more, the first fifths in any
one order share a shingle, so each text sends its rarest fifth, and shingles of a single text or group bring
no pair. Texts just below 0.8 share such shingles in great number, so a pair leaves the join only if no bound speaks
against it (``_may_reach``); the bounds are exact and lose no link. The groups are thus at least those of all pairs that share a key.

Defined results: words are parted by ASCII blanks and lower-cased in ASCII. A text under five words is one shingle.
Null, empty and blank texts are copies of each other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from .common import arrow_map, small_batches
from .components import components

WORDS, BANDS, ROWS, HUBS, APART, VOCABULARY = 5, 20, 4, 3, 26, 1 << 17
MAP = 1024  # bits of the map of a text's shingles
_ODD = np.random.PCG64(42).random_raw(BANDS * ROWS + WORDS + 1) | np.uint64(1)
_WORD, _PERMUTE, _FINAL = _ODD[:WORDS], _ODD[WORDS:-1, None], _ODD[-1]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _FINAL
    return x ^ (x >> np.uint64(29))


def shingles(text: str, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; one zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    hashed = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    return np.unique(_mixed(sum(hashed[k:k + n] * _WORD[k] for k in range(size))))


def signature(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set, and its sketch: two words of one bit of each of 64 minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingle), 1024):
        np.minimum(least, (_PERMUTE * shingle[start:start + 1024]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS) * _WORD[:ROWS]
    keys = _mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _WORD[ROWS]).view(np.int64)
    mixed, place = _mixed(least[:64]), np.arange(64, dtype=np.uint64)
    bits = [((mixed >> np.uint64(k)) & np.uint64(1)) << place for k in (7, 29)]
    return keys, np.array([np.bitwise_or.reduce(b) for b in bits]).view(np.int64)


def shingle_map(shingle: np.ndarray) -> np.ndarray:
    """``MAP`` bits as words; a shingle sets the bit of its last places."""
    words, place = np.zeros(MAP // 64, np.uint64), shingle & np.uint64(MAP - 1)
    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return words


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _signed(texts: DataFrame) -> DataFrame:
    """(node, n, keys, s, t): the number of shingles, the keys and the sketch of each text."""
    def run(batches):
        hashes = _Hashes()
        for batch in small_batches(batches):
            sets = [shingles(t or "", hashes) for t in batch.column("text").to_pylist()]
            keys, sketches = zip(*map(signature, sets), strict=True) if sets else ((), ())
            both = np.array(sketches, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, sets), pa.int64()), _lists(list(keys)),
                                              pa.array(both[:, 0]), pa.array(both[:, 1])], names=["node", "n", "keys", "s", "t"])

    return arrow_map(texts, run, "node binary, n long, keys array<long>, s long, t long")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles, map) of each text."""
    def run(batches):
        hashes = _Hashes()
        for batch in small_batches(batches):
            sets = [shingles(t or "", hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets), _lists([shingle_map(x) for x in sets])], names=["node", "shingles", "map"])

    return arrow_map(texts, run, "node binary, shingles array<long>, map array<long>")


def _like(x: Column, y: Column, both: Column) -> Column:
    """Whether ``both`` of x and y shingles are 0.8 of all, in whole numbers."""
    return 5 * both >= 4 * (x + y - both)


def _may_link() -> Column:
    """Rows x and y in different groups, of like sizes and sketches."""
    other = F.col("x.s").bitwiseXOR(F.col("y.s")).bitwiseOR(F.col("x.t").bitwiseXOR(F.col("y.t")))
    return (F.col("x.component") != F.col("y.component")) & _like(F.col("x.n"), F.col("y.n"), F.least("x.n", "y.n")) & (F.bit_count(other) <= APART)


def _pairs(x: DataFrame, y: DataFrame, on: str) -> DataFrame:
    """Distinct pairs (a, b) with a < b of rows that share ``on`` and may be linked."""
    met = x.alias("x").join(y.alias("y"), (F.col(f"x.{on}") == F.col(f"y.{on}")) & _may_link())
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both, sets = F.size(F.array_intersect("a_set", "b_set")), sets.select("node", "shingles")
    held = pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b").select("a", "b", F.size("a_set").alias("x"), F.size("b_set").alias("y"), both.alias("both"))
    return held.where(_like(F.col("x"), F.col("y"), F.col("both"))).select("a", "b")


def _placed(met: DataFrame, found: DataFrame | None) -> DataFrame:
    """``met`` with each text's group; a text without links is its own."""
    if found is None:
        return met.withColumn("component", F.col("node"))
    return met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups with more links: known groups are stars already, so few rounds are left."""
    known = [] if found is None else [found.where("node <> component").toDF("a", "b")]
    return components(reduce(DataFrame.unionAll, known, links))


def _open_keys(rows: DataFrame) -> DataFrame:
    """(key, hub) of keys whose texts lie in several groups; the hub is the least node."""
    row = F.struct("node", "n", "s", "t", "component")
    kinds = rows.groupBy("key").agg(F.min(row).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    return kinds.where("low <> high").select("key", "hub")


def _without(met: DataFrame, hubs: DataFrame) -> DataFrame:
    """``met`` less the keys in which a text was the hub: it has met all others there."""
    done = hubs.groupBy("hub.node").agg(F.collect_list("key").alias("done"))  # at most BANDS keys a node
    left = F.when(F.col("done").isNull(), F.col("keys")).otherwise(F.array_except("keys", "done"))
    return met.join(done, "node", "left").withColumn("keys", left).drop("done")


def _may_reach() -> Column:
    """Whether rows x and y, met at a shingle, can have 0.8 of all shingles in common, ``need`` of them.

    None but shingles of several groups (``mixed`` of them) are common to both. In one order of all shingles the first common one has
    ``need`` - 1 behind it in both (``at``). A bit of one map that the other lacks is a shingle that the other lacks.
    """
    need = F.expr("(4 * (x.n + y.n) + 8) div 9")
    lacks = lambda p, q: F.aggregate(F.zip_with(f"{p}.map", f"{q}.map", lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda n, k: n + k)
    near = (F.least("x.mixed", "y.mixed") >= need) & (F.col("x.at") <= F.col("x.n") - need) & (F.col("y.at") <= F.col("y.n") - need)
    return _may_link() & near & (F.col("x.n") - lacks("x", "y") >= need) & (F.col("y.n") - lacks("y", "x") >= need)


def _by_rare_shingles(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``open_`` (node, n, s, t, component) that share one of the rarest fifth of both sets' shingles and may be linked."""
    tokens = sets.join(open_.select("node", "component"), "node").select("node", "component", F.explode("shingles").alias("shingle"))
    counts = tokens.groupBy("shingle").agg(F.count("*").alias("c"), (F.min("component") != F.max("component")).alias("mixed"))
    ranked = tokens.join(counts, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "shingle", "mixed"))).alias("all"))
    fifth = F.expr("slice(all, 1, cast(size(all) - (4 * size(all) + 4) div 5 + 1 as int))")
    sent = ranked.select("node", F.size(F.filter("all", lambda e: e["mixed"])).alias("mixed"), F.posexplode(fifth).alias("at", "e")).where("e.mixed")
    sent = sent.select("node", "mixed", "at", F.col("e.shingle").alias("shingle"))
    sent = staged(sent.join(open_.join(sets.select("node", "map"), "node"), "node"), "rare")
    held = sent.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("kinds"))
    mixed = sent.join(held.where("kinds > 1").select("shingle", F.col("top.component").alias("largest")), "shingle")
    x, y = mixed.where("component <> largest").alias("x"), mixed.alias("y")
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & once & _may_reach())
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def groups(docs: DataFrame, hubs: int = HUBS, pairs: DataFrame | None = None) -> DataFrame:
    """(node, component) of every text with a near copy. A node is ``node_of`` a text. Any number of rounds with hubs gives the same groups or larger ones.

    ``pairs``: nodes (a, b) that met before by other means; those that are near copies are grouped before the first round.
    """
    texts = docs.select(node_of(F.col("text")).alias("node"), "text")
    one = [F.first(c).alias(c) for c in ("n", "keys", "s", "t")]
    signed = staged(_signed(texts).groupBy("node").agg(*one), "signatures")
    keyed = signed.select("node", F.explode("keys").alias("key"))
    common = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    shared = keyed.join(common, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys"))
    met = staged(signed.drop("keys").join(shared, "node"), "met")
    sets = staged(_sets(texts.join(met, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))), "sets")
    found = None if pairs is None else _merged(None, staged(_verified(pairs, sets), "verified"))
    for turn in range(hubs + 1):
        placed = staged(_placed(met, found), "placed")
        rows = placed.select("*", F.explode("keys").alias("key")).drop("keys")
        open_keys = staged(_open_keys(rows), "open-keys")
        if open_keys.isEmpty():
            break
        if turn < hubs:
            pairs = _pairs(rows, open_keys.select("key", "hub.*"), "key")
            met = _without(met, open_keys)
        else:
            open_ = rows.join(open_keys.select("key"), "key", "left_semi").drop("key").distinct()
            pairs = _by_rare_shingles(staged(open_, "open"), sets)
        found = _merged(found, staged(_verified(pairs, sets), "verified"))
    return signed.select("node", F.col("node").alias("component")).limit(0) if found is None else found
