"""Phrase collocation mining over a weighted de Bruijn graph.

Only the longest grams are counted: each word of a piece gives one edge of ``SIZE`` = 3 symbols, from the node of its first
two to the node of its last two, and at a piece's end the missing symbols are ``END``. Shorter counts follow from the flow: a
two-word node occurs as often as its outgoing edges plus the pieces that end with it (edges to END), and a word as often as the
nodes that begin with it plus the pieces that end with it.

Words with under ``LEAST`` occurrences can't be in a candidate. A first pass counts words; those frequent enough get a symbol
of their own (a 64-bit hash of language and word, checked to be unique), all others share one, so that rare words
merge their edges and nothing of a candidate's count is lost. A second pass sums hashes of neighbouring frequent words in the same
way; in an edge, a word that doesn't make a frequent pair with the one before it counts as rare, so few edges are left.
Which words and pairs are frequent is told to the passes by Bloom filters of at most 64 MB (``bloom``): what passes
wrongly only keeps its own symbol, and all counts come from the edges.

The heavy edges (``LEAST`` or more) are compacted: a node whose ingoing and outgoing edge both carry its whole count lies inside
a unary path, found by doubling pointers. A path is one row of symbols and one count, no longer than the longest piece. Its windows are
the three-word candidates. Its inner nodes are as frequent as their edges, so they are never kept as phrases; two-word
candidates are the other nodes, less those that a heavy edge covers for ``COVERED`` percent or more.

Hot words and pairs: edges are summed in each task before they are shuffled, and spread by all three symbols; node and word
counts are partial sums. The best ``TOP`` phrases of a language are cut in each task before they meet. Products are decimals
of 38 digits: exact while counts stay below 10^16.

Defined results: null and empty texts have no words; a null lang is ``und``, and is one language with a lang of that name. Repeated
rows count again. Without candidates there are no rows. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from . import bloom
from .common import arrow_map, give_back, small_batches

LEAST, COVERED, TOP, SCALE, SEED, HELD = 10, 50, 2000, 1_000_000, 42, 1 << 21
END, RARE = 0, 1
#: Letters A-Z become small, tabs become blanks and everything that ends a piece a full stop (contract).
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


def tokens(text: str | None) -> list[bytes]:
    """Words, with a full stop after each piece."""
    return ((text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).replace(b".", b" . ") + b" .").split()


def _symbol(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(lang, word, symbol, n) of every word; a task sums its words before they are shuffled."""
    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, counts in held.items():
                counts.pop(b".", None)
                symbols = np.array([_symbol(lang, w, seed) for w in counts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()),
                                                  pa.array(symbols), pa.array(counts.values(), pa.int64())], names=["lang", "word", "symbol", "n"])
            held.clear()

        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].update(tokens(text))
            if sum(map(len, held.values())) > HELD // 4:
                yield from flush()
        yield from flush()
        give_back()

    counted = arrow_map(_named(docs), run, "lang string, word string, symbol long, n long")
    return counted.groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n"))


class _Symbols:
    """The symbols of the words of each language, learned a batch at a time; emptied when they are ``HELD`` / 4 words."""

    def __init__(self, frequent: bloom.Keys, seed: int):
        self.frequent, self.seed, self.known, self.size = frequent, seed, {}, 0

    def of(self, lang: str, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Symbols of each text, with two ENDs behind it."""
        if self.size > HELD >> 2:
            self.known, self.size = {}, 0
        known = self.known.setdefault(lang, {b".": END})
        if new := list(set(itertools.chain.from_iterable(texts)).difference(known)):
            symbols = np.array([_symbol(lang, w, self.seed) for w in new], np.uint64)
            known.update(zip(new, np.where(self.frequent.passes(symbols), symbols, np.uint64(RARE)).tolist(), strict=True))
            self.size += len(new)
        return [np.fromiter(itertools.chain(map(known.__getitem__, found), (END, END)), np.uint64, len(found) + 2) for found in texts]


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mixed = (x * np.uint64(0x9E3779B97F4A7C15) ^ y) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(29)


def _pairs(ids: np.ndarray, _) -> pa.RecordBatch:
    """(pair, n): how often each hash of two neighbouring frequent words occurs."""
    x, y = ids[:-1], ids[1:]
    own = (x > RARE) & (y > RARE)
    pair, n = np.unique(_mix(x[own], y[own]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n, pa.int64())], names=["pair", "n"])


def _edges(ids: np.ndarray, frequent: bloom.Keys) -> pa.RecordBatch:
    """Counts of equal edges. Edges whose mixed keys collide may stay apart; the next sum joins them."""
    x, y, z = ids[:-2], ids[1:-1], ids[2:]
    often = np.zeros(len(ids) - 1, bool)
    both = np.flatnonzero((ids[:-1] > RARE) & (ids[1:] > RARE))
    often[both] = frequent.passes(_mix(ids[both], ids[both + 1]))
    y = np.where(often[:-1] | (y == END), y, np.uint64(RARE))
    z = np.where(y <= RARE, y, np.where(often[1:] | (z == END), z, np.uint64(RARE)))
    own = x > RARE
    x, y, z = x[own], y[own], z[own]
    order = np.argsort(_mix(_mix(x, y), z))
    x, y, z = x[order], y[order], z[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]))
    n = np.diff(np.append(first, len(x)))
    return pa.RecordBatch.from_arrays([pa.array(c[first].view(np.int64)) for c in (x, y, z)] + [pa.array(n, pa.int64())], names=["x", "y", "z", "n"])


def _filter(keys: DataFrame, label: str):
    """A Bloom filter of the one column of ``keys`` as (blocks' rows, number of blocks): 64 MB at most, held for the tasks."""
    keys = staged(keys, label)
    blocks = bloom.blocks_for(keys.count())
    rows = [(r["block"], np.array(r["bits"], np.int64)) for r in staged(bloom.build(keys, blocks), f"{label}-filter").toLocalIterator()]
    return keys.sparkSession.sparkContext.broadcast((rows, blocks))


def _chunks(docs: DataFrame, cut, words_of, pairs_of, seed: int, schema: str) -> DataFrame:
    """``cut`` of the symbols of many texts at a time, about ``HELD`` / 2; two ENDs lie between texts."""
    def run(batches):
        symbols, held, size = _Symbols(bloom.Keys(*words_of.value), seed), [], 0
        frequent = bloom.Keys(*pairs_of.value) if pairs_of else None
        for batch in small_batches(batches):
            texts: dict[str, list] = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts[lang].append(tokens(text))
            for lang, found in texts.items():
                held += symbols.of(lang, found)
                size += sum(map(len, found))
            if size >= HELD >> 1:
                yield cut(np.concatenate(held), frequent)
                held, size = [], 0
        if held:
            yield cut(np.concatenate(held), frequent)
        give_back()

    return arrow_map(_named(docs), run, schema)


def graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, symbol, n) and the counts of everything that occurs ``LEAST`` times: rows x, y, z, n, with
    null z for a two-word node and null y for a word.

    All three levels come from one shuffle of edges. END and RARE are filtered from what was written, since a
    filter on symbols would move below that shuffle and make it three.
    """
    for seed in itertools.count(SEED):
        vocabulary = staged(words(docs, seed), "words")
        twice = vocabulary.groupBy("symbol").agg(F.count("*").alias("k")).where(F.col("k") > 1)
        if twice.isEmpty() and vocabulary.where(F.col("symbol").isin(END, RARE)).isEmpty():
            break  # else two words share a symbol: another seed
    many = F.col("n") >= LEAST
    words_of = _filter(vocabulary.where(many).select("symbol"), "frequent-words")
    pairs = _chunks(docs, _pairs, words_of, None, seed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs_of = _filter(pairs.where(many).select("pair"), "frequent-pairs")
    summed = _chunks(docs, _edges, words_of, pairs_of, seed, "x long, y long, z long, n long").groupBy("x", "y", "z").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("long")
    two = summed.groupBy("x", "y").agg(F.sum("n").alias("n")).where(many).select("x", "y", none.alias("z"), "n")
    one = summed.groupBy("x").agg(F.sum("n").alias("n")).where(many).select("x", none.alias("y"), none.alias("z"), "n")
    counts = staged(summed.where(many).unionByName(two).unionByName(one), "graph")
    return vocabulary, counts.where(f"(y IS NULL OR y NOT IN ({END}, {RARE})) AND (z IS NULL OR z NOT IN ({END}, {RARE}))")


def paths(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary paths of heavy edges (symbols, n), and the nodes inside them (x, y)."""
    heavy, nodes = counts.where("z IS NOT NULL"), counts.where("y IS NOT NULL AND z IS NULL").select("x", "y", F.col("n").alias("f"))
    into = heavy.select(F.col("x").alias("o"), F.col("y").alias("x"), F.col("z").alias("y"), "n").join(nodes, ["x", "y"]).where("n = f").select("o", "x", "y")
    out = heavy.join(nodes, ["x", "y"]).where("n = f").select("x", "y", "z")
    inner = staged(into.join(out, ["x", "y"]), "inner-nodes")  # one edge in and one edge out
    now, open_ = inner.select("x", "y", F.col("o").alias("tx"), F.col("x").alias("ty"), F.col("y").alias("via"), F.lit(1).alias("at")), 1
    while open_:  # pointers reach twice as far each time; at the end (tx, ty) lies outside the path
        now = staged(now, "path-pointers")
        then = now.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("via").alias("up"), F.col("at").alias("more"))
        open_ = now.join(then, ["tx", "ty"], "left_semi").count()
        if open_:
            now = now.join(then, ["tx", "ty"], "left").select("x", "y", F.coalesce("ux", "tx").alias("tx"), F.coalesce("uy", "ty").alias("ty"),
                                                              F.coalesce("up", "via").alias("via"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
    placed = heavy.join(now, ["x", "y"], "left").select("n", F.coalesce("tx", "x").alias("a"), F.coalesce("ty", "y").alias("b"), F.coalesce("via", "z").alias("c"),
                                                        F.coalesce("at", F.lit(0)).alias("at"), "z")
    found = placed.groupBy("a", "b", "c").agg(F.sort_array(F.collect_list(F.struct("at", "z"))).alias("steps"), F.min("n").alias("n"))
    return staged(found.select(F.concat(F.array("a", "b"), F.col("steps.z")).alias("symbols"), "n"), "paths"), inner.select("x", "y")


def _score(a: Column, cut: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) in whole decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = (wide(F.lit(SCALE)) * wide(a)).cast("decimal(38,0)") * wide(a)
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(cut["l"]) * wide(cut["r"])).cast("decimal(38,0)"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    vocabulary, counts = graph(docs)
    compact, inner = paths(counts)
    ones = counts.where("y IS NULL").join(vocabulary.select(F.col("symbol").alias("x"), "lang", "word"), "x").select("x", "lang", "word", F.col("n").alias("f"))
    ones = staged(ones, "frequent-words")
    nodes = counts.where("y IS NOT NULL AND z IS NULL").select("x", "y", F.col("n").alias("f"))
    windows = F.transform(F.sequence(F.lit(0), F.size("symbols") - 3), lambda i: F.struct(*[F.get("symbols", i + k).alias(c) for k, c in enumerate("xyz")]))
    three = compact.select(F.explode(windows).alias("w"), F.col("n").alias("a")).select("w.*", "a")
    cover = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("w")
    covered = three.select(cover, "a").select("w.*", "a").groupBy("x", "y").agg(F.max("a").alias("most"))
    two = (nodes.join(inner, ["x", "y"], "left_anti").join(covered, ["x", "y"], "left").where(F.expr(f"most IS NULL OR 100 * most < {COVERED} * f"))
           .select("x", "y", F.col("f").alias("a")))
    word = lambda c: ones.select(F.col("x").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"), *(["lang"] if c == "x" else []))
    node = lambda p, q: nodes.select(F.col("x").alias(p), F.col("y").alias(q), F.col("f").alias(f"f_{p}{q}"))
    cuts2 = two.join(word("x"), "x").join(word("y"), "y").select("lang", F.concat_ws(" ", "word_x", "word_y").alias("phrase"), "a",
                                                                F.array(F.struct(F.col("f_x").alias("l"), F.col("f_y").alias("r"))).alias("cuts"))
    cuts3 = (three.join(node("x", "y"), ["x", "y"]).join(node("y", "z"), ["y", "z"]).join(word("x"), "x").join(word("y").drop("f_y"), "y").join(word("z"), "z")
             .select("lang", F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"), "a", F.array(
                 F.struct(F.col("f_x").alias("l"), F.col("f_yz").alias("r")), F.struct(F.col("f_xy").alias("l"), F.col("f_z").alias("r"))).alias("cuts")))
    scored = cuts2.unionByName(cuts3).withColumn("best", F.array_min(F.transform("cuts", lambda c, k: F.struct(
        _score(F.col("a"), c).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
