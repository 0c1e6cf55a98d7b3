"""Exact dedup, collocations and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerwake.llm import bloom, collocations, exact_dedup, queries, spelling

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
LONG = "Wörterbuch lang " * 40_000
EDGES = [(None, "no one's words here", None), (1, None, None), (2, "", "en"), (3, " \n\t\x0b", "en"), (4, "same text here", "en"), (4, "same text here", "en"),
         (5, "sametexthere", None), (4, "another text", "und"), (6, LONG, "de"), (7, "%%% 123 !!", "en"), (None, "same  text here", "fr")]
CLASHES = ("key", "sha", "row", "round", "bits", "block", "doc", "n", "word", "near", "x", "y", "z", "rank", "kept", "keep_id", "symbol", "chars")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    made = spark.createDataFrame(EDGES, DOCS).withColumns({c: F.lit("mine") for c in CLASHES})
    return made.withColumns({"a.b": F.lit(1), "pairs": F.create_map(F.lit("k"), F.lit(1))})


# ---- Bloom filter

def test_filter_holds_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    blocks = bloom.blocks_for(20_000)
    rows = bloom.build(keys, blocks).collect()
    held = bloom.Keys([(r["block"], r["bits"]) for r in rows], blocks)
    own = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    other = np.array([r[0] for r in spark.range(20_000, 60_000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    assert blocks == 2 and held.passes(own).all() and held.passes(other).mean() < 0.02
    probed = keys.join(F.broadcast(spark.createDataFrame(rows, "block int, bits array<long>")),
                       (bloom.block_of(F.col("key"), blocks) == F.col("block")) & bloom.passes(F.col("key"), F.col("bits")), "left_semi")
    assert probed.count() == 20_000


def test_repeated_filter_finds_every_repeated_key(spark):
    keys = spark.range(9_000).unionAll(spark.range(3_000)).repartition(5).select(F.xxhash64("id").alias("key"))
    held = bloom.Keys([(r["block"], r["bits"]) for r in bloom.build(keys, 3, repeated=True).collect()], 3)
    value = lambda a, b: np.array([r[0] for r in spark.range(a, b).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    assert held.passes(value(0, 3_000)).all() and held.passes(value(3_000, 9_000)).mean() < 0.02


# ---- Exact dedup

def plain_dedup(rows):
    groups = defaultdict(list)
    for k, (i, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, k))
    out = []
    for text, members in groups.items():
        first = min(members)
        for _, nameless, i, k in members:
            out.append((None if nameless else i, None if first[1] else first[2], len(members), k == first[3], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_equals_brute_force_in_one_round_and_in_several(docs, edges):
    for table in (docs, edges):
        want = plain_dedup([(r.doc_id, r.text) for r in table.collect()])
        for rows in (exact_dedup.ROUND, 7):
            found = exact_dedup.memberships(table, rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
            assert sorted(map(tuple, found.collect()), key=str) == want


def test_large_groups_come_back_whole(spark):
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id") % 3_000)).alias("text"))
    assert sorted(map(tuple, exact_dedup.memberships(rows).collect()), key=str) == plain_dedup([tuple(r) for r in rows.collect()])


def test_keep_one_returns_whole_rows(docs, edges):
    for table in (docs, edges):
        kept = exact_dedup.keep_one(table)
        want = exact_dedup.memberships(table).where("kept")
        assert kept.columns == table.columns
        assert sorted(map(str, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(map(str, (r.doc_id for r in want.select("doc_id").collect())))
    assert {r["a.b"] for r in kept.collect()} == {1}


# ---- Collocations

def test_collocations_of_edge_rows_equal_sql(spark, edges):
    import duckdb

    rng, rows = random.Random(3), [(i, t if t is not LONG else t[:3_200], x) for i, t, x in EDGES]  # the SQL is quadratic in a piece
    words = ["Alpha", "beta", "gamma", "delta", "über", "x"]
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", ", "]) for _ in range(40)) + " one two three four five six one two three four five seven" * (k % 3)
        rows.append((100 + k, text, rng.choice(["en", "de", None, "und"])))
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in CLASHES})
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "lang").toPandas().astype(object).where(lambda t: t.notna(), None))
    rel = con.execute(queries.COLLOCATIONS_SQL)
    names = [d[0] for d in rel.description]
    found = collocations.collocations(table).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(rel.fetchall()) and found.count() > 30


def test_paths_hold_each_heavy_edge_once(docs):
    _, counts = collocations.graph(docs)
    found, inner = collocations.paths(counts)
    held = Counter()
    for r in found.collect():
        for k in range(len(r.symbols) - 2):
            held[tuple(r.symbols[k:k + 3]), r.n] += 1
    assert held == Counter(((r.x, r.y, r.z), r.n) for r in counts.where("z IS NOT NULL").collect())
    assert inner.count() == sum(len(s) - 3 for s in (r.symbols for r in found.collect()))


def test_long_repeated_piece_becomes_one_path(spark):
    piece = " ".join(f"word{k}" for k in range(50))
    table = spark.createDataFrame([(k, piece, "en") for k in range(12)], DOCS)
    found, inner = collocations.paths(collocations.graph(table)[1])
    assert [(len(r.symbols), r.n) for r in found.collect()] == [(50, 12)] and inner.count() == 47
    assert {(r.phrase.count(" "), r.a, r.score) for r in collocations.collocations(table).collect()} == {(2, 12, 1_000_000)}


# ---- Spelling variants

def plain_variants(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    without, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            without[i, w[:i] + w[i + 1:]].add(w)
    for (_, x), found in without.items():
        for w in found:
            near[w] |= found - {w}
            if x in counts:
                near[w].add(x)
                near[x].add(w)
    best = {w: min(v, key=lambda u: (-counts[u], u)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= 10 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), counts.get(form.get(w)) or 0) for w, n in counts.items())


def listed(table):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(table).collect())


def test_variants_equal_brute_force(spark, docs, edges):
    rng, rows = random.Random(5), []
    for k in range(60):  # chains of forms: each ten times as frequent as the one before
        rows.append((k, "colouring colouring " * 100 + "coloring " * (25 if k < 8 else 0) + ("colorings " * 2 if k < 8 else "") + ("kolorings " if k < 2 else ""), "en"))
    rows += [(1_000 + k, " ".join("".join(rng.choice("abcé") for _ in range(rng.choice((7, 8)))) for _ in range(400)), "fr") for k in range(10)]
    for table in (spark.createDataFrame(rows, DOCS), docs, edges):
        assert listed(table) == plain_variants([(r.doc_id, r.text) for r in table.collect()])


def test_pivots_are_apart_and_least():
    rng = random.Random(1)
    for _ in range(300):
        places = [(p, rng.randrange(50)) for p in sorted(rng.sample(range(12), rng.randrange(3, 8)))]
        a, b = spelling.pivots(places)
        rank = dict(places)
        least = min(r + s for p, r in places for q, s in places if q - p >= 2)
        assert b - a >= 2 and rank[a] + rank[b] == least


@pytest.mark.parametrize("run", [exact_dedup.memberships, exact_dedup.keep_one, collocations.collocations, spelling.variants])
def test_empty_tables(edges, run):
    assert run(edges.where("false")).collect() == []
