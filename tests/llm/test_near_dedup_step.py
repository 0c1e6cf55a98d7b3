"""The simhash stage of the pipeline lets texts meet by their fingerprints."""

import pytest

pytest.importorskip("peerwake.llm")

from peerwake.llm import near_copies, simhash  # noqa: E402


def test_keep_one_groups_texts_that_only_fingerprints_bring_together(spark, monkeypatch):
    """With no rounds of other keys left to pair them, copies that fingerprints bring together are still grouped, others aren't."""
    monkeypatch.setattr(near_copies, "_open_keys", lambda rows: rows.select("key", "node").limit(0))
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (2, words.upper()), (3, "  " + words), (4, "nothing like it at all in here"), (5, None), (6, " ")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5]


def test_rare_shingles_pair_hardly_more_texts_than_are_linked(spark):
    """Copies of one text that lie around the limit share most shingles; candidates are no square of their number, and no link is lost."""
    import random

    from pyspark.sql import functions as F
    rnd, base = random.Random(5), [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        words = list(base)
        for place in rnd.sample(range(150), rnd.randint(1, 6)):
            words[place] = f"x{k}y{place}"
        texts.append(" ".join(words))
    found = {t: near_copies.shingles(t, near_copies._Hashes()) for t in texts}
    keys = {t: near_copies.signature(s)[1] for t, s in found.items()}
    table = spark.createDataFrame([(t, len(found[t]), int(keys[t][0]), int(keys[t][1])) for t in texts], "text string, n long, s long, t long")
    table = table.withColumn("node", near_copies.node_of(F.col("text")))
    open_ = table.select("node", "n", "s", "t", F.col("node").alias("component"))
    named = {bytes(r.node): found[r.text] for r in table.select("node", "text").collect()}
    pairs = {(bytes(r.a), bytes(r.b)) for r in near_copies._by_rare_shingles(open_, near_copies._sets(table.select("node", "text"))).collect()}
    like = lambda a, b: 5 * (both := len(set(named[a]) & set(named[b]))) >= 4 * (len(named[a]) + len(named[b]) - both)
    links = {(a, b) for a in named for b in named if a < b and like(a, b)}
    assert 100 < len(links) < 120 * 119 / 4 and links <= pairs and len(pairs) <= 1.5 * len(links)
