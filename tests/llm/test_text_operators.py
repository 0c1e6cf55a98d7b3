"""Brute-force versions, exact round trips and edge cases of the operators without SQL."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from peerwake.llm import (bpe, chat, decontaminate, langid, learning, licenses, near_copies, range_coder, rules, simhash, surrogates,
                          toxicity)
from peerwake.llm.components import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 30_000
EDGES = [(None, "some words of no one", None, None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 3),
         (4, "same text here", "en", "s", 14), (4, "same text here", "en", "s", 14), (5, "same text here", None, "s", 14),
         (4, "another text of the same id", "en", "s", 27), (6, LONG, "de", "s", len(LONG)), (7, "%%% 123 !!", "en", "s", 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns named like results."""
    made = spark.createDataFrame(EDGES, DOCS)
    return made.withColumns({c: F.lit("mine") for c in ("fp", "score", "key", "ids", "n_words", "shingle", "component_id", "n_entities", "held_out", "order", "words")})


def none_of(df):
    return df.where("false")


# ---- SimHash

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps):
    """fps: id -> value; links at 2 or fewer differing bits."""
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_fingerprints_and_components_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_components(fps)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{fps[i]:016x}", groups[i]) for i in texts}


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for flips in (0, 1, 2):
        other = words.copy()
        for i in range(len(words)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        a, b = simhash.golay_keys(words)[0], simhash.golay_keys(other)[0]
        assert all(set(x) & set(y) for x, y in zip(a, b, strict=True))
    near, first = simhash.golay_keys(words)
    assert set(first.sum(axis=1)) <= {1, 6}


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_connect_all_near_fingerprints(spark, crowd):
    rng = np.random.default_rng(2)
    values = set()
    for centre in rng.integers(0, 1 << 62, 4).tolist():
        for _ in range(12):
            x = centre
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            values.add(x - (1 << 64) if x >> 63 else x)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = plain_components({v: v % (1 << 64) for v in values})
    got = {v: v for v in values} | {r.node: r.component for r in components(simhash.links(fps, crowd)).collect()}
    same = lambda g: {frozenset(k for k in g if g[k] == c) for c in g.values()}
    assert same(got) == same(want)


def test_components_of_a_chain_and_none(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(none_of(chain)).count() == 0


def test_simhash_edges(spark, edges):
    found = simhash.near_duplicates(edges).collect()
    assert len(found) == len(EDGES)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16 and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[5].component_id == 4 and by_id[None].component_id is None
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 6, 7]
    assert simhash.near_duplicates(none_of(edges)).count() == 0


# ---- near copies of the pipeline

def five_word_similarity(a, b):
    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}
    x, y = shingles(a or ""), shingles(b or "")
    return len(x & y) / len(x | y)


def near_groups(texts, similarity=0.8):
    """Sets of two or more texts that links of brute force connect."""
    group = {t: {t} for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if five_word_similarity(a, b) >= similarity and group[a] is not group[b]:
                group[a] |= group[b]
                for t in group[b]:
                    group[t] = group[a]
    return {frozenset(g) for g in group.values() if len(g) > 1}


def edited_copies(seed, bases, copies, words):
    """Texts of seldom words, each with copies in which 0 to 8 words are others; so similarities lie around the limit."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        for _ in range(copies):
            new = list(base)
            for at in rng.integers(0, words, int(rng.integers(0, 9))):
                new[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(new))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("hubs", [0, 1, near_copies.HUBS])
def test_near_copy_groups_equal_brute_force(spark, docs, hubs):
    texts = list(dict.fromkeys([*(r.text for r in docs.select("text").collect()), *edited_copies(5, 6, 30, 150)]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", near_copies.node_of(F.col("text")))
    found = {}
    for r in table.join(near_copies.groups(table, hubs), "node").collect():
        found.setdefault(r.component, set()).add(r.text)
    want = near_groups(texts)
    assert len(want) > 6 and {frozenset(g) for g in found.values()} == want


def test_keep_one_drops_edited_copies_and_copies_without_id(spark):
    base = [f"word{i}" for i in range(120)]
    edited = " ".join([*base[:60], "other", *base[61:]])
    assert five_word_similarity(" ".join(base), edited) >= 0.8
    rows = [(7, " ".join(base)), (3, edited), (None, edited), (None, "alone here"), (None, "alone here"), (None, "Alone  here"), (9, "alone there")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower().split()[0]) for r in kept) == [(0, "alone"), (3, "word0"), (9, "alone")]


# ---- byte-level BPE

def plain_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs):
    codec = plain_encoding()
    want = {}
    for r in docs.collect():
        ids = codec.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: tuple(r[1:]) for r in bpe.digests(docs).collect()} == want


@pytest.mark.parametrize("text", ["a b  c\n\n d  e 12 34's we'll " * 40, "ä ö 漢字 かな é " * 50, "x" * 500, " " * 300, "a \x1cb  c d " * 60])
def test_long_texts_are_cut_where_ids_stay(text):
    codec = plain_encoding()
    assert [i for p in bpe.safe_pieces(text, 7) for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)
    assert "".join(bpe.safe_pieces(text, 7)) == text


def test_bpe_edges(edges):
    found = bpe.decode(bpe.encode(edges)).collect()
    assert len(found) == len(EDGES) and all(bytes(r.decoded).decode() == (r.text or "") for r in found)
    assert bpe.digests(none_of(edges)).count() == 0


# ---- range coder

def test_range_coder_files_round_trip(spark, docs, tmp_path):
    part = docs.where("doc_id < 60")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for r in part.orderBy("doc_id").collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = range_coder.digests(part, str(tmp_path / "files"))
    assert {r.doc_id: tuple(r[1:]) for r in found.collect()} == want


@pytest.mark.parametrize("blocks", [[[2]], [[0, 65535, 50256, 2], [2]], [[7] * 3000, list(range(500)), [1, 2] * 100]])
def test_blocks_round_trip_and_runs_shrink(blocks):
    blocks = [np.array(b) for b in blocks]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(range_coder.encode_blocks([np.full(3000, 7)])[0]) < 200


def test_damaged_blocks_are_noticed():
    row = range_coder.pack(0, 0, [(None, np.array([5, 6, 2])), (3, np.arange(5000))])
    assert [d for d, _ in range_coder.unpack(row)] == [None, 3]
    with pytest.raises(ValueError, match="checksum"):
        range_coder.unpack({**row, "payload": row["payload"][:-1] + bytes([row["payload"][-1] ^ 1])})


def test_range_coder_edges(edges, tmp_path):
    short = edges.where("doc_id IS NULL OR doc_id != 6")
    found = range_coder.digests(short, str(tmp_path / "edges")).orderBy("start").collect()
    assert len(found) == len(EDGES) - 1 and found[0].doc_id is None and found[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))
    assert range_coder.digests(none_of(edges), str(tmp_path / "none")).count() == 0


# ---- surrogates

def test_surrogates_keep_type_and_format():
    text = ("Mail a.b@mail.example.com and A.B@MAIL.EXAMPLE.COM, +1 (743) 555-3824 or (743) 555-3824, 227.5.221.1, 4111 1111 1111 1111, "
            "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\", 123-45-6789, DE89370400440532013000. Mrs. Anna Schmidt. Herr Иван Петров.")
    table = {x[2:4]: surrogates.surrogate(*x[2:5], 0) for x in surrogates.find(text)}
    end, out = 0, []
    for a, b, kind, value, _ in surrogates.find(text):
        out += [text[end:a], surrogates.render(kind, text[a:b], table[kind, value])]
        end = b
    new = "".join([*out, text[end:]])
    assert Counter(x[2] for x in surrogates.find(new)) == Counter(x[2] for x in surrogates.find(text))
    assert not {x[3] for x in surrogates.find(new)} & {x[3] for x in surrogates.find(text)}
    phones = [x[3] for x in surrogates.find(new) if x[2] == "phone"]
    assert len(set(phones)) == 1 and new.count("+1 (") == 1
    card = next(x[3] for x in surrogates.find(new) if x[2] == "card")
    assert card[0] == "4" and surrogates.luhn(card[:-1]) == int(card[-1])
    iban = next(x[3] for x in surrogates.find(new) if x[2] == "iban")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert surrogates.surrogate("name", "anna schmidt", "f", 0).split()[0].endswith("ia")
    assert all("а" <= c <= "я" or c == " " for c in surrogates.surrogate("name", "иван петров", "m", 0))


def test_surrogates_in_documents_are_one_to_one(docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in surrogates.pseudonymize(docs).collect()}
    assert after.keys() == before.keys()
    mapped = {}
    for i, text in before.items():
        old, new = surrogates.find(text), surrogates.find(after[i].text)
        assert after[i].n_entities == len(old) and (old or after[i].text == text)
        assert after[i].n_chars == len(after[i].text)
        if len(old) == len(new):
            for a, b in zip(old, new, strict=True):
                assert a[2] == b[2] and mapped.setdefault(a[2:4], b[3]) == b[3]
    assert len(mapped) > 3 and len({(k[0], v) for k, v in mapped.items()}) == len(mapped)
    assert not {(k[0], v) for k, v in mapped.items()} & set(mapped)


def test_collisions_draw_again(spark):
    """A draw of few values: losers and real values must move on until all differ."""
    entities = spark.createDataFrame([("x", str(i), "") for i in range(5)], "kind string, value string, gender string")
    calls = []

    def draw(open_, attempt, key):
        calls.append(attempt)
        return open_.withColumn("surrogate", F.pmod(F.xxhash64("value", F.lit(attempt)), F.lit(10 if attempt == 0 else 10_000)).cast("string"))

    table = {r.value: r.surrogate for r in surrogates.assign(entities, draw=draw).collect()}
    assert sorted(table) == list("01234") and len(set(table.values()) - set("01234")) == 5 and calls[0] == 0


def test_blank_forms_and_punctuated_values_come_to_an_end(spark):
    """Blanks of a form aren't secrets; values with one or no letter or digit get surrogates although all of their form are taken."""
    forms = ["Name:\nPassword: ________\n\nPassword: ________\n", "token: ..........", "password:==========", "Password:\n\n________"]
    rows = forms + [f"password: _______{d}" for d in range(10)] + ["write to __@-.de", "write to -_@-.de"]
    docs_ = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in surrogates.pseudonymize(docs_).collect()}
    assert all(found[i].text == t and found[i].n_entities == 0 for i, t in enumerate(forms))
    new = [found[i].text for i in range(len(forms), len(rows))]
    assert len(set(new)) == len(new) and not set(new) & set(rows)
    assert [[x[2] for x in surrogates.find(t)] for t in new] == [["secret"]] * 10 + [["email"]] * 2


def test_surrogates_that_run_out_stop_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ROUNDS", 2)
    entities = spark.createDataFrame([("ip", "x", "")], "kind string, value string, gender string")
    with pytest.raises(RuntimeError, match="no free surrogates"):
        surrogates.assign(entities, draw=lambda open_, attempt, key: open_.withColumn("surrogate", F.col("value")))


def test_surrogate_edges(edges):
    found = surrogates.pseudonymize(edges.withColumn("text", F.when(F.col("doc_id") == 5, "write to me@here.org").otherwise(F.col("text"))))
    rows = found.collect()
    assert len(rows) == len(EDGES) and next(r for r in rows if r.doc_id == 1).text is None
    assert "me@here.org" not in {r.text for r in rows} and sum(r.n_entities for r in rows) == 1
    assert surrogates.pseudonymize(none_of(edges)).count() == 0


# ---- licences

def test_licences_equal_brute_force(spark, docs):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = lambda w: {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
    found = {(r.doc_id, r.license) for r in licenses.scan(docs, licenses.templates_of(spark)).collect()}
    exact = set()
    for r in docs.collect():
        w = words(r.text)
        for name, text in licenses.TEMPLATES.items():
            t = words(text)
            if any(w[i:i + len(t)] == t for i in range(len(w))):
                exact.add((r.doc_id, name))
    assert exact <= found and exact
    texts = {r.doc_id: shingles(words(r.text)) for r in docs.collect()}
    for doc, name in found - exact:
        t = shingles(words(licenses.TEMPLATES[name]))
        assert len(t & texts[doc]) >= licenses.CONTAINED * len(t)


def test_edited_notice_at_any_offset(spark):
    notice = licenses.TEMPLATES["mit"].split()
    edited = " ".join([*notice[:12], "changed", *notice[13:]])
    made = spark.createDataFrame([(k, "wort " * k + edited + " ende" * (37 - k)) for k in range(37)], "doc_id long, text string")
    found = licenses.scan(made, licenses.templates_of(spark)).where("license = 'mit'").collect()
    assert len(found) == 37 and all(0.8 <= r.containment < 1 for r in found)


def test_licence_position_is_that_of_the_best_statement(spark):
    notice = licenses.TEMPLATES["mit"].split()
    edited = [*notice[:12], "changed", *notice[13:]]
    rows = [(gap, " ".join([*["wort"] * 30, *edited, *["ende"] * gap, *notice, *["ende"] * 9])) for gap in (40, 200, 213)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.containment, r.first_word) for r in licenses.scan(made, licenses.templates_of(spark)).where("license = 'mit'").collect()}
    assert found == {gap: (1.0, text.split().index("ende") + gap) for gap, text in rows}


def test_licence_edges(spark, edges):
    assert licenses.scan(edges, licenses.templates_of(spark)).count() == 0
    assert licenses.scan(edges, licenses.templates_of(spark, {})).count() == 0
    marked = edges.withColumn("text", F.when(F.col("doc_id").isNull(), "all rights reserved").otherwise(F.col("text")))
    assert [r.doc_id for r in licenses.scan(marked, licenses.templates_of(spark)).collect()] == [None]


# ---- quality rules, chat, decontamination: SQL covers the tables, these the edges

def test_rule_edges(spark, edges):
    labels = spark.createDataFrame([(None, 1), (4, 1), (4, 0), (6, None)], "doc_id long, quality int")
    found = rules.quality_verdicts(edges, labels).collect()
    assert len(found) == len(EDGES)
    long = next(r for r in found if r.doc_id == 6)
    assert long.n_words == 30_000 and long.n_repeat_words == 30_000 and long.base_failed and not long.kept
    assert rules.quality_verdicts(none_of(edges), labels).count() == 0 and rules.quality_verdicts(edges, none_of(labels)).count() == len(EDGES)


def test_binomial_tail_and_certified_cutoffs(spark):
    from math import comb
    cases = [(0, 50), (2, 400), (7, 400), (30, 5000)]
    made = spark.createDataFrame(cases, "k long, n long").withColumn("p", rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in made.collect():
        exact = sum(comb(r.n, j) * 0.01 ** j * 0.99 ** (r.n - j) for j in range(r.k + 1)) if r.k < r.n * 0.01 else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)
    # 2,000 good texts with symbols below 0.1, one of 50 above 0.3: no cutoff under 0.3 may be certified for it.
    base = {r: 0.0 for r in rules.RULES}
    rows = [(i, "en", *({**base, "symbols": 0.35 if i % 50 == 1 else 0.05}.values())) for i in range(2000)]
    found = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in rules.RULES))
    labels = found.select("doc_id", F.lit(1).alias("quality"))
    cut = rules.cutoffs(found, labels).first()
    assert cut.symbols == 0.4 and cut.repeats == min(rules.GRID)
    few = rules.cutoffs(found.where("doc_id < 30"), labels).collect()
    assert not few or few[0].symbols is None


def test_chat_parts_are_whole_and_masks_point_at_turns(spark):
    rows = [(1, i, ("user", "assistant", None)[i % 3], f"t{i}" if i % 5 else None) for i in range(150)] + [(None, None, "user", "x"), (None, None, "user", "x")]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = found.orderBy("conv_id", "perspective", "part").collect()
    assert [(r.perspective, r.part, r.n_turns) for r in parts if r.conv_id == 1] == [(p, k, n) for p in ("assistant", "unknown", "user") for k, n in enumerate((64, 64, 22))]
    spoken = "".join(r.text[s.start:s.end] for r in parts if r.perspective == "assistant" for s in r.mask)
    assert spoken == "".join((t or "") + chat.END for _, _, role, t in rows if role == "assistant")
    assert [r.n_turns for r in parts if r.conv_id is None] == [2]
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_decontamination_edges(spark, edges):
    items = spark.createDataFrame([(1, "same text"), (2, None), (None, "HERE"), (1, "same text"), (3, "wort " * 12)], "item_id long, text string")
    rows = decontaminate.decontaminate(edges, items).collect()
    assert len(rows) == len(EDGES)
    by_text = {r.text: r for r in rows}
    assert (by_text["same text here"].n_hit, by_text["same text here"].n_items) == (3, 1)
    assert by_text[LONG].n_hit == 30_000 and by_text["another text of the same id"].n_hit == 0
    kept = decontaminate.keep_clean(edges, items)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 4
    assert decontaminate.decontaminate(edges, none_of(items)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(none_of(edges), items).count() == 0


# ---- trained models

def made_texts(n, seed, words, marks):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for k in range(n):
        text = [words[i] for i in rng.integers(0, len(words), int(rng.integers(5, 120)))]
        if k % 3 == 0:
            for _ in range(2):
                text[int(rng.integers(0, len(text)))] = marks[int(rng.integers(0, len(marks)))]
        texts.append(" ".join(text))
        labels.append(int(any(m in text for m in marks)))
    return texts, labels


def test_toxicity_learns_marks_and_gradients_are_right():
    words = [f"{a}{b}{c}" for a in "btk" for b in ("ra", "ol", "in") for c in ("x", "ta", "mo", "s")]
    texts, labels = made_texts(240, 1, words, ["grok", "vile"])
    net = toxicity.train(texts, labels)
    held, want = made_texts(120, 2, words, ["grok", "vile"])
    assert np.mean((net.scores(held) >= 0.5) == np.array(want)) > 0.95
    assert ((0 <= net.scores(["", "!!"])) & (net.scores(["", "!!"]) < 0.5)).all()
    y, w = np.array(labels[:4], np.float32), np.full(4, 0.25, np.float32)

    class Still:  # no word is left to the characters
        def random(self, n):
            return np.ones(n)

    def loss():
        words, ids, at, starts, ends, text = net.read(texts[:4])
        logit = net.logits(net.project(words, ids)[1], at, starts, ends)
        odds = np.bincount(text, np.exp(logit.astype(np.float64)), 4)
        return float((w * (np.log1p(odds) - y * np.log(odds))).sum())

    for v in net.p.values():
        v += np.float32(0.01)
    grads = net.gradients(texts[:4], y, w, Still())
    for name in ("out", "state_f", "in_b", "attend"):
        flat, at = net.p[name].reshape(-1), int(np.abs(grads[name]).argmax())
        step, kept = 1e-2, flat[at].item()
        flat[at] = kept + step
        high = loss()
        flat[at] = kept - step
        low = loss()
        flat[at] = kept
        assert (high - low) / (2 * step) == pytest.approx(float(grads[name].reshape(-1)[at]), rel=0.05, abs=2e-4)


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 100):
        starts, text = toxicity.windows_of(np.array([n, 5]))
        seen = {s + k for s, t in zip(starts, text, strict=True) if t == 0 for k in range(toxicity.WINDOW)}
        assert set(range(n)) <= seen and (text == 1).sum() == 1
    words = ["a", "grün", "x" * 40]
    means, bucket, owner = toxicity.trigram_means(words, np.ones((toxicity.BUCKETS, 3), np.float32))
    assert np.allclose(means, 1) and np.bincount(owner).tolist() == [1, 5, 40] and bucket.max() < toxicity.BUCKETS


def test_toxicity_edges(spark, edges):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(edges, none).collect()
    assert len(rows) == len(EDGES) and all(r.score == 0 and r.predicted == 0 for r in rows)
    some = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(edges, some).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id == 5} == {zlib.crc32(b"5") % 5 == 0}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_tables_equal_filters_and_edges(edges):
    net = langid.train(["abc " * 40, "xyz " * 40], ["one", "two"], steps=30)
    windows, owner, size = langid.windows_of([b"hello world " * 30, b""])
    assert size.tolist() == [128, 128, 104, 0] and owner.tolist() == [0, 0, 0, 1]
    for k in langid.WIDTHS:
        places = langid.LENGTH - k + 1
        plain = sum(net.p["bytes"][windows[:, j:j + places]] @ net.p[f"filter_{k}"][j] for j in range(k))
        assert np.allclose(net.sums(np.ascontiguousarray(windows.T), k).transpose(1, 0, 2), plain, atol=1e-4)
    assert net.predict([None, "", "12 !!", "abc"])[0] == ["und", "und", "und", "one"]
    rows = langid.identify(edges).collect()
    assert len(rows) == len(EDGES) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert langid.identify(none_of(edges)).count() == 0


def test_sample_is_bounded_and_takes_copies_once(spark):
    rows = spark.createDataFrame([(1, "same")] * 300 + [(0, f"text {i}") for i in range(300)], "label int, text string")
    found = learning.sample_per_label(learning.keyed_texts(rows, "label"), rows, "label", 20, 100)
    assert Counter(r.label for r in found) == {1: 1, 0: 20}


# ---- pipeline

def test_pipeline_equals_stages_by_hand(spark, docs, monkeypatch):
    net = toxicity.train(*made_texts(60, 3, ["alpha", "beta", "gamma"], ["idiot"]))
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda d, l: net)  # noqa: E741
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in rows.items() if net.scores([t])[0] < 0.5}
    first = {}
    for i, t in sorted(left.items()):
        first.setdefault(t, i)
    group = {t: g for g in near_groups(list(first)) for t in g}
    left = {i: t for i, t in left.items() if i == min(first[u] for u in group.get(t, {t}))}
    hit = decontaminate.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("contaminated")
    left = {i: t for i, t in left.items() if i not in {r.doc_id for r in hit.collect()}}
    assert found.keys() == left.keys()
    clean = [i for i, t in left.items() if not surrogates.find(t)]
    assert all(found[i] == hashlib.sha256(left[i].encode()).hexdigest() for i in clean)
    assert all((found[i] == hashlib.sha256(left[i].encode()).hexdigest()) == (i in clean) for i in left)


def test_stages_return_the_columns_of_documents(spark, edges):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edges, SMALL).columns == edges.columns, name
        assert stage(spark, none_of(edges), SMALL).count() == 0


def test_later_mentions_of_a_name_have_its_surrogate(spark):
    text = "Mr. Jones met Jones. Jones's friend Dr Anna Maria Smith and Anna Maria Smith saw Joneson, and Smith."
    out = surrogates.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = surrogates.find(text)
    assert [text[a:b] for a, b, *_ in found] == ["Jones", "Jones", "Jones", "Anna Maria Smith", "Anna Maria Smith"]
    new = out.text.split()[1]
    assert out.n_entities == 5 and out.text.startswith(f"Mr. {new} met {new}. {new}'s friend Dr ") and "Joneson" in out.text
    assert not any(f in out.text.replace("Joneson", "") for f in ("Jones", "Anna"))


def test_stages_keep_the_values_of_extra_columns(spark):
    """Names that the stages use themselves, a dotted one, and types that can't be hashed."""
    names = ["doc_id", "text", "given", "text_key", "n_entities", "a.b", "score", "__node", "hit_doc", "held_out"]
    rows = [(1, "Write to jane.doe@example.org now", *"abcdefgh", {"k": 1}), (2, "nothing of the kind here", *"stuvwxyz", {"k": 2})]
    made = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names) + ", m map<string,int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, made, SMALL)
        assert out.columns == made.columns, name
        got = {r.doc_id: tuple(r)[2:] for r in out.collect()}
        assert got == {r[0]: r[2:] for r in rows}, name


def test_one_of_many_repeated_rows_stays(spark):
    rows = spark.range(500).select(F.lit(4).cast("long").alias("doc_id"), F.lit("the same row").alias("text"))
    assert [tuple(r) for r in simhash.keep_one(rows).collect()] == [(4, "the same row")]


def test_literal_end_token_gives_its_id_as_the_plain_call_does(spark):
    text = "hi <|endoftext|> there"
    row = range_coder.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 2]
    assert 50256 in ids and (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_very_long_runs_of_blanks_and_line_ends_are_encoded():
    codec = bpe.encoding()
    for middle in (" " * 2_000_000, "\n" * 1_500_000, " \n" * 700_000, "\t " * 600_000):
        text = "Start of it" + middle + "end, and more."
        ids = bpe.encode_text(text, codec)
        assert codec.decode_bytes(ids.tolist()) == text.encode()
    short = "Start of it" + " \n\t  " * 60_000 + "end, and more."  # over the length, and still within the library's reach
    assert len(short) > bpe.LONG and bpe.encode_text(short, codec).tolist() == codec.encode_ordinary(short)


def test_decontamination_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "x", "y"), (2, "none of it", "x", "y")], "doc_id long, text string, hit_doc string, hit_text string")
    items = spark.createDataFrame([("i", "a b c d e f g h i j")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.keep_clean(docs, items).collect()] == [(2, "none of it", "x", "y")]
    found = {r.doc_id: (r.n_hit, r.hit_doc, r.hit_text) for r in decontaminate.decontaminate(docs, items).collect()}
    assert found == {1: (10, "x", "y"), 2: (0, "x", "y")}
