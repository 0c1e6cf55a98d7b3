"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered by how many words hold them, rarest first. Its *prefix* is its three rarest bigrams, and all
that are as common as the third. Its *pivots* are two bigrams of the prefix that don't overlap; dynamic programming picks
the pair of least total rank. One edit can touch only one of them, so a word at distance one still holds
the other, and if that word's prefix reaches at least as far in the order, holds it in its prefix.
So the pivots of one word are looked up in the prefixes of the others, in the direction from the shorter reach.

Position limits: if the edit is behind the first pivot, everything up to that pivot's end is unchanged, else everything from
the second pivot on. A first pivot is thus looked up with the letters before it, a second with those behind it. The rest of
the word holds the edit, in one of its halves, and the other half is unchanged too; it is part of the key, as is the
rest's length in the other word (one less, the same or one more). A key thus fixes the gram's position, the length and over
half of the letters, so common bigrams are rare keys. Pairs are verified by their edit distance inside the
join, so that only pairs at distance one leave it.

Words are counted with partial aggregates; the join works on distinct words only, 12 keys a word against 12 or
a few more. The bigram order is a table of at most ``ALPHABET`` squared rows, the one thing that is sent to tasks. A
form has at least ten times its variant's count, so following forms takes few steps, whose number the largest count bounds.

Defined results: null and empty texts have no words. A null doc_id counts as the empty text in the checksum. Repeated rows
count again. Without words there are no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from .common import LOWER, UPPER, arrow_map, give_back, small_batches

LETTERS, LENGTH, COUNT, TIMES, ONE_IN, ALPHABET = r"A-Za-zÀ-ÿ", 7, 2, 10, 31, 90
PREFIX, GRAM, HELD = 3, 2, 1 << 19
_LOWER = str.maketrans(UPPER, LOWER)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least ``LENGTH`` letters with ``COUNT`` occurrences, after the keyed deletions.

    A task sums its words before they are shuffled, and hands on what it holds at ``HELD`` words.
    """
    runs = re.compile(rf"[{LETTERS}]{{{LENGTH},}}")

    def typed(name: str, run: str) -> str:
        h = zlib.crc32(f"{name}:{run}".encode())
        return run if h % ONE_IN else run[:h % len(run)] + run[h % len(run) + 1:]

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in small_batches(batches):
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for found, n in Counter(runs.findall((text or "").translate(_LOWER))).items():
                    word = typed(name, found)
                    if len(word) >= LENGTH:
                        held[word] += n
            if len(held) > HELD:
                yield flush()
        yield flush()
        give_back()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = arrow_map(named, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


def gram_order(vocabulary: DataFrame) -> dict[str, int]:
    """Rank of each bigram by the number of words' places that hold it; at most ``ALPHABET`` squared entries."""
    grams = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).limit(ALPHABET ** 2 + 1).collect()
    if len(rows) > ALPHABET ** 2:
        raise ValueError("words hold letters outside the alphabet")
    return {r["gram"]: k for k, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def pivots(places: list[tuple[int, int]]) -> tuple[int, int]:
    """The two places that are ``GRAM`` or more apart with the least total rank. ``places``: (place, rank) by place."""
    best, pair, left, free = math.inf, (0, 0), [], (math.inf, 0)
    for place, rank in places:
        while left and left[0][0] + GRAM <= place:  # bigrams that end before this one
            at, r = left.pop(0)
            free = min(free, (r, at))
        if free[0] + rank < best:
            best, pair = free[0] + rank, (free[1], place)
        left.append((place, rank))
    return pair


def _key(side: int, half: int, size: int, head: str, part: str) -> int:
    return xxhash.xxh64_intdigest(f"{head}|{part}", size << 2 | side << 1 | half) - (1 << 63)


def _places(word: str, order: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """(place, rank) of the prefix's bigrams by place, and the rank that it reaches."""
    ranks = [order[word[i:i + GRAM]] for i in range(len(word) - GRAM + 1)]
    reach = sorted(ranks)[PREFIX - 1]
    return [(i, r) for i, r in enumerate(ranks) if r <= reach], reach


def pivot_keys(word: str, places: list[tuple[int, int]]) -> set[int]:
    """Keys of the first pivot and what is before it, and of the second and what is behind it (read backwards)."""
    first, second = pivots(places)
    back, cut, out = word[::-1], len(word) - second, set()
    for side, head, tail in ((0, word[:first + GRAM], word[first + GRAM:]), (1, back[:cut], back[cut:])):
        n = len(tail)
        for size in (n - 1, n, n + 1) if n else (0, 1):  # of the other word's tail
            half = size // 2
            if half <= n:
                out.add(_key(side, 0, size, head, tail[:half]))
            if size - half <= n:
                out.add(_key(side, 1, size, head, tail[n - size + half:]))
    return out


def prefix_keys(word: str, places: list[tuple[int, int]]) -> set[int]:
    """Keys of each bigram of the prefix, from both sides."""
    back, length, out = word[::-1], len(word), set()
    for i, _ in places:
        a, b = i + GRAM, length - i
        m, n = (length - a) // 2, (length - b) // 2
        out |= {_key(0, 0, length - a, word[:a], word[a:a + m]), _key(0, 1, length - a, word[:a], word[a + m:]),
                _key(1, 0, length - b, back[:b], back[b:b + n]), _key(1, 1, length - b, back[:b], back[b + n:])}
    return out


def _keyed(vocabulary: DataFrame, shared, make) -> DataFrame:
    """(word, n, reach, key) for each key that ``make`` gives a word."""
    def run(batches):
        for batch in batches:
            placed = [(w, *_places(w, shared.value)) for w in batch.column("word").to_pylist()]
            keys = [make(w, places) for w, places, _ in placed]
            row = pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(row), batch.column("n").take(row), pa.array([p[2] for p in placed], pa.int32()).take(row),
                                              pa.array([x for k in keys for x in k], pa.int64())], names=["word", "n", "reach", "key"])

    return arrow_map(vocabulary.select("word", "n"), run, "word string, n long, reach int, key long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words at distance one, both ways round. ``vocabulary``: distinct words."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(gram_order(vocabulary))
    x, y = _keyed(vocabulary, shared, pivot_keys).alias("x"), _keyed(vocabulary, shared, prefix_keys).alias("y")
    like = "x.key = y.key AND x.reach <= y.reach AND x.word <> y.word AND levenshtein(x.word, y.word, 1) = 1"
    met = x.join(y, F.expr(like)).select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return met.select(both.alias("p")).select("p.*").distinct()


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) for words with a form: their forms followed to the end, twice as far each time."""
    now = forms.select("word", F.col("form").alias("root"))
    steps = math.log(max(largest, 1), TIMES) + 1
    for _ in range(math.ceil(math.log2(steps)) + 1):
        now = staged(now, "roots")
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def variants(docs: DataFrame) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    vocabulary = staged(words(docs), "words")
    near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near", "near_n")).alias("most"))
    is_form = F.col("most.near_n") >= TIMES * F.col("n")
    judged = staged(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(is_form, F.col("most.near")).alias("form"), F.when(is_form, F.col("most.near_n")).alias("form_n")), "forms")
    roots = _roots(judged.where("form IS NOT NULL"), vocabulary.agg(F.max("n")).first()[0] or 1)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
