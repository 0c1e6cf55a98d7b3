"""Benchmark decontamination by a prefix-filtered set join, with built-in functions only.

An item gives windows of ``WINDOW`` consecutive words (a shorter item gives one window). A
window can only occur in a document that holds all of its shingles, so looking for one of
them is enough: its rarest in the corpus, with the offset it has in the window.

1. One pass counts the benchmark's shingles in the corpus. A window with an unseen shingle
   occurs nowhere and needs no join.
2. A second pass joins document shingles to these prefixes. The offset gives the start of
   the window in the document; it must lie in the document (positional and length bound),
   and its words must equal the window's.
3. Hits are merged to spans for each document and joined back.

Windows are broadcast in blocks of at most ``BLOCK`` rows, so that what is broadcast is bounded
however large the benchmark; each block is one more pass. Hot passages cost one row for each
occurrence. Common shingles are never join keys unless all of a window's shingles are common.

Defined results: null or empty texts have no words, no hits and no items (``items_sha256`` of
the empty text). A null item_id marks words as hit but isn't listed. Rows that repeat doc_id and
text get equal results each; equal doc_ids with other texts are kept apart. An empty benchmark
leaves all documents clean. Further columns are kept unless they bear a result's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from .common import NOT_WORD_ANY_CASE, pieces, words_of

WINDOW, SHINGLE, BLOCK = 10, 3, 200_000
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _shingle(words: Column, at, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, key, words): each item's windows; ``key`` is the words joined by spaces."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all_words"))
    last = F.greatest(F.size("all_words") - window, F.lit(0))
    cut = items.where(F.size("all_words") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("words", F.slice("all_words", F.col("at") + 1, window))
    return cut.select("item_id", F.array_join("words", " ").alias("key"), "words").distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(key, size, shingle, at): shingles of SHINGLE words, or of all words of a shorter window."""
    sized = windows.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at")
    by_size = reduce(lambda rest, k: F.when(F.col("size") == k, _shingle(F.col("words"), F.col("at"), k)).otherwise(rest),
                     range(1, SHINGLE), _shingle(F.col("words"), F.col("at"), SHINGLE))
    return sized.select("key", "words", "size", at).withColumn("shingle", by_size)


def _document_shingles(docs: DataFrame, sizes: list[int], *columns: str) -> DataFrame:
    """A row for each word position and shingle size, made inside one generated loop."""
    positions = docs.select(*columns, "words", F.posexplode("words").alias("position", "word"))
    if len(sizes) == 1:
        return positions.withColumn("shingle", _shingle(F.col("words"), F.col("position"), sizes[0]))
    made = F.array(*[_shingle(F.col("words"), F.col("position"), k) for k in sizes])
    return positions.withColumn("shingle", F.explode(made))


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    n = -(-df.count() // BLOCK)
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_id, start, end, key): every occurrence of a window in a document."""
    distinct = windows.select("key", "words").distinct()
    shingles = staged(_window_shingles(distinct), "windows")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most SHINGLE values
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_id"), words_of(F.col("text")).alias("words"))
    empty = worded.select("doc_id", "text_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("key")).limit(0)
    if not sizes:
        return empty
    wanted = _blocks(shingles.select("shingle").distinct(), "shingle")
    seen = [_document_shingles(worded, sizes).join(block, "shingle").groupBy("shingle").agg(F.count("*").alias("n")) for block in wanted]
    counts = reduce(DataFrame.unionAll, seen)
    ranked = (shingles.join(counts, "shingle", "left")
              .groupBy("key").agg(F.first("words").alias("window"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("rarest")))
    prefixes = staged(ranked.where("rarest.n > 0").select("key", "window", "rarest.shingle", "rarest.at"), "prefixes")
    found = []
    for block in _blocks(prefixes, "key"):
        joined = _document_shingles(worded, sizes, "doc_id", "text_id").join(block, "shingle")
        start = F.col("position") - F.col("at")
        inside = (start >= 0) & (start + F.size("window") <= F.size("words"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
        found.append(joined.where(inside).where(same).select("doc_id", "text_id", start.alias("start"), (start + F.size("window")).alias("end"), "key"))
    return reduce(DataFrame.unionAll, found).distinct() if found else empty


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["reach"]), F.lit(0))).alias("n"),
                                   F.greatest(acc["reach"], x["end"]).alias("reach"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with word and hit counts, the items that occur in them, and ``contaminated``."""
    windows = staged(benchmark_windows(benchmark, window), "item-windows")
    hits = staged(find_windows(docs, windows), "hits")
    spans = hits.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    items = (hits.select("doc_id", "text_id", "key").distinct().join(windows.select("key", "item_id"), "key")
             .select("doc_id", "text_id", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("item")).alias("items")))
    per_doc = (spans.alias("s").join(items.alias("i"), F.expr("s.doc_id <=> i.doc_id AND s.text_id = i.text_id"))
               .select("s.doc_id", "s.text_id", _covered(F.col("s.spans")).cast("long").alias("n_hit"), "i.items"))
    per_doc = per_doc.toDF("__hit_doc", "__hit_text", "__n_hit", "__items")
    base = docs.drop(*RESULTS).withColumns({"__text_id": F.xxhash64("text"), "n_words": F.size(pieces(F.col("text"), NOT_WORD_ANY_CASE)).cast("long")})
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__hit_doc")) & (F.col("__text_id") == F.col("__hit_text")), "left")
    n_hit, listed = F.coalesce("__n_hit", F.lit(0)), F.coalesce("__items", F.array().cast("array<string>"))
    return joined.select(*base.drop("__text_id").columns, n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                         F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without a benchmark window, with their columns as they were."""
    windows = staged(benchmark_windows(benchmark, window), "item-windows")
    hit = staged(find_windows(docs, windows).select("doc_id", "text_id").distinct(), "hit-documents")
    gone = hit.toDF("__hit_doc", "__hit_text")
    own = docs.withColumn("__text_id", F.xxhash64("text"))
    return own.join(gone, F.col("doc_id").eqNullSafe(F.col("__hit_doc")) & (F.col("__text_id") == F.col("__hit_text")), "left_anti").drop("__text_id")
