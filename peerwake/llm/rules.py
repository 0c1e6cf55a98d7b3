"""Quality rules with risk-controlled cutoffs, with built-in functions only.

A rule rejects a text whose share of something (symbols, capitals, shouted words, repeated
lines, repeated words) is above a cutoff. Cutoffs come from labelled documents of good quality:
for each stratum (language) and rule, a fixed grid is walked from lenient to strict. A cutoff
with k of n good documents rejected is certified while P(Binomial(n, RISK/rules) <= k) is at
most ``DELTA`` divided by the number of (stratum, rule) families: an exact one-sided bound, with
fixed-sequence testing inside a family and Bonferroni over families. The strictest certified
cutoff counts. With probability 1 - ``DELTA`` no stratum rejects over ``RISK`` of its good
documents by all rules together. A stratum with too few labels gets no cutoff and rejects nothing.
Calibration uses labelled rows whose doc_id is no multiple of 5; the others stay for an audit.

Word windows are compared inside a row by their 64-bit hashes, in sorted order, so a long text
costs n log n and no shuffle. Features are written once; calibration and verdict both read them.
Cutoffs are one row for each stratum and are broadcast only if a count shows at most
``BROADCAST`` of them; otherwise they are joined by shuffle.

Defined results: null and empty texts have no words and fail the base. A null lang is a stratum
of its own. Labels that contradict each other for one doc_id count as bad quality. Repeated rows
stay and further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from .common import SPACES, let, pieces

WINDOW, RISK, DELTA, BROADCAST = 8, 0.05, 0.05, 10_000
RULES = ("symbols", "capitals", "shouts", "dup_lines", "repeats")
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the array."""
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                    lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def positions(ordered: Column) -> Column:
        twin = lambda s, j: F.when((s["h"] == F.get(ordered, j - 1)["h"]) | (s["h"] == F.get(ordered, j + 1)["h"]), s["i"])
        return F.sort_array(F.array_compact(F.transform(ordered, twin)))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, positions), covered))

    return let(hashes, count)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, base counts and the rules' shares of every whole text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.col("lang").alias("stratum"), pieces(F.col("text"), SPACES).alias("words"),
                        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
                        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_capitals"),
                        F.length(F.regexp_replace(text, r"[^!]+", "")).alias("n_shouts"))
    counted = split.select("doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
                           F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
                           (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                           repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), F.size("lines").alias("n_lines"), "n_capitals", "n_shouts")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                          share("n_symbols", "word_chars").alias("symbols"), share("n_capitals", "word_chars").alias("capitals"),
                          share("n_shouts", "n_words").alias("shouts"), share("n_dup_lines", "n_lines").alias("dup_lines"),
                          share("n_repeat_words", "n_words").alias("repeats"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10; the error is below 1e-12 of the value."""
    z = n.cast("double") + 11
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = F.lit(1.0)
    for k in range(1, 11):
        product = product * (n.cast("double") + k)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), for k below the mean; 1 otherwise.

    The terms are summed downward from k; those over 50 standard deviations away are below rounding.
    """
    head = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(50 * F.sqrt(n.cast("double"))) + 50).cast("long"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    total = F.aggregate(steps, start, lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"),
                        (acc["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term")), lambda acc: acc["sum"])
    return F.when(k < n * p, head * total).otherwise(F.lit(1.0))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one column for each rule): the strictest certified cutoff, null where there is none."""
    quality = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = quality.where("quality = 1").where("pmod(doc_id, 5) != 0").select("doc_id")
    over = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)]
    counts = found.join(good, "doc_id", "left_semi").groupBy("stratum").agg(F.count("*").alias("n"), *over)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(GRID)])
    families = counts.agg((F.count("*") * len(RULES)).alias("families"))
    tests = (counts.select("stratum", "n", F.explode(cells).alias("cell")).select("stratum", "n", "cell.*")
             .withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES))).crossJoin(families))
    failed_at = tests.groupBy("stratum", "rule").agg(F.max(F.when(F.col("p") > delta / F.col("families"), F.col("cutoff"))).alias("stop"))
    certified = (tests.join(failed_at.withColumnRenamed("stratum", "s").withColumnRenamed("rule", "r"), F.expr("stratum <=> s AND rule = r"))
                 .where("stop IS NULL OR cutoff > stop"))
    return certified.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, the verdict and which rule rejected, for every document."""
    found = staged(features(docs), "quality-features")
    limits = staged(cutoffs(found, labels), "quality-cutoffs")
    limits = limits.select(F.col("stratum").alias("s"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    if limits.count() <= BROADCAST:
        limits = F.broadcast(limits)
    judged = found.join(limits, F.col("stratum").eqNullSafe(F.col("s")), "left")
    rejected = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size(rejected) == 0)).alias("kept"), F.array_join(rejected, ",").alias("rejected_by"))
