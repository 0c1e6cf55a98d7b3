"""What the trained models share: Adam, and the bounded labelled sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LABELS = 1000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def keyed_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns with each text's hash and length in place of the text."""
    return docs.select(*columns, F.xxhash64("text").alias("order"), F.length("text").alias("size"))


def sample_per_label(keys: DataFrame, docs: DataFrame, label: str, per_label: int, max_chars: int) -> list:
    """(label, text, order) of at most ``per_label`` texts of each label, to the driver: the first by hash of the text.

    ``keys`` has label, order and size (see keyed_texts), so texts aren't moved to be chosen; the chosen
    hashes, at most LABELS x per_label, are broadcast to fetch them. Texts above ``max_chars`` characters
    aren't taught from (they are scored like any other). The hash is the order, so that the sample is
    the same on every run and layout. At most ``LABELS`` labels are taught, the largest.
    """
    fit = keys.where(F.col("size").between(1, max_chars)).select(label, "order")
    sizes = fit.groupBy(label).agg(F.approx_count_distinct("order").alias("n")).orderBy(F.desc("n")).limit(LABELS)
    # A bound on the hash leaves the wanted rows and some slack for each label; only those are ranked, copies once.
    share = F.least(F.lit(1.0), (F.lit(float(per_label)) * 1.2 + 8 * F.sqrt(F.lit(float(per_label))) + 50) / F.col("n"))
    near = fit.join(F.broadcast(sizes), label).where(F.pmod("order", F.lit(1 << 30)) <= share * float(1 << 30)).select(label, "order").distinct()
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(F.pmod("order", F.lit(1 << 30)), "order")))
    chosen = ranked.where(F.col("k") <= per_label).select(F.col(label).alias("label"), F.col("order").alias("chosen"))
    found = docs.select("text", F.xxhash64("text").alias("order")).join(F.broadcast(chosen), F.col("order") == F.col("chosen"))
    return sorted(found.groupBy("label", "order").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["order"], str(r["label"])))


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = parameters, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * self.decay * self.p[k]


def summed_rows(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the rows of ``values`` for each index."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        sorted_index = index[order]
        first = np.flatnonzero(np.r_[True, sorted_index[1:] != sorted_index[:-1]])
        out[sorted_index[first]] = np.add.reduceat(values[order], first, axis=0)
    return out
