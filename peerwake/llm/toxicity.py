"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (letters and digits, lower-cased) are cut into overlapping windows of ``WINDOW``
words, ``STRIDE`` apart, to its end. A word's input is the embedding of its number in the training
vocabulary joined with the mean embedding of its hashed character trigrams. Two GRUs read a window
in both directions, attention weighs their states, and a linear layer gives the window's logit. A
text's odds are the sum of its windows' odds, so one clear window is enough.

Training takes at most ``PER_LABEL`` labelled rows of each class (a bounded, documented sample)
whose crc32(doc_id) mod 5 isn't 0. The loss is that of whole texts, so no window needs a label.
Everything else (scoring) covers all rows and whole texts: one Arrow map without a shuffle, windows
in blocks of ``CHUNK``. The model, well under a megabyte, travels with the tasks.

Defined results: null, empty and wordless texts are scored as one empty window. Without labelled
rows of both classes every score is the share of toxic labels (0 without any) cut to below 0.5.
Labels that contradict each other for one doc_id count as toxic. A null doc_id counts as the empty
id for the split, so it is held out. Repeated rows stay.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, small_batches
from .learning import Adam, keyed_texts, remainder, sample_per_label, summed_rows

WINDOW, STRIDE, CHUNK = 32, 16, 2048
HIDDEN, WORD, CHARS, BUCKETS, VOCABULARY = 8, 8, 8, 4096, 8192
PER_LABEL, MAX_CHARS, EPOCHS, STEPS = 1500, 8_000, 5, 500
TOKEN = re.compile(r"[^\W_]+")


def trigram_means(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean embedding of each word's byte trigrams (with both ends marked), the buckets and their words."""
    coded = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D))
    bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64) % BUCKETS
    inside = np.ones(len(raw), bool)
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that start here leave the word
    bucket = bucket[inside[:-2]]
    counts = sizes - 2
    starts = np.cumsum(counts) - counts
    means = np.add.reduceat(table[bucket], starts, axis=0) / counts[:, None].astype(np.float32)
    return means, bucket, np.repeat(np.arange(len(words)), counts)


def windows_of(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words laid end to end: each window's first word, and its text's row."""
    counts = np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n_words)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.cumsum(n_words) - n_words)[text] + within * STRIDE, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary, self.constant = vocabulary, None
        self.p = {"words": 0.1 * rng.standard_normal((len(vocabulary) + 1, WORD)).astype(np.float32),
                  "chars": 0.1 * rng.standard_normal((BUCKETS, CHARS)).astype(np.float32),
                  "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.array([-1.0], np.float32)}
        for d in ("f", "b"):
            self.p |= {f"in_{d}": draw(WORD + CHARS, 3 * HIDDEN), f"in_bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"state_{d}": draw(HIDDEN, 3 * HIDDEN)}

    # Words of a batch of texts, each distinct word once.
    def read(self, texts: list[str], rng: np.random.Generator | None = None):
        index: dict[str, int] = {}
        at, n_words = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = TOKEN.findall(text.lower())
            n_words[k] = len(words)
            at += [index.setdefault(w, len(index)) for w in words]
        words = list(index) or ["-"]  # masked everywhere, but lookups need one word
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if rng is not None:
            ids[rng.random(len(ids)) < 0.1] = 0  # some known words are left to the characters
        starts, text = windows_of(n_words)
        ends = np.cumsum(n_words)[text]
        return words, ids, np.array([*at, 0], np.int64), starts, ends, text

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each step; x: steps, windows, 3 gates; in reading order."""
        steps, n, _ = x.shape
        h, weights, out = np.zeros((n, HIDDEN), np.float32), self.p[f"state_{d}"], np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            g = h @ weights
            gates = _sigmoid(x[t, :, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            after = new + z * (h - new)
            if keep is not None:
                keep.append((h, z, r, new, g[:, 2 * HIDDEN:]))
            h = np.where(mask[t][:, None], after, h)
            out[t] = h
        return out

    def logits(self, projected: dict[str, np.ndarray], at: np.ndarray, starts: np.ndarray, ends: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logit of each window; ``tape`` receives what the gradient needs."""
        place = starts[None, :] + np.arange(WINDOW)[:, None]
        mask = place < ends[None, :]
        index = at[np.where(mask, place, len(at) - 1)]
        both = []
        for d in ("f", "b"):
            order = slice(None) if d == "f" else slice(None, None, -1)
            keep = [] if tape is not None else None
            both.append(self.states(projected[d][index[order]], mask[order], d, keep)[order])
            if tape is not None:
                tape[d] = keep
        h = np.concatenate(both, axis=2)
        weight = np.where(mask, h @ self.p["attend"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tnh,tn->nh", h, weight)
        if tape is not None:
            tape |= {"index": index, "mask": mask, "h": h, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def project(self, words: list[str], ids: np.ndarray):
        means, bucket, owner = trigram_means(words, self.p["chars"])
        x = np.concatenate([self.p["words"][ids], means], axis=1)
        return x, {d: x @ self.p[f"in_{d}"] + self.p[f"in_bias_{d}"] for d in ("f", "b")}, bucket, owner

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        words, ids, at, starts, ends, text = self.read(texts)
        _, projected, _, _ = self.project(words, ids)
        odds = np.zeros(len(texts))
        for k in range(0, len(starts), CHUNK):
            part = slice(k, k + CHUNK)
            odds += np.bincount(text[part], np.exp(self.logits(projected, at, starts[part], ends[part]).astype(np.float64)), len(texts))
        return odds / (1 + odds)

    def gradients(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        words, ids, at, starts, ends, text = self.read(texts, rng)
        x, projected, bucket, owner = self.project(words, ids)
        tape: dict = {}
        logit = self.logits(projected, at, starts, ends, tape)
        top = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(top, text, logit)
        soft = np.exp(logit - top[text])
        total = np.bincount(text, soft, len(texts))
        whole = top + np.log(total)
        d_logit = ((_sigmoid(whole) - labels) * weights)[text] * soft / total[text]
        d_logit = d_logit.astype(np.float32)
        h, weight, pooled, mask, p = tape["h"], tape["weight"], tape["pooled"], tape["mask"], self.p
        out = {"bias": np.array([d_logit.sum()], np.float32), "out": d_logit @ pooled}
        d_pooled = d_logit[:, None] * p["out"]
        d_score = weight * (np.einsum("tnh,nh->tn", h, d_pooled) - (d_pooled * pooled).sum(axis=1))
        out["attend"] = np.einsum("tn,tnh->h", d_score, h)
        d_h = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            order = slice(None) if d == "f" else slice(None, None, -1)
            own, seen, state = d_h[order][:, :, part], mask[order], p[f"state_{d}"]
            carried, d_state = np.zeros_like(own[0]), np.zeros_like(state)
            d_in = np.empty((WINDOW, len(starts), 3 * HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1):
                before, z, r, new, g = tape[d][t]
                dh, m = carried + own[t], seen[t][:, None]
                d_new = dh * (1 - z) * (1 - new * new) * m
                d_z, d_r = dh * (before - new) * z * (1 - z) * m, d_new * g * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_state += before.T @ d_g
                carried = np.where(m, dh * z, dh) + d_g @ state.T
            rows = summed_rows(tape["index"][order].ravel(), d_in.reshape(-1, 3 * HIDDEN), len(words))
            out |= {f"state_{d}": d_state, f"in_{d}": x.T @ rows, f"in_bias_{d}": rows.sum(axis=0)}
            d_x += rows @ p[f"in_{d}"].T
        out["words"] = summed_rows(ids, d_x[:, :WORD], len(p["words"]))
        sizes = np.bincount(owner, minlength=len(words)).astype(np.float32)
        out["chars"] = summed_rows(bucket, (d_x[:, WORD:] / sizes[:, None])[owner], BUCKETS)
        return out


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    seen = Counter(w for t in texts for w in set(TOKEN.findall(t.lower())))
    common = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network({w: k + 1 for k, w in enumerate(common)}, seed)
    y = np.array(toxic, np.float32)
    if not 0 < y.sum() < len(y):
        net.constant = min(float(y.mean()) if len(y) else 0.0, 0.49)
        return net
    weights = np.where(y > 0, 0.25 / y.mean(), 0.75 / (1 - y.mean())).astype(np.float32)  # clean texts count for more
    rng, adam = np.random.default_rng(seed), Adam(net.p, 0.01, 1e-3)
    epochs = max(epochs, min(60, STEPS * 32 // len(y)))
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(y))
        for k in range(0, len(order), 32):
            rows = order[k:k + 32]
            grads = net.gradients([texts[i] for i in rows], y[rows], weights[rows] / len(rows), rng)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            adam.step({n: g * min(1.0, 2.0 / (norm + 1e-9)) for n, g in grads.items()})
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network:
    """Train on a bounded sample of labelled rows that aren't held out."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keys = keyed_texts(docs.where(remainder(F.col("doc_id"), 5) != 0), "doc_id").join(marked, "doc_id")
    sample = sample_per_label(keys, docs, "toxic", per_label, MAX_CHARS)
    return train([r["text"] for r in sample], [int(r["label"] > 0) for r in sample])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), from the text alone."""
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        for batch in small_batches(batches, rows=256, size=1 << 20):
            found = net.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.float64())], names=[*kept, "score"])

    return arrow_map(docs.select(*kept), run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
