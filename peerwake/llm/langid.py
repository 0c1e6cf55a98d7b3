"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of ``LENGTH`` bytes, the last one padded. Filters over 2,
3 and 4 embedded bytes are pooled by their maximum over the window; a linear layer and a softmax
give the window's languages. A text's language has the largest mean probability over all windows,
weighted by their bytes; that mean is the score. For scoring, embedding and filters are folded
into tables over byte pairs, which gives the same sums without multiplying.

Training takes at most ``PER_LABEL`` texts of each language (a bounded, documented sample) whose
crc32(doc_id) mod 3 isn't 1. Scoring covers all rows and whole texts in one Arrow map.

Defined results: null text and text without a letter is ``und`` with score 0. Without labelled
rows all is ``und``. A null doc_id counts as the empty id for the split. Repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, small_batches
from .learning import Adam, keyed_texts, remainder, sample_per_label, summed_rows

LENGTH, EMBED, FILTERS, WIDTHS, CHUNK = 128, 6, 8, (2, 3, 4), 512
PER_LABEL, MAX_CHARS, STEPS, BATCH = 400, 4_000, 600, 256
LETTER = regex.compile(r"\p{L}")


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded windows, the text each belongs to, and how many bytes it holds."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // LENGTH))
    out = np.zeros(int(counts.sum()) * LENGTH, np.uint8)
    first = (np.cumsum(counts) - counts) * LENGTH
    for start, text in zip(first.tolist(), texts, strict=True):
        out[start:start + len(text)] = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - first[owner] // LENGTH
    return out.reshape(-1, LENGTH), owner, np.clip(sizes[owner] - within * LENGTH, 0, LENGTH)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"bytes": rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5,
                  "out": rng.standard_normal((len(WIDTHS) * FILTERS, max(1, len(languages)))).astype(np.float32) * 0.2,
                  "bias": np.zeros(max(1, len(languages)), np.float32)}
        for k in WIDTHS:
            self.p |= {f"filter_{k}": rng.standard_normal((k, EMBED, FILTERS)).astype(np.float32) / np.sqrt(k * EMBED),
                       f"shift_{k}": np.zeros(FILTERS, np.float32)}

    def tables(self) -> dict:
        """Filter sums by byte (odd widths) and by byte pair."""
        if not hasattr(self, "_tables"):
            single = {k: [self.p["bytes"] @ self.p[f"filter_{k}"][j] for j in range(k)] for k in WIDTHS}
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            self._tables = {k: ([pair(t[j], t[j + 1]) for j in range(0, k - 1, 2)], t[k - 1] if k % 2 else None) for k, t in single.items()}
        return self._tables

    def sums(self, windows: np.ndarray, k: int) -> np.ndarray:
        """Filter sums of width k; the windows' bytes come as rows, so that the maximum runs over whole rows."""
        pairs, last = self.tables()[k]
        places = LENGTH - k + 1
        joined = windows[:-1].astype(np.int32) * 256 + windows[1:]
        total = pairs[0][joined[:places]]
        for j, t in enumerate(pairs[1:], 1):
            total += t[joined[2 * j:2 * j + places]]
        if last is not None:
            total += last[windows[k - 1:k - 1 + places]]
        return total

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        across = np.ascontiguousarray(windows.T)
        pooled = np.concatenate([np.maximum(self.sums(across, k).max(axis=0) + self.p[f"shift_{k}"], 0) for k in WIDTHS], axis=1)
        logits = pooled @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, n, tape, pooled = self.p, len(windows), {}, []
        embedded = p["bytes"][windows]
        for k in WIDTHS:
            places = LENGTH - k + 1
            total = sum(embedded[:, j:j + places] @ p[f"filter_{k}"][j] for j in range(k))
            best = total.argmax(axis=1)
            top = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0] + p[f"shift_{k}"]
            tape[k] = best, top > 0
            pooled.append(np.maximum(top, 0))
        joined = np.concatenate(pooled, axis=1)
        logits = joined @ p["out"] + p["bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(n), label] -= 1
        d /= n
        out = {"out": joined.T @ d, "bias": d.sum(axis=0)}
        d_pooled, d_bytes = d @ p["out"].T, np.zeros_like(p["bytes"])
        for i, k in enumerate(WIDTHS):
            best, alive = tape[k]
            own = d_pooled[:, i * FILTERS:(i + 1) * FILTERS] * alive
            out[f"shift_{k}"] = own.sum(axis=0)
            d_filter = np.empty_like(p[f"filter_{k}"])
            for j in range(k):
                seen = np.take_along_axis(windows, best + j, axis=1)  # bytes under each filter's best place
                d_filter[j] = np.einsum("nfe,nf->ef", p["bytes"][seen], own)
                spread = own[:, :, None] * p[f"filter_{k}"][j].T[None]
                d_bytes += summed_rows(seen.ravel().astype(np.int64), spread.reshape(-1, EMBED), 256)
            out[f"filter_{k}"] = d_filter
        return out | {"bytes": d_bytes}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        if known:
            windows, owner, size = windows_of([texts[i].encode("utf-8", "surrogatepass") for i in known])
            total = np.zeros((len(known), len(self.languages)))
            for k in range(0, len(windows), CHUNK):
                part = slice(k, k + CHUNK)
                np.add.at(total, owner[part], self.probabilities(windows[part]) * size[part, None])
            total /= total.sum(axis=1, keepdims=True)
            for row, i in enumerate(known):
                best = int(total[row].argmax())
                names[i], score[i] = self.languages[best], total[row, best]
        return names, score


def train(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 11) -> Network:
    names = sorted(set(languages))
    net = Network(names, seed)
    if len(names) < 2:
        return net
    windows, owner, _ = windows_of([t.encode("utf-8", "surrogatepass") for t in texts])
    label = np.array([names.index(x) for x in languages])[owner]
    rows = [np.flatnonzero(label == k) for k in range(len(names))]
    rng, adam = np.random.default_rng(seed), Adam(net.p, 0.01, 1e-4)
    for step in range(steps):
        adam.rate = 0.01 * (1 - 0.9 * step / steps)
        pick = np.array([rng.choice(rows[k]) for k in rng.integers(0, len(names), BATCH)])  # languages in equal parts
        adam.step(net.gradients(windows[pick], label[pick]))
    return net


def fit(docs: DataFrame, per_label: int = PER_LABEL) -> Network:
    keys = keyed_texts(docs.where("lang IS NOT NULL").where(remainder(F.col("doc_id"), 3) != 1), "lang")
    sample = [r for r in sample_per_label(keys, docs, "lang", per_label, MAX_CHARS) if LETTER.search(r["text"])]
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        for batch in small_batches(batches, size=1 << 20):
            names, score = net.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             names=[*kept, "lang_pred", "score"])

    return arrow_map(docs.select(*kept), run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
