"""Byte-level BPE with the tiktoken library and a local rank file.

Texts above ``PIECE`` characters are cut before a single space between two letters. The
pre-splitting pattern always starts a new match there, so the ids are those of the whole
text while each call stays short. A part that has no such place for over ``LONG`` characters (runs of blanks, say, on which the
library's own splitter gives up) is split by the pattern here, and each match is encoded alone. Decoding joins the tokens' bytes and needs no valid UTF-8.

Both directions are Arrow maps: no shuffle, a few megabytes of text in memory at a time, and
a lost task is simply run again. Null text is encoded as the empty text (no ids, no bytes).
Further columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, small_batches

RANKS = "byte_bpe_50k.tiktoken"
PIECE, LONG = 1 << 16, 1 << 18


@lru_cache(maxsize=4)
def encoding(name: str = RANKS) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """Parts of at least ``size`` characters (but the last) whose ids, joined, are those of the text."""
    boundary, out, start = regex.compile(r"(?<=\p{L}) (?=\p{L})"), [], 0
    while len(text) - start > size and (cut := boundary.search(text, start + size)):
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def _encode_part(part: str, codec: tiktoken.Encoding) -> np.ndarray:
    if len(part) <= LONG:
        return np.asarray(codec.encode_to_numpy(part, disallowed_special=()), dtype=np.int32)
    matches = regex.finditer(public_tokenizers.PATTERN, part)
    return np.fromiter((i for m in matches for i in codec._encode_single_piece(m.group().encode("utf-8"))), np.int32)


def encode_text(text: str, codec: tiktoken.Encoding) -> np.ndarray:
    parts = [_encode_part(p, codec) for p in safe_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _mapped(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, make, source: str) -> DataFrame:
    """``df`` with column ``name`` made from batches of column ``source``."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind, False)])

    def run(batches):
        for batch in make.cut(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], make(batch.column(source))], names=[*kept, name])

    return arrow_map(df.select(*dict.fromkeys([*kept, source])), run, schema)


class _Encode:
    def __init__(self, ranks: str):
        self.ranks = ranks

    def cut(self, batches):
        return small_batches(batches, "text")

    def __call__(self, texts: pa.Array) -> pa.Array:
        codec = encoding(self.ranks)
        ids = [encode_text(t or "", codec) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


class _Decode:
    def __init__(self, ranks: str):
        self.ranks = ranks

    def cut(self, batches):
        for batch in batches:
            yield from (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))

    def __call__(self, ids: pa.Array) -> pa.Array:
        codec = encoding(self.ranks)
        return pa.array([codec.decode_bytes(x or []) for x in ids.to_pylist()], pa.binary())


def encode(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Add ``ids``, the token ids of ``text``."""
    return _mapped(df, "ids", T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32()), _Encode(ranks), "text")


def decode(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for."""
    return _mapped(df, "decoded", T.BinaryType(), pa.binary(), _Decode(ranks), "ids")


def digests(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Encode and decode whole texts and return counts and digests for each document."""
    both = decode(encode(df.select("doc_id", "text"), ranks).drop("text"), ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
