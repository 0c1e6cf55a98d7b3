"""Bloom filters kept as a table of blocks, built and tested where the rows are.

A 64-bit key belongs to one block of ``BLOCK_BITS`` bits by its upper bits and sets ``PROBES`` bits there by
its lower ones. Tasks send each block the distinct keys they hold, packed (a key that fills a third of the
table costs a row a task); one group a block then tests and inserts them. So neither the number of
keys nor a hot key lets a group grow beyond a block's share. A filter has at most ``MAX_BLOCKS``
blocks (64 MB), which bounds what is broadcast; more keys than it has room for only let more of the others
pass. Filters never decide: what passes is compared exactly by the caller.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BLOCK_BITS, PROBES, BITS_PER_KEY, MAX_BLOCKS, HELD = 1 << 17, 5, 12, 4096, 1 << 21


def blocks_for(keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-keys * BITS_PER_KEY // BLOCK_BITS)))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 34), F.lit(blocks)).cast("int")


def _probes(key: Column) -> list[Column]:
    start, step = key.bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(key, 17).bitwiseAND(BLOCK_BITS - 1).bitwiseOR(1)
    return [(start + i * step).bitwiseAND(BLOCK_BITS - 1) for i in range(PROBES)]


def passes(key: Column, bits: Column) -> Column:
    """Whether all bits of ``key`` are set in its block's ``bits``."""
    one = lambda at: F.call_function("shiftright", F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return reduce(lambda x, y: x & y, map(one, _probes(key)))


def probes(keys: np.ndarray) -> np.ndarray:
    """Bit numbers in the block, a row for each key."""
    mask = np.uint64(BLOCK_BITS - 1)
    start, step = keys & mask, (keys >> np.uint64(17)) & mask | np.uint64(1)
    return ((start[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & mask).astype(np.int64)


def numpy_block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(34)) % np.uint64(blocks)).astype(np.int64)


class Keys:
    """A whole filter in one array, for tests inside Python tasks."""

    def __init__(self, rows: list, blocks: int):
        self.blocks, self.bits = blocks, np.zeros((blocks, BLOCK_BITS // 64), np.int64)
        for block, bits in rows:
            self.bits[block] = bits

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = probes(keys)
        found = self.bits.view(np.uint64)[numpy_block_of(keys, self.blocks)[:, None], at >> 6] >> (at & 63).astype(np.uint64)
        return (found & np.uint64(1)).all(axis=1)


def _packed(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, once, more): the keys of a task that lie in a block, and those it holds more than once."""
    def cut(held: list[np.ndarray]):
        found, n = np.unique(np.concatenate(held), return_counts=True)
        block = numpy_block_of(found, blocks)
        order = np.argsort(block, kind="stable")
        found, n, block = found[order], n[order], block[order]
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        rows = [(int(block[a]), found[a:b].tobytes(), found[a:b][n[a:b] > 1].tobytes()) for a, b in zip(edges, [*edges[1:], len(block)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["block", "once", "more"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                size += batch.num_rows
            if size >= HELD:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    return arrow_map(keys, run, "block int, once binary, more binary")


def build(keys: DataFrame, blocks: int, repeated: bool = False) -> DataFrame:
    """(block, bits) of the one long column of ``keys``; ``repeated``: only of keys that seem to occur twice or more.

    For the latter a first filter takes the keys as they come: one that passes it already goes into the second.
    """
    def fill(table: pa.Table) -> pa.Table:
        seen, again = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True):
            at = probes(np.frombuffer(once, np.uint64))
            if repeated:
                again[at[seen[at].all(axis=1)]] = True
                again[probes(np.frombuffer(more, np.uint64))] = True
            seen[at] = True
        bits = np.packbits(again if repeated else seen, bitorder="little").view(np.int64)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.list_(pa.int64()))})

    return _packed(keys, blocks).groupBy("block").applyInArrow(fill, "block int, bits array<long>")
