"""Sums over units drawn with replacement, in blocks of bounded size.

A draw is a digest of its keys, iteration and slot. Tasks draw for a range of slots and all
iterations at once and send each block of units the draws that hit it, four bytes each. A block
counts how often an iteration drew each of its units and multiplies these counts with the units'
values, so neither a row for each draw nor a table of all units is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoints import staged

DRAWS_PER_BLOCK, DRAWS_PER_TASK_ROW = 1 << 22, 1 << 20


def drawn_sums(units: DataFrame, keys: list[str], inner: list[str], values: list[str], iterations: int, seed: int,
               number: str = "__i", total: str = "__i_total") -> DataFrame:
    """(keys, inner, iteration, values): for each iteration the sums over the units it drew.

    ``units`` are numbered from 0 to ``total`` - 1 within ``keys``; a number may have one row for
    each ``inner`` key, all of which share their unit's draws. Values must not be null. Slot s of
    iteration t draws the number ``draw_index(total, seed, *keys, t, s)``.
    """
    width = max(1, DRAWS_PER_BLOCK // iterations)
    span = max(1, DRAWS_PER_TASK_ROW // iterations)
    spark = units.sparkSession
    units = staged(units.select(*keys, *inner, number, total, *[F.col(v).cast("double") for v in values]), "units")
    totals = units.groupBy(*keys).agg(F.max(total).alias("__n"))
    ranges = totals.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(span).cast("bigint"))))
    ranges = ranges.withColumn("__lead", F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit("")))
    # A range is one short row but much work, so the number of tasks is given: AQE would join them.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranges = ranges.repartition(tasks, *keys, "__first")
    key_fields = [units.schema[k] for k in keys]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                n, first, lead = (row.column(c)[0].as_py() for c in ("__n", "__first", "__lead"))
                slots = [b"|%d" % s for s in range(first, min(first + span, n))]
                picks = np.empty((iterations, len(slots)), np.int64)
                for t in range(iterations):
                    head = b"%s%d" % (lead.encode(), t)
                    drawn = np.frombuffer(b"".join([sha256(head + s).digest() for s in slots]), ">u8")[::4]
                    picks[t] = (drawn >> np.uint64(4)) % np.uint64(n)  # 15 hex digits
                block = (picks // width).ravel()
                codes = (np.arange(iterations)[:, None] * width + picks % width).ravel().astype(np.int32)
                order = np.argsort(block, kind="stable")
                hit, start = np.unique(block[order], return_index=True)
                parts = [p.tobytes() for p in np.split(codes[order], start[1:])]
                held = [pa.array([row.column(k)[0].as_py()] * len(hit), row.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*held, pa.array(hit, pa.int64()), pa.array(parts, pa.binary())], [*keys, "__block", "__codes"])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, *inner, "iteration", *values]
        hits = [np.frombuffer(c.as_buffer(), np.int32) for c in right.column("__codes")] if len(right) else []
        times = np.bincount(np.concatenate([*hits, np.empty(0, np.int32)]), minlength=iterations * width).reshape(iterations, width).astype(float)
        cells = left.select(inner).to_pandas().groupby(inner, dropna=False, sort=False).ngroup().to_numpy() if inner else np.zeros(len(left), int)
        at = left.column(number).to_numpy() % width
        tables = []
        for cell in np.unique(cells):
            mine = np.flatnonzero(cells == cell)
            x = np.column_stack([left.column(v).to_numpy()[mine] for v in values])
            drawn, odd = times[:, at[mine]], ~np.isfinite(x)
            sums = drawn @ np.where(odd, 0.0, x)
            for i, j in np.argwhere(odd):  # an endless value or NaN touches only the iterations that drew it
                sums[:, j] += np.where(drawn[:, i] > 0, x[i, j], 0.0)
            fixed = left.select([*keys, *inner]).slice(int(mine[0]), 1)
            tables.append(pa.table([*[pa.array([fixed.column(k)[0].as_py()] * iterations, fixed.column(k).type) for k in [*keys, *inner]],
                                    pa.array(np.arange(iterations), pa.int32()), *[pa.array(sums[:, j]) for j in range(len(values))]], names=names))
        return pa.concat_tables(tables)

    codes = ranges.mapInArrow(draw, T.StructType([*key_fields, T.StructField("__block", T.LongType()), T.StructField("__codes", T.BinaryType())]))
    schema = T.StructType([*key_fields, *[units.schema[k] for k in inner], T.StructField("iteration", T.IntegerType()),
                           *[T.StructField(v, T.DoubleType()) for v in values]])
    side = [*keys, "__block"]
    blocks = units.withColumn("__block", F.floor(F.col(number) / width)).groupBy(*side).cogroup(codes.groupBy(*side)).applyInArrow(add, schema)
    return blocks.groupBy(*keys, *inner, "iteration").agg(*[F.sum(v).alias(v) for v in values])
