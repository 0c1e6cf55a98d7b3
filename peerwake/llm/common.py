"""Readers, word splitting and size checks shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but digits, lower-case letters and characters outside ASCII separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BATCH_ROWS = 1000
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text of one-byte characters takes the plain function, with the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(text: Column, separator: str) -> Column:
    """The non-empty parts between separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def words_of(text: Column) -> Column:
    return pieces(ascii_lower(text), NOT_WORD)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body holds lambdas."""
    return F.transform(F.array(value), body)[0]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast when a count shows at most ``rows`` rows, else the frame for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def packed(docs: DataFrame) -> DataFrame:
    """(text, doc): all other columns in one struct with names of its own, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    return docs.select("text", F.struct(F.lit(0).alias("c"), *rest).alias("doc"))


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from a frame that ``packed`` made of it; ``changed`` ones in place of the old."""
    held = {c: F.col("doc").getField(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"} | {"text": F.col("text")} | changed
    return [held[c].alias(c) for c in docs.columns]


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, since texts may be long."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 512,
                  size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a task holds about ``size`` bytes of text, or one text, at a time."""
    for batch in batches:
        start = held = 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and (held + length > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for later tasks, beside other stages' workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
