"""Sources that users plug in, as Spark data sources with declared schema and partitions.

A source names its columns and cuts itself into parts; each part is read in a task of its own and handed to Spark as Arrow
batches, so nothing passes the driver but the list of parts. The result is an ordinary frame.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Sources travel with their tasks, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MarketSource(Protocol):
    """What a source must offer. It is sent to tasks, so it must be picklable."""

    name: str

    def schema(self) -> str:
        """Columns and types, as in a table definition."""

    def parts(self) -> list:
        """Independent pieces: file names, ranges of keys or dates. Called once, on the driver."""

    def read(self, part) -> Iterator[pa.RecordBatch]:
        """Batches of one piece, with the columns of ``schema``. Called in a task, again if an executor is lost."""


class _Part(InputPartition):
    def __init__(self, value):
        super().__init__(value)
        self.value = value


def open_source(spark: SparkSession, source: MarketSource) -> DataFrame:
    """Register ``source`` under its name and read it."""
    absent = [m for m in ("schema", "parts", "read") if not callable(getattr(source, m, None))]
    if absent or not getattr(source, "name", None):
        raise TypeError(f"a source needs a name and {', '.join(absent) or 'schema, parts and read'}")

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(p) for p in source.parts()]

        def read(self, partition):
            yield from source.read(partition.value)

    class Plugged(DataSource):
        @classmethod
        def name(cls):
            return source.name

        def schema(self):
            return source.schema()

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Plugged)
    return spark.read.format(source.name).load()


class ParquetGroups:
    """Parquet files on a file system that all tasks see, one part for each row group; only the named columns are read."""

    def __init__(self, paths: list[str], columns: dict[str, str], name: str = "parquet_groups"):
        self.paths, self.columns, self.name = paths, columns, name

    def schema(self) -> str:
        return ", ".join(f"`{c}` {kind}" for c, kind in self.columns.items())

    def parts(self) -> list:
        from pyarrow import parquet

        return [(p, k) for p in self.paths for k in range(parquet.ParquetFile(p).metadata.num_row_groups)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        path, group = part
        for batch in parquet.ParquetFile(path).iter_batches(row_groups=[group], columns=list(self.columns)):
            yield batch.select(list(self.columns))
