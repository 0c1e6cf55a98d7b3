"""Rules that hold inside a plan: a row that breaks one stops the run that meets it, without a pass of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown(what: str, *columns: str) -> Column:
    """A message that ends with the row's values of ``columns``."""
    return F.concat_ws(" ", F.lit(what), *[F.col(c).cast("string") for c in columns])


def stop_unless(df: DataFrame, rule: Column, message: Column) -> DataFrame:
    """The rows of ``df``; the first one that isn't known to keep ``rule`` raises ``message``.

    The rule is a filter, so it keeps the frame's partitioning and no later pruning of columns removes it.
    """
    return df.where(F.when(rule, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def once_by(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows of ``df``, which must hold each combination of ``keys`` once.

    The count comes from a partial aggregate by the keys, so a key that repeats a million times is one row a
    task. A join on the same keys uses that shuffle again: the proof costs an aggregate, no pass and no exchange.
    Where nothing of an outer join's unique side is read, Spark leaves the join out, and the proof with it.
    """
    rest = [c for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest) if rest else F.lit(True)).alias("__row"))
    single = stop_unless(held, F.col("__n") == 1, shown(f"{what}: duplicate {', '.join(keys)}", *keys))
    return single.select(*[F.col(f"__row.{c}") if c in rest else F.col(c) for c in df.columns])


def once_by_date(df: DataFrame, unit: str, date: str, what: str) -> DataFrame:
    """The rows of ``df``, which must hold each (unit, date) once.

    Twins are neighbours in the unit's order of dates. Windows of the same unit and order that follow share the sort.
    """
    before = df.withColumn("__before", F.lag(date).over(Window.partitionBy(unit).orderBy(date)))
    return stop_unless(before, F.col("__before").isNull() | (F.col("__before") < F.col(date)), shown(f"{what}: duplicate {unit}, {date}", unit, date)).drop("__before")
