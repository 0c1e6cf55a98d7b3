"""Projection of the star-schema test tables onto the study model.

``lineitem`` becomes two-weekly prices per supplier (about 96 % of the cells are
observed, so gaps occur but most windows are complete); ``supplier``, ``nation`` and
``region`` become the researcher's classification. Prices are rounded to six
decimals so that every engine starts from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key) -> "F.Column":
    return F.concat(F.lit("s."), F.lpad(key.cast("string"), 10, "0"))


def vendor_prices(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One row per (supplier, two weeks), in the vendor's spelling. ``lines``: the order lines, if they come from elsewhere."""
    lines = (table(spark, sf_dir, "lineitem") if lines is None else lines).select("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    origin = F.lit("1995-01-02").cast("date")
    fortnight = F.date_add(origin, (F.floor(F.datediff(F.col("l_shipdate").cast("date"), origin) / 14) * 14).cast("int"))
    lots = lines.groupBy("l_suppkey", fortnight.alias("Date")).agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.min("l_discount").alias("lo"),
        F.max("l_discount").alias("hi"), F.min("l_tax").alias("tx"), F.sum("l_quantity").alias("Volume"))
    ticker = F.upper(ticker_of(F.col("l_suppkey")))
    tick = lambda c: F.round(c * 100, 6)
    return lots.select(
        "Date", F.concat(F.lit("SEC_S_"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("security_id"),
        ticker.alias("ticker"), tick(1 + F.col("tx")).alias("Open"), tick(1 + F.col("hi")).alias("High"),
        tick(1 + F.col("lo")).alias("Low"), tick(1 + F.col("d")).alias("Close"),
        tick(1 + F.col("d") - F.col("t")).alias("Adj Close"), "Volume")


def peer_group_of(subsector, ticker) -> "F.Column":
    """Region split by blocks of 25 supplier keys: about five firms each, however many suppliers there are."""
    key = F.substring(ticker, 3, 10).cast("bigint")
    return F.concat(subsector, F.lit("/"), F.floor(key / 25).cast("string"))


def classification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Researcher metadata as untrimmed text, one row per supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    adr = F.when(F.col("s_suppkey") % 10 == 0, F.lit(" ADR")).otherwise(F.lit(""))
    return joined.select(
        F.concat(F.lit("  "), ticker_of(F.col("s_suppkey")), F.lit(" ")).alias("ticker"),
        F.col("s_name").alias("company_name"), F.concat("n_name", adr).alias("exchange_or_market"),
        F.concat(F.lit(" "), "r_name").alias("subsector"), F.lit("supplier ").alias("semiconductor_role"),
        F.concat(F.lit("ships from "), "n_name").alias("business_description"),
        F.lit("listed supplier").alias("inclusion_reason"), F.lit("reviewed").alias("review_flag"),
        F.when(F.col("s_acctbal") >= 0, F.lit("core")).otherwise(F.lit("extension")).alias("universe_tier"),
        F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("notes"))
