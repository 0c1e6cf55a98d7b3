"""Readers, normalisers and writers for market data (lazy unless a writer is called)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checked import once_by, once_by_date, shown, stop_unless
from ..functions.dates import parse_mixed_date as parse_date
from ..functions.exprs import union_all
from .pluggable import open_source

# Vendor spellings (letters and digits only, lower case) and their canonical names.
VENDOR_COLUMNS = {
    "date": "date", "datetime": "date", "open": "open", "high": "high", "low": "low",
    "close": "close", "adjclose": "adj_close", "adjustedclose": "adj_close", "volume": "volume",
}
PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close")
DAILY_PRICES = ("date", "security_id", "ticker", *PRICE_COLUMNS, "volume")
CLASSIFICATION = ("ticker", "company_name", "exchange_or_market", "subsector", "semiconductor_role", "business_description",
                  "inclusion_reason", "universe_tier", "review_flag", "notes")


def read_csv(spark: SparkSession, path, schema, column_map: dict[str, str] | None = None, **options) -> DataFrame:
    """CSV scan with a declared schema and an optional rename map."""
    reader = spark.read.schema(schema).options(header=True, **options)
    return reader.csv(path).withColumnsRenamed(column_map or {})


def read_strings(spark: SparkSession, path, columns) -> DataFrame:
    """All-text CSV in which an empty cell stays an empty string."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).options(header=True, emptyValue="", nullValue="\u0000").csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def scan_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive date range; published ``reason`` gets its contract name back."""
    if "reason" in df.columns and "exclusion_reason" not in df.columns:
        df = df.withColumnRenamed("reason", "exclusion_reason")
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def clean_master(raw: DataFrame) -> DataFrame:
    """Trim every text column of a vendor mapping."""
    return raw.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in raw.columns])


def _filled(df: DataFrame, what: str) -> DataFrame:
    """Rows without a null or blank cell; others stop the run, with the names of their blank columns."""
    blank = F.concat_ws(", ", *[F.when(F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0, F.lit(c)) for c in df.columns])
    return stop_unless(df, blank == "", F.concat(F.lit(f"{what}: blank cells in "), blank))


def load_security_master(raw: DataFrame, unique=("security_id", "ticker", "yahoo_symbol")) -> DataFrame:
    """Trimmed vendor mapping; blanks and duplicate identifiers stop the run that reads them."""
    out = _filled(clean_master(raw), "security master")
    for column in unique:
        out = once_by(out, [column], "security master")
    return out


def load_classification(raw: DataFrame, subsectors=None, tiers=("core", "extension")) -> DataFrame:
    """Trimmed classification text with upper-case tickers.

    Absent columns and columns that aren't text are refused at once. Blank cells, a second row of a ticker, and subsectors or tiers
    outside the approved ones (any, where None) stop the run that reads them.
    """
    kinds = dict(raw.dtypes)
    if absent := [c for c in CLASSIFICATION if c not in kinds]:
        raise ValueError(f"classification is missing {absent}")
    if odd := [c for c in CLASSIFICATION if kinds[c] != "string"]:
        raise ValueError(f"classification columns {odd} must be text")
    out = _filled(clean_master(raw).withColumn("ticker", F.upper("ticker")), "classification")
    for column, approved in (("subsector", subsectors), ("universe_tier", tiers)):
        if approved is not None:
            out = stop_unless(out, F.col(column).isin(*approved), shown(f"classification: unsupported {column}", column))
    return once_by(out, ["ticker"], "classification")


def canonical_names(columns) -> dict[str, str]:
    """Vendor column -> canonical column; two spellings of one column are an error."""
    found = {c: VENDOR_COLUMNS["".join(ch for ch in c.lower() if ch.isalnum())]
             for c in columns if "".join(ch for ch in c.lower() if ch.isalnum()) in VENDOR_COLUMNS}
    if len(set(found.values())) != len(found):
        raise ValueError(f"ambiguous vendor columns: {sorted(found)}")
    missing = {"date", "volume", *PRICE_COLUMNS} - set(found.values())
    if missing:
        raise ValueError(f"vendor response is missing {sorted(missing)}")
    return found


def standardize_prices(raw: DataFrame) -> DataFrame:
    """Canonical daily prices; fully empty placeholder rows are dropped, partial rows stay.

    ``raw`` carries security_id and ticker next to the vendor's own column names, so one
    pass serves every security.
    """
    names = canonical_names([c for c in raw.columns if c not in ("security_id", "ticker")])
    numbers = {new: F.expr(f"try_cast(`{old}` AS double)") for old, new in names.items() if new != "date"}
    date_in = next(old for old, new in names.items() if new == "date")
    out = raw.select(parse_date(F.col(date_in)).alias("date"), "security_id", "ticker",
                     *[F.when(~F.isnan(numbers[c]), numbers[c]).alias(c) for c in (*PRICE_COLUMNS, "volume")])
    empty = F.coalesce(*[F.col(c) for c in PRICE_COLUMNS]).isNull() & (F.coalesce("volume", F.lit(0.0)) == 0)
    return out.where(~empty).select(*DAILY_PRICES)


def combine_prices(frames: list[DataFrame]) -> DataFrame:
    """Union of standardised frames; a second row of a (security, date) stops the run that reads it."""
    return once_by_date(union_all([f.select(*DAILY_PRICES) for f in frames]), "security_id", "date", "standardized prices")


def normalize_rows(raw: DataFrame, identifier: str = "ticker") -> DataFrame:
    """Typed rows plus ``defect``: null for a good row, else the first broken rule."""
    date = parse_date(F.col("date"))
    text = F.col("date").cast("string")
    zoned = text.rlike(r"[T ]\d{2}:\d{2}.*([zZ]|[+-]\d{2}:?\d{2})$")
    numeric = ("adjusted_close", "close", "volume")
    parsed = {c: F.expr(f"try_cast(trim(cast(`{c}` AS string)) AS double)") for c in numeric}
    bad = F.when(F.col(identifier).isNull(), "null_values").when(F.length(F.trim(F.col(identifier))) == 0, "blank_string")
    bad = bad.when(F.col("date").isNull(), "null_values").when(zoned | date.isNull(), "malformed_date")
    for c in numeric:
        huge = F.abs(parsed[c]) == F.lit(float("inf"))
        bad = (bad.when(F.col(c).isNull() | F.isnan(parsed[c]), "null_values")
               .when(parsed[c].isNull(), "invalid_type").when(huge, "non_finite"))
    return raw.select(date.alias("date"), F.trim(F.col(identifier)).alias(identifier),
                      *[parsed[c].alias(c) for c in numeric], bad.alias("defect"))


def build_daily_panel(raw: DataFrame, master: DataFrame, identifier: str = "ticker") -> DataFrame:
    """Normalise, resolve identifiers and add simple returns; a defect raises when read.

    The rules run inside the plan (``raise_error``), so no separate validation pass scans the data.
    """
    from ..operators.panel import simple_returns

    ids = once_by(master.select(F.col(identifier), "security_id"), [identifier], "security master")
    rows = normalize_rows(raw, identifier).join(ids, identifier, "left")
    defect = F.coalesce("defect", F.when(F.col("security_id").isNull(), F.lit("invalid_security_reference")))
    twin = F.count("*").over(Window.partitionBy("security_id", "date")) > 1
    defect = F.coalesce(defect, F.when(twin, F.lit("duplicate_primary_key")))
    checked = rows.withColumn("security_id", F.when(defect.isNull(), F.col("security_id"))
                              .otherwise(F.raise_error(F.concat(F.lit("daily panel: "), defect)).cast("string")))
    panel = checked.select("date", "security_id", "adjusted_close", "close", "volume")
    return simple_returns(panel, "adjusted_close")


def ingest_market_data(spark: SparkSession, source, master: DataFrame, identifier: str = "ticker", prepare=None) -> DataFrame:
    """A frame or a plugged-in source (``pluggable.MarketSource``) to an analysis panel.

    ``prepare`` turns what the source returns into rows of date, identifier, adjusted_close, close and volume.
    """
    raw = source if isinstance(source, DataFrame) else open_source(spark, source)
    return build_daily_panel(raw if prepare is None else prepare(raw), master, identifier)


def write_parquet(df: DataFrame, path: str, partition_by_year: bool = False) -> None:
    """Overwrite through Spark's commit protocol; readers never see half a table."""
    if partition_by_year:
        df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """One CSV folder per named report table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{directory}/{name}")


def write_raw_snapshot(df: DataFrame, directory: str, run_id: str) -> str:
    """Immutable raw copy: an existing run id is an error."""
    target = f"{directory}/run_id={run_id}"
    df.write.mode("errorifexists").option("header", True).csv(target)
    return target


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and order-free content sum per table."""
    rows = []
    for name, df in tables.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
        word = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
        rows.append(df.agg(F.count("*").alias("row_count"), F.sum(word).alias("content_sum"))
                    .select(F.lit(name).alias("table_name"), "row_count", "content_sum"))
    return union_all(rows)
