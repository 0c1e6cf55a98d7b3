"""Rules inside plans, mixed dates and plugged-in sources."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peerwake.functions.checked import once_by, once_by_date, stop_unless
from peerwake.functions.dates import parse_mixed_date
from peerwake.operators import panel as pn
from peerwake.params import Universe
from peerwake.sources import market
from peerwake.sources.pluggable import ParquetGroups, open_source

META = "ticker string, company_name string, exchange_or_market string, subsector string, semiconductor_role string, business_description string, " \
       "inclusion_reason string, universe_tier string, review_flag string, notes string"


def meta(spark, *changes):
    rows = [{"ticker": t, "company_name": "c", "exchange_or_market": "X", "subsector": "s", "semiconductor_role": "r", "business_description": "b",
             "inclusion_reason": "i", "universe_tier": "core", "review_flag": "f", "notes": "n"} | c for t, c in changes]
    return spark.createDataFrame([tuple(r.values()) for r in rows], META)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_that_occur_once_pass_unchanged(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 2.0), (None, "b", 3.0)], "k int, s string, x double")
    for keys in (["k"], ["k", "s"], ["k", "s", "x"]):
        out = once_by(df, keys, "t")
        assert out.dtypes == df.dtypes and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert once_by(df.where("false"), ["k"], "t").collect() == []
    with pytest.raises(Exception, match="t: duplicate s a"):
        once_by(df, ["s"], "t").collect()


def test_rule_survives_column_pruning_and_counts(spark):
    twins = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, s string, v int")
    for run in (lambda d: d.select(F.lit(1)).collect(), lambda d: d.count(), lambda d: d.groupBy("k").count().collect(), lambda d: d.join(spark.range(3), F.col("k") == F.col("id")).count()):
        with pytest.raises(Exception, match="duplicate k 1"):
            run(once_by(twins, ["k"], "t"))
    with pytest.raises(Exception, match="v is 2"):
        stop_unless(twins, F.col("v") < 2, F.concat(F.lit("v is "), "v")).count()
    with pytest.raises(Exception, match="unknown"):  # null doesn't keep a rule
        stop_unless(twins, F.lit(None).cast("boolean"), F.lit("unknown")).count()


def test_proof_shares_the_shuffle_of_its_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"))
        many = spark.range(1000).select((F.col("id") % 100).alias("k"))
        plain, checked = many.join(one, "k"), many.join(once_by(one, ["k"], "t"), "k")
        assert plan_of(checked).count("Exchange") == plan_of(plain).count("Exchange") and checked.count() == plain.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dates_of_a_unit_once(spark):
    d = dt.date(2024, 1, 1)
    good = spark.createDataFrame([("a", d, 1), ("b", d, 2), ("a", d + dt.timedelta(1), 3)], "u string, d date, x int")
    out = once_by_date(good, "u", "d", "t")
    assert out.columns == good.columns and sorted(out.collect()) == sorted(good.collect())
    with pytest.raises(Exception, match="t: duplicate u, d a 2024-01-01"):
        once_by_date(good.unionAll(good.where("x = 1")), "u", "d", "t").count()
    windows = plan_of(pn.simple_returns(once_by_date(good.select(F.col("u").alias("security_id"), F.col("d").alias("date"), F.col("x").alias("adj_close")), "security_id", "date", "t")))
    assert windows.count("Exchange") == 1 and windows.count("Sort ") == 1  # the next window goes on in the same order


def test_classification_is_validated_while_it_is_read(spark):
    good = market.load_classification(meta(spark, (" a ", {}), ("b", {"universe_tier": "extension"})), subsectors=("s",))
    assert sorted(r.ticker for r in good.collect()) == ["A", "B"]
    for change, match in (({"notes": " "}, "blank cells in notes"), ({"notes": None}, "blank cells in notes"), ({"universe_tier": "x"}, "unsupported universe_tier x"),
                          ({"subsector": "z"}, "unsupported subsector z"), ({"ticker": "a"}, "duplicate ticker A")):
        with pytest.raises(Exception, match=match):
            market.load_classification(meta(spark, ("A", {}), ("b", change)), subsectors=("s",)).collect()
    with pytest.raises(ValueError, match="missing"):
        market.load_classification(meta(spark, ("A", {})).drop("notes"))
    with pytest.raises(ValueError, match="must be text"):
        market.load_classification(meta(spark, ("A", {})).withColumn("notes", F.lit(1)))


def test_identities_that_collide_stop_the_run(spark):
    assert [r.security_id for r in pn.build_security_master(meta(spark, ("A.B", {}))).collect()] == ["SEC_A_B"]
    with pytest.raises(Exception, match="duplicate security_id SEC_A_B"):
        pn.build_security_master(meta(spark, ("A.B", {}), ("A-B", {}))).collect()
    with pytest.raises(Exception, match="duplicate ticker A"):
        pn.build_security_master(meta(spark, ("A", {}), ("A", {}))).collect()
    one = meta(spark, ("A", {}))
    master = pn.build_security_master(one)
    assert pn.classification_view(one, master).count() == 1
    for left, right in ((one.unionAll(one), master), (one, master.unionAll(master))):
        with pytest.raises(Exception, match="duplicate ticker A"):
            pn.classification_view(left, right).count()


def test_panel_refuses_twins(spark):
    master = pn.build_security_master(meta(spark, ("A", {})))
    prices = spark.createDataFrame([(dt.date(2024, 1, k), "SEC_A", "A", *[1.0] * 6) for k in (2, 3)], "date date, security_id string, ticker string, open double, high double, "
                                   "low double, close double, adj_close double, volume double")
    rules = Universe(classification_snapshot_date="2024-01-01")
    assert pn.assemble_daily_panel(prices, master, rules, rules).count() == 2
    with pytest.raises(Exception, match="daily prices: duplicate security_id, date SEC_A 2024-01-02"):
        pn.assemble_daily_panel(prices.unionAll(prices.limit(1)), master, rules, rules).count()
    with pytest.raises(Exception, match="security master: duplicate security_id, ticker"):
        pn.assemble_daily_panel(prices, master.unionAll(master), rules, rules).collect()
    with pytest.raises(Exception, match="standardized prices: duplicate"):
        market.combine_prices([prices, prices]).count()


def test_mixed_dates_read_like_pandas(spark):
    texts = ["2024-01-05", "2024/1/5", "2024.01.05", "20240105", "01/05/2024", "1/5/2024", "13/02/2024", "5 Jan 2024", "05-Jan-2024", "January 5, 2024", "Jan 5 2024",
             "Fri, 05 Jan 2024", "Friday, January 5, 2024", "2024-Jan-05", "5th January 2024", "Sept 3, 2023", "1/5/24", "2024-01-05 13:45:00",
             "2024-01-05T13:45", "Jan 5, 2024 10:00", "29 Feb 2024", "  2024-01-05 "]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("d", parse_mixed_date(F.col("t"))).orderBy("k").collect()
    assert {r.t: r.d for r in rows} == {t: pd.to_datetime(t.strip(), format="mixed").date() for t in texts}


def test_what_is_no_date_is_null(spark):
    texts = ["", "soon", "not a date", "2024-13-01", "2024-02-30", "30/30/2024", "29 Feb 2023", "Ja 5 2024", "2024", "2024-01", "1 2 3 4", "2024--", "5 Jan Feb", "12345678 x",
             "2024-01-05x", "1/5/024", "Jan 2024 99999999999999999999"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").withColumn("d", parse_mixed_date(F.col("t"))).collect()
    assert {r.t: r.d for r in rows if r.d} == {}
    years = spark.createDataFrame([("1/5/68",), ("5 Jan 69",)], "t string").select(F.year(parse_mixed_date(F.col("t"))))
    assert [r[0] for r in years.collect()] == [2068, 1969]
    stamp = spark.sql("SELECT date'2024-01-05' AS a, timestamp_ntz'2024-01-05 10:00:00' AS b").select(*[parse_mixed_date(F.col(c)) for c in "ab"]).first()
    assert set(stamp) == {dt.date(2024, 1, 5)}


def numbers():
    class Numbers:
        name = "test_numbers"

        def schema(self):
            return "date string, ticker string, adjusted_close double, close double, volume double"

        def parts(self):
            return [1, 2, 3]

        def read(self, part):
            yield pa.RecordBatch.from_pydict({"date": [f"Jan {part}, 2024"], "ticker": ["A"], "adjusted_close": [float(part)], "close": [1.0], "volume": [1.0]})
    return Numbers()


def test_a_plugged_in_source_becomes_a_panel(spark):
    master = spark.createDataFrame([("SEC_A", "A")], "security_id string, ticker string")
    raw = open_source(spark, numbers())
    assert raw.rdd.getNumPartitions() == 3
    rows = market.ingest_market_data(spark, numbers(), master).orderBy("date").collect()
    assert [r.date.day for r in rows] == [1, 2, 3] and rows[1]["return"] == pytest.approx(1.0)
    with pytest.raises(TypeError, match="parts"):
        open_source(spark, type("Half", (), {"name": "half", "schema": lambda self: "", "read": lambda self, p: iter(())})())


def test_parquet_groups_read_named_columns(spark, tmp_path):
    table = pa.table({"a": list(range(10)), "b": [str(k) for k in range(10)], "c": [None] * 10})
    import pyarrow.parquet as pq
    pq.write_table(table, f"{tmp_path}/t.parquet", row_group_size=4)
    df = open_source(spark, ParquetGroups([f"{tmp_path}/t.parquet"], {"b": "string", "a": "long"}))
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect())) == [(str(k), k) for k in range(10)]
