import datetime as dt

import pytest

from peerwake.contracts import CONTRACTS, ContractError, contract_issues, require
from peerwake.operators import audits, panel
from peerwake.params import Detection, Inference, Resampling, Study, Universe
from peerwake.sources import market


def test_vendor_columns_are_canonical_and_unambiguous():
    assert market.canonical_names(["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"])["Adj Close"] == "adj_close"
    with pytest.raises(ValueError, match="ambiguous"):
        market.canonical_names(["Date", "Open", "High", "Low", "Close", "Adj Close", "adj_close", "Volume"])
    with pytest.raises(ValueError, match="missing"):
        market.canonical_names(["Date", "Close"])


def test_placeholders_are_dropped_and_partial_rows_kept(spark):
    raw = spark.createDataFrame(
        [("2024-01-02T00:00:00+09:00", "A", "a", None, None, None, None, None, "0"), ("2024-01-03", "A", "a", None, None, None, "5", "x", None),
         ("2024-01-04", "A", "a", None, None, None, None, None, "7")],
        "Date string, security_id string, ticker string, Open string, High string, Low string, Close string, `Adj Close` string, Volume string")
    rows = market.standardize_prices(raw).orderBy("date").collect()
    assert [(r.date, r.close, r.adj_close, r.volume) for r in rows] == [
        (dt.date(2024, 1, 3), 5.0, None, None), (dt.date(2024, 1, 4), None, None, 7.0)]


def test_master_loader_fails_closed(spark):
    cols = "security_id string, ticker string, yahoo_symbol string"
    good = spark.createDataFrame([(" S1", "A ", "a")], cols)
    assert market.load_security_master(good).first()[:] == ("S1", "A", "a")
    with pytest.raises(Exception, match="blank cells in ticker"):
        market.load_security_master(spark.createDataFrame([("S1", " ", "a")], cols)).collect()
    with pytest.raises(Exception, match="duplicate ticker A"):
        market.load_security_master(spark.createDataFrame([("S1", "A", "a"), ("S2", "A", "b")], cols)).collect()


RAW = "date string, ticker string, adjusted_close string, close string, volume string"


def _panel(spark, rows):
    master = spark.createDataFrame([("SEC_A", "A")], "security_id string, ticker string")
    return market.build_daily_panel(spark.createDataFrame(rows, RAW), master)


def test_daily_panel_resolves_ids_and_returns(spark):
    rows = _panel(spark, [("2024/01/03", " A ", "110", "11", "1"), ("01/02/2024", "A", "100", "10", "1")]).orderBy("date").collect()
    assert [r.security_id for r in rows] == ["SEC_A", "SEC_A"]
    assert rows[0]["return"] is None and rows[1]["return"] == pytest.approx(0.1)


@pytest.mark.parametrize("row, code", [
    (("soon", "A", "1", "1", "1"), "malformed_date"), (("2024-01-02", "A", "x", "1", "1"), "invalid_type"),
    (("2024-01-02", "B", "1", "1", "1"), "invalid_security_reference"), (("2024-01-02", None, "1", "1", "1"), "null_values"),
    (("2024-01-02", "A", "Infinity", "1", "1"), "non_finite")])
def test_daily_panel_raises_on_defects(spark, row, code):
    with pytest.raises(Exception, match=code):
        _panel(spark, [row]).collect()


def test_duplicate_rows_raise(spark):
    with pytest.raises(Exception, match="duplicate_primary_key"):
        _panel(spark, [("2024-01-02", "A", "1", "1", "1")] * 2).collect()


def test_contract_issues_collects_every_code(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), " ", True), (dt.date(2024, 1, 1), " ", None)], "date date, security_id string, eligible boolean")
    codes = {(r.code, r.subject) for r in contract_issues(df, CONTRACTS["universe_membership"]).collect()}
    assert codes == {("missing_columns", "exclusion_reason"), ("null_values", "eligible"), ("blank_string", "security_id"),
                     ("duplicate_primary_key", "date,security_id")}
    wrong = df.withColumn("eligible", df.eligible.cast("string")).withColumn("exclusion_reason", df.security_id)
    assert "invalid_type" in {r.code for r in contract_issues(wrong, CONTRACTS["universe_membership"]).collect()}
    with pytest.raises(ContractError):
        require(contract_issues(df, CONTRACTS["universe_membership"]))


def test_parameters_are_validated():
    for make in (lambda: Detection(cooldown_scope="x"), lambda: Detection(minimum_history_requirement=90), lambda: Study(primary_horizons=()),
                 lambda: Study(post_event_days=2), lambda: Universe(allowed_universe_tiers=()), lambda: Inference(confidence_level=1.0),
                 lambda: Inference(interval_method="bootstrap", cluster_by="two_way"), lambda: Resampling(null_iterations=0),
                 lambda: Inference(bootstrap_iterations=99), lambda: Resampling(confidence_level=0), lambda: Resampling(match_columns=("a", "a")),
                 lambda: Study(primary_horizons=(0, 1)), lambda: Universe(), lambda: Detection(exclude_corporate_action_types=("gift",))):
        with pytest.raises(ValueError):
            make()
    assert Detection(threshold_multiplier=0).threshold_multiplier == 0
    with pytest.raises(ValueError, match="cooldown_period.*minimum_peer_count"):  # all faults at once
        Detection(cooldown_period=-1, minimum_peer_count=0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.5), (dt.date(2023, 1, 1), 2.5)], "date date, x double")
    market.write_parquet(df, f"{tmp_path}/p", partition_by_year=True)
    assert spark.read.parquet(f"{tmp_path}/p").where("year = 2024").count() == 1
    market.write_csv_tables({"t": df}, str(tmp_path))
    back = market.read_csv(spark, f"{tmp_path}/t", "date date, x double", {"x": "y"})
    assert sorted(r.y for r in back.collect()) == [1.5, 2.5]
    market.write_raw_snapshot(df, str(tmp_path), "one")
    with pytest.raises(Exception, match="exist|EXIST"):
        market.write_raw_snapshot(df, str(tmp_path), "one")
    strings = market.read_strings(spark, f"{tmp_path}/t", ["date", "x"])
    assert dict(strings.dtypes) == {"date": "string", "x": "string"}


def test_returns_use_the_previous_observed_row(spark):
    p = spark.createDataFrame([(dt.date(2024, 1, d), "A", v) for d, v in ((1, 100.0), (2, 110.0), (9, 99.0))], "date date, security_id string, adj_close double")
    got = [r["return"] for r in panel.simple_returns(p).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.1, -0.1])


def test_universe_reasons_in_order(spark):
    dates = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [(d, "A", 10.0, 100.0) for d in dates] + [(dates[2], "B", 1.0, 1.0)]
    prices = spark.createDataFrame(rows, "date date, security_id string, close double, volume double")
    master = spark.createDataFrame([("A", "NYSE", "common_stock", "core"), ("B", "NYSE", "adr", "core"), ("C", "XETRA", "fund", "extension")],
                                   "security_id string, exchange string, security_type string, universe_tier string")
    known = spark.createDataFrame([("A",), ("B",)], "security_id string")
    p = Universe(min_price=5.0, min_history_days=2, min_average_dollar_volume=100.0, average_dollar_volume_window_days=2, allow_adrs=False,
                 allow_classification_before_as_of=True)
    got = {(r.date, r.security_id): (r.eligible, r.exclusion_reason) for r in panel.universe_membership(prices, master, known, p).collect()}
    assert len(got) == 9
    assert got[(dates[0], "A")] == (False, "insufficient_history;insufficient_liquidity_history")
    assert got[(dates[2], "A")] == (True, None)
    assert got[(dates[2], "B")][1] == "adr_not_allowed;insufficient_history;below_minimum_price;insufficient_liquidity_history"
    assert got[(dates[0], "C")][1] == ("missing_semiconductor_classification;universe_tier_not_allowed;non_us_listing;ineligible_security_type;"
                                       "missing_data;no_market_data")


def test_security_ids(spark):
    df = spark.createDataFrame([(" brk.b ",), ("2330-TW",)], "t string")
    got = [r[0] for r in df.select(panel.security_id_from_ticker(df.t)).collect()]
    assert got == ["SEC_BRK_B", "SEC_2330_TW"]


def test_audit_counts_weekdays_gaps_and_extremes(spark):
    master = spark.createDataFrame([("A", "a"), ("B", "b")], "security_id string, ticker string")
    rows = [(dt.date(2024, 1, d), "A", "a", 1.0, 1.0, 1.0, 1.0, px, v) for d, px, v in ((1, 10.0, 5.0), (2, 16.0, 0.0), (12, 8.0, 5.0))]
    prices = spark.createDataFrame(rows, "date date, security_id string, ticker string, open double, high double, low double, close double, adj_close double, volume double")
    got = {r.security_id: r for r in audits.data_audit(master, prices, extreme=0.50 - 1e-12).collect()}
    assert got["A"].issues == ("missing_weekdays_or_holidays=7; large_gaps=1(max_calendar_days=10); zero_volume_days=1; extreme_returns=2")
    assert got["A"].missing_percentage == pytest.approx(70.0)
    assert (got["B"].observation_count, got["B"].missing_percentage, got["B"].issues) == (0, 100.0, "no_data")
