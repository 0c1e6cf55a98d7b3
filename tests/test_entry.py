import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))
SMALL = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402
from check import connect, rows_of  # noqa: E402


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "direction" in df.columns


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.parametrize("name", ["standardize_vendor_prices", "assemble_daily_panel", "relative_returns", "cooldown_filter", "data_audit",
                                  "trailing_factor_residuals", "matching_panel", "mapping_audit"])
def test_queries_match_their_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    rel = connect(SMALL).execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in rel.description], rel.fetchall())
