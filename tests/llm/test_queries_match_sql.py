import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))

from check import connect, rows_of  # noqa: E402

from peerwake.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracles()))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_its_sql(spark, name, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    rel = connect(sf_dir).execute(queries.oracles()[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
