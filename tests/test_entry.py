"""Every query on the smallest data, and the SQL beside it, where these data are at hand."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")

import __spark_entry__ as entry  # noqa: E402


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for p in DATA.glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else p / '*.parquet'}')")
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    elif name == "ris_roundtrip":
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
