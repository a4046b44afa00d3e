"""Every registered query gives the rows of its SQL twin."""

import duckdb
import pytest

from wordloom import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    values = frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()
    return sorted(repr([float(x) if isinstance(x, (int, float)) else x for x in row]) for row in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
