"""Every registered notice query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(table, columns):
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r.values()) for r in table.select(columns).to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, db, name):
    got, expected = registry.queries()[name](spark, SF).toArrow(), db.execute(registry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(expected.column_names)
    assert sorted(got.column_names) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_flagship_and_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
