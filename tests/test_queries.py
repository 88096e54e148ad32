"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from reelframe.plans import registry
from reelframe.sources.carriers import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = registry.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    ours = sorted(repr([plain(v) for v in row]) for row in found.select(*[f"`{c}`" for c in columns]).collect())
    other = duck.sql(registry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert ours == sorted(repr([plain(row[k]) for k in at]) for row in other.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
