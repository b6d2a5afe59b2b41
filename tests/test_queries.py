"""Every query with SQL gives the rows that DuckDB gives, and the rest give rows."""

import duckdb
import pytest

import __spark_entry__
from scriptorium.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("documents", "conversations", "events", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    relation = duck.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
    at = [relation.columns.index(n) for n in names]
    expected = sorted(([plain(r[i]) for i in at] for r in relation.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).head(1)


def test_entry(spark):
    assert __spark_entry__.entry(spark).head(1)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
