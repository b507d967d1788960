"""Every query of the document engine against its DuckDB twin, over whole tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert rows
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name])
        assert sorted(want.columns) == cols
        assert sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()) == rows


def test_only_known_queries_have_oracles():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "oid", "n", "md5", "raw_md5"]
