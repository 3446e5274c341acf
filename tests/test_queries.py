"""Every named query with SQL agrees with DuckDB on the small tables."""

import math

import duckdb
import pytest

from dupstrata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    r = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert any(r["key"] == "ALL" for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_content_defined_chunks_find_shared_text(spark, sf):
    rows = {r["key"]: r for r in catalog.QUERIES["cdc_dedup"](spark, sf).collect()}
    assert 0 < rows["ALL"]["real"] <= rows["ALL"]["total"]
