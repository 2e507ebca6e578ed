"""Every query of the engine against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from segmenta import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_like_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert ordered(df.select(*cols).collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
