"""Every query of the catalog that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from weftline.plans import catalog, models, more  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return None if x is None else float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(want) == len(have)
    assert want == have


def test_each_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"dictionary_codes"}  # eigenvectors: tested against numpy
