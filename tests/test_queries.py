"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from askwell.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    return round(float(x), 5) + 0.0 if isinstance(x, float) or x.__class__.__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
