"""Every query of the engine against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quadrille import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck.sql(catalog.ORACLES[name]).df())
    else:
        assert len(got.columns)
