"""Every query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        return round(v, 6) if isinstance(v, float) else str(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = lambda df: df.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" else c)
    assert rows(numbers(got)) == rows(numbers(want))


def test_entry_lists_them_all():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
