"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str([_cell(y) for y in x])
    if x is None or pd.isna(x):
        return "NULL"
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def _rows(df):
    return sorted(tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"reproduce_report", "packcheck_report"}))
def test_query_equals_oracle(spark, sf, duck, name):
    assert _rows(catalog.queries()[name](spark, sf).toPandas()) == _rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
