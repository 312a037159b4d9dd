"""Queries against their SQL over the fixture tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries

SIZES = [p for p in (Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")) if p.exists()]


def rows(df):
    return sorted(tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in map(lambda v: None if isinstance(v, float) and math.isnan(v) else v, r)) for r in df)


@pytest.mark.parametrize("size", SIZES, ids=lambda p: p.name)
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, size, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{size}/{t}.parquet'")
    made = queries.QUERIES[name](spark, str(size))
    want = con.sql(f"SELECT {', '.join(made.columns)} FROM ({queries.ORACLE_SQL[name]})")
    assert rows(map(tuple, made.collect())) == rows(want.fetchall())
