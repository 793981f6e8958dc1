"""The operators that SQL can express against their DuckDB twins, over the driver tables."""

import os

import duckdb
import pytest

from stratalith.llm import queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    assert sorted(map(tuple, got.select(*order).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
