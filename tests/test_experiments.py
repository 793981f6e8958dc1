"""Experiment queries against DuckDB on keys that the small tables lack."""

import duckdb

from stratalith.plans import registry


def test_manifest_names_of_large_numbers_equal_sql(spark, tmp_path):
    c, d = duckdb.connect(), str(tmp_path)
    c.sql("CREATE TABLE orders AS SELECT * REPLACE (o_orderkey + x.base AS o_orderkey) FROM (FROM '/root/testdata/sf0.001/orders.parquet' LIMIT 100), (VALUES (0), (999900), (123456700)) x(base)")
    c.sql(f"COPY orders TO '{d}/orders.parquet'")
    got = registry.queries()["k8_recovery_manifest"](spark, d)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['k8_recovery_manifest']})").fetchall()
    assert any(r[0] == "recovered_anonymous" and r[1] > 999999 for r in want)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
