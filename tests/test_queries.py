"""Every core query against its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from assayer.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(values):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in values)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    found = duck.execute(oracle.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == names
    order = [[d[0] for d in found.description].index(n) for n in names]
    want = rows([r[i] for i in order] for r in found.fetchall())
    assert rows(tuple(r) for r in df.select(*names).collect()) == want


def test_partitions_change_no_decision(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows(tuple(r) for r in queries.gate_carryover(spark, DATA).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert rows(tuple(r) for r in queries.gate_carryover(spark, DATA).collect()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
