"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from veldra import workload

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in workload.TABLES:
        if os.path.exists(f"{DIR}/{name}.parquet"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_query(spark, duck, name):
    frame = workload.queries()[name](spark, DIR)
    cursor = duck.execute(workload.oracle_sql()[name])
    assert rows(frame.columns, frame.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_all_queries_have_sql():
    assert set(workload.queries()) == set(workload.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["c_custkey", "o_orderkey", "o_totalprice"] and frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
