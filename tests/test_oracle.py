"""Every query of the reference's operators against its DuckDB oracle on sf0.001 (the driver
repeats this on sf0.01)."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from cohortlens.plans.catalog import queries
from cohortlens.plans.oracle import oracle_sql
from tools.oracle_check import canon

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0 and "Final_Churn_Flag" in df.columns


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle(spark, duck, key):
    df = queries()[key](spark, SF)
    rows = df.collect()
    cur = duck.execute(oracle_sql()[key])
    o_rows = cur.fetchall()
    o_names = [d[0] for d in cur.description]
    names = sorted(df.columns)
    assert sorted(o_names) == names
    a = sorted(tuple(canon(r[n]) for n in names) for r in rows)
    idx = [o_names.index(n) for n in names]
    b = sorted(tuple(canon(r[i]) for i in idx) for r in o_rows)
    assert len(a) == len(b)
    assert a == b


def test_entry_schema_is_stable(spark):
    assert entry(spark).schema == entry(spark).schema
    assert all(callable(f) for f in queries().values())
