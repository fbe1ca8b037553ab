"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from presswork.plans import catalogue

SF = os.environ.get("PRESSWORK_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def compare(spark, duck, make, sql):
    df = make(spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    theirs_names = [d[0] for d in result.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    assert ours == sorted((tuple(norm(row[i]) for i in at) for row in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", catalogue.ORACLE)
def test_query(spark, duck, name):
    compare(spark, duck, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    least = 0 if name == "embed_missing" else 1  # at the smallest size every article has its vector
    assert catalogue.QUERIES[name](spark, SF).count() >= least


def test_entry(spark):
    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
