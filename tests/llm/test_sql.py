"""Operators with SQL give the rows that DuckDB gives, and empty tables give none."""

import duckdb
import pytest

from presswork.llm import license, pack, registry, shard, simhash, topk

SF = "/root/testdata/sf0.001"


def rounded(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((rounded(r) for r in df.select(*names).collect()), key=repr) == sorted((rounded(r) for r in result.fetchall()), key=repr)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    for f in (shard.op3_shard_bytes, topk.op6_top_k, pack.op10_pack, simhash.op4_simhash_dedup, license.op9_license_scan):
        assert f(spark, str(tmp_path)).count() == 0
