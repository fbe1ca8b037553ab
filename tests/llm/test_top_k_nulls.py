"""Exact top-k with rows that have no vec_id, repeats and ties, against all products and against its SQL."""

import duckdb
import numpy as np

from presswork.llm import topk


def test_null_ids_are_candidates(spark, tmp_path):
    rng = np.random.default_rng(8)
    vectors = [[float(x) for x in rng.integers(-3, 4, 6) / 4] for _ in range(150)]
    rows = [(k if k % 9 else None, v, k) for k, v in enumerate(vectors)] + [(None, vectors[50], 1), (50, vectors[50], 2), (100, [0.25] * 6, 3), (-50, vectors[7], 4)]
    rows += [(200, None, 1), (250, [None, 1.0], 1), (300, [float("nan")] * 6, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if v is not None and None not in v and not np.isnan(v).any()]
    want = []
    for k, (i, q) in enumerate(good):
        if i is not None and i % 50 == 0:
            order = sorted((x for x in range(len(good)) if x != k), key=lambda x: (-int(good[x][1] @ q), good[x][0] is None, good[x][0] or 0, x))[:5]
            want += [(i, n, good[x][0], int(good[x][1] @ q)) for n, x in enumerate(order, 1)]
    got = topk.op6_top_k(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(r[2] is None for r in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(topk.OP6_SQL).fetchall(), key=repr) == sorted(want, key=repr)
