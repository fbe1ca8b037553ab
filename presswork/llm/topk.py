"""Exact top-k search by Fagin's threshold algorithm.

Vectors are turned into integers and dealt into blocks of candidates and chunks of queries. In each cell of that grid, every dimension has
a list of the candidates in order. A query walks its lists in parallel, each from the end that its component favours; whoever is met
first in any list is scored in full. The sum of the components at the current depth bounds the score of everyone not met
yet, and the walk stops when the bound is below the kth score (at equality it goes on, for ties). A window per query
merges the few best of each block.

Queries and candidates are replicated along one side of the grid only; a cell's memory is one block and one chunk.

Nulls and edges: vectors that are null or hold null or non-finite components take no part; missing components of shorter vectors
count 0; a query leaves out its own row only, so a repeated row finds its twin; ties go to the smaller vec_id, a
null one last; rows without vec_id are candidates but no queries; fewer candidates than
k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from presswork.llm.common import table
from presswork.session import checkpoint

K, QUERY_EVERY, SCALE = 5, 50, 256
#: Rows of a block of candidates (it grows with the table up to the larger number) and of a chunk of queries.
BLOCK, MOST_BLOCK, CHUNK = 4096, 65536, 4096
FIRST_DEPTH = 16
#: Where a row without vec_id stands among ties.
LAST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def to_integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of integers, missing components 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    wide = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(lengths), wide), dtype=np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out


class SortedLists:
    """The candidates of a block, in order along each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.vectors = ids[by_id], rows[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def search(self, query: np.ndarray, own_row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and scores of the k best (ties to smaller ids), without the query's own row."""
        n = len(self.ids)
        exact = float(self.largest) * float(np.abs(query).max(initial=0)) * max(1, query.size) < 2**53
        vectors = self._floats() if exact else self.vectors
        q = query.astype(np.float64) if exact else query
        live = np.flatnonzero(query)
        seen = np.zeros(n, dtype=bool)
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth, step = 0, FIRST_DEPTH
        up = query[live] > 0
        while depth < n:
            to = min(n, depth + step) if len(live) else n
            if len(live):
                heads = np.concatenate([self.order[live[up], n - to : n - depth].ravel(), self.order[live[~up], depth:to].ravel()])
                met = np.zeros(n, dtype=bool)
                met[heads] = True
                new = np.flatnonzero(met & ~seen)
            else:
                new = np.arange(n)
            seen[new] = True
            new = new[self.rows[new] != own_row]
            best = np.concatenate([best, new])
            scores = np.concatenate([scores, (vectors[new] @ q).astype(np.int64)])
            if len(best) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                kept = np.flatnonzero(scores >= kth)
                kept = kept[np.lexsort((best[kept], -scores[kept]))][:k]
                best, scores = best[kept], scores[kept]
            depth, step = to, step * 2
            if seen.all():
                break
            if len(best) >= k and len(live):
                edge = np.where(up, self.sorted[live, n - depth], self.sorted[live, depth - 1])
                if int(edge @ query[live]) < scores.min():
                    break
        kept = np.lexsort((best, -scores))[:k]
        return best[kept], scores[kept]

    def _floats(self) -> np.ndarray:
        if not hasattr(self, "floats"):
            self.floats = self.vectors.astype(np.float64)
        return self.floats


def _cell(k: int):
    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if queries.num_rows and candidates.num_rows:
            wide = max(matrix(queries["v"]).shape[1], matrix(candidates["v"]).shape[1])
            ids, nameless = pc.fill_null(candidates["id"], LAST).to_numpy(), candidates["id"].is_null().to_numpy()
            lists = SortedLists(ids, candidates["row"].to_numpy(), matrix(candidates["v"], wide))
            nameless = nameless[np.argsort(ids, kind="stable")]
            for query, qid, qrow in zip(matrix(queries["v"], wide), queries["id"].to_pylist(), queries["row"].to_pylist()):
                best, scores = lists.search(query, qrow, k)
                for column, values in zip(out, ([qrow] * len(best), [qid] * len(best), lists.rows[best].tolist(), [None if nameless[b] else int(lists.ids[b]) for b in best], scores.tolist())):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_row", "query_id", "row", "vec_id", "score"])

    return cell


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, n_candidates: int | None = None, n_queries: int | None = None) -> DataFrame:
    """The k best candidates of each query. Both have ``id``, ``row`` (unique) and ``v`` (array<long>)."""
    n = candidates.count() if n_candidates is None else n_candidates
    m = queries.count() if n_queries is None else n_queries
    blocks = max(1, -(-n // max(BLOCK, min(MOST_BLOCK, n // 64))))
    chunks = max(1, -(-m // CHUNK))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "row", "v", dealt(chunks).alias("chunk"), copied(blocks).alias("block"))
    right = candidates.select("id", "row", "v", dealt(blocks).alias("block"), copied(chunks).alias("chunk"))
    cells = (
        left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
        .applyInArrow(_cell(k), "query_row long, query_id long, row long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), to_integers(F.col("embedding")).alias("v"))
    )
    rows = checkpoint(rows)
    return top_k(rows.where(F.col("id") % QUERY_EVERY == 0), rows, K)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
