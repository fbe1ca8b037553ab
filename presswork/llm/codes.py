"""Vector code compression: product codes by partial-distance search.

Vectors of integers are cut into equal parts; each part position has a codebook, refined by rounds of nearest-entry assignment and
integer means, and a vector's code is the index of its nearest entry in every part. The search works through a part's dimensions in
descending variance of the codebook. A mask keeps, for the entry at hand, the vectors whose distance so far does not strictly exceed
the best complete distance that they have; the others leave before their distance is complete, which can't change the result.

A round is one pass that adds up whole numbers per task: what is shuffled and what reaches the driver is one number per entry and
dimension, whatever the rows. The codebooks, of that same fixed size, travel with the tasks.

Nulls and edges: vectors that are null or hold null or non-finite components take no part; components missing in shorter vectors, or
at the end to make the width a multiple of the parts, count 0; integers beyond ``LARGEST`` are held at it; repeated rows each count;
of equally near entries the lowest index wins; rows without vec_id take part but come last, and equal vec_ids in order of their
vectors, where the first ones are asked for; fewer rows than entries give so many entries; an empty table gives no row; sums beyond a
long are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.llm.common import BROADCAST_ROWS, broadcast_if_small, table
from presswork.llm.topk import matrix, usable
from presswork.session import checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Distances of vectors up to 8 components a part stay far inside a long below this size.
LARGEST = 1 << 27
SALTS = 16


def scaled(vector: Column, scale: int, shift: int = 0, largest: int = LARGEST) -> Column:
    """Each component as an integer, floor(scale * x) + shift."""
    held = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(largest)), F.lit(-largest))
    return F.transform(vector, lambda x: (held(x) + F.lit(shift)).cast("int"))


def widest(rows: DataFrame, column: str) -> int:
    return rows.agg(F.max(F.size(column))).first()[0] or 0


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of ``book`` for each row of ``x``; ties to the lower index."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable") if book.shape[1] else np.zeros(0, dtype=np.int64)
    x, book = np.ascontiguousarray(x[:, order].T), book[:, order]
    n, dims = x.shape[1], len(order)
    # a good first entry: the nearest along the widest dimension, compared in full
    code = np.abs(x[0][:, None] - book[:, 0]).argmin(axis=1) if dims else np.zeros(n, dtype=np.int64)
    best = ((x - book[code].T) ** 2).sum(axis=0)
    for entry in range(len(book)):
        live, far = np.flatnonzero(code != entry), None
        for d in range(dims):
            step = (x[d, live] - book[entry, d]) ** 2
            far = step if far is None else far + step
            stays = far <= best[live]
            if not stays.all():
                live, far = live[stays], far[stays]
        if dims:
            wins = (far < best[live]) | (entry < code[live])
            best[live[wins]], code[live[wins]] = far[wins], entry
    return code, best


def _parts(column: pa.Array, books: np.ndarray) -> np.ndarray:
    """(parts, rows, dimensions of a part)."""
    wide = books.shape[0] * books.shape[2]
    x = matrix(column, wide) if wide else np.zeros((len(column), 0), dtype=np.int64)
    return x.reshape(len(x), books.shape[0], books.shape[2]).transpose(1, 0, 2).astype(np.int64)


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of the parts nearest to it, entries without any stay."""
    parts, entries, dims = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, dims + 1), dtype=np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(batch["v"], books)):
                code, _ = nearest_entries(x, books[p])
                for e in np.unique(code):
                    own = x[code == e]
                    total[p, e, 0] += len(own)
                    total[p, e, 1:] += own.sum(axis=0)
        flat = total.ravel()
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(flat[slots])], names=["slot", "value"])

    found = rows.select("v").mapInArrow(sums, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value"))
    total = np.zeros(books.size + parts * entries, dtype=np.int64)
    for r in found.collect():  # one row an entry and dimension at most
        total[r.slot] = r.value
    total = total.reshape(parts, entries, dims + 1)
    used = total[:, :, 0] > 0
    out = books.copy()
    out[used] = total[used][:, 1:] // total[used][:, :1]
    return out


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest ids, as codebooks of shape (parts, entries, dimensions)."""
    dims = -(-widest(rows, "v") // parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), parts * dims), dtype=np.int64)
    for k, r in enumerate(first):
        books[k, : len(r.v)] = r.v
    return books.reshape(len(first), parts, dims).transpose(1, 0, 2).copy()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks for ``rows`` with ``id`` and ``v`` (array<int>)."""
    if entries > 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = refine(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` without ``v``, with ``code`` (two hex digits a part) and ``error`` (squared distances, summed over the parts)."""
    kept = [f for f in rows.schema if f.name != "v"]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest_entries(x, books[p]) for p, x in enumerate(_parts(batch["v"], books))]
            packed = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            columns = [batch[f.name] for f in kept] + [pa.array([row.tobytes().hex() for row in packed], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "code", "error"])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(codes, f"{spec}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` with ``decoded`` (array<long>), the entries that the code names."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in book)) for book in books))
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("decoded", F.flatten(F.array(*(F.element_at(entries[p], index(p)) for p in range(len(books))))).cast("array<long>"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(
        table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("id"), "label", scaled(F.col("embedding"), SCALE).alias("v"))
    )
    books = train(rows)
    if not books.shape[1]:
        return rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = checkpoint(encode(rows, books))
    total, few = broadcast_if_small(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), BROADCAST_ROWS)
    on = F.col("label").eqNullSafe(F.col("_label"))
    if not few:  # a label of very many rows is dealt to several tasks
        coded = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int"))
        total = total.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("_salt") == F.col("_of"))
    return coded.join(total, on).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds written out, over a row per vector and component."""
    nearest = """
n{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * 16 + e) AS e, min(d) AS d
  FROM (SELECT x.r, x.p, b.e, sum((x.x - b.c) * (x.x - b.c))::BIGINT AS d FROM x JOIN b{k} b ON x.p = b.p AND x.j = b.j GROUP BY ALL) GROUP BY r, p),"""
    means = """
b{next} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c
  FROM b{k} b LEFT JOIN (
    SELECT p, e, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS c
    FROM (SELECT x.p, n.e, x.j, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN n{k} n ON x.r = n.r AND x.p = n.p GROUP BY ALL)) m
  ON b.p = m.p AND b.e = m.e AND b.j = m.j),"""
    rounds = "".join((nearest + means).format(k=k, next=k + 1) for k in range(ROUNDS)) + nearest.format(k=ROUNDS)
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT ((max(len(v)) + {PARTS - 1}) // {PARTS})::BIGINT AS w FROM v),
x AS MATERIALIZED (
  SELECT r, (i // w)::INTEGER AS p, (i % w)::INTEGER AS j, coalesce(v[i + 1], 0) AS x FROM v, w, (SELECT unnest(range({PARTS} * w)) AS i FROM w)),
b0 AS MATERIALIZED (SELECT p, r::INTEGER AS e, j, x AS c FROM x WHERE r < {ENTRIES}),{rounds}
c AS (
  SELECT v.vec_id, v.label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error
  FROM v JOIN n{ROUNDS} n ON v.r = n.r GROUP BY v.r, v.vec_id, v.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c
"""


OP13_SQL = _sql()
