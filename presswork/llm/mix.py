"""Mixing sources to target weights.

Tokens are aggregated per source, a repetition rate is derived for each, and every document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy with probability equal to the fraction. Column expressions only.

Targets are found by water-filling: a source may not exceed ``max_repeats`` times its size, and what it cannot take goes to
the others by weight. With sources ordered by size over weight, the capped ones are a prefix, so prefix sums give the level.

A fair coin per document leaves small sources with heavy-tailed documents far from their target. So each source draws
with the best of ``SEEDS`` seeds: one aggregation sums the words that every seed would take, and the seed whose sum is
nearest to the target is used. Every document still has a hash-seeded coin of the right probability, reruns agree, and no text is
shuffled.

Nulls and edges: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id is replaced by a hash of
the text; repeated rows share one coin; empty tables give empty results; other columns are kept untouched by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from presswork.llm.common import broadcast_if_small, table, word_count
from presswork.session import checkpoint

WEIGHTS, SHARE_PERCENT, MAX_REPEATS = (3, 1, 2), 150, 2
SEEDS = 32
#: The largest prime below 2**28; coins are residues of a + seed * b for two 28-bit parts of a digest.
PRIME = 268435399
SALTS = 16


def _hex(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 7), 16, 10).cast("long")


def _coin(seed: Column | int) -> Column:
    """A number in [0, 1) from the document's digest and a seed."""
    return F.pmod(F.col("_pw_a") + F.lit(seed) * F.col("_pw_b"), F.lit(PRIME)) / F.lit(float(PRIME))


def with_measures(docs: DataFrame) -> DataFrame:
    """Add a document's size in words and the two parts of its digest."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    return (
        docs.withColumn("_pw_size", word_count(F.col("text")))
        .withColumn("_pw_digest", digest)
        .withColumns({"_pw_a": _hex(F.col("_pw_digest"), 1), "_pw_b": _hex(F.col("_pw_digest"), 9)})
        .drop("_pw_digest")
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``(source, source_size, target)`` for ``(source, source_size)``: one row a source, so one task orders them.

    The weights repeat along the sources by code point, null last. Amounts are kept as integers, times 100 and the weight's
    cofactor, until one division; ``share_percent`` must not exceed 100 * ``max_repeats``.
    """
    if share_percent > 100 * max_repeats:
        raise ValueError("the share exceeds what the sources can give")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    weighed = sizes.withColumn("_w", weight)
    cap = 100 * max_repeats * F.col("source_size")
    fill = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share_percent * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rest = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = weighed.select("source", "source_size", "_w", left.alias("_left"), rest.alias("_rest"), cap.alias("_cap")).withColumn(
        "_level", F.when(F.col("_w") * F.col("_left").cast("double") <= F.col("_cap").cast("double") * F.col("_rest"), F.col("_left") / F.col("_rest"))
    )
    share = F.col("_w") * F.min_by("_level", F.when(F.col("_level").isNotNull(), F.col("source_size") / F.col("_w"))).over(Window.partitionBy()) / F.lit(100.0)
    return level.select("source", "source_size", F.coalesce(F.least(share, F.lit(float(max_repeats)) * F.col("source_size")), F.lit(0.0)).alias("target"))


def source_rates(measured: DataFrame, **limits) -> DataFrame:
    """``(source, source_size, target, whole, fraction, seed)``, from narrow rows with measures."""
    measured = measured.select("source", "_pw_size", "_pw_a", "_pw_b")
    sizes = measured.groupBy("source").agg(F.sum("_pw_size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = checkpoint(
        source_targets(sizes, **limits)
        .withColumn("_rate", rate)
        .select("source", "source_size", "target", F.floor("_rate").alias("whole"), (F.col("_rate") - F.floor("_rate")).alias("fraction"))
    )
    drawn = attach(measured, rates).groupBy("source").agg(
        *[F.sum(F.when(_coin(s) < F.col("fraction"), F.col("_pw_size")).otherwise(0)).alias(f"_s{s}") for s in range(SEEDS)],
    )
    need = F.col("target") - F.col("whole") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_s{s}") - need).alias("off"), F.lit(s).cast("long").alias("seed")) for s in range(SEEDS)]))
    chosen = drawn.withColumnRenamed("source", "_source")
    return checkpoint(
        rates.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).withColumn("seed", best["seed"]).select("source", "source_size", "target", "whole", "fraction", "seed")
    )


def attach(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Join each row to its source's rates: by broadcast while a count shows few sources, else on salted sources."""
    right = rates.withColumnsRenamed({"source": "_pw_source"})
    keep = [c for c in right.columns if c != "_pw_source"]
    right, small = broadcast_if_small(right)
    on = F.col("source").eqNullSafe(F.col("_pw_source"))
    if small:
        return rows.join(right, on).select(*[rows[c] for c in rows.columns], *keep)
    salted = right.withColumn("_pw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_pw_mine", F.pmod(F.hash("_pw_a", "_pw_b"), F.lit(SALTS)))
    return left.join(salted, on & (F.col("_pw_mine") == F.col("_pw_salt"))).select(*rows.columns, *keep)


def copies() -> Column:
    """How often a row with measures and rates is emitted."""
    return F.col("whole") + (_coin(F.col("seed")) < F.col("fraction")).cast("long")


def mix(docs: DataFrame, **limits) -> DataFrame:
    """The mixed documents: each row as often as its source's rate asks, with the columns of ``docs``."""
    narrow = checkpoint(with_measures(docs).select("source", "_pw_size", "_pw_a", "_pw_b"))
    rates = source_rates(narrow, **limits).withColumnsRenamed({c: f"_pw_{c}" for c in ("source_size", "target")}).select("source", "whole", "fraction", "seed")
    names = {c: f"_pw_own_{c}" for c in docs.columns if c in ("whole", "fraction", "seed")}
    rows = with_measures(docs.withColumnsRenamed(names))
    taken = attach(rows, rates).withColumn("_pw_copies", copies().cast("int"))
    emitted = taken.where("_pw_copies > 0").withColumn("_pw_copy", F.explode(F.sequence(F.lit(1), F.col("_pw_copies"))))
    return emitted.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = checkpoint(with_measures(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_pw_size", "_pw_a", "_pw_b"))
    return attach(narrow, source_rates(narrow)).select(
        "doc_id", F.col("_pw_size").alias("size"), "source", "source_size", "target", (F.col("_pw_size") * copies()).alias("taken")
    )


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest
  FROM documents),
m AS (SELECT doc_id, source, size, ('0x' || substr(digest, 1, 7))::BIGINT AS a, ('0x' || substr(digest, 9, 7))::BIGINT AS b FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS w FROM s),
f AS (
  SELECT *, 150 * sum(source_size) OVER () - coalesce(sum(200 * source_size) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM w),
l AS (SELECT rest_words::DOUBLE / rest_w::DOUBLE AS level FROM f WHERE w * rest_words::DOUBLE <= (200 * source_size)::DOUBLE * rest_w
      ORDER BY source_size::DOUBLE / w LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(w * (SELECT level FROM l) / 100.0::DOUBLE, 2.0::DOUBLE * source_size), 0.0::DOUBLE) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
p AS (SELECT source, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction FROM r),
e AS (
  SELECT p.source, k.seed, any_value(p.target - p.whole * p.source_size) AS need,
         sum(CASE WHEN ((m.a + k.seed * m.b) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE < p.fraction THEN m.size ELSE 0 END) AS words
  FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT unnest(range(0, {SEEDS})) AS seed) k GROUP BY p.source, k.seed),
c AS (SELECT source, seed FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(words - need), seed) = 1)
SELECT m.doc_id, m.size, m.source, p.source_size, p.target,
       (m.size * (p.whole + CASE WHEN ((m.a + c.seed * m.b) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE < p.fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source JOIN c ON m.source IS NOT DISTINCT FROM c.source
"""
