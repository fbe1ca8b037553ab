"""The article table and what derives from it, over the generic test tables.

Every document is an article of a column; events give its date and embeddings its vector. The clock is explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork import schema
from presswork.functions import text as X

#: The clock of all registered queries.
NOW = "2024-02-01 00:00:00"


def now(at: str = NOW) -> Column:
    return F.lit(at).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_bias(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in schema.BIASES]), F.least(F.floor(number / 4), F.lit(4)).cast("int") + 1)


def planted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, vector``: vectors pulled towards the first vector of their label. There are few labels, so the anchors are broadcast."""
    e = table(spark, sf_dir, "embeddings")
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("av"))
    mixed = F.zip_with("av", "embedding", lambda x, y: F.lit(0.9) * x.cast("double") + F.lit(0.45) * y.cast("double"))
    return e.join(F.broadcast(anchors), "label").select("vec_id", "label", mixed.alias("vector"))


def articles(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    dates = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("pub_date")).where("event_id % 5 = 0")
    dates = dates.select(F.expr("event_id div 5").alias("doc_id"), "pub_date")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    columns = F.array(*[F.lit(c) for c in schema.COLUMNS])
    out = docs.join(dates, "doc_id", "left").select(
        F.md5(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"),
        "doc_id",
        F.col("source").alias("source_slug"),
        F.concat(F.lit("Source "), number.cast("string")).alias("source_name"),
        source_bias(number).alias("source_bias"),
        F.element_at(columns, (F.col("doc_id") % 5 + 1).cast("int")).alias("col_name"),
        X.truncate(F.col("text"), 80).alias("headline"),
        X.truncate(F.col("text"), 2000).alias("summary"),
        F.concat(F.lit("https://news.example/"), F.md5("text")).alias("url"),
        "pub_date",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://img.example/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_url"),
    )
    if not vectors:
        return out
    v = planted_vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "label", F.col("vector").alias("embedding"))
    return out.join(v, "doc_id", "left")


#: The same view for the SQL oracle, as the head of a WITH clause.
SQL = """WITH anchors AS (SELECT label, arg_min(embedding, vec_id) AS av FROM embeddings GROUP BY label),
vectors AS (SELECT vec_id, e.label, list_transform(range(1, 65), lambda i: 0.9::DOUBLE * a.av[i] + 0.45::DOUBLE * e.embedding[i]) AS embedding
            FROM embeddings e JOIN anchors a USING (label)),
numbered AS (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INTEGER AS number FROM documents),
articles AS (
  SELECT md5('doc-' || d.doc_id) AS id, d.doc_id, d.source AS source_slug, 'Source ' || number AS source_name,
         (['left', 'lean-left', 'center', 'lean-right', 'right'])[least(number // 4, 4) + 1] AS source_bias,
         (['politics', 'tech', 'money', 'sports', 'lifestyle'])[d.doc_id % 5 + 1] AS col_name,
         substr(text, 1, 80) AS headline, substr(text, 1, 2000) AS summary, 'https://news.example/' || md5(text) AS url, ts AS pub_date,
         CASE WHEN d.doc_id % 3 = 0 THEN 'https://img.example/' || d.doc_id || '.jpg' END AS image_url, label, embedding
  FROM numbered d LEFT JOIN events ON event_id = 5 * d.doc_id LEFT JOIN vectors ON vec_id = d.doc_id)
"""
NOW_SQL = f"TIMESTAMP '{NOW}'"
