"""The registry of sources: a small static table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork import schema


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a registry from YAML (a list under ``sources``), if a YAML reader is installed, or from JSON lines.

    The file goes through Spark's readers, so it may lie in any store. An entry without ``active`` is active.
    """
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a registry is a small configuration file
    if path.endswith((".yaml", ".yml")):
        import yaml

        entries = yaml.safe_load(text)["sources"]
    else:
        import json

        entries = [json.loads(line) for line in text.splitlines() if line.strip()]
    return from_entries(spark, entries)


def from_entries(spark: SparkSession, entries: list[dict]) -> DataFrame:
    names = schema.SOURCES.fieldNames()
    rows = [tuple(e.get("column") if n == "col_name" and "col_name" not in e else e.get(n, True if n == "active" else None) for n in names) for e in entries]
    return spark.createDataFrame(rows, schema.SOURCES)


def demo(spark: SparkSession) -> DataFrame:
    """The registry of the test sources: src0 to src19, two inactive, one scraped, one without a feed."""
    n = F.col("id").cast("int")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    slug = F.concat(F.lit("src"), n.cast("string"))
    return spark.range(20).select(
        F.concat(F.lit("Source "), n.cast("string")).alias("name"), slug.alias("slug"),
        F.when(n != 7, F.concat(F.lit("https://feeds.example/"), slug)).alias("rss_url"),
        F.when(n == 5, "scrape").otherwise("rss").alias("fetch_method"),
        pick(schema.COLUMNS, n % 5).alias("col_name"), pick(schema.BIASES, F.floor(n / 4)).alias("bias"), (~n.isin(3, 11)).alias("active"),
    )


def is_active_feed() -> Column:
    return F.col("active") & (F.col("fetch_method") == "rss")


def active_feeds(sources: DataFrame) -> DataFrame:
    return sources.where(is_active_feed())
