"""Stories: one row per group of articles, with derived attributes.

All attributes come from one aggregation on the story's key; lists are ordered by an explicit position. A story is
bounded by what an editorial column publishes about one event, so its lists are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork import schema
from presswork.functions import ranking, text as X

def with_position(articles: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("pub_date"), "id")
    return articles.withColumn("position", F.row_number().over(order))


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted non-null values; null if there is none."""
    ordered = F.array_sort(F.array_compact(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def image_rank(bias: Column) -> Column:
    """Place in the preference of hero images; unknown biases come last."""
    place = F.array_position(F.array(*[F.lit(b) for b in schema.IMAGE_PREFERENCE]), F.coalesce(bias, F.lit("")))
    return F.when(place > 0, place).otherwise(len(schema.IMAGE_PREFERENCE) + 1)


def article_refs(*, order: str = "position") -> Column:
    """The references of a story's articles, in order."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    ref = F.struct(blank("url"), blank("headline"), blank("source_name"), blank("source_slug"), blank("source_bias"), F.col("image_url"))
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), ref.alias("ref")))), lambda x: x["ref"])


def stories(articles: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """One row per key with every derived attribute."""
    rows = with_position(articles, keys)
    bias = F.coalesce("source_bias", F.lit("unknown"))
    has_image = F.coalesce("image_url", F.lit("")) != ""
    grouped = rows.groupBy(*keys).agg(
        F.min_by("id", "position").alias("first_id"),
        F.min_by("headline", "position").alias("headline"),
        F.count("*").cast("int").alias("article_count"),
        F.size(F.collect_set(F.coalesce("source_slug", F.lit("")))).alias("source_count"),
        F.size(F.collect_set(bias)).alias("bias_count"),
        F.array_sort(F.collect_set("source_name")).alias("sources_used"),
        F.array_sort(F.collect_list(F.when(F.coalesce("url", F.lit("")) != "", F.col("url")))).alias("article_urls"),
        upper_median(F.collect_list("pub_date")).alias("median_pub_date"),
        F.min("pub_date").alias("first_pub_date"),
        F.max("pub_date").alias("last_pub_date"),
        F.min_by(F.when(has_image, F.struct("image_url", "source_name")), F.when(has_image, F.struct(image_rank(F.col("source_bias")), F.col("position")))).alias("_hero"),
        F.array_sort(F.collect_list(bias)).alias("_biases"),
        article_refs().alias("articles"),
    )
    spread = F.map_from_entries(F.transform(F.array_distinct("_biases"), lambda b: F.struct(b, F.size(F.filter("_biases", lambda x: x == b)).cast("long"))))
    return grouped.select(
        X.story_id(F.col("first_id")).alias("story_id"), *keys, "headline", "article_count", "source_count", "bias_count", "sources_used",
        spread.alias("bias_coverage"), "article_urls", F.col("_hero.image_url").alias("hero_image_url"), F.col("_hero.source_name").alias("hero_image_source"),
        "median_pub_date", "first_pub_date", "last_pub_date",
        ranking.stored_hotness(F.col("article_count"), F.col("bias_count"), F.col("median_pub_date"), now).alias("hotness_score"), "articles",
    )


def multi_source(stories_: DataFrame, least: int = 2) -> DataFrame:
    return stories_.where(F.col("source_count") >= least)


def by_bias(articles: DataFrame, keys: list[str]) -> DataFrame:
    """Lists of articles per story and bias, in position order."""
    rows = with_position(articles, keys).withColumn("bias", F.coalesce("source_bias", F.lit("unknown")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"])
    return rows.groupBy(*keys, "bias").agg(F.count("*").alias("n"), ids.alias("ids"))
