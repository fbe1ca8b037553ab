"""Article and synthesis scans. Empty arguments mean no filter, as in a search form."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions import ranking, text as X, vectors


def search_articles(articles: DataFrame, column: str = "", bias: str = "", query: str = "", since: str = "", size: int = 100) -> DataFrame:
    """Newest articles under all given conditions; a query matches any of its tokens in the headline."""
    tests: list[Column] = []
    if column:
        tests.append(F.col("col_name") == column)
    if bias:
        tests.append(F.col("source_bias") == bias)
    if query:
        tests.append(F.arrays_overlap(X.search_tokens(F.col("headline")), X.search_tokens(F.lit(query))))
    if since:
        tests.append(F.col("pub_date") >= F.lit(since).cast("timestamp"))
    found = articles.where(functools.reduce(operator.and_, tests, F.lit(True)))
    return found.orderBy(F.desc_nulls_last("pub_date"), "id").limit(size)


def missing_embeddings(articles: DataFrame, size: int = 100) -> DataFrame:
    return articles.where(F.col("embedding").isNull()).orderBy(F.desc_nulls_last("pub_date"), "id").limit(size)


def has_embedding(articles: DataFrame) -> DataFrame:
    return articles.where(F.size("embedding") > 0)


def knn(articles: DataFrame, vector: Column, k: int = 10, column: str = "") -> DataFrame:
    """The k articles nearest to a vector by cosine: filter first, then score exactly; ties by id."""
    rows = articles.where(F.col("embedding").isNotNull())
    if column:
        rows = rows.where(F.col("col_name") == column)
    return rows.withColumn("cosine", vectors.cosine(F.col("embedding"), vector)).orderBy(F.desc("cosine"), "id").limit(k)


def is_current() -> Column:
    """Current or from before that was recorded."""
    return F.coalesce("is_current", F.lit(True))


def ranked_syntheses(syntheses: DataFrame, now: Column, column: str = "", limit: int = 20, historical: bool = False) -> DataFrame:
    rows = syntheses if historical else syntheses.where(is_current())
    if column:
        rows = rows.where(F.col("col_name") == column)
    live = ranking.live_hotness(F.col("article_count"), F.col("source_count"), F.col("median_pub_date"), now)
    return rows.withColumn("hotness", live).orderBy(F.desc("hotness"), F.desc_nulls_last("generated_at"), "story_id").limit(limit)


def count_current(syntheses: DataFrame, column: str = "") -> DataFrame:
    rows = syntheses.where(is_current())
    return (rows.where(F.col("col_name") == column) if column else rows).agg(F.count("*").alias("n"))


def synthesis_by_id(syntheses: DataFrame, story_id: str) -> DataFrame:
    return syntheses.where(F.col("story_id") == story_id)


def store_score(cosine: Column, approximate: bool = False) -> Column:
    """A hit's score as document stores give it: 1 + cosine for an exact scan, 1 / (2 - cosine) for an index of neighbours."""
    return 1 / (2 - cosine) if approximate else 1 + cosine
