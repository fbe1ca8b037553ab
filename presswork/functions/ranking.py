"""The two hotness scores: live (decides on read) and stored (written with a story)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from presswork.functions.text import hours_between


def live_hotness(article_count: Column, source_count: Column, median_pub_date: Column, now: Column) -> Column:
    """Articles per hour of age, times 1 + 0.1 for each source beyond the first; without a date there is no decay."""
    articles = F.coalesce(article_count, F.lit(1)).cast("double")
    diversity = F.lit(1.0) + F.lit(0.1) * F.greatest(F.lit(0), F.coalesce(source_count, F.lit(1)) - 1)
    age = F.greatest(F.lit(1.0), (F.unix_millis(now) - F.unix_millis(median_pub_date)) / F.lit(3.6e6))
    return F.when(median_pub_date.isNull(), articles * diversity).otherwise(articles / age * diversity)


def stored_hotness(article_count: Column, bias_count: Column, median_pub_date: Column, now: Column) -> Column:
    """As above, but by distinct biases, 0 without a date, and rounded to four digits."""
    diversity = F.lit(1.0) + F.lit(0.1) * F.greatest(F.lit(0), bias_count - 1)
    score = F.round(article_count / hours_between(now, median_pub_date) * diversity, 4)
    return F.when(median_pub_date.isNull(), F.lit(0.0)).otherwise(score)
