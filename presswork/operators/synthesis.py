"""Writing about stories: prompt text, answers of a text model, embeddings. Models are providers; the defaults need no service."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from presswork import schema
from presswork.functions import text as X
from presswork.operators import cluster

ANSWER = "headline string, article string, analysis string"
TEMPLATE_CHARS = 200


class TextProvider(Protocol):
    def complete(self, prompt: str) -> str: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ExtractiveText:
    """Answers with the prompt's own first lines."""

    def complete(self, prompt: str) -> str:
        lines = [x.strip() for x in prompt.splitlines() if x.strip() and not x.startswith("###")]
        head = re.sub(r"^\*\*.*?\*\*: ", "", lines[0]) if lines else ""
        return "```json\n" + json.dumps({"headline": head[:120], "article": "\n".join(lines[:5]), "analysis": f"{len(lines)} lines of coverage"}) + "\n```"


class HashedWords:
    """Unit vectors of hashed bags of words."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                row[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % self.width] += 1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0).tolist()


def prompt_blocks(articles: DataFrame, keys: list[str]) -> DataFrame:
    """The source text of each story: a section per bias, left to right, articles in position order; other biases are left out."""
    order = F.array_position(F.array(*[F.lit(b) for b in schema.BIASES]), F.col("source_bias"))
    line = X.prompt_line(F.col("source_name"), F.col("headline"), F.col("summary"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("t")))), lambda s: s["t"]), "\n")
    sections = articles.where(F.col("source_bias").isin(*schema.BIASES)).groupBy(*keys, "source_bias").agg(lines.alias("lines"))
    section = F.struct(order.alias("o"), F.concat(F.lit("### "), X.bias_label(F.col("source_bias")), F.lit("\n"), F.col("lines")).alias("t"))
    return sections.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda s: s["t"]), "\n\n").alias("prompt"))


def fits(prompt: Column, budget: int, system_chars: int = 0) -> Column:
    return X.token_estimate(F.length(prompt) + F.lit(system_chars)) + F.lit(int(TEMPLATE_CHARS / 3.5)) <= F.lit(budget)


def budget_prompts(articles: DataFrame, keys: list[str], budget: int, system_chars: int = 0) -> DataFrame:
    """Each story's prompt within the token budget: all articles, else the largest cap per bias that fits, else the first per bias.

    Caps from 1 to 20 are tried at once, for the stories over the budget only.
    """
    full = prompt_blocks(articles, keys).withColumn("ok", fits(F.col("prompt"), budget, system_chars))
    rows = articles.join(full.where("not ok").select(*keys), keys, "left_semi")
    known = F.col("source_bias").isin(*schema.BIASES)
    buckets = rows.where(known).groupBy(*keys).agg(F.count_distinct("source_bias").alias("buckets"))
    most = F.least(F.greatest(F.lit(1), F.floor(F.lit(budget) / (F.col("buckets") * 200))), F.lit(20))
    places = cluster.representative_places(rows.where(known), [*keys, "source_bias"]).join(buckets, keys)
    capped = places.withColumn("cap", F.explode(F.sequence(F.lit(1), most.cast("int")))).withColumn("_place", cluster.place_under(F.col("cap"))).where("_place is not null")
    first = places.where("in_order = 1").withColumns({"cap": F.lit(0), "_place": F.lit(1)})
    chosen = capped.unionByName(first).select("id", "cap", "_place")
    texts = rows.drop("position", "cap").join(chosen, "id").withColumnRenamed("_place", "position")
    tried = prompt_blocks(texts, [*keys, "cap"]).where((F.col("cap") == 0) | fits(F.col("prompt"), budget, system_chars))
    best = tried.groupBy(*keys).agg(F.max_by("prompt", "cap").alias("prompt"), F.max("cap").alias("cap"))
    return full.where("ok").select(*keys, "prompt", F.lit(None).cast("int").alias("cap")).unionByName(best)


def with_retries(model: TextProvider, prompt: str, attempts: int = 3, delay: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """A model's answer; after an error it is reloaded, if it can be, and asked again ``delay`` seconds later for each attempt made."""
    for attempt in range(1, attempts + 1):
        try:
            return model.complete(prompt)
        except Exception:  # whatever a service may raise
            if attempt == attempts:
                raise
            if hasattr(model, "reload"):
                model.reload()
            sleep(delay * attempt)
    raise ValueError("there must be one attempt at least")


def answers(prompts: DataFrame, key: str, provider: Callable[[], TextProvider] = ExtractiveText, attempts: int = 3, delay: float = 10.0) -> DataFrame:
    """``key, first, second, error``: two calls a story. A story whose calls keep failing has an error and no answers; the others go on."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf["prompt"]):
                try:
                    first = with_retries(model, p, attempts, delay)
                    out.append((k, first, with_retries(model, p + "\n\n" + first, attempts, delay), None))
                except Exception as e:
                    out.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "first", "second", "error"])

    return prompts.select(key, "prompt").mapInPandas(call, f"{key} {dict(prompts.dtypes)[key]}, first string, second string, error string")


def parsed(raw: DataFrame, key: str) -> DataFrame:
    """Headline, article and analysis; a story whose answer lacks one is left out."""
    rows = raw.where("error is null").select(key, X.parse_json(F.col("first"), ANSWER).alias("a"), X.parse_json(F.col("second"), ANSWER).alias("b"))
    return rows.where("a.headline is not null and a.article is not null and b.analysis is not null").select(
        key, F.col("a.headline").alias("generated_headline"), F.col("a.article").alias("article"), F.col("b.analysis").alias("analysis")
    )


def synthesize(prompts: DataFrame, key: str, provider: Callable[[], TextProvider] = ExtractiveText, attempts: int = 3, delay: float = 10.0) -> DataFrame:
    """Article and analysis of each prompt; a story that fails, or whose answer lacks its fields, is left out."""
    return parsed(answers(prompts, key, provider, attempts, delay), key)


def embed_list(articles: list[dict], provider: Callable[[], EmbeddingProvider] = HashedWords, batch: int = 32) -> list[list[float] | None]:
    """Vectors of given articles (``headline``, ``summary``), in their order; none where the model gave none."""
    texts = [a["headline"] + ("\n\n" + a["summary"] if a.get("summary") else "") for a in articles]
    model, made = provider(), []
    for at in range(0, len(texts), batch):
        got = model.embed(texts[at : at + batch])
        made += [*got, *[None] * (len(texts[at : at + batch]) - len(got))]
    return made[: len(texts)]


def healthy(provider: Callable[[], object]) -> bool:
    """Whether a provider answers: its own check if it has one, else one short call."""
    try:
        model = provider()
        if hasattr(model, "healthy"):
            return bool(model.healthy())
        return bool(model.complete("ping") if hasattr(model, "complete") else model.embed(["ping"]))
    except Exception:  # whatever a service may raise
        return False


def embed_missing(articles: DataFrame, provider: Callable[[], EmbeddingProvider] = HashedWords, limit: int | None = None, batch: int = 32) -> DataFrame:
    """``id, embedding`` of articles without a vector, newest first up to ``limit``; one pass. A short answer gives nulls."""
    rows = articles.where(F.col("embedding").isNull())
    rows = rows.select("id", "pub_date", X.embedding_text(F.col("headline"), F.col("summary")).alias("text"))
    if limit is not None:
        rows = rows.orderBy(F.desc_nulls_last("pub_date"), "id").limit(limit)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            made: list = []
            for at in range(0, len(pdf), batch):
                part = pdf["text"].iloc[at : at + batch].tolist()
                got = model.embed(part)
                made += [*got, *[None] * (len(part) - len(got))][: len(part)]
            yield pd.DataFrame({"id": pdf["id"], "embedding": made})

    return rows.select("id", "text").mapInPandas(call, "id string, embedding array<double>")


def markdown(syntheses: DataFrame) -> DataFrame:
    """``story_id, markdown``."""
    bias = F.array_join(F.transform(F.map_entries("bias_coverage"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
    n = F.size("sources_used")
    sources = F.concat(F.array_join(F.slice("sources_used", 1, 10), ", "), F.when(n > 10, F.concat(F.lit(" (+"), (n - 10).cast("string"), F.lit(" more)"))).otherwise(""))
    # fixed values: the strings of the output format
    parts = ["## ", F.col("generated_headline"), "\n\n", F.col("article"), "\n\n### Coverage Analysis\n", F.col("analysis"), "\n\n---\n**Sources:** ", sources,
             "\n**Bias Coverage:** ", bias, "\n**Articles:** ", F.col("article_count").cast("string"), "\n"]
    return syntheses.select("story_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("markdown"))
