"""One object for the whole surface: ingest, search, cluster, rank, de-duplicate, write, export.

Tables are Parquet folders below one root. Reads give lazy frames; writes give a summary. The clock is an argument everywhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from presswork import schema
from presswork.config import Settings
from presswork.functions import text as X
from presswork.operators import cluster, dedup, pages, rank, search, stories as S, store, synthesis
from presswork.session import checkpoint
from presswork.sources import dumps, feeds, registry

KEYS = ["col_name", "story_key"]
TABLE_KEYS = (("articles", "id"), ("syntheses", "story_id"))


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, text: Callable = synthesis.ExtractiveText, vectors: Callable = synthesis.HashedWords,
        context: int | None = None, max_tokens: int | None = None, settings: Settings = Settings(),
    ):
        self.spark, self.root, self.text, self.vectors, self.settings = spark, root.rstrip("/"), text, vectors, settings
        self.budget = X.prompt_budget(context or settings.context, max_tokens or settings.max_tokens)

    # tables

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str) -> DataFrame | None:
        store.recover(self.spark, self._path(name))
        try:
            return self.spark.read.parquet(self._path(name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def tables(self, pattern: str = "*") -> list[str]:
        """Names of the stored tables that match a pattern; the counter of editions is none."""
        return [t for t in store.tables(self.spark, self.root, pattern) if t != "edition"]

    def articles(self, month: str | None = None) -> DataFrame:
        """Stored articles; those of one partition if a month is given."""
        rows = self._read("articles")
        if rows is None:
            raise LookupError("no articles are stored")
        return rows.where(F.col("ym") == month) if month else rows

    def syntheses(self) -> DataFrame:
        store.ensure_table(self.spark, self._path("syntheses"), schema.SYNTHESIS)
        return self._read("syntheses")

    def edition(self) -> int:
        return max(store.editions(self.spark, self._path("edition")), default=0)

    def health(self) -> dict[str, bool]:
        """Whether the store can be reached and the models answer."""
        try:
            fs, at = store.file_system(self.spark, self.root)
            reached = bool(fs.exists(at(self.root)) or fs.mkdirs(at(self.root)))
        except Exception:  # whatever a store may raise
            reached = False
        return {"store": reached, "embeddings": synthesis.healthy(self.vectors), "text": synthesis.healthy(self.text)}

    # ingest

    def fetch(self, sources: DataFrame, now: Column, get: Callable[[str], str] | None = None) -> dict[str, int]:
        """Fetch active feeds and store what is new in the run's month; counts of distinct URLs, rows written and rejected items."""
        wait, agent = self.settings.fetch_timeout, self.settings.user_agent
        raw = checkpoint(feeds.fetch(registry.active_feeds(sources), get or (lambda url: feeds.http_get(url, wait, agent))))
        items = feeds.parse(raw.where("error is null"))
        good, bad = feeds.normalise(items, sources, now)
        return self.ingest(good.drop("position"), now) | {"rejected": bad.count(), "failed_sources": raw.where("error is not null").count()}

    def ingest(self, articles: DataFrame, now: Column) -> dict[str, int]:
        """Append articles whose URL the run's month doesn't hold yet."""
        rows = articles if "embedding" in articles.columns else articles.withColumn("embedding", F.lit(None).cast("array<double>"))
        month = self.spark.range(1).select(X.month_key(now)).first()[0]
        stored = self._read("articles")
        known = rows.select("url").limit(0) if stored is None else stored.where(F.col("ym") == month).select("url")
        fresh = checkpoint(dedup.first_by(rows.join(known.distinct(), "url", "left_anti"), "url", F.asc("id")).select(*rows.columns))
        store.write_articles(fresh, self._path("articles"), now)
        return {"seen": rows.select("url").distinct().count(), "written": fresh.count()}

    def embed(self, limit: int | None = None, batch: int | None = None) -> int:
        """Fill in missing vectors, newest first; rows that the model leaves out stay without. Only months that get a vector are written."""
        rows = self.articles()
        made = checkpoint(synthesis.embed_missing(rows, self.vectors, limit, batch or self.settings.embed_batch))
        store.update_partitions(self.spark, self._path("articles"), made, "id", "embedding", "ym")
        return made.where("embedding is not null").count()

    # reads

    def search(self, **conditions) -> DataFrame:
        self._known(conditions.get("column", ""))
        return search.search_articles(self.articles(), **conditions)

    def knn(self, vector: list[float], k: int = 10, column: str = "") -> DataFrame:
        self._known(column)
        return search.knn(self.articles(), F.array(*[F.lit(float(x)) for x in vector]), k, column)

    def stories(self, now: Column, scan: int | None = None) -> DataFrame:
        """Clustered stories of all columns, as one job."""
        rows = self.articles()
        keyed = cluster.story_keys(rows, scan=scan or self.settings.scan).select("id", "story_key")
        return S.stories(rows.join(keyed, "id"), KEYS, now)

    @staticmethod
    def columns() -> list[str]:
        return list(schema.COLUMNS)

    @staticmethod
    def _known(column: str) -> None:
        if column and column not in schema.COLUMNS:
            raise LookupError(f"there is no column {column}")

    def ranked(self, now: Column, column: str = "", limit: int = 20, historical: bool = False) -> DataFrame:
        self._known(column)
        return search.ranked_syntheses(self.syntheses(), now, column, limit, historical)

    def front_page(self, now: Column) -> DataFrame:
        rows = self.syntheses().where(search.is_current()).withColumnRenamed("hotness_score", "stored_hotness")
        return rank.front_page(rank.with_hotness(rows, now))

    def story(self, story_id: str) -> DataFrame:
        """A story's row; raises if there is none."""
        found = search.synthesis_by_id(self.syntheses(), story_id)
        if found.isEmpty():
            raise LookupError(f"there is no story {story_id}")
        return found

    def neighbours(self, story_id: str, now: Column) -> DataFrame:
        """The stories before and after a story in its column."""
        rows = rank.with_hotness(self.syntheses().where(search.is_current()), now)
        column = self.story(story_id).first().col_name
        return rank.navigation(rows.where(F.col("col_name") == column)).where(F.col("story_id") == story_id)

    def about(self) -> dict[str, object]:
        return {"text": pages.ABOUT, "edition": self.edition() or 1}

    def plot(self, column: str = "") -> DataFrame:
        """The table of a scatter plot of stories."""
        self._known(column)
        rows = search.has_embedding(self.articles())
        rows = rows.where(F.col("col_name") == column) if column else rows
        return cluster.plot_table(rows, cluster.story_keys(rows, scan=self.settings.scan))

    def render(self, path: str, now: Column, clean: bool = False) -> int:
        """Write the pages of the current edition; returns their number."""
        return pages.write(pages.site(checkpoint(self.syntheses()), now, self.edition()), path, clean)

    # writing

    def _written(self, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Texts of chosen stories, and the ids of those that failed or lack a field."""
        rows = self.articles().drop("position").join(chosen.select("story_id", "col_name", F.posexplode("article_urls").alias("position", "url")), ["col_name", "url"])
        prompts = synthesis.budget_prompts(rows, ["story_id"], self.budget)
        raw = checkpoint(synthesis.answers(prompts, "story_id", self.text, self.settings.attempts, self.settings.retry_seconds))
        good = checkpoint(synthesis.parsed(raw, "story_id"))
        return good, checkpoint(chosen.select("story_id").join(good, "story_id", "left_anti"))

    def _complete(self, stories: DataFrame, written: DataFrame, number: int, now: Column) -> DataFrame:
        made = stories.withColumnRenamed("headline", "original_headline").join(written, "story_id").withColumns({"edition": F.lit(number), "generated_at": now})
        return checkpoint(store.fill_defaults(made, now))

    def _limited(self, found: DataFrame, limit: int | None) -> DataFrame:
        if limit is None:
            return found
        by_size = Window.partitionBy("col_name").orderBy(F.desc("article_count"), "story_id")
        return checkpoint(found.withColumn("_rn", F.row_number().over(by_size)).where(F.col("_rn") <= limit).drop("_rn"))

    def run_cycle(self, now: Column, limit: int | None = None) -> dict[str, float]:
        """Cluster, decide, write and supersede: one edition over all columns.

        A story is left out if it is unchanged, or overlaps a larger one that this run writes. Unchanged stories are not written, so they hide
        no other; nor do stories whose text fails: what they alone kept out is written in another pass.
        """
        began = time.monotonic()
        number = store.claim_edition(self.spark, self._path("edition"))
        found = self._limited(checkpoint(S.multi_source(self.stories(now))), limit)
        current = checkpoint(self.syntheses())
        decided = checkpoint(dedup.decide(found, current).where("action <> 'skip'").select("story_id", "existing_id", "action"))
        open_ = checkpoint(found.join(decided.select("story_id"), "story_id", "left_semi"))
        failed = open_.select("story_id").limit(0)
        written: DataFrame | None = None
        while True:
            kept = dedup.greedy_batch(open_.join(failed, "story_id", "left_anti")).where("not dropped").select("story_id")
            todo = checkpoint(open_.join(kept if written is None else kept.join(written, "story_id", "left_anti"), "story_id", "left_semi"))
            if written is not None and todo.isEmpty():
                break
            good, bad = self._written(todo)
            written = good if written is None else checkpoint(written.unionByName(good))
            if bad.isEmpty():
                break
            failed = checkpoint(failed.unionByName(bad))
        kept = dedup.greedy_batch(open_.join(failed, "story_id", "left_anti")).where("not dropped").select("story_id")
        made = self._complete(open_, written.join(kept, "story_id", "left_semi"), number, now)
        pairs = decided.where("action = 'evolve'").join(made.select("story_id"), "story_id", "left_semi").select(F.col("existing_id").alias("old_id"), F.col("story_id").alias("new_id"))
        whole = store.upsert(store.supersede(current, pairs), made, "story_id", F.desc("generated_at"))
        store.replace_table(whole, self._path("syntheses"))
        counts = {"stories": found.count(), "written": made.count(), "failed": failed.count(), "superseded": pairs.count()}
        skipped = counts["stories"] - counts["written"] - counts["failed"]
        return {"edition": number} | counts | {"skipped": skipped, "seconds": round(time.monotonic() - began, 3)}

    def write_column(self, column: str, now: Column, limit: int | None = 5, min_cluster: int = cluster.MIN_CLUSTER, keep: bool = True) -> DataFrame:
        """Texts of the largest stories of one column, or of each, without a look at earlier ones; stored if ``keep``."""
        self._known(column)
        rows = self.articles()
        rows = rows.where(F.col("col_name") == column) if column else rows
        keyed = cluster.story_keys(rows, scan=self.settings.scan, min_cluster=min_cluster).select("id", "story_key")
        found = self._limited(checkpoint(S.multi_source(S.stories(rows.join(keyed, "id"), KEYS, now))), limit)
        good, _ = self._written(found)
        made = self._complete(found, good, self.edition() or 1, now)
        if keep:
            store.replace_table(store.upsert(checkpoint(self.syntheses()), made, "story_id", F.desc("generated_at")), self._path("syntheses"))
        return made

    def dedup(self, now: Column, apply: bool = False, column: str = "") -> DataFrame:
        """Flags of near-identical headlines among current syntheses; ``apply`` removes what isn't kept."""
        self._known(column)
        rows = self.syntheses()
        chosen = rows.where(search.is_current() & (F.col("col_name") == column)) if column else rows.where(search.is_current())
        named = chosen.select(
            F.xxhash64("story_id").alias("id"), "story_id", "col_name", F.col("generated_headline").alias("headline"), "article_count", "source_count", "median_pub_date"
        )
        flagged = checkpoint(dedup.keep_best(dedup.headline_groups(named), now))
        if apply:
            store.replace_table(store.delete_ids(rows, flagged.where("not keep"), "story_id"), self._path("syntheses"))
        return flagged

    def dedup_report(self, now: Column, apply: bool = False, column: str = "") -> DataFrame:
        """Kept and removed rows per column and in total."""
        return dedup.dedup_report(self.dedup(now, apply, column)).orderBy("is_total", "col_name")

    def export(self, name: str, path: str, key: str | None = None) -> int:
        """Write a table as JSON lines; its key is that of the table if none is given. Returns the number of rows."""
        rows = self._read(name)
        if rows is None:
            raise LookupError(f"there is no table {name}")
        dumps.export(rows, path, key or dict(TABLE_KEYS).get(name, rows.columns[0]))
        return rows.count()

    def dumps(self, path: str, pattern: str = "*") -> list[str]:
        """Names of the dumps in a folder that match a pattern."""
        return store.tables(self.spark, path.rstrip("/"), pattern)

    def import_(self, name: str, path: str, clear: bool = False) -> int:
        """Bring a dump into a table; rows with the same key are replaced. Returns the number of its rows."""
        month = "ym" if "ym" in dumps.mapping(self.spark, path)[0].fieldNames() else None
        return dumps.load(self.spark, path, self._path(name), clear, month)
