"""HTML pages as rows ``(path, html)``; executors write them, the driver puts them in their places.

A site has one page a story, of at most ``STORIES`` a column, and a handful of others, so it is bounded.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from presswork import schema
from presswork.functions import text as X
from presswork.functions.markdown import commonmark_html
from presswork.operators import rank, search
from presswork.session import checkpoint

STORIES, PER_COLUMN, PER_FRONT = 100, 20, 3
TITLE = "Presswork"
ABOUT = "Stories are groups of articles from sources across the spectrum. Each page names its sources and shows how coverage is spread."


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def shell(title: Column, body: Column, now: Column, edition: int) -> Column:
    """A whole page around a body: head, links to the columns, dateline and edition."""
    links = "".join(f'<a href="/column/{c}/">{c.capitalize()}</a>' for c in schema.COLUMNS)
    return _cat(
        "<!DOCTYPE html>\n<html lang=\"en\"><head><meta charset=\"utf-8\"><title>", X.escape_html(title), f"</title></head>\n<body><header><a href=\"/\">{TITLE}</a><nav>{links}",
        '<a href="/about/">About</a></nav><p>', X.dateline(now), f" &middot; Edition {edition or 1}</p></header>\n<main>", body, "</main></body></html>\n",
    )


def _card(now: Column) -> Column:
    image = F.when(F.col("hero_image_url").isNotNull(), _cat('<img src="', X.escape_html(F.col("hero_image_url")), '" alt="">'))
    return _cat(
        '<article><a href="/story/', F.col("story_id"), '/">', image, "<h2>", X.escape_html(F.col("generated_headline")), "</h2></a><p>",
        X.escape_html(X.preview(F.coalesce("article", F.lit("")))), "</p><footer>", F.col("article_count").cast("string"), " articles &middot; ",
        X.escape_html(X.source_list(F.col("sources_used"))), " &middot; ", F.when(F.col("median_pub_date").isNotNull(), X.relative_time(now, F.col("median_pub_date"))), "</footer></article>",
    )


def _bias_bar() -> Column:
    """A bar with a part for each bias that has articles."""
    part = lambda e: F.concat(
        F.lit('<span style="background:'), X.bias_color(e["key"]), F.lit(";flex:"), e["value"].cast("string"), F.lit('" title="'), X.title_label(e["key"]), F.lit('"></span>')
    )
    return _cat('<div class="bias">', F.array_join(F.transform(F.array_sort(F.map_entries("bias_coverage")), part), ""), "</div>")


def _body(rows: DataFrame) -> Column:
    """The story's text; rows from before the field's present name have it under the former one."""
    return X.body_text(F.col("article"), F.col("summary") if "summary" in rows.columns else F.lit(None).cast("string"))


def story_pages(syntheses: DataFrame, now: Column, edition: int) -> DataFrame:
    """A page for each of the hottest current stories of each column, with links to its neighbours."""
    rows = rank.top_n(rank.with_hotness(syntheses.where(search.is_current()), now), STORIES)
    placed = rows.join(rank.navigation(rows).select("story_id", "prev_id", "next_id"), "story_id")
    link = lambda c, text: F.when(F.col(c).isNotNull(), _cat('<a href="/story/', F.col(c), f'/">{text}</a>'))
    item = lambda a: F.concat(F.lit('<li><a href="'), X.escape_html(F.coalesce(a["url"], F.lit(""))), F.lit('">'), X.escape_html(F.coalesce(a["headline"], F.lit(""))), F.lit("</a> "), X.escape_html(F.coalesce(a["source_name"], F.lit(""))), F.lit("</li>"))
    body = _cat(
        "<h1>", X.escape_html(F.col("generated_headline")), "</h1>", _bias_bar(), commonmark_html(_body(rows)), "\n<h2>Coverage</h2>",
        commonmark_html(F.coalesce("analysis", F.lit(""))), "\n<ul>", F.array_join(F.transform("articles", item), ""), "</ul><nav>", link("prev_id", "Previous"), link("next_id", "Next"), "</nav>",
    )
    return placed.select(_cat("story/", F.col("story_id"), "/index.html").alias("path"), shell(F.col("generated_headline"), body, now, edition).alias("html"))


def _listing(rows: DataFrame, keys: list[str], now: Column) -> DataFrame:
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", _card(now).alias("card")))), lambda s: s["card"]), "\n")
    return rows.groupBy(*keys).agg(cards.alias("cards"))


def column_pages(syntheses: DataFrame, now: Column, edition: int) -> DataFrame:
    """One page a column, also for columns without stories."""
    top = rank.top_n(rank.with_hotness(syntheses.where(search.is_current()), now), PER_COLUMN)
    names = syntheses.sparkSession.createDataFrame([(c,) for c in schema.COLUMNS], "col_name string")
    rows = names.join(_listing(top, ["col_name"], now), "col_name", "left")
    title = F.initcap("col_name")
    return rows.select(_cat("column/", F.col("col_name"), "/index.html").alias("path"), shell(title, _cat("<h1>", title, "</h1>", F.col("cards")), now, edition).alias("html"))


def front_page(syntheses: DataFrame, now: Column, edition: int) -> DataFrame:
    """The first stories of each column, in page order of the columns."""
    top = rank.top_n(rank.with_hotness(syntheses.where(search.is_current()), now), PER_FRONT)
    place = F.array_position(F.array(*[F.lit(c) for c in schema.COLUMNS]), F.col("col_name"))
    sections = _listing(top, ["col_name"], now).where(place > 0).select(
        F.struct(place.alias("o"), _cat("<section><h2>", F.initcap("col_name"), "</h2>", F.col("cards"), "</section>").alias("s")).alias("x")
    )
    body = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("body"))
    return body.select(F.lit("index.html").alias("path"), shell(F.lit(TITLE), F.col("body"), now, edition).alias("html"))


def about_page(spark: SparkSession, now: Column, edition: int) -> DataFrame:
    return spark.range(1).select(F.lit("about/index.html").alias("path"), shell(F.lit("About"), F.lit(f"<h1>About</h1><p>{ABOUT}</p>"), now, edition).alias("html"))


def site(syntheses: DataFrame, now: Column, edition: int) -> DataFrame:
    """All pages of an edition."""
    pages = front_page(syntheses, now, edition).unionByName(column_pages(syntheses, now, edition))
    return pages.unionByName(story_pages(syntheses, now, edition)).unionByName(about_page(syntheses.sparkSession, now, edition))


@dataclass
class Drafted(WriterCommitMessage):
    """The pages one task has written: draft and path of each."""

    pages: list[tuple[str, str]]


def _files(root: str) -> tuple[fs.FileSystem, str]:
    root = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "/", root))
    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))


class _SiteWriter(DataSourceArrowWriter):
    """Executors write drafts into a folder of the job's own; the commit alone touches the site."""

    def __init__(self, root: str, clean: bool):
        self.root, self.clean, self.drafts = root, clean, f"_drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafted:
        files, root = _files(self.root)
        files.create_dir(f"{root}/{self.drafts}", recursive=True)
        done = []
        for batch in iterator:
            for path, html in zip(batch["path"].to_pylist(), batch["html"].to_pylist()):
                draft = f"{self.drafts}/{uuid.uuid4().hex}"
                with files.open_output_stream(f"{root}/{draft}", compression=None) as out:
                    out.write((html or "").encode())
                done.append((draft, path))
        return Drafted(done)

    def commit(self, messages: list[Drafted | None]) -> None:
        files, root = _files(self.root)
        files.create_dir(root, recursive=True)
        if self.clean:
            for entry in files.get_file_info(fs.FileSelector(root)):
                if entry.base_name != self.drafts:
                    (files.delete_dir if entry.type == fs.FileType.Directory else files.delete_file)(entry.path)
        for draft, path in (p for m in messages if m for p in m.pages):
            files.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
            files.move(f"{root}/{draft}", f"{root}/{path}")
        self.abort(messages)

    def abort(self, messages: list[Drafted | None]) -> None:
        files, root = _files(self.root)
        if files.get_file_info(f"{root}/{self.drafts}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.drafts}")


class Site(DataSource):
    """Sink ``site`` for rows of ``path, html``."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return "path string, html string"

    def writer(self, schema: StructType, overwrite: bool) -> _SiteWriter:
        return _SiteWriter(self.options["path"], overwrite)


def write(pages: DataFrame, root: str, clean: bool = False) -> int:
    """Put each page at its path below ``root``; ``clean`` empties the folder first. Returns the number of pages.

    Tasks write drafts side by side; pages take their places only when all drafts are there, so a job that fails leaves the site as it was.
    """
    pages.sparkSession.dataSource.register(Site)
    pages = checkpoint(pages.select("path", "html"))
    pages.write.format("site").option("path", root).mode("overwrite" if clean else "append").save()
    return pages.count()
