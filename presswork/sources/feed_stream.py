"""Feeds as a data source, for batches and streams: ``spark.read.format("news_feeds")``, ``spark.readStream.format("news_feeds")``.

Options: ``sources``, a JSON list of ``[slug, url]``; ``timeout`` in seconds; ``agent``. Each source is a partition. A batch reads all. A
stream's offset is what every source says about its content (entity tag or date of change, asked for without the content), so a
micro-batch reads only what has changed, also after a restart; a source that says neither, or can't be asked, is read once an ``every``
seconds (3600). A source that fails gives a row with its error and no text, and ends no other.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from presswork.sources import feeds

PARALLEL = 32
SCHEMA = "slug string, url string, version string, xml string, error string"


@dataclass
class Feed(InputPartition):
    slug: str
    url: str
    version: str | None


class _Feeds:
    def __init__(self, options: dict[str, str]):
        self.sources: dict[str, str] = dict(json.loads(options["sources"]))
        self.timeout, self.agent = float(options.get("timeout", "30")), options.get("agent", "presswork/1.0")
        self.every = int(options.get("every", "3600"))

    def read(self, feed: Feed) -> Iterator[tuple]:
        try:
            yield feed.slug, feed.url, feed.version, feeds.http_get(feed.url, self.timeout, self.agent), None
        except Exception as e:  # any failure of a publisher's server
            yield feed.slug, feed.url, feed.version, None, f"{type(e).__name__}: {e}"

    def version(self, url: str) -> str:
        try:
            found = feeds.http_version(url, self.timeout, self.agent)
        except Exception:  # as above; reading says what is wrong
            found = None
        return found or f"period {int(time.time()) // self.every}"


class FeedReader(_Feeds, DataSourceReader):
    def partitions(self) -> list[Feed]:
        return [Feed(slug, url, None) for slug, url in sorted(self.sources.items())]


class FeedStreamReader(_Feeds, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(PARALLEL) as pool:
            return dict(zip(sorted(self.sources), pool.map(self.version, (self.sources[s] for s in sorted(self.sources)))))

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        return [Feed(slug, self.sources[slug], version) for slug, version in sorted(end.items()) if slug in self.sources and start.get(slug) != version]

    def commit(self, end: dict) -> None:
        pass


class NewsFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "news_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def _options(sources: DataFrame) -> str:
    """Active sources as the option; a registry is a short list that people keep."""
    return json.dumps([[r.slug, r.rss_url] for r in sources.where("rss_url is not null").select("slug", "rss_url").collect()])


def read(sources: DataFrame, **options) -> DataFrame:
    spark: SparkSession = sources.sparkSession
    spark.dataSource.register(NewsFeeds)
    return spark.read.format("news_feeds").options(**options).option("sources", _options(sources)).load()


def read_stream(sources: DataFrame, **options) -> DataFrame:
    spark: SparkSession = sources.sparkSession
    spark.dataSource.register(NewsFeeds)
    return spark.readStream.format("news_feeds").options(**options).option("sources", _options(sources)).load()
