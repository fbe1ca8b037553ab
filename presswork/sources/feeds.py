"""Feeds: RSS text to articles, entirely by expressions; fetching is a provider."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from presswork import schema
from presswork.functions import text as X
from presswork.session import BROADCAST_ROWS

_URL = "struct<_url:string,_medium:string,_type:string>"
_ITEM = (
    "array<struct<title:string,link:string,summary:string,description:string,encoded:string,pubDate:string,published:string,updated:string,date:string,"
    f"created:string,thumbnail:array<{_URL}>,media_content:array<{_URL}>,enclosure:array<{_URL}>>>"
)
_ENTRY = (
    "array<struct<title:string,link:array<struct<_href:string,_rel:string,_type:string>>,summary:string,content:string,published:string,updated:string,"
    f"created:string,thumbnail:array<{_URL}>,media_content:array<{_URL}>>>"
)
#: A feed may have so many bytes.
MOST_BYTES = 20 << 20
#: What a feed's root may hold: a channel of items (RSS 0.9x and 2), items beside it (RSS 1), or entries (Atom).
FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}"


def _opener() -> urllib.request.OpenerDirector:
    """HTTP and nothing else: no files, FTP or data URLs, whatever a registry or a redirect says."""
    opener = urllib.request.OpenerDirector()
    for handler in ("Proxy", "HTTP", "HTTPS", "HTTPDefaultError", "HTTPRedirect", "Unknown"):
        opener.add_handler(getattr(urllib.request, f"{handler}Handler")())
    opener.add_handler(urllib.request.HTTPErrorProcessor())
    return opener


def _open(url: str, timeout: float, agent: str, method: str = "GET"):
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not an HTTP address: {url[:100]}")
    return _opener().open(urllib.request.Request(url, headers={"User-Agent": agent}, method=method), timeout=timeout)


def http_get(url: str, timeout: float = 30.0, agent: str = "presswork/1.0", most: int = MOST_BYTES) -> str:
    """The text at an HTTP address, of at most ``most`` bytes; redirects are followed, an error status raises."""
    with _open(url, timeout, agent) as answer:
        data = answer.read(most + 1)
        if len(data) > most:
            raise ValueError(f"more than {most} bytes")
        return data.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def http_version(url: str, timeout: float = 30.0, agent: str = "presswork/1.0") -> str | None:
    """What an address says about its present content, without the content: entity tag, else date of change; null if neither."""
    with _open(url, timeout, agent, "HEAD") as answer:
        return answer.headers.get("ETag") or answer.headers.get("Last-Modified")


def fetch(sources: DataFrame, get: Callable[[str], str] = http_get, parallel: int = 16) -> DataFrame:
    """``slug, xml, error``: each source's feed through ``get``, dealt over tasks. An error ends that source only and is kept as text."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for slug, url in zip(pdf["slug"], pdf["rss_url"]):
                try:
                    out.append((slug, get(url), None))
                except Exception as e:  # any failure of a publisher's server
                    out.append((slug, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["slug", "xml", "error"])

    dealt = sources.where(F.col("rss_url").isNotNull()).select("slug", "rss_url").repartition(parallel, "slug")
    return dealt.mapInPandas(call, "slug string, xml string, error string")


def _pictures(pictures: Column) -> Column:
    return F.transform(F.coalesce(pictures, F.array().cast(f"array<{_URL}>")), lambda p: F.struct(p["_url"].alias("url"), p["_medium"].alias("medium"), p["_type"].alias("type")))


def _link(entry: Column) -> Column:
    """An entry's page: its first link without a relation or with that of an alternate."""
    return F.get(F.filter(entry["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]


def _enclosures(entry: Column) -> Column:
    found = F.filter(F.coalesce(entry["link"], F.array().cast("array<struct<_href:string,_rel:string,_type:string>>")), lambda x: x["_rel"] == "enclosure")
    return F.transform(found, lambda x: F.struct(x["_href"].alias("url"), F.lit(None).cast("string").alias("medium"), x["_type"].alias("type")))


def parse(feeds: DataFrame) -> DataFrame:
    """One row per item of an RSS feed or entry of an Atom feed; what is no feed gives none.

    Prefixes of media, Dublin Core and content elements are dropped before parsing, and so are elements of Atom inside RSS.
    """
    bare = F.regexp_replace("xml", r"<atom:link\b[^>]*?(/>|>\s*</atom:link>)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<(/?)media:content\b", "<$1media_content"), r"<(/?)(?:media|dc|content):", "<$1")
    root = feeds.select("slug", F.from_xml(bare, FEED).alias("feed"))

    def row(link, body, dates, enclosures):
        text = lambda x: X.strip(F.coalesce(x, F.lit("")))
        return lambda x: F.struct(
            text(x["title"]).alias("title"), text(link(x)).alias("link"), body(x).alias("body"), dates(x).alias("dates"),
            X.image_url(_pictures(x["thumbnail"]), _pictures(x["media_content"]), enclosures(x)).alias("image_url"),
        )

    item = row(
        lambda x: x["link"], lambda x: F.coalesce(x["summary"], x["description"], x["encoded"]),
        lambda x: F.array(F.coalesce(x["pubDate"], x["published"]), F.coalesce(x["updated"], x["date"]), x["created"]), lambda x: _pictures(x["enclosure"]),
    )
    entry = row(_link, lambda x: F.coalesce(x["summary"], x["content"]), lambda x: F.array(x["published"], x["updated"], x["created"]), _enclosures)
    items = F.concat(F.coalesce("feed.channel.item", F.array().cast(_ITEM)), F.coalesce("feed.item", F.array().cast(_ITEM)))
    rows = F.concat(F.transform(items, item), F.transform(F.coalesce("feed.entry", F.array().cast(_ENTRY)), entry))
    return root.select("slug", F.posexplode(rows).alias("position", "item")).select("slug", "position", "item.*")


def normalise(items: DataFrame, sources: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """Articles, and the items that failed validation with the reason; items without title or link are no articles at all.

    The registry is broadcast if a count shows that it is small.
    """
    dates = [F.get("dates", F.lit(k)) for k in range(3)]
    known = F.broadcast(sources) if sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sources
    joined = items.join(known, "slug").where((F.col("title") != "") & (F.col("link") != ""))
    url = X.normal_url(F.col("link"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(url.isNull(), "url").when(blank(F.col("name")) | blank(F.col("slug")), "source").when(~F.col("col_name").isin(*schema.COLUMNS, "local"), "column").when(~F.col("bias").isin(*schema.BIASES), "bias")
    rows = joined.select(
        F.md5(F.concat_ws("|", "slug", "link")).alias("id"), F.col("name").alias("source_name"), F.col("slug").alias("source_slug"), F.col("bias").alias("source_bias"),
        "col_name", X.truncate(F.col("title"), 500).alias("headline"), X.truncate(X.clean_html(F.col("body")), 2000).alias("summary"), url.alias("url"),
        X.timestamp_cascade(*dates, default=fetched_at).alias("pub_date"), fetched_at.alias("fetched_at"), "image_url", "position", reason.alias("reason"),
    )
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("source_slug", "headline", "url", "reason")
