"""Domains, fixed maps and explicit schemas of the news data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Editorial columns in page order, and the spectrum of source bias.
COLUMNS = ("politics", "tech", "money", "sports", "lifestyle")
BIASES = ("left", "lean-left", "center", "lean-right", "right")
#: Order in which a hero image's bias is preferred.
IMAGE_PREFERENCE = ("center", "lean-left", "lean-right", "left", "right")
#: Colours of the bias bar, and that of an unknown bias.
BIAS_COLORS = {
    "left": "#3b82f6",
    "lean-left": "#60a5fa",
    "center": "#a855f7",
    "lean-right": "#f97316",
    "right": "#ef4444",
}
DEFAULT_COLOR = "#888"
#: Words that headline comparison leaves out.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can not no nor so if then than that this it its over after amid among about into up out"
).split()
#: Content types by file extension, and cache rules by extension and by name.
CONTENT_TYPES = {
    ".html": "text/html; charset=utf-8",
    ".css": "text/css; charset=utf-8",
    ".js": "application/javascript; charset=utf-8",
    ".json": "application/json; charset=utf-8",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".svg": "image/svg+xml",
    ".ico": "image/x-icon",
    ".woff": "font/woff",
    ".woff2": "font/woff2",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
CACHE_BY_EXTENSION = {
    ".html": "public, max-age=300",
    ".css": "public, max-age=31536000",
    ".js": "public, max-age=31536000",
    ".png": "public, max-age=86400",
    ".jpg": "public, max-age=86400",
    ".jpeg": "public, max-age=86400",
}
CACHE_BY_NAME = {"sw.js": "public, max-age=0, must-revalidate", "manifest.json": "public, max-age=3600"}
DEFAULT_CACHE = "public, max-age=3600"

REF = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "headline", "source_name", "source_slug", "source_bias", "image_url")])

SOURCES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "slug", "rss_url", "fetch_method", "col_name", "bias")] + [T.StructField("active", T.BooleanType())]
)

ARTICLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "source_name", "source_slug", "source_bias", "col_name", "headline", "summary", "url")]
    + [T.StructField("pub_date", T.TimestampType()), T.StructField("fetched_at", T.TimestampType()), T.StructField("image_url", T.StringType())]
    + [T.StructField("embedding", T.ArrayType(T.DoubleType()))]
)

SYNTHESIS = T.StructType(
    [
        T.StructField("story_id", T.StringType()), T.StructField("col_name", T.StringType()), T.StructField("original_headline", T.StringType()),
        T.StructField("generated_headline", T.StringType()), T.StructField("article", T.StringType()), T.StructField("analysis", T.StringType()),
        T.StructField("sources_used", T.ArrayType(T.StringType())), T.StructField("bias_coverage", T.MapType(T.StringType(), T.LongType())),
        T.StructField("article_count", T.IntegerType()), T.StructField("source_count", T.IntegerType()), T.StructField("generated_at", T.TimestampType()),
        T.StructField("hero_image_url", T.StringType()), T.StructField("hero_image_source", T.StringType()), T.StructField("article_urls", T.ArrayType(T.StringType())),
        T.StructField("articles", T.ArrayType(REF)), T.StructField("edition", T.IntegerType()), T.StructField("is_current", T.BooleanType()),
        T.StructField("superseded_by", T.StringType()), T.StructField("hotness_score", T.DoubleType()), T.StructField("median_pub_date", T.TimestampType()),
        T.StructField("first_pub_date", T.TimestampType()), T.StructField("last_pub_date", T.TimestampType()),
    ]
)

#: Zone names of mail dates and their offsets.
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
