"""The queries of the news engine and their SQL, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from presswork import schema
from presswork.functions import text as X
from presswork.functions.markdown import commonmark_html
from presswork.operators import cluster, dedup, hdbscan, layout, pages, rank, search, stories as S, store, synthesis, vector_index
from presswork.session import checkpoint, delete_folder, shared_folder
from presswork.sources import articles as A, dumps, feeds, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = ["col_name", "label"]
#: When the previous edition was made: its stories have what had been published by then.
PREVIOUS = "2024-01-08 00:00:00"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- shared views, in both languages ------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return A.articles(spark, sf).where("label is not null")


def stories(spark: SparkSession, sf: str) -> DataFrame:
    return S.stories(labelled(spark, sf), KEYS, A.now())


def previous(spark: SparkSession, sf: str) -> DataFrame:
    """Syntheses of the previous edition; those with few sources predate the record of being current."""
    rows = S.stories(labelled(spark, sf).where(F.col("pub_date") < F.lit(PREVIOUS).cast("timestamp")), KEYS, A.now(PREVIOUS))
    return rows.withColumns(
        {"edition": F.lit(1), "generated_at": A.now(PREVIOUS), "is_current": F.when(F.col("source_count") > 2, F.lit(True)), "superseded_by": F.lit(None).cast("string")}
    )


def syntheses(spark: SparkSession, sf: str) -> DataFrame:
    second = stories(spark, sf).withColumns({"edition": F.lit(2), "generated_at": A.now(), "is_current": F.lit(True), "superseded_by": F.lit(None).cast("string")})
    return previous(spark, sf).unionByName(second)


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """Synthesis-like rows with a headline per document; the counts come from its words, to vary."""
    docs = A.articles(spark, sf, vectors=False)
    return docs.select(
        F.col("doc_id").alias("id"), "col_name", F.col("headline").alias("headline"), F.size(F.split("headline", " ")).alias("article_count"),
        F.lit(1).alias("source_count"), F.col("pub_date").alias("median_pub_date"),
    )


def _story_sql(name: str, where: str, now: str) -> str:
    return f""", {name}_p AS (SELECT *, row_number() OVER (PARTITION BY col_name, label ORDER BY pub_date DESC NULLS LAST, id) AS position FROM articles WHERE label IS NOT NULL{where}),
{name} AS (
  SELECT 'story-' || substr(arg_min(id, position), 1, 8) AS story_id, col_name, label, arg_min(headline, position) AS headline, count(*)::INTEGER AS article_count,
         count(DISTINCT coalesce(source_slug, ''))::INTEGER AS source_count, count(DISTINCT coalesce(source_bias, 'unknown'))::INTEGER AS bias_count,
         list_sort(list(DISTINCT source_name)) AS sources_used, list_sort(list(url)) AS article_urls,
         (list_sort(list(pub_date) FILTER (pub_date IS NOT NULL)))[count(pub_date) // 2 + 1] AS median_pub_date, min(pub_date) AS first_pub_date, max(pub_date) AS last_pub_date,
         {now} AS at_time
  FROM {name}_p GROUP BY col_name, label)"""


NOW = A.NOW_SQL
STORIES = A.SQL + _story_sql("stories", "", NOW)
PREV = STORIES + _story_sql("prev0", f" AND pub_date < TIMESTAMP '{PREVIOUS}'", f"TIMESTAMP '{PREVIOUS}'") + """,
prev AS (SELECT *, CASE WHEN source_count > 2 THEN true END AS is_current FROM prev0),
syntheses AS (SELECT *, 1 AS edition FROM prev UNION ALL SELECT *, true AS is_current, 2 AS edition FROM stories)"""
LIVE = f"""CASE WHEN median_pub_date IS NULL THEN article_count::DOUBLE * (1.0::DOUBLE + 0.1::DOUBLE * greatest(0, source_count - 1))
  ELSE article_count::DOUBLE / greatest(1.0::DOUBLE, (epoch_ms({NOW}) - epoch_ms(median_pub_date))::DOUBLE / 3.6e6::DOUBLE) * (1.0::DOUBLE + 0.1::DOUBLE * greatest(0, source_count - 1)) END"""
STOP = "[" + ", ".join(f"'{w}'" for w in schema.STOP_WORDS) + "]"


def _round(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- ranked reads -------------------------------------------------------------------------------------------------------


@query(STORIES + f"""
SELECT col_name, rank::INTEGER AS rank, story_id, headline, article_count, source_count, round(hotness, 6) AS hotness FROM (
  SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY hotness DESC, last_pub_date DESC NULLS LAST, story_id) AS rank FROM (SELECT *, {LIVE} AS hotness FROM stories))
WHERE rank <= 3""")
def front_page_top3(spark, sf):
    top = rank.top_n(rank.with_hotness(stories(spark, sf), A.now()), 3)
    return top.select("col_name", "rank", "story_id", "headline", "article_count", "source_count", _round("hotness"))


@query(STORIES + """
SELECT s.story_id, bias, n FROM (SELECT col_name, label, coalesce(source_bias, 'unknown') AS bias, count(*) AS n FROM stories_p GROUP BY ALL)
JOIN stories s USING (col_name, label)""")
def story_bias_spread(spark, sf):
    return stories(spark, sf).select("story_id", F.explode("bias_coverage").alias("bias", "n"))


@query(STORIES + " SELECT story_id, col_name, article_count, source_count, bias_count FROM stories")
def story_source_count(spark, sf):
    return stories(spark, sf).select("story_id", "col_name", "article_count", "source_count", "bias_count")


@query(STORIES + """
SELECT story_id, median_pub_date, first_pub_date, last_pub_date,
       coalesce(round(article_count / greatest(1.0, (epoch_us(at_time) - epoch_us(median_pub_date)) / 3.6e9) * (1.0 + 0.1 * greatest(0, bias_count - 1)), 4), 0.0)::DOUBLE AS hotness_score
FROM stories""")
def story_timing_hotness(spark, sf):
    return stories(spark, sf).select("story_id", "median_pub_date", "first_pub_date", "last_pub_date", "hotness_score")


@query(A.SQL + """
SELECT id, col_name, source_bias, headline, pub_date FROM articles
WHERE col_name = 'tech' AND source_bias = 'center' AND pub_date >= TIMESTAMP '2024-01-10' ORDER BY pub_date DESC NULLS LAST, id LIMIT 100""")
def search_articles_filtered(spark, sf):
    found = search.search_articles(A.articles(spark, sf, vectors=False), column="tech", bias="center", since="2024-01-10 00:00:00")
    return found.select("id", "col_name", "source_bias", "headline", "pub_date")


@query(A.SQL + r"""
SELECT id, headline, pub_date FROM articles
WHERE list_has_any(list_filter(regexp_split_to_array(lower(headline), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ['the', 'being']) ORDER BY pub_date DESC NULLS LAST, id LIMIT 100""")
def search_headline_match(spark, sf):
    return search.search_articles(A.articles(spark, sf, vectors=False), query="The, being").select("id", "headline", "pub_date")


@query(A.SQL + " SELECT id, pub_date FROM articles WHERE embedding IS NULL ORDER BY pub_date DESC NULLS LAST, id LIMIT 100")
def missing_embeddings(spark, sf):
    return search.missing_embeddings(A.articles(spark, sf)).select("id", "pub_date")


@query(PREV + " SELECT count(*) AS n FROM syntheses WHERE coalesce(is_current, true)")
def current_syntheses_count(spark, sf):
    return search.count_current(syntheses(spark, sf))


@query(PREV + f"""
SELECT story_id, edition, article_count, round({LIVE}, 6) AS hotness FROM syntheses WHERE coalesce(is_current, true) AND col_name = 'politics'
ORDER BY {LIVE} DESC, at_time DESC, story_id LIMIT 20""")
def column_page_top20(spark, sf):
    return search.ranked_syntheses(syntheses(spark, sf), A.now(), "politics").select("story_id", "edition", "article_count", _round("hotness"))


@query(PREV + f"""
SELECT story_id, edition, is_current, round({LIVE}, 6) AS hotness FROM syntheses ORDER BY {LIVE} DESC, at_time DESC, story_id LIMIT 50""")
def ranked_with_history(spark, sf):
    return search.ranked_syntheses(syntheses(spark, sf), A.now(), limit=50, historical=True).select("story_id", "edition", "is_current", _round("hotness"))


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS clean FROM pages""")
def clean_html_pages(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.clean_html(F.col("html")).alias("clean"))


@query(A.SQL + " SELECT id, CASE WHEN coalesce(summary, '') <> '' THEN headline || chr(10) || chr(10) || summary ELSE headline END AS input FROM articles")
def embedding_text(spark, sf):
    return A.articles(spark, sf, vectors=False).select("id", X.embedding_text(F.col("headline"), F.col("summary")).alias("input"))


_LINE = "'**' || source_name || '**: ' || headline || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || '  ' || substr(summary, 1, 500) ELSE '' END"


@query(STORIES + f"""
, sections AS (
  SELECT col_name, label, source_bias, '### ' || upper(replace(source_bias, '-', ' ')) || chr(10) || string_agg({_LINE}, chr(10) ORDER BY position) AS section
  FROM stories_p GROUP BY col_name, label, source_bias)
SELECT col_name, label, string_agg(section, chr(10) || chr(10) ORDER BY list_position(['left', 'lean-left', 'center', 'lean-right', 'right'], source_bias)) AS prompt
FROM sections GROUP BY col_name, label""")
def prompt_block(spark, sf):
    return synthesis.prompt_blocks(S.with_position(labelled(spark, sf), KEYS), KEYS)


@query("SELECT doc_id, floor(length(text) / 3.5)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.token_estimate(F.length("text")).alias("tokens"))


@query(A.SQL + f"""
SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago'
  ELSE strftime(pub_date, '%b ') || day(pub_date) END AS ago
FROM (SELECT id, pub_date, (epoch_ms({NOW}) - epoch_ms(pub_date)) // 60000 AS m FROM articles)""")
def relative_time(spark, sf):
    return A.articles(spark, sf, vectors=False).select("id", X.relative_time(A.now(), F.col("pub_date")).alias("ago"))


@query(A.SQL + """
SELECT id, CASE WHEN image_url IS NOT NULL AND doc_id % 2 = 0 THEN image_url WHEN doc_id % 7 = 0 THEN NULL
  WHEN doc_id % 7 = 1 THEN 'https://m.example/' || doc_id WHEN doc_id % 7 = 2 THEN 'https://e.example/' || doc_id END AS picked FROM articles""")
def image_pick(spark, sf):
    """Thumbnails, declared and undeclared media and enclosures made from the article's number, to take every branch."""
    kind = "array<struct<url:string,medium:string,type:string>>"
    item = lambda test, url, medium, type_: F.when(test, F.array(F.struct(url.alias("url"), F.lit(medium).alias("medium"), F.lit(type_).alias("type")))).otherwise(F.array().cast(kind)).cast(kind)
    n = F.col("doc_id")
    thumbs = item(F.col("image_url").isNotNull() & (n % 2 == 0), F.col("image_url"), None, None)
    declared = item(n % 7 == 0, F.lit(None).cast("string"), "image", None)
    plain = item(n % 7 == 1, F.concat(F.lit("https://m.example/"), n.cast("string")), None, "video/mp4")
    enclosed = item(n % 7 == 2, F.concat(F.lit("https://e.example/"), n.cast("string")), None, "image/png")
    rows = A.articles(spark, sf, vectors=False).select("id", thumbs.alias("t"), F.concat(declared, plain).alias("m"), enclosed.alias("e"))
    return rows.select("id", X.image_url(F.col("t"), F.col("m"), F.col("e")).alias("picked"))


_PATHS = ["index.html", "static/sw.js", "static/manifest.json", "css/site.CSS", "img/a.jpeg", "favicon.ico", "noext", ".hidden", "a.b/c"]


@query("SELECT 'p' || (page_id % 9) || '/' || (" + str(_PATHS) + ")[page_id % 9 + 1] AS path, " + """
CASE page_id % 9 WHEN 0 THEN 'public, max-age=300' WHEN 1 THEN 'public, max-age=0, must-revalidate' WHEN 2 THEN 'public, max-age=3600' WHEN 3 THEN 'public, max-age=31536000'
  WHEN 4 THEN 'public, max-age=86400' ELSE 'public, max-age=3600' END AS cache,
CASE page_id % 9 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/javascript; charset=utf-8' WHEN 2 THEN 'application/json; charset=utf-8'
  WHEN 3 THEN 'text/css; charset=utf-8' WHEN 4 THEN 'image/jpeg' WHEN 5 THEN 'image/x-icon' ELSE 'application/octet-stream' END AS content_type,
substr(md5(html), 1, 8) AS hash FROM pages""")
def cache_control(spark, sf):
    path = F.concat(F.lit("p"), (F.col("page_id") % 9).cast("string"), F.lit("/"), F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("page_id") % 9 + 1).cast("int")))
    rows = A.table(spark, sf, "pages").select(path.alias("path"), "html")
    return rows.select("path", X.cache_control(F.col("path")).alias("cache"), X.content_type(F.col("path")).alias("content_type"), X.content_hash(F.col("html")).alias("hash"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#\s]+[^\s]*$') THEN
  lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) || CASE WHEN starts_with(regexp_extract(url, '^[^:]+://[^/?#]*(.*)$', 1), '/') THEN '' ELSE '/' END
  || regexp_extract(url, '^[^:]+://[^/?#]*(.*)$', 1) END AS url FROM pages""")
def normal_urls(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.normal_url(F.col("url")).alias("url"))


@query(A.SQL + """
SELECT id, strftime(pub_date, '%Y-%m') AS month, strftime(pub_date, '%A, %B ') || day(pub_date) || ', ' || year(pub_date) AS dateline,
  CASE source_bias WHEN 'left' THEN 'Left' WHEN 'lean-left' THEN 'Lean-Left' WHEN 'center' THEN 'Center' WHEN 'lean-right' THEN 'Lean-Right' WHEN 'right' THEN 'Right' END AS label,
  CASE source_bias WHEN 'left' THEN '#3b82f6' WHEN 'lean-left' THEN '#60a5fa' WHEN 'center' THEN '#a855f7' WHEN 'lean-right' THEN '#f97316' WHEN 'right' THEN '#ef4444' ELSE '#888' END AS color,
  CASE WHEN length(summary) > 300 THEN substr(summary, 1, 300) || '...' ELSE summary END AS preview, 'story-' || substr(id, 1, 8) AS story_id
FROM articles""")
def page_context(spark, sf):
    return A.articles(spark, sf, vectors=False).select(
        "id", X.month_key(F.col("pub_date")).alias("month"), X.dateline(F.col("pub_date")).alias("dateline"), X.title_label(F.col("source_bias")).alias("label"),
        X.bias_color(F.col("source_bias")).alias("color"), X.preview(F.col("summary")).alias("preview"), X.story_id(F.col("id")).alias("story_id"),
    )


@query("""SELECT doc_id, 'H' || doc_id AS headline, text AS article FROM documents""")
def parse_model_json(spark, sf):
    """Fenced answers with thinking, preambles and raw line breaks, made from the whole texts and parsed back into them."""
    return parsed_answers(A.table(spark, sf, "documents"))


def parsed_answers(docs):
    """``doc_id, headline, article`` of answers that hold each whole text, with quotes and backslashes escaped."""
    body = F.regexp_replace("text", r'(["\\])', r"\\$1")
    raw = F.concat(F.lit("<think>{no}</think>\nSure:\n```json\n{\"headline\": \"H"), F.col("doc_id").cast("string"), F.lit('", "article": "'), body, F.lit('"}\n```'))
    return docs.select("doc_id", X.parse_json(raw, "headline string, article string").alias("j")).select("doc_id", "j.headline", "j.article")


# --- stories and pages --------------------------------------------------------------------------------------------------


@query(STORIES + """
SELECT s.story_id, arg_min(image_url, k) FILTER (image_url IS NOT NULL) AS hero_image_url, arg_min(source_name, k) FILTER (image_url IS NOT NULL) AS hero_image_source
FROM (SELECT *, coalesce(list_position(['center', 'lean-left', 'lean-right', 'left', 'right'], source_bias), 6) * 1000000 + position AS k FROM stories_p) p
JOIN stories s USING (col_name, label) GROUP BY s.story_id""")
def story_hero_image(spark, sf):
    return stories(spark, sf).select("story_id", "hero_image_url", "hero_image_source")


@query(STORIES + " SELECT story_id, article_urls, sources_used FROM stories")
def story_urls(spark, sf):
    return stories(spark, sf).select("story_id", "article_urls", "sources_used")


@query(STORIES + """
SELECT s.story_id, p.position::INTEGER AS position, p.url, p.headline, p.source_name, p.source_slug, p.source_bias, p.image_url FROM stories_p p JOIN stories s USING (col_name, label)""")
def story_article_refs(spark, sf):
    refs = stories(spark, sf).select("story_id", F.posexplode("articles").alias("position", "ref"))
    return refs.select("story_id", (F.col("position") + 1).alias("position"), "ref.*")


@query(STORIES + """
SELECT s.story_id, coalesce(source_bias, 'unknown') AS bias, count(*) AS n, list(id ORDER BY position) AS ids FROM stories_p p JOIN stories s USING (col_name, label) GROUP BY ALL""")
def articles_by_bias(spark, sf):
    grouped = S.by_bias(labelled(spark, sf), KEYS)
    return grouped.join(stories(spark, sf).select(*KEYS, "story_id"), KEYS).select("story_id", "bias", "n", "ids")


@query(STORIES + f"""
SELECT story_id, col_name, row_number() OVER w::INTEGER AS rank, lag(story_id) OVER w AS prev_id, lead(story_id) OVER w AS next_id FROM (SELECT *, {LIVE} AS hotness FROM stories)
WINDOW w AS (PARTITION BY col_name ORDER BY hotness DESC, last_pub_date DESC NULLS LAST, story_id)""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER"))
def prev_next_nav(spark, sf):
    return rank.navigation_over_ranges(rank.with_hotness(stories(spark, sf), A.now()))


@query(STORIES + f"""
, r AS (SELECT *, (row_number() OVER (PARTITION BY col_name ORDER BY {LIVE} DESC, last_pub_date DESC NULLS LAST, story_id))::INTEGER AS rank FROM stories)
SELECT story_id, col_name, rank, CASE WHEN col_name = 'politics' AND rank = 1 THEN 'lead' WHEN col_name IN ('tech', 'money', 'sports') AND rank = 1 THEN 'sidebar' ELSE 'section' END AS slot,
  CASE WHEN col_name = 'lifestyle' THEN rank WHEN rank > 1 THEN rank - 1 END AS slot_position FROM r WHERE rank <= 3""")
def front_page_slots(spark, sf):
    return rank.front_page(rank.with_hotness(stories(spark, sf), A.now())).select("story_id", "col_name", "rank", "slot", "slot_position")


@query(STORIES + """
SELECT s.story_id, s.article_count, bias, n, round_even(n / s.article_count * 100, 0)::INTEGER AS percent FROM (
  SELECT col_name, label, coalesce(source_bias, 'unknown') AS bias, count(*) AS n FROM stories_p GROUP BY ALL) JOIN stories s USING (col_name, label)""")
def bias_percent(spark, sf):
    return rank.bias_percent(stories(spark, sf)).join(stories(spark, sf).select("story_id", "article_count"), "story_id").select("story_id", "article_count", "bias", "n", "percent")


@query(STORIES + """
, b AS (SELECT col_name, label, string_agg(bias || ': ' || n, ', ' ORDER BY bias) AS spread FROM (
  SELECT col_name, label, coalesce(source_bias, 'unknown') AS bias, count(*) AS n FROM stories_p GROUP BY ALL) GROUP BY ALL)
SELECT story_id, '## ' || headline || chr(10) || chr(10) || headline || chr(10) || chr(10) || '### Coverage Analysis' || chr(10) || 'None.' || chr(10) || chr(10) || '---' || chr(10)
  || '**Sources:** ' || array_to_string(sources_used[1:10], ', ') || CASE WHEN len(sources_used) > 10 THEN ' (+' || (len(sources_used) - 10) || ' more)' ELSE '' END || chr(10)
  || '**Bias Coverage:** ' || spread || chr(10) || '**Articles:** ' || article_count || chr(10) AS markdown
FROM stories JOIN b USING (col_name, label)""")
def synthesis_markdown(spark, sf):
    rows = stories(spark, sf).withColumns({"generated_headline": F.col("headline"), "article": F.col("headline"), "analysis": F.lit("None.")})
    return synthesis.markdown(rows)


@query(STORIES + " SELECT col_name, count(*) AS n, grouping(col_name)::INTEGER AS is_total FROM stories GROUP BY ROLLUP (col_name)")
def stories_by_column(spark, sf):
    return rank.count_by_column(stories(spark, sf))


@query(PREV + " SELECT story_id, col_name, article_count, source_count, is_current, edition FROM syntheses WHERE story_id = (SELECT min(story_id) FROM syntheses)")
def synthesis_by_id(spark, sf):
    rows = syntheses(spark, sf)
    return search.synthesis_by_id(rows, rows.agg(F.min("story_id")).first()[0]).select("story_id", "col_name", "article_count", "source_count", "is_current", "edition")


# --- de-duplication and editions ----------------------------------------------------------------------------------------


@query(A.SQL + f"""
SELECT doc_id, url FROM articles a WHERE pub_date >= TIMESTAMP '{PREVIOUS}' AND url NOT IN (SELECT url FROM articles WHERE pub_date < TIMESTAMP '{PREVIOUS}')
QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1""")
def new_articles_antijoin(spark, sf):
    rows = A.articles(spark, sf, vectors=False)
    old = F.col("pub_date") < F.lit(PREVIOUS).cast("timestamp")
    return dedup.new_articles(rows.where(~old), rows.where(old)).select("doc_id", "url")


@query("""
SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def upsert_latest(spark, sf):
    """Every event is an upsert of its user's row; the last one stays."""
    rows = A.table(spark, sf, "events")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return store.upsert(rows.where(half), rows.where(~half), "user_id", F.desc("ts"), F.asc("event_id")).select("event_id", "user_id", "event_type", "value")


_OVERLAPS = PREV + """
, ours AS (SELECT DISTINCT story_id, unnest(article_urls) AS url FROM stories), theirs AS (SELECT DISTINCT story_id AS existing_id, unnest(article_urls) AS url FROM prev WHERE is_current),
common AS (SELECT story_id, existing_id, count(*) AS common FROM ours JOIN theirs USING (url) GROUP BY ALL),
sizes AS (SELECT story_id, count(*) AS n FROM ours GROUP BY ALL), others AS (SELECT existing_id, count(*) AS m FROM theirs GROUP BY ALL),
best AS (SELECT story_id, existing_id, common / (n + m - common) AS jaccard, (n - common)::INTEGER AS new_urls FROM common JOIN sizes USING (story_id) JOIN others USING (existing_id)
         QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY jaccard DESC, existing_id) = 1),
decided AS (SELECT s.story_id, s.col_name, existing_id, jaccard, new_urls,
  CASE WHEN existing_id IS NULL THEN 'new' WHEN new_urls >= 3 THEN 'evolve' WHEN jaccard > 0.3 THEN 'skip' ELSE 'add' END AS action FROM stories s LEFT JOIN best USING (story_id))"""


@query(_OVERLAPS + " SELECT story_id, existing_id, round(jaccard, 6) AS jaccard, new_urls FROM best")
def overlap_best_match(spark, sf):
    return dedup.best_overlap(stories(spark, sf), previous(spark, sf)).select("story_id", "existing_id", _round("jaccard"), "new_urls")


@query(_OVERLAPS + " SELECT story_id, col_name, existing_id, action FROM decided")
def supersede_decision(spark, sf):
    return dedup.decide(stories(spark, sf), previous(spark, sf)).select("story_id", "col_name", "existing_id", "action")


@query(_OVERLAPS + """
, marks AS (SELECT existing_id AS story_id, min(story_id) AS by_id FROM decided WHERE action = 'evolve' GROUP BY ALL)
SELECT p.story_id, CASE WHEN by_id <> p.story_id THEN false ELSE is_current END AS is_current, CASE WHEN by_id <> p.story_id THEN by_id END AS superseded_by
FROM prev p LEFT JOIN marks m ON p.story_id = m.story_id""")
def supersede_apply(spark, sf):
    old = previous(spark, sf)
    decided = dedup.decide(stories(spark, sf), old).where("action = 'evolve'")
    marked = store.supersede(old, decided.select(F.col("existing_id").alias("old_id"), F.col("story_id").alias("new_id")))
    return marked.select("story_id", "is_current", "superseded_by")


@query((PREV + """
, g AS (SELECT story_id || '/' || edition AS story_id, col_name, article_count, list_distinct(article_urls) AS urls FROM syntheses),
r AS (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY article_count DESC, story_id) AS place FROM g),
near AS (SELECT a.col_name, b.place AS later, list(a.place) AS earlier FROM r a JOIN r b ON a.col_name = b.col_name AND a.place < b.place
         WHERE len(list_intersect(a.urls, b.urls)) / len(list_distinct(list_concat(a.urls, b.urls))) > 0.3 GROUP BY ALL),
walk(col_name, place, kept) AS (
  SELECT DISTINCT col_name, 0::BIGINT, []::BIGINT[] FROM r
  UNION ALL
  SELECT w.col_name, r.place, CASE WHEN len(list_intersect(w.kept, coalesce(n.earlier, []::BIGINT[]))) > 0 THEN w.kept ELSE list_append(w.kept, r.place) END
  FROM walk w JOIN r ON r.col_name = w.col_name AND r.place = w.place + 1 LEFT JOIN near n ON n.col_name = r.col_name AND n.later = r.place)
SELECT story_id, r.col_name, NOT list_contains(kept, r.place) AS dropped FROM r JOIN walk USING (col_name, place)""").replace("WITH anchors", "WITH RECURSIVE anchors", 1))
def intra_batch_greedy(spark, sf):
    """Stories of both editions as one batch, so that many overlap."""
    rows = syntheses(spark, sf).withColumn("story_id", F.concat_ws("/", "story_id", "edition"))
    return dedup.greedy_batch(rows).select("story_id", "col_name", "dropped")


_HEADLINES = A.SQL + f""", words AS (
  SELECT doc_id AS id, col_name, list_filter(list_distinct(regexp_extract_all(lower(headline), '[a-z]+')), lambda w: NOT list_contains({STOP}, w)) AS words,
         len(string_split(headline, ' '))::INTEGER AS article_count, 1 AS source_count, pub_date AS median_pub_date
  FROM articles),
near AS (
  SELECT a.col_name, a.id AS left_id, b.id AS right_id, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS jaccard
  FROM words a JOIN words b ON a.col_name = b.col_name AND a.id < b.id AND len(a.words) > 0 AND len(b.words) > 0
    AND len(a.words) >= 0.5 * len(b.words) AND len(b.words) >= 0.5 * len(a.words)
    AND len(list_intersect(a.words, b.words)) >= 0.5 * len(list_distinct(list_concat(a.words, b.words))))"""


@query(_HEADLINES + """, firsts AS (SELECT col_name, list_sort(words) AS w, min(id) AS first FROM words GROUP BY ALL), f AS (
  SELECT id, first FROM words JOIN firsts ON words.col_name = firsts.col_name AND list_sort(words.words) = firsts.w)
SELECT n.col_name, left_id, right_id, round(jaccard, 6) AS jaccard FROM near n JOIN f a ON a.id = left_id JOIN f b ON b.id = right_id
WHERE (a.first = a.id AND b.first = b.id) OR (a.first = b.first AND a.first = left_id)""")
def headline_jaccard_pairs(spark, sf):
    """Pairs of distinct word sets through their first ids, and each repeat with its first."""
    return dedup.headline_pairs(headlines(spark, sf)).select("col_name", "left_id", "right_id", _round("jaccard"))


_COMPONENTS = _HEADLINES.replace("WITH ", "WITH RECURSIVE ", 1) + """, edges AS (SELECT left_id AS a, right_id AS b FROM near UNION SELECT right_id, left_id FROM near),
reach(node, seen) AS (SELECT id, id FROM words UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON r.node = e.a),
groups AS (SELECT node AS id, min(seen) AS group_id FROM reach GROUP BY ALL),
flagged AS (SELECT w.*, group_id, row_number() OVER (PARTITION BY w.col_name, group_id ORDER BY article_count DESC, """ + LIVE + """ DESC, w.id) = 1 AS keep
            FROM words w JOIN groups g ON w.id = g.id)"""


@query(_COMPONENTS + " SELECT id, col_name, group_id, keep FROM flagged")
def headline_dedup_keep(spark, sf):
    return dedup.keep_best(dedup.headline_groups(headlines(spark, sf)), A.now()).select("id", "col_name", "group_id", "keep")


@query(_COMPONENTS + """
SELECT col_name, count(*) AS total, count_if(keep)::BIGINT AS kept, count_if(NOT keep)::BIGINT AS removed, grouping(col_name)::INTEGER AS is_total FROM flagged GROUP BY ROLLUP (col_name)""")
def dedup_rollup_report(spark, sf):
    return dedup.dedup_report(dedup.keep_best(dedup.headline_groups(headlines(spark, sf)), A.now()))


@query(PREV + " SELECT story_id, edition FROM syntheses WHERE NOT (col_name = 'sports' AND coalesce(is_current, true))")
def delete_by_predicate(spark, sf):
    left, _ = store.delete_where(syntheses(spark, sf), (F.col("col_name") == "sports") & search.is_current())
    return left.select("story_id", "edition")


@query(PREV + """
SELECT story_id, col_name, edition, coalesce(is_current, true) AS is_current, len(sources_used)::INTEGER AS source_count, '' AS analysis, superseded_by
FROM (SELECT *, NULL::VARCHAR AS superseded_by FROM syntheses)""")
def store_with_defaults(spark, sf):
    rows = syntheses(spark, sf).drop("source_count")
    return store.fill_defaults(rows, A.now()).select("story_id", "col_name", "edition", "is_current", "source_count", "analysis", "superseded_by")


@query(PREV + " SELECT (coalesce(max(edition), 0) + 1)::INTEGER AS edition FROM syntheses")
def next_edition(spark, sf):
    return store.next_edition(syntheses(spark, sf))


# --- vectors ------------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity({0}, {1})"


@query(A.SQL + f""", v AS (SELECT id, col_name, embedding FROM articles WHERE embedding IS NOT NULL),
d AS (SELECT a.id, b.id AS other_id, {_COS.format("a.embedding", "b.embedding")} AS cosine FROM v a JOIN v b ON a.col_name = b.col_name AND a.id <> b.id)
SELECT id, other_id, round(cosine, 6) AS cosine FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, other_id) <= 3""")
def pairwise_cosine_topk(spark, sf):
    """The three nearest articles of each, within its column."""
    return cluster.nearest(A.articles(spark, sf), 3).select("id", "other_id", F.round("cosine", 6).alias("cosine"))


@query(A.SQL + f"""
SELECT id, round({_COS.format("a.embedding", "q.embedding")}, 6) AS cosine FROM articles a, (SELECT arg_min(embedding, vec_id) AS embedding FROM vectors) q
WHERE a.embedding IS NOT NULL AND col_name = 'tech' ORDER BY round({_COS.format("a.embedding", "q.embedding")}, 9) DESC, id LIMIT 10""")
def knn_filtered(spark, sf):
    first = A.planted_vectors(spark, sf).agg(F.min_by("vector", "vec_id")).first()[0]
    return search.knn(A.articles(spark, sf), F.array(*[F.lit(x) for x in first]), 10, "tech").select("id", _round("cosine"))


@query(A.SQL + """
, e AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM articles WHERE embedding IS NOT NULL)
SELECT label, list(round(m, 6) ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL) GROUP BY label""")
def centroids(spark, sf):
    return cluster.centroids(A.articles(spark, sf), ["label"]).select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(A.SQL + f""", v AS (SELECT id, col_name, embedding FROM articles WHERE embedding IS NOT NULL),
d AS (SELECT a.col_name, a.id, 1 - {_COS.format("a.embedding", "b.embedding")} AS distance FROM v a JOIN v b ON a.col_name = b.col_name AND a.id <> b.id)
SELECT col_name, id, round(distance, 6) AS core_distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance) = 2""")
def core_distance(spark, sf):
    near = cluster.nearest(A.articles(spark, sf), cluster.MIN_SAMPLES).where(F.col("place") == cluster.MIN_SAMPLES)
    return near.select("col_name", "id", F.round(1 - F.col("cosine"), 6).alias("core_distance"))


@query(STORIES + f""", e AS (SELECT col_name, label, source_bias, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM stories_p),
c AS (SELECT col_name, label, source_bias, list(m ORDER BY pos) AS center FROM (SELECT col_name, label, source_bias, pos, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL),
n AS (SELECT p.*, count(*) OVER (PARTITION BY col_name, label, source_bias) AS size, round(1 - {_COS.format("p.embedding", "c.center")}, 9) AS distance FROM stories_p p JOIN c USING (col_name, label, source_bias))
SELECT col_name, label, source_bias, id FROM n QUALIFY row_number() OVER (PARTITION BY col_name, label, source_bias ORDER BY CASE WHEN size <= 2 THEN position ELSE 0 END,
  CASE WHEN size <= 2 THEN 0 ELSE distance END, position) <= 2""")
def representative_sample(spark, sf):
    rows = S.with_position(labelled(spark, sf), KEYS)
    return cluster.representatives(rows, [*KEYS, "source_bias"], 2).select(*KEYS, "source_bias", "id")


@query(A.SQL + f"""
, e AS (SELECT col_name, label, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM articles WHERE embedding IS NOT NULL),
c AS (SELECT col_name, label, list(m ORDER BY pos) AS center FROM (SELECT col_name, label, pos, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL)
SELECT a.col_name, a.label AS left_label, b.label AS right_label, round(1 - {_COS.format("a.center", "b.center")}, 6) AS distance
FROM c a JOIN c b ON a.col_name = b.col_name AND a.label < b.label WHERE 1 - {_COS.format("a.center", "b.center")} < 0.8""")
def near_centroids(spark, sf):
    """The merge's join, at a threshold that these vectors reach."""
    return cluster.merge_pairs(cluster.centroids(A.articles(spark, sf), KEYS), "col_name", "label", 0.8).select("col_name", "left_label", "right_label", _round("distance"))


@query((A.SQL + f"""
, e AS (SELECT col_name, label, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM articles WHERE embedding IS NOT NULL),
c AS (SELECT col_name, label, list(m ORDER BY pos) AS center FROM (SELECT col_name, label, pos, avg(x) AS m FROM e GROUP BY ALL) GROUP BY ALL),
near AS (SELECT a.col_name, a.label AS l, b.label AS r FROM c a JOIN c b ON a.col_name = b.col_name AND a.label <> b.label WHERE 1 - {_COS.format("a.center", "b.center")} < 0.8),
reach(col_name, label, seen) AS (SELECT col_name, label, label FROM c UNION SELECT n.col_name, n.r, x.seen FROM reach x JOIN near n ON n.col_name = x.col_name AND n.l = x.label)
SELECT col_name, label, min(seen) AS merged FROM reach GROUP BY ALL""").replace("WITH anchors", "WITH RECURSIVE anchors", 1))
def merge_similar_clusters(spark, sf):
    return cluster.merge_near(cluster.centroids(A.articles(spark, sf), KEYS), "col_name", "label", 0.8).select("col_name", "label", "merged")


@query()
def hdbscan_stories(spark, sf):
    """Clusters over each column's scan; checked against brute force and planted labels in the tests."""
    return cluster.story_keys(A.articles(spark, sf)).select("col_name", "id", "story_key")


@query()
def cluster_sizes(spark, sf):
    return cluster.cluster_stats(cluster.cluster(A.articles(spark, sf)))


@query()
def ann_neighbours(spark, sf):
    """Ten nearest by LSH to the first vector; its recall is measured in the tests."""
    first = A.planted_vectors(spark, sf).agg(F.min_by("vector", "vec_id")).first()[0]
    return cluster.approximate_knn(A.articles(spark, sf), first).select("id", _round("cosine"))


@query(A.SQL + """, q AS (SELECT id AS query_id, embedding AS qv FROM articles WHERE embedding IS NOT NULL AND doc_id % 50 = 0),
s AS (SELECT query_id, id, list_cosine_similarity(embedding, qv) AS cosine FROM articles, q WHERE embedding IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id)::INTEGER AS place FROM s)
SELECT query_id, id, place, round(cosine, 6) AS cosine FROM p WHERE place <= 10""")
def index_neighbours(spark, sf):
    """Ten nearest articles of every fiftieth, from a stored index of which all lists are read, so that it is exact."""
    rows, folder = A.articles(spark, sf), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(rows, folder, lists=16)
    found = checkpoint(vector_index.search_many(rows.where("doc_id % 50 = 0"), folder, 10).select("query_id", "id", "place", _round("cosine")))
    delete_folder(spark, folder)
    return found


@query()
def projection_2d(spark, sf):
    return cluster.projection_2d(A.articles(spark, sf))


# --- models, dumps, registry --------------------------------------------------------------------------------------------


@query()
def synthesize_extractive(spark, sf):
    rows = S.with_position(labelled(spark, sf), KEYS)
    prompts = synthesis.budget_prompts(rows, KEYS, X.prompt_budget()).join(stories(spark, sf).select(*KEYS, "story_id"), KEYS)
    return synthesis.synthesize(prompts, "story_id")


@query(A.SQL + r"""
, a AS (SELECT id, headline || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || chr(10) || summary ELSE '' END AS text FROM articles WHERE embedding IS NULL),
w AS (SELECT id, ('0x' || substr(md5(word), 7, 2))::INTEGER & 63 AS at, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM a) GROUP BY ALL),
l AS (SELECT id, sqrt(sum(n * n)) AS length FROM w GROUP BY id)
SELECT a.id, list(round(coalesce(n / length, 0), 6) ORDER BY i) AS embedding FROM a CROSS JOIN range(64) t(i) LEFT JOIN l ON l.id = a.id LEFT JOIN w ON w.id = a.id AND w.at = i GROUP BY a.id""")
def embed_missing(spark, sf):
    """Vectors of hashed words, in which the last six bits of a word's fourth digest byte are its place."""
    made = synthesis.embed_missing(A.articles(spark, sf))
    return made.select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(A.SQL + " SELECT id, doc_id, headline, pub_date, image_url FROM articles")
def export_import_roundtrip(spark, sf):
    rows = A.articles(spark, sf, vectors=False).select("id", "doc_id", "headline", "pub_date", "image_url")
    header = spark.createDataFrame([(dumps.HEADER + rows.schema.json(),), ("",)], "value string")
    return dumps.parse(header.unionByName(dumps.lines(rows, "id")), rows.schema)


@query("""
SELECT 'src' || i AS slug, i % 2 = 0 AS even FROM range(20) t(i) WHERE i NOT IN (3, 5, 11)""")
def active_feeds(spark, sf):
    return registry.active_feeds(registry.demo(spark)).select("slug", (F.regexp_extract("slug", r"(\d+)", 1).cast("int") % 2 == 0).alias("even"))


@query(A.SQL + """
, b AS (SELECT doc_id, (row_number() OVER (ORDER BY pub_date DESC NULLS LAST, id) - 1) // 50 AS batch, article FROM (SELECT *, 1 AS article FROM articles WHERE label IS NOT NULL))
SELECT batch, count(*) AS n, (sum(count(*)) OVER (ORDER BY batch))::BIGINT AS done FROM b GROUP BY batch""")
def batch_totals(spark, sf):
    """Chunks of fifty in scan order with running totals."""
    return rank.chunk_totals(labelled(spark, sf).select("id", "pub_date"), 50, F.desc_nulls_last("pub_date"), F.asc("id"))


@query(STORIES + f""", ranked AS (SELECT *, round({LIVE}, 9) AS hotness FROM stories)
SELECT story_id, (row_number() OVER (ORDER BY article_count DESC, story_id))::INTEGER AS by_size, source_count >= 2 AS multi_source FROM ranked""")
def stories_by_size(spark, sf):
    rows = stories(spark, sf)
    placed = rank.numbered(rows.select("story_id", "article_count", "source_count"), F.desc("article_count"), F.asc("story_id"))
    return placed.select("story_id", F.col("place").cast("int").alias("by_size"), (F.col("source_count") >= 2).alias("multi_source"))


# --- feeds, dates, pages ------------------------------------------------------------------------------------------------

_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id)"


@query(f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(substr(text, 1, 40), '[^A-Za-z ]', '', 'g')) AS title, {_AT} AS ts FROM documents)
SELECT doc_id, title AS headline, 'https://n.example/' || doc_id AS url,
       CASE doc_id % 6 WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN {A.NOW_SQL} ELSE ts END AS pub_date,
       CASE doc_id % 5 WHEN 0 THEN 'https://i.example/t' || doc_id WHEN 1 THEN 'https://i.example/m' || doc_id WHEN 3 THEN 'https://i.example/e' || doc_id END AS image_url
FROM d WHERE title <> ''""")
def parse_feeds(spark, sf):
    """Documents as feeds of one item, RSS and Atom in turn, with every way to give a date and an image; parsed and validated."""
    docs = A.table(spark, sf, "documents").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    n, atom = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 1
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    published = F.when(atom, F.lit("published")).otherwise("pubDate")
    tag = lambda name, v: cat("<", name, ">", v, "</", name, ">")
    ago = lambda h: F.col("ts") + F.make_dt_interval(hours=F.lit(h))
    form = F.col("doc_id") % 6
    date = (
        F.when(form == 0, tag(published, cat(F.date_format(ago(-5), "d MMM yyyy HH:mm:ss"), " EST"))).when(form == 1, tag(published, iso))
        .when(form == 2, tag(published, F.date_format("ts", "MMMM d, yyyy"))).when(form == 3, F.lit(""))
        .when(form == 4, cat(tag(published, F.lit("soon")), tag(F.lit("updated"), iso))).otherwise(tag(published, cat(F.date_format(ago(2), "EEE, dd MMM yyyy HH:mm"), " +0200")))
    )
    kind, thumb = F.col("doc_id") % 5, lambda u: cat('<media:thumbnail url="', u, '"/>')
    enclosure = F.when(atom, cat('<link rel="enclosure" type="image/png" href="https://i.example/e', n, '"/>')).otherwise(cat('<enclosure type="image/png" url="https://i.example/e', n, '"/>'))
    image = (
        F.when(kind == 0, thumb(cat("https://i.example/t", n))).when(kind == 1, cat(thumb(F.lit("")), '<media:content medium="image" url="https://i.example/m', n, '"/>'))
        .when(kind == 2, cat('<media:content type="image/png"/>', enclosure)).when(kind == 3, enclosure).otherwise("")
    )
    inside = cat(tag(F.lit("title"), F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z ]", "")), date, image)
    xml = F.when(atom, cat("<feed><entry>", inside, '<link href="HTTPS://N.example:443/', n, '"/></entry></feed>')).otherwise(cat("<rss><channel><item>", inside, "<link>https://N.EXAMPLE/", n, "</link></item></channel></rss>"))
    slug = F.concat(F.lit("s"), n)
    sources = docs.select(slug.alias("name"), slug.alias("slug"), F.lit(None).cast("string").alias("rss_url"), F.lit("rss").alias("fetch_method"), F.lit("tech").alias("col_name"), F.lit("center").alias("bias"), F.lit(True).alias("active"))
    good, _ = feeds.normalise(feeds.parse(docs.where("text is not null").select(slug.alias("slug"), xml.alias("xml"))), sources, A.now())
    return good.select(F.substring("source_slug", 2, 20).cast("long").alias("doc_id"), "headline", "url", "pub_date", "image_url")


@query("""
SELECT event_id, CASE event_id % 8 WHEN 3 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS at FROM events""")
def written_dates(spark, sf):
    """Dates of events written in eight ways, read again."""
    rows = A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    shifted = lambda h: F.col("ts") + F.make_dt_interval(hours=F.lit(h))
    forms = [
        F.concat(F.date_format(shifted(-8), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" PST")), F.date_format("ts", "M/d/yyyy H:mm"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format("ts", "MMMM d, yyyy"), F.concat(F.date_format(shifted(1), "dd MMM yyyy HH:mm:ss"), F.lit(" +01:00")), F.date_format("ts", "EEE MMM d HH:mm:ss yyyy"),
        F.date_format("ts", "yyyy/M/d"), F.date_format("ts", "MMM d, yyyy HH:mm:ss"),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    return rows.select("event_id", X.timestamp_cascade(text, default=F.lit(None).cast("timestamp")).alias("at"))


@query("""
SELECT event_id, CASE event_id % 10 WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('hour', ts)
  WHEN 5 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('month', ts) WHEN 8 THEN date_trunc('milliseconds', ts) ELSE date_trunc('minute', ts) END AS at FROM events""")
def free_dates(spark, sf):
    """Dates of events as people write them: zones, ordinals, either order of day and month, dots, compact, without a day."""
    rows = A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    shifted = lambda m: F.col("ts") + F.make_dt_interval(mins=F.lit(m))
    written = lambda pattern, ts="ts": F.date_format(ts, pattern)
    forms = [
        F.concat(written("yyyy-MM-dd HH:mm", shifted(-300)), F.lit(" EST")), written("EEE, dd MMM yyyy HH:mm:ss 'BST'"), written("yyyyMMdd'T'HHmmss'Z'"), written("MM.dd.yyyy"),
        F.concat(written("EEEE, d"), F.lit("th "), written("MMMM yyyy 'at' ha")), F.when(F.dayofmonth("ts") > 12, written("d/M/yyyy")).otherwise(written("M/d/yyyy")),
        written("MMM yyyy"), written("h:mm a 'on' MMMM d, yyyy"), written("yyyy.M.d HH:mm:ss,SSS"), F.concat(written("d-MMM-yy HH:mm", shifted(330)), F.lit(" +0530")),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 10 + 1).cast("int"))
    return rows.select("event_id", X.timestamp_cascade(text, default=F.lit(None).cast("timestamp")).alias("at"))


@query(A.SQL + f"""
SELECT id, round(1 + {_COS.format("a.embedding", "q.embedding")}, 6) AS score, round(1 / (2 - {_COS.format("a.embedding", "q.embedding")}), 6) AS index_score
FROM articles a, (SELECT arg_min(embedding, vec_id) AS embedding FROM vectors) q
WHERE a.embedding IS NOT NULL ORDER BY round({_COS.format("a.embedding", "q.embedding")}, 9) DESC, id LIMIT 10""")
def knn_scores(spark, sf):
    first = A.planted_vectors(spark, sf).agg(F.min_by("vector", "vec_id")).first()[0]
    found = search.knn(A.articles(spark, sf), F.array(*[F.lit(x) for x in first]), 10)
    return found.select("id", F.round(search.store_score(F.col("cosine")), 6).alias("score"), F.round(search.store_score(F.col("cosine"), True), 6).alias("index_score"))


@query(A.SQL + """, k AS (SELECT *, col_name || '/' || label AS story_key FROM articles WHERE embedding IS NOT NULL),
h AS (SELECT story_key, count(*) AS n, arg_min(headline, id) AS head FROM k GROUP BY story_key),
t AS (SELECT story_key, row_number() OVER (ORDER BY n DESC, story_key) - 1 AS t FROM h WHERE n > 1)
SELECT id, coalesce(t, -1)::INTEGER AS trace, (t % 25)::INTEGER AS color, CASE WHEN t IS NULL THEN 'Single articles' ELSE substr(head, 1, 80) END AS label,
       '<b>' || substr(headline, 1, 60) || '</b><br>Source: ' || coalesce(source_name, '?') || ' (' || coalesce(source_bias, '?') || ')<br>Cluster: ' || substr(head, 1, 80) || '<br>Cluster size: ' || n AS hover,
       CASE WHEN t IS NULL THEN 4 ELSE 8 END AS size
FROM k JOIN h USING (story_key) LEFT JOIN t USING (story_key)""")
def plot_traces(spark, sf):
    """The table of a scatter plot without its coordinates, which SQL can't give, for stories by planted label."""
    rows = A.articles(spark, sf).where("embedding is not null")
    return cluster.plot_table(rows, rows.select("id", F.concat_ws("/", "col_name", "label").alias("story_key"))).drop("x", "y")


@query(STORIES + """
SELECT story_id, array_to_string(sources_used[1:5], ', ') || CASE WHEN len(sources_used) > 5 THEN ' + ' || (len(sources_used) - 5) || ' more' ELSE '' END AS sources FROM stories""")
def story_source_list(spark, sf):
    return stories(spark, sf).select("story_id", X.source_list(F.col("sources_used")).alias("sources"))


@query(STORIES + """
SELECT col_name, count(*) AS stories, count(*) FILTER (len(article_urls) > 1) AS clustered, count(*) FILTER (len(article_urls) = 1) AS single,
       count(*) FILTER (source_count > 1) AS multi_source, sum(len(article_urls))::BIGINT AS articles FROM stories GROUP BY col_name""")
def story_counts(spark, sf):
    return cluster.story_stats(stories(spark, sf))


@query("""
SELECT count(*) FILTER (doc_id % 10 <> 0) AS ok, count(*) FILTER (doc_id % 10 = 0) AS errors FROM documents""")
def bulk_upsert_counts(spark, sf):
    docs = A.table(spark, sf, "documents")
    changes = docs.select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("doc_id"), "text")
    return store.bulk_upsert(docs.select("doc_id", "text").limit(0), changes, "doc_id")[1]


@query("""
SELECT doc_id, '<h1>' || doc_id || '</h1>' || chr(10) || '<p><strong>' || lang || '</strong> &amp; <em>' || source || '</em></p>' || chr(10) || '<ul><li>' || n_chars || '</li><li>&lt;b&gt;</li></ul>' AS html FROM documents""")
def markdown_pages(spark, sf):
    docs = A.table(spark, sf, "documents")
    text = F.format_string("# %s\n\n**%s** & *%s*\n\n- %s\n- <b>", "doc_id", "lang", "source", "n_chars")
    return docs.select("doc_id", X.markdown_html(text).alias("html"))


@query("""
WITH t AS (SELECT doc_id, 'w ' || trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM documents)
SELECT doc_id, concat_ws(chr(10), '<h1>' || w || '</h1>', '<p>' || w || '</p>', '<ul>', '<li>' || w, '<ol>', '<li>' || w || '</li>', '<li><em>' || w || '</em></li>', '</ol>',
  '</li>', '</ul>', '<blockquote>', '<p>' || w, 'lazy</p>', '</blockquote>', '<pre><code class="language-text">' || w || ' &lt;b&gt;', '</code></pre>',
  '<p><em><strong>' || w || '</strong></em></p>', '<hr />', '<p><a href="http://a.example/?a=1&amp;b=2">' || w || '</a> <code>' || w || '</code></p>', '<h2>Sub</h2>', '') AS html
FROM t WHERE w IS NOT NULL""")
def markdown_blocks(spark, sf):
    """The words of each text within every construct of CommonMark that stories use."""
    words = F.concat(F.lit("w "), F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")))
    lines = ["# %s", "%s", "- %s", "  1. %s", "  2. _%s_", "", "> %s", "lazy", "", "```text", "%s <b>", "```", "***%s***", "***", "[%s](http://a.example/?a=1&b=2) `%s`", "", "Sub", "---"]
    text = F.concat_ws("\n", *[F.replace(F.lit(x), F.lit("%s"), words) for x in lines])
    return A.table(spark, sf, "documents").where("text is not null").select("doc_id", commonmark_html(text).alias("html"))


@query()
def layout_2d(spark, sf):
    """Two dimensions of all articles by the graph of their neighbours; its trustworthiness is measured in the tests."""
    return layout.layout_2d(A.articles(spark, sf))


@query()
def hdbscan_whole(spark, sf):
    """Clusters over all articles that have a vector, without a scan's limit; checked against a plain version in the tests."""
    return hdbscan.hdbscan_whole(A.articles(spark, sf))


@query()
def site_pages(spark, sf):
    """All pages of an edition over the stories of the planted labels; their content is checked in the tests."""
    rows = store.fill_defaults(stories(spark, sf).withColumnRenamed("headline", "original_headline").withColumn("generated_headline", F.col("original_headline")), A.now())
    return pages.site(rows, A.now(), 1)
