"""URL filters by an index of rare tokens.

Every rule is a host and a path prefix. A rule is indexed by the literal token that the corpus holds least often; a URL's own
tokens fetch the candidate rules by an equi-join, and only those run their regular expression. The longest rule that matches
decides, else the method's verdict, ``allow``. Column expressions only.

An index of at most ``IN_PLACE`` rules is a literal map from token to candidates: a URL's tokens look them up and the candidates are tested in place, with
no shuffle. A larger one is joined on tokens, salted if it can't be broadcast; rows are told apart by a generated id, so a frequent host
or a repeated URL is no group of its own. Both give the same rows.

Nulls and edges: a null URL, or one without ``://``, has an empty host and path and takes the method's verdict; repeated rows
are each judged, very long URLs whole; a rule without tokens is a candidate of every URL; of equally long rules that fit, the larger name decides, then
the larger verdict; an empty table gives no rows; an empty rule list gives verdicts without rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.llm.common import ascii_lower, broadcast_if_small, numbered, table
from presswork.session import checkpoint

#: (host, path, verdict); fixed values of the query's contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: A token that every URL has; it indexes rules without literal tokens.
ANY = ""
SALTS = 16
#: Rules that are looked up without a join at most.
IN_PLACE = 500


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substring_index(F.expr("substring(_pw_url, locate('://', _pw_url) + 3)"), "#", 1)).otherwise("")
    bare = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = ascii_lower(F.substring_index(bare, "/", 1))
    return host, F.substring(bare, F.length(F.substring_index(bare, "/", 1)) + 1, 2**31 - 1)


def _tokens(host: Column, path: Column) -> Column:
    """Labels of the host and whole segments of the path (a segment counts if a slash ends it), marked apart."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    closed = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    segments = F.transform(closed, lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda x: ~x.isin("h:", "p:")))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9/])", r"\\$1")


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``(token, rule, verdict, pattern, length)``: each rule under the token that ``urls`` (with ``_pw_tokens``) hold least often."""
    named = rules.select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict", F.concat(ascii_lower(F.col("host")), "path").alias("rule")
    ).withColumn("token", F.explode_outer(_tokens(F.col("host"), F.col("path"))))
    named = checkpoint(named)
    wanted, small = broadcast_if_small(named.select("token").where("token is not null").distinct())
    held = urls.select(F.explode("_pw_tokens").alias("token"))
    seen = held.join(wanted, "token", "left_semi").groupBy("token").count()
    counted = named.join(seen, "token", "left").groupBy("rule", "host", "path", "verdict").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("rare")
    )
    return counted.select(
        F.coalesce(F.col("rare.token"), F.lit(ANY)).alias("token"),
        "rule",
        "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(F.col("host")), _quoted(F.col("path"))).alias("pattern"),
        F.length("rule").alias("length"),
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names in ``pages`` are replaced."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col("_pw_url"))
    rows = (
        numbered(pages.select(F.struct(*keep).alias("_pw_row"), F.col(url).alias("_pw_url")), "_pw_id")
        .withColumns({"_pw_host": host, "_pw_path": path})
        .withColumn("_pw_tokens", F.concat(_tokens(F.col("_pw_host"), F.col("_pw_path")), F.array(F.lit(ANY))))
        .drop("_pw_url")
    )
    index = checkpoint(rule_index(rules, rows))
    few = index.limit(IN_PLACE + 1).collect()
    if len(few) <= IN_PLACE:
        best = _best_in_place(few)
        return rows.withColumn("_pw_best", best).select(*_result(keep, default))
    index, small = broadcast_if_small(index)
    held = rows.withColumn("_pw_token", F.explode("_pw_tokens")).drop("_pw_tokens")
    if small:
        held = held.join(index, F.col("_pw_token") == F.col("token"), "left")
    else:
        salted = index.withColumn("_pw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("_pw_mine", F.pmod("_pw_id", F.lit(SALTS))).join(
            salted, (F.col("_pw_token") == F.col("token")) & (F.col("_pw_mine") == F.col("_pw_salt")), "left"
        )
    fits = F.when(F.col("pattern").isNotNull() & F.expr("concat(_pw_host, _pw_path) rlike pattern"), F.struct("length", "rule", "verdict"))
    best = held.groupBy("_pw_id").agg(F.max(fits).alias("_pw_best"), *[F.first(c).alias(c) for c in ("_pw_row", "_pw_host", "_pw_path")])
    return best.select(*_result(keep, default))


def _best_in_place(index: list) -> Column:
    """The longest rule that fits, among the candidates that the URL's tokens have in a literal map."""
    by_token: dict[str, list] = {}
    for r in index:
        by_token.setdefault(r.token, []).append(F.struct(F.lit(r.length).alias("length"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")))
    if not by_token:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    rules = F.create_map(*[x for token, held in by_token.items() for x in (F.lit(token), F.array(*held))])
    fetched = F.flatten(F.filter(F.transform("_pw_tokens", lambda t: F.element_at(rules, t)), lambda found: found.isNotNull()))
    text = F.concat("_pw_host", "_pw_path")
    return F.array_max(F.transform(F.filter(fetched, lambda r: F.regexp_like(text, r["pattern"])), lambda r: F.struct(r["length"], r["rule"], r["verdict"])))


def _result(keep: list[str], default: str) -> list[Column]:
    return [
        *[F.col("_pw_row")[c].alias(c) for c in keep],
        F.col("_pw_host").alias("host"),
        F.col("_pw_path").alias("path"),
        F.col("_pw_best.rule").alias("rule"),
        F.coalesce(F.col("_pw_best.verdict"), F.lit(default)).alias("verdict"),
    ]


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS bare FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(bare, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(bare, ''), length(regexp_extract(coalesce(bare, ''), '^[^/]*')) + 1) AS path,
         row_number() OVER () AS row_id
  FROM u),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (
  SELECT p.row_id, rhost || rpath AS rule, verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY length(rhost || rpath) DESC) = 1)
SELECT page_id, host, path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (row_id)
"""
