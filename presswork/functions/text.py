"""Text, date and JSON functions, as Column expressions; only dates that aren't ISO 8601 go through Arrow."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from presswork import schema
from presswork.functions.dates import free_date
from presswork.functions.hosts import ascii_host


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def clean_html(text: Column) -> Column:
    """Drop tags, collapse white space, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"(?U)\s+", " "))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def headline_tokens(headline: Column) -> Column:
    """Distinct runs of a-z of the lower-cased headline without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(headline), F.lit("([a-z]+)"), 1))
    return F.array_except(words, F.array(*[F.lit(w) for w in schema.STOP_WORDS]))


def search_tokens(text: Column) -> Column:
    """Tokens of an analysed field: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def embedding_text(headline: Column, summary: Column) -> Column:
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(headline, F.lit("\n\n"), summary)).otherwise(headline)


def prompt_line(source_name: Column, headline: Column, summary: Column) -> Column:
    head = F.concat(F.lit("**"), F.coalesce(source_name, F.lit("Unknown")), F.lit("**: "), F.coalesce(headline, F.lit("")))
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(head, F.lit("\n  "), truncate(summary, 500))).otherwise(head)


def bias_label(bias: Column) -> Column:
    return F.upper(F.replace(bias, F.lit("-"), F.lit(" ")))


def token_estimate(n_chars: Column) -> Column:
    return F.floor(n_chars / F.lit(3.5))


def prompt_budget(context: int = 32768, max_tokens: int = 1500) -> int:
    return context - max_tokens - context // 10


def json_text(noisy: Column) -> Column:
    """The outermost braces of a model's answer, without fences and thinking."""
    bare = F.regexp_replace(noisy, r"```(?:json)?\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"`+$", "")
    bare = F.regexp_replace(bare, r"(?s)<think>.*?</think>", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def parse_json(noisy: Column, fields: str) -> Column:
    """Lenient parse into ``fields``; null if there is no object. Raw line breaks inside strings are let through."""
    return F.from_json(json_text(noisy), fields, {"allowUnquotedControlChars": "true"})


def _date(text: Column) -> Column:
    """ISO 8601 as it stands, else by the grammar of written dates."""
    iso = F.try_to_timestamp(text)
    return F.coalesce(iso, free_date(F.when(iso.isNull(), text)))


def timestamp_cascade(*texts: Column, default: Column) -> Column:
    """The first text that is a date; a missing zone means UTC."""
    return F.coalesce(*[_date(t) for t in texts], default)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def dateline(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, MMMM d, yyyy")


def hours_between(now: Column, then: Column) -> Column:
    """Hours from then to now, at least 1."""
    return F.greatest(F.lit(1.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(3.6e9))


def relative_time(now: Column, then: Column) -> Column:
    seconds = F.floor((F.unix_millis(now) - F.unix_millis(then)) / F.lit(1000.0))
    minutes, hours, days = (F.floor(seconds / F.lit(float(k))) for k in (60, 3600, 86400))
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 7, ago(days, "d"))
        .otherwise(F.date_format(then, "MMM d"))
    )


def full_time(now: Column, then: Column) -> Column:
    return F.concat(F.date_format(then, "MMM d, h:mm a"), F.lit(" ("), relative_time(now, then), F.lit(")"))


def title_label(bias: Column) -> Column:
    """Capitalise after blanks and hyphens: the known biases by table, others by word."""
    known = literal_map({b: "-".join(w.capitalize() for w in b.split("-")) for b in schema.BIASES})
    return F.coalesce(F.element_at(known, bias), F.initcap(bias))


def bias_color(bias: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(schema.BIAS_COLORS), bias), F.lit(schema.DEFAULT_COLOR))


def extension(path: Column) -> Column:
    """With its dot, lower-cased; empty for names without one or that only begin with one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def content_type(path: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(schema.CONTENT_TYPES), extension(path)), F.lit(schema.DEFAULT_CONTENT_TYPE))


def cache_control(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.coalesce(
        F.element_at(literal_map(schema.CACHE_BY_NAME), name), F.element_at(literal_map(schema.CACHE_BY_EXTENSION), extension(path)), F.lit(schema.DEFAULT_CACHE)
    )


def object_key(path: Column, root: str) -> Column:
    """Path below ``root``, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + root.rstrip("/") + "/", "")


def content_hash(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 8)


def index_uri(uri: Column) -> Column:
    """A directory's index page; a name without a dot is a directory."""
    return F.when(F.endswith(uri, F.lit("/")), F.concat(uri, F.lit("index.html"))).when(~F.substring_index(uri, "/", -1).contains("."), F.concat(uri, F.lit("/index.html"))).otherwise(uri)


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, an empty path as a slash; null unless it is http(s) with a plausible host and port.

    Hosts beyond ASCII are turned into their ASCII form; only they go through Arrow.
    """
    host = r"(?:[^/?#\s@]*@)?(?:[^/?#\s@:\[\]<>^|\\%\"]+|\[[0-9a-fA-F:.]+\])(?::\d{1,5})?"
    ok = F.regexp_like(url, F.lit(rf"(?i)^https?://{host}(?:[/?#]\S*)?$")) & (F.length(url) <= 2083)
    ok &= F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(url, r"^[^:]+://[^/?#]*:(\d{1,5})(?:[/?#]|$)", 1), F.lit("")), F.lit("99999")), F.lit(0)) <= 65535
    head = F.lower(F.regexp_extract(url, r"^([^:]+://[^/?#]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_extract(url, r"^[^:]+://[^/?#]*(.*)$", 1)
    before, host, port = (F.regexp_extract(head, r"^([a-z]+://(?:[^@]*@)?)(.*?)(:\d+)?$", k) for k in (1, 2, 3))
    foreign = F.regexp_like(host, F.lit(r"[^\x00-\x7F]"))
    head = F.when(foreign, F.concat(before, ascii_host(F.when(foreign, host)), port)).otherwise(head)
    return F.when(ok, F.concat(head, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def image_url(thumbnails: Column, media: Column, enclosures: Column) -> Column:
    """The first thumbnail if it has a url, then declared image (even without url, which ends the search), then any media url, then an image enclosure."""
    is_image = lambda m: (F.coalesce(m["medium"], F.lit("")) == "image") | F.startswith(F.coalesce(m["type"], F.lit("")), F.lit("image/"))
    declared = F.filter(media, is_image)
    with_url = F.filter(media, lambda m: F.coalesce(m["url"], F.lit("")) != "")
    pictures = F.filter(enclosures, lambda e: F.startswith(F.coalesce(e["type"], F.lit("")), F.lit("image/")))
    first = lambda a: F.get(a, F.lit(0))
    return (
        F.when(F.coalesce(first(thumbnails)["url"], F.lit("")) != "", first(thumbnails)["url"]).when(F.size(declared) > 0, first(declared)["url"])
        .when(F.size(with_url) > 0, first(with_url)["url"]).otherwise(first(pictures)["url"])
    )


def story_id(article_id: Column) -> Column:
    return F.concat(F.lit("story-"), F.substring(article_id, 1, 8))


def body_text(article: Column, summary: Column) -> Column:
    """A story's text under its present name, else its former one."""
    return F.coalesce(F.nullif(article, F.lit("")), F.nullif(summary, F.lit("")), F.lit(""))


def source_list(names: Column, n: int = 5) -> Column:
    """The first names and how many more there are."""
    more = F.size(names) - n
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" + "), more.cast("string"), F.lit(" more"))).otherwise(""))


def edition_label(edition: Column) -> Column:
    """The edition's number, 1 where there is none yet."""
    return F.coalesce(F.nullif(edition, F.lit(0)), F.lit(1))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def markdown_html(text: Column) -> Column:
    """HTML of a subset of Markdown: headings, lists, rules, paragraphs, strong, emphasis, code and links; other markup is text."""
    t = escape_html(F.regexp_replace(text, r"\r\n?", "\n"))
    for pattern, html in (
        (r"`([^`\n]+)`", "<code>$1</code>"), (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"\*([^*\n]+)\*", "<em>$1</em>"),
        (r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)", '<a href="$2">$1</a>'),
    ):
        t = F.regexp_replace(t, pattern, html)

    def block(b: Column) -> Column:
        items = F.array_join(F.transform(F.split(b, "\n"), lambda x: F.concat(F.lit("<li>"), F.regexp_replace(x, r"^[-*] ", ""), F.lit("</li>"))), "")
        level = F.length(F.regexp_extract(b, "^(#+) ", 1)).cast("string")
        return (
            F.when(F.regexp_like(b, F.lit(r"^#{1,6} [^\n]*$")), F.concat(F.lit("<h"), level, F.lit(">"), F.regexp_replace(b, "^#+ ", ""), F.lit("</h"), level, F.lit(">")))
            .when(F.regexp_like(b, F.lit(r"^(-{3,}|\*{3,})$")), F.lit("<hr>"))
            .when(F.regexp_like(b, F.lit(r"^[-*] [^\n]*(\n[-*] [^\n]*)*$")), F.concat(F.lit("<ul>"), items, F.lit("</ul>")))
            .otherwise(F.concat(F.lit("<p>"), b, F.lit("</p>")))
        )

    blocks = F.filter(F.transform(F.split(t, r"\n[ \t]*\n\s*"), lambda b: F.trim(b)), lambda b: b != "")
    return F.array_join(F.transform(blocks, block), "\n")
