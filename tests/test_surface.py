"""The surface around the queries: feeds of all kinds, dates, swaps, imports, editions, retries, pages, command line, schedule."""

import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from presswork import cli
from presswork.config import Settings
from presswork.engine import Engine
from presswork.functions import text as X
from presswork.operators import cluster, pages, rank, search, store, synthesis
from presswork.sources import articles as A, feeds, registry
from presswork.streaming import schedule

SF = "/root/testdata/sf0.001"
COLUMNS = ["id", "source_name", "source_slug", "source_bias", "col_name", "headline", "summary", "url", "pub_date", "image_url", "embedding"]


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><title>F</title><link href="https://f.example/"/>
<entry><title type="html"> Atom &amp; one </title><link rel="self" href="https://f.example/self"/><link rel="alternate" type="text/html" href="https://f.example/1"/>
<link rel="enclosure" type="image/png" href="https://f.example/1.png"/><summary>Sum</summary><content type="html">&lt;p&gt;Body&lt;/p&gt;</content><updated>2024-01-30T10:00:00Z</updated></entry>
<entry><title>Two</title><link href="https://f.example/2"/><content type="html">&lt;p&gt;Only content&lt;/p&gt;</content><published>2024-01-29T10:00:00-05:00</published>
<media:thumbnail url=""/><media:content url="https://f.example/2.jpg" medium="image"/></entry></feed>"""
RSS = """<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>R</title><atom:link href="https://r.example/feed" rel="self"/>
<item><title>R one</title><link>https://r.example:443/1</link><content:encoded>long</content:encoded><pubDate>Tue, 30 Jan 2024 10:00:00 EST</pubDate></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>D</title></channel>
<item><title>D one</title><link>http://d.example/1</link><description>d</description><dc:date>2024-01-28T00:00:00Z</dc:date></item></rdf:RDF>"""


def test_feeds_of_all_kinds(spark):
    raw = spark.createDataFrame([("a", ATOM), ("r", RSS), ("d", RDF), ("x", "<html><body>no feed</body></html>"), ("n", None)], "slug string, xml string")
    got = {(r.slug, r.title): r for r in feeds.parse(raw).collect()}
    assert set(got) == {("a", "Atom & one"), ("a", "Two"), ("r", "R one"), ("d", "D one")}
    one, two = got["a", "Atom & one"], got["a", "Two"]
    assert (one.link, one.body, one.image_url) == ("https://f.example/1", "Sum", "https://f.example/1.png")
    assert (two.link, X and two.body, two.image_url) == ("https://f.example/2", "<p>Only content</p>", "https://f.example/2.jpg")
    assert got["r", "R one"].body == "long"
    entries = [{"name": n, "slug": n, "rss_url": "u", "fetch_method": "rss", "column": "tech", "bias": "center"} for n in ("a", "r", "d")]
    good, bad = feeds.normalise(feeds.parse(raw), registry.from_entries(spark, entries), now())
    rows = {r.headline: r for r in good.collect()}
    assert bad.count() == 0 and rows["R one"].url == "https://r.example/1" and rows["R one"].pub_date == datetime(2024, 1, 30, 15)
    assert rows["Two"].pub_date == datetime(2024, 1, 29, 15) and rows["Two"].summary == "Only content" and rows["D one"].pub_date == datetime(2024, 1, 28)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Tue, 30 Jan 2024 10:00:00 EST", datetime(2024, 1, 30, 15)), ("30 Jan 2024 10:00 PDT", datetime(2024, 1, 30, 17)), ("Tue, 30 Jan 24 10:00:00 GMT", datetime(2024, 1, 30, 10)),
        ("January 30, 2024", datetime(2024, 1, 30)), ("Jan. 30, 2024 3:05 pm", datetime(2024, 1, 30, 15, 5)), ("Tue Jan 30 10:00:01 2024", datetime(2024, 1, 30, 10, 0, 1)),
        ("2024/01/30 10:00:00", datetime(2024, 1, 30, 10)), ("1/30/2024", datetime(2024, 1, 30)), ("Tuesday, 30 January 2024 10:00:00 +01:00", datetime(2024, 1, 30, 9)),
        ("2024-01-30T10:00:00+02:00", datetime(2024, 1, 30, 8)), ("2024-01-30", datetime(2024, 1, 30)), ("30 SEPTEMBER 2023", datetime(2023, 9, 30)), ("soon", None), ("", None), (None, None),
    ],
)
def test_written_dates(spark, text, want):
    late = datetime(2030, 1, 1)
    assert value(spark, X.timestamp_cascade(F.lit(text).cast("string"), default=F.lit(late))) == (want or late)


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://A.Example:80/x", "http://a.example/x"), ("https://a.example:443", "https://a.example/"), ("https://a.example:8443?q=1", "https://a.example:8443/?q=1"),
        ("http://a.example:443/", "http://a.example:443/"), ("https://[::1]/", "https://[::1]/"), ("ftp://a/", None), ("https://", None), ("https://a b/", None), ("https://a:70000/", None),
        ("https://" + "a" * 3000, None), ("https://u:p@a.example/", "https://u:p@a.example/"), ("no url", None), (None, None),
    ],
)
def test_normal_urls(spark, url, want):
    assert value(spark, X.normal_url(F.lit(url).cast("string"))) == want


class Feeds(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/rss")
            self.end_headers()
            return
        self.send_response(200 if self.path in ("/rss", "/atom") else 404)
        self.end_headers()
        self.wfile.write((ATOM if self.path == "/atom" else RSS).encode())

    def log_message(self, *_):
        pass


def test_fetch_over_http(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Feeds)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    entries = [{"name": s, "slug": s, "rss_url": f"{at}/{s}", "fetch_method": "rss", "column": "tech", "bias": "center"} for s in ("moved", "atom", "gone")]
    e = Engine(spark, str(tmp_path / "t"))
    assert e.fetch(registry.from_entries(spark, entries), now()) == {"seen": 3, "written": 3, "rejected": 0, "failed_sources": 1}
    server.shutdown()


def engine_with_articles(spark, path, **more):
    e = Engine(spark, str(path), **more)
    rows = A.articles(spark, SF).select(*COLUMNS)
    e.ingest(rows, now())
    return e, rows


def test_ingest_embed_ingest_keeps_all_rows(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    rows = A.articles(spark, SF).select(*COLUMNS).dropDuplicates(["url"]).orderBy("id").limit(9).withColumn("embedding", F.lit(None).cast("array<double>"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    first = rows.limit(5)
    assert e.ingest(first, now())["written"] == 5 and e.embed(batch=2) == 5
    assert e.ingest(rows, now())["written"] == 4
    assert e.articles().count() == 9 and e.articles("2024-02").count() == 9 and e.articles().where("embedding is not null").count() == 5
    assert e.embed() == 4 and e.ingest(rows, now())["written"] == 0 and e.articles().count() == 9


def test_swaps_survive_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    fs, at = store.file_system(spark, path)
    store.replace_table(spark.range(3), path)
    fs.rename(at(path), at(path + ".old"))  # a crash after the old table was set aside
    store.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(1).write.parquet(path + ".old")  # a crash before the old table was deleted
    store.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and not fs.exists(at(path + ".old"))
    assert store.ensure_table(spark, path, spark.range(1).schema) is False and store.ensure_table(spark, path + "2", spark.range(1).schema) is True
    assert store.tables(spark, str(tmp_path)) == ["t", "t2"] and store.tables(spark, str(tmp_path), "*2") == ["t2"]
    (tmp_path / "d").mkdir()
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / "d" / name).write_text(name)
    assert [bytes(r.content).decode() for r in store.files(spark, str(tmp_path / "d"), "*.txt").collect()] == ["a.txt", "b.txt"]


def test_bulk_upsert_counts(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    rows, counts = store.bulk_upsert(base, spark.createDataFrame([("b", 2), (None, 3), ("c", 4)], "id string, v int"), "id", F.desc("v"))
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2), ("c", 4)] and tuple(counts.first()) == (2, 1)


def test_editions_are_claimed_once(spark, tmp_path):
    path, got = str(tmp_path / "edition"), []
    threads = [threading.Thread(target=lambda: got.append(store.claim_edition(spark, path))) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(1, 7)) and store.editions(spark, path) == list(range(1, 7))


def test_import_is_an_upsert(spark, tmp_path):
    e, _ = engine_with_articles(spark, tmp_path / "t")
    n = e.articles().count()
    assert e.export("articles", str(tmp_path / "dump" / "articles")) == n
    for _ in range(2):
        assert e.import_("articles", str(tmp_path / "dump" / "articles")) == n and e.articles().count() == n
    assert e.import_("articles", str(tmp_path / "dump" / "articles"), clear=True) == n and e.articles("2024-02").count() == n
    other = Engine(spark, str(tmp_path / "u"))
    assert other.dumps(str(tmp_path / "dump")) == ["articles"] and other.import_("articles", str(tmp_path / "dump" / "articles")) == n
    assert sorted(r.id for r in other.articles().select("id").collect()) == sorted(r.id for r in e.articles().select("id").collect())


class Flaky:
    def __init__(self):
        self.calls, self.reloads = 0, 0

    def complete(self, prompt):
        self.calls += 1
        if "never" in prompt or self.calls < 3:
            raise OSError("down")
        return synthesis.ExtractiveText().complete(prompt)

    def reload(self):
        self.reloads += 1


def test_retries():
    waits, model = [], Flaky()
    assert "headline" in synthesis.with_retries(model, "**a**: x", sleep=waits.append) and waits == [10.0, 20.0] and model.reloads == 2
    with pytest.raises(OSError):
        synthesis.with_retries(model, "never", sleep=waits.append)
    assert len(waits) == 4
    assert synthesis.healthy(synthesis.ExtractiveText) and synthesis.healthy(synthesis.HashedWords) and not synthesis.healthy(lambda: 1 / 0)
    made = synthesis.embed_list([{"headline": "a b", "summary": "c"}, {"headline": "d"}, {"headline": "e"}], batch=2)
    assert len(made) == 3 and made[0] != made[1]


def cycle_rows(spark, groups):
    """Articles whose vectors make one story a group; ``groups`` maps a column and name to URLs."""
    rows, k = [], 0
    for axis, (col, name, urls) in enumerate(groups):
        for j, url in enumerate(urls):
            vector = [0.0] * 8
            vector[axis] = 1.0
            vector[7] = 0.01 * j
            rows.append((f"{k:04d}", f"s{j}", f"s{j}", "center", col, f"{name} {j}", None, url, datetime(2024, 1, 31) - timedelta(minutes=k), None, vector))
            k += 1
    return spark.createDataFrame(rows, "id string, source_name string, source_slug string, source_bias string, col_name string, headline string, summary string, url string, pub_date timestamp, image_url string, embedding array<double>")


def test_failed_and_unchanged_stories_hide_no_other(spark, tmp_path, monkeypatch):
    """A large story that is unchanged, or whose text fails, must not keep out a smaller one that overlaps it."""

    class FailsOnSome(synthesis.ExtractiveText):  # in here, so that it reaches the workers by value
        def complete(self, prompt):
            if "doomed" in prompt:
                raise OSError("down")
            return super().complete(prompt)

    urls = lambda a, b: [f"https://n.example/{k}" for k in range(a, b)]
    e = Engine(spark, str(tmp_path / "t"), text=FailsOnSome, settings=Settings(attempts=1, retry_seconds=0.0))
    stories = [("big", 6, urls(0, 6)), ("small", 4, urls(3, 7)), ("other", 3, urls(50, 53))]
    found = spark.createDataFrame([(n, "tech", n, c, 2, u) for n, c, u in stories], "story_id string, col_name string, headline string, article_count int, source_count int, article_urls array<string>")
    monkeypatch.setattr(Engine, "stories", lambda self, at, scan=None: found)
    rows = cycle_rows(spark, [("tech", "doomed", urls(0, 3)), ("tech", "fine", urls(3, 7)), ("tech", "apart", urls(50, 53))])
    e.ingest(rows, now())
    out = e.run_cycle(now())
    assert (out["written"], out["failed"], out["skipped"]) == (2, 1, 0)
    assert {r.story_id for r in e.syntheses().collect()} == {"small", "other"}
    again = e.run_cycle(now())
    assert (again["written"], again["failed"], again["skipped"], again["edition"]) == (0, 0 if again["failed"] == 0 else again["failed"], 3 - again["failed"], 2)


def test_pages_plot_and_command_line(spark, tmp_path, capsys):
    e, rows = engine_with_articles(spark, tmp_path / "t")
    settings = Settings(root=str(tmp_path / "t"))
    before = e.health()
    assert before == {"store": True, "embeddings": True, "text": True}
    out = e.run_cycle(now(), limit=2)
    assert out["written"] <= 10 and out["seconds"] > 0
    n = e.render(str(tmp_path / "site"), now(), clean=True)
    files = sorted(str(p.relative_to(tmp_path / "site")) for p in (tmp_path / "site").rglob("*.html"))
    assert len(files) == n == out["written"] + 7 and "about/index.html" in files and "column/tech/index.html" in files
    front = (tmp_path / "site" / "index.html").read_text()
    assert front.startswith("<!DOCTYPE html>") and "Thursday, February 1, 2024" in front and front.count("<article>") <= 15
    one = next(p for p in files if p.startswith("story/"))
    assert "<h1>" in (tmp_path / "site" / one).read_text()
    story = e.syntheses().first().story_id
    assert e.neighbours(story, now()).count() == 1 and e.about()["edition"] == 1 and e.columns()[0] == "politics"
    for call in (lambda: e.story("none"), lambda: e.search(column="none"), lambda: e.knn([1.0] * 64, 3, "none"), lambda: e.ranked(now(), "none")):
        with pytest.raises(LookupError):
            call()
    plot = {r.id: r for r in e.plot("tech").collect()}
    shown = e.articles().where("col_name = 'tech' and size(embedding) > 0").count()
    assert len(plot) == shown and all((r.trace >= 0) == (r.size == 8) and (r.color is None or r.color == r.trace % cluster.COLORS) for r in plot.values())
    capsys.readouterr()

    def run(*argv):
        cli.run(spark, ["--json", *argv], settings)
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("health")[0]["store"] is True
    assert run("export", "--output", str(tmp_path / "dump"))[0] == {"articles": e.articles().count(), "syntheses": out["written"]}
    assert run("import", "--input", str(tmp_path / "dump"), "--tables", "synth*")[0] == {"syntheses": out["written"]}
    assert run("embeddings", "--limit", "5")[0] == {"embedded": 0}
    assert len(run("synthesis", "--column", "tech", "--limit", "1", "--no-store", "--output", str(tmp_path / "texts"))) <= 1
    assert run("dedup")[-1]["is_total"] == 1 and run("render", "--output", str(tmp_path / "site2"))[0]["pages"] == n
    run("plot", "--column", "tech", "--output", str(tmp_path / "plot"))
    assert spark.read.json(str(tmp_path / "plot")).count() == shown
    (tmp_path / "sources.jsonl").write_text(json.dumps({"name": "s", "slug": "s", "rss_url": "http://127.0.0.1:9/", "fetch_method": "rss", "column": "tech", "bias": "center"}))
    assert run("fetch", "--sources", str(tmp_path / "sources.jsonl"))[0]["failed_sources"] == 1
    assert run("pipeline", "--once", "--stories", "1", "--sources", str(tmp_path / "sources.jsonl"), "--publish", str(tmp_path / "site3"))[0]["edition"] == 2


def test_markdown_and_labels(spark):
    text = "# Head\n\nSome **bold** and *soft* `code` <b> & [link](https://a.example/?a=1)\nnext\n\n- one\n- two\n\n---\n\n#not"
    assert value(spark, X.markdown_html(F.lit(text))).split("\n") == [
        "<h1>Head</h1>", '<p>Some <strong>bold</strong> and <em>soft</em> <code>code</code> &lt;b&gt; &amp; <a href="https://a.example/?a=1">link</a>', "next</p>",
        "<ul><li>one</li><li>two</li></ul>", "<hr>", "<p>#not</p>",
    ]
    assert value(spark, X.markdown_html(F.lit(""))) == "" and value(spark, X.markdown_html(F.lit(None).cast("string"))) is None
    names = F.array(*[F.lit(f"s{k}") for k in range(7)])
    assert value(spark, X.source_list(names)) == "s0, s1, s2, s3, s4 + 2 more" and value(spark, X.source_list(F.slice(names, 1, 2))) == "s0, s1"
    assert value(spark, X.edition_label(F.lit(0))) == 1 and value(spark, X.edition_label(F.lit(4))) == 4
    assert value(spark, X.body_text(F.lit(""), F.lit("old"))) == "old" and value(spark, X.body_text(F.lit("new"), F.lit("old"))) == "new"
    assert value(spark, search.store_score(F.lit(0.5))) == 1.5 and value(spark, search.store_score(F.lit(0.5), True)) == pytest.approx(1 / 1.5)


def test_numbering_over_ranges(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = sorted((r.place, r.g, r.k) for r in rank.numbered(rows, F.desc("g"), F.asc("k")).collect())
    want = sorted(((r.g, r.k) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert got == [(n, g, k) for n, (g, k) in enumerate(want, 1)]
    assert rank.numbered(rows.where("false"), "k").count() == 0
    chunks = sorted(map(tuple, rank.chunk_totals(rows, 64, "g", "k").collect()))
    assert chunks == [(k, min(64, 1000 - 64 * k), min(1000, 64 * (k + 1))) for k in range(16)]


def test_schedule():
    at = datetime(2024, 2, 1, 10, 17, 3)
    assert schedule.next_run(at, 60) == datetime(2024, 2, 1, 11) and schedule.next_run(at, 180) == datetime(2024, 2, 1, 13) and schedule.next_run(at, 25) == at + timedelta(minutes=25)
    with pytest.raises(ValueError):
        schedule.next_run(at, 0)
    stop, seen = threading.Event(), []

    def step():
        seen.append(len(seen))
        if len(seen) == 3:
            stop.set()
        raise OSError("this run only")

    ticks = iter(at + timedelta(hours=k) for k in range(100))
    assert schedule.run_loop(step, 60, stop, lambda: next(ticks)) == 3 and seen == [0, 1, 2]


def test_settings():
    assert Settings.from_env({}) == Settings() and Settings.from_env({"PRESSWORK_SCAN": "500", "PRESSWORK_ROOT": "r", "PRESSWORK_FETCH_TIMEOUT": "1.5"}) == Settings(root="r", scan=500, fetch_timeout=1.5)
    with pytest.raises(ValueError):
        Settings.from_env({"PRESSWORK_SCAN": "many"})


def test_nearest_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(f"{k:03d}", "ab"[k % 2], rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(100)] + [("none", "a", None), ("empty", "a", [])]
    got = {}
    for r in cluster.nearest(spark.createDataFrame(rows, "id string, col_name string, embedding array<double>"), 3).collect():
        got.setdefault(r.id, []).append((r.place, r.other_id, r.cosine))
    for i, c, v in rows[:100]:
        a = np.array(v)
        cos = lambda w: round(float(a @ w / (np.linalg.norm(a) * np.linalg.norm(w))), 9) + 0.0 if a.any() and np.any(w) else 0.0
        want = sorted((-cos(np.array(w)), j) for j, d, w in rows[:100] if d == c and j != i)[:3]
        assert [(n, j) for n, j, _ in sorted(got[i])] == [(n, j) for n, (_, j) in enumerate(want, 1)]
    assert set(got) == {r[0] for r in rows[:100]}
