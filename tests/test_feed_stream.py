"""Feeds as batch and stream sources from a local server."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from presswork.sources import feed_stream, feeds


@pytest.fixture()
def server():
    state = {"version": {"/a": 1, "/b": 1}, "read": []}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            n = state["version"].get(self.path)
            self.send_response(200 if n else 404)
            if n and self.path != "/plain":
                self.send_header("ETag", f'"{n}"')
            self.end_headers()
            if body and n:
                state["read"].append(self.path)
                self.wfile.write(f"<rss>{self.path} {n}</rss>".encode())

        def do_GET(self):
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", "ftp://127.0.0.1/x")
                self.end_headers()
                return
            self.answer(True)

        def do_HEAD(self):
            self.answer(False)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{http.server_port}"
    yield state
    http.shutdown()


def registry(spark, server, *paths):
    rows = [(p.strip("/"), server["url"] + p) for p in paths] + [("none", None)]
    return spark.createDataFrame(rows, "slug string, rss_url string")


def test_batch(spark, server):
    rows = {r.slug: r for r in feed_stream.read(registry(spark, server, "/a", "/gone")).collect()}
    assert rows["a"].xml == "<rss>/a 1</rss>" and rows["a"].error is None
    assert rows["gone"].xml is None and "404" in rows["gone"].error and len(rows) == 2


def test_stream_skips_what_is_unchanged_and_resumes(spark, server, tmp_path):
    def run():
        before = len(server["read"])
        out = feed_stream.read_stream(registry(spark, server, "/a", "/b", "/plain")).writeStream.format("parquet")
        q = out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(server["read"][before:])

    server["version"]["/plain"] = 1  # says nothing about its content: once a period
    assert run() == ["/a", "/b", "/plain"]
    assert run() == []
    server["version"]["/b"] = 2
    assert run() == ["/b"]
    rows = sorted((r.slug, r.xml) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("a", "<rss>/a 1</rss>"), ("b", "<rss>/b 1</rss>"), ("b", "<rss>/b 2</rss>"), ("plain", "<rss>/plain 1</rss>")]


def test_only_http_and_only_so_much(server, tmp_path):
    (tmp_path / "x").write_text("secret")
    for url in (f"file://{tmp_path}/x", "ftp://127.0.0.1/x", "data:,x", server["url"] + "/away"):
        with pytest.raises(Exception):
            feeds.http_get(url, 5)
    with pytest.raises(ValueError, match="more than 5 bytes"):
        feeds.http_get(server["url"] + "/a", most=5)
    assert feeds.http_get(server["url"] + "/a", most=50) == "<rss>/a 1</rss>" and feeds.http_version(server["url"] + "/a") == '"1"'
