"""Internationalised hosts of links."""

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as X
from presswork.functions.hosts import to_ascii


@pytest.mark.parametrize(
    "host, want",
    [
        ("münchen.example", "xn--mnchen-3ya.example"), ("MÜNCHEN.Example", "xn--mnchen-3ya.example"), ("mu\u0308nchen.example", "xn--mnchen-3ya.example"), ("例え。テスト", "xn--r8jz45g.xn--zckzah"),
        ("straße.example", "xn--strae-oqa.example"), ("ｅｘ.example", "ex.example"), ("ü" * 70 + ".example", None), ("a..ü", None), ("ü.example.", "xn--tda.example"), (".".join(["ü" * 20] * 12), None), ("a℀ü", None),
    ],
)
def test_hosts(host, want):
    assert to_ascii(host) == want


def test_urls(spark):
    rows = [("http://user@MÜNCHEN.example:8080/ä?b", "http://user@xn--mnchen-3ya.example:8080/ä?b"), ("https://münchen.example:443", "https://xn--mnchen-3ya.example/"), ("http://a.example/ü", "http://a.example/ü"), ("http://ü..x/", None), (None, None)]
    got = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "k int, u string").select("k", X.normal_url(F.col("u")).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [want for _, want in rows]
