"""The quality model is fitted on all trusted rows of its half, whole, and scores alike by broadcast and by joins."""

import random

import pytest
from test_models import DOCS, corpus, edge_rows

from presswork.llm import quality


def test_all_rows_of_the_half_fit_the_model(spark):
    """More rows than the old sample of 3,000 took."""
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id < 8500, concat('text ', id), if(id < 8700, '', null)) as text")
    trusted = docs.select("doc_id")
    got = {r.doc_id for r in quality._sample_ids(docs.unionByName(docs.limit(50)), trusted).collect()}
    assert got == {r.id for r in spark.range(8500).where("pmod(xxhash64(id), 2) = 0").collect()} and len(got) > 4000


def test_long_trusted_rows_are_counted_whole(spark, monkeypatch):
    """Every character of a long trusted text is in the model, though n-grams are counted in pieces."""
    first = spark.range(1000).where("pmod(xxhash64(id), 2) = 0").first().id
    text = "".join(chr(0x4E00 + k % 400) for k in range(200_000)) + "Ω" + "".join(chr(0x4E00 + k % 400) for k in range(50_000))
    docs = spark.createDataFrame([(first, text, "en", "s0", len(text), 1, "x")], DOCS)
    marks = spark.createDataFrame([(first, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.Classifier(docs, marks).points.count(ord("Ω")) == 1
    rows = spark.createDataFrame([(text,), (None,), ("",), ("abc",)], "text string")
    points = (*range(0x4E00, 0x4E00 + 400), ord("Ω"))
    count = lambda: {r.g: r.c for r in rows.mapInArrow(quality._count_grams(points), "g long, c long").groupBy("g").sum("c").toDF("g", "c").collect()}
    whole = count()
    assert sum(whole.values()) == len(text) + 3
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 7001)
    assert count() == whole


def test_a_model_too_large_to_broadcast_judges_alike(spark, monkeypatch):
    rows, labels = corpus(random.Random(4), 120, 20)
    docs = spark.createDataFrame(rows + edge_rows(), DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def judged():
        c = quality.Classifier(docs, marks)
        assert (c.shared is None) == (quality.BROADCAST_GRAMS == 10)
        return {r._pw_row: (r.doc_id, r._pw_n, r._pw_score, r._pw_threshold, r._pw_keep) for r in c.judge(c.scored).collect()}

    want = judged()
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 10)
    got = judged()
    assert len(want) == len(rows) + len(edge_rows()) and got.keys() == want.keys()
    for k, (doc_id, n, score, threshold, keep) in want.items():
        assert got[k][:2] == (doc_id, n) and got[k][2:4] == (pytest.approx(score, rel=1e-6), pytest.approx(threshold, rel=1e-6))
        if abs(score - threshold) > 1e-6 * threshold:  # else sums in another order may decide
            assert got[k][4] == keep
