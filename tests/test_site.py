"""Writing a site: all or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from presswork.operators import pages


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names if not f.startswith(".")}


def test_pages_take_their_places(spark, tmp_path):
    root = str(tmp_path / "site")
    rows = spark.range(50, numPartitions=5).select(F.format_string("story/%s/index.html", "id").alias("path"), F.format_string("<p>ü %s</p>", "id").alias("html"))
    assert pages.write(rows, root) == 50
    assert tree(root) == {f"story/{k}/index.html": f"<p>ü {k}</p>" for k in range(50)}
    assert pages.write(rows.where("id = 3").withColumn("html", F.lit("new")), root) == 1
    assert len(tree(root)) == 50 and tree(root)["story/3/index.html"] == "new"
    assert pages.write(rows.where("id < 2"), f"file:{root}", clean=True) == 2
    assert sorted(tree(root)) == ["story/0/index.html", "story/1/index.html"]


def test_a_failing_task_leaves_no_half_site(spark, tmp_path):
    root = str(tmp_path / "site")
    pages.write(spark.createDataFrame([("index.html", "old")], "path string, html string"), root)
    spark.dataSource.register(pages.Site)
    rows = spark.range(20, numPartitions=4).select(F.format_string("p%s.html", "id").alias("path"), F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("html"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            rows.write.format("site").option("path", root).mode(mode).save()
        assert tree(root) == {"index.html": "old"} and [d for d in os.listdir(root) if d.startswith("_drafts")] == []
