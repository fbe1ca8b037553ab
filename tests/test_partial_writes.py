"""Updates that write only their partitions, the greedy batch in rounds, and the newest rows without moving vectors."""

import os
import random

from pyspark.sql import functions as F

from presswork.operators import cluster, dedup, store


def months(spark, path):
    rows = [(f"a{k}", None if k % 3 else [1.0, float(k)], f"2024-0{1 + k % 4}") for k in range(40)]
    spark.createDataFrame(rows, "id string, embedding array<double>, ym string").write.partitionBy("ym").parquet(path)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_only_touched_months_are_written(spark, tmp_path):
    path = str(tmp_path / "articles")
    months(spark, path)
    before = files(path)
    made = spark.createDataFrame([("a1", [5.0]), ("a5", [6.0]), ("a2", None), ("unknown", [7.0])], "id string, embedding array<double>")
    assert store.update_partitions(spark, path, made, "id", "embedding", "ym") == ["ym=2024-02"]
    after = files(path)
    same = {f: t for f, t in before.items() if "ym=2024-02" not in f}
    assert same and same.items() <= after.items() and not [f for f in before if "ym=2024-02" in f and f in after]
    rows = {r.id: r.embedding for r in spark.read.parquet(path).collect()}
    assert len(rows) == 40 and rows["a1"] == [5.0] and rows["a5"] == [6.0] and rows["a9"] == [1.0, 9.0] and rows["a2"] is None
    assert sorted(os.listdir(tmp_path)) == ["articles"]
    assert store.update_partitions(spark, path, made.where("id = 'unknown'"), "id", "embedding", "ym") == []


def test_a_month_set_aside_comes_back(spark, tmp_path):
    path = str(tmp_path / "articles")
    months(spark, path)
    os.makedirs(f"{path}.parts")
    os.rename(f"{path}/ym=2024-03", f"{path}.parts/ym=2024-03")  # a crash between two renames
    os.makedirs(f"{path}.parts/ym=2024-01")  # and one whose successor is in place
    store.recover(spark, path)
    assert spark.read.parquet(path).count() == 40 and sorted(os.listdir(tmp_path)) == ["articles"]


def test_greedy_batch_in_rounds(spark):
    rng = random.Random(3)
    rows = []
    for c in ("x", "y"):
        for k in range(80):
            start = rng.randrange(60)
            rows.append((f"{c}{k:03d}", c, rng.randrange(3, 9), [f"u{start + j}" for j in range(rng.randrange(3, 9))] + ["u1", "u1"][: rng.randrange(3)]))
    rows += [(f"z{k:03d}", "z", 50 - k, [f"w{2 * k + j}" for j in range(4)]) for k in range(30)]  # a chain, each overlapping the next
    rows.append(("none", None, 5, ["u1", "u2", "u3"]))
    want = {}
    for c in ("x", "y", "z", None):
        kept = []
        for story, _, _, urls in sorted((r for r in rows if r[1] == c), key=lambda r: (-r[2], r[0])):
            urls = set(urls)
            want[story] = any(len(urls & k) / len(urls | k) > dedup.OVERLAP for k in kept)
            if not want[story]:
                kept.append(urls)
    df = spark.createDataFrame(rows, "story_id string, col_name string, article_count int, article_urls array<string>")
    assert {r.story_id: r.dropped for r in dedup.greedy_batch(df).collect()} == want
    assert dedup.greedy_batch(df.limit(0)).count() == 0


def test_newest_moves_ids_only(spark):
    rows = [(f"a{k}", "x" if k % 3 else None, f"2024-01-{1 + k % 28:02d}", [float(k)]) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, col_name string, d string, embedding array<double>").withColumn("pub_date", F.col("d").cast("timestamp"))
    found = cluster.newest(df, 7)
    got = {c: [r.id for r in sorted(found.collect(), key=lambda r: r.position) if r.col_name == c] for c in ("x", None)}
    for c in got:
        assert got[c] == [r[0] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (-int(r[2][-2:]), r[0]))][:7]
    plan = found._jdf.queryExecution().executedPlan().toString().replace("+- ", "")
    below = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert below and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
