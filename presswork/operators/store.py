"""Table mutations as pure transforms, and the writers that put them on disk.

Parquet rows are not updated in place: an upsert gives the next snapshot, and ``replace_table`` writes it beside the old one
before it takes its name.
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from presswork import schema
from presswork.functions import text as X


def upsert(base: DataFrame, changes: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows of both, one per key: a change wins over the base, a later change (by ``order``) over an earlier one."""
    names = base.columns
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.select(*names).withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), *order))
    return both.withColumn("_rn", rank).where("_rn = 1").select(*names)


def update_column(base: DataFrame, updates: DataFrame, key: str, name: str) -> DataFrame:
    """Set one column where ``updates`` has a value for the key."""
    new = updates.groupBy(key).agg(F.max_by(name, F.when(F.col(name).isNotNull(), 1).otherwise(0)).alias("_value"))
    return base.join(new, key, "left").withColumn(name, F.coalesce("_value", name)).drop("_value").select(*base.columns)


def fill_defaults(syntheses: DataFrame, now: Column) -> DataFrame:
    """A synthesis with every field: defaults for what is missing, the source count derived."""
    have = set(syntheses.columns)
    defaults = {
        "original_headline": F.lit(""), "generated_headline": F.lit(""), "article": F.lit(""), "analysis": F.lit(""), "article_count": F.lit(0),
        "edition": F.lit(1), "is_current": F.lit(True), "hotness_score": F.lit(0.0), "generated_at": now,
        "sources_used": F.array().cast("array<string>"), "article_urls": F.array().cast("array<string>"),
        "bias_coverage": F.create_map().cast("map<string,bigint>"), "articles": F.array().cast(schema.SYNTHESIS["articles"].dataType),
    }
    out = {}
    for field in schema.SYNTHESIS.fields:
        own = [F.col(field.name)] if field.name in have else []
        out[field.name] = F.coalesce(*own, *([defaults[field.name]] if field.name in defaults else [F.lit(None)])).cast(field.dataType)
    out["source_count"] = F.size(out["sources_used"]).cast("int")
    return syntheses.select(*[c.alias(n) for n, c in out.items()])


def supersede(syntheses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark rows historical: ``pairs`` has ``old_id`` and ``new_id``. An id that supersedes itself stays current."""
    marked = syntheses.join(pairs.groupBy("old_id").agg(F.min("new_id").alias("_by")), syntheses.story_id == F.col("old_id"), "left")
    hit = F.col("_by").isNotNull() & (F.col("_by") != F.col("story_id"))
    return marked.withColumns({"is_current": F.when(hit, False).otherwise(F.col("is_current")), "superseded_by": F.when(hit, F.col("_by")).otherwise(F.col("superseded_by"))}).select(*syntheses.columns)


def delete_where(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and the number of deleted rows as a one-row frame; an unknown test deletes nothing."""
    hit = F.coalesce(test, F.lit(False))
    return rows.where(~hit), rows.where(hit).agg(F.count("*").alias("deleted"))


def delete_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def next_edition(editions: DataFrame) -> DataFrame:
    """The edition counter, one higher; 1 when there is none."""
    return editions.agg((F.coalesce(F.max("edition"), F.lit(0)) + 1).alias("edition"))


def route_by_month(articles: DataFrame, now: Column) -> DataFrame:
    """The partition of the run's month, whatever the publishing date."""
    return articles.withColumn("ym", X.month_key(now))


def write_articles(articles: DataFrame, path: str, now: Column) -> None:
    route_by_month(articles, now).write.mode("append").partitionBy("ym").parquet(path)


def bulk_upsert(base: DataFrame, changes: DataFrame, key: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The next snapshot, and one row ``(ok, errors)``: changes without a key can't be stored."""
    ok = F.col(key).isNotNull()
    counts = changes.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"))
    return upsert(base, changes.where(ok), key, *order), counts


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the maker of its paths."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was cut short: without a table, or a partition, the one set aside comes back; with one, that goes."""
    fs, at = file_system(spark, path)
    if fs.exists(at(f"{path}.parts")):
        for part in fs.listStatus(at(f"{path}.parts")):
            home = at(f"{path}/{part.getPath().getName()}")
            if not fs.exists(home) and not fs.rename(part.getPath(), home):
                raise OSError(f"cannot put back {home}")
        fs.delete(at(f"{path}.parts"), True)
    if not fs.exists(at(f"{path}.old")):
        return
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.old"), True)
    elif not fs.rename(at(f"{path}.old"), at(path)):
        raise OSError(f"cannot put back {path}")


def replace_table(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a snapshot that may derive from the table at ``path``: beside it first, then in its place.

    The old table is set aside, not deleted, until the new one has its name; ``recover`` repairs what a crash leaves.
    """
    spark = rows.sparkSession
    fs, at = file_system(spark, path)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}.next")
    recover(spark, path)
    if fs.exists(at(path)) and not fs.rename(at(path), at(f"{path}.old")):
        raise OSError(f"cannot set aside {path}")
    if not fs.rename(at(f"{path}.next"), at(path)):
        raise OSError(f"cannot put the new snapshot at {path}")
    fs.delete(at(f"{path}.old"), True)


def replace_partitions(rows: DataFrame, path: str, partition_by: str) -> list[str]:
    """Put whole partitions in the place of those at ``path``; all others keep their files. Returns the partitions' folders.

    ``rows`` may derive from the table. Each partition is set aside until its next one has its name; a crash leaves each of them old or new.
    """
    spark = rows.sparkSession
    fs, at = file_system(spark, path)
    rows.write.mode("overwrite").partitionBy(partition_by).parquet(f"{path}.next")
    recover(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(f"{path}.next")) if f.isDirectory() and f.getPath().getName().startswith(f"{partition_by}="))
    fs.mkdirs(at(f"{path}.parts"))
    for name in names:
        if fs.exists(at(f"{path}/{name}")) and not fs.rename(at(f"{path}/{name}"), at(f"{path}.parts/{name}")):
            raise OSError(f"cannot set aside {path}/{name}")
        if not fs.rename(at(f"{path}.next/{name}"), at(f"{path}/{name}")):
            raise OSError(f"cannot put the next {path}/{name} in place")
    fs.delete(at(f"{path}.parts"), True)
    fs.delete(at(f"{path}.next"), True)
    return names


def update_partitions(spark: SparkSession, path: str, updates: DataFrame, key: str, name: str, partition_by: str) -> list[str]:
    """``update_column`` on the table at ``path``, writing only the partitions that hold an updated key. ``updates`` is a checkpoint."""
    recover(spark, path)
    base = spark.read.parquet(path)
    changed = updates.where(F.col(name).isNotNull()).select(key).distinct()
    touched = [r[0] for r in base.select(key, partition_by).join(changed, key, "left_semi").select(partition_by).distinct().collect()]  # months, not rows
    if not touched:
        return []
    hit = F.coalesce(F.col(partition_by).isin([t for t in touched if t is not None]), F.lit(False))
    rows = base.where(hit | F.col(partition_by).isNull() if None in touched else hit)
    return replace_partitions(update_column(rows, updates, key, name), path, partition_by)


def ensure_table(spark: SparkSession, path: str, columns: StructType) -> bool:
    """Create an empty table with a schema if there is none; whether it was made."""
    recover(spark, path)
    fs, at = file_system(spark, path)
    if fs.exists(at(path)):
        return False
    spark.createDataFrame([], columns).write.parquet(path)
    return True


def editions(spark: SparkSession, path: str) -> list[int]:
    """Edition numbers that have been claimed."""
    fs, at = file_system(spark, path)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at(path)) if f.getPath().getName().isdigit()) if fs.exists(at(path)) else []


def _create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file that wasn't there; of several writers one succeeds. Hadoop's local file system checks first and then writes, so it is left out."""
    fs, at = file_system(spark, path)
    if fs.getScheme() == "file":
        local = at(path).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at(path), False).close()
    except Py4JJavaError as e:
        if fs.exists(at(path)):
            return False
        raise e
    return True


def claim_edition(spark: SparkSession, path: str) -> int:
    """Take the next edition number. The claim is a file that only one writer can make, so two writers never share a number."""
    number = max(editions(spark, path), default=0) + 1
    while not _create_new(spark, f"{path}/{number}"):
        number += 1
    return number


def tables(spark: SparkSession, root: str, pattern: str = "*") -> list[str]:
    """Names of the tables below a root that match a pattern, in order."""
    fs, at = file_system(spark, root)
    found = fs.globStatus(at(f"{root}/{pattern}")) or []
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and not f.getPath().getName().endswith((".next", ".old", ".parts")))


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified, content`` of all files below a root whose names match a glob, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "content").orderBy("path")
