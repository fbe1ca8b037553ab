"""Table dumps: JSON lines behind one header line with the table's schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from presswork.operators import store
from presswork.session import checkpoint

HEADER = "#MAPPING#"
#: Timestamps keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def lines(rows: DataFrame, key: str) -> DataFrame:
    """``value``: each row as ``{"_id", "_source"}``."""
    return rows.select(F.to_json(F.struct(F.col(key).cast("string").alias("_id"), F.struct(*rows.columns).alias("_source")), TIMES).alias("value"))


def export(rows: DataFrame, path: str, key: str) -> None:
    """A folder of text parts in order of the key, and beside it a folder with the header line."""
    lines(rows.orderBy(key), key).write.mode("overwrite").text(f"{path}/data")
    schema = StructType([StructField(f.name, f.dataType, f.nullable, {"key": True} if f.name == key else {}) for f in rows.schema.fields])
    header = rows.sparkSession.createDataFrame([(HEADER + schema.json(),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/mapping")


def is_row(value: Column) -> Column:
    return (F.trim(value) != "") & ~F.startswith(value, F.lit(HEADER))


def parse(text: DataFrame, schema: StructType) -> DataFrame:
    """Rows of a dump's lines; blank and header lines are skipped."""
    wrapped = StructType().add("_id", "string").add("_source", schema)
    return text.where(is_row(F.col("value"))).select(F.from_json("value", wrapped, TIMES).alias("r")).select("r._source.*")


def mapping(spark: SparkSession, path: str) -> tuple[StructType, str | None]:
    """A dump's schema and the name of its key column."""
    header = spark.read.text(f"{path}/mapping").where(F.startswith("value", F.lit(HEADER))).first()
    if header is None:
        raise ValueError(f"{path} has no header line")
    schema = StructType.fromJson(json.loads(header.value[len(HEADER) :]))
    return schema, next((f.name for f in schema.fields if f.metadata.get("key")), None)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(f"{path}/data"), mapping(spark, path)[0])


def load(spark: SparkSession, path: str, table: str, clear: bool = False, partition_by: str | None = None) -> int:
    """Bring a dump into a table: its rows replace those with the same key, or with ``clear`` all; returns the number of its rows.

    Of rows with equal keys in the dump one is taken. A dump without a key, or a table that isn't there yet, has nothing to replace.
    """
    _, key = mapping(spark, path)
    rows = checkpoint(read(spark, path))
    n = rows.count()
    fresh = rows.dropDuplicates([key]) if key else rows
    store.recover(spark, table)
    root, name = table.rsplit("/", 1)
    if not clear and store.tables(spark, root, name):
        old = spark.read.parquet(table).select(*rows.columns)
        fresh = (old.join(fresh.select(key), key, "left_anti").select(*rows.columns) if key else old).unionByName(fresh)
    if n or clear:
        store.replace_table(fresh, table, partition_by)
    return n
