"""The scheduled ingest loop: each micro-batch keeps new URLs only and appends them to the article table.

State is the table itself: a batch is de-duplicated within, then joined against the stored URLs, of which only that column is read. With a
checkpoint a restart goes on where it stopped; a batch that is tried again overwrites what it wrote before. ``schedule`` has the loop for runs
at full hours, and how a signal stops it; a query is stopped with ``query.stop()``. ``watermarked`` keeps its state in the engine instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.operators.dedup import first_by


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append what is new to ``path``, one folder per batch, overwriting that of a retried batch."""
    spark = batch.sparkSession
    fresh = first_by(batch, "url", F.asc("doc_id"))
    try:
        stored = spark.read.parquet(path).where(F.col("batch") != batch_id).select("url")
    except Exception as e:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = fresh.select("url").limit(0)
    new = fresh.join(stored, "url", "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start the loop: once through all that is available, or again ``every`` interval. Stop it with ``query.stop()``."""
    writer = stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def watermarked(stream: DataFrame, delay: str = "31 days") -> DataFrame:
    """The alternative with state in the engine: first sight of each URL within the delay."""
    return stream.withWatermark("pub_date", delay).dropDuplicatesWithinWatermark(["url"])


def replay(spark: SparkSession, folder: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
