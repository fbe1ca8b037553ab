"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only when a count shows that it has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000


def local_session(app: str = "presswork", cpus: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and continue from there.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a temporary one is made. The files outlive an executor, so nothing upstream is recomputed.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="presswork-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: where checkpoints are, or, for tests without such a folder, a temporary one."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    base = at.get() if at.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if not base and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base or tempfile.mkdtemp(prefix="presswork-")


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame to the shared folder and reads it again; all goes when the block ends.

    For algorithms that join their state with itself round after round: a checkpoint keeps the size that the plan before it was expected to
    have, a join multiplies sizes, and after some squarings planning takes longer than the work. A table has the size that it has.
    """
    folder = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        delete_folder(spark, folder)
