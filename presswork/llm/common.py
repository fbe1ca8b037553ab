"""What several operators share: table scans, text measures and checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.session import BROADCAST_ROWS, checkpoint

#: Rows of a single long, such as generated ids, that are broadcast at most (about 24 MB as a hash table).
BROADCAST_IDS = 1_000_000
#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if a count shows at most ``most`` rows; and whether it has it."""
    small = df.limit(most + 1).count() <= most
    return (F.broadcast(df) if small else df), small


def numbered(docs: DataFrame, name: str = "_pw_row") -> DataFrame:
    """``docs`` with a generated id that is the same whenever the frame is read again.

    A scan or a checkpoint repeats its rows in the same partitions; what comes out of a shuffle may not once an executor is lost, so it is
    written first.
    """
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = checkpoint(docs)
    return docs.withColumn(name, F.monotonically_increasing_id())


def joined_on_hot(rows: DataFrame, classes: DataFrame, key: list[str], salts: int = 64) -> DataFrame:
    """Rows joined with their class, unique by ``key``; a key may have a third of all rows.

    Few classes are broadcast. Otherwise each class is repeated for ``salts`` salts, and its rows are dealt over them by their ``id``.
    """
    few, small = broadcast_if_small(classes)
    if small:
        return rows.join(few, key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    repeated = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*key, "_salt"]).drop("_salt")


def without(rows: DataFrame, gone: DataFrame, key: str = "_pw_row") -> DataFrame:
    """Rows whose id is not among ``gone`` (distinct longs): broadcast if few, else an equi-join on unique ids."""
    few, _ = broadcast_if_small(gone, BROADCAST_IDS)
    return rows.join(few, key, "left_anti")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` has about ``most`` bytes; a longer row is a run of its own."""
    for batch in batches:
        at, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def give_back() -> None:
    """Return a Python worker's freed memory to the system; workers are reused and would keep the peak of an earlier stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, which all executors share; tests without such a folder get a temporary one."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    base = at.get() if at.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if not base and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='presswork-')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
