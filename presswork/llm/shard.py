"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group. Groups are ordered by a hash of their text; the smallest capacity for
which the ordered groups fit into the wanted number of shards is found by binary search with a greedy check, and the shards
are cut there. A group larger than an even share gets a shard of its own first, so that it doesn't set the capacity of all others;
after the search each cut is moved, within what the capacity allows, to the boundary nearest to an even share.

Scale: one narrow shuffle sorts (group key, row id) by range, so a hot group spans many tasks. Prefix sums come from each partition's
running sums plus one offset a partition. The driver never holds all groups: it keeps prefix sums at no more than
``BLOCKS`` boundaries and asks for finer ones, in one distributed job, only where the greedy check would land between two of
them. The result is that of a search over all boundaries.

Nulls and edges: a null text has no bytes and checksum 0 and groups with empty texts; null or repeated doc_ids are ordinary rows;
equal sizes keep the hash order; an empty table gives no rows; fewer groups than shards leave some shards empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm.common import table
from presswork.session import checkpoint

SHARDS, OVERHEAD = 40, 16
#: Boundaries that the driver holds at most after a job, three longs each.
BLOCKS = 1 << 16


class Boundaries:
    """Known ends of groups along the order: bytes and rows before each end, and whether groups hide before it.

    ``ask(lows, highs, parts)`` returns more ends inside the given open gaps.
    """

    def __init__(self, total: tuple[int, int], ask: Callable[[np.ndarray, np.ndarray, int], np.ndarray]):
        self.ask = ask
        self.ends = np.array([(0, 0, 1), (*total, 0)], dtype=np.int64)
        self.refine({1})

    def refine(self, gaps: set[int]) -> None:
        """Learn ends inside the gaps that end at these indices."""
        at = np.array(sorted(gaps))
        parts = max(2, BLOCKS // len(at))
        new = self.ask(self.ends[at - 1, 0], self.ends[at, 0], parts)
        whole = np.concatenate([np.delete(self.ends, at, axis=0), new])
        self.ends = whole[np.argsort(whole[:, 0], kind="stable")]

    def furthest(self, x: float, limit: int) -> tuple[int, int, int | None]:
        """Index of the last known end at most ``x``; of the last end there could be, in bytes; the gap in between, if open."""
        i = int(np.searchsorted(self.ends[:, 0], x, side="right")) - 1
        if i + 1 < len(self.ends) and not self.ends[i + 1, 2] and x > self.ends[i, 0]:
            return i, int(min(x, limit)), i + 1
        return i, int(self.ends[i, 0]), None


def _fits(b: Boundaries, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
    """Whether ``shards`` of this capacity hold all; None and the gaps to look into if it isn't known yet."""
    total, known, could, gaps = int(b.ends[-1, 0]), 0, 0, set()
    for _ in range(shards):
        i, _, gap = b.furthest(known + capacity, total)
        known = int(b.ends[i, 0])
        gaps |= {gap} if gap else set()
        _, could, gap = b.furthest(could + capacity, total)
        gaps |= {gap} if gap else set()
    return (True if known >= total else False if could < total else None), gaps


def minimax_cuts(b: Boundaries, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the indices of ``b.ends`` where shards end (``shards`` of them)."""
    total = int(b.ends[-1, 0])
    low, high = -(-total // shards) - 1, total
    while high - low > 1:
        middle = (low + high) // 2
        fits, gaps = _fits(b, middle, shards)
        if fits is None:
            b.refine(gaps)
        elif fits:
            high = middle
        else:
            low = middle
    while True:
        cuts, gaps = _near_even(b, high, shards)
        if not gaps:
            return high, cuts
        b.refine(gaps)


def _near_even(b: Boundaries, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Cuts near even shares such that each shard, and the rest behind each cut, keeps to the capacity."""
    total, gaps = int(b.ends[-1, 0]), set()
    earliest = [len(b.ends) - 1]
    for _ in range(shards - 1):
        x = int(b.ends[earliest[-1], 0]) - capacity
        i = int(np.searchsorted(b.ends[:, 0], x, side="left"))
        if x > 0 and b.ends[i, 0] > x and not b.ends[i, 2]:
            gaps.add(i)
        earliest.append(i)
    cuts, at = [], 0
    for k, floor in enumerate(reversed(earliest[:-1]), 1):
        last, _, gap = b.furthest(at + capacity, total)
        gaps |= {gap} if gap else set()
        even = at + (total - at) / (shards - k + 1)
        i, _, gap = b.furthest(even, total)
        gaps |= {gap} if gap else set()
        if i + 1 < len(b.ends) and b.ends[i + 1, 0] - even < even - b.ends[i, 0]:
            i += 1
        cuts.append(min(max(i, floor), last))
        at = int(b.ends[cuts[-1], 0])
    return [*cuts, len(b.ends) - 1], gaps


def with_groups(docs: DataFrame) -> DataFrame:
    """Narrow rows: the document, its size and checksum, and the key of its group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add running sums of bytes and rows within the partition, and whether a row ends its group there (the last row: unknown, true)."""
    size_sum = row_sum = 0
    held: pa.RecordBatch | None = None

    def out(batch: pa.RecordBatch, following: int | None) -> pa.RecordBatch:
        nonlocal size_sum, row_sum
        key = batch["key"].to_numpy(zero_copy_only=False)
        after = np.append(key[1:], key[-1] if following is None else following)
        ends = after != key
        ends[-1] |= following is None
        sizes = size_sum + np.cumsum(batch["size"].to_numpy(zero_copy_only=False))
        rows = row_sum + np.arange(1, len(key) + 1)
        size_sum, row_sum = int(sizes[-1]), int(rows[-1])
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes), pa.array(rows), pa.array(ends)], [*batch.schema.names, "run_bytes", "run_rows", "ends"]
        )

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield out(held, batch["key"][0].as_py())
            held = batch
    if held is not None:
        yield out(held, None)


def _prefix_sums(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with global inclusive prefix sums ``bytes`` and ``rows`` and ``ends`` (last of its group), plus the totals."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields]
    runs = ranged.mapInArrow(_runs, ", ".join([*kept, "run_bytes long", "run_rows long", "ends boolean"]))
    runs = checkpoint(runs.withColumn("part", F.spark_partition_id()))
    parts = (
        runs.groupBy("part").agg(F.max("run_bytes").alias("bytes"), F.max("run_rows").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"))
        .orderBy("part").collect()  # one row a partition
    )
    before, offsets = (0, 0), []
    for k, p in enumerate(parts):
        goes_on = k + 1 < len(parts) and parts[k + 1].first == p.last
        offsets.append((p.part, *before, not goes_on, p.rows))
        before = (before[0] + p.bytes, before[1] + p.rows)
    table_ = F.broadcast(spark.createDataFrame(offsets, "part int, b long, r long, final boolean, of long"))
    summed = runs.join(table_, "part").select(
        *rows.columns,
        (F.col("b") + F.col("run_bytes")).alias("bytes"),
        (F.col("r") + F.col("run_rows")).alias("rows"),
        (F.col("ends") & ((F.col("run_rows") < F.col("of")) | F.col("final"))).alias("ends"),
    )
    return summed, *before


def _asker(summed: DataFrame) -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """A function that looks up ends of groups inside gaps, at most ``parts`` for each gap, by one aggregation."""

    def ask(lows: np.ndarray, highs: np.ndarray, parts: int) -> np.ndarray:
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                end = batch["bytes"].to_numpy(zero_copy_only=False)
                gap = np.searchsorted(highs, end, side="left")
                inside = (gap < len(highs)) & (end > lows[np.minimum(gap, len(highs) - 1)])
                gap, end, rows = gap[inside], end[inside], batch["rows"].to_numpy(zero_copy_only=False)[inside]
                low, high = lows[gap], highs[gap]
                block = np.where(end == high, parts, ((end - low).astype(np.float64) * parts / (high - low)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gap.astype(np.int64), block, end, rows)], ["gap", "block", "bytes", "rows"])

        found = (
            summed.where("ends").select("bytes", "rows").mapInArrow(blocks, "gap long, block long, bytes long, rows long")
            .groupBy("gap", "block").agg(F.max(F.struct("bytes", "rows")).alias("end"), F.count("*").alias("n"))
            .select("end.bytes", "end.rows", "n").toArrow()
        )  # at most BLOCKS rows and one a gap
        return np.stack([found["bytes"], found["rows"], found["n"].to_numpy() == 1], axis=1).astype(np.int64).reshape(-1, 3)

    return ask


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; shards are near equal in bytes, groups of equal texts stay whole."""
    rows = checkpoint(with_groups(docs))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    sizes = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    alone: list[tuple[int, int, int]] = []
    while len(alone) < shards - 1:
        share = (total - sum(a[1] for a in alone)) / (shards - len(alone))
        large = [tuple(r) for r in sizes.where((F.col("bytes") > share) & ~F.col("key").isin([a[0] for a in alone])).orderBy(F.desc("bytes"), "key").limit(shards - 1 - len(alone)).collect()]
        if not large:
            break
        alone += large  # groups over an even share: fewer than there are shards
    rest = shards - len(alone)
    own = {key: rest + k for k, (key, _, _) in enumerate(alone)}
    number = F.lit(None).cast("int")
    for key, k in own.items():
        number = F.when(F.col("key") == F.lit(key).cast("long"), F.lit(k)).otherwise(number)
    summed, _, _ = _prefix_sums(rows.withColumn("alone", number))
    placed = _place(summed, alone, rest)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def _place(summed: DataFrame, alone: list[tuple[int, int, int]], shards: int) -> DataFrame:
    """Shard and slot of each row; groups that stand alone are taken out of the sums of those that follow them in the order."""
    gone_bytes, gone_rows = F.lit(0).cast("long"), F.lit(0).cast("long")
    inner = F.lit(0).cast("long")
    before = 0
    for key, size, count in sorted(alone):
        past = F.col("key") > F.lit(key).cast("long")
        gone_bytes = gone_bytes + F.when(past, F.lit(size)).otherwise(0)
        gone_rows = gone_rows + F.when(past, F.lit(count)).otherwise(0)
    # Rows of a lone group before it in the order: all rows of smaller keys, which the group's smallest prefix tells.
    if alone:
        starts = {r.key: r.first for r in summed.where("alone is not null").groupBy("key").agg((F.min("rows") - 1).alias("first")).collect()}
        for key, first in starts.items():
            inner = F.when(F.col("key") == F.lit(key).cast("long"), F.col("rows") - F.lit(first) - 1).otherwise(inner)
    rows = summed.withColumns({"bytes": F.col("bytes") - gone_bytes, "rows": F.col("rows") - gone_rows, "inner": inner})
    common = rows.where("alone is null")
    top = common.agg(F.max("bytes"), F.max("rows")).first()
    cuts: list[tuple[int, int]] = []
    if top[0] is not None:
        b = Boundaries((top[0], top[1]), _asker(common))
        _, at = minimax_cuts(b, shards)
        cuts = [(int(b.ends[i, 0]), int(b.ends[i, 1])) for i in at[:-1]]
    ends = F.array(*[F.lit(c[0]).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    starts_at = F.array(F.lit(0).cast("long"), *[F.lit(c[1]).cast("long") for c in cuts])
    number = F.size(F.filter(ends, lambda c: c < F.col("bytes")))
    slot = F.when(F.col("alone").isNull(), F.col("rows") - F.element_at(starts_at, F.col("_shard") + 1) - 1).otherwise(F.col("inner"))
    return rows.withColumn("_shard", number).select("*", F.coalesce("alone", "_shard").alias("shard"), slot.alias("slot"))


def op3_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
