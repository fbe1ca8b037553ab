"""Document fingerprints: canonical exact digests.

A text is normalised (NFKC), case-folded and its white space folded to single blanks; the 128-bit xxhash of that form is the
fingerprint. Within a bucket of equal hashes the forms are compared byte by byte with that of the bucket's first document; a
form that differs gets the hash plus its SHA-256, so that two forms never share a fingerprint. As the fingerprint is exact, the likeness of two
is 1 if they are equal and 0 if not.

Comparing reads the texts again but moves few: a bitmap of fixed size, filled with the hashes that occur more than once,
lets only such documents through to the shuffle (a false hit costs a comparison, never a result). Each bucket is dealt to ``SALTS`` parts, where
a document is compared with the part's first; the parts' firsts are then compared with the bucket's first. So a hot bucket is no single
task's work, and the second shuffle has at most ``SALTS`` rows of a bucket.

The edited text takes from the next document, in descending doc_id. Documents are dealt by ranges of doc_id, each text moved once,
and the first document of a range is also sent to the range before it.

Nulls and edges: a null text is an empty one; equal doc_ids are ordered by the text's hash; null doc_ids come last in
descending order; repeated rows follow each other; a lone document follows itself; very long texts are one value each, compared whole; an empty
table gives no rows. White space is what Unicode says, U+001C to U+001F included, for ASCII texts as for others.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm.common import numbered, table
from presswork.session import checkpoint

#: 64-bit words of the bitmap of repeated hashes: 8 MB, at any size of the input.
BITMAP_WORDS = 1 << 20
#: Parts of a bucket.
SALTS = 64


def canonical(text: str) -> bytes:
    """The folded form: NFKC, case folding, white space to single blanks, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def _ranges(ids: DataFrame, parts: int) -> list:
    """Upper ends of ranges of doc_id that hold about as many rows each."""
    edges = ids.where("doc_id is not null").stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(e) for e in edges})


def _part_of(edges: list[int]):
    """A document's part: they count up as doc_id goes down; nulls come last. Only doc_id goes through Python."""
    ends = np.array(edges, dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = len(ends) - np.searchsorted(ends, ids.fillna(0).to_numpy().astype(np.int64), side="left")
        return pd.Series(np.where(known, at, len(ends) + 1)).astype("int32")

    return part


def _neighbours():
    """Yield each document with its edited text's digests; the batch rows are in order: part, descending doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "row"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        out: list[tuple] = []
        held: tuple | None = None
        for batch in batches:
            for part, row, doc_id, guest, text in zip(*(batch[c].to_pylist() for c in ("part", "row", "doc_id", "guest", "text"))):
                now = (part, row, doc_id, text, canonical(text), guest)
                if held is not None and held[0] == part and not held[5]:
                    out.append(_judged(held, now))
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []

    return run


def _judged(own: tuple, following: tuple) -> tuple:
    _, row, doc_id, text, form, _ = own
    n = len(text) // 3
    edited = text[: len(text) - n] + following[3][:n]
    edited_form = form if edited == text else canonical(edited)
    mine, its, theirs = digest(form), digest(edited_form), digest(following[4])
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, its,
        float(mine == its and form == edited_form), float(mine == theirs and form == following[4]), row,
    )


def edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document (``doc_id, text, row``): the hashes of its text and of the text edited with the next document, and their likenesses."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "row")
    ids = checkpoint(rows.select("doc_id", F.xxhash64("text").alias("tie"), "row"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    edges = _ranges(ids, parts)
    number = _part_of(edges)("doc_id")
    order = F.struct((-F.col("doc_id")).alias("down"), F.col("tie"), F.col("row"))
    firsts = ids.withColumn("part", number).groupBy("part").agg(F.min(order).alias("o")).select("part", "o.row").orderBy("part").collect()  # one row a part
    guests: dict[int, list[int]] = {}
    for k, first in enumerate(firsts):
        guests.setdefault(first.row, []).append(firsts[k - 1].part)
    if not firsts:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"), "row")
    homes = spark.createDataFrame([(r, p) for r, ps in guests.items() for p in ps], "g_row long, g_part int")
    own = rows.withColumn("part", number).withColumn("guest", F.lit(False))
    visits = rows.join(F.broadcast(homes), F.col("row") == F.col("g_row")).select("doc_id", "text", "row", F.col("g_part").alias("part"), F.lit(True).alias("guest"))
    dealt = (
        own.unionByName(visits).withColumn("tie", F.xxhash64("text")).withColumn("down", -F.col("doc_id"))
        .repartitionById(len(edges) + 2, F.col("part"))
        .sortWithinPartitions("part", "guest", F.col("down").asc_nulls_last(), "tie", "row")
        .select("part", "row", "doc_id", "guest", "text")
    )
    return dealt.mapInArrow(
        _neighbours(), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, row long"
    )


def differing(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(row, suffix)`` of documents whose form differs from that of the first document with the same hash.

    ``docs`` has ``row`` and ``text``; ``hashes`` has ``row`` and ``fingerprint``.
    """
    repeated = hashes.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    head = F.conv(F.substring("fingerprint", 1, 13), 16, 10).cast("long")
    slots = repeated.select(
        F.pmod(head, F.lit(BITMAP_WORDS)).cast("int").alias("w"), F.pmod(F.floor(head / BITMAP_WORDS), F.lit(64)).cast("int").alias("b")
    )
    found = slots.select("w", F.expr("shiftleft(1L, b)").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most BITMAP_WORDS rows
    bitmap = np.zeros(BITMAP_WORDS, dtype=np.int64)
    bitmap[found["w"].to_numpy()] = found["m"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, hexes, forms = [], [], []
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                form = canonical(text)
                value = digest(form)
                head = int(value[:13], 16)
                if bits[head % BITMAP_WORDS] >> (head // BITMAP_WORDS % 64) & 1:
                    rows.append(row)
                    hexes.append(value)
                    forms.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hexes, pa.string()), pa.array(forms, pa.binary())], ["row", "bucket", "form"])

    held = docs.select("row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(members, "row long, bucket string, form binary")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    dealt = held.withColumn("salt", salt).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "row")
    firsts = dealt.mapInArrow(_against_first(["bucket", "salt"], True), "bucket string, salt int, row long, form binary, first boolean")
    gathered = firsts.repartition("bucket").sortWithinPartitions("bucket", "row")
    apart = checkpoint(gathered.mapInArrow(_against_first(["bucket"], False), "bucket string, salt int, row long, form binary, first boolean"))
    if apart.isEmpty():
        return apart.select("row", F.lit("").alias("suffix"))
    # the members of a part whose first differs from the bucket's first, as far as they equal the part's first
    heads = apart.where("first").select(F.col("bucket").alias("a_bucket"), F.col("salt").alias("a_salt"), F.sha2("form", 256).alias("suffix"))
    others = checkpoint(firsts.where("not first").select("row", "form"))
    in_part = hashes.select("row", F.col("fingerprint").alias("bucket")).withColumn("salt", salt)
    alike = in_part.join(heads, (F.col("bucket") == F.col("a_bucket")) & (F.col("salt") == F.col("a_salt"))).join(others, "row", "left_anti")
    return alike.select("row", "suffix").unionByName(apart.where("not first").select("row", F.sha2("form", 256).alias("suffix")))


def _against_first(keys: list[str], keep_first: bool):
    """Of rows in order of ``keys``: the first of each run (if ``keep_first``), and all whose form differs from its."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, form = None, b""
        for batch in batches:
            chosen, first = [], []
            forms = batch["form"]
            for k, key in enumerate(zip(*(batch[c].to_pylist() for c in keys))):
                own = forms[k].as_py()
                if key != now:
                    now, form = key, own
                    if keep_first:
                        chosen.append(k)
                        first.append(True)
                elif own != form:
                    chosen.append(k)
                    first.append(False)
            rows = batch.take(pa.array(chosen, pa.int64()))
            was = pa.array(first, pa.bool_()) if keep_first else rows["first"]
            yield pa.RecordBatch.from_arrays([rows["bucket"], rows["salt"], rows["row"], rows["form"], was], ["bucket", "salt", "row", "form", "first"])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """Documents with their exact fingerprints and those of their edited texts."""
    rows = numbered(docs.select("doc_id", "text"), "row")
    judged = checkpoint(edited(rows))
    apart = checkpoint(differing(rows, judged.select("row", "fingerprint")).withColumnRenamed("row", "apart_row"))
    if apart.isEmpty():
        return judged.drop("row")
    own = F.concat_ws("-", "fingerprint", "suffix")
    return judged.join(apart, F.col("row") == F.col("apart_row"), "left").select(
        "doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), F.when(F.col("near_edited") == 1, own).otherwise(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
