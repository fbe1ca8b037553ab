"""WARC archives: writing, and a normaliser for those that are one gzip stream.

``write_archives`` puts pages into archives compressed as a whole, one gzip member a file, as careless crawlers leave them: no record can
be read without inflating all before it. ``normalise`` mends that. Spark's text reader inflates each file's stream once and hands it on in
pieces between blank lines, so no file is ever whole in memory; a data source writer puts the pieces together by each record's
Content-Length, writes the record as a gzip member of its own, and beside the archive a sidecar with each record's offset and length.
Then ``read_records`` fetches any set of records by single ranged reads.

Executors write under names of their own attempt; what counts is what the commit lists in one small file, so a lost executor or an
aborted job leaves no archive half valid. A payload that occurs again is a ``revisit`` without content that names the record that has
it. The unit of inflating is a file, as its stream can't be entered in the middle; a record is in memory one at a time.

Nulls and edges: a null html is an empty payload; a null url leaves WARC-Target-URI out; line ends in a url are percent-encoded; of equal
payloads the largest page_id has the content, a null page_id is below all, of equal page_ids the row read last; very long payloads and
payloads with blank lines or WARC headers in them come back byte for byte; an archive without records and an empty table give no row; a
truncated record, a header without length or a payload that contradicts its digest raises; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from presswork.llm.common import broadcast_if_small, delete_folder, numbered, scratch_folder, table
from presswork.session import checkpoint

BLANK = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this many bytes are never replaced by a revisit.
LEAST_BYTES = 0
SALTS = 16
#: Bytes of adjacent members that are fetched at once, and of payloads in one batch of results.
SPAN, BATCH = 8 << 20, 8 << 20
COMMITTED = "_archives.jsonl"
INDEX = (
    "file string, offset long, length long, record_id string, warc_type string, target_uri string, warc_date string, "
    "payload_digest string, payload_length long, refers_to string, content_length long"
)


# --- records from pages -------------------------------------------------------------------------------------------------


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 32 groups of five bits."""
    groups = []
    for bit in range(0, 160, 5):
        two = F.conv(F.substring(digest, bit // 4 + 1, 2), 16, 10).cast("int")
        groups.append(F.substring(F.lit(BASE32), F.shiftright(two, 3 - bit % 4).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*groups)


def _copies(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` with ``_first``, the page_id and row that has the content, where that is another row."""
    keyed = pages.withColumn("_key", F.when(F.octet_length("_html") >= least, F.sha2(F.col("_html").cast("binary"), 256)))
    groups = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max(F.struct("page_id", "_pw_row")).alias("_first"), F.count("*").alias("_n"))
    repeated = checkpoint(groups.where("_n > 1").select(F.col("_key").alias("_of"), "_first"))
    repeated, few = broadcast_if_small(repeated)
    on = F.col("_key") == F.col("_of")
    if not few:  # a payload of very many pages is dealt to several tasks
        repeated = repeated.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.pmod(F.col("_pw_row"), F.lit(SALTS)).cast("int") == F.col("_part"))
    joined = keyed.join(repeated, on, "left")
    return joined.withColumn("_first", F.when(F.col("_first._pw_row") != F.col("_pw_row"), F.col("_first")))


def to_records(pages: DataFrame, least: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """``record``: one WARC record a row of ``page_id, url, html``, without the blank line that ends it."""
    rows = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html")))
    rows = _copies(rows, least)
    urn = lambda page, row: F.concat(F.lit("<urn:x-presswork:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    size, again = F.octet_length("_html").cast("string"), F.col("_first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", size), F.lit("\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("_html")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"), F.col("_pw_row"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1(F.col("_html").cast("binary"))))),
        line("X-Payload-Length", size),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("_first.page_id"), F.col("_first._pw_row"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(records: DataFrame, folder: str) -> None:
    """One archive a task, compressed as a whole. The text writer ends each record with the blank line that a record has."""
    records.write.option("compression", "gzip").option("lineSep", BLANK.decode()).text(folder)


# --- the normaliser -----------------------------------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that a folder is in, for executors; ``file:`` paths must be shared by all of them."""
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "/", uri)))


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the last of a repeated name counts."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines[1:]) if sep}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and all bytes of each record, from the pieces between a stream's blank lines."""
    rest = b""
    while True:
        while BLANK not in rest.lstrip(b"\r\n"):
            piece = next(pieces, None)
            if piece is None:
                if rest.strip(b"\r\n"):
                    raise ValueError(f"an archive ends inside of a header: {rest[:80]!r}")
                return
            rest += piece + BLANK
        rest = rest.lstrip(b"\r\n")
        end = rest.index(BLANK) + len(BLANK)
        head, found = rest[:end], fields(rest[: end - len(BLANK)])
        if not head.startswith(b"WARC/") or not found.get("content-length", "").isdigit():
            raise ValueError(f"not a WARC header with a Content-Length: {head[:80]!r}")
        size = int(found["content-length"])
        held, have = [rest[end:]], len(rest) - end
        while have < size + len(BLANK):  # the blank line after the block too
            piece = next(pieces, None)
            if piece is None:
                if have < size:
                    raise ValueError(f"an archive ends inside of record {found.get('warc-record-id')}")
                break
            held.append(piece + BLANK)
            have += len(held[-1])
        body = b"".join(held)
        yield found, head + body[:size] + BLANK
        rest = body[size + len(BLANK) :]


@dataclass
class Written(WriterCommitMessage):
    """The archives that one task has finished: name, sidecar's name, number of records."""

    archives: list[tuple[str, str, int]]


class _Normaliser(DataSourceArrowWriter):
    def __init__(self, folder: str, level: int):
        self.folder, self.level = folder, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = filesystem(self.folder)
        done: list[tuple[str, str, int]] = []
        begun: list[str] = []
        pieces = ((a, p) for batch in iterator for a, p in zip(batch["archive"].to_pylist(), batch["piece"].to_pylist()))
        try:
            for archive, own in groupby(pieces, key=lambda x: x[0]):
                name = f"{re.sub(r'([.](warc|txt))*[.]gz$', '', archive)}-{uuid.uuid4().hex}.warc.gz"
                begun += [name, f"{name}.idx"]
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out, store.open_output_stream(f"{folder}/{name}.idx", compression=None) as index:
                    offset = count = 0
                    for head, record in split_records(p for _, p in own):
                        member = zlib.compress(record, self.level, wbits=31)
                        out.write(member)
                        line = {
                            "file": name, "offset": offset, "length": len(member), "record_id": head.get("warc-record-id"), "warc_type": head.get("warc-type"),
                            "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest"),
                            "payload_length": int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else None,
                            "refers_to": head.get("warc-refers-to"), "content_length": int(head["content-length"]),
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                done.append((name, f"{name}.idx", count))
        except BaseException:
            _remove(self.folder, begun)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.folder)
        lines = [json.dumps({"file": a, "index": i, "records": n}) + "\n" for m in messages if m for a, i, n in m.archives]
        draft = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as out:
            out.write("".join(sorted(lines)).encode())
        store.move(draft, f"{folder}/{COMMITTED}")

    def abort(self, messages: list[Written | None]) -> None:
        _remove(self.folder, [name for m in messages if m for a, i, _ in m.archives for name in (a, i)])


def _remove(root: str, names: list[str]) -> None:
    store, folder = filesystem(root)
    for name in names:
        if store.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
            store.delete_file(f"{folder}/{name}")


class WarcMembers(DataSource):
    """Sink ``warc_members`` for rows of ``archive, piece``, in the order of each archive's stream."""

    @classmethod
    def name(cls) -> str:
        return "warc_members"

    def schema(self) -> str:
        return "archive string, piece binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Normaliser:
        return _Normaliser(self.options["path"], int(self.options.get("level", "6")))


def normalise(spark: SparkSession, source: str, folder: str) -> None:
    """Rewrite the ``.gz`` archives under ``source`` into a new ``folder``: a gzip member a record, and sidecars."""
    spark.dataSource.register(WarcMembers)
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    pieces = spark.read.option("lineSep", BLANK.decode()).option("pathGlobFilter", "*.gz").text(source)
    pieces.select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("piece")).write.format("warc_members").option("path", folder).mode("append").save()


# --- reading ------------------------------------------------------------------------------------------------------------


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of all committed archives, a row a record."""
    store, path = filesystem(folder)
    with store.open_input_stream(f"{path}/{COMMITTED}", compression=None) as f:
        names = [json.loads(line)["index"] for line in f.read().splitlines()]
    if not names:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json([f"{folder}/{n}" for n in names])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Rows of ``read_index`` with ``payload``, the block or what follows its HTTP header; adjacent records are fetched together."""
    known = index.schema

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for batch in batches:
            held, size, at = [], 0, 0
            for name, members in _spans(batch):
                with store.open_input_file(f"{path}/{name}") as f:
                    f.seek(members[0][0])
                    data = f.read(members[-1][0] + members[-1][1] - members[0][0])
                for offset, length in members:
                    start = offset - members[0][0]
                    held.append(payload_of(zlib.decompress(data[start : start + length], wbits=31)))
                    size += len(held[-1])
                    if size > BATCH:
                        yield _with(batch.slice(at, len(held)), held)
                        at, held, size = at + len(held), [], 0
            if held:
                yield _with(batch.slice(at, len(held)), held)

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known)
    return index.mapInArrow(fetch, f"{spec}, payload binary")


def _with(batch: pa.RecordBatch, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], names=[*batch.schema.names, "payload"])


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of adjacent members of one file, of about ``SPAN`` bytes."""
    run: list[tuple[int, int]] = []
    last, held = None, 0
    for name, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
        if run and (name != last or offset != run[-1][0] + run[-1][1] or held + length > SPAN):
            yield last, run
            run, held = [], 0
        run.append((offset, length))
        last, held = name, held + length
    if run:
        yield last, run


def payload_of(record: bytes) -> bytes:
    """The block, or, of an HTTP message, what follows its header."""
    head, _, block = record.partition(BLANK)
    block = block[: int(fields(head)["content-length"])]
    if fields(head).get("content-type", "").startswith("application/http"):
        return block.partition(BLANK)[2]
    return block


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, folder = scratch_folder(spark, "warc-raw"), scratch_folder(spark, "warc")
    write_archives(to_records(table(spark, sf_dir, "pages")), raw)
    normalise(spark, raw, folder)
    delete_folder(spark, raw)
    read = read_records(read_index(spark, folder), folder)
    said, found = F.substring_index("payload_digest", ":", -1), base32_of_hex(F.sha1("payload"))
    page = lambda urn: F.nullif(F.regexp_extract(urn, "^<urn:x-presswork:(-?[0-9]*):", 1), F.lit("")).cast("long")
    whole = F.col("warc_type") == "response"
    digest = F.when(~whole | (said == found), said).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("record_id"))))
    out = checkpoint(read.select(
        page(F.col("record_id")).alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"),
    ))
    delete_folder(spark, folder)
    return out


OP12_SQL = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, h, sha1(h) AS x, row_number() OVER w AS k, first_value(page_id) OVER w AS top
  FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r DESC))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + ((('0x' || substr(x, i * 5 // 4 + 1, 2))::INTEGER >> (3 - i * 5 % 4)::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM d
"""
