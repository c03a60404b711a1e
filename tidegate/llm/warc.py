"""WARC archives: written with revisit records, read back by boundary-chain verification (operator 7).

A record is a header, its payload (the html in UTF-8; null counts as empty) and two line ends. Of
pages with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest ``page_id`` is
written whole; the others become revisits that refer to it (rows that repeat that id are written
whole as well). Archives are gzip files of a bounded number of records in the shared folder.

Readers cut the byte stream at every empty line, so a payload may hold any number of cuts, and text
that looks like a header. Tasks emit a candidate for everything that looks like one: its offset, and
the offset of the record that would follow it. Pointer jumping from the start of the file keeps the
candidates on the chain; all others are payload. A file's offsets (16 bytes a candidate) are jumped
over together; files are split into blocks where Spark can split them. A chain that breaks ends its
file there. An empty table gives empty archives; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm.common import materialise, scratch_path, text_bytes

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2000
CUT = "\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

EMPTY = hashlib.sha1(b"").hexdigest()

_CANDIDATE = re.compile(rb"(?:\r\n)?WARC/1\.[01]\r\n")
_PAGE = re.compile(rb"<urn:page:(-?\d+|null)>")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to gzip archives below ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # A row a digest; sums before the shuffle keep hot digests small.
    whole = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner")
    whole = materialise(whole, "warc-copies")
    rows = rows.join(whole, "digest", "left").withColumn("revisit", F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("winner")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), 0).otherwise(F.col("bytes")).cast("string")),
    )
    record = F.concat(head, F.lit(CUT), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", CUT).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_header(chunk: bytes) -> tuple[int, dict] | None:
    """The place of a header in a chunk (0, or 2 after a payload's last line end) and its fields, if it is one."""
    m = _CANDIDATE.match(chunk)
    if not m:
        return None
    skip = 2 if chunk[:2] == b"\r\n" else 0
    fields = {}
    for line in chunk[m.end() :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    length, kind = fields.get(b"content-length", b""), fields.get(b"warc-type", b"")
    if not length.isdigit() or not kind:
        return None

    def page(name: bytes) -> int | None:
        found = _PAGE.match(fields.get(name, b""))
        return None if not found or found[1] == b"null" else int(found[1])

    return skip, {"length": int(length), "type": kind.decode("ascii", "replace"), "page_id": page(b"warc-record-id"), "refers_to": page(b"warc-refers-to")}


_SCANNED = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("text", pa.binary())]
)
SCANNED = "file string, block long, at long, size long, length long, type string, page_id long, refers_to long, digest string, text binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (type not null) and chunks whose bytes may be needed (text not null), with places in their block.

    From the start of a file the chain is known as far as it was read: a chunk that is the whole
    payload of a header on it is digested here and left out.
    """
    held: list[tuple] = []
    place = None
    at = ends = total = 0
    expected: int | None = None
    pending: tuple | None = None
    for batch in batches:
        for file, block, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            chunk = chunk.as_py()
            if (file, block) != place:
                if pending:
                    held.append(pending)
                place, at, ends, pending = (file, block), 0, 0, None
                expected = 0 if block == 0 else None
            if pending and len(chunk) == pending[4]:
                held.append((*pending[:8], hashlib.sha1(chunk).hexdigest(), None))
                pending = None
            else:
                if pending:
                    held.append(pending)
                    pending = None
                found = parse_header(chunk)
                if found:
                    skip, head = found
                    size = len(chunk) - skip
                    row = (file, block, at + skip, size, head["length"], head["type"], head["page_id"], head["refers_to"], None, None)
                    if expected == at + skip:
                        expected += size + head["length"] + 2 * len(CUT)
                        pending = row
                    else:
                        held += [row, (file, block, at, len(chunk), *[None] * 5, chunk)]
                        total += len(chunk)
                else:
                    held.append((file, block, at, len(chunk), *[None] * 5, chunk))
                    total += len(chunk)
            at += len(chunk) + len(CUT)
            if len(held) >= 5000 or total > 4_000_000:
                yield _batch(held)
                held, total = [], 0
    if pending:
        held.append(pending)
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCANNED)], schema=_SCANNED)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the candidates (offsets ascending) lie on the chain from offset 0, by pointer jumping."""
    n = len(offsets)
    found = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        found[0] = True
        at = np.minimum(np.searchsorted(offsets, successors), n - 1)
        jump = np.append(np.where(offsets[at] == successors, at, n), n)
        while True:
            reached = jump[:-1][found[:-1]]
            if found[:-1].sum() and found[reached[reached < n]].all():
                break
            found[reached] = True
            jump = jump[jump]
    return found[:-1]


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("offset", kind="stable")
    return rows[reachable(rows["offset"].to_numpy(), rows["successor"].to_numpy())][["file", "offset"]]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of a payload from its chunks in order."""
    for batch in batches:
        digests = []
        for length, chunks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            payload = b"".join(c["text"] + CUT.encode() for c in sorted(chunks, key=lambda c: c["offset"]))[:length]
            digests.append(hashlib.sha1(payload).hexdigest() if len(payload) == length else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["file", "offset", "digest2"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, page_id, type, refers_to, length, digest of every record on the chains of the archives below ``path``."""
    cut = spark.read.option("lineSep", CUT).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    scanned = materialise(cut.mapInArrow(_scan, SCANNED), "warc-scan")
    if scanned.filter("block > 0").isEmpty():
        placed = scanned.withColumn("offset", F.col("at"))
    else:
        # Blocks of a file lie end to end, so the bytes of those before one give its offset.
        sizes = scanned.groupBy("file", "block").agg(F.max(F.col("at") + F.col("size") + F.when(F.col("digest").isNotNull(), F.col("length") + 2 * len(CUT)).otherwise(len(CUT))).alias("bytes"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
        placed = scanned.join(sizes, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at"))
    candidates = placed.filter("type IS NOT NULL")
    ends = candidates.select("file", "offset", (F.col("offset") + F.col("size") + F.col("length") + 2 * len(CUT)).alias("successor"))
    chain = ends.groupBy("file").applyInPandas(_chain, "file string, offset long")
    records = candidates.join(chain, ["file", "offset"]).select("file", "offset", (F.col("offset") + F.col("size") + len(CUT)).alias("start"), "length", "type", "page_id", "refers_to", F.when(F.col("length") == 0, F.lit(EMPTY)).otherwise(F.col("digest")).alias("digest"))
    records = materialise(records, "warc-records")
    split = records.filter("digest IS NULL")
    if split.isEmpty():
        return records.drop("start")
    # Each chunk belongs to the last record that starts at or before it, as far as its payload goes.
    chunks = placed.filter("text IS NOT NULL").select("file", F.col("offset").alias("spot"), "text", F.lit(None).cast("struct<offset:long,start:long,length:long>").alias("mark"))
    marks = split.select("file", F.col("start").alias("spot"), F.lit(None).cast("binary").alias("text"), F.struct("offset", "start", "length").alias("mark"))
    order = Window.partitionBy("file").orderBy("spot", F.col("text").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = chunks.unionByName(marks).withColumn("owner", F.last("mark", ignorenulls=True).over(order)).filter("text IS NOT NULL AND spot < owner.start + owner.length")
    grouped = owned.groupBy("file", F.col("owner.offset").alias("offset"), F.col("owner.length").alias("length")).agg(F.collect_list(F.struct(F.col("spot").alias("offset"), "text")).alias("chunks"))
    digests = grouped.mapInArrow(_assemble, "file string, offset long, digest2 string")
    return records.join(digests, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "digest2")).drop("digest2", "start")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archives.

    A revisit takes its payload's length and digest from the record it refers to.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    records = materialise(read_archives(spark, path), "warc-read")
    whole = records.filter("type = 'response'").select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = materialise(whole.groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")), "warc-targets")
    again = records.filter("type = 'revisit'").select("page_id", "refers_to").join(target, "refers_to", "left")
    return whole.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
