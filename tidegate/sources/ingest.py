"""From files and text chunks to items and segments.

``stage_batch`` gives a row an item with its segments; ``segments_of`` flattens them. Office archives
go through an Arrow-batched UDF that streams each file's parts; everything else is native.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions import fixed
from tidegate.functions.text import is_blank
from tidegate.functions.udf import vectorised
from tidegate.operators.characters import FINDING, invalid_finding

SEGMENT = "struct<provenance:string,text:string>"
EXTRACTED = f"struct<fmt:string,segments:array<{SEGMENT}>,note:string>"


def detect_format(name: Column, head: Column) -> Column:
    """Format by extension, else by the first bytes."""
    extension = F.lower(F.substring_index(F.coalesce(name, F.lit("")), ".", -1))
    dotted = F.coalesce(name, F.lit("")).contains(".")
    return (
        F.when(dotted & extension.isin("docx", "xlsx", "pptx", "pdf"), extension)
        .when(dotted & extension.isin(*fixed.TEXT_EXTENSIONS), "txt")
        .when(dotted & extension.isin(*fixed.LEGACY_EXTENSIONS), "legacy_office")
        .when(F.substring(head, 1, 4) == F.lit(b"%PDF"), "pdf")
        .when(F.substring(head, 1, 2) == F.lit(b"PK"), "ooxml_zip")
        .otherwise("txt")
    )


def provenance(part: str) -> str:
    low = part.lower()
    for how, what, name in fixed.PROVENANCE:
        if (how == "equals" and low == what) or (how == "starts" and low.startswith(what)) or (how == "contains" and what in low):
            return f"Slide {''.join(c for c in part if c.isdigit()) or '?'}" if name == "Slide" else name
    return f"Other ({part})"


def part_texts(xml: bytes) -> tuple[str, str]:
    """Visible and deleted text of an XML part; a part that can't be read, or declares entities, has none."""
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        return "", ""
    visible, deleted = [], []
    try:
        for _, node in ElementTree.iterparse(io.BytesIO(xml)):
            local = node.tag.rpartition("}")[2]
            if node.text and local in ("t", "delText"):
                (visible if local == "t" else deleted).append(node.text)
    except ElementTree.ParseError:
        return "", ""
    return "".join(visible), " ".join(deleted)


def office_segments(data: bytes) -> dict:
    """Format, segments by provenance and note of an office archive; one that is no archive, or too large, has a note only."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        parts = archive.infolist()
        if len(parts) > fixed.MAX_ZIP_ENTRIES:
            return {"fmt": "ooxml", "segments": [], "note": f"rejected: archive has too many entries ({len(parts)})"}
        size = sum(p.file_size for p in parts)
        if size > fixed.MAX_UNZIPPED_BYTES:
            return {"fmt": "ooxml", "segments": [], "note": f"rejected: archive uncompressed size exceeds cap ({size} bytes)"}
        names = {p.filename for p in parts}
        fmt = "docx" if "word/document.xml" in names else "pptx" if any(n.startswith("ppt/slides/") for n in names) else "xlsx" if "xl/workbook.xml" in names else "ooxml"
        kept: dict[str, list[str]] = {}
        cut: dict[str, list[str]] = {}
        for p in parts:
            low = p.filename.lower()
            if low.endswith(".xml") and low.startswith(("word/", "ppt/", "xl/", "docprops/")):
                try:
                    visible, deleted = part_texts(archive.read(p))
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError):
                    continue
                where = provenance(p.filename)
                if visible or deleted:
                    kept.setdefault(where, []).append(visible)
                if deleted.strip():
                    cut.setdefault(f"Tracked-change deletion ({where})", []).append(deleted)
        joined = [(where, "\n".join(t for t in texts if t.strip())) for where, texts in [*kept.items(), *cut.items()]]
        return {"fmt": fmt, "segments": [{"provenance": w, "text": t} for w, t in joined if t.strip()], "note": None}
    except Exception as e:  # noqa: BLE001  a hostile file becomes a row that says so
        return {"fmt": "ooxml", "segments": [], "note": f"OOXML parse error: {e}"}


def pdf_segments(data: bytes) -> dict:
    """Metadata and pages of a PDF where a reader is installed; without one, or without text, a note and no segments."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return {"fmt": "pdf", "segments": [], "note": "no PDF reader installed"}
    segments: list[dict] = []
    try:
        reader = PdfReader(io.BytesIO(data))
        meta = " ".join(str(v) for v in (reader.metadata or {}).values() if v)
        pages = [(f"Page {n}", p.extract_text() or "") for n, p in enumerate(reader.pages, 1)]
        segments = [{"provenance": w, "text": t} for w, t in [("Document properties", meta), *pages] if t.strip()]
        return {"fmt": "pdf", "segments": segments, "note": None if any(t.strip() for _, t in pages) else fixed.NO_TEXT_NOTE}
    except Exception as e:  # noqa: BLE001
        return {"fmt": "pdf", "segments": segments, "note": f"PDF parse error: {e}"}


@vectorised(EXTRACTED)
def _archive(fmt: pd.Series, data: pd.Series) -> pd.DataFrame:
    nothing = {"fmt": None, "segments": [], "note": None}
    rows = [nothing if d is None else pdf_segments(d) if f == "pdf" else office_segments(d) for f, d in zip(fmt, data)]
    return pd.DataFrame(rows, columns=["fmt", "segments", "note"])


def extract(name: Column, content: Column) -> Column:
    """fmt, segments and note of a file. Only archives and PDFs are sent to Python."""
    fmt = detect_format(name, content)
    packed = fmt.isin("docx", "xlsx", "pptx", "ooxml_zip", "pdf")
    opened = _archive(F.when(packed, fmt), F.when(packed, content))
    text = F.make_valid_utf8(content.cast("string"))
    none = F.array().cast(f"array<{SEGMENT}>")
    plain = F.struct(F.lit("txt").alias("fmt"), F.array(F.struct(F.lit("Text").alias("provenance"), text.alias("text"))).alias("segments"), F.lit(None).cast("string").alias("note"))
    legacy = F.struct(F.lit("legacy_office").alias("fmt"), none.alias("segments"), F.lit(fixed.LEGACY_NOTE).alias("note"))
    return F.when(packed, opened).when(fmt == "legacy_office", legacy).otherwise(plain)


def read_files(spark: SparkSession, path: str, most: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Files below a path; the size limit is pushed to the listing, so larger ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most)
    return files.select(F.substring_index("path", "/", -1).alias("source_name"), "content")


def rejected_jobs(files: DataFrame | None, texts: DataFrame | None, jobs: DataFrame | None = None, most_files: int = fixed.MAX_FILES, most_file: int = fixed.MAX_FILE_BYTES, most_text: int = fixed.MAX_TEXT_BYTES, most_job: int = fixed.MAX_JOB_BYTES) -> DataFrame:
    """job_id, status (400 or 413) and reason of the jobs that are not taken, by the first thing against each.

    Too many files come first, then a file, chunk or running size over its cap, in the order of the items;
    of ``jobs`` (job_id) those without an item have nothing to inspect. Only sizes are shuffled.
    """
    parts = []
    if files is not None:
        parts.append(files.select("job_id", F.lit(0).alias("first"), "ord", F.octet_length("content").cast("long").alias("size"), F.col("source_name").alias("name")))
    if texts is not None:
        kept = texts.filter(~is_blank(F.col("text")))
        parts.append(kept.select("job_id", F.lit(1).alias("first"), "ord", F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("string").alias("name")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = Window.partitionBy("job_id").orderBy("first", "ord")
    rows = rows.withColumn("running", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("chunk", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    say = fixed.REJECTED
    reason = (
        F.when((F.col("first") == 0) & (F.col("size") > most_file), F.format_string(say["file"], "name"))
        .when((F.col("first") == 1) & (F.col("size") > most_text), F.format_string(say["text"], "chunk"))
        .when(F.col("running") > most_job, F.lit(say["job"]))
    )
    found = rows.withColumn("reason", reason).groupBy("job_id").agg(
        F.sum(1 - F.col("first")).alias("n_files"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("first", "ord"))).alias("reason")
    )
    found = found.withColumn("reason", F.when(F.col("n_files") > most_files, F.lit(say["files"] % most_files)).otherwise(F.col("reason")))
    out = found.filter("reason IS NOT NULL").select("job_id", F.lit(413).alias("status"), "reason")
    if jobs is not None:
        out = out.unionByName(jobs.select("job_id").distinct().join(found, "job_id", "left_anti").select("job_id", F.lit(400).alias("status"), F.lit(say["nothing"]).alias("reason")))
    return out


def stage_batch(files: DataFrame | None, texts: DataFrame | None) -> DataFrame:
    """Items of one or more jobs: files (job_id, ord, source_name, content) first, then text chunks (job_id, ord, text).

    Blank chunks are dropped; ``seq`` counts a job's items from 0. ``early`` has what the bytes of a text
    tell before they are text: where they are no UTF-8.
    """
    parts = []
    if files is not None:
        parts.append(files.select("job_id", F.lit(0).alias("first"), "ord", F.lit("DOCUMENT").alias("kind"), "source_name", "content"))
    if texts is not None:
        kept = texts.filter(~is_blank(F.col("text")))
        chunk = F.row_number().over(Window.partitionBy("job_id").orderBy("ord"))
        parts.append(kept.select("job_id", F.lit(1).alias("first"), "ord", F.lit("TEXT").alias("kind"), F.concat(F.lit("text-chunk-"), chunk.cast("string")).alias("source_name"), F.col("text").cast("binary").alias("content")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("first", "ord")) - 1
    rows = rows.withColumn("seq", seq).withColumn("x", extract(F.col("source_name"), F.col("content")))
    chars = F.aggregate("x.segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    return rows.select(
        "job_id", "seq", F.concat_ws("-", "job_id", "seq").alias("item_id"), "kind", "source_name", F.col("x.fmt").alias("fmt"), F.octet_length("content").cast("long").alias("size_bytes"),
        F.col("x.segments").alias("segments"), F.col("x.note").alias("note"), chars.alias("extracted_chars"), F.size("x.segments").alias("segment_count"),
        F.filter(F.array(invalid_finding(F.when(F.col("x.fmt") == "txt", F.col("content")))), lambda f: f.isNotNull()).alias("early"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan of a few splits dealt over all cores, for work that costs far more than the shuffle.

    Such splits can be empty, as a file of one row group is read by one of its splits. A scan with more
    splits than there are cores stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def segments_of(items: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each segment of staged items; the first one carries what staging found."""
    early = F.when(F.col("seg_idx") == 0, F.col("early")) if "early" in items.columns else F.lit(None).cast(f"array<{FINDING}>")
    rows = items.select("*", F.posexplode("segments").alias("seg_idx", "x"))
    return rows.select(*keys, "seg_idx", "x.provenance", "x.text", early.alias("early"))


def line_segments(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines of a text as segments; blank ones are left out, but count."""
    rows = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("seg_idx", "text"))
    return rows.filter(~is_blank(F.col("text"))).select(*keys, "seg_idx", F.concat(F.lit("Line "), (F.col("seg_idx") + 1).cast("string")).alias("provenance"), "text")


def whole_segments(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A text as its only segment."""
    return docs.select(*keys, F.lit(0).alias("seg_idx"), F.lit("Text").alias("provenance"), F.coalesce(F.col(text), F.lit("")).alias("text"))
