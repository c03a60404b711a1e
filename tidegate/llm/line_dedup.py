"""Line dedup by segment-partition edit join (operator 1).

Lines (split at line feeds, with a word; null text has none) are compared as code points. Lines of at
least ``MIN_CHARS`` characters link when at most ``EDITS`` insertions, deletions or substitutions turn
one into the other, a similarity of 0.9 or more; shorter lines are equal or not. A class is all lines
linked directly or through others; its representative, the one with the smallest first document (then
by its SHA-256), stays. Repeated rows and repeated lines count as occurrences; an empty table gives an empty
result; extra columns are ignored. A very long line is compared like any other; its work grows with its
length.

* Equal lines meet first: tasks pack their distinct lines by bucket, and a bucket's lines are written
  once, with a number each, to a table bucketed the same way.
* An indexed line is cut into EDITS + 1 segments of nearly equal length, of which a partner has one
  unchanged. Probes are the substrings of a line that can be that segment of a line as long or up to
  EDITS shorter, at the few places that the edits to the left and right of it allow. Segments and
  probes meet by a hash of length, segment number and text, packed as numbers.
* Pairs whose characters differ in more than 2 EDITS bits of a parity signature are dropped there; the
  rest meet their texts, bucket by bucket, and are verified by a bit-parallel edit distance that
  works in a band of the diagonal and stops early.

Candidates of a common segment are compared in numpy, a slice at a time, and only pairs that pass the
signature leave the task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import blocks, join_groups, materialise, partitions_for, text_bytes
from tidegate.llm.simhash import components

EDITS = 2
MIN_CHARS = 20
BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
#: Spark's own limit on the buckets of a table.
MAX_BUCKETS = 100_000
KEYS_PER_TASK = 2_000_000
#: Text whose keys are made at once.
KEY_BYTES = 2_000_000
#: Candidates of one segment that are compared at once.
SLICE = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_SPACE = b" \t\n\x0b\x0c\r"


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 if it is larger.

    Columns of the matrix are bit vectors of the 2 most + 1 cells around the diagonal; a step moves the
    band down one cell, and adds, ands and shifts work on all of its cells at once.
    """
    if len(a) > len(b):
        a, b = b, a
    gap = len(b) - len(a)
    if gap > most:
        return most + 1
    if a == b:
        return 0
    # Cell (i, j) of a[:i], b[:j] lies on diagonal j - i + most; state k holds a bit for each diagonal reached with k edits.
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << (j + most)
    reach = [0] * (most + 1)
    reach[0] = 1 << most
    for k in range(1, most + 1):
        reach[k] = reach[k - 1] | (reach[k - 1] << 1 & full)
    for i, c in enumerate(a):
        same = places.get(c, 0) >> i & full  # bit d: b[i + d - most] equals c
        old = 0
        for k in range(most + 1):
            now = reach[k] & same
            if k:
                # From one edit less: substitution keeps the diagonal, deletion moves one down, insertion one up.
                now |= old | old >> 1 | (reach[k - 1] << 1 & full)
            old, reach[k] = reach[k], now
        if not reach[most]:
            return most + 1
    goal = 1 << (gap + most)
    return next((k for k in range(most + 1) if reach[k] & goal), most + 1)


def segment(length: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment k of the edits + 1 of a line; the later ones get the characters left over."""
    parts = edits + 1
    short, longer = np.divmod(length, parts)
    before = parts - longer
    return k * short + np.maximum(k - before, 0), short + (k >= before)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(gap, segment, shift): a line that is ``gap`` longer can have the segment, unchanged, that far from its place there.

    At most k edits are left of segment k and edits - k right of it, or the segment before or after it is the one to meet by.
    """
    return [
        (gap, k, shift)
        for gap in range(edits + 1)
        for k in range(edits + 1)
        for shift in range(max(-k, gap - (edits - k)), min(k, gap + (edits - k)) + 1)
    ]


# ---- distinct lines


def _packed_lines(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of a block of documents: its distinct lines, how often and where first."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
            seen: dict[bytes, list] = {}
            for doc, text in zip(ids[a:b], texts[a:b]):
                for line in text.split(b"\n"):
                    if line.strip(_WORD_SPACE):
                        found = seen.get(line)
                        if found is None:
                            seen[line] = [1, doc]
                        else:
                            found[0] += 1
                            found[1] = doc if found[1] is None else found[1] if doc is None else min(found[1], doc)
            by_bucket: dict[int, list[bytes]] = {}
            for line in seen:
                by_bucket.setdefault(xxhash.xxh64_intdigest(line, 7) % buckets, []).append(line)
            pack = zstandard.ZstdCompressor(level=1).compress
            if by_bucket:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(by_bucket), pa.int32()),
                        pa.array([pack(b"\n".join(lines)) for lines in by_bucket.values()], pa.binary()),
                        pa.array([[seen[x][0] for x in lines] for lines in by_bucket.values()], pa.list_(pa.int64())),
                        pa.array([[seen[x][1] for x in lines] for lines in by_bucket.values()], pa.list_(pa.int64())),
                    ],
                    names=["bucket", "lines", "n", "doc"],
                )


def _merged_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines of each bucket, numbered: the bucket, then the place in it."""
    held: dict[int, dict[bytes, list]] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for bucket, packed, counts, docs in zip(*(batch.column(k).to_pylist() for k in range(4))):
            lines = held.setdefault(bucket, {})
            for line, n, doc in zip(unpack(packed).split(b"\n"), counts, docs):
                found = lines.get(line)
                if found is None:
                    lines[line] = [n, doc]
                else:
                    found[0] += n
                    found[1] = doc if found[1] is None else found[1] if doc is None else min(found[1], doc)
    for bucket, lines in sorted(held.items()):
        order = sorted(lines, key=lambda x: ((lines[x][1] is None, lines[x][1] or 0), x))
        for a, b in blocks([len(x) for x in order], 4_000_000):
            some = order[a:b]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket] * len(some), pa.int32()),
                    pa.array([bucket << 36 | a + k for k in range(len(some))], pa.int64()),
                    pa.array([lines[x][1] for x in some], pa.int64()),
                    pa.array([lines[x][0] for x in some], pa.int64()),
                    pa.array(some, pa.binary()),
                ],
                names=["bucket", "id", "doc_id", "n", "line"],
            )


def distinct_lines(docs: DataFrame) -> tuple[DataFrame, str]:
    """bucket, id, doc_id (the first), n, line of every distinct line, in a table bucketed by bucket; and the table's name, to drop it by."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(partitions_for(spark, size, BUCKET_BYTES), MAX_BUCKETS)
    packed = texts.mapInArrow(lambda it: _packed_lines(it, buckets), "bucket int, lines binary, n array<long>, doc array<long>")
    lines = packed.repartition(buckets, "bucket").mapInArrow(_merged_lines, "bucket int, id long, doc_id long, n long, line binary")
    name = f"tidegate_lines_{uuid.uuid4().hex}"
    lines.write.bucketBy(buckets, "bucket").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


# ---- candidates


def _signatures(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """32 parity bits of a line's characters; an edit flips two at most."""
    cell = (codes.astype(np.uint64) * _BASE >> np.uint64(59)).astype(np.int64)
    counts = np.bincount(owner * 32 + cell, minlength=32 * n).reshape(n, 32) & 1
    return (counts.astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def line_keys(lines: list[str], ids: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, id, signature and role (0 segment, 1 probe, 2 both) of all keys of some lines."""
    sizes = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate(([0], np.cumsum(sizes)))
    signature = _signatures(np.repeat(np.arange(len(lines)), sizes), codes, len(lines))
    # Prefix hashes over the joined lines, in log steps; a substring's hash doesn't depend on its place.
    up, down = _powers(len(codes) + 1)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], dtype=np.uint64)))
    out = []
    for gap, k, shift in probes(edits):
        indexed = sizes - gap
        start, size = segment(indexed, k, edits)
        start = start + shift
        rows = np.flatnonzero((indexed >= MIN_CHARS) & (start >= 0) & (start + size <= sizes))
        first = starts[rows] + start[rows]
        h = (prefix[first + size[rows]] - prefix[first]) * up[first]
        h = (h ^ (indexed[rows] * 64 + k).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out.append((h ^ h >> np.uint64(32), ids[rows], signature[rows], np.full(len(rows), 2 if gap == shift == 0 else 1, np.uint8)))
    return tuple(np.concatenate(c) for c in zip(*out))


_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, kept in the process; blocks bound their number."""
    if len(_power[0]) < n:
        for which, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            _power[which] = np.ones(n, np.uint64)
            np.multiply.accumulate(np.full(n - 1, base), out=_power[which][1:])
    return _power[0], _power[1]


def _key_rows(batches: Iterator[pa.RecordBatch], groups: int, edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = batch.column(1).to_pylist()
        for a, b in blocks([len(t) for t in texts], KEY_BYTES):
            lines = [t.decode("utf-8", "replace") for t in texts[a:b]]
            long = [k for k, x in enumerate(lines) if len(x) >= MIN_CHARS]
            if not long:
                continue
            h, i, s, r = line_keys([lines[k] for k in long], ids[a:b][long], edits)
            group = (h % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            names, blobs = [], []
            for part in np.split(order, cuts):
                names.append(int(group[part[0]]))
                blobs.append(h[part].astype("<u8").tobytes() + i[part].astype("<i8").tobytes() + s[part].astype("<u4").tobytes() + r[part].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["group", "keys"])


def _pair_batch(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def candidate_pairs(hashes: np.ndarray, ids: np.ndarray, signatures: np.ndarray, roles: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids that share a key, one as a segment and one as a probe, with close signatures."""
    ranked = np.sort(hashes)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    keep = np.flatnonzero(twice[at] == hashes)
    keep = keep[np.lexsort((ids[keep], hashes[keep]))]
    h, i, s, r = hashes[keep], ids[keep], signatures[keep], roles[keep]
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    begins = np.concatenate(([0], ends[:-1]))

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (i[x] != i[y]) & (np.bitwise_count(s[x] ^ s[y]) <= 2 * edits) & (((r[x] != 1) & (r[y] != 0)) | ((r[y] != 1) & (r[x] != 0)))

    small = ends - begins <= 16
    for step in range(1, 16):  # all short runs side by side, by distance in the run
        left = [np.arange(len(h))[:-step]]
        x = left[0]
        run = np.repeat(np.arange(len(begins)), ends - begins)
        x = x[(run[x] == run[x + step]) & small[run[x]]]
        x = x[close(x, x + step)]
        if len(x):
            yield i[x], i[x + step]
    for a, b in zip(begins[~small].tolist(), ends[~small].tolist()):
        for p in range(a, b, SLICE):
            one = np.arange(p, min(p + SLICE, b))
            for q in range(p, b, SLICE):
                two = np.arange(q, min(q + SLICE, b))
                x, y = (m.reshape(-1) for m in np.meshgrid(one, two, indexing="ij"))
                x, y = x[x < y], y[x < y]
                near = close(x, y)
                if near.any():
                    yield i[x[near]], i[y[near]]


def _candidate_rows(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(blob) // 21
            held.setdefault(group, []).append((np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<i8", n, 8 * n), np.frombuffer(blob, "<u4", n, 16 * n), np.frombuffer(blob, np.uint8, n, 20 * n)))
    for group in list(held):
        for one, two in candidate_pairs(*(np.concatenate(c) for c in zip(*held.pop(group))), edits):
            yield _pair_batch(one, two)


# ---- verification


def _fetch(pairs: pa.Table, lines: pa.Table) -> pa.Table:
    """The pairs of a bucket with the text of their first line."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("text", pa.binary())])
    if not pairs.num_rows:
        return schema.empty_table()
    at = {x: k for k, x in enumerate(lines.column("id").to_pylist())}
    found = lines.column("line").take(pa.array([at[x] for x in pairs.column("a").to_pylist()]))
    return pa.Table.from_arrays([pairs.column("a"), pairs.column("b"), found], schema=schema)


def _verify(pairs: pa.Table, lines: pa.Table, edits: int) -> pa.Table:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    if not pairs.num_rows:
        return schema.empty_table()
    at = {x: k for k, x in enumerate(lines.column("id").to_pylist())}
    texts = lines.column("line")
    kept = [
        (a, b)
        for a, b, text in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "text")))
        if edit_distance(text.decode("utf-8", "replace"), texts[at[b]].as_py().decode("utf-8", "replace"), edits) <= edits
    ]
    return pa.Table.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], schema=schema)


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """u, v: every pair of different lines within the edits, once."""
    spark = lines.sparkSession
    per_line = (edits + 1) * (edits + 2)
    groups = partitions_for(spark, per_line * lines.count(), KEYS_PER_TASK)
    keys = lines.select("id", "line").mapInArrow(lambda it: _key_rows(it, groups, edits), "group int, keys binary")
    pairs = keys.repartition(groups, "group").mapInArrow(lambda it: _candidate_rows(it, edits), "a long, b long")
    pairs = materialise(pairs.distinct(), "lines-pairs")
    # The lines stay where their buckets are; only pairs move.
    first = pairs.withColumn("of", F.shiftright("a", 36).cast("int")).groupBy("of").cogroup(lines.select("bucket", "id", "line").groupBy("bucket")).applyInArrow(_fetch, "a long, b long, text binary")
    second = first.withColumn("of", F.shiftright("b", 36).cast("int")).groupBy("of").cogroup(lines.select("bucket", "id", "line").groupBy("bucket")).applyInArrow(lambda p, x: _verify(p, x, edits), "u long, v long")
    return materialise(second, "lines-links")


def _marked(lines: DataFrame, edits: int) -> DataFrame:
    """id, doc_id, n, sha, n_links, class_doc_id, class_sha, kept of the distinct lines that come twice or have a link; the others are classes of their own."""
    links = line_links(lines, edits)
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n_links"))
    linked = materialise(degree.join(components(links).select(F.col("code").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "lines-linked")
    some = lines.join(linked, "id", "left").filter("n > 1 OR n_links IS NOT NULL")
    some = materialise(some.select("id", "doc_id", "n", F.unhex(F.sha2("line", 256)).alias("sha"), "n_links", "root"), "lines-some")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "sha")).alias("best")
    best = materialise(some.filter("root IS NOT NULL").groupBy("root").agg(first), "lines-best")
    named = some.join(best, "root", "left")
    alone = F.col("best").isNull()
    return named.select(
        "id", "doc_id", "n", "sha", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_doc_id"),
        F.coalesce("best.sha", "sha").alias("class_sha"), (alone | (F.col("best.sha") == F.col("sha"))).alias("kept"),
    )


def _hex(sha: Column) -> Column:
    return F.lower(F.hex(sha))


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each distinct line: doc_id (the first with it), line_sha256, n_chars, n_rows, n_links, class_doc_id and class_sha256 (of the representative), kept."""
    lines, table = distinct_lines(docs)
    marked = _marked(lines, edits).select("id", "n_links", "class_doc_id", _hex(F.col("class_sha")).alias("class_sha256"), "kept")
    facts = lines.select("id", "doc_id", "n", F.sha2("line", 256).alias("line_sha256"), F.length(F.col("line").cast("string")).alias("n_chars"))
    rows = facts.join(marked, "id", "left")
    rows = rows.select(
        "doc_id", "line_sha256", F.col("n_chars").cast("long").alias("n_chars"), F.col("n").alias("n_rows"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("class_sha256").isNull(), F.col("doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"), F.coalesce("class_sha256", "line_sha256").alias("class_sha256"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
    )
    rows = materialise(rows, "lines-classes")
    docs.sparkSession.sql(f"DROP TABLE {table}")
    return rows


MEMBERS = "doc_id long, row long, text_key long, line_no int, n_chars long, sha binary"


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word of each row, numbered."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids, texts, keys = (batch.column(k).to_pylist() for k in range(3))
        for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
            out = []
            for doc, text, key in zip(ids[a:b], texts[a:b], keys[a:b]):
                for place, line in enumerate(text.split(b"\n")):
                    if line.strip(_WORD_SPACE):
                        out.append((doc, row, key, place, len(line.decode("utf-8", "replace")), hashlib.sha256(line).digest()))
                row += 1
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "row", "text_key", "line_no", "n_chars", "sha"])


def line_members(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each line of each row of ``docs``: doc_id, line_no (from 0), line_sha256, n_chars, n_rows, n_links, class_doc_id, class_sha256, kept.

    Only a representative's first place is kept: its first document, there (ids may repeat) the first line, then the first text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.xxhash64(text_bytes()).alias("text_key"))
    members = materialise(texts.mapInArrow(_member_rows, MEMBERS), "lines-members")
    lines, table = distinct_lines(docs)
    marked = _marked(lines, edits).select("sha", F.col("n").alias("n_rows"), "n_links", F.col("class_doc_id").alias("of_doc"), "class_sha", F.col("kept").alias("stays"))
    # Most lines come once and have no link: they find nothing here and are what they are.
    marked = materialise(marked, "lines-marked")
    docs.sparkSession.sql(f"DROP TABLE {table}")
    rows = materialise(join_groups(members, marked, "sha", "n_rows", "left"), "lines-rows")
    shared = (F.col("n_rows") > 1) & F.col("stays")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line_no", "text_key", "row")
    first = materialise(rows.filter(shared).groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n_shared")), "lines-first")
    seated = join_groups(rows.filter(shared), first, "sha", "n_shared").withColumn("kept", (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))).drop("first", "n_shared")
    others = rows.filter(~F.coalesce(shared, F.lit(False))).withColumn("kept", F.coalesce("stays", F.lit(True)))
    own = F.col("n_rows").isNull()
    return seated.unionByName(others).select(
        "doc_id", "line_no", _hex(F.col("sha")).alias("line_sha256"), "n_chars", F.coalesce("n_rows", F.lit(1)).alias("n_rows"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(own, F.col("doc_id")).otherwise(F.col("of_doc")).alias("class_doc_id"), _hex(F.coalesce("class_sha", "sha")).alias("class_sha256"), "kept",
    )


def drop_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id and text of every row without the lines that another represents; a representative stays where it first comes."""
    gone = line_classes(docs, edits).filter("NOT kept").select(F.col("line_sha256").alias("__sha"))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(rows, "lines-rows")
    each = rows.select("__row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("__sha", F.sha2(F.col("line").cast("binary"), 256))
    worded = F.col("line").rlike(r"[^ \t\x0B\x0C\r]")
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").cast("long").alias("doc_id"), "at", "__row")
    first = each.filter(worded).groupBy("__sha").agg(F.min(place).alias("__first"))
    here = (F.col("__row") == F.col("__first.__row")) & (F.col("at") == F.col("__first.at"))
    left = each.join(gone, "__sha", "left_anti").join(first, "__sha", "left").filter(~worded | here).groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("__text"))
    return rows.join(left, "__row", "left").select("doc_id", F.coalesce("__text", F.lit("")).alias("text"))
