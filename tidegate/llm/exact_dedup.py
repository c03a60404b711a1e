"""Exact dedup over a cuckoo-filter index (operator 8).

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the
row with the largest ``doc_id`` stays (a null id sorts below all others; of rows that repeat an id,
one stays). An empty table gives an empty result; other columns are ignored, whatever their names.

* Each task first runs its own rows through an index, so a group of copies leaves a task as one row
  however hot it is. Those rows are dealt by digest, and the index of each shard holds one live digest
  for each text: a filter hit is verified against the digest and length kept in the bucket, a larger
  id deletes the live one and takes its place, and an overflow grows the filter from the stored keys.
* What a shard's index holds in the end is the result; the rows that it turned down find it by digest.
  Groups with over a thousandth of all rows, a thousand at most, go to the rows instead.
* The texts of all groups that the index found are then bucketed by digest and compared as such; a
  group whose texts differ (a SHA-256 collision) stops the job, so no text is ever lost to one.

A very long text is a digest like any other; only texts that have copies move, for the comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import begin, few, join_groups, materialise, partitions_for, row_key, text_bytes, without_rows

SLOTS = 4
MAX_KICKS = 200
#: Live digests after which a task passes on what it has, to the shards; theirs hold all that they are dealt.
LIVE_PER_TASK = 400_000
ROWS_PER_SHARD = 200_000


class CuckooIndex:
    """A cuckoo filter whose slots refer to stored records ``[key, payload]``.

    ``find`` compares 16-bit tags first and the stored key after a hit, so answers are exact.
    ``insert`` grows the table when no free slot turns up; ``delete`` frees the slot of a live key.
    Keys are digests of at least 8 bytes.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self._clear(buckets)
        self.records: dict[int, list] = {}
        self._next = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.refs = [-1] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.records)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(key[:2], "little") | 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        tag, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.refs[slot] >= 0 and self.records[self.refs[slot]][0] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> list | None:
        """The record of a live key, to be read or changed in place."""
        slot = self._slot(key)
        return None if slot < 0 else self.records[self.refs[slot]]

    def insert(self, key: bytes, payload: object) -> list:
        record = [key, payload]
        ref, self._next = self._next, self._next + 1
        self.records[ref] = record
        if not self._seat(key, ref):
            self._grow()
        return record

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        del self.records[self.refs[slot]]
        self.tags[slot], self.refs[slot] = 0, -1
        return True

    def _seat(self, key: bytes, ref: int) -> bool:
        tag, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.refs[slot] < 0:
                    self.tags[slot], self.refs[slot] = tag, ref
                    return True
        bucket = one
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + ref) % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            ref, self.refs[slot] = self.refs[slot], ref
            bucket = self._other(bucket, tag)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.refs[slot] < 0:
                    self.tags[slot], self.refs[slot] = tag, ref
                    return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled again from the stored keys."""
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._seat(record[0], ref) for ref, record in self.records.items()):
                return
            buckets *= 2


#: best, at, raw: id, row number and text hash of the row that stays; same: rows with its id and text; n: all rows.
GROUPS = "digest binary, length long, best long, at long, raw long, same long, n long"
_LOW = -(1 << 63)


def _rank(best: int | None, at: int, raw: int) -> tuple[int, int, int]:
    """The row that stays has the highest: the largest id, the smallest text hash, the first row."""
    return (_LOW - 1 if best is None else best, -raw, -at)


def index_groups(rows: Iterable[tuple], most: int | None = None) -> Iterator[tuple]:
    """Rows as in ``GROUPS``, one for each live digest; with ``most``, an index that full is passed on first."""
    index = CuckooIndex()
    for digest, length, best, at, raw, same, n in rows:
        key = digest + length.to_bytes(8, "little")
        record = index.find(key)
        if record is None:
            if most is not None and len(index) >= most:
                yield from _live(index)
                index = CuckooIndex()
            index.insert(key, (best, at, raw, same, n))
            continue
        best2, at2, raw2, same2, n2 = record[1]
        if best == best2 and raw == raw2:
            record[1] = (best, min(at, at2), raw, same + same2, n + n2)
        elif _rank(best, at, raw) > _rank(best2, at2, raw2):
            index.delete(key)
            index.insert(key, (best, at, raw, same, n + n2))
        else:
            record[1] = (best2, at2, raw2, same2, n + n2)
    yield from _live(index)


def _live(index: CuckooIndex) -> Iterator[tuple]:
    for key, payload in index.records.values():
        yield key[:-8], int.from_bytes(key[-8:], "little"), *payload


def _to_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.binary()), *((c, pa.int64()) for c in ("length", "best", "at", "raw", "same", "n"))])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    each = ((*row, 1, 1) for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(5))))
    yield from _to_batches(index_groups(each, LIVE_PER_TASK))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    yield from _to_batches(index_groups(row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(7)))))


DIGESTS = "digest binary, length long, doc_id long, at long, raw long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        texts = [t.lower() for t in batch.column(2).to_pylist()]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), batch.column(0), pa.array(range(at, at + len(texts)), pa.int64()), batch.column(1)],
            names=["digest", "length", "doc_id", "at", "raw"],
        )
        at += len(texts)


def digests(docs: DataFrame) -> DataFrame:
    """digest, length, doc_id, at (a number), raw (a hash of the text as it is) of every row, in the shared folder."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("raw"), text_bytes().alias("text")).mapInArrow(_digests, DIGESTS)
    return materialise(made, "exact-digests")


def groups(keyed: DataFrame) -> DataFrame:
    """One row a distinct text, as in ``GROUPS``: what the shards' indexes hold. ``keyed`` comes from ``digests``."""
    partial = materialise(keyed.mapInArrow(_partial, GROUPS), "exact-partial")
    shards = partitions_for(keyed.sparkSession, partial.count(), ROWS_PER_SHARD)
    return materialise(partial.repartition(shards, "digest").mapInArrow(_shard, GROUPS), "exact-groups")


def _members(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``keyed`` in the groups ``repeated``, with what the index holds of them."""
    kept = repeated.select("digest", "best", F.col("at").alias("best_at"), F.col("raw").alias("best_raw"), "same", "n")
    return join_groups(keyed, kept, "digest", "n")


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify_groups(docs: DataFrame, members: DataFrame) -> None:
    """Compare the texts of each group that the index found; raises where they differ."""
    wanted = few(materialise(members.select("raw", "digest").distinct(), "exact-wanted"))
    texts = docs.select(F.xxhash64(text_bytes()).alias("raw"), "text").join(wanted, "raw").select("digest", _lowered(F.col("text")).alias("text"))
    # A least and a greatest text a group: summed up before the shuffle, however hot the group.
    apart = texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b")
    found = apart.select(F.hex("digest").alias("digest")).first()
    if found is not None:
        raise ValueError(f"different texts have the digest {found['digest'].lower()}")


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digests of all rows, the groups, and the members of those with copies, verified."""
    keyed = digests(docs)
    found = groups(keyed)
    members = materialise(_members(keyed, found.filter("n > 1")), "exact-members")
    verify_groups(docs, members)
    return keyed, found, members


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for every row of ``docs``."""
    _, found, members = _found(docs)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = found.filter("n = 1").select(F.col("best").alias("doc_id"), F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(members.select("doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("best_at")).alias("kept"), sha))


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    Rows with the largest id can differ in case; the one with the smallest text hash stays. Of rows
    alike in id and text, the one with the smallest hash of all columns stays.
    """
    _, _, members = _found(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("best")) & (F.col("raw") == F.col("best_raw"))
    pair = row_key(F.col("doc_id"), F.col("raw"))
    gone = materialise(members.filter(~stays).select(pair).distinct(), "exact-gone")
    again = materialise(members.filter(stays & (F.col("same") > 1)).select(pair).distinct(), "exact-again")
    return without_rows(docs, gone, again)
