"""Best-fit packing of documents into token sequences (operator 2).

A document is its ids by a file of the tokenizers library, then an end id; null text counts as empty.
Documents longer than the capacity are cut into pieces of it; the last piece may be shorter. Pieces
of full length are sequences of their own, the others are packed in bulk-synchronous rounds:

* the longest documents left, and those over half as long, take part; each sequence offers its gap,
  split into as many equal slots as documents of the largest length would fill. Of the gaps that hold
  any of these documents only the smallest take part, as many as give each document a slot;
* documents and slots are sorted together by size over the cluster, and each task sweeps its range:
  a slot takes the largest document before it that no smaller slot took. What finds no mate in its
  range is ranked; the ranks that meet across ranges follow from the numbers left in each range, and
  documents and slots are joined by that rank, so no two documents get one slot;
* gaps shrink by what they took, and the next round starts. Sequences are opened as long as the
  largest document fits no gap.

Every round is a table in the shared folder. Documents of one length and slots of one size come in the
order of their numbers. A very long text is cut like any other and its pieces are spread over
sequences. Repeated rows and null ids are packed like any other row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.bpe import Table
from tidegate.llm.common import begin, blocks, materialise, worker_table

CAPACITY = 4096
END_ID = 1
#: In each round documents over the largest length divided by this take part.
WAVE = 2
ROWS_PER_TASK = 50_000
#: Ranges of a round at most; beyond that they grow. Their leftovers are matched by a few numbers a range.
MAX_RANGES = 50_000
#: Sequences of one gap are chosen by so many buckets.
BUCKETS = 1024
BLOCK_CHARS = 2_000_000
#: Characters that one call of the library encodes.
JOINED = 4096
#: Texts of these are in normal form, and their lower case is that of each character.
LATIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-įı-ſ¡¿«»“”‘’–—…€£]*")
#: The pre-tokenizer's pieces of such a text in lower case.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ſ]+|[0-9]|[^\x09-\x0D\x20a-z0-9ß-öø-ſ]+")


class Tokens:
    """Ids of texts by a file of the tokenizers library whose pre-tokenizer drops white space.

    Texts of Latin letters are split here as the pre-tokenizer does, and the ids of the pieces are kept;
    other texts are split between spaces and line feeds, and the ids of those parts are kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for s, i in self.model.get_vocab().items() if s.endswith("</w>")]] = True
        self.pieces, self.parts = Table(self._pieces), Table(self._parts)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pieces: many a call, as the last id of a piece says that it is the last."""
        out: list[bytes] = []
        for a, b in blocks([len(p) for p in pieces], JOINED):
            ids = self._ids(" ".join(pieces[a:b]))
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != b - a:
                raise ValueError(f"not one piece each: {pieces[a:b]}")
            out += map(ids.tobytes().__getitem__, map(slice, [0, *cuts[:-1]], cuts))
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of any strings: many a call, with a special token between them."""
        mark, name = 49406, "<|startoftext|>"
        out: list[bytes] = []
        for a, b in blocks([len(p) for p in parts], JOINED):
            ids = self._ids(name.join(parts[a:b]))
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) == b - a - 1:
                flat, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                out += map(flat.__getitem__, map(slice, [0, *[x + 4 for x in ends[:-1]]], ends))
            else:  # a string that holds the token itself
                out += [self._ids(p).tobytes() for p in parts[a:b]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        latin = [(t.isascii() or LATIN.fullmatch(t) is not None) and "<|" not in t for t in texts]
        split = [PIECES.findall(t.lower()) if x else t.replace("\n", " ").split(" ") for t, x in zip(texts, latin)]
        self.pieces.fill(set().union(*(ps for ps, x in zip(split, latin) if x)))
        self.parts.fill(set().union(*(ps for ps, x in zip(split, latin) if not x)))
        get = {True: self.pieces.__getitem__, False: self.parts.__getitem__}
        return [b"".join(map(get[x], ps)) for ps, x in zip(split, latin)]


_models: dict[str, Tokens] = worker_table()

PIECE = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    begin(_models)
    if path not in _models:
        _models[path] = Tokens(path)
    end = END_ID.to_bytes(4, "little")
    pid = TaskContext.get().partitionId() << 36
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in blocks([len(t) for t in texts], BLOCK_CHARS):
            rows = []
            for doc, ids in zip(docs[a:b], _models[path].encode(texts[a:b])):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((pid, doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part))
                    pid += 1
            kinds = {"pid": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, a number (pid) each; with_ids adds their ids."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda it: _pieces(it, path, capacity, with_ids), PIECE + (", ids binary" if with_ids else "")
    )
    return materialise(made, "packing-pieces")


def sweep(rows: Iterator[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """One pass over (kind, id, size) in order of size, documents (0) before slots (1).

    Returns the pairs (document, slot) by place, the slots left in order, and the documents left, largest first.
    """
    waiting: list[int] = []
    pairs, slots = [], []
    for place, (kind, _, _) in enumerate(rows):
        if kind == 0:
            waiting.append(place)
        elif waiting:
            pairs.append((waiting.pop(), place))
        else:
            slots.append(place)
    return pairs, slots, waiting[::-1]


SWEPT = "kind int, id long, size long, task int, rank long, bin long"


def _sweep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the sequence it got, or with its rank among those left; slots left with theirs."""
    begin()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    kind, ids, size = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
    pairs, slots, waiting = sweep(zip(kind.tolist(), ids.tolist(), size.tolist()))
    rank, mate = np.full(len(kind), -1, np.int64), np.full(len(kind), -1, np.int64)
    rank[slots] = np.arange(len(slots))
    rank[waiting] = np.arange(len(waiting))
    if pairs:
        doc, slot = np.array(pairs).T
        mate[doc] = ids[slot]
    out = np.flatnonzero((kind == 0) | (rank >= 0))
    task = np.full(len(out), TaskContext.get().partitionId(), np.int32)
    for a in range(0, len(out), 20_000):
        o = out[a : a + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind[o]), pa.array(ids[o]), pa.array(size[o]), pa.array(task[a : a + len(o)]), pa.array(rank[o]), pa.array(mate[o], mask=mate[o] < 0)],
            names=["kind", "id", "size", "task", "rank", "bin"],
        )


def meeting_ranks(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Where leftovers of the ranges meet: rows (kind, task, first rank, first key), with a last rank.

    ``left`` has (task, slots left, documents left) of each range in order. Slots take the documents
    of the nearest range before them first; equal keys are mates.
    """
    stack: list[list[int]] = []
    out, key = [], 0
    for task, slots, documents in left:
        taken = 0
        while taken < slots and stack:
            top = stack[-1]
            n = min(slots - taken, top[2])
            out += [(1, task, taken, taken + n, key), (0, top[0], top[1], top[1] + n, key)]
            key, taken = key + n, taken + n
            top[1], top[2] = top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if documents:
            stack.append([task, 0, documents])
    return out


def offered(documents: int, largest: int, gaps: dict[int, int]) -> tuple[int, int, int]:
    """Of the gaps (number by size) that hold the largest document, the fullest sequences that have a slot for each document.

    Returns the largest gap that takes part, and how many of its sequences and slots of each are needed.
    """
    left = documents
    for gap in sorted(g for g in gaps if g >= largest):
        some = gaps[gap] * (gap // largest)
        if some >= left:
            return gap, min(left, gaps[gap]), -(-left // gaps[gap])
        left -= some
    return max(gaps, default=0), gaps[max(gaps)] if gaps else 0, max(gaps, default=0) // largest


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pid, bin: the sequence of each item (pid, length), all shorter than the capacity."""
    spark = items.sparkSession
    placed: list[DataFrame] = []
    opened = 0
    # kind 0: a document and its length; kind 1: a sequence and its gap.
    state = materialise(items.select(F.lit(0).alias("kind"), F.col("pid").alias("id"), F.col("length").alias("size")), "packing-state")
    while True:
        # How many documents and gaps have each size: at most two rows for each number up to the capacity.
        sizes: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for row in state.groupBy("kind", "size").count().collect():
            sizes[row["kind"]][row["size"]] = row["count"]
        documents, gaps = sizes
        if not documents:
            break
        largest, gap = max(documents), max(gaps, default=0)
        if gap < largest:
            more = -(-sum(size * n for size, n in documents.items() if size > gap) // capacity)
            fresh = spark.range(opened, opened + more).select(F.lit(1).alias("kind"), "id", F.lit(capacity).cast("long").alias("size"))
            opened += more
            gaps[capacity] = more
            state = state.unionByName(fresh)
        bound = largest // WAVE
        waiting_now = sum(n for size, n in documents.items() if size > bound)
        most, wanted, each = offered(waiting_now, largest, gaps)
        place = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
        taking = F.lit(True)
        if gaps[most] > 2 * wanted:  # so many sequences of one gap that some buckets of them will do
            counts = {r["place"]: r["count"] for r in state.filter((F.col("kind") == 1) & (F.col("size") == most)).groupBy(place.alias("place")).count().collect()}  # a row a bucket
            total, last = 0, -1
            while total < wanted:
                last += 1
                total += counts.get(last, 0)
            taking, gaps[most] = place <= last, total
        active = state.filter((F.col("size") > bound) & ((F.col("kind") == 0) | (F.col("size") < most) | ((F.col("size") == most) & taking)))
        parts = F.when(F.col("size") == most, each).otherwise(F.greatest(F.lit(1), F.floor(F.col("size") / largest))).cast("int")
        ranged = active.select(
            "kind", "id", F.when(F.col("kind") == 1, F.floor(F.col("size") / parts)).otherwise(F.col("size")).cast("long").alias("size"),
            F.explode(F.when(F.col("kind") == 1, F.sequence(F.lit(1), parts)).otherwise(F.array(F.lit(0)))).alias("slot"),
        )
        rows = waiting_now + sum(n * (each if size == most else max(1, size // largest)) for size, n in gaps.items() if bound < size <= most)
        tasks = min(max(1, -(-rows // ROWS_PER_TASK)), MAX_RANGES)
        swept = ranged.repartitionByRange(tasks, "size", "kind", "id", "slot").sortWithinPartitions("size", "kind", "id", "slot").select("kind", "id", "size").mapInArrow(_sweep_rows, SWEPT)
        swept = materialise(swept, "packing-swept")
        # A row for each range, of which there are MAX_RANGES at most.
        left = swept.filter("rank >= 0").groupBy("task").agg(F.sum("kind").alias("slots"), F.sum(1 - F.col("kind")).alias("documents")).orderBy("task").collect()
        met = meeting_ranks([(r["task"], r["slots"], r["documents"]) for r in left])
        local = swept.filter("kind = 0 AND bin IS NOT NULL").select(F.col("id").alias("pid"), "size", "bin")
        rest = swept.filter("kind = 0 AND bin IS NULL")
        if met:
            spans = F.broadcast(spark.createDataFrame(met, "mkind int, mtask int, low long, high long, key long"))  # four rows a range at most
            ranked = swept.filter("rank >= 0").join(spans, (F.col("kind") == F.col("mkind")) & (F.col("task") == F.col("mtask")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
            ranked = ranked.withColumn("mate", F.col("key") + F.col("rank") - F.col("low"))
            matched = ranked.filter("mate IS NOT NULL")
            pairs = matched.filter("kind = 0").select(F.col("id").alias("pid"), "size", "mate").join(matched.filter("kind = 1").select("mate", F.col("id").alias("bin2")), "mate")
            now = local.unionByName(pairs.select("pid", "size", F.col("bin2").alias("bin")))
            rest = ranked.filter("kind = 0 AND mate IS NULL")
        else:
            now = local
        now = materialise(now, "packing-round")
        placed.append(now)
        gaps = state.filter("kind = 1").select("id", "size").unionByName(now.select(F.col("bin").alias("id"), (-F.col("size")).alias("size")))
        gaps = gaps.groupBy("id").agg(F.sum("size").alias("size")).filter("size > 0").select(F.lit(1).alias("kind"), "id", "size")
        waiting = state.filter((F.col("kind") == 0) & (F.col("size") <= bound))
        state = materialise(waiting.unionByName(rest.select(F.lit(0).alias("kind"), "id", "size")).unionByName(gaps), "packing-state")
    if not placed:
        return spark.createDataFrame([], "pid long, bin long")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("pid", "bin")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with_ids adds ids.

    Sequences of one full piece have negative numbers.
    """
    made = pieces(docs, path, capacity, with_ids)
    full = made.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    short = made.filter(F.col("length") < capacity)
    bins = best_fit(short.select("pid", "length"), capacity)
    before = Window.partitionBy("bin").orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    seated = short.join(bins, "pid").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).withColumnRenamed("bin", "sequence_id")
    return full.unionByName(seated).drop("pid")
