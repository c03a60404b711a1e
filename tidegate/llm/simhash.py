"""SimHash near-dedup over a Gray-order hierarchical index (operator 10).

A fingerprint has a bit where over half of the text's shingle hashes have it. Shingles are of three
words (a parameter), repeats counted; texts with fewer words have one shingle, texts without words
the fingerprint zero, which links like any other. Null text counts as empty. Two fingerprints link
at ``most`` (3) or fewer differing bits; a component is named by the smallest ``doc_id`` in it (null
ids come last). Repeated rows share a component; an empty table gives an empty result.

The search runs over distinct fingerprints. The top of the index splits the 64 bits into four
blocks: of two fingerprints that differ in at most three bits one block is equal, so a copy dealt by
each block's pattern meets every partner. A block pattern that is too common is split once more by
the same rule over its remaining bits. Below, a task sorts its codes by Gray rank and groups runs of
them; a node keeps the bits that all its codes share, a parent those its children share. The search
goes down pairs of nodes, adds up the differences in shared bits and drops a pair once they exceed
the limit. A pair that cannot differ in more than the limit is taken whole. Each task passes on a
spanning forest, so a large group costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import begin, blocks, materialise, partitions_for, text_bytes

SEED = 42
FAN = 8
BLOCKS = 4
CODES_PER_TASK = 400_000
#: Distinct fingerprints under one block pattern beyond which the pattern is split further.
COMMON_PATTERN = 20_000
#: Node pairs that the search holds at once.
FRONTIER = 200_000
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int = 3) -> list[bytes]:
    """XXH64 of each shingle, big-endian."""
    tokens = text.lower().split()  # bytes: lowers A-Z, splits at \x20 \x09-\x0D
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_digest(b" ".join(tokens), SEED)]
    return list(map(xxhash.xxh64_digest, map(b" ".join, zip(*(tokens[i:] for i in range(words)))), repeat(SEED)))


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """One unsigned fingerprint a text."""
    out = np.zeros(len(texts), np.uint64)
    weights = _ONE << np.arange(63, -1, -1, dtype=np.uint64)
    for a, b in blocks([len(t) for t in texts], 1_000_000):
        hashes = [shingle_hashes(t, words) for t in texts[a:b]]
        counts = np.array([len(h) for h in hashes])
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        bits = np.unpackbits(np.frombuffer(b"".join(b"".join(h) for h in hashes), np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[a + full] = ((2 * ones > counts[full][:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Labels of codes 0..n-1 under links given in bulk."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.label
        while True:
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = parent[parent]
                if (jumped == parent).all():
                    break
                parent = jumped
            self.label = parent


class GrayIndex:
    """Runs of codes in Gray order under nodes that keep the bits shared below them."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        low = high = codes[self.order]
        #: Per level, from the codes up: shared bits, and their values.
        self.levels = [(np.full(len(codes), _ALL), low)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            shared = ~(low ^ high)
            self.levels.append((shared, low & shared))

    def link_within(self, most: int, exact: np.uint64, forest: Forest, ids: np.ndarray) -> None:
        """Link in ``forest`` all codes at ``most`` or fewer differing bits that agree in the bits ``exact``.

        ``ids`` are the places of the codes in the forest.
        """
        ids = ids[self.order]
        top = len(self.levels) - 1
        held = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while held:
            level, a, b = held.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                held += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            shared, value = self.levels[level]
            both = shared[a] & shared[b]
            apart = (value[a] ^ value[b]) & both
            sure = np.bitwise_count(apart)
            near = (sure <= most) & ((apart & exact) == 0)
            a, b, both, sure = a[near], b[near], both[near], sure[near]
            if level == 0:
                forest.link(ids[a], ids[b])
                continue
            whole = (sure + np.bitwise_count(~both) <= most) & ((~both & exact) == 0)
            if whole.any():  # every code below one is within reach of every code below the other
                self._join(level, a[whole], b[whole], forest, ids)
                a, b = a[~whole], b[~whole]
            if level == 1 and len(a):
                labels = forest.label[ids]
                starts = np.arange(0, len(ids), FAN)
                low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
                done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
                a, b = a[~done], b[~done]
            if not len(a):
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FAN)
            x = (a[:, None, None] * FAN + step[:, None] + 0 * step).reshape(-1)
            y = (b[:, None, None] * FAN + step + 0 * step[:, None]).reshape(-1)
            ok = (x <= y) & (y < below)
            if level == 1:
                ok &= x < y
            held.append((level - 1, x[ok], y[ok]))

    def _join(self, level: int, a: np.ndarray, b: np.ndarray, forest: Forest, ids: np.ndarray) -> None:
        width = FAN**level
        for x, y in zip(a.tolist(), b.tolist()):
            first = ids[x * width : (x + 1) * width]
            forest.link(np.full(len(first), first[0]), first)
            if x != y:
                second = ids[y * width : (y + 1) * width]
                forest.link(np.full(len(second), first[0]), second)


def _block_mask(block: int, sub: int) -> int:
    """The bits that a block pattern fixes; sub -1: the block's 16, else 12 of the others as well."""
    mask = 0xFFFF << (16 * block)
    if sub >= 0:
        rest = [i for i in range(64) if i // 16 != block][12 * sub : 12 * sub + 12]
        mask |= sum(1 << i for i in rest)
    return mask


def _forest_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    begin()
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    code, block, sub = (np.concatenate(c) for c in zip(*held))
    every, place = np.unique(code.astype(np.int64).view(np.uint64), return_inverse=True)
    forest = Forest(len(every))
    for j in range(BLOCKS):
        for s in range(-1, BLOCKS):
            rows = np.flatnonzero((block == j) & (sub == s))
            if len(rows) > 1:
                mask = np.uint64(_block_mask(j, s))
                index = GrayIndex(_rotate(every[place[rows]], j))
                index.link_within(most, _rotate(np.array([mask]), j)[0], forest, place[rows])
    apart = np.flatnonzero(forest.label != np.arange(len(every)))
    if len(apart):
        yield pa.RecordBatch.from_arrays([pa.array(every[apart].view(np.int64)), pa.array(every[forest.label[apart]].view(np.int64))], names=["u", "v"])


def _rotate(codes: np.ndarray, block: int) -> np.ndarray:
    """Block ``block`` becomes the leading bits, so Gray order keeps its patterns together."""
    left = np.uint64(48 - 16 * block)
    return codes if left == 0 else (codes << left) | (codes >> (np.uint64(64) - left))


def near_links(codes: DataFrame, most: int = 3) -> DataFrame:
    """u, v: a spanning forest of the links between distinct fingerprints ``code``, task by task."""
    if most >= BLOCKS:
        raise ValueError(f"at most {BLOCKS - 1} differing bits")
    spark = codes.sparkSession
    dealt = codes.select("code", F.explode(F.array(*(F.struct(F.lit(j).alias("block"), F.shiftrightunsigned("code", 16 * j).bitwiseAND(0xFFFF).alias("pattern")) for j in range(BLOCKS)))).alias("k"))
    dealt = dealt.select("code", "k.block", "k.pattern")
    common = dealt.groupBy("block", "pattern").count().filter(F.col("count") > COMMON_PATTERN).drop("count")
    common = materialise(common, "simhash-common")
    if common.isEmpty():
        keyed = dealt.withColumn("sub", F.lit(-1)).withColumn("more", F.lit(0).cast("long"))
    else:
        marked = dealt.join(common.withColumn("hot", F.lit(True)), ["block", "pattern"], "left")
        # The 48 other bits, those of the lower blocks first, as _block_mask counts them.
        low = F.col("code").bitwiseAND(F.expr("shiftleft(1L, 16 * block) - 1"))
        high = F.when(F.col("block") < BLOCKS - 1, F.expr("shiftleft(shiftrightunsigned(code, 16 * block + 16), 16 * block)")).otherwise(F.lit(0).cast("long"))
        rest = low.bitwiseOR(high)
        parts = F.array(*(F.struct(F.lit(s).alias("sub"), F.shiftrightunsigned(rest, 12 * s).bitwiseAND(0xFFF).cast("long").alias("more")) for s in range(BLOCKS)))
        one = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("more")))
        keyed = marked.withColumn("s", F.explode(F.when(F.col("hot"), parts).otherwise(one))).select("code", "block", "pattern", "s.sub", "s.more")
    tasks = partitions_for(spark, BLOCKS * codes.count(), CODES_PER_TASK)
    spread = keyed.repartition(tasks, "block", "pattern", "sub", "more").select("code", "block", "sub")
    return spread.mapInArrow(lambda it: _forest_rows(it, most), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """code, root for every code in ``links`` (u, v): the smallest code reachable.

    Large-star and small-star steps, each a minimum by key and a join, until a round changes nothing;
    every round is a table in the shared folder.
    """
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        before = edges
        # Large-star: a node hands its larger neighbours to the smallest one around.
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(around.groupBy("u").agg(F.min("v").alias("m")), "stars-least").withColumn("m", F.least("u", "m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "stars-large")
        # Small-star: a node hands itself and its smaller neighbours to the smallest of them.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "stars-least")
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        if edges.exceptAll(before).isEmpty() and before.exceptAll(edges).isEmpty():
            return edges.select(F.col("u").alias("code"), F.col("v").alias("root"))


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        codes = fingerprints(batch.column(1).to_pylist(), words)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])


def simhash_codes(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long, of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(lambda it: _fingerprint_rows(it, words), "doc_id long, code long")


def simhash_components(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for every row of ``docs``."""
    coded = materialise(simhash_codes(docs, words), "simhash-codes")
    codes = materialise(coded.groupBy("code").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(materialise(near_links(codes.select("code"), most), "simhash-links"))
    named = codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    named = materialise(named, "simhash-roots")
    smallest = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    answer = materialise(named.join(smallest, "root").select("code", "component_id"), "simhash-answer")
    return coded.join(answer, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def keep_near(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component one row with its smallest id."""
    from pyspark.sql import Window

    kept = simhash_components(docs, words, most).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__tg_id")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("__tg_id")))
    one = Window.partitionBy("__tg_id").orderBy(F.coalesce(F.col("text"), F.lit("")))
    return rows.withColumn("__tg_row", F.row_number().over(one)).filter("__tg_row = 1").select(*[docs[c] for c in docs.columns])
