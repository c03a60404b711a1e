"""Near-dedup by SimHash, checked and completed on whole shingle sets (the near-dedup stage of the pipeline).

A text's set holds its distinct shingles of five words, as operator 10 cuts them (lower-cased A-Z; a
text with fewer words is one shingle). Texts link when the sets' Jaccard similarity is 0.8 or more,
compared in whole numbers; texts without words link to each other. Null text counts as empty. A
component is all texts linked directly or through others; one row with its smallest ``doc_id`` stays
(null ids come last). An empty table gives an empty result.

* Texts with equal sets are one from the start.
* Operator 10 gives each text its fingerprint, over five words, and the Gray-order index links those
  within ``NEAR_BITS``. The pairs of its forest are verified on the whole sets, and make the first components.
* Fingerprints further apart can belong to texts that link, and a pair of the forest that fails can stand
  for one that doesn't; what follows finds all these. A set's shingles are put in one order for all, those
  that are common in a sample last. Two sets that link share a shingle among the first n - ceil(0.8 n) + 1
  of each (a prefix filter). The order decides the cost only, never the result.
* The sets under one such shingle are a run; runs of the same sets are one. A set has a signature, the
  parity of its hashes in each of ``BITS`` cells. Two signatures differ in no more cells than the sets have
  shingles apart, so a pair that differs in too many can't link. Runs bring signatures together, and only
  pairs that can link leave the task, of those that are not in one component yet.
* A crowded run gives a forest of such pairs, no more than it has sets. Where a pair of a forest fails,
  its run gives all its pairs that are still apart.
* Every pair is verified on the whole sets; similarity is never estimated.

A very long text has a set like any other. Texts alike in id and hash are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import begin, blocks, few, join_groups, materialise, partitions_for, row_key, text_bytes, without_rows
from tidegate.llm.simhash import components, fingerprints, near_links, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Documents of the sample, occurrences in it that make a shingle common, and shingles listed at most.
SAMPLE_ROWS, COMMON, MOST_COMMON = 20_000, 3, 200_000
KEYS_PER_TASK = 1_000_000
#: Cells of a signature.
BITS = 2048
#: Bits that fingerprints linked by the index differ in at most.
NEAR_BITS = 3
#: Sets of a run beyond which it gives a forest, and those of them that meet all others first.
CROWDED, PIVOTS = 64, 4


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, words)), ">u8").astype(np.uint64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least similarity."""
    up, down = LEAST
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    return (up + down) * len(np.intersect1d(a, b, assume_unique=True)) >= up * (len(a) + len(b))


def signature(found: np.ndarray) -> bytes:
    """The parity of the number of shingles in each cell."""
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(found: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a linked set has one among its own; ``common`` is sorted, ``places`` its ranks."""
    up, down = LEAST
    n = len(found)
    size = n + up * n // -down + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, places[at] + 1, 0)
        found = found[np.lexsort((found, rank))]
    return found[:size]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["shingle"])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are common in a sample, ascending, and the place of each by its count."""
    texts = docs.select(text_bytes().alias("text"))
    step = max(docs.count() // SAMPLE_ROWS, 1)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    counts = sample.mapInArrow(_sample_rows, "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()
    found = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(rows) - np.arange(len(rows)))[order]


def _set_rows(batches: Iterator[pa.RecordBatch], common: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        codes, sizes, keys, signs = [], [], [], []
        texts = batch.column(2).to_pylist()
        prints = fingerprints(texts, WORDS)
        for text in texts:
            found = shingle_set(text)
            codes.append(xxhash.xxh64_intdigest(found.tobytes()))
            sizes.append(len(found))
            keys.append(prefix(found, common, places).tobytes())
            signs.append(signature(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(prints.view(np.int64))],
            names=["doc_id", "text_key", "code", "n", "keys", "sign", "print"],
        )


def _key_rows(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """A row for each group of keys in a batch: shingles and codes, packed."""
    begin()
    for batch in batches:
        packed = batch.column(1).to_pylist()
        for x, y in blocks([len(k) for k in packed], 16_000_000):
            counts = np.array([len(k) // 8 for k in packed[x:y]])
            h = np.frombuffer(b"".join(packed[x:y]), np.uint64)
            code = np.repeat(batch.column(0).to_numpy()[x:y], counts)
            group = (h % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            names, blobs = [], []
            for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if len(part):
                    names.append(int(group[part[0]]))
                    blobs.append(h[part].tobytes() + code[part].astype("<i8").tobytes())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["group", "keys"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of each run (a hash of its codes, code): of two sets or more under one key, once for equal ones."""
    begin()
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for group, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(blob) // 16
            held.setdefault(group, []).append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, "<i8", n, 8 * n)))
    for group in list(held):
        h, code = (np.concatenate(c) for c in zip(*held.pop(group)))
        order = np.lexsort((code, h))
        h, code = h[order], code[order]
        new = np.append(True, (h[1:] != h[:-1]) | (code[1:] != code[:-1]))
        h, code = h[new], code[new]
        begins = np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)
        sizes = np.diff(np.append(begins, len(h)))
        # Runs under one hash by chance would be compared as one, which loses nothing.
        runs = {xxhash.xxh64_intdigest(code[x : x + k].tobytes()): (x, k) for x, k in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist())}
        if runs:
            names = np.repeat(np.array(list(runs), np.uint64).view(np.int64), [k for _, k in runs.values()])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([code[x : x + k] for x, k in runs.values()]))], names=["run", "code"])


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    up, down = LEAST
    return down * np.minimum(a, b) >= up * np.maximum(a, b)


def _can_link(n: np.ndarray, sign: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets x and y fit in size and their signatures don't rule a link out."""
    up, down = LEAST
    ok = _fits(n[x], n[y])
    at = np.flatnonzero(ok)
    for i in range(0, len(at), 20_000):
        part = at[i : i + 20_000]
        apart = np.bitwise_count(sign[x[part]] ^ sign[y[part]]).sum(axis=1, dtype=np.int64)
        ok[part] = (up + down) * apart <= (down - up) * (n[x[part]] + n[y[part]])
    return ok


def _forest(n: np.ndarray, sign: np.ndarray, label: np.ndarray, pivots: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in a run whose labels differ and that can link: a forest of them, or every one."""
    k = len(n)
    label = label.copy()
    by_size = np.argsort(n, kind="stable")
    first = [] if every else by_size[np.linspace(0, k - 1, min(pivots, k)).astype(np.int64)].tolist()
    for turn, i in enumerate([*first, *range(k)]):
        y = np.arange(k) if turn < len(first) else np.arange(i + 1, k)
        y = y[label[y] != label[i]]
        y = y[_can_link(n, sign, np.full(len(y), i), y)]
        if len(y) and not every:
            found, one = np.unique(label[y], return_index=True)
            y = y[one]
            label[np.isin(label, found)] = label[i]
        if len(y):
            yield np.full(len(y), i), y


def _meet_rows(batches: Iterator[pa.RecordBatch], few: int, pivots: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs a, b of a run that can link and are not in one component yet; ``run`` is null where all of them are there."""
    begin()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    run, code, n, root = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1, 2, 4))
    sign = np.concatenate([np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, -1) for b in held])
    held.clear()
    order = np.lexsort((code, run))
    run, code, n, sign, root = run[order], code[order], n[order].astype(np.int64), sign[order], root[order]
    begins = np.append(0, np.flatnonzero(run[1:] != run[:-1]) + 1)
    sizes = np.diff(np.append(begins, len(run)))
    place = np.arange(len(run)) - np.repeat(begins, sizes)
    size = np.repeat(sizes, sizes)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for step in range(1, int(sizes[sizes <= few].max(initial=1))):
        x = np.flatnonzero((size <= few) & (place + step < size))
        x = x[root[x] != root[x + step]]
        x = x[_can_link(n, sign, x, x + step)]
        found.append((code[x], code[x + step]))
    a, b = (np.concatenate(c) for c in zip(*found))
    if len(a):
        pairs = np.unique(np.array([np.minimum(a, b), np.maximum(a, b)]).T.copy().view("i8,i8").ravel())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs["f0"].copy()), pa.array(pairs["f1"].copy())], names=["run", "a", "b"])
    for x, k in zip(begins[sizes > few].tolist(), sizes[sizes > few].tolist()):
        here = slice(x, x + k)
        for i, j in _forest(n[here], sign[here], root[here], pivots, every):
            a, b = code[here][i], code[here][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), run[x])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["run", "a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        ok = pa.array([linked(shingle_set(x.as_py()), shingle_set(y.as_py())) for x, y in zip(one, two)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])


def _close_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures don't differ in more cells than linked sets of their sizes can have shingles apart."""
    begin()
    up, down = LEAST
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
            apart = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            ok = pa.array((up + down) * apart <= (down - up) * both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: the pairs whose whole sets have the least similarity."""
    pairs = materialise(pairs.select("a", "b").distinct(), "near-candidates")
    sides = pairs.join(sets.select(F.col("code").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa")), "a")
    sides = sides.join(sets.select(F.col("code").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb")), "b")
    pairs = materialise(sides.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_close_rows, "a long, b long"), "near-pairs")
    held = pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct()
    wanted = materialise(sets.select("code", "text_key").join(held, "code", "left_semi"), "near-wanted")
    # Texts are smaller than their sets, which are made again for each pair.
    texts = docs.select(text_bytes().alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = materialise(texts.join(few(wanted), "text_key").select("code", "text").dropDuplicates(["code"]), "near-texts")
    both = pairs.join(texts.select(F.col("code").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("code").alias("b"), F.col("text").alias("two")), "b")
    return materialise(both.select("a", "b", "one", "two").mapInArrow(_verified, "u long, v long"), "near-links")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """a, b: sets of one fingerprint, each with the first; first sets of fingerprints that the index links."""
    prints = materialise(sets.groupBy("print").agg(F.min("code").alias("first"), F.count("*").alias("members")), "near-prints")
    near = near_links(prints.select(F.col("print").alias("code")), NEAR_BITS)
    near = near.join(prints.select(F.col("print").alias("u"), F.col("first").alias("x")), "u").join(prints.select(F.col("print").alias("v"), F.col("first").alias("y")), "v")
    same = join_groups(sets.select("code", "print"), prints.filter("members > 1"), "print", "members").filter("code <> first")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same.select("first", "code"))


def _met(runs: DataFrame, sets: DataFrame, roots: DataFrame, every: bool) -> DataFrame:
    """run, a, b: what the runs (run, code) give, as ``_meet_rows`` says."""
    crowded, pivots = CROWDED, PIVOTS
    sides = runs.join(sets.select("code", "n", "sign"), "code").join(roots, "code", "left")
    sides = sides.select("run", "code", "n", "sign", F.coalesce("root", "code").alias("root")).repartition("run")
    return materialise(sides.mapInArrow(lambda it: _meet_rows(it, crowded, pivots, every), "run long, a long, b long"), "near-met")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), code (of the set), root (the component's smallest code): one row for every row of ``docs``."""
    spark = docs.sparkSession
    common, places = common_shingles(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("text_key"), text_bytes().alias("text"))
    coded = materialise(texts.mapInArrow(lambda it: _set_rows(it, common, places), "doc_id long, text_key long, code long, n int, keys binary, sign binary, print long"), "near-coded")
    # Of the texts of one set, n and sign are the same; the fingerprint, which counts repeats, is that of one of them.
    sets = materialise(coded.groupBy("code").agg(F.min("text_key").alias("text_key"), F.any_value("n").alias("n"), F.any_value("sign").alias("sign"), F.min("print").alias("print")), "near-sets")
    links = _links(simhash_pairs(sets), sets, docs)
    roots = materialise(components(links), "near-roots")
    groups = partitions_for(spark, (coded.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8, KEYS_PER_TASK)
    keys = coded.select("code", "keys").mapInArrow(lambda it: _key_rows(it, groups), "group int, keys binary")
    runs = materialise(keys.repartition(groups, "group").mapInArrow(_run_rows, "run long, code long").distinct(), "near-runs")
    met = _met(runs, sets, roots, False)
    found = _links(met, sets, docs)
    links = links.union(found)
    roots = materialise(components(links), "near-roots")
    failed = met.filter("run IS NOT NULL").join(found.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
    failed = materialise(failed.select("run").distinct(), "near-failed")
    if not failed.isEmpty():
        more = _links(_met(runs.join(failed, "run", "left_semi"), sets, roots, True), sets, docs)
        if not more.isEmpty():
            roots = materialise(components(links.union(more)), "near-roots")
    return coded.select("doc_id", "text_key", "code").join(roots, "code", "left").select("doc_id", "text_key", "code", F.coalesce("root", "code").alias("root"))


def keep_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component one row with its smallest id, there the smallest text hash."""
    found = materialise(near_components(docs), "near-components")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("best")
    groups = materialise(found.groupBy("root").agg(best, F.count("*").alias("n")).filter("n > 1"), "near-groups")
    members = materialise(join_groups(found, groups, "root", "n"), "near-members")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    pair = row_key(F.col("doc_id"), F.col("text_key"))
    gone = materialise(members.filter(~stays).select(pair).distinct(), "near-gone")
    again = materialise(members.filter(stays).groupBy(pair).count().filter("count > 1").select("__tg_key"), "near-again")
    return without_rows(docs, gone, again)
