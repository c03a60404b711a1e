"""Language-model scores by subword lattice likelihood (operator 4).

The model is a unigram model over the pieces of an existing vocabulary file and an end piece. The
probability of a text is the sum over all its segmentations into pieces; pieces don't cross the start
of a word, so it is a product over words of lattice sums, each a forward recursion in log space.
The vocabulary's existing scores are the model's own share of each weight: log probabilities as they
are, merge ranks (whole numbers) by Zipf's law. Expected counts over the segmentations of all training
words, a forward-backward pass each round, give the rest, so that a piece keeps ``EXISTING`` of its
existing probability however much text there is.

Texts are lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+``, then one end. Rows whose
crc32(doc_id as text) mod 7 is 2 are held out; a null id counts as an empty text there, a null text
as an empty text. Bytes that aren't UTF-8 are read as U+FFFD in the lattice. A very long text is a block
of its own, and a very long word a lattice of its own. Repeated rows count and score each; an empty
table gives an empty result; extra columns are ignored.

Tasks turn documents into blocks of word numbers with a vocabulary for each block. Words are summed,
valued and joined back over the cluster block by block, so neither documents nor the word table meet
in one place; only the piece weights, as many as the vocabulary file has, pass the driver.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import materialise, partitions_for, text_bytes, worker_table

HOLD_OUT, FOLDS = 2, 7
BLOCK_BYTES = 12_000_000
EM_ROUNDS = 2
#: The share of the existing scores in the weight of every piece.
EXISTING = 0.1
#: Rows of the word tables that a task is dealt.
WORDS_PER_TASK = 1_000_000
#: Words that a numpy lattice holds side by side.
ROWS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"
_FILTER_BITS = 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HOLD_OUT


class Pieces:
    """The pieces of a SentencePiece file, and their lookup by rolling hash."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_of: dict[int, int] = {}
        names, numbers, scores = [], [], []
        for i in range(size):
            if model.is_byte(i):
                self.byte_of[int(model.id_to_piece(i)[3:-1], 16)] = len(numbers)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            else:
                names.append((model.id_to_piece(i), len(numbers)))
            numbers.append(i)
            scores.append(model.get_score(i))
        #: The end piece comes last.
        self.end, self.size = len(numbers), len(numbers) + 1
        self.longest = max(len(s) for s, _ in names)
        #: Log probabilities by the existing scores.
        self.prior = existing_weights(np.array(scores))
        hashes = np.array([_hash(s) for s, _ in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], np.array([p for _, p in names])[order]
        self.some = np.zeros(1 << _FILTER_BITS, bool)
        self.some[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece number of each hash, or -1."""
        out = np.full(hashes.shape, -1, np.int64)
        maybe = np.nonzero(self.some[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == wanted, self.place[at], -1)
        return out


def existing_weights(scores: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces, and of the end piece, which is as likely as the likeliest of them.

    Whole numbers are the ranks of a merge vocabulary, 0, -1, ...: rank r weighs 1 / (r + 2).
    """
    logs = -np.log(2.0 - scores) if (scores == np.round(scores)).all() else scores
    logs = np.append(logs, logs.max())
    top = logs.max()
    return logs - top - np.log(np.exp(logs - top).sum())


def _finish(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _BASE


def _hash(s: str) -> np.uint64:
    h = 0
    for c in s:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
    return _finish(np.array([h], np.uint64))[0]


class Lattice:
    """All segmentations of words of one length; a row a word."""

    def __init__(self, words: list[str], pieces: Pieces, weights: np.ndarray) -> None:
        self.pieces, rows, n = pieces, len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(rows, n).astype(np.uint64)
        rolling = np.zeros((rows, n + 1), np.uint64)
        for k in range(n):
            rolling[:, k + 1] = rolling[:, k] * _BASE + codes[:, k] + np.uint64(1)
        self.n, self.rows = n, rows
        #: By length: piece numbers and log weights of the arcs from each place.
        self.piece: list[np.ndarray] = []
        self.arc: list[np.ndarray] = []
        power = 1
        padded = np.append(weights, -np.inf)
        for length in range(1, min(pieces.longest, n) + 1):
            power = power * int(_BASE) % (1 << 64)
            number = pieces.find(_finish(rolling[:, length:] - rolling[:, :-length] * np.uint64(power)))
            self.piece.append(number)
            self.arc.append(padded[number])
        # A character that is no piece is spelled in bytes.
        self.spelled = np.nonzero(self.piece[0] < 0)
        self.spelling: dict[int, list[int]] = {}
        if len(self.spelled[0]):
            odd = codes[self.spelled]
            for c in np.unique(odd).tolist():
                self.spelling[c] = [pieces.byte_of[b] for b in chr(c).encode("utf-8", "replace")]
            self.odd = odd
            cost = {c: weights[p].sum() for c, p in self.spelling.items()}
            self.arc[0][self.spelled] = [cost[c] for c in odd.tolist()]

    def forward(self) -> np.ndarray:
        """Log sums over the segmentations of each prefix."""
        out = np.full((self.rows, self.n + 1), -np.inf)
        out[:, 0] = 0
        for j in range(1, self.n + 1):
            terms = np.stack([out[:, j - k] + self.arc[k - 1][:, j - k] for k in range(1, min(len(self.arc), j) + 1)])
            top = terms.max(axis=0)
            out[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return out

    def backward(self) -> np.ndarray:
        out = np.full((self.rows, self.n + 1), -np.inf)
        out[:, self.n] = 0
        for i in range(self.n - 1, -1, -1):
            terms = np.stack([out[:, i + k] + self.arc[k - 1][:, i] for k in range(1, min(len(self.arc), self.n - i) + 1)])
            top = terms.max(axis=0)
            out[:, i] = top + np.log(np.exp(terms - top).sum(axis=0))
        return out

    def expected(self, times: np.ndarray, total: np.ndarray) -> None:
        """Add to ``total`` the expected count of each piece over the segmentations."""
        a, b = self.forward(), self.backward()
        for k, (number, arc) in enumerate(zip(self.piece, self.arc), 1):
            share = np.exp(a[:, : self.n - k + 1] + arc + b[:, k:] - a[:, -1:]) * times[:, None]
            known = number >= 0
            total += np.bincount(number[known], weights=share[known], minlength=len(total))
            if k == 1 and self.spelling:
                for c, x in zip(self.odd.tolist(), share[self.spelled].tolist()):
                    for p in self.spelling[c]:
                        total[p] += x


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, not too many at a time."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        most = max(1, ROWS * 16 // (int(lengths[group[0]]) + 1))
        for a in range(0, len(group), most):
            yield group[a : a + most]


def word_scores(words: list[str], pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """The natural log of each word's sum over its segmentations."""
    out = np.zeros(len(words))
    marked = [_START + w for w in words]
    for at in _by_length(marked) if words else ():
        out[at] = Lattice([marked[k] for k in at], pieces, weights).forward()[:, -1]
    return out


_loaded: dict[str, Pieces] = worker_table()


def load(path: str) -> Pieces:
    """One table of pieces a process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class _Numbers(dict):
    """A new word gets the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Block:
    """Documents as word numbers and how often each comes; numbers are the block's own."""

    def __init__(self) -> None:
        self.vocabulary = _Numbers()
        self.ids, self.times = array("I"), array("I")
        self.docs: list[tuple[int | None, int, int, bool]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.lower().split()
        found = Counter(words)
        self.ids.extend(map(self.vocabulary.__getitem__, found))
        self.times.extend(found.values())
        self.docs.append((doc_id, len(words), len(found), held_out(doc_id)))
        self.bytes += len(text)

    def row(self, number: int) -> pa.RecordBatch:
        ids, times = np.array(self.ids, np.uint32), np.array(self.times, np.uint32)
        widths = np.array([d[2] for d in self.docs])
        train = np.repeat([not d[3] for d in self.docs], widths).astype(bool)
        counts = np.bincount(ids[train], weights=times[train], minlength=len(self.vocabulary)).astype(np.int64)
        words = pa.StructArray.from_arrays([pa.array(list(self.vocabulary), pa.binary()), pa.array(counts)], names=["word", "n"])
        columns = {
            "block": pa.array([number], pa.int64()),
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            "ids": pa.array([zlib.compress(ids.tobytes(), 1)], pa.binary()),
            "times": pa.array([zlib.compress(times.tobytes(), 1)], pa.binary()),
            "docs": pa.array([[{"doc_id": d[0], "n": d[1], "width": d[2]} for d in self.docs]], pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("width", pa.int64())]))),
            "train_docs": pa.array([sum(not d[3] for d in self.docs)], pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


BLOCKS = "block long, words array<struct<word:binary,n:long>>, ids binary, times binary, docs array<struct<doc_id:long,n:long,width:long>>, train_docs long"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            block.add(doc_id, text.as_py())
            if block.bytes >= BLOCK_BYTES:
                yield block.row(number)
                number, block = number + 1, _Block()
    if block.docs:
        yield block.row(number)


def _expected_rows(batches: Iterator[pa.RecordBatch], path: str, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    total = np.zeros(pieces.size)
    for batch in batches:
        times = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        marked = [_START + w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
        for at in _by_length(marked) if marked else ():
            Lattice([marked[k] for k in at], pieces, weights).expected(times[at], total)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "expected"])


def _value_rows(batches: Iterator[pa.RecordBatch], path: str, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    pieces = load(path)
    for batch in batches:
        values = word_scores([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], pieces, weights)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["word", "c", "value"])


def train(words: DataFrame, train_docs: int, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log weights of the pieces, the end piece last; ``words`` has word, c (in training texts)."""
    pieces = load(path)
    weights = pieces.prior
    seen = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        parts = seen.mapInArrow(lambda it, w=weights: _expected_rows(it, path, w), "piece long, expected double")
        total = np.zeros(pieces.size)
        for row in parts.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():  # as many rows as the file has pieces, at most
            total[row["piece"]] += row["expected"]
        total[pieces.end] += train_docs
        weights = mixed(pieces.prior, total)
    return weights


def mixed(prior: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log weights: EXISTING of the existing probabilities, the rest by the expected counts."""
    if not total.sum():
        return prior
    return np.log(EXISTING * np.exp(prior) + (1 - EXISTING) * total / total.sum())


def _score_block(block: pa.Table, values: pa.Table, facts: dict) -> pa.Table:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))
    if not block.num_rows:
        return schema.empty_table()
    size = values.num_rows
    at = values.column("at").to_numpy()
    c, value = np.zeros(size), np.zeros(size)
    c[at], value[at] = values.column("c").to_numpy(), values.column("value").to_numpy()
    docs = block.column("docs")[0].as_py()
    ids = np.frombuffer(zlib.decompress(block.column("ids")[0].as_py()), np.uint32).astype(np.int64)
    times = np.frombuffer(zlib.decompress(block.column("times")[0].as_py()), np.uint32).astype(float)
    owner = np.repeat(np.arange(len(docs)), [d["width"] for d in docs])
    all_tokens = facts["tokens"] + facts["types"] + 1

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=len(docs)) if len(owner) else np.zeros(len(docs))

    base = per_doc(times * np.log10((c[ids] + 1) / all_tokens)) + math.log10((facts["ends"] + 1) / all_tokens)
    known = per_doc(times * (c[ids] > 0)) + (facts["ends"] > 0)
    score = (per_doc(times * value[ids]) + facts["end_weight"]) / math.log(10)
    columns = [[d["doc_id"] for d in docs], [held_out(d["doc_id"]) for d in docs], [d["n"] + 1 for d in docs], known.astype(np.int64), [facts["tokens"]] * len(docs), base, score]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], schema=schema)


def lattice_scores(docs: DataFrame, path: str, rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    held = materialise(texts.mapInArrow(_block_rows, BLOCKS), "lattice-blocks")
    each = held.select("block", F.posexplode("words").alias("at", "w")).select("block", "at", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    sums = held.agg(F.sum("train_docs").alias("ends"), F.sum(F.size("words")).alias("rows")).first()
    ends = sums["ends"] or 0
    usual = partitions_for(docs.sparkSession, 0, WORDS_PER_TASK)
    tasks = partitions_for(docs.sparkSession, sums["rows"] or 0, WORDS_PER_TASK)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        """By key, to more tasks than a shuffle has where that many rows need it."""
        return df.repartition(tasks, key) if tasks > usual else df

    words = materialise(dealt(each, "word").groupBy("word").agg(F.sum("n").alias("c")), "lattice-words")
    of_words = words.agg(F.sum("c").alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("types")).first()
    weights = train(words, ends, path, rounds)
    facts = {"tokens": (of_words["tokens"] or 0) + ends, "types": of_words["types"] + (ends > 0), "ends": ends, "end_weight": float(weights[-1])}
    valued = words.mapInArrow(lambda it: _value_rows(it, path, weights), "word binary, c long, value double")
    back = dealt(each.drop("n"), "word").join(dealt(valued, "word"), "word").select(F.col("block").alias("of"), "at", "c", "value")
    return dealt(held.select("block", "ids", "times", "docs"), "block").groupBy("block").cogroup(dealt(back, "of").groupBy("of")).applyInArrow(
        lambda block, values: _score_block(block, values, facts),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
