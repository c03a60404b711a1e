"""Byte-level BPE encoding and decoding with a segment tree over pair ranks (operator 5).

The leaves of a tree hold the merge rank of each adjacent pair; the root is the lowest rank, leftmost
on ties. A merge writes three leaves and their paths to the root, and the loop ends when no pair can
merge. Short pieces run side by side in numpy, one tree a row; a long piece has a tree of its own.

Texts split at single spaces into chunks whose ids don't depend on their neighbours; the ids of
chunks are kept in a bounded table of the worker process. A text where white space meets white space
at such a place is split by the full pattern instead. Null text counts as empty and has no ids;
repeated rows are encoded alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import begin, blocks, worker_table

#: Splits a text before the merges; it belongs to the vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces of up to so many bytes run side by side.
SHORT = 64
#: Bytes of strings and ids that a table keeps, and those of an entry beside its characters.
CACHE_BYTES = 100_000_000
ENTRY_BYTES = 200
BLOCK_CHARS = 2_000_000
_NONE = np.int64(1) << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()}
        size = max([*names, *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for i, s in names.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.split = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or -1."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


def merge_one(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    """The merges of one piece; its tree is a list with the root at 1."""
    n = len(ids)
    if n < 2:
        return ids
    rank_of, merged = vocabulary.rank_of, vocabulary.merged
    width = 1 << (n - 1).bit_length()
    none = len(rank_of) * width + width
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = rank_of.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids, alive = list(ids), [True] * n
    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        k = after[j]
        ids[i], alive[j], after[i] = int(merged[rank]), False, k
        put(j, none)
        fresh = None
        if k < n:
            before[k] = i
            fresh = rank_of.get(ids[i] << 32 | ids[k])
        put(i, none if fresh is None else fresh * width + i)
        p = before[i]
        if p >= 0:
            fresh = rank_of.get(ids[p] << 32 | ids[i])
            put(p, none if fresh is None else fresh * width + p)
    return [t for t, a in zip(ids, alive) if a]


def merge_rows(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> list[bytes]:
    """The merges of pieces of up to ``width`` bytes (a power of two), a tree for each row of a matrix."""
    rows, n = len(pieces), np.array([len(p) for p in pieces])
    token = np.zeros((rows, width + 1), np.int64)
    inside = np.arange(width) < n[:, None]
    token[:, :width][inside] = vocabulary.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, width + 2), (rows, 1))
    before = np.tile(np.arange(-1, width), (rows, 1))
    alive = inside.copy()
    tree = np.full((rows, 2 * width), _NONE)
    r, i = np.nonzero(inside[:, 1:])
    rank = vocabulary.pair_ranks(token[r, i], token[r, i + 1])
    tree[r, width + i] = np.where(rank >= 0, rank * width + i, _NONE)
    half = width >> 1
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half >>= 1
    live = np.arange(rows)
    while True:
        live = live[tree[live, 1] < _NONE]
        if not len(live):
            break
        rank, i = np.divmod(tree[live, 1], width)
        j = after[live, i]
        k = after[live, j]
        token[live, i] = vocabulary.merged[rank]
        alive[live, j] = False
        after[live, i] = k
        some = k < n[live]
        before[live[some], k[some]] = i[some]
        p = before[live, i]
        back = p >= 0
        fresh = vocabulary.pair_ranks(np.concatenate((token[live, i], token[live[back], p[back]])), np.concatenate((token[live, k], token[live[back], i[back]])))
        mine, theirs = fresh[: len(live)], fresh[len(live) :]
        tree[live, width + i] = np.where((mine >= 0) & some, mine * width + i, _NONE)
        tree[live, width + j] = _NONE
        tree[live[back], width + p[back]] = np.where(theirs >= 0, theirs * width + p[back], _NONE)
        who = np.concatenate((live, live, live[back]))
        at = np.concatenate((i, j, p[back])) + width
        while at[0] > 1:
            at >>= 1
            tree[who, at] = np.minimum(tree[who, 2 * at], tree[who, 2 * at + 1])
    flat = token[:, :width][alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merge_many(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each piece (not empty), little-endian 32-bit."""
    out: list[bytes] = [b""] * len(pieces)
    groups: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        width = max(2, 1 << (len(piece) - 1).bit_length())
        groups.setdefault(min(width, 2 * SHORT), []).append(k)
    for width, members in groups.items():
        if width > SHORT:
            for k in members:
                out[k] = np.array(merge_one(vocabulary.of_byte[np.frombuffer(pieces[k], np.uint8)].tolist(), vocabulary), "<u4").tobytes()
            continue
        for a in range(0, len(members), 8192):
            some = members[a : a + 8192]
            for k, ids in zip(some, merge_rows([pieces[k] for k in some], width, vocabulary)):
                out[k] = ids
    return out


class Table(dict):
    """Ids by string, in two generations: when the young one is full it becomes the old one, from which what is asked for again comes back.

    What is in neither is encoded in bulk. A generation is full at half of ``most`` bytes, by an estimate
    of its strings and ids, so long strings don't fill the memory; those of one call are held in any case.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes | None]], most: int = CACHE_BYTES) -> None:
        super().__init__()
        self.encode, self.most = encode, most
        self.old: dict[str, bytes | None] = {}
        self.bytes = 0

    def fill(self, keys: set[str]) -> None:
        if self.bytes > self.most // 2:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        missing = keys.difference(self)
        again = missing.intersection(self.old)
        if again:
            self.update(zip(again, map(self.old.__getitem__, again)))
            missing -= again
        fresh = list(missing)
        if fresh:
            self.update(zip(fresh, self.encode(fresh)))
        # A string and its ids have up to 8 bytes a character, beside the two objects and their place.
        self.bytes += ENTRY_BYTES * (len(again) + len(fresh)) + 8 * (sum(map(len, again)) + sum(map(len, fresh)))


class Encoder:
    """Texts to ids, little-endian 32-bit, and back."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pieces = Table(lambda keys: merge_many([k.encode() for k in keys], self.vocabulary))
        self.chunks = Table(self._chunk_ids)

    def _parts(self, text: str) -> list[str]:
        """The pieces of a text; strings of special tokens stand by themselves."""
        split = self.vocabulary.split
        if split is None or not split.search(text):
            return PATTERN.findall(text)
        out, end = [], 0
        for m in split.finditer(text):
            out += [*PATTERN.findall(text[end : m.start()]), m.group()]
            end = m.end()
        return out + PATTERN.findall(text[end:])

    def _whole(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        special = self.vocabulary.special
        self.pieces.fill({p for ps in parts for p in ps if p not in special})
        ids = {s: int(i).to_bytes(4, "little") for s, i in special.items()}
        return [b"".join([ids[p] if p in ids else self.pieces[p] for p in ps]) for ps in parts]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes | None]:
        """None for a chunk that can't be split from its neighbours: white space at its inner edges."""
        out = self._whole(chunks)
        for k, chunk in enumerate(chunks):
            inner = chunk.removeprefix(" ")
            if (not inner and chunk) or (inner and (inner[0].isspace() or inner[-1].isspace())):
                out[k] = None
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else None for t in texts]
        self.chunks.fill({c for cs in split if cs is not None for c in cs})
        get = self.chunks.__getitem__
        out: list[bytes] = [b""] * len(texts)
        for k, chunks in enumerate(split):
            ids = [None] if chunks is None else list(map(get, chunks))
            out[k] = self._whole([texts[k]])[0] if None in ids else b"".join(ids)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = worker_table()


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    begin(_encoders)
    codec = encoder(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks([len(t) for t in texts], BLOCK_CHARS):
            ids = codec.encode(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(codec.decode(i).encode()).hexdigest() for i in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; nothing is shuffled."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda it: _rows(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _id_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = encoder(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks([len(t) for t in texts], BLOCK_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(codec.encode(texts[a:b]), pa.binary())], names=["doc_id", "ids"])


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian 32-bit) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda it: _id_rows(it, path), "doc_id long, ids binary")
