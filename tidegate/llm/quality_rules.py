"""Quality rules by repetition coverage (operator 6).

Words are ``[^\\x20\\x09-\\x0D]+``; null text counts as empty. Windows of several lengths get a
rolling hash over exact word numbers in numpy; equal hashes within a text are compared word by word
before they count. A text is rejected by the base rule (fewer than ``min_words`` words, or over a
fifth of the words inside 5-word windows that occur twice or more), or if the characters inside
repeated windows or lines, first occurrences left out, exceed the share for their length. Repeated
rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import begin, blocks, text_bytes

MIN_WORDS = 10
BASE_WINDOW = 5
BASE_PERCENT = 20
#: Window length in words -> largest share of word characters in repeated windows.
WINDOW_SHARE = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
#: Largest share of word characters in repeated lines.
LINE_SHARE = 0.20
SYMBOLS = b"#*$%&|<>"
BLOCK_BYTES = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CONTINUATION = bytes(range(0x80, 0xC0))
_LINE_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def _scatter(numbers: np.ndarray) -> np.ndarray:
    """64-bit mix of small numbers."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _repeats(hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that occur twice or more in their text: all of them, and those after the first."""
    keys = hashes ^ _scatter(owner)
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return starts[:0], starts[:0]
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    some = np.flatnonzero(twice[place] == keys)
    keys, starts, owner = keys[some], starts[some], owner[some]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    at, before = starts[order[1:][same]], starts[order[:-1][same]]
    equal = owner[order[1:][same]] == owner[order[:-1][same]]
    for k in range(length):
        equal &= words[at + k] == words[before + k]
    if equal.all():
        return np.union1d(at, before), np.unique(at)
    # Different windows under one hash: compare the windows themselves.
    seen: dict[tuple, int] = {}
    every, later = set(), set()
    for start, who in sorted(zip(np.union1d(at, before).tolist(), owner[np.searchsorted(starts, np.union1d(at, before))].tolist())):
        key = (who, *words[start : start + length].tolist())
        if key in seen:
            every |= {seen[key], start}
            later.add(start)
        else:
            seen[key] = start
    return np.array(sorted(every), np.int64), np.array(sorted(later), np.int64)


def _covered(total: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window of that length from one of the starts."""
    edge = np.zeros(total + length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:total] > 0


def measure(texts: list[bytes], windows: dict[int, float] | None = None, line_share: float = LINE_SHARE, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """The columns of the result, for texts in UTF-8 that make one block."""
    windows = WINDOW_SHARE if windows is None else windows
    split = [t.split() for t in texts]
    n = len(texts)
    n_words = np.array([len(w) for w in split], np.int64)
    total = int(n_words.sum())
    flat = [w for ws in split for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.int64, total)
    width = np.array([len(w.translate(None, _CONTINUATION)) for w in number] or [0], np.int64)
    chars = width[words] if total else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), n_words)
    ends = np.cumsum(n_words)
    last = ends[owner] if total else np.zeros(0, np.int64)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n).astype(np.int64) if total else np.zeros(n, np.int64)

    word_chars = per_text(chars)
    repeat_words = np.zeros(n, np.int64)
    rejected = np.zeros(n, bool)
    mixed = _scatter(words)
    rolling = mixed.copy()
    for length in range(2, max([BASE_WINDOW, *windows]) + 1):
        if len(rolling) < 2:
            break
        rolling = rolling[:-1] * _MULTIPLIER + mixed[length - 1 :]
        if length != BASE_WINDOW and length not in windows:
            continue
        starts = np.flatnonzero(np.arange(len(rolling)) + length <= last[: len(rolling)])
        every, later = _repeats(rolling[starts], starts, owner[starts], words, length)
        if length == BASE_WINDOW and len(every):
            repeat_words = per_text(_covered(total, every, length))
        if length in windows and len(later):
            rejected |= per_text(chars * _covered(total, later, length)) > windows[length] * word_chars
    dup_lines = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(set(lines)) == len(lines):
            continue
        seen: set[bytes] = set()
        repeated = 0
        for line in lines:
            if line in seen:
                if _LINE_WORD.search(line):
                    dup_lines[i] += 1
                    repeated += sum(len(w.translate(None, _CONTINUATION)) for w in line.split())
            else:
                seen.add(line)
        rejected[i] |= repeated > line_share * word_chars[i]
    base_failed = (n_words < min_words) | (100 * repeat_words > BASE_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": ~(base_failed | rejected),
    }


_COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
            found = measure(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[c], t) for c, t in _COLUMNS.items())], names=["doc_id", *_COLUMNS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, of every row; nothing is shuffled."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_rows, schema)


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
                yield batch.slice(a, b - a).filter(pa.array(measure(texts[a:b])["kept"], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
