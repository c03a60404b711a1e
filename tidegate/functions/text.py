"""Character-level column functions. Native where Spark can say it, else Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions import fixed, patterns
from tidegate.functions.udf import vectorised


def let(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, wherever and however often the body uses it."""
    return F.get(F.transform(F.array(values), body), F.lit(0))


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a pattern of the catalogue matches; most texts fail the looser test first."""
    return text.rlike(patterns.loose(pattern, ignore_case)) & text.rlike(patterns.java(pattern, ignore_case))


def count_class(text: Column, members: str) -> Column:
    """How many characters of a class a text has."""
    return F.regexp_count(text, F.lit(f"[{members}]"))


def first_place(text: Column, pattern: str) -> Column:
    """The 0-based code point where a pattern first matches; null if nowhere."""
    return F.when(text.rlike(pattern), F.length(F.element_at(F.split(text, pattern, 2), 1)))


def longest_run(text: Column, members: str) -> Column:
    """The longest run of characters of a class."""
    runs = F.regexp_extract_all(text, F.lit(f"[{members}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def odd_words(text: Column) -> Column:
    """The letter runs that aren't plain Latin throughout: all that can be of mixed scripts."""
    return F.regexp_extract_all(text, F.lit(patterns.ODD_WORD), F.lit(0))


def homoglyphs(words: Column) -> Column:
    """Of some words, those that mix Latin with Cyrillic or Greek letters."""
    return F.filter(words, lambda w: w.rlike(patterns.NOT_LATIN) & w.rlike(patterns.LATIN) & (w.rlike(patterns.CYRILLIC) | w.rlike(patterns.GREEK)))


def other_mixes(words: Column) -> Column:
    """Of some words, those of two scripts or more that are no homoglyphs; all other scripts are one."""

    def mixed(w: Column) -> Column:
        scripts = sum((w.rlike(p).cast("int") for p in (patterns.LATIN, patterns.CYRILLIC, patterns.GREEK, patterns.OTHER_LETTER)), F.lit(0))
        return w.rlike(patterns.NOT_LATIN) & (scripts > 1) & ~(w.rlike(patterns.LATIN) & (w.rlike(patterns.CYRILLIC) | w.rlike(patterns.GREEK)))

    return F.filter(words, mixed)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{fixed.SPACE}]")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, patterns.REMOVED, "")


@vectorised("string")
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def sanitise(text: Column) -> Column:
    """Without invisible characters, in canonical form."""
    return nfc(strip_invisible(text))


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def hot_starts(text: str) -> list[int]:
    """Starts of the full windows that are dense in letters and digits and of high entropy."""
    n, width, step = len(text), fixed.ENTROPY_WINDOW, fixed.ENTROPY_STEP
    if n < width:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    dense = np.concatenate(([0], np.cumsum(_alnum()[codes])))
    starts = np.arange(0, n - width + 1, step)
    starts = starts[(dense[starts + width] - dense[starts]) / width >= fixed.ENTROPY_ALNUM]
    if not len(starts):
        return []
    windows = np.sort(codes[starts[:, None] + np.arange(width)], axis=1)
    hot = []
    for start, window in zip(starts.tolist(), windows):
        edges = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1], [True])))
        share = np.diff(edges) / width
        if -(share * np.log2(share)).sum() >= fixed.ENTROPY_BITS:
            hot.append(start)
    return hot


@vectorised("array<int>")
def hot_windows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hot_starts(t or ""))


def entropy_bits(data: bytes) -> float:
    """Bits a byte."""
    if not data:
        return 0.0
    share = np.bincount(np.frombuffer(data, np.uint8))
    share = share[share > 0] / len(data)
    return float(-(share * np.log2(share)).sum())


def word_windows(n_tokens: Column, width: int = fixed.GUARD_WINDOW, stride: int = fixed.GUARD_STRIDE) -> Column:
    """Starts of windows over a sequence of tokens; the last is the first that reaches the end."""
    more = F.ceil(F.greatest(n_tokens - width, F.lit(0)) / stride).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda k: k * stride)
