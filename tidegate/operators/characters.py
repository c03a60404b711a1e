"""Gate 1: character and encoding findings of a text.

Findings are an array of ``FINDING`` structs in a fixed order. What Spark can express is native;
decoded blobs and canonical form go through Arrow-batched UDFs, which get a null for every text that
a native test rules out.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions import fixed, patterns
from tidegate.functions.text import count_class, entropy_bits, first_place, homoglyphs, hot_windows, let, longest_run, odd_words, other_mixes
from tidegate.functions.udf import vectorised
from tidegate.functions.verdicts import bucket

FINDING = "struct<code:string,severity:string,occurrences:string,detail:string,verbatim:string,position:int>"


def _finding(when: Column, code: str, severity: Column | str, n: Column, detail: Column | str, position: Column | None = None, verbatim: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(
        when,
        F.struct(
            F.lit(code).alias("code"),
            text(severity).alias("severity"),
            bucket(n).alias("occurrences"),
            text(detail).alias("detail"),
            (F.lit(None).cast("string") if verbatim is None else verbatim).alias("verbatim"),
            (F.lit(None) if position is None else position).cast("int").alias("position"),
        ),
    )


def snippet(text: Column, start: Column) -> Column:
    """Up to 320 characters from a place on, and a mark where there is more."""
    return F.concat(F.substring(text, (start + 1).cast("int"), F.lit(fixed.SNIPPET)), F.when(F.length(text) - start > fixed.SNIPPET, "…").otherwise(""))


def zero_width_channel(n: Column, run: Column, length: Column) -> Column:
    """Whether zero-width characters are a channel rather than stray joiners."""
    ratio = n / F.greatest(F.lit(1), length - n)
    return (run >= fixed.ZERO_WIDTH_RUN) | (n >= fixed.ZERO_WIDTH_TOTAL) | ((n >= fixed.ZERO_WIDTH_RATIO_MIN) & (ratio >= fixed.ZERO_WIDTH_RATIO))


def _found(findings: list[Column]) -> Column:
    return F.filter(F.array(*findings), lambda f: f.isNotNull())


def invisible_findings(text: Column) -> Column:
    """Findings of characters that don't show; the counts are worked out once."""
    classes = {"bidi": fixed.BIDI, "tag": fixed.TAG, "zero": fixed.ZERO_WIDTH, "mark": fixed.BIDI_MARK, "variation": fixed.VARIATION}

    def counts(thin: Column) -> Column:
        return F.struct(*(count_class(thin, m).alias(k) for k, m in classes.items()), F.regexp_count(thin, F.lit(patterns.OTHER_INVISIBLE)).alias("other"), longest_run(thin, fixed.ZERO_WIDTH).alias("run"), F.length(text).alias("size"))

    at = lambda members: first_place(text, f"[{members}]")

    def report(n: Column) -> Column:
        channel = zero_width_channel(n["zero"], n["run"], n["size"])
        ratio = n["zero"] / F.greatest(F.lit(1), n["size"] - n["zero"])
        return _found([
            _finding(n["bidi"] > 0, "BIDI_CONTROL", "HIGH", n["bidi"], fixed.DETAIL["BIDI_CONTROL"], at(fixed.BIDI)),
            _finding(n["tag"] > 0, "TAG_CHARS", "HIGH", n["tag"], fixed.DETAIL["TAG_CHARS"], at(fixed.TAG)),
            _finding((n["zero"] > 0) & channel, "ZEROWIDTH_CHANNEL", "HIGH", n["zero"], F.format_string(fixed.DETAIL["ZEROWIDTH_CHANNEL"], n["run"], ratio), at(fixed.ZERO_WIDTH)),
            _finding((n["zero"] > 0) & ~channel, "ZEROWIDTH_SPARSE", "LOW", n["zero"], fixed.DETAIL["ZEROWIDTH_SPARSE"], at(fixed.ZERO_WIDTH)),
            _finding(n["other"] > 0, "INVISIBLE_CHARS", F.when(n["other"] >= fixed.INVISIBLE_MEDIUM, "MEDIUM").otherwise("LOW"), n["other"], fixed.DETAIL["INVISIBLE_CHARS"], first_place(text, patterns.OTHER_INVISIBLE)),
            _finding(n["mark"] > 0, "BIDI_MARK", "LOW", n["mark"], fixed.DETAIL["BIDI_MARK"], at(fixed.BIDI_MARK)),
            _finding(n["variation"] >= fixed.VARIATION_MIN, "VARIATION_SELECTORS", "MEDIUM", n["variation"], fixed.DETAIL["VARIATION_SELECTORS"], at(fixed.VARIATION)),
        ])

    none = F.array().cast(f"array<{FINDING}>")
    return let(F.regexp_replace(text, patterns.PLAIN_RUN, " "), lambda thin: F.when(thin.rlike(patterns.REMOVED), let(counts(thin), report)).otherwise(none))


def script_findings(text: Column) -> Column:
    """Findings of words of mixed scripts; texts with letters of one script only are not split into words."""
    samples = lambda words: F.array_join(F.slice(words, 1, fixed.MAX_SAMPLES), "; ")

    def report(w: Column) -> Column:
        # The place of the first spoofed word: the text before the letter run that is this word.
        first = F.element_at(w["spoofs"], 1)
        edge = F.concat(F.lit(r"(?<![\p{L}\p{Nl}\p{No}])\Q"), first, F.lit(r"\E(?![\p{L}\p{Nl}\p{No}])"))
        place = F.length(F.element_at(F.split(F.concat(F.lit(" "), text, F.lit(" ")), edge, 2), 1)) - 1
        return _found([
            _finding(F.size(w["spoofs"]) > 0, "HOMOGLYPH_MIXED_SCRIPT", "HIGH", F.size(w["spoofs"]), fixed.DETAIL["HOMOGLYPH_MIXED_SCRIPT"], place, samples(w["spoofs"])),
            _finding(F.size(w["mixes"]) > 0, "MIXED_SCRIPT_OTHER", "LOW", F.size(w["mixes"]), fixed.DETAIL["MIXED_SCRIPT_OTHER"], None, samples(w["mixes"])),
        ])

    mixed = let(odd_words(text), lambda words: F.struct(homoglyphs(words).alias("spoofs"), other_mixes(words).alias("mixes")))
    return F.when(text.rlike(patterns.BEYOND_LATIN), let(mixed, report)).otherwise(F.array().cast(f"array<{FINDING}>"))


@vectorised("boolean")
def _not_canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and not unicodedata.is_normalized("NFC", t)).astype(bool)


def not_canonical(text: Column) -> Column:
    """Whether a text is not in form NFC; ASCII always is, and is not sent to Python."""
    return _not_canonical(F.when(text.rlike(r"[^\x00-\x7F]"), text))


def magic_label(data: bytes) -> str | None:
    if len(data) < fixed.MAGIC_MIN_BYTES:
        return None
    return next((label for head, label in fixed.MAGIC if data.startswith(head)), None)


def blob_finding(data: bytes, kind: str, where: str) -> dict | None:
    """What decoded bytes reveal: a known file, or near-maximal entropy."""
    label = magic_label(data)
    if label:
        return {"code": "EMBEDDED_FILE_SIGNATURE", "severity": "HIGH", "detail": fixed.DETAIL["EMBEDDED_FILE_SIGNATURE"] % (kind, where, label), "position": None}
    if len(data) >= fixed.DECODED_MIN_BYTES:
        bits, most = entropy_bits(data), math.log2(min(256, len(data)))
        if most >= fixed.DECODED_MIN_MAX and bits >= fixed.DECODED_RATIO * most:
            return {"code": "ENCRYPTED_OR_COMPRESSED", "severity": "HIGH", "detail": fixed.DETAIL["ENCRYPTED_OR_COMPRESSED"] % (kind, where, bits, most), "position": None}
    return None


def _unbase64(run: str) -> bytes | None:
    run = run.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=False)
    except ValueError:
        return None


_URI, _B64, _B64URL, _HEX, _BLOB = (re.compile(p) for p in (fixed.DATA_URI, fixed.BASE64_RUN, fixed.BASE64URL_RUN, fixed.HEX_RUN, fixed.BLOB))
_PURE_HEX, _SEPARATOR = re.compile(r"[0-9A-Fa-f]+"), re.compile(r"[\s:.\-]")


class _Cover:
    """Spans that came before; a later span inside one of them is skipped. Ends are kept as a running maximum by start."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, spans: list[tuple[int, int]]) -> None:
        merged = sorted([*zip(self.starts, self.ends), *spans])
        self.starts, self.ends, reach = [], [], -1
        for s, e in merged:
            reach = max(reach, e)
            self.starts.append(s)
            self.ends.append(reach)

    def holds(self, s: int, e: int) -> bool:
        from bisect import bisect_right

        at = bisect_right(self.starts, s) - 1
        return at >= 0 and self.ends[at] >= e


def encoded_findings(text: str) -> list[dict]:
    """Data URIs, base64 and hex runs; a run whose bytes reveal more is reported as that."""
    out: list[dict] = []

    def report(run: str, kind: str, start: int, plain: dict) -> None:
        data = _unbase64(run) if kind != "hex" else bytes.fromhex(run[: len(run) // 2 * 2])
        out.append((data is not None and blob_finding(data, kind, f"offset {start}")) or plain)

    for m in _URI.finditer(text):
        out.append({"code": "DATA_URI", "severity": "MEDIUM", "detail": fixed.DETAIL["DATA_URI"], "position": m.start()})
        data = _unbase64(m[1])
        found = data is not None and blob_finding(data, "data-URI", f"offset {m.start()}")
        if found:
            out.append(found)
    cover = _Cover()
    for pattern, kind in ((_B64, "base64"), (_B64URL, "base64url")):
        spans = []
        for m in pattern.finditer(text):
            run = m[0]
            if (len(run) % 2 == 0 and _PURE_HEX.fullmatch(run)) or cover.holds(*m.span()):
                continue
            spans.append(m.span())
            report(run, kind, m.start(), {"code": "BASE64_BLOB", "severity": "MEDIUM", "detail": fixed.DETAIL["BASE64_BLOB"] % (kind, len(run)), "position": m.start()})
        cover.add(spans)
    for m in _HEX.finditer(text):
        digits = _SEPARATOR.sub("", m[0])
        if not cover.holds(*m.span()) and len(digits) >= fixed.HEX_MIN:
            report(digits, "hex", m.start(), {"code": "HEX_BLOB", "severity": "MEDIUM", "detail": fixed.DETAIL["HEX_BLOB"] % len(digits), "position": m.start()})
    blob = None
    for f in out:
        at = f["position"]
        if at is None:  # shown from the first blob of the text on
            blob = blob or _BLOB.search(text)
            at = blob.start() if blob else None
        f["verbatim"] = None if at is None else text[at : at + fixed.SNIPPET] + ("…" if len(text) - at > fixed.SNIPPET else "")
        f["occurrences"] = "1"
    return out


FAILED = {"code": "PARSE_ERROR", "severity": "HIGH", "occurrences": "1", "detail": fixed.FAILED_ITEM[1], "verbatim": None, "position": None}


def _encoded_or_failed(text: str | None) -> list[dict]:
    """A text on which the detectors fail blocks its item; its batch goes on."""
    try:
        return encoded_findings(text) if text else []
    except Exception:  # noqa: BLE001
        return [FAILED]


@vectorised(f"array<{FINDING}>")
def _encoded(text: pd.Series) -> pd.Series:
    return text.map(_encoded_or_failed)


def has_runs(text: Column) -> Column:
    """Whether a text can have an encoded run at all."""
    return text.rlike(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{40}") | text.rlike(patterns.HEX_RUN_JAVA) | text.contains(";base64,")


def pem_finding(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(fixed.PEM_BEGIN), F.lit(0))
    labels = F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, fixed.MAX_LABELS), "; ")
    place = first_place(text, fixed.PEM_BEGIN)
    return _finding(text.contains("-----BEGIN ") & (F.size(found) > 0), "PEM_PGP_BLOCK", "HIGH", F.size(found), F.concat(F.lit(fixed.DETAIL["PEM_PGP_BLOCK"]), labels), place, snippet(text, place))


def entropy_finding(text: Column) -> Column:
    hot = hot_windows(F.when(F.length(text) >= fixed.ENTROPY_WINDOW, text))
    place = F.get(hot, 0)
    return _finding(F.size(hot) > 0, "HIGH_ENTROPY_REGION", "MEDIUM", F.size(hot), fixed.DETAIL["HIGH_ENTROPY_REGION"], place, snippet(text, place))


def character_findings(text: Column) -> Column:
    """All gate-1 findings of a text, in order."""
    # Most texts have nothing but plain Latin letters, and pass the first three detectors by one test.
    odd = text.rlike(patterns.BEYOND_PLAIN)
    canonical = _finding(not_canonical(F.when(odd, text)), "NON_NFC", "LOW", F.lit(1), fixed.DETAIL["NON_NFC"])
    return F.concat(
        F.when(odd, F.concat(invisible_findings(text), script_findings(text), _found([canonical]))).otherwise(F.array().cast(f"array<{FINDING}>")),
        _found([pem_finding(text)]),
        _encoded(F.when(has_runs(text), text)),
        _found([entropy_finding(text)]),
    )


@vectorised("string")
def _what_is_invalid(content: pd.Series) -> pd.Series:
    def say(data: bytes | None) -> str | None:
        try:
            return None if data is None else data.removeprefix(b"\xef\xbb\xbf").decode() and None
        except UnicodeDecodeError as e:
            return fixed.DETAIL["INVALID_UTF8"] % (e.reason, e.start)

    return content.map(say)


def invalid_finding(content: Column) -> Column:
    """A finding of bytes that are no UTF-8, with the reason and the place after a byte order mark; null for others."""
    bad = ~F.is_valid_utf8(content.cast("string"))
    return _finding(bad, "INVALID_UTF8", "HIGH", F.lit(1), _what_is_invalid(F.when(bad, content)))


def mark_finding(marked: Column) -> Column:
    return _finding(marked, "INVISIBLE_CHARS", "LOW", F.lit(1), fixed.DETAIL["BOM"])


def byte_findings(content: Column) -> Column:
    """Findings of raw bytes before their text: a byte order mark; bytes that are no UTF-8."""
    return _found([mark_finding(content.startswith(F.unhex(F.lit("EFBBBF")))), invalid_finding(content)])


def segment_findings(text: Column) -> Column:
    """Gate-1 findings of a segment: a leading byte order mark is one, and no part of the text behind it."""
    marked = text.startswith("\ufeff")
    body = F.when(marked, F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    return F.concat(_found([mark_finding(marked)]), character_findings(body))


__all__ = ["FINDING", "character_findings", "segment_findings", "byte_findings", "encoded_findings", "blob_finding"]
