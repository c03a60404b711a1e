r"""One catalogue, three dialects: patterns as Python reads them, put into Java and RE2 form.

Python's ``\b``, ``\d``, ``\s`` and case folding go by Unicode. Java takes them by ASCII unless told
otherwise, and RE2 has no look-around, so both get them spelled out.
"""

from __future__ import annotations

from tidegate.functions import fixed

_WORD = r"\p{L}\p{N}_"


def java(pattern: str, ignore_case: bool = False) -> str:
    """For Spark: word edges by look-around, white space and digits by Unicode, dots stop at line feeds only."""
    edge = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
    return ("(?diu)" if ignore_case else "(?d)") + pattern.replace(r"\b", edge).replace(r"\s", f"[{fixed.SPACE}]").replace(r"\d", r"\p{Nd}")


def re2(pattern: str, ignore_case: bool = False) -> str:
    """For DuckDB, in lexicons whose word edges stand beside a word character of the pattern or its ends."""
    flags = "(?i)" if ignore_case else ""
    return flags + pattern.replace(r"\s", f"[{fixed.SPACE}]").replace(r"\d", r"\p{Nd}")


INJECTION = "|".join(fixed.INJECTION)
# Possessive where a Java loop would otherwise recurse once a step; the result is the same.
HEX_RUN_JAVA = rf"(?:[0-9A-Fa-f]{{2}}[{fixed.SPACE}:.\-]?+){{20,}}+"
BASE64_RUN_JAVA = r"[A-Za-z0-9+/]{40,}+={0,2}"
BASE64URL_RUN_JAVA = r"[A-Za-z0-9_\-]{40,}+={0,2}"
ANY_REMOVED = "".join([fixed.BIDI, fixed.BIDI_MARK, fixed.ZERO_WIDTH, fixed.TAG, fixed.VARIATION])
#: Cf, Cc, Co and Cn without the classes above and the white space that may stay.
OTHER_INVISIBLE = rf"[[\p{{Cf}}\p{{Cc}}\p{{Co}}\p{{Cn}}]&&[^{ANY_REMOVED}{fixed.ALLOWED_SPACE}]]"
REMOVED = rf"[{ANY_REMOVED}[\p{{Cf}}\p{{Cc}}\p{{Co}}\p{{Cn}}&&[^{fixed.ALLOWED_SPACE}]]]"
#: A word with a letter or number beyond plain Latin; a plain word is passed over in one step.
_PLAIN_LETTER = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\x{24F}"
ODD_WORD = rf"(?<![{_PLAIN_LETTER}])[{_PLAIN_LETTER}]*+[[\p{{L}}\p{{Nl}}\p{{No}}]&&[^{_PLAIN_LETTER}]][\p{{L}}\p{{Nl}}\p{{No}}]*+"
LATIN = rf"[\p{{IsLatin}}&&[^{fixed.NOT_NAMED_LATIN}]]"
CYRILLIC = r"\p{IsCyrillic}"
GREEK = r"[\p{IsGreek}\p{IsCoptic}]"
OTHER_LETTER = rf"[\p{{L}}&&[^{LATIN}{CYRILLIC}{GREEK}]]"
#: A letter that is not Latin by name.
NOT_LATIN = rf"[{CYRILLIC}{GREEK}{OTHER_LETTER}]"
#: The cheapest of tests: a text without such a character has nothing invisible, one script and canonical form.
BEYOND_PLAIN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\xAA\xAD\xBA\x{250}-\x{10FFFF}]"
#: Runs of characters that never count as invisible.
PLAIN_RUN = r"[\t\n\r\x20-\x7E\xA0-\xAC\xAE-\x{2FF}]+"
BEYOND_LATIN = r"[\xAA\xBA\x{250}-\x{10FFFF}]"


def loose(pattern: str, ignore_case: bool = False) -> str:
    """Without word edges: matches wherever the pattern does, and is cheaper to rule out."""
    return java(pattern.replace(r"\b", ""), ignore_case)
