"""Unicode-aware text helpers shared by parsing and features.

Java regex classes differ from Python's ``str`` predicates on a few code points
(Python counts U+001C..U+001F as whitespace, superscript digits as digits, ...).
The few extra code points are derived here from Python's own Unicode tables by
rule, then appended to the closest Java property class, so the expressions stay
plain JVM regexes (no UDF).
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ranges(codepoints: list[int]) -> str:
    """Compact a sorted code-point list into a Java regex class body."""
    out = []
    start = prev = None
    for cp in codepoints:
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            out.append((start, prev))
            start = prev = cp
    if start is not None:
        out.append((start, prev))
    parts = []
    for a, b in out:
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "".join(parts)


@functools.lru_cache(maxsize=None)
def _extra(kind: str) -> str:
    """Code points Python accepts that the base Java class misses (by rule)."""
    import unicodedata

    extra = []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if kind == "digit" and ch.isdigit() and cat != "Nd":
            extra.append(cp)
        elif kind == "alnum" and ch.isalnum() and cat[0] not in "LN":
            extra.append(cp)
    return _ranges(extra)


@functools.lru_cache(maxsize=None)
def non_alnum_not_python() -> str:
    """Code points in \\p{L}/\\p{N} that Python's isalnum rejects (rule-derived)."""
    import unicodedata

    cps = [cp for cp in range(sys.maxunicode + 1)
           if unicodedata.category(chr(cp))[0] in "LN" and not chr(cp).isalnum()]
    return _ranges(cps)


# Python str.isspace() == Java White_Space plus the four information separators.
WS = r"[\s\x1c-\x1f]"


def digit_class() -> str:
    extra = _extra("digit")
    return f"[\\p{{Nd}}{extra}]"


def upper_class() -> str:
    # Python isupper() uses the derived Uppercase property (Lu + Other_Uppercase).
    return r"\p{IsUppercase}"


def non_alnum_class() -> str:
    extra = _extra("alnum")
    drop = non_alnum_not_python()
    if drop:
        return f"[^\\p{{L}}\\p{{N}}{extra}]|[{drop}]"
    return f"[^\\p{{L}}\\p{{N}}{extra}]"


def is_blank(c: Column) -> Column:
    """``not line.strip()`` in Python terms: empty or whitespace only."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")  # ends at the first other character


def ustrip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace on both ends)."""
    return F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def code_points(c: Column) -> Column:
    """Array of code points (as 1-char strings); surrogate pairs stay whole.

    ``split(c, '')`` cuts UTF-16 units, so it is used only for texts without
    supplementary-plane characters; the regex form handles the rest.  (A split
    may add one trailing empty string, which joins and counts ignore.)
    """
    supplementary = c.rlike("[\\x{10000}-\\x{10FFFF}]")
    return F.when(supplementary, F.regexp_extract_all(c, F.lit("(?s)."), 0)).otherwise(
        F.filter(F.split(c, "", -1), lambda x: x != ""))
