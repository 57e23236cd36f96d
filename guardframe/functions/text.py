"""Small text helpers shared by screening, redaction and the request audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardframe.rules import WHITESPACE

# A word character as Python's ``\w`` sees it. Java's own ``(?U)\w`` also counts combining
# marks, and its ``(?U)\s`` leaves out U+001C to U+001F, so both classes are spelled out.
WORD = r"\p{L}\p{N}_"
# Java looks behind by whole code points only if the class names one beyond U+FFFF; this digit is
# already in \\p{N}.
_WORD_BEHIND = WORD + "\U0001d7d8"
_SPACE = "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE)
_BOUNDARY = f"(?:(?<=[{_WORD_BEHIND}])(?![{WORD}])|(?<![{_WORD_BEHIND}])(?=[{WORD}]))"


def java_pattern(pattern: str) -> str:
    """Rewrite a Python ``re`` pattern (``\\b``, ``\\d``, ``\\s``) for Java with equal meaning."""
    return pattern.replace(r"\b", _BOUNDARY).replace(r"\d", r"\p{Nd}").replace(r"\s", _SPACE)


def whole_word_pattern(phrase: str) -> str:
    """``\\bphrase\\b`` for a phrase that starts and ends with word characters."""
    return f"(?<![{_WORD_BEHIND}]){phrase}(?![{WORD}])"


def strip_text(col: Column) -> Column:
    """Strip outer whitespace as ``str.strip`` does (looks at the ends only)."""
    return F.trim(col, F.lit(WHITESPACE))


def words(col: Column) -> Column:
    """Maximal runs of word characters; the first or last may be an empty string."""
    return F.split(col, f"[^{WORD}]+")


def text_array(values: list[str]) -> Column:
    """A constant array of texts, made in one call."""
    return F.expr("array(" + ", ".join(sql_text(value) for value in values) + ")")


def sql_text(value: str) -> str:
    """A raw SQL literal for a text without single quotes."""
    return f"r'{value}'"


def contains_any(col: Column, terms: list[str]) -> Column:
    """True if ``col`` contains any of the fixed terms as a substring; stops at the first."""
    return reduce(lambda left, right: left | right, [col.contains(term) for term in terms])


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text ending in ``Z``; the fraction is written only when it is not zero."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fraction = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.date_trunc("second", utc) == utc, whole).otherwise(fraction)


def without_credentials(uri: Column) -> Column:
    """The part of a connection string after the last ``@``."""
    return F.substring_index(uri, "@", -1)
