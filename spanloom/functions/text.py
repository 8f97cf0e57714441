"""Column functions on surfaces, codes and lists.  All stay in the JVM but ``nfc``."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import vocab


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _normal(c: Column, form: str) -> Column:
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normal(c)


def nfc(c: Column) -> Column:
    """Unicode NFC.  Spark has no builtin; ASCII texts skip the work."""
    return _normal(c, "NFC")


def nfd(c: Column) -> Column:
    return _normal(c, "NFD")


def surface(c: Column) -> Column:
    """Key of a span's text: trimmed, lower case.  Texts are NFC already; apply ``nfc`` first where they may not be."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def term(c: Column) -> Column:
    """Key of a terminology entry: ``surface`` with white space collapsed."""
    return F.regexp_replace(surface(c), r"(?U)\s+", " ")


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def dot(code: Column) -> Column:
    """D550 -> D55.0; digits, dotted and codes of up to three characters stay as they are."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(c.rlike(r"^\d*$") | F.contains(c, F.lit(".")) | (F.length(c) <= 3), c).otherwise(F.concat(F.substring(c, 1, 3), F.lit("."), F.substr(c, F.lit(4))))


def undot(code: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(code, F.lit("")))), F.lit("."), F.lit(""))


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def malformed(c: Column) -> Column:
    """Reason why a span's edges are wrong, or null."""
    return (
        F.when(c.rlike(r"(?U)^\s|\s$"), "edge space")
        .when(c.rlike(r"^[.,;:]|[.,;:]$"), "edge punctuation")
        .when((_count(c, "(") != _count(c, ")")) | (_count(c, "[") != _count(c, "]")), "unbalanced bracket")
    )


def banned(c: Column) -> Column:
    """The first hard rule that a span's text breaks, or null."""
    return (
        F.when(surface(c) == "", "empty")
        .when(c.rlike(vocab.MASK), "masked")
        .when(surface(c).isin(*vocab.BANNED_EXACT), "banned term")
        .when(c.rlike(vocab.VITAL_VALUE), "vital value")
        .otherwise(malformed(c))
    )


def weak(c: Column) -> Column:
    """One bare syllable: a soft rule."""
    return surface(c).isin(*vocab.ONE_SYLLABLE)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets, null as empty: both empty 1, one empty 0."""
    x, y = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def break_even(j: Column) -> Column:
    return j / (1 + j)


def lenient_double(c: Column) -> Column:
    """Decimal comma allowed; blanks and other text are null."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def escape(c: Column) -> Column:
    """Backslash, line feed and carriage return for a line codec."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape(c: Column) -> Column:
    """Inverse of ``escape``.  Pairs are read from the left, so an escaped backslash never starts another pair; of an unknown
    pair the second character stays, and so does a backslash at the end."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.regexp_replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), r"(?s)\\(.)", "$1"))
    return F.array_join(plain, "\\")


def cells(c: Column, sep: str = ";") -> Column:
    """A multi-value cell: trimmed parts, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def context_window(text: Column, start: Column, end: Column, width: int = 35, left: str = "【", right: str = "】") -> Column:
    """The span in marks with up to ``width`` characters on either side; line breaks become spaces."""
    before = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(F.lit(width), start))
    return F.replace(F.concat(before, F.lit(left), F.substring(text, start + 1, end - start), F.lit(right), F.substring(text, end + 1, F.lit(width))), F.lit("\n"), F.lit(" "))
