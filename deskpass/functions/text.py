"""Text column functions: strip, category segment, cleaning, tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from deskpass.schema import FORM_SUFFIX_PATTERN

# Unicode-aware whitespace at either end, like Python's str.strip().
_EDGE_SPACE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
# A token: two or more letters, digits or underscores (TF-IDF default pattern).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Trim every kind of whitespace at both ends (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), _EDGE_SPACE, "")


def last_segment(c: Column | str) -> Column:
    """The part after the last ``/``, stripped; null stays null, a trailing ``/`` gives ''."""
    return py_strip(F.element_at(F.split(_c(c), "/"), -1))


def last_segment_loose(c: Column | str) -> Column:
    """P2, variant: only split and strip when a ``/`` is present; otherwise keep the value as is."""
    c = _c(c)
    return F.when(c.contains("/"), last_segment(c)).otherwise(c)


def strip_form_suffix(c: Column | str) -> Column:
    """Drop the ``(휴게 O|X)`` suffix a form value carries."""
    return F.regexp_replace(_c(c), FORM_SUFFIX_PATTERN, "")


def char_length(c: Column | str) -> Column:
    """Length in characters; null stays null."""
    return F.char_length(_c(c))


def clean_text(c: Column | str) -> Column:
    """Replace symbols with spaces, collapse runs of whitespace, strip the ends.

    Symbols and whitespace together are exactly the characters that are not
    letters or digits, so one pass turns each run of them into one space."""
    return F.trim(F.regexp_replace(_c(c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column | str) -> Column:
    """T3 tokeniser: lower-case, then every run of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def _nfkc_series(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) else v)


def nfkc(c: Column | str) -> Column:
    """NFKC normalisation (no built-in); Arrow-batched pandas UDF."""
    return F.pandas_udf(_nfkc_series, "string")(_c(c))
