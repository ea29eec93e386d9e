"""Labels, model text, flags and validation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskpass.schema import BINARY_LABEL, REQUIRED_MESSAGE, STATUS_CODE
from deskpass.functions.text import _c, py_strip


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def encode_status(c: Column | str) -> Column:
    """승인됨 → 1, 거절됨 → 0, anything else → null."""
    return F.element_at(_lookup(BINARY_LABEL), _c(c))


def decode_status(c: Column | str) -> Column:
    """P3a inverse: 1 → 승인됨, 0 → 거절됨 (accepts ints or doubles)."""
    c = _c(c)
    return F.when(c == 1, F.lit("승인됨")).when(c == 0, F.lit("거절됨"))


def status_code(c: Column | str) -> Column:
    """Four statuses → 0..3; unmapped (and null) → null."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(
        F.element_at(_lookup(STATUS_CODE), c))


def decode_status_code(c: Column | str) -> Column:
    """P3b inverse."""
    inverse = {v: k for k, v in STATUS_CODE.items()}
    c = _c(c).cast("int")
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.element_at(_lookup(inverse), c))


def model_text(category: Column | str, reason: Column | str) -> Column:
    """Category + ' ' + reason; a null reason counts as '', a null category gives null."""
    return F.concat(_c(category), F.lit(" "), F.coalesce(_c(reason), F.lit("")))


def duplicate_flag(note: Column | str, word: str = "중복") -> Column:
    """1 when the note contains the word, else 0 (null note → 0)."""
    return F.coalesce(_c(note).contains(word).cast("int"), F.lit(0))


def is_blank(c: Column | str) -> Column:
    """Null, or nothing but whitespace (same as ``py_strip(c) == ''``; the search
    stops at the first non-space character instead of rewriting the text)."""
    c = _c(c)
    return c.isNull() | ~c.rlike(r"(?U)\S")


def validate_required(*cols: Column | str) -> Column:
    """The fixed message when any required input is blank, else null."""
    blank = None
    for c in cols:
        blank = is_blank(c) if blank is None else (blank | is_blank(c))
    return F.when(blank, F.lit(REQUIRED_MESSAGE))
