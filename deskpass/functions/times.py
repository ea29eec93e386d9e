"""Timestamp text and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskpass.schema import DAY_FORMAT, LOG_ZONE, TS_FORMAT
from deskpass.functions.text import _c


def ts_text(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a wall-clock timestamp."""
    return F.date_format(_c(ts), TS_FORMAT)


def ts_text_zoned(ts: Column | str, zone: str = LOG_ZONE, from_zone: str = "UTC") -> Column:
    """The same text after moving a UTC wall-clock time to ``zone`` (UTC+9 by default)."""
    shifted = F.convert_timezone(F.lit(from_zone), F.lit(zone), _c(ts).cast("timestamp_ntz"))
    return F.date_format(shifted, TS_FORMAT)


def iso_text(ts: Column | str) -> Column:
    """P20: ISO-8601 text; the fraction is shown only when it is not zero (as Python prints it)."""
    ts = _c(ts)
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def day_key(ts: Column | str) -> Column:
    """P20: ``yyyyMMdd`` day key (the per-day log file name part)."""
    return F.date_format(_c(ts), DAY_FORMAT)


def session_id() -> Column:
    """A random session id (nondeterministic; never part of a value check)."""
    return F.expr("uuid()")
