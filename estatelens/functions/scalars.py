"""Scalar functions with the meaning they have in the source system, as Spark columns.

Everything stays inside Spark's own expressions. Where a Spark function of the same name means
something else, the difference is noted.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens import fixed_values as V


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of(value: datetime | str | None) -> Column:
    """The moment a job runs for; the current time when none is given.

    A parameter instead of the clock keeps results repeatable.
    """
    if value is None:
        return F.localtimestamp()
    return F.lit(str(value)).cast("timestamp_ntz")


# -- names and numbers


def normalize_name(c: str | Column) -> Column:
    """Trim, lower-case, runs of other characters to ``_``, no ``_`` at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), V.NOT_WORD, "_"), F.lit("_"))


def normalize_header(name: str) -> str:
    """``normalize_name`` for a column name."""
    return re.sub(r"\W+", "_", str(name).strip().lower()).strip("_")


def to_number(c: str | Column) -> Column:
    """Lenient whole number: text that is no number, and null, give 0; fractions are cut."""
    text = _col(f"`{c}`" if isinstance(c, str) else c).cast("string")
    number = F.when(F.rlike(text, F.lit(V.NUMBER)), text.try_cast("double"))
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


# -- strings


def plus(*columns: str | Column) -> Column:
    """String ``+``: null as soon as one part is null."""
    return F.concat(*[_col(c) for c in columns])


def isnull(c: str | Column, replacement) -> Column:
    """Two-argument ``ISNULL``: a replacement for null (Spark's ``isnull`` is a predicate)."""
    return F.coalesce(_col(c), replacement if isinstance(replacement, Column) else F.lit(replacement))


def base_name(c: str | Column) -> Column:
    """Last part of a path."""
    return F.substring_index(_col(c), "/", -1)


def stem(c: str | Column) -> Column:
    """Last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(c), r"(?s)(?<=.)\.[^.]+$", "")


def line_count(c: str | Column) -> Column:
    """Number of line ends plus one."""
    text = _col(c)
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint") + 1


def first_line(c: str | Column, width: int | None = None) -> Column:
    """Text before the first line end, at most ``width`` characters of it if a width is given."""
    line = F.regexp_extract(_col(c), V.FIRST_LINE, 1)
    return line if width is None else F.substring(line, 1, width)


# -- dates


def convert_120(c: str | Column, length: int | None = None) -> Column:
    """``CONVERT(VARCHAR, d, 120)``: ``yyyy-MM-dd HH:mm:ss``, cut to ``length`` characters."""
    text = F.substring(_col(c).cast("timestamp_ntz").cast("string"), 1, 19)
    return text if length is None else F.substring(text, 1, length)


def datediff_day(start: str | Column, end: str | Column) -> Column:
    """Midnights passed from ``start`` to ``end`` (Spark's ``datediff(DAY, …)`` counts full days)."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))


def datediff_month(start: str | Column, end: str | Column) -> Column:
    """Month boundaries passed from ``start`` to ``end``."""
    start, end = _col(start), _col(end)
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def dateadd(unit: str, amount: int, c: str | Column) -> Column:
    """``DATEADD`` for days and months; a month step keeps to the end of a shorter month."""
    if unit.upper() not in ("DAY", "MONTH"):
        raise ValueError(f"unit {unit!r} is not DAY or MONTH")
    if unit.upper() == "DAY":
        return _col(c) + F.make_dt_interval(F.lit(int(amount)))
    return _col(c) + F.make_ym_interval(F.lit(0), F.lit(int(amount)))


def as_date(c: str | Column) -> Column:
    """``CAST(x AS DATE)``."""
    return F.to_date(_col(c))


def utc_stamp(c: str | Column) -> Column:
    """``yyyyMMddHHmmss``."""
    return F.date_format(_col(c), "yyyyMMddHHmmss")
