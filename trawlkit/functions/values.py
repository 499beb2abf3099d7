"""Parsing of control values and of result fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column) -> Column:
    """Integer value of a text, null when it is not one. Single underscores may part its digits."""
    return F.regexp_replace(F.trim(text), r"(?<=[0-9])_(?=[0-9])", "").try_cast("bigint")


def parse_delay(text: Column) -> Column:
    """`N` or `MIN-MAX` as a struct of two numbers; both null when either is bad."""
    parts = F.split(F.trim(text), "-", 2)
    low = whole_number(F.element_at(parts, 1))
    high = whole_number(F.element_at(parts, -1))
    good = low.isNotNull() & high.isNotNull()
    return F.struct(F.when(good, low).alias("delay_min"), F.when(good, high).alias("delay_max"))


def parse_concurrency(text: Column) -> Column:
    value = whole_number(text)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(1)))


def parse_flag(text: Column) -> Column:
    """`on` for a control that is present, `off` for one taken away; anything else is refused."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(trimmed == "on", True).when(trimmed == "off", False)


def parse_igsets(text: Column) -> Column:
    """Set names of a comma list; items are not trimmed, an empty list has none."""
    trimmed = F.btrim(text, F.lit("\r\n\t ,"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, ",", -1))


def with_global_set(sets: Column, use_global: bool | Column = True) -> Column:
    """Put the general set before the chosen ones unless it is switched off."""
    flag = use_global if isinstance(use_global, Column) else F.lit(use_global)
    return F.when(flag, F.array_union(F.array(F.lit("global")), sets)).otherwise(sets)


def result_code(status_code: Column, ftp_code: Column | None = None) -> Column:
    """An FTP reply code wins over the HTTP status; 0 when neither is known."""
    columns = [status_code, F.lit(0)] if ftp_code is None else [ftp_code, status_code, F.lit(0)]
    return F.coalesce(*columns)


def result_message(error: Column, reason: Column) -> Column:
    return F.coalesce(error, reason, F.lit(""))


def status_class(code: Column, error: Column) -> Column:
    """r1xx..r5xx for three-digit codes, runk for everything else and for errors."""
    first = F.floor(code / 100).cast("int")
    return F.when(error.isNull() & code.between(100, 599), F.concat(F.lit("r"), first.cast("string"), F.lit("xx"))).otherwise(
        F.lit("runk")
    )
