"""Extended times: seconds since the start of the service day, which may pass 24 hours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def seconds(text: Column) -> Column:
    """``HH:MM:SS`` as seconds; null for blank or malformed text."""
    t = F.trim(text)
    part = lambda i: F.try_to_number(F.split_part(t, F.lit(":"), F.lit(i)), F.lit("9999")).cast("int")
    return F.when(t.rlike(r"^\d{1,4}:[0-5]\d:[0-5]\d$"), part(1) * 3600 + part(2) * 60 + part(3))


def clock(value: Column) -> Column:
    """Seconds as ``HH:MM:SS``."""
    return F.format_string("%02d:%02d:%02d", F.floor(value / 3600), F.floor(value / 60) % 60, value % 60)


def day_before(day: str) -> str:
    return DAYS[(DAYS.index(day) - 1) % 7]


def within(value: Column, periods: list[tuple[int, int]]) -> Column:
    """Inside any of the periods, both ends included; everything is if there are none."""
    return reduce(Column.__or__, [(value >= a) & (value <= b) for a, b in periods], F.lit(not periods))


def add_period(periods: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """``periods`` and one more, unless its start or end lies in one of them (one that holds another may be added)."""
    if end < start:
        raise ValueError("a period must not end before it starts")
    clash = any(a <= x <= b for a, b in periods for x in (start, end))
    return periods if clash else [*periods, (start, end)]


def flag(column: str) -> Column:
    """A calendar's day flag; anything but 1 is false."""
    return F.coalesce(F.col(column).try_cast("int") == 1, F.lit(False))


def active_on_any(days: list[str]) -> Column:
    return reduce(Column.__or__, [flag(d) for d in days], F.lit(False))
