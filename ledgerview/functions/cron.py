"""Cron schedules as pure predicates: minute hour day month weekday, with *, lists, ranges and steps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def _values(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not low <= a <= b <= high:
            raise ValueError(f"bad schedule part {part!r}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def is_time(schedule: str, at: dt.datetime) -> bool:
    """Whether a schedule fires in the minute of `at`; Sunday is 0."""
    parts = schedule.split()
    if len(parts) != 5:
        raise ValueError("a schedule has five parts")
    now = (at.minute, at.hour, at.day, at.month, (at.weekday() + 1) % 7)
    return all(v in _values(p, *lim) for v, p, lim in zip(now, parts, LIMITS, strict=True))


def fires(schedule: str, at: Column) -> Column:
    """is_time() for a timestamp column."""
    parts = schedule.split()
    if len(parts) != 5:
        raise ValueError("a schedule has five parts")
    now = (F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1)
    found = F.lit(True)
    for v, p, lim in zip(now, parts, LIMITS, strict=True):
        if p != "*":
            found = found & v.isin(*sorted(_values(p, *lim)))
    return found
