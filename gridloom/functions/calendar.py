"""Dates, session steps, and the maps between step frequencies."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Session minutes: 09:30 to 11:29 and 13:00 to 14:56 (fixed values).
SESSION = ((9 * 60 + 30, 11 * 60 + 29), (13 * 60, 14 * 60 + 56))
MINUTES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "60min": 60}
DAILY = "1d"


def date_key(value) -> str:
    """YYYYMMDD from a date, a timestamp or one of the usual spellings."""
    if hasattr(value, "strftime"):
        return value.strftime("%Y%m%d")
    digits = re.sub(r"[-/.]", "", str(value).strip().split("T")[0].split(" ")[0])
    if not re.fullmatch(r"\d{8}", digits):
        raise ValueError(f"{value!r} is not a date")
    return digits


def day_of(column: Column, kind: str) -> Column:
    """YYYYMMDD of a date, timestamp, number or string column of type ``kind``."""
    return F.date_format(column, "yyyyMMdd") if kind.startswith(("date", "timestamp")) else F.regexp_replace(column.cast("string"), "[-/.]", "")


def in_days(column: Column, kind: str, first: str, last: str, spelling: str | None = None) -> Column | None:
    """Whether a raw column lies in the days ``first`` to ``last``, compared in its own type, so that the scan can skip by it.

    Strings need their ``spelling`` (a strftime format that sorts like the dates); without one there is nothing to compare raw.
    """
    a, b = (datetime.strptime(d, "%Y%m%d") for d in (first, last))
    if kind.startswith("timestamp"):
        return (column >= F.lit(str(a)).cast(kind)) & (column < F.lit(str(b + timedelta(days=1))).cast(kind))
    if kind == "date":
        return column.between(F.lit(a.date()), F.lit(b.date()))
    if kind in ("int", "bigint"):
        return column.between(F.lit(int(first)).cast(kind), F.lit(int(last)).cast(kind))
    return None if spelling is None else column.between(F.lit(a.strftime(spelling)), F.lit(b.strftime(spelling)))


def step_labels(freq: str, count: int | None = None) -> list[int]:
    """HHMM of each bucket's start; 0, 1, 2... where the count is not the session's."""
    if freq == DAILY:
        return list(range(count or 1))
    width = MINUTES[freq]
    minutes = [m for a, b in SESSION for m in range(a, b + 1)]
    offsets = [k for k in range(0, len(minutes), width)]
    # buckets do not cross the noon break: its first half is a whole number of every width
    labels = [minutes[k] // 60 * 100 + minutes[k] % 60 for k in offsets]
    return labels if count is None or count == len(labels) else list(range(count))


def buckets(source: str, target: str) -> list[int]:
    """Coarse bucket of each fine step."""
    if target == DAILY:
        return [0] * len(step_labels(source))
    if MINUTES[target] % MINUTES[source]:
        raise ValueError(f"{target} is no multiple of {source}")
    return [k * MINUTES[source] // MINUTES[target] for k in range(len(step_labels(source)))]


def latest_step(source: str, target: str) -> list[int]:
    """For each fine step of ``target`` the last coarse step of ``source`` that has begun."""
    coarse, fine = step_labels(source), step_labels(target)
    return [max(k for k, label in enumerate(coarse) if label <= x) for x in fine]
