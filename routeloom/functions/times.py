"""Times of the query interface."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_FORM = re.compile(r"(\d{4}-\d{1,2}-\d{1,2})(?: (\d{1,2}:\d{1,2}(?::\d{1,2})?))?|(\d+)")


def parse_time(text: str) -> tuple[int, str]:
    """Epoch seconds of `Y-m-d [H:M[:S]]` (UTC) or of digits, and what follows them."""
    m = _FORM.match(text)
    if not m:
        raise ValueError(f"bad time: {text}")
    if m[3]:
        return int(m[3]), text[m.end() :]
    clock = (m[2] or "0:0").split(":")
    day = [int(x) for x in m[1].split("-")]
    return int(datetime(*day, *map(int, clock), tzinfo=UTC).timestamp()), text[m.end() :]


def parse_interval(text: str) -> tuple[int, int | None]:
    """`begin[,end]`; no end, or 0, is forever."""
    begin, rest = parse_time(text)
    if not rest:
        return begin, None
    end, rest = parse_time(rest.removeprefix(","))
    if rest or (end and end < begin):
        raise ValueError(f"bad interval: {text}")
    return begin, end or None


def recent_interval(text: str, now: int) -> tuple[int, None]:
    """`N s|m|h|d` up to now."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text)
    if not m:
        raise ValueError(f"bad period: {text}")
    return now - int(m[1]) * UNITS[m[2]], None


def seconds_and_micros(text: Column) -> tuple[Column, Column]:
    """Decimal seconds as text to (sec, usec)."""
    exact = text.cast("decimal(20,6)")
    return F.floor(exact).cast("long"), ((exact - F.floor(exact)) * 1_000_000).cast("int")


def time_text(sec: Column, usec: Column) -> Column:
    return F.concat(sec.cast("string"), F.lit("."), F.lpad(usec.cast("string"), 6, "0"))
