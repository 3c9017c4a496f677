"""Durations, instants and value kinds of the query language."""

from __future__ import annotations

import re
from datetime import UTC, datetime

# The language's duration units in nanoseconds.
UNITS = {"ns": 1, "u": 1_000, "us": 1_000, "µ": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000, "w": 604_800_000_000_000}
# The multipliers of a write's or an answer's precision.
PRECISIONS = {"ns": 1, "n": 1, "u": 1_000, "us": 1_000, "µ": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}

FLOAT, INTEGER, BOOLEAN, STRING = "float", "integer", "boolean", "string"
SPARK_TYPES = {FLOAT: "double", INTEGER: "bigint", BOOLEAN: "boolean", STRING: "string"}
KINDS = {"double": FLOAT, "float": FLOAT, "bigint": INTEGER, "int": INTEGER, "smallint": INTEGER, "tinyint": INTEGER, "boolean": BOOLEAN, "string": STRING}


class QueryError(ValueError):
    """A statement that can't be parsed or doesn't fit the schema."""


def duration(text: str) -> int:
    m = re.fullmatch(r"(\d+)(ns|us|ms|u|µ|s|m|h|d|w)", text.strip())
    if not m:
        raise QueryError(f"not a duration: {text}")
    return int(m[1]) * UNITS[m[2]]


def duration_text(ns: int) -> str:
    """The longest unit that divides a duration; 0 is unlimited."""
    if not ns:
        return "0s"
    unit = next(u for u in ("w", "d", "h", "m", "s", "ms", "us", "ns") if ns % UNITS[u] == 0)
    return f"{ns // UNITS[unit]}{unit}"


def instant(text: str) -> int:
    """Nanoseconds of an RFC3339 time; nine digits of the second count."""
    m = re.fullmatch(r"\s*(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d)?)(?:\.(\d{1,9}))?\s*(Z|[+-]\d\d:?\d\d)?)?\s*", text)
    if not m:
        raise QueryError(f"not a time: {text}")
    clock = m[2] or "00:00:00"
    when = datetime.fromisoformat(f"{m[1]}T{clock if len(clock) > 5 else clock + ':00'}{'+00:00' if (m[4] or 'Z') == 'Z' else m[4]}")
    whole = when - datetime(1970, 1, 1, tzinfo=UTC)
    return (whole.days * 86400 + whole.seconds) * 1_000_000_000 + int((m[3] or "0").ljust(9, "0"))


def instant_text(ns: int) -> str:
    seconds, rest = divmod(ns, 1_000_000_000)
    days, clock = divmod(seconds, 86400)
    day = datetime.fromordinal(datetime(1970, 1, 1).toordinal() + days)
    return f"{day:%Y-%m-%d}T{clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d}.{rest:09d}Z"
