"""Statements as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """A measurement, with its database and retention policy if given."""

    measurement: str
    rp: str | None = None
    db: str | None = None


@dataclass(frozen=True)
class Item:
    """One selected column: a plain field (func None), ``*``, or a function call."""

    field: str
    func: str | None = None
    args: tuple = ()
    distinct: bool = False

    @property
    def alias(self) -> str:
        if self.func is None or self.func == "distinct":
            return self.field
        if self.distinct:
            return f"count_distinct_{self.field}"
        return "_".join([self.func, self.field, *(a.text if isinstance(a, Duration) else f"{a:g}" if isinstance(a, float) else str(a) for a in self.args)])


@dataclass(frozen=True)
class Duration:
    ns: int
    text: str


@dataclass(frozen=True)
class Predicate:
    """``name op value``; value is (kind, content), kind being string, number,
    regex, boolean or time."""

    name: str
    op: str
    value: tuple


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


Condition = Predicate | Both | Either | None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: object  # Name or Select
    where: Condition = None
    into: Name | None = None
    every: int | None = None
    tags: tuple[str, ...] = ()
    all_tags: bool = False
    fill: object = None  # None, "null", "previous", "linear" or a number
    descending: bool = False
    limit: int | None = None
    offset: int = 0
    slimit: int | None = None
    soffset: int = 0

    @property
    def grouped(self) -> bool:
        return bool(self.every or self.tags or self.all_tags)


@dataclass(frozen=True)
class Explain:
    select: Select
    analyze: bool = False


@dataclass(frozen=True)
class Show:
    what: str
    source: Name | None = None
    db: str | None = None
    key: str | None = None
    where: Condition = None
    measurement: tuple | None = None  # (op, value) of WITH MEASUREMENT
    topic: str | None = None
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Delete:
    """DELETE (points that match) or DROP SERIES (all of the series that match)."""

    sources: tuple[Name, ...]
    where: Condition = None
    whole_series: bool = False
    where_text: str | None = None  # of the condition as it was written


@dataclass(frozen=True)
class Command:
    """Anything else that changes the catalog: a verb and its settings."""

    verb: str
    settings: dict = field(default_factory=dict, hash=False)
