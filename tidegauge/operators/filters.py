"""WHERE conditions: time bounds for the scan, and a Column for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.literals import QueryError
from ..plans.syntax import Both, Condition, Either, Predicate
from .frame import c


@dataclass(frozen=True)
class Bounds:
    """Inclusive bounds in nanoseconds."""

    low: int | None = None
    high: int | None = None

    def meet(self, other: Bounds) -> Bounds:
        lows, highs = [x for x in (self.low, other.low) if x is not None], [x for x in (self.high, other.high) if x is not None]
        return Bounds(max(lows, default=None), min(highs, default=None))


def branches(condition: Condition) -> list[list[Predicate]]:
    """Disjunctive normal form."""
    if condition is None:
        return [[]]
    if isinstance(condition, Predicate):
        return [[condition]]
    if isinstance(condition, Either):
        return [b for part in condition.parts for b in branches(part)]
    out: list[list[Predicate]] = [[]]
    for part in condition.parts:
        out = [a + b for a in out for b in branches(part)]
    return out


def bounds(condition: Condition) -> Bounds:
    """The time bounds that hold for every branch."""
    out = Bounds()
    for p in branches(condition)[0]:
        if p.value[0] == "time":
            ns = p.value[1]
            out = out.meet({"=": Bounds(ns, ns), ">": Bounds(ns + 1), ">=": Bounds(ns), "<": Bounds(None, ns - 1), "<=": Bounds(None, ns)}[p.op])
    return out


def names(condition: Condition) -> set[str]:
    return {p.name for b in branches(condition) for p in b if p.value[0] != "time"}


def is_field(p: Predicate, tags: tuple[str, ...], fields: dict[str, str]) -> bool:
    return p.value[0] in ("number", "boolean") or p.value[0] != "time" and p.name not in tags and p.name in fields


def check(condition: Condition, tags: tuple[str, ...], fields: dict[str, str]) -> None:
    """All OR branches must agree on their time and field predicates."""
    seen = {frozenset(p for p in b if p.value[0] == "time" or is_field(p, tags, fields)) for b in branches(condition)}
    if len(seen) > 1:
        raise QueryError("the branches of OR must have the same time and field predicates")


def _one(p: Predicate, tags: tuple[str, ...], fields: dict[str, str]) -> Column:
    kind, want = p.value
    if kind == "time":
        return F.lit(True)
    if kind == "boolean":
        if fields.get(p.name) != "boolean":
            return F.lit(False)
        same = c(p.name) == want
        return same if p.op == "=" else ~same
    if kind == "number":
        if fields.get(p.name) not in ("float", "integer", "boolean"):
            return F.lit(False)
        v = c(p.name).cast("int").cast("double") if fields[p.name] == "boolean" else c(p.name).cast("double")
        if p.op in ("=", "!="):
            near = F.abs(v - want) < 1e-9
            return near if p.op == "=" else ~near
        return {">": v > want, ">=": v >= want, "<": v < want, "<=": v <= want}[p.op]
    if p.name not in tags and fields.get(p.name) != "string":
        return F.lit(False)
    v = c(p.name)
    if kind == "regex":
        hit = v.rlike(want)
        return hit if p.op == "=~" else v.isNotNull() & ~hit
    return v == want if p.op == "=" else v.isNotNull() & (v != want)


def column(condition: Condition, tags: tuple[str, ...], fields: dict[str, str]) -> Column | None:
    """The condition on tags and fields; None if there is none. A missing tag or
    field fails every predicate."""
    if condition is None:
        return None
    if isinstance(condition, Predicate):
        return F.coalesce(_one(condition, tags, fields), F.lit(False))
    parts = [x for p in condition.parts if (x := column(p, tags, fields)) is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if isinstance(condition, Both) else out | x
    return out
