"""The functions of the language and how each turns into Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.frame import Points, numeric, value
from ..plans.literals import UNITS, QueryError
from ..plans.syntax import Duration, Item


@dataclass(frozen=True)
class Function:
    """``kind``: aggregate (one value for a group), transform (one for a point) or
    selector (some points). ``build`` makes an aggregate's expression."""

    name: str
    kind: str
    least: int = 0
    most: int = 0
    build: Callable[[Points, Item], Column] | None = None


_registry: dict[str, Function] = {}


def register_function(name: str, kind: str, build: Callable[[Points, Item], Column] | None = None, least: int = 0, most: int = 0) -> None:
    """Makes a function known; ``build(points, item)`` gives an aggregate's Column."""
    _registry[name.lower()] = Function(name.lower(), kind, least, most, build)


def function(item: Item) -> Function:
    found = _registry.get(item.func)
    if found is None:
        raise QueryError(f"unknown function {item.func}()")
    if not found.least <= len(item.args) <= found.most:
        raise QueryError(f"{item.func}() takes {found.least + 1} to {found.most + 1} arguments")
    return found


def unit(item: Item) -> int:
    return item.args[0].ns if item.args and isinstance(item.args[0], Duration) else UNITS["s"]


def whole(item: Item, least: int = 1) -> int:
    n = item.args[0] if item.args else None
    if not isinstance(n, int) or n < least:
        raise QueryError(f"{item.func}() needs a whole number of at least {least}")
    return n


def order() -> Column:
    """Points of a group stand in this order."""
    return F.struct("time_ns", "_key")


def _at_end(v: Column, last: bool) -> Column:
    pick = F.max_by if last else F.min_by
    return pick(v, F.when(v.isNotNull(), order()))


def _ends(p: Points, i: Item) -> tuple[Column, Column, Column]:
    v = numeric(p, i.field)
    return _at_end(v, False), _at_end(v, True), F.count(v)


def _times(p: Points, i: Item) -> Column:
    v = numeric(p, i.field)
    return F.max(F.when(v.isNotNull(), F.col("time_ns"))) - F.min(F.when(v.isNotNull(), F.col("time_ns")))


def _difference(p: Points, i: Item) -> Column:
    first, last, n = _ends(p, i)
    return F.when(n >= 2, last - first)


def _derivative(p: Points, i: Item) -> Column:
    dt = _times(p, i)
    return F.when(dt > 0, _difference(p, i) * F.lit(float(unit(i))) / dt)


def _nonnegative(f: Callable[[Points, Item], Column]) -> Callable[[Points, Item], Column]:
    return lambda p, i: F.when(f(p, i) >= 0, f(p, i))


def _percentile(p: Points, i: Item) -> Column:
    q = i.args[0]
    if isinstance(q, Duration) or not 0 <= q <= 100:
        raise QueryError("percentile() needs a number from 0 to 100")
    return F.percentile(numeric(p, i.field), q / 100)


def _count(p: Points, i: Item) -> Column:
    return F.count_distinct(value(p, i.field)) if i.distinct else F.count(value(p, i.field))


_SCALARS: dict[str, Callable[[Column, Item], Column]] = {
    "abs": lambda v, i: F.abs(v),
    "ceil": lambda v, i: F.ceil(v).cast("double"),
    "floor": lambda v, i: F.floor(v).cast("double"),
    "sqrt": lambda v, i: F.when(v >= 0, F.sqrt(v)),
    "round": lambda v, i: F.bround(v, i.args[0] if i.args else 0),
}


def scalar(item: Item, v: Column) -> Column:
    return _SCALARS[item.func](v, item)


SCALARS = frozenset(_SCALARS)

for _name, _build in {
    "count": _count,
    "sum": lambda p, i: F.sum(numeric(p, i.field)),
    "mean": lambda p, i: F.avg(numeric(p, i.field)),
    "min": lambda p, i: F.min(numeric(p, i.field)),
    "max": lambda p, i: F.max(numeric(p, i.field)),
    "first": lambda p, i: _at_end(value(p, i.field), False),
    "last": lambda p, i: _at_end(value(p, i.field), True),
    "spread": lambda p, i: F.max(numeric(p, i.field)) - F.min(numeric(p, i.field)),
    "stddev": lambda p, i: F.stddev_samp(numeric(p, i.field)),
    "median": lambda p, i: F.percentile(numeric(p, i.field), 0.5),
}.items():
    register_function(_name, "aggregate", _build)
register_function("percentile", "aggregate", _percentile, 1, 1)
register_function("mode", "aggregate")
register_function("distinct", "selector")
register_function("difference", "transform", _difference)
register_function("non_negative_difference", "transform", _nonnegative(_difference))
register_function("derivative", "transform", _derivative, 0, 1)
register_function("non_negative_derivative", "transform", _nonnegative(_derivative), 0, 1)
register_function("cumulative_sum", "transform", lambda p, i: F.sum(numeric(p, i.field)))
register_function("moving_average", "transform", lambda p, i: F.avg(numeric(p, i.field)), 1, 1)
register_function("integral", "transform", None, 0, 1)
register_function("elapsed", "transform", None, 0, 1)
for _name in ("abs", "ceil", "floor", "sqrt"):
    register_function(_name, "transform", lambda p, i: scalar(i, _at_end(numeric(p, i.field), True)))
register_function("round", "transform", lambda p, i: F.bround(_at_end(numeric(p, i.field), True), 0), 0, 1)
for _name in ("top", "bottom", "sample"):
    register_function(_name, "selector", None, 1, 1)
