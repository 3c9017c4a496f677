"""SELECT statements to lazy DataFrames: scan, filter, group or transform, fill,
order and page. Catalyst plans the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import SCALARS, function, order, scalar, unit, whole
from ..operators import filters
from ..operators.fill import filled
from ..operators.filters import Bounds
from ..operators.frame import Points, c, numeric, series_key, sliced, value, with_index, with_previous, with_running
from .literals import KINDS, QueryError
from .syntax import Item, Name, Select

Source = Callable[[Name, Bounds, set[str] | None], Points]


@dataclass(frozen=True)
class Planned:
    """A result: ``time`` (ns), then tag columns, then values. ``series`` are the
    tags that tell its series apart."""

    frame: DataFrame
    name: str
    series: tuple[str, ...]
    tags: tuple[str, ...]
    columns: tuple[str, ...]


def _points(s: Select, source: Source, outer: Bounds) -> tuple[Points, str, Bounds]:
    held = filters.bounds(s.where).meet(outer)
    if isinstance(s.source, Select):
        inner = plan(s.source, source, held)
        kinds = {x: KINDS.get(t.split("(")[0], "float") for x, t in inner.frame.dtypes}
        tags = tuple(dict.fromkeys([*inner.series, *inner.tags]))
        p = Points(inner.frame.withColumnRenamed("time", "time_ns"), tags, {x: kinds[x] for x in inner.columns if x not in tags})
        name = inner.name
    else:
        wanted = None if any(i.field == "*" for i in s.items) else {i.field for i in s.items} | filters.names(s.where)
        p = source(s.source, held, wanted)
        name = s.source.measurement
    filters.check(s.where, p.tags, p.fields)
    df = p.frame
    if held.low is not None:
        df = df.where(F.col("time_ns") >= F.lit(held.low))
    if held.high is not None:
        df = df.where(F.col("time_ns") <= F.lit(held.high))
    if (cond := filters.column(s.where, p.tags, p.fields)) is not None:
        df = df.where(cond)
    return p.with_frame(df.withColumn("_key", series_key(p.tags))), name, held


def plan(s: Select, source: Source, outer: Bounds = Bounds()) -> Planned:
    p, name, held = _points(s, source, outer)
    series = tuple(sorted(p.tags)) if s.all_tags else s.tags
    s = replace(s, items=_expanded(s.items, p))
    plain = [i.func is None for i in s.items]
    if any(plain) and not all(plain):
        raise QueryError("fields and functions can't be mixed in one SELECT")
    if all(plain):
        if s.every:
            raise QueryError("GROUP BY time() needs a function")
        return _paged(_raw(s, p, name, series), s)
    if s.items[0].func == "distinct":
        return _paged(_distinct(s, p, name, series), s)
    for i in s.items:
        function(i)
        if i.field == "*":
            raise QueryError(f"{i.func}(*) isn't supported; name a field")
    out = _grouped(s, p, name, series) if s.grouped else _ungrouped(s, p, name)
    if s.every and s.fill is not None and held.low is not None and held.high is not None and not _selects(s):
        out = replace(out, frame=filled(out.frame, list(series), list(out.columns), s.every, held.low, held.high, s.fill))
    return _paged(out, s)


def _expanded(items: tuple[Item, ...], p: Points) -> tuple[Item, ...]:
    """``count(*)`` counts every field; names come out sorted."""
    out: list[Item] = []
    for i in items:
        out += [Item(f, "count") for f in sorted(p.fields)] if i.func == "count" and i.field == "*" and not i.distinct else [i]
    names = [i.alias for i in out]
    return tuple(i for k, i in enumerate(out) if names.index(i.alias) == k)


def _selects(s: Select) -> bool:
    return any(function(i).kind == "selector" for i in s.items)


# --- points ----------------------------------------------------------------


def _raw(s: Select, p: Points, name: str, series: tuple[str, ...]) -> Planned:
    tags = tuple(sorted(p.tags))
    fields: list[str] = []
    for i in s.items:
        fields += sorted(p.fields) if i.field == "*" else [i.field]
    fields = [f for f in dict.fromkeys(fields) if f not in tags]
    df = p.frame
    if fields:
        df = df.where(F.coalesce(*(F.when(value(p, f).isNotNull(), True) for f in fields)))
    absent = [F.lit(None).cast("string").alias(t) for t in series if t not in tags]
    df = df.select(F.col("time_ns").alias("time"), *(c(t) for t in tags), *absent, *(value(p, f).alias(f) for f in fields), "_key")
    return Planned(df, name, series, tags, tuple(fields))


def _distinct(s: Select, p: Points, name: str, series: tuple[str, ...]) -> Planned:
    """The first point of each value; it keeps its time and tags."""
    if len(s.items) > 1 or s.every:
        raise QueryError("distinct() stands alone, without GROUP BY time()")
    f, tags = s.items[0].field, tuple(sorted(p.tags))
    groups = [F.coalesce(c(t), F.lit("")) if t in p.tags else F.lit("") for t in series]
    w = Window.partitionBy(*groups, value(p, f)).orderBy("time_ns", "_key")
    df = p.frame.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    absent = [F.lit(None).cast("string").alias(t) for t in series if t not in tags]
    return Planned(df.select(F.col("time_ns").alias("time"), *(c(t) for t in tags), *absent, value(p, f).alias(f), "_key"), name, series, tags, (f,))


def _pass(p: Points, f: str, items: list[Item], keys: list[str]) -> DataFrame:
    """Point transforms and selectors of one field in one pass: ``_keys``, time,
    _key and a column for each item."""
    df = p.frame.withColumn("_v", numeric(p, f)).where("_v is not null").select("time_ns", "_key", "_v", *(c(k) for k in keys))
    df = sliced(df, keys)
    v, t = F.col("_v"), F.col("time_ns")
    if any(i.func in ("difference", "non_negative_difference", "derivative", "non_negative_derivative", "integral", "elapsed") for i in items):
        df = with_previous(df, keys, v, "_before")
    if any(i.func in ("moving_average", "sample") for i in items):
        df = with_index(df, keys, "_at")
    made: list[Column] = []
    for n, i in enumerate(items):
        pv, pt = F.col("_before.v") if "_before" in df.columns else None, F.col("_before.t") if "_before" in df.columns else None
        if i.func in SCALARS:
            x = scalar(i, v)
        elif i.func.endswith("difference"):
            x = v - pv
        elif i.func.endswith("derivative"):
            x = F.when(t > pt, (v - pv) * F.lit(float(unit(i))) / (t - pt))
        elif i.func == "elapsed":
            x = (t - pt) / F.lit(1e9)
        elif i.func == "cumulative_sum":
            df = with_running(df, keys, v, f"_x{n}")
            x = c(f"_x{n}")
        elif i.func == "integral":
            area = F.when(t > pt, (v + pv) / 2 * (t - pt) / F.lit(float(unit(i))))
            df = with_running(df, keys, F.coalesce(area, F.lit(0.0)), f"_x{n}")
            x = F.when(pt.isNotNull(), c(f"_x{n}"))  # a point at the time of the one before adds nothing and has its row
        elif i.func == "moving_average":
            df = _moving(df, keys, whole(i), f"_x{n}")
            x = c(f"_x{n}")
        elif i.func in ("top", "bottom"):
            best = v.desc() if i.func == "top" else v.asc()
            w = Window.partitionBy(*(c(k) for k in keys)).orderBy(best, "time_ns", "_key")
            if not keys and len(items) == 1:
                return df.orderBy(best, "time_ns", "_key").limit(whole(i)).select("time_ns", "_key", v.alias(i.alias))
            df = df.withColumn(f"_x{n}", F.when(F.row_number().over(w) <= whole(i), v))
            x = c(f"_x{n}")
        elif i.func == "sample":
            x = F.when(_sampled(whole(i)), v)
        else:
            raise QueryError(f"{i.func}() isn't a transform")
        if i.func.startswith("non_negative"):
            x = F.when(x >= 0, x)
        made.append(x.alias(i.alias))
    out = df.select("time_ns", "_key", *(c(k) for k in keys), *made)
    return out.where(F.coalesce(*(F.when(c(i.alias).isNotNull(), True) for i in items)))


def _sampled(k: int) -> Column:
    """Whether a point is one of k that are evenly spaced by index, ends included."""
    step = (F.col("_at_of") - 1) / max(1, k - 1)
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.round(j * step).cast("long"))
    return (F.col("_at_of") <= k) | F.array_contains(spots, F.col("_at") - 1)


def _moving(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The mean of the last n points, from the n-th on. Points are dealt into blocks
    by their index, each with the n - 1 points before it."""
    if keys:
        w = Window.partitionBy(*(c(k) for k in keys)).orderBy("_at").rowsBetween(1 - n, 0)
        return df.withColumn(name, F.when(F.col("_at") >= n, F.avg("_v").over(w)))
    size = max(4 * n, 65_536)
    block = F.floor((F.col("_at") - 1) / size)
    last = F.floor((F.col("_at") + n - 2) / size)
    dealt = df.withColumn("_block", F.explode(F.sequence(block, last)))
    w = Window.partitionBy("_block").orderBy("_at").rowsBetween(1 - n, 0)
    out = dealt.withColumn(name, F.when(F.col("_at") >= n, F.avg("_v").over(w)))
    return out.where(F.col("_block") == block).drop("_block")


# --- groups ----------------------------------------------------------------


def _aggregated(p: Points, items: list[Item], keys: list[str], every: int | None) -> DataFrame:
    """One row for each group: ``keys``, ``time`` and a column for each item."""
    df, made = p.frame, []
    by = [*keys, *(["_bucket"] if every else [])]
    p = p.with_frame(df)
    for n, i in enumerate(items):
        f = function(i)
        if i.func == "elapsed":
            raise QueryError("elapsed() isn't an aggregate; leave out GROUP BY")
        if i.func == "integral":
            v = numeric(p, i.field)
            w = Window.partitionBy(*(c(k) for k in by)).orderBy("time_ns", "_key").rowsBetween(Window.unboundedPreceding, -1)
            back = F.last(F.when(v.isNotNull(), F.struct(F.col("time_ns").alias("t"), v.alias("v"))), True).over(w)
            df = df.withColumn(f"_i{n}", back)
            pt, pv = c(f"_i{n}")["t"], c(f"_i{n}")["v"]
            area = F.when(F.col("time_ns") > pt, (v + pv) / 2 * (F.col("time_ns") - pt) / F.lit(float(unit(i))))
            made.append(F.when(F.count(v) > 0, F.coalesce(F.sum(area), F.lit(0.0))).alias(i.alias))
        elif i.func != "mode":
            made.append(f.build(p, i).alias(i.alias))
    lone = len(items) == 1 and items[0].func == "first" and not every
    time = F.coalesce(F.min(F.when(value(p, items[0].field).isNotNull(), F.col("time_ns"))), F.max("time_ns")) if lone else F.max("time_ns")
    out = df.groupBy(*(c(k) for k in by)).agg(time.alias("_time"), F.count("*").alias("_points"), *made).where("_points > 0").drop("_points")
    for i in items:
        if i.func == "mode":
            v = value(p, i.field)
            each = df.where(v.isNotNull()).groupBy(*(c(k) for k in by), v.alias("_v")).agg(F.count("*").alias("_n"), F.min(order()).alias("_first"))
            often = F.struct(F.col("_n"), -F.col("_first.time_ns"))
            mode = each.groupBy(*(c(k) for k in by)).agg(F.max_by("_v", often).alias(i.alias)).toDF(*(f"_m{n}" for n in range(len(by))), i.alias)
            on = F.lit(True)
            for n, k in enumerate(by):
                on = on & c(k).eqNullSafe(F.col(f"_m{n}"))
            out = out.join(mode if by else F.broadcast(mode), on, "left").drop(*(f"_m{n}" for n in range(len(by))))
    return out.withColumnRenamed("_bucket", "time").drop("_time") if every else out.withColumnRenamed("_time", "time")


def _grouped(s: Select, p: Points, name: str, series: tuple[str, ...]) -> Planned:
    df = p.frame
    for t in series:
        df = df.withColumn(f"_g_{t}", F.coalesce(c(t), F.lit("")) if t in p.tags else F.lit(""))
    if s.every:
        df = df.withColumn("_bucket", F.expr(f"time_ns div {s.every} * {s.every}"))
    p, keys = p.with_frame(df), [f"_g_{t}" for t in series]
    names = [i.alias for i in s.items]
    if not _selects(s):
        out = _aggregated(p, list(s.items), keys, s.every)
        out = out.select("time", *(c(k).alias(t) for k, t in zip(keys, series, strict=True)), *(c(n) for n in names))
        return Planned(out, name, series, (), tuple(names))
    # Selectors give some points; a single value stands at its bucket's start.
    by = [*keys, *(["_bucket"] if s.every else [])]
    parts: list[DataFrame] = []
    for f in dict.fromkeys(i.field for i in s.items):
        if chosen := [i for i in s.items if i.field == f and function(i).kind == "selector"]:
            parts.append(_pass(p, f, chosen, by).drop("_bucket").withColumnRenamed("time_ns", "time"))
    if rest := [i for i in s.items if function(i).kind != "selector"]:
        parts.append(_aggregated(p, rest, keys, s.every).withColumn("_key", F.lit("")))
    return Planned(_merged(parts, keys, series, names), name, series, (), tuple(names))


def _merged(parts: list[DataFrame], keys: list[str], series: tuple[str, ...], names: list[str]) -> DataFrame:
    """Rows of equal group, time and key put together."""
    on = [*keys, "time", "_key"]
    rows = None
    for part in parts:
        part = part.select(*(c(k) for k in on), *(c(n) if n in part.columns else F.lit(None).cast("double").alias(n) for n in names))
        rows = part if rows is None else rows.unionByName(part)
    if len(parts) > 1:
        rows = rows.groupBy(*(c(k) for k in on)).agg(*(F.max(c(n)).alias(n) for n in names))
    return rows.select("time", *(c(k).alias(t) for k, t in zip(keys, series, strict=True)), *(c(n) for n in names), "_key")


def _ungrouped(s: Select, p: Points, name: str) -> Planned:
    names = [i.alias for i in s.items]
    kinds = {i: function(i).kind for i in s.items}
    aggregates = [i for i in s.items if kinds[i] == "aggregate"]
    if len(aggregates) == len(s.items):
        out = _aggregated(p, aggregates, [], None)
        return Planned(out.select("time", *(c(n) for n in names)), name, (), (), tuple(names))
    parts = []
    for f in dict.fromkeys(i.field for i in s.items if kinds[i] != "aggregate"):
        parts.append(_pass(p, f, [i for i in s.items if i.field == f and kinds[i] != "aggregate"], []).withColumnRenamed("time_ns", "time"))
    if aggregates:
        parts.append(_aggregated(p, aggregates, [], None).withColumn("_key", F.lit("")))
    return Planned(_merged(parts, [], (), names), name, (), (), tuple(names))


# --- order and pages -------------------------------------------------------


def _paged(out: Planned, s: Select) -> Planned:
    df = out.frame
    tie = ["_key"] if "_key" in df.columns else []
    by_time = F.col("time").desc() if s.descending else F.col("time").asc()
    keys = [F.coalesce(c(t), F.lit("")) for t in out.series]
    if out.series and (s.limit is not None or s.offset):
        w = Window.partitionBy(*keys).orderBy(by_time, *tie)
        df = df.withColumn("_row", F.row_number().over(w))
        if s.limit is not None:
            df = df.where(F.col("_row") <= s.limit + s.offset)
        df = df.where(F.col("_row") > s.offset).drop("_row")
    if out.series and (s.slimit is not None or s.soffset):
        chosen = df.select(*(k.alias(f"_s{n}") for n, k in enumerate(keys))).distinct().orderBy(*(f"_s{n}" for n in range(len(keys))))
        chosen = chosen.offset(s.soffset) if s.soffset else chosen
        chosen = chosen.limit(s.slimit) if s.slimit is not None else chosen
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & (k == F.col(f"_s{n}"))
        df = df.join(chosen, on, "left_semi")
    elif s.soffset or s.slimit == 0:
        df = df.where(F.lit(False))
    df = df.orderBy(*keys, by_time, *tie)
    if not out.series:
        df = df.offset(s.offset) if s.offset else df
        df = df.limit(s.limit) if s.limit is not None else df
    return replace(out, frame=df.drop("_key"))
