"""The frame that all operators work on: ``time_ns``, tag columns, field columns,
``_key`` (the series key) and ``_slice`` helpers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices that an ungrouped line of points is cut into, so that running values
#: need no single task.
SLICES = 256


@dataclass(frozen=True)
class Points:
    """Points of one measurement or subquery."""

    frame: DataFrame
    tags: tuple[str, ...]
    fields: dict[str, str]  # name -> kind

    def with_frame(self, frame: DataFrame) -> Points:
        return Points(frame, self.tags, self.fields)


def c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def series_key(tags: tuple[str, ...] | list[str]) -> Column:
    """``k=v,k2=v2`` in tag order; absent tags are left out."""
    return F.concat_ws(",", *(F.when(c(t).isNotNull(), F.concat(F.lit(f"{t}="), c(t))) for t in sorted(tags))) if tags else F.lit("")


def numeric(points: Points, name: str) -> Column:
    """A field as a double; booleans are 1 and 0, strings and unknown fields null."""
    kind = points.fields.get(name)
    if kind is None or kind == "string":
        return F.lit(None).cast("double")
    return c(name).cast("int").cast("double") if kind == "boolean" else c(name).cast("double")


def value(points: Points, name: str) -> Column:
    return c(name) if name in points.fields else F.lit(None).cast("double")


def sliced(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``_slice``: a number that rises with time and cuts the line into
    at most SLICES parts. With keys there is one slice, for their groups are
    separate already."""
    if keys:
        return df.withColumn("_slice", F.lit(0).cast("long"))
    low, high = df.agg(F.min("time_ns"), F.max("time_ns")).first()
    width = 1 if low is None else (high - low) // SLICES + 1
    return df.withColumn("_slice", F.floor((F.col("time_ns") - F.lit(low or 0)) / F.lit(width)).cast("long"))


def in_slice(keys: list[str]) -> Window:
    return Window.partitionBy(*(c(k) for k in keys), "_slice").orderBy("time_ns", "_key")


def _across(keys: list[str]) -> Window:
    return Window.partitionBy(*(c(k) for k in keys)).orderBy("_slice")


def _joined(df: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """What earlier slices hand on, one small row for each slice and group."""
    names = {k: f"_g{i}" for i, k in enumerate([*keys, "_slice"])}
    starts = starts.select(*(c(k).alias(n) for k, n in names.items()), "_start")
    on = None
    for k, n in names.items():
        same = c(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return df.join(starts if keys else F.broadcast(starts), on, "left").drop(*names.values())


def with_previous(df: DataFrame, keys: list[str], v: Column, name: str) -> DataFrame:
    """Adds ``name``: struct(t, v) of the point before, in the order of (time, key).

    Rows with a null ``v`` must be gone. Ungrouped lines look back within their
    slice, and past its start to the last point of the slices before (at most
    SLICES rows, broadcast).
    """
    here = F.struct(F.col("time_ns").alias("t"), v.alias("v"))
    back = F.lag(here).over(in_slice(keys))
    if keys:
        return df.withColumn(name, back)
    tails = df.groupBy("_slice").agg(F.max_by(here, F.struct("time_ns", "_key")).alias("_tail"))
    starts = tails.withColumn("_start", F.lag("_tail").over(_across([]))).drop("_tail")
    return _joined(df.withColumn(name, back), starts, keys).withColumn(name, F.coalesce(c(name), F.col("_start"))).drop("_start")


def with_running(df: DataFrame, keys: list[str], v: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``v`` up to and with the point, in (time, key) order."""
    here = F.sum(v).over(in_slice(keys).rowsBetween(Window.unboundedPreceding, 0))
    if keys:
        return df.withColumn(name, here)
    sums = df.groupBy("_slice").agg(F.sum(v).alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(_across([]).rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    return _joined(df.withColumn(name, here), starts, keys).withColumn(name, c(name) + F.coalesce("_start", F.lit(0.0))).drop("_start")


def with_index(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name`` (1, 2, ... in (time, key) order) and ``{name}_of``, the count."""
    here = F.row_number().over(in_slice(keys)).cast("long")
    if keys:
        return df.withColumn(name, here).withColumn(f"{name}_of", F.count("*").over(Window.partitionBy(*(c(k) for k in keys))))
    counts = df.groupBy("_slice").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.struct(F.coalesce(F.sum("_n").over(_across([]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("_n").over(Window.partitionBy()).alias("n"))).drop("_n")
    return _joined(df.withColumn(name, here), starts, keys).withColumn(name, c(name) + F.col("_start.b")).withColumn(f"{name}_of", F.col("_start.n")).drop("_start")
