"""Gap filling over the grid of time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frame import c


def bucket_start(ns: int, every: int) -> int:
    """As Spark's ``div``, this truncates towards zero."""
    return (ns // every if ns >= 0 else -(-ns // every)) * every


def filled(df: DataFrame, keys: list[str], values: list[str], every: int, low: int, high: int, mode: object) -> DataFrame:
    """``df`` (time, keys, values) with a row for every bucket from low to high of
    every group that has one. Existing rows stay as they are, nulls included."""
    first, last = (bucket_start(x, every) for x in (low, high))
    groups = df.select(*(c(k) for k in keys)).distinct() if keys else df.limit(1).select(F.lit(1).alias("_one"))
    grid = groups.withColumn("time", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(every)))) if first <= last else groups.withColumn("time", F.lit(first)).where(F.lit(False))
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "time"])}
    have = df.select(*(c(k).alias(n) for k, n in names.items()), *(c(v) for v in values), F.lit(True).alias("_present"))
    on = None
    for k, n in names.items():
        same = c(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    out = grid.join(have, on, "left").drop(*names.values())
    back = Window.partitionBy(*(c(k) for k in keys)).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*(c(k) for k in keys)).orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    new = []
    for v in values:
        if mode == "null":
            made = F.lit(None)
        elif mode == "previous":
            made = F.last(F.when(F.col("_present"), F.struct(c(v).alias("v"))), True).over(back)["v"]
        elif mode == "linear":
            point = F.when(F.col("_present") & c(v).isNotNull(), F.struct(F.col("time").alias("t"), c(v).cast("double").alias("v")))
            a, b = F.last(point, True).over(back), F.first(point, True).over(ahead)
            made = a["v"] + (b["v"] - a["v"]) * (F.col("time") - a["t"]) / (b["t"] - a["t"])
        else:
            made = F.lit(float(mode)).cast(df.schema[v].dataType)
        new.append(F.when(F.col("_present"), c(v)).otherwise(made).alias(v))
    return out.select("time", *(c(k) for k in keys), *new)
