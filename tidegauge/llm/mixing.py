"""Operator 6, mixing sources to target weights along a time-varying curriculum,
in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, stored, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Weight over training time, as (time, weight) knots from 0 to 1; a source takes
#: the schedule of its place in WEIGHTS: early, level, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hex digits of the order key that split a source into independently summed parts.
SPLIT_DIGITS = 3
BROADCAST_SOURCES = 100_000


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``totals`` (source, source_size) with ``place``, ``w`` and ``target``: shares
    of ``share`` * all sizes by weight; no target exceeds ``most`` times its
    source's size, the excess goes to the others by weight.

    Sorted by size per weight, the sources that hit their cap come first, so one
    pass finds the level at which the rest share what the caps leave.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.lit(weights[-1])
    for k, x in enumerate(weights[:-1]):
        w = F.when(F.col("place") % len(weights) == k, x).otherwise(w)
    out = totals.withColumn("place", place).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "place")
    out = out.withColumn("spot", F.row_number().over(by))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    out = out.withColumn("level", (F.lit(share) * everything - before) / after)
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("spot"))
    out = out.withColumn("free", F.min(free).over(Window.partitionBy()))
    out = out.withColumn("level", F.max(F.when(F.col("spot") == F.col("free"), F.col("level"))).over(Window.partitionBy()))
    target = F.when(F.col("free").isNull() | (F.col("spot") < F.col("free")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return out.select("source", "source_size", "place", "w", target.alias("target"))


def _time(schedule: tuple[tuple[float, float], ...], q: Column) -> Column:
    """The time at which the integral of the schedule's weight reaches the share q
    of its whole: the piece that holds q, then the root of its quadratic."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, t1 - t0, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    need, out = q * total, None
    for t0, dt, w0, w1, c0 in reversed(pieces):
        rest = need - c0
        root = t0 + 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) / dt * rest, F.lit(0.0))))
        out = root if out is None else F.when(need < c0 + (dt * (w0 + w1) / 2), root).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, position, position_again)
    for every row of ``docs`` (doc_id, source, text), range-sorted by position.

    A document's size is its number of words (null text: 0). A source is read in
    the order of md5(doc_id), whole and then again from the start, until its target
    is filled; ``taken`` is the words read from the document (the last one may be
    read in part), so each source's sum is its target rounded down and no document
    is taken more than ``most`` = 2 times. ``position`` in [0, 1) is the training
    time at which the first reading starts: the source's cumulative demand is the
    integral of its weight schedule, inverted at the words read before. Documents
    that are never read have no position and come last. Null sources form one
    source, ranked last; null ids are ordered first; ties (repeated rows) are
    interchangeable; empty tables give none; extra columns are ignored.

    Scale: running sums are taken within 4096 parts of each source and added to
    the parts' own running sums, so a hot source is spread over all tasks.
    """
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("key")), "sized")
    part = F.substring("key", 1, SPLIT_DIGITS).alias("part")
    parts = sized.groupBy("source", part).agg(F.sum("size").alias("part_size"))
    goals = stored(targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most), "targets")
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(run), F.lit(0)).alias("part_start"))
    small = goals.count() <= BROADCAST_SOURCES
    starts = starts.withColumnRenamed("source", "s").join(F.broadcast(goals) if small else goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.select("doc_id", "source", "size", "key", part).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = summed.withColumnRenamed("source", "s").withColumnRenamed("part", "p").join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("part")))
    before = F.col("part_start") + F.col("before")
    out = out.withColumn("before", before).withColumn("whole", F.floor("target").cast("long"))

    def read(start: Column) -> Column:
        return F.greatest(F.least(F.col("size"), F.col("whole") - start), F.lit(0).cast("long"))

    def position(start: Column) -> Column:
        q = start / F.col("whole")
        at = _time(schedules[-1], q)
        for k, s in enumerate(schedules[:-1]):
            at = F.when(F.col("place") % len(schedules) == k, _time(s, q)).otherwise(at)
        return F.when(read(start) > 0, at)

    again = F.col("before") + F.col("source_size")
    out = out.select("doc_id", "size", "source", "source_size", "target", (read(F.col("before")) + read(again)).alias("taken"), position(F.col("before")).alias("position"), position(again).alias("position_again"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def _time_sql(schedule, q: str) -> str:
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, t1 - t0, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    out = ""
    for t0, dt, w0, w1, c0 in reversed(pieces):
        rest = f"({q} * {total}::double - {c0}::double)"
        root = f"{t0}::double + 2 * {rest} / ({w0}::double + sqrt(greatest({w0 * w0}::double + {2 * (w1 - w0) / dt}::double * {rest}, 0)))"
        out = root if not out else f"case when {q} * {total}::double < {c0 + dt * (w0 + w1) / 2}::double then {root} else {out} end"
    return out


def mixing_sql(documents: str = "documents") -> str:
    cases = " ".join(f"when {k} then {w}" for k, w in enumerate(WEIGHTS))

    def at(q: str) -> str:
        return "case place % 3 " + " ".join(f"when {k} then {_time_sql(s, q)}" for k, s in enumerate(SCHEDULES)) + " end"

    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, coalesce(md5(doc_id::varchar), '') as key from {documents}),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (select *, row_number() over (order by source nulls last) - 1 as place from totals),
weighed as (select *, case place % 3 {cases} end as w, {MOST} * source_size as cap from placed),
spots as (select *, row_number() over (order by cap / w, place) as spot, sum(source_size) over () as everything from weighed),
levels as (select *, ({SHARE}::double * everything::double - coalesce(sum(cap) over (order by spot rows between unbounded preceding and 1 preceding), 0)::double) / (sum(w) over (order by spot rows between current row and unbounded following))::double as lvl from spots),
freed as (select *, min(case when lvl * w <= cap then spot end) over () as free from levels),
goals as (select *, case when free is null or spot < free then cap::double else (max(case when spot = free then lvl end) over ()) * w end as target from freed),
summed as (select s.doc_id, s.size, g.source_size, g.place, g.target, floor(g.target)::bigint as whole,
  (coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id nulls first, s.size rows between unbounded preceding and 1 preceding), 0))::bigint as before
  from sized s join goals g on s.source is not distinct from g.source),
reads as (select *, greatest(least(size, whole - before), 0) as r1, greatest(least(size, whole - before - source_size), 0) as r2 from summed)
select doc_id, size, source_size, target, (r1 + r2)::bigint as taken,
  case when r1 > 0 then {at("(before::double / whole::double)")} end as position,
  case when r2 > 0 then {at("((before + source_size)::double / whole::double)")} end as position_again
from reads"""


assert all(math.isclose(s[0][0], 0) and math.isclose(s[-1][0], 1) for s in SCHEDULES)
