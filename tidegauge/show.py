"""SHOW statements as DataFrames."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import filters
from .operators.frame import c, series_key
from .plans.literals import QueryError, duration_text, instant_text
from .plans.syntax import Name, Show


def _known(engine, db: str) -> dict[str, tuple[list[str], dict[str, str]]]:
    """Tags and fields of each measurement, over all policies."""
    out: dict[str, tuple[list[str], dict[str, str]]] = {}
    for name, found in engine.catalog.measurements(db).items():
        for m in found:
            tags, fields = out.setdefault(name, ([], {}))
            tags += [t for t in m["tags"] if t not in tags]
            fields |= m["fields"]
    for (own, _, name), e in engine.external.items():
        if own == db:
            tags, fields = out.setdefault(name, ([], {}))
            tags += [t for t in e.points.tags if t not in tags]
            fields |= e.points.fields
    return dict(sorted(out.items()))


def _sources(engine, db: str, name: str) -> list[Name]:
    policies = [rp for rp, by_name in engine.catalog.database(db)["measurements"].items() if name in by_name]
    policies += [rp for (own, rp, n) in engine.external if own == db and n == name]
    return [Name(name, rp, db) for rp in dict.fromkeys(policies)]


def _matching(engine, db: str, name: str, where) -> list[tuple[DataFrame, tuple[str, ...]]]:
    """The points that the condition lets through, one frame for each policy."""
    out = []
    for source in _sources(engine, db, name):
        held = filters.bounds(where)
        p = engine.points(db, source, held, filters.names(where))
        df = p.frame
        if held.low is not None:
            df = df.where(F.col("time_ns") >= held.low)
        if held.high is not None:
            df = df.where(F.col("time_ns") <= held.high)
        if (cond := filters.column(where, p.tags, p.fields)) is not None:
            df = df.where(cond)
        out.append((df, p.tags))
    return out


def _union(frames: list[DataFrame], engine, schema: str) -> DataFrame:
    out = engine.spark.createDataFrame([], schema)
    for f in frames:
        out = out.union(f)
    return out


def _series(engine, db: str, names: list[str], where, with_name: bool) -> DataFrame:
    frames = []
    for name in names:
        for df, tags in _matching(engine, db, name, where):
            key = series_key(tags)
            if with_name:
                key = F.when(key == "", F.lit(name)).otherwise(F.concat(F.lit(name + ","), key))
            frames.append(df.select(key.alias("key")).distinct())
    return _union(frames, engine, "key string").distinct()


def _tag_values(engine, db: str, names: list[str], key: str | None, where) -> DataFrame:
    frames = []
    for name in names:
        for df, tags in _matching(engine, db, name, where):
            for t in tags if key is None else [t for t in tags if t == key]:
                frames.append(df.where(c(t).isNotNull()).select(F.lit(t).alias("key"), c(t).alias("value")).distinct())
    return _union(frames, engine, "key string, value string").distinct()


def show(engine, s: Show, db: str) -> DataFrame:
    """The frame that answers ``s``; rows are in order of their first columns."""
    make = engine.spark.createDataFrame
    what = s.what
    if what == "databases":
        return make([(n,) for n in sorted(engine.catalog.state["databases"])], "name string")
    if what == "queries":
        rows = [(q["qid"], q["query"], q["database"], f"{time.time() - q['started']:.3f}s") for q in engine._running.values()]
        return make(rows, "qid bigint, query string, database string, duration string")
    if what == "diagnostics":
        rows = [("engine", "tidegauge"), ("spark", engine.spark.version), ("parallelism", str(engine.spark.sparkContext.defaultParallelism)), ("root", engine.folder.root if engine.folder else "")]
        return make(rows, "key string, value string")
    if what == "retention policies":
        rows = [(n, duration_text(p["duration"]), p["replication"], p["default"]) for n, p in sorted(engine.catalog.database(s.db or db)["policies"].items())]
        return make(rows, "name string, duration string, replicaN bigint, `default` boolean")
    if what == "continuous queries":
        rows = []
        for own, d in sorted(engine.catalog.state["databases"].items()):
            for n, q in sorted(d["queries"].items()):
                rows.append((own, n, q["text"], duration_text(q["every"]), duration_text(q["for"]) if q["for"] else None, q["recompute"], instant_text(q["last"]) if q["last"] is not None else None))
        return make(rows, "database string, name string, query string, every string, `for` string, recompute bigint, lastRun string")
    if what in ("shards", "shard groups"):
        shards = [x for x in engine.shards() if s.db in (None, x["database"])]
        if what == "shards":
            rows = [(x["id"], x["database"], x["retention_policy"], instant_text(x["start"]), instant_text(x["end"]), duration_text(x["duration"])) for x in shards]
            return make(rows, "id bigint, database string, retention_policy string, start_time string, end_time string, expiry string")
        rows = [(x["id"], x["database"], x["retention_policy"], instant_text(x["start"]), instant_text(x["end"])) for x in shards]
        return make(rows, "id bigint, database string, retention_policy string, start_time string, end_time string")
    known = _known(engine, db)
    if what == "stats":
        if s.topic in known:
            rows = [("fields", len(known[s.topic][1])), ("tags", len(known[s.topic][0])), ("series", _series(engine, db, [s.topic], None, True).count())]
        elif s.topic == "indexes":
            rows = [("measurements", len(known)), ("series", _series(engine, db, list(known), None, True).count())]
        else:
            rows = [("queries", engine.metrics.queries), ("errors", engine.metrics.errors), ("pointsWritten", engine.metrics.points_written), ("running", len(engine._running))]
        return make([(k, str(v)) for k, v in rows], "stat string, value string")
    names = list(known)
    if s.source is not None:
        names = [n for n in names if n == s.source.measurement]
    if s.measurement:
        op, want = s.measurement
        names = [n for n in names if (n == want if op == "=" else re.search(want, n))]
    if what == "measurements":
        if s.where is not None:
            names = [n for n in names if any(df.limit(1).count() for df, _ in _matching(engine, db, n, s.where))]
        return make([(n,) for n in names], "name string")
    if what == "measurement cardinality":
        return make([(len(names),)], "count bigint")
    if what in ("field keys", "field key cardinality"):
        rows = sorted({(f, k) for n in names for f, k in known[n][1].items()})
        return make([(len({f for f, _ in rows}),)], "count bigint") if what.endswith("cardinality") else make(rows, "fieldKey string, fieldType string")
    if what in ("tag keys", "tag key cardinality"):
        if s.where is not None:
            names = [n for n in names if any(df.limit(1).count() for df, _ in _matching(engine, db, n, s.where))]
        rows = sorted({(t,) for n in names for t in known[n][0]})
        return make([(len(rows),)], "count bigint") if what.endswith("cardinality") else make(rows, "tagKey string")
    if what == "tag values":
        if s.key is None:
            raise QueryError("SHOW TAG VALUES needs WITH KEY =")
        return _tag_values(engine, db, names, s.key, s.where).orderBy("key", "value")
    if what == "tag values cardinality":
        return _tag_values(engine, db, names, s.key, s.where).agg(F.count("*").alias("count"))
    if what == "series":
        return _series(engine, db, names, s.where, s.source is not None).orderBy("key")
    if what == "series cardinality":
        return _series(engine, db, names, s.where, True).agg(F.count("*").alias("count"))
    raise QueryError(f"unknown SHOW {what}")
