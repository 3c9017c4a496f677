"""The engine: writes points, and answers statements with DataFrames."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import filters
from .operators.filters import Bounds
from .operators.frame import Points, c, series_key
from .plans.literals import KINDS, PRECISIONS, SPARK_TYPES, QueryError, instant_text
from .plans.parser import Tokens, condition, parse
from .plans.planner import Planned, plan
from .plans.syntax import Command, Delete, Explain, Item, Name, Select, Show
from .sources import line_protocol, store


@dataclass
class Limits:
    """0 is no limit."""

    rows: int = 100_000
    points: int = 0
    seconds: float = 0
    series: int = 10_000_000


@dataclass
class External:
    """A frame registered as a measurement: its points and how to prune its source."""

    points: Points
    prune: Callable[[Bounds], list] | None
    unique: bool


@dataclass
class Report:
    query: str
    seconds: float = 0.0
    rows: int = 0
    plan: str = ""
    error: str | None = None


@dataclass
class Metrics:
    queries: int = 0
    errors: int = 0
    points_written: int = 0
    seconds: float = 0.0
    buckets: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("0.005", "0.01", "0.05", "0.1", "0.5", "1", "5", "+Inf"), 0))
    continuous: dict[str, dict] = field(default_factory=dict)

    def took(self, seconds: float) -> None:
        self.queries, self.seconds = self.queries + 1, self.seconds + seconds
        for edge in self.buckets:
            self.buckets[edge] += seconds <= float(edge.replace("+Inf", "inf"))

    def prometheus(self) -> str:
        lines = [f"tidegauge_queries_total {self.queries}", f"tidegauge_query_errors_total {self.errors}", f"tidegauge_points_written_total {self.points_written}"]
        lines += [f'tidegauge_query_seconds_bucket{{le="{e}"}} {n}' for e, n in self.buckets.items()]
        lines += [f"tidegauge_query_seconds_sum {self.seconds}", f"tidegauge_query_seconds_count {self.queries}"]
        for name, m in self.continuous.items():
            lines += [f'tidegauge_cq_{k}{{cq="{name}"}} {v}' for k, v in sorted(m.items())]
        return "\n".join(lines) + "\n"


def _leaves(tree) -> list:
    """The source nodes of a logical plan."""
    found = tree.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


class Engine:
    """``root`` is a folder that the driver and all executors see; without one the
    engine holds registered frames only. ``now`` gives the time in ns."""

    def __init__(self, spark: SparkSession, root: str | None = None, now: Callable[[], int] = time.time_ns, limits: Limits | None = None) -> None:
        self.spark, self.now, self.limits = spark, now, limits or Limits()
        self.folder = store.Folder(spark, root) if root else None
        self.catalog = Catalog(self.folder)
        self.external: dict[tuple[str, str, str], External] = {}
        self.metrics, self.last_report = Metrics(), None
        self._running: dict[int, dict] = {}
        self._ids, self._lock = 0, threading.RLock()

    # --- measurements ------------------------------------------------------

    def register(self, db: str, name: str, df: DataFrame, time_col: str, tags: list[str], fields: list[str] | None = None, rp: str = "autogen", unique: bool = False, order: list[str] | None = None) -> None:
        """Makes a frame a measurement. ``time_col`` is a timestamp or whole ns. Where
        (tags, time) isn't unique, the last row in ``order`` wins, field by field."""
        self.catalog.create_database(db)
        kind = dict(df.dtypes)[time_col]
        native = c(time_col)
        if kind.startswith("timestamp"):
            stamp = native.cast("timestamp")
            zone = self.spark.conf.get("spark.sql.session.timeZone")
            if kind == "timestamp_ntz" and zone not in ("UTC", "Etc/UTC"):
                stamp = F.from_utc_timestamp(F.to_utc_timestamp(stamp, zone), zone)
            ns = F.unix_micros(stamp) * 1000
        else:
            ns = native.cast("long")
        fields = fields if fields is not None else [x for x in df.columns if x != time_col and x not in tags]
        kinds = {f: KINDS[t] for f, t in df.dtypes if f in fields and t in KINDS}
        shown = df.select(ns.alias("time_ns"), *(c(t).cast("string").alias(t) for t in tags), *(c(f).cast(SPARK_TYPES[k]).alias(f) for f, k in kinds.items() if f not in tags), native.alias("_native"), F.struct(*(c(o) for o in order)).alias("_order") if order else F.lit(0).alias("_order"))

        def prune(b: Bounds) -> list:
            if not kind.startswith("timestamp"):
                return []
            made = []
            for ns_at, up in ((b.low, False), (b.high, True)):
                if ns_at is not None and abs(ns_at) < 8_000_000_000_000_000_000:
                    micros = ns_at // 1000 + (1 if up else 0)
                    text = instant_text(micros * 1000)[:26].replace("T", " ")
                    at = F.expr(f"timestamp_ntz'{text}'") if kind == "timestamp_ntz" else F.timestamp_micros(F.lit(micros))
                    made.append(F.col("_native") <= at if up else F.col("_native") >= at)
            return made

        self.external[db, rp, name] = External(Points(shown, tuple(tags), {f: k for f, k in kinds.items() if f not in tags}), prune, unique)

    def points(self, db: str, name: Name, held: Bounds = Bounds(), wanted: set[str] | None = None) -> Points:
        """The merged points of a measurement within time bounds; ``wanted`` limits
        the fields that are read."""
        db = name.db or db
        rp = name.rp or (self.catalog.default_policy(db) if db in self.catalog.state["databases"] else "autogen")
        if (found := self.external.get((db, rp, name.measurement))) is not None:
            p = found.points
            df = p.frame
            for x in found.prune(held):
                df = df.where(x)
            fields = {f: k for f, k in p.fields.items() if wanted is None or f in wanted}
            if not found.unique:
                cols = [F.max_by(c(f), F.when(c(f).isNotNull(), F.col("_order"))).alias(f) for f in fields]
                if held.low is not None:
                    df = df.where(F.col("time_ns") >= F.lit(held.low))
                if held.high is not None:
                    df = df.where(F.col("time_ns") <= F.lit(held.high))
                df = df.groupBy("time_ns", *(c(t) for t in p.tags)).agg(*cols, F.count("*").alias("_n")).drop("_n")
            return Points(df.select("time_ns", *(c(t) for t in p.tags), *(c(f) for f in fields)), p.tags, p.fields)
        m = self.catalog.measurement(db, rp, name.measurement) if self.folder else None
        if m is None:
            return Points(self.spark.createDataFrame([], "time_ns bigint"), (), {})
        return Points(self._stored(db, rp, name.measurement, m, held, wanted), tuple(m["tags"]), dict(m["fields"]))

    def _path(self, db: str, rp: str, name: str) -> str:
        """Where a measurement's files are: in the folder of its last compaction."""
        version = (self.catalog.measurement(db, rp, name) or {}).get("version", 0)
        return self.folder.at("data", db, rp, name, f"v{version}")

    def _shard_ns(self, db: str, rp: str) -> int:
        return self.catalog.database(db)["policies"][rp]["shard"]

    def _written(self, db: str, rp: str, name: str, m: dict, held: Bounds = Bounds()) -> DataFrame:
        """Points as written, without those that were deleted."""
        tags, fields = m["tags"], m["fields"]
        if not self.folder.exists(self._path(db, rp, name)):
            return self.spark.createDataFrame([], store.schema(tags, fields))
        df = self.spark.read.schema(store.schema(tags, fields)).parquet(self._path(db, rp, name))
        shard = self._shard_ns(db, rp)
        if held.low is not None:
            df = df.where((F.col("_shard") >= F.lit(held.low // shard * shard)) & (F.col("time_ns") >= F.lit(held.low)))
        if held.high is not None:
            df = df.where((F.col("_shard") <= F.lit(held.high // shard * shard)) & (F.col("time_ns") <= F.lit(held.high)))
        for d in m["deleted"]:
            gone = F.col("_batch") <= F.lit(d["batch"])
            if d.get("series"):
                series = self.spark.read.parquet(d["series"])
                keyed = df.withColumn("_s", series_key(tags)).withColumn("_old", gone)
                df = keyed.join(series, (keyed["_s"] == series["key"]) & keyed["_old"], "left_anti").drop("_s", "_old")
                continue
            if d.get("where"):
                tree = condition(Tokens(d["where"]), lambda at=d["now"]: at)
                held_by = filters.bounds(tree)
                for ns, up in ((held_by.low, False), (held_by.high, True)):
                    if ns is not None:
                        gone = gone & (F.col("time_ns") <= F.lit(ns) if up else F.col("time_ns") >= F.lit(ns))
                rest = filters.column(tree, tuple(tags), fields)
                gone = gone & rest if rest is not None else gone
            df = df.where(~gone)
        return df

    def _stored(self, db: str, rp: str, name: str, m: dict, held: Bounds, wanted: set[str] | None) -> DataFrame:
        """Points merged by last write. A shard that nothing was written to since its
        measurement was compacted holds each point once, and is read without a merge."""
        fields = [f for f in m["fields"] if f not in m["tags"] and (wanted is None or f in wanted)]
        df = self._written(db, rp, name, m, held)
        if "fresh" not in m:
            return store.merged(df, m["tags"], fields)
        once = df.select("time_ns", *(c(t) for t in m["tags"]), *(c(f) for f in fields))
        if not m["fresh"]:
            return once
        fresh = F.col("_shard").isin(m["fresh"])
        return once.where(~fresh).unionByName(store.merged(df.where(fresh), m["tags"], fields))

    # --- writing -----------------------------------------------------------

    def write_lines(self, lines: str | DataFrame, db: str, rp: str | None = None, precision: str = "ns") -> int:
        """Writes line protocol: a text, or a frame with column ``value`` (as from
        ``spark.read.text``, gzip included). Nothing is written if a line is no point
        or a field changes its kind. Returns the number of points."""
        if isinstance(lines, str):
            rows = [(x, n) for n, x in enumerate(lines.split("\n"))]
            df = self.spark.createDataFrame(rows, "value string, line bigint")
        else:
            df = lines.select("value").withColumn("line", F.monotonically_increasing_id())
        return self._write(line_protocol.parsed(df, precision, self.now() // 1_000_000 * 1_000_000), db, rp)

    def _write(self, points: DataFrame, db: str, rp: str | None) -> int:
        with self._lock:
            staged = self.folder.at("staging", uuid.uuid4().hex)
            points.write.parquet(staged)
            try:
                return self._commit(self.spark.read.schema(line_protocol.SCHEMA).parquet(staged), db, rp)
            finally:
                self.folder.remove(staged)

    def _commit(self, points: DataFrame, db: str, rp: str | None) -> int:
        if bad := points.where("error is not null").orderBy("line").select("error").first():
            raise QueryError(bad.error)
        keys = points.select("measurement", F.explode_outer(F.map_keys("tags")).alias("tag")).distinct().collect()
        kinds = points.select("measurement", F.explode("fields").alias("f", "v")).select("measurement", "f", "v.kind").distinct().collect()
        names = sorted({r.measurement for r in keys})
        if not names:
            return 0
        self.catalog.create_database(db)
        rp = rp or self.catalog.default_policy(db)
        if rp not in self.catalog.database(db)["policies"]:
            self.catalog.set_policy(db, rp, {})
        before = json.dumps(self.catalog.state)
        try:
            for n in names:
                by_field: dict[str, set[str]] = {}
                for r in kinds:
                    if r.measurement == n:
                        by_field.setdefault(r.f, set()).add(r.kind)
                self.catalog.register(db, rp, n, {r.tag for r in keys if r.measurement == n and r.tag}, by_field)
            if self.limits.series:
                self._check_series(points, db, names)
        except QueryError:
            self.catalog.state = json.loads(before)
            raise
        batch, slot = self.catalog.next_batch(), {"float": "f", "integer": "i", "boolean": "b", "string": "s"}
        touched: dict[str, set[int]] = {}
        for r in points.where("measurement is not null").select("measurement", store.shard_of(self._shard_ns(db, rp)).alias("shard")).distinct().collect():
            touched.setdefault(r.measurement, set()).add(r["shard"])
        for n in names:
            m = self.catalog.measurement(db, rp, n)
            own = points.where(F.col("measurement") == n)
            wide = own.select("time_ns", *(F.col("tags")[t].alias(t) for t in m["tags"]), *(F.col("fields")[f][slot[k]].alias(f) for f, k in m["fields"].items() if f not in m["tags"]), F.lit(batch).cast("long").alias("_batch"), F.col("line").alias("_line"))
            store.append(wide, self._path(db, rp, n), self._shard_ns(db, rp))
            if "fresh" in m:
                m["fresh"] = sorted({*m["fresh"], *touched[n]})
        self.catalog.save()
        count = points.count()
        self.metrics.points_written += count
        return count

    def _check_series(self, points: DataFrame, db: str, names: list[str]) -> None:
        """The database's series, those that are written now included, against the limit."""
        new = points.where("measurement is not null").select("measurement", F.array_sort(F.map_entries("tags")).alias("tags"))
        for rp, by_name in self.catalog.database(db)["measurements"].items():
            for name, m in by_name.items():
                if not self.folder.exists(self._path(db, rp, name)):
                    continue
                tags = F.filter(F.array(*(F.struct(F.lit(t).alias("key"), c(t).alias("value")) for t in m["tags"])), lambda e: e["value"].isNotNull()) if m["tags"] else F.array().cast("array<struct<key:string,value:string>>")
                new = new.union(self._written(db, rp, name, m).select(F.lit(name), F.array_sort(tags)).distinct())
        if new.distinct().limit(self.limits.series + 1).count() > self.limits.series:
            raise QueryError(f"more than {self.limits.series} series in {db}")

    def write_points(self, planned: Planned, target: Name, db: str) -> int:
        """A result written as points: its tags as tags, its columns as fields."""
        db, rp = target.db or db, target.rp or "autogen"
        kinds = {n: KINDS.get(t.split("(")[0], "float") for n, t in planned.frame.dtypes}
        tags = [t for t in dict.fromkeys([*planned.series, *planned.tags]) if t in planned.frame.columns]
        fields = [f for f in planned.columns if f not in tags]
        slot = {"float": ("f", "double"), "integer": ("i", "bigint"), "boolean": ("b", "boolean"), "string": ("s", "string")}

        def typed(f: str):
            at, kind = slot[kinds[f]]
            return F.struct(F.lit(kinds[f]).alias("kind"), *(c(f).cast(t).alias(s) if s == at else F.lit(None).cast(t).alias(s) for s, t in slot.values()))

        entries = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), F.when(c(f).isNotNull(), typed(f)).alias("value")) for f in fields)), lambda e: e["value"].isNotNull())
        labels = F.filter(F.array(*(F.struct(F.lit(t).alias("key"), c(t).alias("value")) for t in tags)), lambda e: e["value"].isNotNull() & (e["value"] != "")) if tags else None
        df = planned.frame.select(
            F.lit(target.measurement).alias("measurement"), (F.map_from_entries(labels) if tags else F.create_map().cast("map<string,string>")).alias("tags"), F.map_from_entries(entries).alias("fields"),
            F.col("time").alias("time_ns"), F.monotonically_increasing_id().alias("line"), F.lit(None).cast("string").alias("error"),
        )
        return self._write(df.where(F.size("fields") > 0), db, rp)

    # --- statements --------------------------------------------------------

    def planned(self, statement: Select, db: str, held: Bounds = Bounds()) -> Planned:
        return plan(statement, lambda name, b, wanted: self.points(db, name, b, wanted), held)

    def query(self, text: str, db: str) -> DataFrame:
        """The answer to one statement as a DataFrame; a SELECT's is lazy. ``time`` is
        in nanoseconds."""
        return self._answer(text, db)[0]

    def _answer(self, text: str, db: str) -> tuple[DataFrame, Planned | None]:
        with self._listed(text, db):
            return self._run(parse(text, self.now), text, db)

    @contextmanager
    def _listed(self, text: str, db: str) -> Iterator[None]:
        """The statement shows in SHOW QUERIES, can be killed and is timed until the
        block ends; ``Limits.seconds`` holds for its Spark jobs."""
        begin = time.time()
        with self._lock:
            self._ids += 1
            number = self._ids
            self._running[number] = {"qid": number, "query": text, "database": db, "started": begin}
        self.last_report = report = Report(text)
        tag, late = f"tidegauge-{number}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.limits.seconds, stop) if self.limits.seconds else None
        if timer:
            timer.daemon = True
            timer.start()
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        except Exception as e:
            self.metrics.errors += 1
            killed = number not in self._running
            if late.is_set() or killed:
                e = QueryError("the query was killed" if killed else f"the query took more than {self.limits.seconds} s")
            report.error = str(e)
            raise e
        finally:
            if timer:
                timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
            self._running.pop(number, None)
            report.seconds = time.time() - begin
            self.metrics.took(report.seconds)

    def rows(self, text: str, db: str) -> list[Row]:
        """The rows of an answer, at most ``Limits.rows``. Unlike the lazy frame of
        ``query``, the work is done here, so it is listed, timed and can be killed."""
        with self._listed(text, db):
            s = parse(text, self.now)
            df, p = self._run(s, text, db)
            self._check_points(s, db)
            out = (df.limit(self.limits.rows + 1) if self.limits.rows else df).collect()
            if self.limits.rows and len(out) > self.limits.rows:
                raise QueryError(f"more than {self.limits.rows} rows")
            self.last_report.rows = len(out)
            self.last_report.plan = df._jdf.queryExecution().simpleString() if p else ""
            return out

    def _check_points(self, s: object, db: str) -> None:
        """``Limits.points`` against the points that a SELECT reads within its time bounds."""
        if isinstance(s, Select) and self.limits.points and self._scanned(s, db).limit(self.limits.points + 1).count() > self.limits.points:
            raise QueryError(f"the query reads more than {self.limits.points} points")

    def _scanned(self, s: Select, db: str, held: Bounds = Bounds()) -> DataFrame:
        """The points that a SELECT's innermost source reads."""
        while True:
            held = held.meet(filters.bounds(s.where)) if s.where is not None else held
            if not isinstance(s.source, Select):
                return self.points(db, s.source, held, set()).frame
            s = s.source

    def _run(self, s: object, text: str, db: str) -> tuple[DataFrame, Planned | None]:
        if isinstance(s, Select):
            p = self.planned(s, db)
            if s.into is None:
                return p.frame, p
            n = self.write_points(p, s.into, db)
            return self._frame([(0, n)], "time bigint, written bigint"), None
        if isinstance(s, Explain):
            return self._explain(s, db), None
        if isinstance(s, Show):
            from .show import show

            df = show(self, s, s.db or db)
            df = df.offset(s.offset) if s.offset else df
            return (df.limit(s.limit) if s.limit is not None else df), None
        if isinstance(s, Delete):
            self._delete(s, db)
        elif isinstance(s, Command):
            self._command(s, db)
        return self._frame([], "status string"), None

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _explain(self, s: Explain, db: str) -> DataFrame:
        p = self.planned(replace(s.select, into=None), db)
        tree, begin = p.frame._jdf.queryExecution(), time.time()
        optimized, physical = tree.optimizedPlan().toString(), tree.executedPlan().toString()
        returned = p.frame.count() if s.analyze else 0
        took = time.time() - begin if s.analyze else 0
        scanned = self._scanned(s.select, db).count() if s.analyze else 0
        read = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", physical)))
        # The keys that clients of the language expect.
        rows = [
            ("QUERY PLAN", "SCAN"), ("measurement", p.name), ("scanned_points", scanned), ("rows_returned", returned), ("duration_ms", round(took * 1000)),
            ("used_series_index_pushdown", "PushedFilters: [" in physical and "PushedFilters: []" not in physical), ("used_aggregate_pushdown", "partial_" in physical), ("used_streaming_raw_select", "Aggregate" not in physical and "Window" not in physical),
            ("estimated_input_bytes", sum(int(x.stats().sizeInBytes()) for x in _leaves(tree.optimizedPlan()))), ("estimated_result_bytes", int(tree.optimizedPlan().stats().sizeInBytes())),
            ("segment_columns_read", sum(x.count(",") + 1 for x in read if x)), ("points_materialized", returned),
        ]
        rows += [("series tags", ",".join(p.series)), ("columns", ",".join(p.columns)), ("logical plan", optimized), ("physical plan", physical)]
        return self._frame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in rows], "key string, value string")

    def _delete(self, s: Delete, db: str) -> None:
        with self._lock:
            for name in s.sources or [Name(n) for n in self.catalog.measurements(db)]:
                own = name.db or db
                policies = [name.rp] if name.rp else list(self.catalog.database(own)["measurements"])
                if not s.whole_series and not name.rp:
                    policies = [self.catalog.default_policy(own)]
                for rp in policies:
                    m = self.catalog.measurement(own, rp, name.measurement)
                    if m is None:
                        continue
                    filters.check(s.where, tuple(m["tags"]), m["fields"])
                    mark = {"batch": self.catalog.state["batch"], "where": s.where_text, "now": self.now()}
                    if s.whole_series and s.where is not None:
                        p = self.planned(Select((Item("*"),), Name(name.measurement, rp, own), s.where), own)
                        mark["series"] = self.folder.at("series", uuid.uuid4().hex)
                        p.frame.select(series_key(p.tags).alias("key")).distinct().write.parquet(mark["series"])
                    m["deleted"].append(mark)
            self.catalog.save()

    def _command(self, s: Command, db: str) -> None:
        with self._lock:
            x, cat = s.settings, self.catalog
            if s.verb == "create database":
                cat.create_database(x["db"], x["options"])
            elif s.verb == "drop database":
                cat.state["databases"].pop(x["name"], None)
                self._remove("data", x["name"])
                self.external = {k: v for k, v in self.external.items() if k[0] != x["name"]}
            elif s.verb in ("create retention policy", "alter retention policy"):
                cat.set_policy(x["db"], x["name"], x["options"], s.verb.startswith("alter"))
            elif s.verb == "drop retention policy":
                cat.database(x["db"])["policies"].pop(x["name"], None)
                cat.database(x["db"])["measurements"].pop(x["name"], None)
                self._remove("data", x["db"], x["name"])
            elif s.verb == "drop measurement":
                for rp, by_name in cat.database(db)["measurements"].items():
                    if by_name.pop(x["name"], None) is not None:
                        self._remove("data", db, rp, x["name"])  # all its versions
                self.external = {k: v for k, v in self.external.items() if k[0] != db or k[2] != x["name"]}
            elif s.verb == "drop shard":
                shards = [r for r in self.shards() if r["id"] == x["id"]]
                for r in shards[:1]:
                    for name in cat.database(r["database"])["measurements"].get(r["retention_policy"], {}):
                        self.folder.remove(f"{self._path(r['database'], r['retention_policy'], name)}/_shard={r['start']}")
            elif s.verb == "create continuous query":
                cat.database(x["db"])["queries"][x["name"]] = {"text": x["text"], "every": x["every"], "for": x["for"], "recompute": x["recompute"], "last": None}
            elif s.verb == "drop continuous query":
                cat.database(x["db"])["queries"].pop(x["name"], None)
            elif s.verb == "kill query":
                if x["id"] not in self._running:
                    raise QueryError(f"no such query: {x['id']}")
                self._running.pop(x["id"])
                self.spark.sparkContext.cancelJobsWithTag(f"tidegauge-{x['id']}")
            cat.save()

    def _remove(self, *parts: str) -> None:
        if self.folder:
            self.folder.remove(self.folder.at(*parts))

    # --- upkeep ------------------------------------------------------------

    def shards(self) -> list[dict]:
        """Every shard that holds data, numbered in order of database, policy, start."""
        out: list[dict] = []
        for db, d in sorted(self.catalog.state["databases"].items()):
            for rp, by_name in sorted(d["measurements"].items()):
                starts = {int(x.partition("=")[2]) for name in by_name for x in self.folder.children(self._path(db, rp, name)) if x.startswith("_shard=")}
                for start in sorted(starts):
                    out.append({"id": len(out) + 1, "database": db, "retention_policy": rp, "start": start, "end": start + d["policies"][rp]["shard"], "duration": d["policies"][rp]["duration"]})
        return out

    def expire(self) -> int:
        """Drops the shards that ended before their policy's duration ago."""
        n = 0
        for s in self.shards():
            if s["duration"] and s["end"] < self.now() - s["duration"]:
                for name in self.catalog.database(s["database"])["measurements"][s["retention_policy"]]:
                    self.folder.remove(f"{self._path(s['database'], s['retention_policy'], name)}/_shard={s['start']}")
                n += 1
        return n

    def compact(self, db: str, name: str, rp: str | None = None) -> None:
        """Rewrites a measurement without deleted and overwritten points, as a new
        version that counts once the catalog names it; then the old one goes. Until new
        points are written to a shard, it is read without a merge."""
        with self._lock:
            rp = rp or self.catalog.default_policy(db)
            m = self.catalog.measurement(db, rp, name)
            if m is None or not self.folder.exists(old := self._path(db, rp, name)):
                return
            batch = self.catalog.next_batch()
            points = self._stored(db, rp, name, m, Bounds(), None)
            version = m.get("version", 0) + 1
            new = self.folder.at("data", db, rp, name, f"v{version}")
            self.folder.remove(new)  # of a compaction that was cut short
            store.append(points.withColumn("_batch", F.lit(batch).cast("long")).withColumn("_line", F.lit(0).cast("long")), new, self._shard_ns(db, rp))
            m |= {"version": version, "fresh": [], "deleted": []}
            self.catalog.save()
            self.folder.remove(old)

    def manifest(self, db: str) -> DataFrame:
        """(path, size, sha256) of every data file of a database."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.folder.at("data", db))
        return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def export_lines(self, db: str, name: str, rp: str | None = None) -> DataFrame:
        """(value): a measurement as line protocol."""
        p = self.points(db, Name(name, rp))
        return line_protocol.to_lines(p.frame, name, list(p.tags), {f: k for f, k in p.fields.items() if f not in p.tags})

    def health(self) -> dict:
        return {"status": "pass", "databases": len(self.catalog.state["databases"]), "spark": self.spark.version}

    # --- answers as JSON ---------------------------------------------------

    def query_chunks(self, text: str, db: str, epoch: str | None = None, chunk_size: int = 5000) -> Iterator[dict]:
        """The answer in parts of at most ``chunk_size`` rows of one series each, read
        partition by partition."""
        if epoch is not None and epoch not in PRECISIONS:
            raise QueryError(f"unknown epoch {epoch}")
        with self._listed(text, db):
            yield from self._chunks(text, db, epoch, chunk_size)

    def _chunks(self, text: str, db: str, epoch: str | None, chunk_size: int) -> Iterator[dict]:
        s = parse(text, self.now)
        df, p = self._run(s, text, db)
        self._check_points(s, db)
        series = p.series if p else ()
        columns = [x for x in df.columns if x not in series]
        name = p.name if p else ""
        rows, total, now = [], 0, None

        def part(key: tuple, partial: bool) -> dict:
            out = {"name": name} | ({"tags": dict(zip(series, key, strict=True))} if series else {}) | {"columns": columns, "values": rows}
            return {"results": [{"statement_id": 0, "series": [out]} | ({"partial": True} if partial else {})]}

        for r in df.toLocalIterator(prefetchPartitions=True):
            key = tuple(r[t] if r[t] is not None else "" for t in series)
            if rows and (key != now or len(rows) >= chunk_size):
                yield part(now, key == now)
                rows = []
            now, total = key, total + 1
            if self.limits.rows and total > self.limits.rows:
                raise QueryError(f"more than {self.limits.rows} rows")
            rows.append([(r[x] // PRECISIONS[epoch] if epoch else instant_text(r[x])) if x == "time" and p else r[x] for x in columns])
        if rows:
            yield part(now, False)
        self.last_report.rows = total

    def query_json(self, text: str, db: str, epoch: str | None = None) -> dict:
        """The whole answer, one entry for each series; errors are told, not raised."""
        try:
            series: list[dict] = []
            for chunk in self.query_chunks(text, db, epoch, chunk_size=self.limits.rows or 1 << 30):
                series += chunk["results"][0]["series"]
        except QueryError as e:
            return {"results": [{"statement_id": 0, "error": str(e)}]}
        return {"results": [{"statement_id": 0} | ({"series": series} if series else {})]}
