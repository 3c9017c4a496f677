"""Statements against small sets of points that pin their meaning."""

import pytest

from tidegauge import Engine, QueryError
from tidegauge.engine import Limits
from tidegauge.streaming.continuous import ContinuousQueries

S = 1_000_000_000
DB = "db"


class Clock:
    def __init__(self, ns=0):
        self.ns = ns

    def __call__(self):
        return self.ns


@pytest.fixture
def make(spark, tmp_path):
    made = []

    def new(lines="", now=10_000 * S, precision="s"):
        e = Engine(spark, f"file://{tmp_path}/engine{len(made)}", now=Clock(now))
        made.append(e)
        if lines:
            e.write_lines(lines, DB, precision=precision)
        return e

    return new


def rows(e, q):
    return [tuple(r) for r in e.query(q, DB).collect()]


def values(e, q, at=-1):
    return [r[at] for r in rows(e, q)]


TEN = "\n".join(f"cpu,host=a value={i} {i}" for i in range(1, 11))


def test_aggregates(make):
    e = make(TEN)
    q = "SELECT spread(value), stddev(value), median(value), percentile(value, 90), count(value), sum(value) FROM cpu GROUP BY time(100s)"
    (r,) = rows(e, q)
    assert r[0] == 0 and r[1] == 9 and 3.0 < r[2] < 3.1 and r[3] == 5.5 and abs(r[4] - 9.1) < 1e-9 and r[5:] == (10, 55.0)
    assert rows(e, "SELECT count(*) FROM cpu") == [(10 * S, 10)]
    assert rows(e, "SELECT count(value) FROM cpu WHERE value > 99") == []
    assert rows(e, "SELECT count(value) FROM nothing") == []
    m = make("mem,host=a free=1,used=2 1\nmem,host=a free=3 2")
    d = m.query("SELECT count(*) FROM mem", DB)
    assert d.columns == ["time", "count_free", "count_used"] and tuple(d.first())[1:] == (2, 1)


def test_transforms_and_selectors(make):
    e = make("cpu value=10 1\ncpu value=20 2\ncpu value=35 3")
    got = rows(e, "SELECT difference(value), cumulative_sum(value) FROM cpu")
    assert [r[1:] for r in got] == [(None, 10.0), (10.0, 30.0), (15.0, 65.0)]
    e = make("cpu value=10 0\ncpu value=20 30\ncpu value=50 60")
    assert values(e, "SELECT derivative(value, 1m) FROM cpu ORDER BY time DESC") == [60.0, 20.0]
    assert values(e, "SELECT integral(value, 1s) FROM cpu") == [450.0, 1500.0]
    assert values(e, "SELECT elapsed(value) FROM cpu") == [30.0, 30.0]
    assert values(e, "SELECT moving_average(value, 2) FROM cpu") == [15.0, 35.0]
    e = make("cpu value=10 1\ncpu value=30 2\ncpu value=20 3")
    assert values(e, "SELECT top(value,2) FROM cpu") == [30.0, 20.0] and values(e, "SELECT bottom(value,1) FROM cpu") == [10.0]
    e = make("cpu,host=s1 value=10 1\ncpu,host=s1 value=30 2\ncpu,host=s1 value=20 3\ncpu,host=s2 value=5 1\ncpu,host=s2 value=15 2\ncpu,host=s2 value=25 3")
    assert [r[1:] for r in rows(e, "SELECT top(value,2) FROM cpu GROUP BY host")] == [("s1", 30.0), ("s1", 20.0), ("s2", 15.0), ("s2", 25.0)]
    e = make("\n".join(f"cpu value={v} {t}" for v, t in ((1, 1), (2, 2), (3, 3), (10, 61), (20, 62), (30, 63))))
    assert values(e, "SELECT sample(value,2) FROM cpu GROUP BY time(1m)") == [1.0, 3.0, 10.0, 30.0]
    e = make("\n".join(f"cpu value={i} {i}" for i in range(1, 6)))
    assert values(e, "SELECT sample(value,3) FROM cpu") == [1.0, 3.0, 5.0]
    e = make("cpu value=-2 1\ncpu value=3 2\ncpu value=1 3")
    assert values(e, "SELECT ABS(value) FROM cpu") == [2.0, 3.0, 1.0] and values(e, "SELECT NON_NEGATIVE_DIFFERENCE(value) FROM cpu") == [5.0]
    e = make("cpu value=1 1\ncpu value=1 2\ncpu value=2 3\ncpu value=3 4")
    assert values(e, "SELECT DISTINCT(value) FROM cpu LIMIT 2") == [1.0, 2.0] and values(e, "SELECT COUNT(DISTINCT value) FROM cpu") == [3]
    assert values(e, "SELECT mode(value) FROM cpu") == [1.0]
    e = make('ev status="x" 1\nev status="x" 2\nev status="y" 3')
    assert values(e, "SELECT COUNT(DISTINCT status) FROM ev") == [2] and values(e, "SELECT mode(status) FROM ev") == ["x"] and values(e, "SELECT sum(status) FROM ev") == [None]
    e = make("cpu value=0.5 1\ncpu value=1.5 2\ncpu value=2.5 3")
    assert values(e, "SELECT round(value) FROM cpu") == [0.0, 2.0, 2.0]


def test_fill_and_paging(make):
    e = make("cpu value=10 0\ncpu value=30 120")
    q = "SELECT mean(value) FROM cpu WHERE time >= 0 AND time <= 120s GROUP BY time(1m) fill({})"
    assert values(e, q.format("linear")) == [10.0, 20.0, 30.0]
    assert values(e, q.format("previous")) == [10.0, 10.0, 30.0] and values(e, q.format("null")) == [10.0, None, 30.0]
    assert values(e, q.format("0")) == [10.0, 0.0, 30.0] and values(e, q.format("-7.5")) == [10.0, -7.5, 30.0] and values(e, q.format("none")) == [10.0, 30.0]
    assert len(rows(e, "SELECT mean(value) FROM cpu GROUP BY time(1m) fill(0)")) == 2
    e = make("cpu,host=s1 value=10 0\ncpu,host=s1 value=20 60\ncpu,host=s2 value=30 0\ncpu,host=s2 value=40 60")
    assert rows(e, "SELECT mean(value) FROM cpu GROUP BY time(1m),host ORDER BY time DESC SLIMIT 1 SOFFSET 1") == [(60 * S, "s2", 40.0), (0, "s2", 30.0)]
    e = make("cpu,host=a,region=east value=1 1\ncpu,host=a,region=west value=2 2\ncpu,host=b,region=east value=3 3\ncpu,host=b,region=west value=4 4")
    assert rows(e, "SELECT * FROM cpu WHERE host='a' OR host='b' GROUP BY host ORDER BY time DESC LIMIT 1") == [(2 * S, "a", "west", 2.0), (4 * S, "b", "west", 4.0)]
    assert values(e, "SELECT value FROM cpu ORDER BY time DESC LIMIT 2 OFFSET 1") == [3.0, 2.0]


def test_where(make):
    e = make('cpu,host=a v=1,ok=true,s="x y" 1\ncpu,host=b v=2,ok=false,s="z" 2\ncpu v=3 3')
    for cond, want in {
        "host = 'a'": [1.0], "host != 'a'": [2.0], "host =~ /a|b/": [1.0, 2.0], "host !~ /a/": [2.0], "v >= 2": [2.0, 3.0], "v != 2": [1.0, 3.0], "v = 2.0000000001": [2.0], "ok = true": [1.0], "ok = 1": [1.0],
        "s = 'z'": [2.0], "s =~ /^x/": [1.0], "missing = 'a'": [], "time = 2s": [2.0], "time > 1s AND time < 3s": [2.0], "(host='a' OR host='b') AND v < 5": [1.0, 2.0], "time >= '1970-01-01T00:00:03Z'": [3.0],
    }.items():
        assert values(e, f"SELECT v FROM cpu WHERE {cond}") == want, cond
    for bad in ("v > 1 OR host = 'a'", "time > 1s OR host = 'a'"):
        with pytest.raises(QueryError):
            e.query(f"SELECT v FROM cpu WHERE {bad}", DB)
    for bad in ("SELECT nothing(v) FROM cpu", "SELECT v, mean(v) FROM cpu", "SELECT sum(*) FROM cpu", "SELECT elapsed(v) FROM cpu GROUP BY time(1m)"):
        with pytest.raises(QueryError):
            e.query(bad, DB)


def test_last_write_wins_and_conflicts(make):
    e = make("cpu,host=a value=1.5 1")
    e.write_lines("cpu,host=a temp=42 1", DB, precision="s")
    e.write_lines("cpu,host=a value=9.9 1\ncpu,host=b value=1 1", DB, precision="s")
    assert rows(e, "SELECT value, temp FROM cpu WHERE host='a'") == [(S, "a", 9.9, 42.0)]
    assert len(rows(e, "SELECT value FROM cpu")) == 2
    with pytest.raises(QueryError):
        e.write_lines('cpu,host=a value="text" 5\nnew v=1 5', DB)
    with pytest.raises(QueryError):
        e.write_lines("cpu value=1i 5", DB)
    with pytest.raises(QueryError):
        e.write_lines("cpu value=1 5\nbroken", DB)
    assert values(e, "SHOW MEASUREMENTS", 0) == ["cpu"]
    e.compact(DB, "cpu")
    assert rows(e, "SELECT value, temp FROM cpu WHERE host='a'") == [(S, "a", 9.9, 42.0)]
    tight = Engine(e.spark, e.folder.root + "-tight", limits=Limits(series=1))
    with pytest.raises(QueryError):
        tight.write_lines("m,a=1 v=1 1\nm,a=2 v=1 1", DB)


def test_subqueries_and_into(make):
    e = make("cpu value=10 1\ncpu value=20 5\ncpu value=30 11\ncpu value=50 15")
    assert values(e, "SELECT mean(max_value) FROM (SELECT max(value) FROM cpu GROUP BY time(10s)) GROUP BY time(20s)") == [35.0]
    assert values(e, "SELECT mean(max_value) FROM (SELECT max(value) FROM cpu GROUP BY time(10s)) WHERE time >= 10s GROUP BY time(20s)") == [50.0]
    e = make("cpu,host=a,region=x value=10 1\ncpu,host=a,region=x value=20 2")
    e.query("SELECT mean(value) INTO cpu_rollup FROM cpu GROUP BY time(10s),*", DB)
    assert rows(e, "SELECT * FROM cpu_rollup") == [(0, "a", "x", 15.0)]
    e.query('SELECT value INTO "archive db"."daily.rp"."cpu load" FROM cpu', DB)
    assert values(e, 'SELECT value FROM "archive db"."daily.rp"."cpu load"') == [10.0, 20.0]
    e = make('cpu,host=a status="up" 1')
    e.query("SELECT status INTO copy FROM (SELECT host,status FROM cpu)", DB)
    assert rows(e, "SELECT * FROM copy") == [(S, "a", "up")]


def test_delete_and_drop(make):
    e = make("cpu,host=s1 value=1 1\ncpu,host=s2 value=2 1")
    e.query("DELETE FROM cpu WHERE host='s1'", DB)
    assert values(e, "SELECT value FROM cpu") == [2.0]
    e.write_lines("cpu,host=s1 value=7 1", DB, precision="s")
    assert values(e, "SELECT value FROM cpu WHERE host='s1'") == [7.0]
    e.query("DELETE FROM cpu WHERE value > 2", DB)
    assert values(e, "SELECT value FROM cpu") == [2.0]
    e = make("cpu,host=s1 value=1 1\ncpu,host=s2 value=10 2\ncpu,host=s2 value=2 3")
    e.query("DROP SERIES FROM cpu WHERE value > 5", DB)
    assert values(e, "SELECT value FROM cpu") == [1.0]
    e.query("DROP MEASUREMENT cpu", DB)
    assert rows(e, "SELECT value FROM cpu") == [] and rows(e, "SHOW MEASUREMENTS") == []
    e = make("cpu value=10 3")
    e.write_lines("cpu value=1 1\ncpu value=10 2", DB, rp="archive", precision="s")
    e.query("DELETE FROM archive.cpu WHERE value >= 10", DB)
    assert values(e, "SELECT value FROM archive.cpu") == [1.0] and values(e, "SELECT value FROM cpu") == [10.0]


def test_metadata_and_policies(make):
    e = make("cpu,host=a,region=x value=1 1\ncpu,host=b value=2,n=3i 2\nmem used=1i 1")
    assert rows(e, "SHOW DATABASES") == [("db",)]
    assert values(e, "SHOW MEASUREMENTS WITH MEASUREMENT =~ /^c/") == ["cpu"] and values(e, "SHOW MEASUREMENTS WHERE host = 'a'") == ["cpu"]
    assert rows(e, "SHOW FIELD KEYS FROM cpu") == [("n", "integer"), ("value", "float")]
    assert values(e, "SHOW TAG KEYS") == ["host", "region"]
    assert rows(e, "SHOW TAG VALUES FROM cpu WITH KEY = host") == [("host", "a"), ("host", "b")]
    assert values(e, "SHOW SERIES FROM cpu") == ["cpu,host=a,region=x", "cpu,host=b"]
    assert values(e, "SHOW SERIES CARDINALITY") == [3] and values(e, "SHOW TAG KEY CARDINALITY FROM cpu") == [2]
    e.query("CREATE RETENTION POLICY week ON db DURATION 1w REPLICATION 1 DEFAULT", DB)
    assert rows(e, "SHOW RETENTION POLICIES") == [("autogen", "0s", 1, False), ("week", "1w", 1, True)]
    e.query("ALTER RETENTION POLICY week ON db DURATION 2d", DB)
    assert rows(e, "SHOW RETENTION POLICIES")[1] == ("week", "2d", 1, True)
    assert len(rows(e, "SHOW SHARDS")) == 1
    e.query("DROP SHARD 1", DB)
    assert rows(e, "SELECT value FROM autogen.cpu") == []
    assert any(r[0] == "physical plan" for r in rows(e, "EXPLAIN SELECT mean(value) FROM cpu")) and rows(e, "SHOW DIAGNOSTICS") and rows(e, "SHOW STATS")
    again = Engine(e.spark, e.folder.root)
    assert [r[0] for r in again.query("SHOW MEASUREMENTS", DB).collect()] == ["cpu", "mem"]
    with pytest.raises(QueryError):
        e.query("KILL QUERY 99", DB)
    e.query("DROP DATABASE db", DB)
    assert rows(e, "SHOW DATABASES") == []


def test_json(make):
    e = make("cpu,host=a value=1 1\ncpu,host=b value=2 2")
    assert e.query_json("SELECT mean(value) FROM cpu GROUP BY host", DB, "s") == {"results": [{"statement_id": 0, "series": [
        {"name": "cpu", "tags": {"host": "a"}, "columns": ["time", "mean_value"], "values": [[1, 1.0]]}, {"name": "cpu", "tags": {"host": "b"}, "columns": ["time", "mean_value"], "values": [[2, 2.0]]}]}]}
    assert e.query_json("SELECT value FROM cpu", DB)["results"][0]["series"][0]["values"][0] == ["1970-01-01T00:00:01.000000000Z", "a", 1.0]
    assert "error" in e.query_json("SELEKT", DB)["results"][0]
    assert len(list(e.query_chunks("SELECT value FROM cpu", DB, chunk_size=1))) == 2
    assert "tidegauge_queries_total" in e.metrics.prometheus() and e.health()["status"] == "pass"
    assert e.manifest(DB).count() >= 1
    assert sorted(r.value for r in e.export_lines(DB, "cpu").collect()) == ["cpu,host=a value=1.0 1000000000", "cpu,host=b value=2.0 2000000000"]


def test_continuous_queries(make):
    e = make("cpu,host=a value=10 70\ncpu,host=a value=20 75\ncpu,host=a value=30 85\ncpu,host=a value=40 95", now=105 * S)
    e.query("CREATE CONTINUOUS QUERY c ON db RESAMPLE EVERY 10s FOR 30s BEGIN SELECT mean(value) INTO rollup FROM cpu GROUP BY time(10s),host END", DB)
    runner = ContinuousQueries(e)
    assert runner.run_due() == 3
    got = values(e, "SELECT mean_value FROM rollup")
    assert got == [15.0, 30.0, 40.0]
    assert runner.run_due() == 0
    assert rows(e, "SHOW CONTINUOUS QUERIES")[0][:2] == ("db", "c")
    e.query("DROP CONTINUOUS QUERY c ON db", DB)
    e.query("CREATE CONTINUOUS QUERY r ON db RESAMPLE EVERY 10s RECOMPUTE 1 BEGIN SELECT mean(value) INTO late FROM cpu GROUP BY time(10s),host END", DB)
    runner.run_due()
    assert values(e, "SELECT mean_value FROM late") == [40.0]
    e.write_lines("cpu,host=a value=60 96", DB, precision="s")
    runner.run_due()
    assert values(e, "SELECT mean_value FROM late") == [50.0]


def test_delete_keeps_its_condition(make):
    for gap in ("\n", "\t", "\r\n  "):
        e = make("cpu,host=s1 value=1 1\ncpu,host=s2 value=2 1")
        e.query(f"DELETE FROM cpu{gap}WHERE{gap}host='s1';", DB)
        assert values(e, "SELECT value FROM cpu") == [2.0]
    e = make("cpu\\ where\\ a,host=s1 value=1 1\ncpu\\ where\\ a,host=s2 value=2 1")
    e.query("DELETE FROM \"cpu where a\" WHERE host = 's2' AND time >= 0", DB)
    assert values(e, 'SELECT value FROM "cpu where a"') == [1.0]


def test_compacted_shards_are_read_without_a_merge(make):
    e = make("cpu,host=a value=1 1\ncpu,host=b value=2 1\ncpu,host=a value=3 700000")
    e.write_lines("cpu,host=a value=9 1", DB, precision="s")
    e.query("DELETE FROM cpu WHERE host = 'b'", DB)
    e.compact(DB, "cpu")
    df = e.query("SELECT value FROM cpu", DB)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.value for r in df.collect()) == [3.0, 9.0]
    e.write_lines("cpu,host=a value=4 1\ncpu,host=a value=5 2", DB, precision="s")
    assert sorted(values(e, "SELECT value FROM cpu")) == [3.0, 4.0, 5.0]
    again = Engine(e.spark, e.folder.root)
    assert sorted(r.value for r in again.query("SELECT value FROM cpu", DB).collect()) == [3.0, 4.0, 5.0]
    e.compact(DB, "cpu")
    assert sorted(values(e, "SELECT value FROM cpu")) == [3.0, 4.0, 5.0]
    assert [x for x in e.folder.children(e.folder.at("data", DB, "autogen", "cpu"))] == ["v2"]


def test_a_broken_catalog_write_loses_nothing(make):
    e = make("cpu value=1 1")
    new = e.folder._path(f"{e.folder.root}/catalog.json.new")
    e.folder._fs.create(new, True).close()  # a crash before the new version had its name
    assert [r.value for r in Engine(e.spark, e.folder.root).query("SELECT value FROM cpu", DB).collect()] == [1.0]


def test_series_limit_counts_what_is_there(make):
    e = make("m,a=1 v=1 1\nm,a=2 v=1 1")
    e.limits = Limits(series=3)
    e.write_lines("m,a=2 v=2 2\nn v=1 1", DB)
    with pytest.raises(QueryError, match="series"):
        e.write_lines("m,a=3 v=1 1", DB)
    assert values(e, "SHOW SERIES CARDINALITY") == [3]


def test_limits_of_points_rows_and_seconds(make):
    e = make(TEN)
    e.limits = Limits(points=5)
    assert "points" in e.query_json("SELECT sum(value) FROM cpu", DB)["results"][0]["error"]
    assert e.query_json("SELECT sum(value) FROM cpu WHERE time <= 4s", DB)["results"][0]["series"][0]["values"][0][1] == 10.0
    e.limits = Limits(rows=3)
    with pytest.raises(QueryError, match="rows"):
        e.rows("SELECT value FROM cpu", DB)
    assert len(e.rows("SELECT value FROM cpu LIMIT 3", DB)) == 3 and e.last_report.rows == 3 and e.last_report.plan


def slow(e):
    """A measurement whose reading takes minutes."""
    from pyspark.sql import functions as F

    df = e.spark.range(0, 1 << 42, 1, 4).select(F.col("id").alias("t"), F.rand().alias("value"))
    e.register(DB, "slow", df, "t", [], unique=True)


def test_running_queries_are_listed_and_killed(make):
    import threading
    import time

    e, seen = make("cpu value=1 1"), []
    slow(e)

    def run():
        try:
            e.rows("SELECT sum(value) FROM slow", DB)
        except QueryError as x:
            seen.append(str(x))

    t = threading.Thread(target=run)
    t.start()
    for _ in range(100):
        listed = [r for r in e.query("SHOW QUERIES", DB).collect() if "slow" in r.query]
        if listed and e.spark.sparkContext.statusTracker().getActiveStageIds():
            break
        time.sleep(0.1)
    e.query(f"KILL QUERY {listed[0].qid}", DB)
    t.join(30)
    assert seen == ["the query was killed"] and not e._running
    e.limits = Limits(seconds=1.5)
    with pytest.raises(QueryError, match="more than 1.5 s"):
        e.rows("SELECT sum(value) FROM slow", DB)


def test_explain_analyze_keys(make):
    e = make(TEN)
    got = dict(rows(e, "EXPLAIN ANALYZE SELECT mean(value) FROM cpu WHERE time > 4s GROUP BY host"))
    assert (got["measurement"], got["scanned_points"], got["rows_returned"], got["used_aggregate_pushdown"]) == ("cpu", "6", "1", "true")
    assert len([k for k in got if k in {"QUERY PLAN", "duration_ms", "used_series_index_pushdown", "used_streaming_raw_select", "estimated_input_bytes", "estimated_result_bytes", "segment_columns_read", "points_materialized"}]) == 8
    plain = dict(rows(e, "EXPLAIN SELECT mean(value) FROM cpu"))
    assert plain["scanned_points"] == plain["rows_returned"] == plain["duration_ms"] == "0"


def test_continuous_queries_survive_errors_and_new_databases(make):
    e = make("cpu value=10 70\ncpu value=20 85", now=105 * S)
    e.query("CREATE CONTINUOUS QUERY bad ON db RESAMPLE EVERY 10s FOR 30s BEGIN SELECT mean(value) INTO late FROM cpu GROUP BY time(10s) END", DB)
    e.catalog.state["databases"][DB]["queries"]["bad"]["text"] = "SELECT nothing(value) INTO x FROM cpu GROUP BY time(10s)"
    e.query('CREATE CONTINUOUS QUERY good ON db RESAMPLE EVERY 10s FOR 40s BEGIN SELECT mean(value) INTO "fresh db"."autogen".rolled FROM cpu GROUP BY time(10s) END', DB)
    turns = []
    ContinuousQueries(e).run_forever(1, stop=lambda: len(turns) > 0 or turns.append(1))
    assert e.metrics.continuous["db.bad"]["errors"] == 1 and e.metrics.continuous["db.good"]["errors"] == 0
    assert values(e, 'SELECT mean_value FROM "fresh db".autogen.rolled') == [10.0, 20.0]


def test_streaming_rollup_into_a_measurement(make, spark, tmp_path):
    from pyspark.sql import functions as F

    from tidegauge.plans.syntax import Name
    from tidegauge.streaming.continuous import rollup_stream, stream_into

    e = make("cpu value=1 1")
    at = f"{tmp_path}/in"
    rows_in = [(0, "a", 1.0), (30, "a", 3.0), (61, "a", 5.0), (5, "b", 7.0)]
    spark.createDataFrame(rows_in, "s long, host string, value double").select(F.timestamp_seconds("s").alias("time"), "host", "value").write.parquet(at)
    points = spark.readStream.schema("time timestamp, host string, value double").parquet(at)
    q = stream_into(e, rollup_stream(points, ["host"], "value", "1 minute", "10 minutes"), ["host"], Name("rolled"), DB, f"{tmp_path}/progress")
    q.processAllAvailable()
    q.stop()
    assert rows(e, "SELECT count_value, sum_value FROM rolled GROUP BY host") == [(0, "a", 2, 4.0), (60 * S, "a", 1, 5.0), (0, "b", 1, 7.0)]


def test_gzip_text_is_read(make, spark, tmp_path):
    import gzip

    with gzip.open(f"{tmp_path}/points.gz", "wt") as f:
        f.write("cpu,host=a value=1 1\n# a comment\n\ncpu,host=b value=2 2\n")
    e = make()
    assert e.write_lines(spark.read.text(f"{tmp_path}/points.gz"), DB, precision="s") == 2
    assert values(e, "SELECT value FROM cpu") == [1.0, 2.0]
