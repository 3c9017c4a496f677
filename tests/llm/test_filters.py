"""URL lists, decontamination, mixing and the pipeline."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
import corpus_pipeline
from tidegauge.llm.decontamination import Item, Matcher, contamination, normal
from tidegauge.llm.mixing import _time, mix
from tidegauge.llm.queries import ORACLE_SQL, QUERIES
from tidegauge.llm.urls import intervals, temporal_list_join

DATA = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert len(QUERIES) == 10


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert key(tuple(r[c] for c in columns) for r in df.collect()) == key(want.fetchall())


ENTRY = "list string, kind string, pattern string, verdict string, action string, listed_at long, extra string"


def test_intervals_and_as_of(spark):
    entries = [
        ("l", "domain", "Bad.com", "block", "add", 10, ""), ("l", "domain", "bad.com", "block", "remove", 20, ""), ("l", "domain", "bad.com", "block", "add", 20, ""), ("l", "domain", "bad.com", "block", "add", 40, ""),
        ("l", "domain", "bad.com", "block", "add", 40, ""), ("l", "prefix", "sub.bad.com/ok", "allow", "add", 0, ""), ("l", "domain", None, "block", "add", 0, ""), ("l", "domain", "x", "block", None, 0, ""), (None, "domain", "c.com", "block", "add", 5, ""),
    ]
    e = spark.createDataFrame(entries, ENTRY)
    got = sorted((r.pattern, r.valid_from, r.valid_to) for r in intervals(e).collect() if r.pattern == "bad.com")
    assert got == [("bad.com", 10, 20), ("bad.com", 40, (1 << 62) - 1)]
    caps = [("http://bad.com/x", 9), ("http://bad.com/x", 10), ("http://www.BAD.com:80/", 19), ("http://bad.com/", 20), ("http://bad.com/", 1000), ("https://sub.bad.com/ok/page?q", 50), ("https://sub.bad.com/okay", 50), ("http://notbad.com/", 50), ("c.com", 50), ("ftp://u@c.com", 50), (None, 50), ("http://bad.com/", None)]
    df = spark.createDataFrame([(u, t, "kept") for u, t in caps * 2], "url string, fetched_at long, verdict string")
    rows = [(r.url, r.fetched_at, r.n_active, r.blocked) for r in temporal_list_join(df, e, bin_width=7).collect()]
    want = [(0, False), (1, True), (1, True), (0, False), (1, True), (2, False), (1, True), (0, False), (0, False), (1, True), (0, False), (0, False)]
    assert sorted(rows, key=str) == sorted([(u, t, *w) for (u, t), w in zip(caps, want, strict=True)] * 2, key=str)
    assert temporal_list_join(df.limit(0), e).collect() == [] and not any(r.blocked for r in temporal_list_join(df, e.limit(0)).collect())


def edits(pattern, text):
    """Least edit distance between the pattern and a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_myers_distance(pattern, text):
    assert Item(1, pattern, 0.1).distance(text) == edits(pattern, text)


def test_matcher_finds_all_within_budget():
    rng = random.Random(2)
    items = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 60)))) for i in range(12)]
    m = Matcher(items, 0.15)
    for _ in range(60):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], ["z"], [x[k], "y"]])
        text = "".join(rng.choice("abcdef ") for _ in range(30)) + "".join(x) + "".join(rng.choice("abcdef ") for _ in range(30))
        got = {m.items[k].ident: d for k, d in m.matches(text).items()}
        want = {it.ident: d for it in m.items if (d := edits(it.text, normal(text))) <= it.budget}
        assert got == want


def test_contamination(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    docs = [(1, f"start {item.upper()} end", "o"), (2, item.replace("quick", "quack"), "o"), (3, "clean words only", "o"), (4, None, "o"), (5, "", "o"), (None, item.replace(" ", "\n \t"), "o"), (1, f"start {item.upper()} end", "o")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_items string")
    bench = spark.createDataFrame([(7, item, "e"), (8, item, "e"), (9, None, "e"), (10, "", "e"), (None, "clean words only", "e")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.contaminated, r.n_items, r.item_ids, r.least_distance) for r in contamination(df, bench).collect()), key=str)
    assert got == sorted([(1, True, 2, "7,8", 0), (1, True, 2, "7,8", 0), (2, True, 2, "7,8", 1), (3, True, 1, "", 0), (4, False, 0, "", None), (5, False, 0, "", None), (None, True, 2, "7,8", 0)], key=str)
    assert not any(r.contaminated for r in contamination(df, bench.limit(0)).collect()) and contamination(df.limit(0), bench).collect() == []


def test_mix(spark):
    docs = [(i, f"s{i % 7}" if i % 7 else None, " ".join(["w"] * (i * 13 % 50))) for i in range(1, 200)] + [(None, "s1", "a b c"), (500, "s2", None), (500, "s2", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mix(df).collect()
    assert len(rows) == len(docs) and rows == mix(df.repartition(5)).collect()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].source_size == sum(r.size for r in own) and own[0].target <= 2 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6
    spots = [r.position for r in rows if r.position is not None]
    assert spots == sorted(spots) and 0 <= spots[0] and spots[-1] < 1
    assert mix(df.limit(0)).collect() == []


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    s = ((0.0, 0.5), (0.5, 2.0), (1.0, 1.0))
    df = spark.range(0, 100).select((F.col("id") / 100).alias("q")).select("q", _time(s, F.col("q")).alias("t"))
    for q, t in df.collect():
        done = 0.5 * t + 1.5 * t * t if t <= 0.5 else 0.625 + 2 * (t - 0.5) - (t - 0.5) ** 2
        assert abs(done - q * 1.375) < 1e-9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{abs(hash(name))}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    assert {r.doc_id for r in corpus_pipeline.mixed(spark, docs, DATA).collect()} == before
