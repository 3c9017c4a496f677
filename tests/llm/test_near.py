"""Line dedup and near-duplicates against brute force."""

import random
import re

from tidegauge.llm.common import components
from tidegauge.llm.lines import dedup_lines, op3_line_dedup
from tidegauge.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, d string, node string, n_lines string"


def words(rng, n):
    return " ".join(rng.choice(["red", "blue", "green", "one", "two", "six", "cat", "dog", "sun", "sea"]) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1, families=12, size=7):
    rng, out = random.Random(seed), []
    for _ in range(families):
        base = words(rng, rng.choice([3, 12, 40, 90])).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = words(rng, 1)
            out.append(" ".join(w))
    out += ["", None, "   ", "Word", "word", "a b", out[0], out[0].upper()]
    return list(enumerate(out, 1))


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets, up = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    for k in (2, 5):
        got = {r.doc_id: r for r in near_duplicates(df, k).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "lone text of its own here", "", "", ""), (None, "a b c d e f", "", "", ""), (5, "a b c d e f", "", "", ""), (5, "a b c d e f", "", "", ""), (9, None, "", "", "")], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(None, 5, None, True), (None, 5, 5, False), (5, 5, 5, True), (5, 5, 5, True), (9, 0, 9, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("x", "y"), ("y", "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string").repartition(7)).collect()}
    assert got == {f"{i:04d}": "0000" for i in range(61)} | dict.fromkeys("xyz", "x")


def brute_lines(rows):
    seen, out = [], {}
    for i, text in rows:
        stay = []
        for line in (text or "").split("\n"):
            w = line.lower().split()
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            if not any(100 * len(s & t) >= 80 * len(s | t) for t in seen if s):
                stay.append(line)
            if s:
                seen.append(s)
        out[i] = None if text is None else "\n".join(stay)
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [t for _, t in corpus(9, 8, 6) if t]
    rows = [(i, "\n".join(rng.choice([*lines, "", "short", "Short", " "]) for _ in range(rng.randrange(1, 9)))) for i in range(1, 40)] + [(40, None), (41, ""), (42, "\n\n")]
    df = spark.createDataFrame([(i, t, "x", "y", "taken") for i, t in rows], SCHEMA)
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "d", "node", "n_lines", "n_lines_", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_lines_ == (0 if t is None else t.count("\n") + 1)
    assert sum(r.n_removed for r in got.values()) > 20


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(None, "same line here", "", "", ""), (1, "same line here\nother", "", "", ""), (2, "x\nx", "", "", ""), (2, "x\nx", "", "", "")], SCHEMA)
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "same line here", 0), (1, "other", 1), (2, "x", 1), (2, "x", 1)], key=str)
    assert dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_query_returns_the_rebuilt_text(spark, tmp_path):
    rows = [(1, "the very same line stands here\nlone one"), (2, "other\nThe very same line stands here\n"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.removed) for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 2, 0, []), 2: ("other\n", 3, 1, [1]), 3: (None, 0, 0, [])}


def test_line_dedup_of_null_and_shared_ids(spark):
    rows = [(None, "alpha one\nsame line here"), (None, "beta one\nsame line here"), (None, "same line here\nonly in this one"), (7, "same line here"), (8, "shared start\nq r s"), (8, "shared start\nt u v"), (9, "q r s\nnew")]
    got = [(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    lines = sorted(x for _, t in got for x in t.split("\n") if x)
    assert lines == sorted(["alpha one", "beta one", "same line here", "only in this one", "shared start", "q r s", "t u v", "new"])
    # A row repeated as a whole is one document, also without an id.
    twice = [(None, "a b c\na b c"), (None, "a b c\na b c"), (None, "a b c\nd")]
    got = sorted(r.text for r in dedup_lines(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got in (["a b c", "a b c", "d"], ["", "", "a b c\nd"])


def test_line_dedup_of_string_ids_and_a_very_common_line(spark):
    rng = random.Random(8)
    common = "this very common line stands in every one of these documents"
    base = words(rng, 30)
    rows = [(f"id{i:03d}", f"{common}\n{words(rng, 12)}\n{base if i % 3 else base + ' tail'}") for i in range(200)]
    df = spark.createDataFrame(rows * 2, "doc_id string, text string").repartition(5)
    got = {(r.doc_id, r.text) for r in dedup_lines(df).collect()}
    assert got == set(brute_lines(rows).items()) and dedup_lines(df).count() == 400


def test_line_dedup_leaves_only_the_last_table(spark, tmp_path):
    import os

    from tidegauge.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    dedup_lines(spark.createDataFrame([(1, "a b c\na b c")], "doc_id long, text string")).collect()
    assert [x.split("-")[0] for x in set(os.listdir(root)) - before] == ["marks"]


def test_one_row_of_each_group_stays(spark):
    from corpus_pipeline import one_of_each_group

    a, b, other = "one two three four five six", "red blue green cat dog sun", "a text that only stands here once"
    rows = [(None, a, "x"), (None, a, "y"), (None, b, "x"), (None, b, "x"), (3, b, "x"), (3, b, "x"), (4, b, "x"), (4, other, "x"), (5, "", "x"), (None, None, "x"), (6, "seven eight", "x"), (6, "seven eight", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in one_of_each_group(spark, df, "").collect()), key=str)
    assert got == sorted([(None, a), (3, b), (4, other), (5, ""), (None, None), (6, "seven eight")], key=str)
    plain = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (None, b, "x")], "doc_id long, text string, source string")
    assert sorted((r.text for r in one_of_each_group(spark, plain, "").collect())) == [a, b]


def test_line_dedup_counts_tokens_in_parts(spark, monkeypatch):
    """No part's tokens, and so no part's shuffle, are those of all prefixes; rows are the same."""
    from tidegauge.llm import lines

    rng, tables = random.Random(3), {}
    texts = [t for _, t in corpus(9, 8, 6) if t]
    rows = [(i, "\n".join(rng.choice(texts) for _ in range(6))) for i in range(40)]
    keep = lines.stored

    def stored(df, name):
        out = keep(df, name)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", stored)
    monkeypatch.setattr(lines, "PART_ROWS", 20, raising=False)
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: t for k, (t, _) in got.items()} == brute_lines(rows)
    assert sum(tables["shared"]) > 2 * max(tables["shared"]) and sum(tables["met"]) > 2 * max(tables["met"]) and sum(tables["star"])


def test_line_dedup_orders_only_lines_that_may_be_near_another(spark, monkeypatch):
    """Lines with too many tokens of their own get no prefixes; rows are the same, also
    where all lines share the 40 bits that the lone ones are known by."""
    from tidegauge.llm import lines

    rng, tables = random.Random(4), {}
    base = [words(rng, 30) for _ in range(4)]
    near = [f"{b} {x}" for b in base for x in ("one", "two", "three")] + ["a b " * 20, "a b " * 21 + "a", "short line", "Short line"] + ["hot line " + base[0]] * 40
    rows = [(i, f"{words(rng, 40)} {i}\n{near[i % len(near)]}\n{words(rng, 25)} {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep = lines.stored

    def stored(df, name):
        out = keep(df, name)
        tables.setdefault(name, []).append(out.select("u").distinct().count() if name == "prefixes" else out.count())
        return out

    monkeypatch.setattr(lines, "stored", stored)
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == brute_lines(rows)
    assert tables["prefixes"][0] < 60 < tables["firsts"][0]
    monkeypatch.setattr(lines, "_LINE", "u & 0")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == brute_lines(rows)


def test_line_dedup_runs_stand_for_tokens_of_their_own(spark):
    """What runs that another line lacks stand for is never more than the tokens it lacks,
    and fewer rows are dealt out than tokens."""
    from tidegauge.llm import lines

    rng = random.Random(6)
    texts = sorted({t.lower() for _, t in corpus(5, 5, 4) if t and t.strip()} | {" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)} | {" a\tb  c d e\rf "})
    df = spark.createDataFrame(list(enumerate(texts)), "u long, low string")
    for k in (1, 2, 3, 4, 5, 6):
        runs = {}
        for r in lines._runs(df, k).collect():
            mine = runs.setdefault(r.u, {})
            mine[r.t] = min(r.k, mine.get(r.t, r.k))
        sets = [shingles(t, k) for t in texts]
        for a, x in enumerate(sets):
            mine = runs.get(a, {})
            assert sum(mine.values()) <= len(x)
            for b, y in enumerate(sets):
                assert sum(n for t, n in mine.items() if t not in runs.get(b, {})) <= len(x - y)
        if k == 5:
            assert 0.4 * sum(map(len, sets)) > sum(len(x) for x in runs.values()) > 0
            assert any(n > 1 for x in runs.values() for n in x.values())


def test_line_dedup_does_a_lines_work_once(spark, monkeypatch):
    """The bits of a line are counted, and its tokens ordered, once and not for each row of
    its prefix; the sets of two lines are intersected once."""
    from tidegauge.llm import lines

    plans, keep = {}, lines.stored

    def stored(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(lines, "stored", stored)
    rows = [(1, "a b c d e f g h i j k\nother"), (2, "a b c d e f g h i j k l\n \t\r\x0b\x0c\n\t x y")]
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_lines(rows)
    ordered = plans["prefixes"]
    assert ordered.index("Generate ") < ordered.index("aggregate(") and ordered.count("sort_array(") == 1
    assert plans["gone"].count("array_intersect(") == 1
