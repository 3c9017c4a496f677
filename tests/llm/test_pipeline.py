"""The pipeline against brute force, and each stage on odd rows."""

import random

import corpus_pipeline as pipeline
import pytest
from test_near import brute, brute_lines, words

from tidegauge.llm import quality
from tidegauge.llm.decontamination import RATE, normal

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage_distance(item, text):
    """The least edit distance between ``item`` and a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(k, words(rng, 9)) for k in range(3)]
    boiler = "this line of legal text stands at the end of all documents"
    rows = []
    for i in range(70):
        body = "\n".join(words(rng, rng.randrange(6, 18)) for _ in range(rng.randrange(1, 4)))
        if i % 9 == 4:
            body = rows[-1][1].replace(boiler, "").strip() + " tail" + str(i)  # a near copy
        if i % 13 == 5:
            body += "\n" + words(rng, 4) + " " + items[i % 3][1].replace("red", "rad") + " end" + str(i)
        if i % 7 == 3:
            body = " ".join(["dreadful", "rubbish"] * 4) + "\n" + body
        rows.append((i, body + ("\n" + boiler if i % 2 else ""), "en", f"s{i % 4}", 0))
    rows += [(90, None, "en", "s1", 0), (91, "", "en", None, 0), (92, boiler, "en", "s2", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0 if i % 7 == 3 else 1, 1 if i % 7 == 3 else 0) for i in range(70)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_pipeline_is_its_brute_force(spark, tables):
    at, rows, items = tables
    model = quality.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    kept = [(r[0], r[1], r[3]) for r in rows if model.tails(quality.features(r[1]))[-1] >= quality.LEAST_TAIL]
    assert 0 < len(kept) < len(rows)
    cleaned = brute_lines([(i, t) for i, t, _ in kept])
    kept = [(i, cleaned[i], s) for i, t, s in kept if cleaned[i] == t or cleaned[i].split()]
    near = brute([(i, t) for i, t, _ in kept], 5)
    kept = [x for x in kept if near[x[0]][1] == x[0]]
    before = len(kept)
    kept = [x for x in kept if not any(passage_distance(normal(t), normal(x[1])) <= int(RATE * len(normal(t))) for _, t in items)]
    assert len(kept) < before
    got = {r.doc_id: r for r in pipeline.run(spark, at).collect()}
    assert set(got) == {i for i, _, _ in kept}
    assert all(got[i].size == len((t or "").split()) for i, t, _ in kept)
    for s in {x[2] for x in kept}:
        own = [got[i] for i, _, src in kept if src == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 2 * r.size for r in own)


def test_stages_on_odd_rows(spark, tables, tmp_path):
    at, items = str(tmp_path), tables[2]
    spark.read.parquet(f"{tables[0]}/labels.parquet").limit(0).write.parquet(f"{at}/labels.parquet")  # no rating: all are accepted
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    clash = ["accepted", "contaminated", "c", "d", "n", "stays", "_id", "own_id", "group", "removed", "gone", "lines", "k", "bits", "source_size", "n_removed"]
    text = "one two three four five six seven"
    rows = [(None, None, "en", None, 0), (None, "", "en", "a", 0), (1, text, "en", "a", 0), (1, text, "en", "a", 0), (None, text, "en", "a", 0), (2, "word " * 30_000, "en", "a", 0), (3, "x " + items[0][1], "en", "b", 0)]
    df = spark.createDataFrame([(*r, *("z" for _ in clash)) for r in rows], DOCS + "".join(f", `{c}` string" for c in clash))
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, at)
        assert out.columns == df.columns
        assert all(r.own_id == r.accepted == "z" for r in out.collect())
        ids[name] = sorted((str(r.doc_id) for r in out.collect()))
        assert stage(spark, df.limit(0), at).collect() == []
    assert ids["quality classifier"] == sorted(str(r[0]) for r in rows)
    # The null id comes first, so its line stays; the row of id 1 and its repetition lose theirs and go.
    assert ids["line dedup"] == sorted(["None", "None", "None", "2", "3"])
    assert ids["MinHash near-dedup"] == sorted(["None", "None", "1", "2", "3"])
    assert ids["benchmark decontamination"] == sorted(["None", "None", "None", "1", "1", "2"])
    name, last = pipeline.STAGES[-1]
    assert len(last(spark, df, at).collect()) == len(rows) and last(spark, df.limit(0), at).collect() == []
