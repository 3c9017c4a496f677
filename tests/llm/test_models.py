"""The trained operators: gradients, exactness, held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest

from tidegauge.llm import html, langid, pii, quality

DATA = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# --- quality ---------------------------------------------------------------


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(0)
    truth = np.zeros(quality.DIM)
    truth[[10, 20]] = (3, -3)
    rows = [np.flatnonzero(rng.random(60) < 0.2).astype(np.int32) for _ in range(1500)]
    z = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=1500)
    m = quality.fit(rows, np.digitize(z, [-1, 2]), 3, l1=0.02)
    assert m.thresholds[0] < m.thresholds[1] and m.weights[10] > 1.5 and m.weights[20] < -1.5
    assert np.abs(np.delete(m.weights[:60], [10, 20])).max() < 0.7
    assert (np.diff(m.tails(rows[0])) <= 0).all()


def test_quality_fit_holds_few_bytes_a_feature():
    """The fit runs on the driver, beside Spark's own memory."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60_000, 400).astype(np.int32)) for _ in range(6000)]
    tracemalloc.start()
    quality.fit(rows, rng.integers(0, 3, len(rows)), 3, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * sum(len(r) for r in rows)


def test_quality_operator(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = {r.doc_id: r for r in quality.grade(docs, quality.train(docs, labels)).collect()}
    toxic = {"moron", "loser", "scum", "clown", "stupid", "disgusting", "worthless", "idiot", "pathetic", "trash"}
    bad = [r for r in got.values() if toxic & set(r.text.lower().split())]
    assert np.mean([not r.accepted for r in bad]) > 0.85
    good = [got[r.doc_id] for r in labels.where("quality = 1 and toxic = 0").collect() if r.doc_id in got]
    assert np.mean([r.accepted for r in good]) > 0.93
    junk = [got[r.doc_id] for r in labels.where("quality = 0").collect() if r.doc_id in got]
    assert np.mean([not r.accepted for r in junk]) > 0.75
    odd = spark.createDataFrame([(None, None, True), (1, "", True), (1, "", True), (2, "x " * 50_000, True)], "doc_id long, text string, accepted boolean")
    model = quality.train(odd, labels.limit(0))
    assert [r.accepted for r in quality.grade(odd, model).collect()] == [True] * 4
    assert quality.grade(odd.limit(0), model).collect() == []


# --- language --------------------------------------------------------------


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    counts, k = [1, 70, 0, 33, 32, 200], 3
    text = np.repeat(np.arange(len(counts)), counts)
    scores, moves = rng.normal(size=(len(text), k)), rng.normal(size=(k, k))
    p = langid.marginals(scores, text, len(counts), moves)
    a = np.exp(moves - moves.max())
    for t in range(len(counts)):
        psi = np.exp(scores[text == t])
        if not len(psi):
            continue
        alpha, x = [], np.full(k, 1 / k)
        for q in psi:
            x = (x @ a) * q
            x /= x.sum()
            alpha.append(x)
        beta = [np.ones(k)]
        for q in psi[:0:-1]:
            b = a @ (q * beta[-1])
            beta.append(b / b.sum())
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(p[text == t], want / want.sum(axis=1, keepdims=True), atol=1e-9)


def test_language_held_out(spark):
    docs = read(spark, "documents")
    field = langid.learn(docs, 40)
    got = {r.doc_id: r for r in langid.identify(docs, field).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    mixed = [r.text for r in docs.where("lang = 'en'").limit(1).collect()][0][:400] + " " + [r.text for r in docs.where("lang = 'fr'").limit(1).collect()][0][:800]
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "123 !!", "x"), (3, mixed, "x"), (3, mixed, "x")], "doc_id long, text string, held_out string")
    rows = langid.identify(odd, field).collect()
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3 and rows[3].lang_pred == rows[4].lang_pred == "fr" and rows[3].switches >= 1
    assert langid.identify(odd.limit(0), field).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, langid.train([])).collect()} == {"und"}


# --- personal data ---------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(2)
    net = pii.train([], ["some", "words"], steps=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.integers(0, pii.N_CHARS, (3, 9))
    y = np.stack([pii._tags(9, [(2, 5, "email")]), pii._tags(9, []), pii._tags(9, [(0, 2, "ip"), (2, 6, "phone")])])

    def loss():
        s, m = net.emissions(x).astype(np.float64), net.moves()
        total = 0.0
        for w in range(3):
            a = s[w, 0].copy()
            a[2::2] -= 1e4
            gold = a[y[w, 0]]
            for t in range(1, 9):
                v = a[:, None] + m
                a = v.max(0) + np.log(np.exp(v - v.max(0)).sum(0)) + s[w, t]
                gold += m[y[w, t - 1], y[w, t]] + s[w, t, y[w, t]]
            total += a.max() + np.log(np.exp(a - a.max()).sum()) - gold
        return total / 3

    g = pii._gradients(net, x, y)
    for name in ("fh", "bx", "out", "embed", "moves", "b0"):
        flat = np.argsort(-np.abs(g[name]).ravel())[:2]
        for f in flat:
            at = np.unravel_index(f, g[name].shape)
            old, e = net.p[name][at], 1e-3
            net.p[name][at] = old + e
            up = loss()
            net.p[name][at] = old - e
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / (2 * e) - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_base_spans():
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c@d.e", "x@y", "@a.b", "a.b+c@d-e.f.g, h@i.j", "a@@b.c", "a@b..c", "@", "q@w.e.@r.t"):
        assert pii._emails(t) == [(m.start(), m.end(), "email") for m in email.finditer(t)], t
    text = "mail a.b@c.de, ip 10.0.0.255 not 1.2.3.256, card 4111 1111 1111 1111 not 4111111111111112, call +1 (017) 555-7713 or +12"
    kinds = [(text[a:b], k) for a, b, k in pii.base_spans(text)]
    assert kinds == [("a.b@c.de", "email"), ("10.0.0.255", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (017) 555-7713", "phone")]
    assert pii.base_spans("") == [] and pii.base_spans("9" * 100_000) == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """The fixed patterns, straight from their definition."""
    import re

    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = [int(x) for x in m[0] if x.isdigit() and x.isascii()]
            twice = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and (not 12 <= len(d) <= 19 or sum(twice) % 10) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_personal_data(spark):
    import hashlib

    docs = read(spark, "documents")
    net = pii.learn(docs, 150)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.personal_data(docs, net).collect()}
    for r in rows:
        base = plain_base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert all(got[r.doc_id][f"n_{k}"] == sum(s[2] == k for s in base) for k in pii.KINDS)
        assert {pii.listed([s]) for s in base} <= set(got[r.doc_id].spans.split(","))
    # Held-out sentences of other words: spans that no pattern lists are found, too.
    rng, words = np.random.default_rng(99), "walnut river seven quiet market lamp orchid copper window thirty maple stone harbour velvet canyon".split()
    made = pii.made_up(rng, 900, words)
    found = pii.find_all([t for t, _ in made], net)
    new = [(s, x) for (_, spans), (base, x) in zip(made, found, strict=True) for s in spans if s not in base]
    assert len(new) > 300 and np.mean([any(s[0] < y[1] and y[0] < s[1] and s[2] == y[2] for y in x) for s, x in new]) > 0.85
    none = [x for (_, spans), (_, x) in zip(made, found, strict=True) if not spans]
    assert len(none) > 100 and np.mean([not x for x in none]) > 0.9
    # Clean documents get hardly any spans from the network.
    clean = [r.text for r in rows if not pii.base_spans(r.text)]
    assert sum(len(x) for _, x in pii.find_all(clean, net)) < 40e-6 * sum(map(len, clean))
    odd = spark.createDataFrame([(None, None, "k"), (1, "", "k"), (2, "ä a@b.cd " + "x" * 50_000, "k"), (2, "ä a@b.cd " + "x" * 50_000, "k")], "doc_id long, text string, spans string")
    out = pii.personal_data(odd, net).collect()
    assert [r.n_email for r in out] == [0, 0, 1, 1] and out[0].spans == out[1].spans == "" and "email:2:8" in out[2].spans and out[2].spans == out[3].spans
    assert pii.personal_data(odd.limit(0), net).collect() == []


def test_windows_and_fast_scores():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = pii.window_starts(size)
        covered = np.zeros(size, bool)
        for a in starts:
            covered[a : a + pii.WINDOW] = True
        assert covered.all() and all(b - a <= pii.WINDOW - pii.OVERLAP for a, b in zip(starts, starts[1:], strict=False))
    net = pii.train([], ["some", "words"], steps=3)
    net.p["moves"] += np.random.default_rng(3).normal(size=net.p["moves"].shape).astype(np.float32)
    x = np.random.default_rng(4).integers(0, 99, (300, 40))
    assert np.allclose(net.scores(x.T), net.emissions(x).transpose(2, 1, 0), atol=1e-4)
    # The bound loses no window: all paths that leave "outside" are found.
    tags = net.best(net.emissions(x))
    kept, some = net.spotted(x.T)
    assert kept.tolist() == np.flatnonzero(tags.any(axis=1)).tolist() and (some == tags[kept]).all()
    # A text gives the same spans whatever stands beside it.
    texts = ["call 017-555-7713 now", "plain words only " * 60, "write to walnut at river dot com"]
    assert [pii.find_all([t], net) for t in texts] == [[r] for r in pii.find_all(texts, net)]


# --- html ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><div class="top-nav"><a href=x>Home</a></div><nav>menu</nav><div class="ad">buy {n}</div>
<div class="wrap"><div class="story"><h1>Head&nbsp;{n}</h1><p>One <b>bo</b>ld {n} &amp; <i>x</i><p>Two<br>lines {n}<ul><li>i{n}<li>j</ul><div class="comments"><p>first {n}!</p></div><script>var s="<p>no</p>";</script></div>
<div class="sidebar">side {n}</div></div><form><p>sign up</p></form><footer>&copy; site {n}</footer></body></html>"""


def test_wrapper_without_article_tags(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(n=i * 1111), "z") for i in range(1, 6)]
    pages += [(None, None, None, "z"), (20, "not a url", "", "z"), (21, "http://lone.example/", "<p>just &lt;this&gt;", "z"), (1, "http://h.example/1", PAGE.format(n=1111), "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = html.main_text(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    for i in range(1, 6):
        n = i * 1111
        assert by[i].text == f"Head {n} One bold {n} & x Two lines {n} i{n} j" and by[i].n_chars == len(by[i].text)
    assert by[None].text == "" and by[20].text == "" and by[21].text == "just <this>"
    assert html.main_text(df.limit(0)).collect() == []


def best_match(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.inner) + 1) for _ in range(len(a.inner) + 1)]
    for i, p in enumerate(a.inner):
        for j, q in enumerate(b.inner):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + best_match(p, q))
    return 1 + best[-1][-1]


def test_tree_matching():
    rng = np.random.default_rng(6)

    def tree(depth):
        return html.Block("rxyz"[rng.integers(4)] if depth < 3 else "r", inner=[tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else [])

    for _ in range(300):
        a, b = tree(3), tree(3)
        n, pairs = html.match(a, b)
        assert n == best_match(a, b) == len(pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == n
        assert all(x.label == y.label for x, y in pairs)
        place = [{id(x): i for i, x in enumerate(html.in_order(t))} for t in (a, b)]
        there = sorted((place[0][id(x)], place[1][id(y)]) for x, y in pairs)
        assert [y for _, y in there] == sorted(y for _, y in there)  # order is kept
        assert [x.label for x in html.in_order(html.unpacked(html.packed(a)))] == [x.label for x in html.in_order(a)]
    assert html.match(html.Block("x"), html.Block("y"))[0] == 0


def test_pages_of_the_tables(spark):
    import html as entities
    import re

    pages = read(spark, "pages")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"<(/?(p|h\d|br|div|li|ul)\b[^>]*)>", " ", inner))
        assert got[r.page_id] == " ".join(entities.unescape(plain).split())


def texts_of(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "concat('http://h.example/', page_id) as url", "html")
    return [r.text for r in html.main_text(df).orderBy("page_id").collect()]


def test_articles_stay_whole(spark):
    page = "<body><div>same</div><article><header><h1>Head {n}</h1></header><div class=body><p>{long}</p><ul><li>item {n}</ul></div></article></body>"
    pages = [page.format(n=n, long=f"long text {n} " * 20) for n in range(5)]
    want = [f"Head {n} " + f"long text {n} " * 20 + f"item {n}" for n in range(5)]
    assert texts_of(spark, pages) == want == [html.extract(x, None) for x in pages]
    plain = "<body><div class=lead><p>Lead {n}</p></div><div class=text><div><p>{long}</p></div></div></body>"
    pages = [plain.format(n=n, long=f"long text {n} " * 20) for n in range(5)]
    want = [f"Lead {n} " + (f"long text {n} " * 20).strip() for n in range(5)]
    assert texts_of(spark, pages) == want == [html.extract(x, None) for x in pages]


def test_wrappers_of_all_pages_and_layouts(spark, monkeypatch):
    # A block that only 2 of 40 pages have otherwise is no template; one that all share is.
    one = "<body><div class=top>Site</div><div class=x><section class=s>{s}</section><p>Text {n}</p></div></body>"
    two = "<body><div class=bar>Bar</div><div class=y><div class=note>Same note</div><p>Other {n}</p></div></body>"
    pages = [one.format(n=n, s="odd" if n in (7, 31) else "usual") for n in range(40)] + [two.format(n=n) for n in range(40, 50)]
    want = [f"{'odd' if n in (7, 31) else 'usual'} Text {n}" for n in range(40)] + [f"Other {n}" for n in range(40, 50)]
    assert texts_of(spark, pages) == want
    monkeypatch.setattr(html, "BLOCK_CHARS", 100)
    assert texts_of(spark, pages) == want
    # The wrapper decides: without it the bars stay.
    assert [html.extract(x, None) for x in pages] != want


def test_class_words_inside_articles(spark):
    page = '<article><h1 class="post-header">Title {n}</h1><p>Body {n}</p><div class="related-work side">Work {n}</div><p class="notice">Note {n}</p><div class="comments"><p>first {n}</div></article>'
    want = [f"Title {n} Body {n} Work {n} Note {n}" for n in range(5)]
    pages = [page.format(n=n) for n in range(5)]
    assert texts_of(spark, pages) == want == [html.extract(x, None) for x in pages]


def test_a_teaser_article_and_rotating_adverts(spark):
    teaser = "<body><div class=wrap><article><p>Read also this</p></article><div class=story><h2>Head {n}</h2><p>Story {n}</p></div></div><div class=slot>{ad}</div></body>"
    pages = [teaser.format(n=n, ad=("Buy shoes", "Buy hats")[n % 2]) for n in range(12)]
    assert texts_of(spark, pages) == [f"Head {n} Story {n}" for n in range(12)]


def test_repeated_pages_and_deep_nesting(spark):
    deep = ["<div>" * 5000 + f"core {n}" + "</div>" * 5000 for n in range(4)]
    deep += ["<b>" * 5000 + "bold", "<ul><li>" * 3000 + "item", "<p>" * 5000 + "end"]
    assert texts_of(spark, deep) == [f"core {n}" for n in range(4)] + ["bold", "item", "end"]
    # One page many times over is one page: nothing is template for that.
    same = "<body><div class=a>Only</div><div class=b>page</div></body>"
    df = spark.createDataFrame([(i, "http://one.example/", same) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html.main_text(df).collect()} == {"Only page"}


@pytest.mark.parametrize("bad", ["<", "<p", "</", "<p a='", "<!--", "<script>x", "</p></div>", "<p><div></p></div>", "&#xZZ; &bogus;", "<a" * 500])
def test_any_markup_is_read(bad):
    assert isinstance(html.extract(bad, None), str)


def test_best_paths_are_searched_for_many_blocks_at_once(monkeypatch):
    net = pii.train([], ["some", "words"], steps=3)
    net.p["moves"] += np.random.default_rng(3).normal(size=net.p["moves"].shape).astype(np.float32)
    texts = [f"call 017-555-77{i} now or write to walnut{i} at river dot com " * (1 + i % 3 * 6) for i in range(40)]
    want, searches, best = pii.find_all(texts, net), [], pii.Network.best
    monkeypatch.setattr(pii.Network, "best", lambda self, scores: searches.append(len(scores)) or best(self, scores))
    monkeypatch.setattr(pii, "BLOCK", 8)
    monkeypatch.setattr(pii.Network, "doubtful", lambda self, x, f=pii.Network.doubtful: (f(self, x)[0][:3], f(self, x)[1][:3]))
    some = pii.find_all(texts, net)
    assert len(some) == len(want) and len(searches) > 1 and all(n >= pii.BLOCK for n in searches[:-1]) and max(searches) < pii.BLOCK + 3
    monkeypatch.undo()
    monkeypatch.setattr(pii, "BLOCK", 8)
    assert pii.find_all(texts, net) == want
