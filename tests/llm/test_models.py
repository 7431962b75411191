"""The language model, toxicity, quality rules, HTML and WARC."""

import collections
import hashlib
import html
import io
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from docpipe.llm import elias_fano, html_extract, ngram_lm, quality, toxicity, warc
from docpipe.llm.elias_fano import EliasFano


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 9), (1, 1), (7, 3), (1000, 1010), (5000, 1 << 62), (3000, 50)):
        v = np.sort(r.integers(0, top, n)).astype(np.uint64)
        e = EliasFano.of(EliasFano.build(v).arrays())
        assert (e.access(np.arange(n)) == v).all()
        first = {}
        for i, x in enumerate(v.tolist()):
            first.setdefault(x, i)
        q = np.concatenate([v, r.integers(0, top + 1, 500).astype(np.uint64), np.array([1 << 63], np.uint64)])
        assert [first.get(x, -1) for x in q.tolist()] == e.find(q).tolist()


def test_language_model(make, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CONTEXT_TOKENS", 20)
    df = make()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.collect()]
    learn = [w for i, w in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c, pairs = collections.Counter(), collections.Counter()
    for w in learn:
        c.update(w)
        c["END"] += 1
        pairs.update(zip(["BOS", *w], [*w, "END"]))
    n, v = sum(c.values()), len(c)
    total, kinds, seen = (collections.Counter() for _ in range(3))
    for (a, b), k in pairs.items():
        total[a] += k
        kinds[a] += 1
        seen[b] += 1
    n1, n2 = sum(k == 1 for k in pairs.values()), sum(k == 2 for k in pairs.values())
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))
    p1 = lambda b: (max(seen[b] - 0.75, 0) + 0.75 * v / (v + 1)) / len(pairs)
    p2 = lambda a, b: p1(b) if not total[a] else (max(pairs[a, b] - d, 0) + d * kinds[a] * p1(b)) / total[a]
    assert abs(sum(p2("BOS", b) for b in c) + p2("BOS", "?") - 1) < 1e-9
    want = []
    for i, w in rows:
        t = [*w, "END"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        score = sum(math.log10(p2(a, b)) for a, b in zip(["BOS", *w], t))
        want.append((i if i is not None else -1, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[x] > 0 for x in t), n, base, score))
    trie_rows = ngram_lm.held_out_scores(df).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in trie_rows)
    for g, x in zip(got, sorted(want)):
        assert g[:5] == x[:5]
        assert g[5] == pytest.approx(x[5], rel=1e-9) and g[6] == pytest.approx(x[6], rel=2e-3, abs=1e-3)


def test_language_model_of_order_three(make):
    """Absolute discounting of triples over the model of pairs, by dictionaries."""
    df = make()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.collect()]
    learn = [w for i, w in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    pairs, triples = collections.Counter(), collections.Counter()
    for w in learn:
        t = ["BOS", *w, "END"]
        pairs.update(zip(t, t[1:]))
        triples.update(zip(t, t[1:], t[2:]))
    v = len({b for _, b in pairs})
    total, kinds, seen, whole, kinds3 = (collections.Counter() for _ in range(5))
    for (a, b), k in pairs.items():
        total[a] += k
        kinds[a] += 1
        seen[b] += 1
    for (a, b, _), k in triples.items():
        whole[a, b] += k
        kinds3[a, b] += 1
    ones = lambda c: [sum(k == j for k in c.values()) for j in (1, 2)]
    d2, d3 = (min(0.95, max(0.05, n1 / (n1 + 2 * n2))) for n1, n2 in (ones(pairs), ones(triples)))
    p1 = lambda b: (max(seen[b] - 0.75, 0) + 0.75 * v / (v + 1)) / len(pairs)
    p2 = lambda a, b: p1(b) if not total[a] else (max(pairs[a, b] - d2, 0) + d2 * kinds[a] * p1(b)) / total[a]
    p3 = lambda a, b, c: p2(b, c) if not whole[a, b] else (max(triples[a, b, c] - d3, 0) + d3 * kinds3[a, b] * p2(b, c)) / whole[a, b]
    context = max(whole, key=whole.get)
    assert abs(sum(p3(*context, c) for c in seen) + p3(*context, "?") - 1) < 1e-9
    want = []
    for i, w in rows:
        t = ["BOS", *w, "END"]
        want.append((i if i is not None else -1, len(w) + 1, math.log10(p2(t[0], t[1])) + sum(math.log10(p3(*x)) for x in zip(t, t[1:], t[2:]))))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.score) for r in ngram_lm.held_out_scores(df, order=3).collect())
    for g, x in zip(got, sorted(want), strict=True):
        assert g[:2] == x[:2] and g[2] == pytest.approx(x[2], rel=2e-3, abs=1e-3)


def test_tokens_of_a_slice():
    """Words by their bytes, long ones and texts without any among them."""
    texts = [b"", b" \t\n", b"One two\x0bTWO one", b"x" * 5000 + b" " + b"x" * 5001, "été ÉTÉ".encode(), b"a" * 8 + b" " + b"a" * 9]
    words, sizes, hashes, counts = ngram_lm.numbered(texts)
    plain = [t.lower().split() for t in texts]
    assert sizes.tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(hashes) == len(set(flat)) and (np.diff(hashes.astype(object)) > 0).all()
    number = dict(zip(words.tolist(), flat))
    assert [number[k] for k in words.tolist()] == flat and sum(counts) == len(flat)


def _sorted_blocks(blocks, rows, top):
    """Blocks of triples as tasks pass them on: each in order, some triples in several of them."""
    r = np.random.default_rng(3)
    for _ in range(blocks):
        u, v, x, times = (np.sort(r.integers(2, top, rows)), *(r.integers(2, top, rows) for _ in range(2)), r.integers(1, 9, rows))
        _, first = np.unique(np.stack([u, v, x]), axis=1, return_index=True)
        yield [c[first].astype(np.uint64) for c in (u, v, x, times)]


def test_a_segment_is_merged_in_little_memory():
    """Its blocks, three copies of them in 64-bit columns, were more than an executor had left."""
    blocks = list(_sorted_blocks(12, 100_000, 1 << 20))
    rows = sum(len(b[0]) for b in blocks)
    tracemalloc.start()
    try:
        ngram_lm._segment_arrays(blocks, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 128 * rows


def test_a_segment_merged_by_ranges(monkeypatch):
    """Ranges of any size give the sums of a dictionary, and sequences packed in pieces those packed whole."""
    blocks = list(_sorted_blocks(5, 3000, 30))
    want = collections.Counter()
    for b in blocks:
        for u, v, x, times in zip(*(c.tolist() for c in b)):
            want[u, v, x] += times
    whole = ngram_lm._segment_arrays(blocks, 3)
    for module in (ngram_lm, elias_fano):
        monkeypatch.setattr(module, "PIECE", 128)
    u, v, x, times = ngram_lm._merged_triples(blocks)
    assert list(zip(*(c.tolist() for c in (u, v, x, times)))) == [(*k, n) for k, n in sorted(want.items())]
    for a, b in zip(whole[0] + list(whole[1:]), (parts := ngram_lm._segment_arrays(blocks, 3))[0] + list(parts[1:]), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    assert [len(c) for c in ngram_lm._merged_triples([])] == [0] * 4


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.held_out_scores(none).count() == 0
    one = spark.createDataFrame([(5, "only words")], "doc_id long, text string")
    assert math.isfinite(ngram_lm.held_out_scores(one).first().score)


def test_toxicity(spark, texts):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = r.choice(texts[:40]).split()
        if bad:
            words[r.randrange(len(words))] = r.choice(["idiotic", "scumbag", "moronic"])
        rows.append((i, " ".join(words), "en", 1))
        labels.append((i, int(bad), "x"))
    docs = spark.createDataFrame([*rows, (None, None, None, 1), (9999, "", None, 1)], "doc_id long, text string, lang string, toxic int")
    marks = spark.createDataFrame([*labels, (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 602 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    held = [(got[i].predicted, t) for i, t, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    assert sum(p == t for p, t in held) / len(held) > 0.95
    # Held-out labels must not matter.
    flipped = marks.withColumn("toxic", marks.toxic if False else (1 - marks.toxic))
    mixed = marks.where(~toxicity.held_out()).unionByName(flipped.where(toxicity.held_out()))
    assert (toxicity.train(docs, mixed).weight == model.weight).all()
    one = toxicity.train(docs, marks.where("toxic = 0"))
    assert toxicity.score(docs, one).where("predicted = 1").count() == 0


def test_toxicity_fit_against_plain_descent():
    """Ratios, loss and scores recomputed with dictionaries and plain gradient descent."""
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 60, r.integers(5, 30))).astype(np.int32) for _ in range(80)]
    y = np.array([float(7 in x or 11 in x) for x in (set(q.tolist()) for q in rows)])
    model = toxicity.fit(rows, y)
    count = [[sum(j in set(q.tolist()) for q, c in zip(rows, y) if c == k) + 1.0 for j in range(60)] for k in (0, 1)]
    whole = [sum(c) + toxicity.BUCKETS - 60 for c in count]
    ratio = [math.log(count[1][j] / whole[1]) - math.log(count[0][j] / whole[0]) if count[0][j] + count[1][j] - 2 >= toxicity.MIN_ROWS else 0.0 for j in range(60)]
    used = {j for j in range(60) if abs(ratio[j]) > 0.3}
    x = np.zeros((len(rows), 60))
    for i, q in enumerate(rows):
        for j in set(q.tolist()) & used:
            x[i, j] = ratio[j]
    scale = 1 / max(1.0, math.sqrt((x**2).sum(axis=1).mean()))
    x *= scale
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def loss(w, b):
        z = x @ w + b
        return (weights * (np.logaddexp(0, z) - y * z)).sum() + toxicity.PENALTY / 2 * (w**2).sum()

    w, b = np.zeros(60), 0.0
    for _ in range(60_000):
        error = weights * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.02 * (x.T @ error + toxicity.PENALTY * w), b - 0.02 * error.sum()
    own = np.array([model.weight[j] / (ratio[j] * scale) if j in used else 0.0 for j in range(60)])
    assert all(model.weight[j] == 0 for j in range(60) if j not in used)
    best, start = loss(w, b), loss(np.zeros(60), 0.0)
    assert loss(own, model.intercept) - best < 0.25 * (start - best)
    for i, q in enumerate(rows):
        assert model.score(q) == pytest.approx(1 / (1 + math.exp(-(x[i] @ own + model.intercept))), abs=1e-4)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(make):
    df = make()
    got = {(r.doc_id, r.n_words): r for r in quality.judged(df).collect()}
    for r in df.collect():
        w = plain_statistics(r.text or "")
        g = got[r.doc_id, w[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == w
        assert g.base_failed == (w[0] < 20 or 100 * w[4] > 30 * w[0])
        assert not (g.base_failed and g.kept)


def plain_mcd(x):
    """Squared distances by the smallest determinant that concentration from four starts finds, in NumPy."""
    floors = np.array(quality.FLOORS)
    p, per = x.shape[1], quality._BINS_PER_UNIT
    factor = quality.SUPPORT / quality.chi2_cdf(quality.chi2_quantile(quality.SUPPORT, p), p + 2)

    def cut(bins, share):
        ordered = np.sort(bins)
        return ordered[math.ceil(share * len(ordered)) - 1]

    middle = lambda v: (cut(np.floor(v * per), 0.5) + 0.5) / per
    distances = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        bins = np.floor(per * np.log1p(distances(m, c)))
        near = x[bins <= cut(bins, quality.SUPPORT)]
        return near.mean(axis=0), factor * np.cov(near.T, bias=True) + np.diag(floors**2)

    centre = np.array([middle(x[:, i]) for i in range(p)])
    spread = np.maximum(1.4826 * np.array([middle(np.abs(x[:, i] - centre[i])) for i in range(p)]), floors)
    z = (x - centre) / spread
    squashed = np.cov(np.tanh(z).T, bias=True)
    scale = np.sqrt(np.maximum(np.diag(squashed), 1e-6))
    correlation = squashed / np.outer(scale, scale)
    np.fill_diagonal(correlation, 1)
    signs = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    starts = [
        (centre, np.diag(spread**2)),
        (x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(floors**2)),
        (centre, np.outer(spread, spread) * correlation),
        (centre, np.outer(spread, spread) * (signs.T @ signs / len(x) + 0.01 * np.eye(p))),
    ]
    for _ in range(quality.TRIAL_STEPS):
        starts = [step(*s) for s in starts]
    size = lambda s: np.linalg.slogdet(s[1])[1]
    best = min(starts, key=size)
    while size(better := step(*best)) < size(best) - 1e-9:
        best = better
    return distances(*best), size(best)


def test_determinant_against_random_subsets(spark):
    """No start from a random half of a small group ends lower than the estimate, but for a hair."""
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5)) * np.array([0.8, 0.1, 0.5, 0.2, 0.2]) + np.array([5, 1.5, 0.5, 0.3, 0.3])
    x[:12] += np.array([1.0, 0.5, 4.0, 0.5, 0.5])
    df = spark.createDataFrame([(1, *map(float, row)) for row in x], "g long, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = quality.estimates(df).first()
    assert found.logdet == pytest.approx(plain_mcd(x)[1], abs=1e-6)
    factor = quality.SUPPORT / quality.chi2_cdf(quality.chi2_quantile(quality.SUPPORT, 5), 7)
    size = math.ceil(quality.SUPPORT * len(x))
    lowest = math.inf
    for _ in range(300):
        rows = r.choice(len(x), 30, replace=False)
        last = math.inf
        while True:
            c = factor * np.cov(x[rows].T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2)
            now = np.linalg.slogdet(c)[1]
            if len(rows) == size:
                if now >= last - 1e-9:
                    break
                last = now
            d = x - x[rows].mean(axis=0)
            rows = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))[:size]
        lowest = min(lowest, last)
    assert found.logdet <= lowest + 0.05


def test_quality_outliers(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        words = [r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(r.randrange(500)) for _ in range(r.randrange(60, 400))]
        if i % 40 == 0:
            words = [w + "$$$###" for w in words]
        rows.append((i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12)), "en", "s"))
    rows += [(1000 + i, rows[i][1], "fr", "tiny") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.judged(df).collect()}
    s = np.array([plain_statistics(t)[:5] for i, t, *_ in rows[:400]], float)
    lines = np.array([t.count("\n") + 1 for _, t, *_ in rows[:400]])
    x = np.stack([np.log(s[:, 0]), np.log(s[:, 1] / s[:, 0]), np.log1p(100 * s[:, 2] / s[:, 1]), np.sqrt(s[:, 3] / lines), np.sqrt(s[:, 4] / s[:, 0])], axis=1)
    for i, d in enumerate(plain_mcd(x)[0]):
        assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9)
    assert {i for i in range(400) if not got[i].kept} == set(range(0, 400, 40))
    assert all(got[1000 + i].kept for i in range(5))
    assert quality.drop_rejected(df).count() == 395
    assert quality.judged(df.limit(0)).count() == 0


def test_quality_of_small_languages(spark):
    """A language under a hundred rows, and rare ones that only make a pool together."""
    r = random.Random(10)
    rows, noisy = [], set()
    for lang, n in [("es", 60), *[(f"rare{k}", 8) for k in range(5)]]:
        for i in range(n):
            words = [r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(r.randrange(500)) for _ in range(r.randrange(60, 400))]
            if i % 8 == 0:
                words = [w + "$$$###" for w in words]
                noisy.add(len(rows))
            rows.append((len(rows), "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12)), lang, f"s{i % 3}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judged(df).collect()
    assert {x.doc_id for x in got if not x.kept} == noisy
    assert all(x.distance is not None for x in got)


def test_rejected_rows_go_where_they_lie(spark, small, monkeypatch):
    """Neither the rows nor what they hold is dealt anew, however many are rejected; more sources than are broadcast give the same."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(docs.limit(20).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars"))
    want = sorted(r.doc_id for r in quality.judged(docs).collect() if r.kept)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        kept = quality.drop_rejected(docs)
        assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns
        plan = kept._jdf.queryExecution().optimizedPlan().toString() + kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(quality, "BROADCAST_SOURCES", 0)
        assert sorted(r.doc_id for r in quality.drop_rejected(docs).collect()) == want
    finally:
        spark.conf.set(setting, before)


def test_quality_is_native(make):
    from docpipe.llm import common

    plan = quality.measured(make())._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    del common


def test_chi2():
    assert quality.chi2_cdf(2 * math.log(2), 2) == pytest.approx(0.5)
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)


def test_html_of_known_layouts(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_html_held_out_pages():
    from docpipe.llm.page_samples import sample_pages

    model = html_extract.trained()
    exact = 0
    for source in sample_pages(150, 31):
        page = html_extract.Page(source)
        mark = []
        for i, x in enumerate(page.nodes):
            mark.append(x.mark or (mark[x.parent] if i else "0"))
        want = "\n".join(t for k, t in page.runs if mark[k] == "1")
        exact += html_extract.main_texts([source], model)[0] == want
    assert exact >= 140


@pytest.mark.parametrize(
    ("source", "runs"),
    [
        ("<p>one <button>go <p>two</p><p>three</p>", ["one", "two", "three"]),
        ("<p>one <button>go <p>two</p><button>x</button><p>three</p>", ["one", "two", "three"]),
        ("<p>one <select><option>a <div>two</div>", ["one", "two"]),
        ("<p>one<button><div>icon</div> press</button> two</p>", ["one two"]),
        ("The formula <math><mi>x</mi></math> holds", ["The formula x holds"]),
        ("<p>see <video src=v>a film of it</video> and <object>a map</object></p>", ["see a film of it and a map"]),
        ("<script>if (a < b) document.write('<p>no</p><script>')</script><p>yes</p>", ["yes"]),
        ("<head><title>t<p>kept</p>", ["kept"]),
        ("<textarea>left open <p>after</p>", ["after"]),
        ("<script>never closed", []),
    ],
)
def test_elements_left_open(source, runs):
    assert [text for _, text in html_extract.Page(source).runs] == runs


def test_many_elements_left_open():
    page = html_extract.Page("<button>x" * 50_000 + "<p>end</p>")
    assert [t for _, t in page.runs] == ["end"]


def test_html_edge_cases(spark):
    odd = [None, "", "plain text", "<", "<p", "<div><p>open", "<script>never closed", "<p>a&nbsp;b &lt;c&gt; &#233;</p>" * 3, "<div>" * 3000 + "deep" + "</div>" * 3000, "<a href='x'>" * 100]
    rows = [(i, None if i % 2 else "u", h, 1) for i, h in enumerate(odd)] + [(None, "u", "<p>x</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_decoding_is_hierarchical():
    page = html_extract.Page("<div><p>one</p><p>two</p></div><div><p>three</p></div>")
    z = np.array([0.0, 3.0, -0.5, 3.0, -4.0, -4.0])
    assert page.decode(z) in ([True, True, False], [False, True, False])


@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(spark, least):
    r = random.Random(11)
    body = lambda n: "<html>" + " ".join(r.choice(["alpha", "beta", "gamma", "é"]) for _ in range(n)) + "</html>"
    rows = [(i, f"http://h/{i}", body(r.randrange(5, 200))) for i in range(80)]
    rows += [(100 + i, f"http://c/{i}", rows[3][2]) for i in range(20)] + [(200, None, None), (201, "http://e", ""), (202, "a\nb c", "<p>"), (203, "x", "<p>"), (None, "n", rows[3][2])]
    rows += [rows[7]]
    df = spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, record_type string").repartition(4)
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None and len(h) >= least:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= least and i is not None and first[h] != i
        want.append((i if i is not None else -1, len(h), warc.sha1_base32(h), "revisit" if again else "response", first[h] if again else None))
    archives = warc.write_archives(df, least, archive_bytes=20_000)
    got = warc.read_archives(archives, payloads=True).collect()
    assert sorted((x.page_id if x.page_id is not None else -1, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(
        map(str, ((x.page_id if x.page_id is not None else -1, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got))
    ) == sorted(map(str, want))
    texts = {warc.sha1_base32((h or "").encode()): (h or "").encode() for _, _, h in rows}
    assert all(bytes(x.payload) == texts[x.payload_digest] for x in got if x.record_type == "response")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_archive_format():
    import zstandard

    records = [warc.warc_record(i, f"http://h/{i}", f"<p>{'word ' * 40}{i}</p>".encode(), "D" * 32, None, False, "2024-01-01T00:00:00Z") for i in range(200)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    raw = out.getvalue()
    assert raw[:4] == warc.SKIPPABLE_MAGIC
    size = int.from_bytes(raw[4:8], "little")
    assert size > 0 and len(raw) < sum(map(len, records)) / 3
    # A plain reader skips the leading frame, and finds each record in its own frame.
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    frame = plain.decompressobj()
    assert frame.decompress(raw[8 + size :]) == records[0] and frame.unused_data
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    assert hashlib.sha1(b"").digest() and warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_dictionary_of_very_few_records(n):
    """The beginnings of the records serve as a dictionary where none can be trained."""
    records = [f"WARC/1.1 {k} {'some words ' * 30}".encode() for k in range(n)]
    assert bool(warc.build_dictionary(records)) == (n > 0)
    stream = io.BytesIO()
    warc.write_archive(stream, records)
    stream.seek(0)
    assert list(warc.read_archive(stream)) == records


def test_dictionary_of_few_large_records():
    r = random.Random(12)
    words = [f"<td class='c{k}'>word{k}</td>" for k in range(3000)]
    records = [" ".join(r.choice(words) for _ in range(30_000)).encode() for _ in range(30)]
    assert sum(map(len, records)) > 6 * warc.SAMPLE_BYTES
    assert warc.build_dictionary(records)
    stream = io.BytesIO()
    warc.write_archive(stream, records)
    stream.seek(0)
    assert list(warc.read_archive(stream)) == records
