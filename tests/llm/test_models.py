"""Quality, top-k search, HTML, near-duplicates and the language model against plain Python."""

import math
import random
import zlib

import numpy as np
import pytest

from gazette.llm import common, graph, html_text, language_model, near_dedup, quality, queries, topk

VOCAB = [f"{a}{b}" for a in "ka lo mi tu re sa no".split() for b in "ban dor fil gus hem jot".split()]


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def near_rows():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (None, "no id at all here"), (None, "no id at all here"), (None, None), (9, "x " * 20000)]
    base = [rng.choice(VOCAB) for _ in range(160)]
    for k in range(120):  # a group at the border of the threshold
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            w[rng.randrange(len(w))] = rng.choice(VOCAB) + str(rng.randrange(50))
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, rows[20][1]) for k in range(40)]  # exact copies
    rows += [(3000 + k, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    rows += [(3000, "É é  É x É y"), (3000, "repeated id"), (3001, rows[25][1] + " end")]
    return rows


def brute_groups(rows, width, percent):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    of[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("width,percent,few", [(3, 85, 1 << 16), (5, 80, 0)])
def test_near_groups(spark, monkeypatch, width, percent, few):
    monkeypatch.setattr(graph, "FEW", few)  # components in one task, and by rounds
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 30)  # so that groups meet in several blocks
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, label int").repartition(5)
    got = sorted(((r.doc_id, r.n, r.component_id) for r in near_dedup.groups(docs, width, percent).collect()), key=repr)
    assert got == brute_groups(rows, width, percent)


def test_sets_of_large_groups_are_sent_few_times(spark, monkeypatch):
    """A group of thousands of near copies, and one of strangers that look alike: how often a node is dealt."""
    rng = random.Random(9)
    base = [rng.choice(VOCAB) + str(k % 9) for k in range(120)]
    rows = []
    for k in range(3000):
        w = list(base)
        w[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen, real = [], near_dedup.confirmed

    def watched(sets, similarity):
        seen.append(sets.count())
        return real(sets, similarity)

    monkeypatch.setattr(near_dedup, "confirmed", watched)
    got = near_dedup.groups(docs, 3, 85)
    assert got.select("component_id").distinct().count() == 1 and got.where("component_id = 0").count() == 3000
    assert 3000 < sum(seen) < 2 * 3000
    members = spark.createDataFrame([(1, k, k % 100 == 0) for k in range(20000)], "label long, node long, outer boolean")
    sizes = spark.createDataFrame([(1, 1, 25)], "label long, outer_blocks long, inner_blocks long")
    pairs = near_dedup.in_blocks(members, "label", sizes)
    assert pairs.count() == 19800 + 200 * 26 and pairs.groupBy("key").agg({"side": "min"}).count() == 26


def test_deduplicate_keeps_one(spark):
    rows = near_rows()[:140]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n int")
    out = near_dedup.deduplicate(docs, 3, 85)
    groups = brute_groups(rows, 3, 85)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.where("doc_id is not null and trim(text) <> ''").collect() if words(r.text)) == sorted({c for _, n, c in groups if n and c is not None})
    assert out.where("text is null").count() == 2 and near_dedup.groups(docs.limit(0)).count() == 0 and near_dedup.deduplicate(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = x[:3000], x[600:3600]
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(np.union1d(a, b))).all()
    got = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(got - 2400 / 3600) < 0.13


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(60)] + [(9, 9)]
    of = {}

    def root(x):
        of.setdefault(x, x)
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            of[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in of}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 1 + k % 5, 16)]) for k in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (420, []), (421, [0.5]), (None, [1.0] * 16), (40, rows[41][1]), (441, rows[41][1]), (442, rows[41][1]), (460, [0.0] * 16), (461, [3e9] * 16), (480, [-2e9] * 16)]
    return rows


def brute_topk(rows, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for n, (j, w) in enumerate(good) if n != at))[:k]
            out += [(i, r, None if none else j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, none, j) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def test_topk(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    for names in ({}, {"QUERY_BLOCK": 7, "VECTOR_BLOCK": 16}, {"QUERY_BLOCK": 2, "VECTOR_BLOCK": 9, "RUN": 3, "QUERY_RUN": 2}):
        for name, value in names.items():
            monkeypatch.setattr(topk, name, value)
        got = sorted(map(tuple, topk.search(topk.usable(df)).collect()), key=repr)
        assert got == brute_topk(rows)


def test_topk_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(topk.usable(df)).collect()] == [(0, 1, 1, 64 * 128 + 128 * 64)]
    assert topk.search(topk.usable(df.limit(0))).count() == 0
    assert topk.search(topk.usable(df.where("vec_id = 1"))).count() == 0


def test_html():
    r = html_text.rendered
    assert r(None) == "" and r("") == "" and r("plain & text &lt;b&gt;") == "plain & text <b>"
    assert r("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\nd"
    assert r("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>z") == "- x\n- y\n  3. p\n  4. q\n\nz"
    assert r("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>") == "aa  b\nc   dd"
    assert r("<p hidden>no<p style='DISPLAY : none'>no<script>if (a<b) '</p>'</script><p>yes") == "yes" and r("<p aria-hidden=true>shown") == "shown"
    assert r("<pre>a\n  b</pre>") == "a\n  b" and r("a<br>b") == "a\nb" and r("<b>un</b>broken <i> spaced </i>x") == "unbroken spaced x"
    assert r("a < b <3 <") == "a < b <3 <" and r("<!-- c --><!doctype html>x<!-- open") == "x"
    assert "deep" in r("<div>" * 5000 + "deep") and r("<td>loose</td>") == "loose"
    assert len(r("<p>" + "w " * 200000)) == 399999


def test_html_at_any_depth():
    r = html_text.rendered
    grid = "<table><tr><td>aa<td>b<tr><td>c<td>dd</table>"
    for way in ("<font>", "<div>", "<span><b>"):
        deep = way * 3000
        assert r(deep + grid) == "aa  b\nc   dd" and r(deep + "<ul><li>x<li>y</ul>z") == "- x\n- y\n\nz"
        assert r(deep + "<pre>a\n  b</pre>") == "a\n  b" and r(deep + "<i hidden>no<b>no</b></i>yes<script>no</script>") == "yes"
    # end tags of deep elements end those, and none of the same name above
    assert r("<div hidden>" + "<div>" * 300 + "</div>" * 300 + "no</div>yes") == "yes"
    assert r("<blockquote>" + "<div>" * 300 + "</div>" * 300 + "in</blockquote>out") == "> in\n\nout"
    assert r("<table><tr><td>" * 300 + "x") == "x" and r("<ul><li>" * 200 + "x") == "  " * 199 + "- x"
    assert r("<p>a <math><mi>x</mi><annotation>no</annotation></math> <map><a>b</a></map> <annotation>c</annotation>") == "a x b c"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", None), (1, "u", "<p>a"), (None, None, "")], "page_id long, url string, html string")
    assert sorted(((r.page_id or 0, r.text) for r in html_text.extract(df).collect())) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert html_text.extract(df.limit(0)).count() == 0
    clash = spark.createDataFrame([("k", "<b>x", "other", 3, "c")], "page_id string, html string, text string, n_chars int, tag string")
    assert [tuple(r) for r in html_text.extract(clash).collect()] == [("k", "x")]


def good_and_bad(n):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        w = [rng.choice(VOCAB) for _ in range(rng.randrange(20, 120))]
        good = k % 4 != 0
        rows.append((k, ". ".join(" ".join(w[a : a + 9]).capitalize() for a in range(0, len(w), 9)) + "." if good else " | ".join(w).upper() + "!!", int(good)))
    return rows


def test_quality(spark):
    rows = good_and_bad(600)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t, _ in rows] + [(None, None, None, None, None, None), (9000, "", "x", "y", 1, 1.0), (9000, "", "x", "y", 1, 1.0), (9001, "z" * 200000, None, None, None, None)], "doc_id long, text string, lang string, source string, quality int, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(1, None, 1), (None, 1, 1), (77777, 0, 0)] + [(i, q, 0) for i, _, q in rows if i % 4 == 0], "doc_id long, quality int, toxic int")
    out = quality.scored(docs, labels).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    truth = {i: q for i, _, q in rows}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)
    held = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if r.score >= 0.3)
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_against_one_solve(spark):
    """The summed system against one in plain numpy, the calibration against a plain isotonic fit, over the same rows."""
    rows = good_and_bad(500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q if i % 9 else 1 - q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    found = quality.features(docs).cache()
    model = quality.fit(found, labels)
    x = {r.doc_id: np.array([r[k] for k in quality.NAMES], np.float32) for r in found.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in x}
    y = {i: float(q if i % 9 else 1 - q) for i, _, q in rows}
    every = np.stack(list(x.values())).astype(float)
    assert np.allclose(model.mean, every.mean(0), atol=1e-5) and np.allclose(model.scale[model.scale != 1], every.std(0)[model.scale != 1], rtol=1e-4)
    fits = [i for i in x if fold[i] in (1, 2, 3)]
    z = model.expand(np.stack([x[i] for i in fits]))
    ridge = 1e-3 * len(fits) * np.diag(np.append(np.ones(z.shape[1] - 1), 1e-6)) + 1e-9 * np.eye(z.shape[1])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + ridge, z.T @ np.array([y[i] for i in fits])), atol=1e-5)
    kernel = z[:40, :-1] @ z[:40, :-1].T
    v = (np.stack([x[i] for i in fits[:40]]).astype(float) - model.mean) / model.scale
    exact = np.exp(-((np.clip(v, -6, 6)[:, None] - np.clip(v, -6, 6)[None]) ** 2).sum(2) / (2 * len(quality.NAMES)))
    assert np.abs(kernel - exact).mean() < 0.1  # what 128 features give
    held = [i for i in x if fold[i] == 4]
    at = np.minimum((np.clip(model.raw(np.stack([x[i] for i in held])), 0, 1) * quality.BINS).astype(int), quality.BINS - 1)
    bins = np.unique(at)
    n, total = np.array([(at == b).sum() for b in bins], float), np.array([sum(y[i] for i, a in zip(held, at, strict=True) if a == b) for b in bins])
    best = [max(min(total[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(bins))) for a in range(k + 1)) for k in range(len(bins))]
    assert np.allclose(np.unique(np.round(model.level, 12)), np.unique(np.round(best, 12)))


def test_pooled():
    at, level = quality.pooled(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert level.tolist() == [0.0, 0.5, 1.0] and at.tolist() == pytest.approx([0.1, 0.25, 0.4])


def test_language_model(spark):
    rng = random.Random(6)
    chain = {w: rng.sample(VOCAB, 3) for w in VOCAB}

    def text():
        w = [rng.choice(VOCAB)]
        while len(w) < 40:
            w.append(rng.choice(chain[w[-1]]))
        return " ".join(w)

    rows = [(k, text()) for k in range(500)] + [(900, None), (901, ""), (None, "unknownword Kaban"), (902, "Kaban x \n kaban"), (902, "Kaban x \n kaban"), (903, "solo " * 30000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = {}
    for i, t in rows:
        if not held(i):
            for w in [*words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in rows), key=repr)
    out = language_model.score(docs)
    got = out.collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    p = {r.held_out: r for r in language_model.perplexity(out.where("doc_id < 500")).collect()}
    assert p[True].perplexity < 0.6 * p[True].base_perplexity
    assert language_model.score(docs.limit(0)).count() == 0
    none = language_model.score(docs.where("crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert none and all(r.base_score == 0 and abs(r.score) < 1e-9 and r.n_known == 0 for r in none)


def model_range(words, n):
    """A range of its own: words sorted hashes, n: {(word number, context): tokens}."""
    keys = sorted(n)
    runs = np.bincount([w for w, _ in keys], minlength=len(words)).astype(np.uint32)
    return language_model.Range(np.array(words, np.uint64).tobytes(), runs.tobytes(), np.array([c for _, c in keys], np.uint16).tobytes(), np.array([n[k] for k in keys], np.uint32).tobytes())


def test_language_model_sums_to_one(spark):
    """Over all words and the unknown one, in seen and unseen restaurants."""
    rng = np.random.default_rng(0)
    word = np.sort(rng.choice(2**62, 30, replace=False).astype(np.uint64))
    n = {(w, int(c)): int(rng.integers(1, 60)) for w in range(30) for c in rng.choice(language_model.CONTEXTS, 5, replace=False)}
    s, r, seats = language_model.Setting(), model_range(word, n), []
    s.add(r.totals())
    for k in range(language_model.SWEEPS):
        r.sweep(s, k, np.random.default_rng(k))
        s.add(r.totals())
        seats = (seats if k > language_model.BURN_IN else []) + r.seats()
    score = language_model.Scorer(model_range(word, n), seats, s)
    for h in (min(c for _, c in n), 5, 60000):
        _, _, logs = score(np.append(word, np.uint64(3)), np.full(31, h))
        assert (10.0**logs).sum() == pytest.approx(1, abs=1e-9)


def rising(start, step, k):
    return math.prod(start + step * i for i in range(k))


def test_language_model_against_all_seatings(monkeypatch):
    """Averaged probabilities against sums over every number of tables of every dish."""
    import itertools

    monkeypatch.setattr(language_model, "DISCOUNTS", np.array([0.5]))
    monkeypatch.setattr(language_model, "STRENGTHS", np.array([1.0]))
    monkeypatch.setattr(language_model, "PLACES", language_model.PATHS + 2)
    counts = {(0, 1): 3, (0, 2): 1, (1, 1): 2, (1, 2): 2, (2, 2): 1}
    d, strength, words, base = 0.5, 1.0, 3, 1 / 4
    exp_s = np.exp(language_model.stirling(d))
    dishes, customers = sorted(counts), {u: sum(n for (_, c), n in counts.items() if c == u) for u in (1, 2)}
    total, want = 0.0, np.zeros((words, 3))
    for seats in itertools.product(*[range(1, counts[k] + 1) for k in dishes]):
        t2 = dict(zip(dishes, seats, strict=True))
        open_ = {u: sum(t for (_, c), t in t2.items() if c == u) for u in (1, 2)}
        c0 = [sum(t for (w, _), t in t2.items() if w == k) for k in range(words)]
        for t0 in itertools.product(*[range(1, c + 1) for c in c0]):
            chance = math.prod(exp_s[counts[k], t2[k]] for k in dishes) * math.prod(rising(strength, d, open_[u]) for u in (1, 2)) * math.prod(exp_s[c, t] for c, t in zip(c0, t0, strict=True)) * rising(strength, d, sum(t0)) / rising(strength, 1, sum(c0)) * base ** sum(t0)
            total += chance
            for w in range(words):
                p0 = (c0[w] - d * t0[w] + (strength + d * sum(t0)) * base) / (strength + sum(c0))
                want[w, 0] += chance * p0
                for u in (1, 2):
                    want[w, u] += chance * (counts.get((w, u), 0) - d * t2.get((w, u), 0) + (strength + d * open_[u]) * p0) / (strength + customers[u])
    want /= total
    s, r, got, kept = language_model.Setting(), model_range([10, 20, 30], counts), np.zeros((words, 3)), 0
    s.add(r.totals())
    for k in range(3000):
        r.sweep(s, k, np.random.default_rng([1, k]))
        s.add(r.totals())
        if k >= 100:
            p0, p1 = r.predictive(s, k + 1)
            got[:, 0] += p0
            x, kept = s.totals[k + 1], kept + 1
            for u in (1, 2):
                got[:, u] += (strength + d * x[u]) * p0 / (strength + customers[u])
            for (w, u), p in zip(dishes, p1, strict=True):
                got[w, u] += p - (strength + d * x[u]) * p0[w] / (strength + customers[u])
    got /= kept
    assert np.abs(np.log10(got / want)).max() < 0.02


def test_language_model_finds_the_discount():
    """Tokens drawn from a process with a discount of 0.8: the sampled ones of root and context, which multiply, come near."""
    rng = random.Random(1)
    n, customers, tables, known = {}, 0, 0, 0
    seats: list[tuple[int, int]] = []
    for _ in range(4000):
        if rng.random() * (1 + customers) < 1 + 0.8 * tables:
            seats.append((known, 1))
            known, tables = known + 1, tables + 1
        else:
            at, left = 0, rng.random() * (customers - 0.8 * tables)
            while left > seats[at][1] - 0.8:
                left, at = left - seats[at][1] + 0.8, at + 1
            seats[at] = (seats[at][0], seats[at][1] + 1)
        customers += 1
    n = {(w, 7): k for w, k in seats}
    s, r = language_model.Setting(), model_range(range(10, 10 + known), n)
    s.add(r.totals())
    for k in range(12):
        r.sweep(s, k, np.random.default_rng([2, k]))
        s.add(r.totals())
    assert abs(s.levels[-1][0] * s.levels[-1][2] - 0.8) <= 0.1


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.randrange(60)))) for k in range(400)] + [(500 + k, f"once{k} w1 w2 once{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (1, 3, 8):
        dealt = docs.repartition(parts)
        common = language_model.common_words(dealt, 2, 250)
        found.append((common.tolist(), {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(dealt).collect()}))
    (words, one), *others = found
    assert 0 < len(words) <= 250
    for common, scores in others:
        assert common == words and set(scores) == set(one)
        assert all(scores[i][:3] == one[i][:3] and scores[i][3:] == pytest.approx(one[i][3:], abs=1e-3) for i in one)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Driver code alone knows where the package is: no PYTHONPATH, another working folder."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in sys.argv[1:]:
    print(name, e.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    names = [n for n in queries.QUERIES if n.split("_")[0] in ("op3", "op5", "op7", "op8", "op9", "op11", "op12", "op13")]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and len(done.stdout.split("\n")) > len(names), done.stderr[-3000:]


def test_contexts_of_common_words_are_their_own(spark):
    text = " ".join(f"w{k % 40}" for k in range(4000))
    docs = spark.createDataFrame([(k, text + f" rare{k}") for k in range(30)], "doc_id long, text string")
    common = language_model.common_words(docs, 3, 40)
    raw = np.frombuffer(text.encode(), np.uint8)
    word, context, _ = language_model.histories(raw, np.array([0, len(raw)]), common)
    assert len(common) == 40 and context[0] == 0 and len(set(context[1:])) == 40 and max(context) <= 40
    pairs = dict(zip(context[1:].tolist(), word[:-1].tolist(), strict=True))
    assert all(pairs[c] == w for c, w in zip(context[1:].tolist(), word[:-1].tolist(), strict=True))


def test_rare_contexts_are_their_own(spark, monkeypatch):
    """Beyond the commonest words as well: no two words share a context, and scores don't depend on which words are common."""
    raw = np.frombuffer(" ".join(f"w{k}" for k in range(20_000)).encode(), np.uint8)
    _, context, _ = language_model.histories(raw, np.array([0, len(raw)]), np.zeros(0, np.uint64))
    assert len(set(context.tolist())) == 20_001
    rng = random.Random(4)
    chain = {w: rng.sample(VOCAB, 3) for w in VOCAB}

    def text():
        w = [rng.choice(VOCAB)]
        while len(w) < 30:
            w.append(rng.choice(chain[w[-1]]))
        return " ".join(w)

    docs = spark.createDataFrame([(k, text()) for k in range(400)] + [(401, "never seen Never before")], "doc_id long, text string").repartition(3)
    found = []
    for most in (60_000, 5, 0):
        monkeypatch.setattr(language_model.common_words, "__defaults__", (most,))
        found.append({r.doc_id: r for r in language_model.score(docs).collect()})
    for other in found[1:]:
        assert set(other) == set(found[0])
        for i, r in other.items():
            assert r[:6] == pytest.approx(found[0][i][:6]) and r.score == pytest.approx(found[0][i].score, abs=0.03 * r.n_tokens)


WORDS = "ash birch cedar elm fir oak pine yew".split()


def random_part(rng, depth):
    kind = rng.choice(("text", "inline", "p", "div", "ul", "ol", "blockquote", "hidden", "table", "br") if depth else ("text", "inline"))
    parts = [random_part(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    said = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))
    if kind == "text":
        return kind, " " + said + " "
    if kind == "inline":
        return kind, rng.choice(("b", "i", "span")), said
    if kind in ("ul", "ol"):
        return kind, [[("text", f" {said} "), *parts] if rng.random() < 0.9 else parts for _ in range(rng.randrange(1, 4))]
    if kind == "table":
        return kind, [[" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 3))) for _ in range(3)] for _ in range(rng.randrange(1, 4))]
    if kind == "p":  # blocks would end it
        parts = [random_part(rng, 0) for _ in range(rng.randrange(4))]
    return kind, said if kind in ("hidden", "br") else parts


def as_html(part):
    kind, said, *more = part
    inside = lambda parts: "".join(map(as_html, parts))
    if kind == "text":
        return said
    if kind == "inline":
        return f"<{said}>{more[0]}</{said}>"
    if kind == "br":
        return f"{said}<br>{said}"
    if kind == "hidden":
        return f"<div style='display:none'>{said}<p>{said}</p></div>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{inside(x)}</li>" for x in said) + f"</{kind}>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in said) + "</table>"
    return f"<{kind}>{inside(said)}</{kind}>"


GAP, END_LINE = object(), object()


def marks(part, within=None):
    """The part as words, ends of lines, gaps, and pushed or popped indents: what a reader would do on paper."""
    kind, said, *more = part
    if kind == "text":
        return [" ", *[w for x in said.split() for w in (x, " ")]]
    if kind == "inline":
        return [*[w for x in more[0].split() for w in (" ", x)][1:]]
    if kind == "br":
        w = [y for x in said.split() for y in (" ", x)][1:]
        return [*w, END_LINE, *w]
    if kind == "hidden":
        return []
    if kind == "table":
        wide = [max(len(row[k]) for row in said) for k in range(3)]
        return [END_LINE, GAP, *[x for row in said for x in (END_LINE, "".join(c.ljust(w + 2) for c, w in zip(row, wide, strict=True)).rstrip())], END_LINE, GAP]
    if kind in ("ul", "ol"):
        gap = [] if within == "li" else [GAP]
        items = []
        for k, x in enumerate(said, 1):
            mark = f"{k}. " if kind == "ol" else "- "
            items += [END_LINE, ("push", mark, " " * len(mark)), *[m for y in x for m in marks(y, "li")], END_LINE, ("pop",)]
        return [END_LINE, *gap, *items, END_LINE, *gap]
    gap = [GAP] if kind in ("p", "blockquote") else []
    push, pop = ([("push", "> ", "> ")], [("pop",)]) if kind == "blockquote" else ([], [])
    return [END_LINE, *gap, *push, *[m for y in said for m in marks(y, kind)], END_LINE, *pop, END_LINE, *gap]


def on_paper(parts):
    lines, line, gap, indents, first = [], "", False, [], {}
    for m in [x for p in parts for x in marks(p)] + [END_LINE]:
        if m is GAP:
            gap = True
        elif m is END_LINE:
            if line.strip():
                last = max((k for k, i in enumerate(indents) if i[1] != "> "), default=0)  # the innermost item's mark is shown
                lead = "".join(first.pop(id(i), i[2]) if k >= last or i[1] == "> " else (first.pop(id(i), 0), i[2])[1] for k, i in enumerate(indents))
                lines += [""] if gap and lines else []
                lines.append((lead + line.strip()).rstrip())
                gap = False
            line = ""
        elif isinstance(m, tuple):
            if m[0] == "push":
                m = list(m)
                indents.append(m)
                first[id(m)] = m[1]
            else:
                first.pop(id(indents.pop()), None)
        else:
            line += m if m != " " or not line.endswith(" ") else ""
    return "\n".join(lines)


def test_html_against_paper():
    rng = random.Random(12)
    for _ in range(1500):
        parts = [random_part(rng, 3) for _ in range(3)]
        source = "".join(map(as_html, parts))
        assert html_text.rendered(source) == on_paper(parts), source


def test_html_that_style_sheets_hide():
    r = html_text.rendered
    css = "<style>/* .a{} */ .gone, p#x { color: red; DISPLAY: none } @media print { .b { display: none } } @media screen { .c { visibility:hidden } } @font-face { src: url(x) } div.d{display:none} .d.keep{display:block} .e p{display:none} .f:hover{display:none}</style>"
    body = "<p class='z gone'>1<p id=x>2<div id=x>3</div><p class=b>4<p class=c>5<div class=d>6</div><div class='d keep'>7</div><div class=e><p>8</div><p class=f>9<p class=gone style='display:block'>10"
    assert r(css + body).split() == ["3", "4", "7", "8", "9", "10"]
    assert r("<p class=a>x</p><style>.a{display:none}") == "" and r("<style>.a{display:none</style><p class=a>x") == "" and r("<style>{}}}{</style>x") == "x"
    hostile = "<style>" + "@media x {" * 20000 + "</style>y" + "<style>" + ".a{display:none}" * 20000 + "}" * 20000 + "</style><p class=b>z"
    assert r(hostile).split() == ["y", "z"]


def test_html_of_fields_and_spans():
    r = html_text.rendered
    assert r("<form><input type=submit value='Send it'> <input type=hidden value=no><input type=password value=no><input value=name><button>Go</button></form>") == "Send it nameGo"
    assert r("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>") == "x  1\n   2"
    assert r("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td rowspan=0>f<tr><td>g<td>h<td>i</table>") == "a  b     c\nd        e\nf\ng  h  i"
    assert r("a\u00a0\u00a0b \n c\u2003d") == "a\u00a0\u00a0b c\u2003d"
    many = "<table>" + "<tr><td rowspan=60000 colspan=1000>x" * 300 + "</table>"
    assert r(many).count("x") == 300


def test_html_of_hostile_pages():
    import time

    r, begun = html_text.rendered, time.time()
    assert r("<table><tr><td colspan='²'>a<td>b</table>") == "a  b" and r(f"<table><tr><td colspan='{'9' * 5000}'>a<td>b</table>").split() == ["a", "b"]
    assert r("&#" + "9" * 6000 + ";x&#" + "0" * 5000 + "65;") == "\ufffdxA"
    for way in ("<a ", '<a "x ', "<a<b", "<!", "<a \"'>", "<?x", "</a "):
        out = r(way * (1_000_000 // len(way)))
        assert len(out) <= 1_000_001
    assert r("<a 'x <b>y</b>") == "<a 'x y" and r("x <a href='") == "x <a href='"
    wide = "<table><tr><td>" + "w " * 4000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(r(wide)) < 2 * len(wide) and r(wide).endswith("a  b")
    spans = "<table>" + "<tr><td colspan=1000>a<td>b" * 2000 + "</table>"
    assert len(r(spans)) < len(spans)
    deep = r("<table><tr><td>a<td>" * 3000 + "x" + "<br>y" * 3000)
    assert deep.count("y") == 3000 and deep.count("a") == 3000 and len(deep) < 60 * 3000 * 20
    assert max(map(len, r("<ul><li>" * 5000 + "x<br>y").split("\n"))) < 410
    assert time.time() - begun < 30


def test_lm_batches_and_pages_are_bounded(spark, monkeypatch):
    """Every table of op9 is computed in Arrow batches of a flush and written a blob a page, not a whole task's text at once."""
    import pyarrow as pa

    seen, write = [], language_model.materialize

    def noted(df, name, **options):
        seen.append((name, int(spark.conf.get(common.BYTES)), options.get("parquet.page.size.row.check.min")))
        return write(df, name, **options)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    monkeypatch.setattr(language_model, "materialize", noted)
    docs = spark.range(0, 48, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 60000) AS text")
    assert language_model.score(docs).count() == 48
    assert {n for n, *_ in seen} >= {"words", "counts", "state0", "met", "sums"}
    assert all(size == language_model.FLUSH_BYTES and rows == "1" for _, size, rows in seen), seen
    with common.setting(spark, common.BYTES, str(language_model.FLUSH_BYTES)):
        found = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 4 * language_model.FLUSH_BYTES and max(found) < 2 * language_model.FLUSH_BYTES


def test_lm_places_and_orders():
    """Lookups by first bits and sorts of packed numbers give what searchsorted, argsort and unique give."""
    rng = np.random.default_rng(3)
    for many in (0, 1, 2, 1000):
        keys = np.unique(np.concatenate([rng.integers(0, 2**64, many, np.uint64), np.array([0, 5, 6, 7, 2**64 - 1] if many else [], np.uint64)]))
        wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64)])
        at, there = language_model.Places(keys)(wanted)
        assert (at == np.searchsorted(keys, wanted)).all() and (there == np.isin(wanted, keys)).all()
        x = rng.integers(0, 50, many, np.uint64)
        assert (language_model.order(x, 6) == np.argsort(x, kind="stable")).all()
        assert (language_model.distinct(x) == np.unique(x)).all()
        some = language_model.order(wanted)
        assert sorted(some.tolist()) == list(range(len(wanted))) and (np.diff((wanted[some] >> np.uint64(11)).astype(np.int64)) >= 0).all()


def test_lm_tables_cost():
    """Numbers of tables are drawn as by the logarithms of all weights, which take more than one and a half times their CPU time."""
    import time

    def plain(c, fresh, discount, weights, rng):
        out, paths = np.minimum(c, 1), np.zeros(len(language_model.DISCOUNTS))
        some = np.flatnonzero((c > 1) & (c <= language_model.EXACT))
        some = some[np.argsort(c[some], kind="stable")]
        cuts = np.searchsorted(c[some], np.arange(2, language_model.EXACT + 2))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 2):
            chance = weights[k, 1 : k + 1] + np.cumsum(np.log(np.stack(list(map(fresh(some[a:b]), range(k))), 1)), 1)
            chance = np.cumsum(np.exp(chance - chance.max(1, keepdims=True)), 1)
            out[some[a:b]] = 1 + (chance < (rng.random(b - a) * chance[:, -1])[:, None]).sum(1)
        at = np.flatnonzero(c > language_model.EXACT)
        t, j = np.ones(len(at)), 1
        while len(at):
            step = max(1, j // 16)
            new, old = fresh(at)(t), np.maximum(j - discount * t, 1e-9)
            group = np.minimum(c[at] - j, step)
            more = rng.binomial(group, np.minimum(new / (new + old), 1))
            paths += ((group - more)[:, None] * np.log(np.maximum(j - language_model.DISCOUNTS * t[:, None], 1e-9))).sum(0)
            t, j = t + more, j + step
            done = c[at] <= j
            out[at[done]] = t[done]
            at, t = at[~done], t[~done]
        return out, paths

    rng = np.random.default_rng(5)
    c = np.minimum((1 / rng.random(300_000)) ** 1.1, 1e5).astype(np.int64)
    share = rng.random(len(c)) ** 4

    def fresh(at):
        some = share[at]
        return lambda i: (3 + 0.4 * i) * some

    found, least = {}, {plain: math.inf, language_model.tables: math.inf}
    for _ in range(3):
        for f in least:
            begun = time.thread_time()
            found[f] = f(c, fresh, 0.4, language_model.stirling(0.4), np.random.default_rng(7))
            least[f] = min(least[f], time.thread_time() - begun)
    (t, paths), (t1, paths1) = found[language_model.tables], found[plain]
    assert (t == t1).all() and paths == pytest.approx(paths1) and t.max() > 24
    assert least[plain] > 1.5 * least[language_model.tables], least.values()
