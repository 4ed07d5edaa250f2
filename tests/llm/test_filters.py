"""Classifiers, rules, URLs, decontamination and packing."""

import random

import brute
import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from tessera.llm import decontamination, gbt, packing, quality_classifier, quality_rules, toxicity, url_filter


def test_trees_are_the_nested_form():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = gbt.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = t.base
        for k in range(len(t.leaf)):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + (row[t.feature[k, at]] > t.threshold[k, at])
            total += t.leaf[k, at - 7]
        return total

    assert np.allclose(t.logit(x[:50]), [walk(r) for r in x[:50]])
    assert ((t.score(x) >= 0.5) == y).mean() > 0.95
    assert gbt.fit(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]
    assert (gbt.fit(x, np.ones(500)).score(x) > 0.5).all()


def test_one_split_is_the_best_one():
    """The histogram's split and leaves against all splits, one by one."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=200) > 5).astype(float)
    t = gbt.fit(x, y, trees=1, depth=1, rate=0.5, least=8)
    base = np.log((y.sum() + 1) / (len(y) + 2) / (1 - (y.sum() + 1) / (len(y) + 2)))
    p = 1 / (1 + np.exp(-base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    splits = []
    for j in range(3):
        for v in np.unique(x[:, j]):
            left = x[:, j] <= v
            if min(left.sum(), (~left).sum()) >= 8:
                splits.append((gain(left) + gain(~left), j, v))
    best = max(splits)
    left = x[:, t.feature[0, 0]] <= t.threshold[0, 0]
    assert t.feature[0, 0] == best[1] and gain(left) + gain(~left) == pytest.approx(best[0])
    assert t.leaf[0].tolist() == pytest.approx([-0.5 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])
    assert t.base == pytest.approx(base)


def test_statistics_are_the_plain_ones():
    texts = ["", "one Two, two two #|x  3!", "a b c " * 30 + "LOUD LOUD", "é\nñ ñ"]
    got = quality_classifier.statistics([t.encode() for t in texts])
    for row, t in zip(got, texts):
        f = dict(zip(quality_classifier.FEATURES, row.tolist()))
        w, raw = t.split(), t.encode()
        n = max(len(w), 1)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want = {
            "bytes": np.log1p(len(raw)), "words": np.log1p(len(w)), "word_size": sum(len(x.encode()) for x in w) / n, "upper": sum(65 <= c < 91 for c in raw) / max(len(raw), 1),
            "digit": sum(48 <= c < 58 for c in raw) / max(len(raw), 1), "symbol": sum(c in b"#*$%&<>@^~_\\{}=+" for c in raw) / n, "bar": t.count("|") / n, "mark": sum(c in "!?" for c in t) / n,
            "wide": sum(c >= 128 for c in raw) / max(len(raw), 1), "line": t.count("\n") / n, "distinct": len(set(w)) / n, "same_as_last": sum(a == b for a, b in zip(w, w[1:])) / n,
            "repeated_3": sum(three.count(x) > 1 for x in three) / n, "top_word": max((w.count(x) for x in w), default=0) / n, "short_words": sum(len(x.encode()) == 1 for x in w) / n,
        }
        assert {k: f[k] for k in want} == pytest.approx(want), t
        segments = [w[i : i + 48] for i in range(0, len(w), 48)]
        loud = [sum(65 <= c < 91 for x in seg for c in x.encode()) / sum(len(x.encode()) for x in seg) for seg in segments if len(seg) >= 12]
        assert f["worst_upper"] == pytest.approx(max(loud, default=0)) and f["worst_distinct"] == pytest.approx(max((1 - len(set(x)) / len(x) for x in segments if len(x) >= 12), default=0))


def test_statistics_do_not_depend_on_the_batch(rows):
    texts = [(t or "").encode() for _, t in rows]
    whole = quality_classifier.statistics(texts)
    assert whole.shape == (len(texts), len(quality_classifier.FEATURES))
    assert np.allclose(whole, np.concatenate([quality_classifier.statistics([t]) for t in texts]))


def _labelled(spark, bad, n=240):
    rng = random.Random(5)
    vocab = ["word%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        y = i % 3 == 0
        w = rng.choices(vocab, k=rng.randrange(30, 300))
        rows.append((i, bad(w, rng) if y else " ".join(w)))
        labels.append((i, int(not y), int(y)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + [(9999, 1, 0), (None, 0, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality(spark, docs, empty, clashing):
    d, labels = _labelled(spark, lambda w, r: " ".join(x.upper() + "!!" for x in w))
    held = quality_classifier.held_out(F.col("doc_id"), 3, 1)
    trees = quality_classifier.fit(d, labels, "quality", ~held)
    got = {r.doc_id: r.score for r in quality_classifier.score(d, trees).where(held).collect()}
    assert len(got) > 50 and all((s < 0.5) == (i % 3 == 0) for i, s in got.items())
    assert quality_classifier.score(docs, trees).count() == docs.count()
    kept = quality_classifier.keep_good(clashing, trees)
    assert kept.columns == clashing.columns and 0 < kept.count() <= clashing.count()
    assert quality_classifier.score(empty, trees).count() == 0
    none = quality_classifier.fit(empty, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_toxicity_generalises_to_misspellings(spark, docs, empty):
    stems = ["idiotic", "worthless", "pathetic"]

    def bad(w, r):
        for _ in range(3):
            s = r.choice(stems)
            k = r.randrange(1, len(s) - 1)
            w[r.randrange(len(w))] = s[:k] + r.choice("abcxyz0") + s[k:]
        return " ".join(w)

    d, labels = _labelled(spark, bad, 360)
    held = quality_classifier.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(d, labels, "toxic", ~held)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).where(held).collect()}
    right = [(s >= 0.5) == (i % 3 == 0) for i, s in got.items()]
    assert len(right) > 40 and sum(right) >= 0.93 * len(right)
    long = " ".join("word%d" % (i % 300) for i in range(20000))
    s = model.score([b"", long.encode(), (long[:50000] + " idi0tic pathetiic worthles " + long).encode()])
    assert s[0] < 0.5 and s[1] < 0.5 < s[2]
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_scores_are_the_plain_ones():
    """Vectorised scoring against loops over words, n-grams and segments."""
    import re

    from tessera.llm import texts as T

    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.25, 1.5, -0.5)
    texts = ["", " ,;", "One one two-three", "é" * 9 + " bad!bad", " ".join("w%d" % (i % 13) for i in range(70))]

    def number(data):
        return int.from_bytes(data, "little")

    def word(w):
        own = T.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        marked = b"<" + w + b">"
        grams = [T.mix(np.array([number(marked[i : i + k]) + (k << 56)], np.uint64)) for k in toxicity.SIZES for i in range(len(marked) - k + 1)]
        return np.mean([model.table[int(h[0]) % toxicity.BUCKETS] for h in [own, *grams]])

    for t, got in zip(texts, model.score([t.encode() for t in texts])):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", brute.lower(t).encode())
        words = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
        size, step = toxicity.SEGMENT, toxicity.SEGMENT // 2
        z = [np.mean([word(w) for w in words[i : i + size]]) for i in range(0, max(len(words) - step, 1), step) if words]
        assert got == pytest.approx(1 / (1 + np.exp(-(1.5 * (max(z, default=0.0) + 0.25) - 0.5))), abs=1e-6)
    assert model.rate(toxicity.Bag(*_joined(texts)), toxicity.Known(4)).tolist() == pytest.approx(model.score([t.encode() for t in texts]).tolist())


def _joined(texts):
    from tessera.llm import shingles

    return shingles.joined([t.encode() for t in texts])


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    emb, soft, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    g, owner = np.array([0, 1, 1, 4, 5, 0]), np.array([0, 0, 0, 1, 1, 2])
    weight, label = rng.random(6), np.array([1, 0, 1])

    def losses():
        out = []
        for i in range(3):
            v = sum(weight[k] * emb[g[k]] for k in range(6) if owner[k] == i) @ soft + bias
            out.append(np.log(np.exp(v).sum()) - v[label[i]])
        return np.array(out)

    def slope(a, at, total):
        old, out = a[at], []
        for e in (1e-6, -1e-6):
            a[at] = old + e
            out.append(total(losses()))
        a[at] = old
        return (out[0] - out[1]) / 2e-6

    grad, tilt, rows, each = toxicity.gradients(emb, soft, bias, g, weight, owner, label)
    assert [[slope(soft, (i, j), np.mean) for j in range(2)] for i in range(3)] == [pytest.approx(r, abs=1e-6) for r in grad.tolist()]
    assert [slope(bias, j, np.mean) for j in range(2)] == pytest.approx(tilt.tolist(), abs=1e-6)
    assert rows.tolist() == [0, 1, 4, 5]
    assert [[slope(emb, (int(r), j), np.sum) for j in range(3)] for r in rows] == [pytest.approx(r, abs=1e-6) for r in each.tolist()]


def test_toxicity_learns_from_long_texts(spark):
    """Toxic texts of any length teach; ids are picked by label alone, and the bound on bytes ends a class."""
    rng = random.Random(6)
    vocab = ["word%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(160):
        bad = i % 2
        w = rng.choices(vocab, k=3000 if bad else rng.randrange(30, 3000))
        for _ in range(40 * bad):
            w[rng.randrange(len(w))] = rng.choice(["idiotic", "worthless", "pathetic"])
        rows.append((i, " ".join(w)))
        labels.append((i, bad))
    d, own = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    learn = F.col("doc_id") < 120
    texts, y = toxicity.lessons(d, own, "toxic", learn, 8000, 24 << 20)
    assert sorted(zip(map(len, texts), y)) == sorted((len(t), i % 2) for i, t in rows if i < 120)
    few, z = toxicity.lessons(d, own, "toxic", learn, 8000, 300_000)
    assert 0 < z.sum() < 60 and sum(len(t) for t, k in zip(few, z) if k) <= 150_000 and max(map(len, few)) > 20_000
    model = toxicity.fit(d, own, "toxic", learn)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).where("doc_id >= 120").collect()}
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in got.items())


def test_rules(docs, rows, clashing, empty):
    want = brute.nulls_first([(i, *brute.rule_counts(t)) for i, t in rows])
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert collected(quality_rules.judge(docs, "source").select(*cols)) == want
    assert collected(quality_rules.judge(clashing, "source").select(*cols)) == want
    assert collected(quality_rules.judge(empty)) == []


def test_host_verdicts(spark):
    base = spark.createDataFrame([("bad", True)] * 50 + [("bad", False)] * 2 + [("good", False)] * 60 + [("tiny", True)] + [("ok", k < 6) for k in range(60)] + [(None, True)], "host string, base_failed boolean")
    got = {r.host: r for r in quality_rules.host_verdicts(base).collect()}
    rates = [50 / 52, 0.0, 1.0, 0.1]
    m, v = np.mean(rates), np.var(rates)
    ab = m * (1 - m) / v - 1 if m * (1 - m) / v > 1 else 1.0
    assert got["bad"].rate == pytest.approx((50 + m * ab) / (52 + ab))
    assert [got[h].host_failed for h in ("bad", "good", "ok")] == [True, False, False]
    assert None not in got


URLS = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
    ("https://example.com/de/9", "example.com", "/de/9", "example.com/de/", "block"),
    ("https://notexample.com/de/9", "notexample.com", "/de/9", None, "allow"),
    ("https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("https://x.net", "x.net", "", None, "allow"),
    ("https://x.net?a=/b", "x.net", "", None, "allow"),
    ("ftp://h:80/p#/q", "h:80", "/p", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls(spark):
    p = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id bigint, url string, html string")
    got = collected(url_filter.judge(p).select("page_id", "host", "path", "rule", "verdict"))
    assert got == [(i, *u[1:]) for i, u in enumerate(URLS)]
    assert collected(url_filter.judge(p.limit(0))) == []


def test_propagation(spark):
    rng = random.Random(2)
    hosts = ["h%d.example" % i for i in range(12)] + ["a.net", "b.net", "good.org"]
    rows, edges = [], {}
    for i, h in enumerate(hosts):
        to = rng.sample(hosts, 4)
        path = "/fr/" if h.endswith("org") else "/p"
        rows.append((i, f"http://{h}{path}", "".join(f'<a href="https://{t.upper()}/x">' for t in to) + '<a href=//b.net/z> <a href="/own">'))
        for t in [*to, "b.net"]:
            if t != h:
                edges[h, t] = edges.get((h, t), 0) + 1
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r.src, r.dst): r.n for r in url_filter.host_edges(p).collect()} == edges
    seeds = [("a.net", "distrust"), ("b.net", "distrust"), ("good.org", "trust")]
    s = url_filter.propagate(url_filter.host_edges(p), spark.createDataFrame(seeds, "host string, kind string"), iterations=4)
    got = {(r.kind, r.host): r.score for r in s.collect()}
    want = {(k, h): x for k in ("trust", "distrust") for h, x in brute.pagerank(edges, seeds, k, 0.85, 4).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    verdict = {r.host: r.verdict for r in url_filter.judge(p, iterations=4).collect()}
    t, d = (brute.pagerank(edges, seeds, k, 0.85, 4) for k in ("trust", "distrust"))
    assert all(verdict[h] == ("block" if d.get(h, 0) > t.get(h, 0) else "allow") for h in hosts if h.endswith("example"))


def test_uncrawled_targets_seed(spark):
    """Hosts without pages seed walks by the urls that are linked; pages that rules judge go before links."""
    to = lambda *urls: "".join(f'<a href="{u}">' for u in urls)
    rows = [
        (0, "http://spam.example/p", to("http://x.net/a", "//y.net/b?c", "http://z.net/c")),
        (1, "http://fine.example/p", to("http://other.example/", "http://x.org/en/")),
        (2, "http://part.example/p", to("http://example.com/de/1", "http://example.com/en/1")),  # half of the targets: no seed
        (3, "http://kept.org/fr/1", to("http://near.example/")),
        (4, "http://near.example/p", to("http://kept.org/fr/1", "http://kept.org/en/1", "http://kept.org/en/2")),
        (5, "http://thin.net", None),  # its one page has no rule
        (6, "http://by.example/p", to("http://thin.net/a", "http://thin.net/b")),
        (7, None, to("http://lone.net/a")),
        (8, "http://own.net", to("http://own.net/a", "http://own.net/b")),  # links within a host say nothing
    ]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(p).collect()}
    assert [i for i, r in sorted(got.items()) if r.verdict == "block"] == [0, 5, 6]
    assert got[0].distrust > 0 and got[1].distrust == got[2].distrust == got[8].distrust == 0
    assert got[3].trust > 0 and got[4].trust > 0


def test_walks_settle(spark):
    """A host far from the seed is reached, and scores in a cycle are those of the settled walk."""
    ring = {("c%d" % i, "c%d" % ((i + 1) % 3)): 1 for i in range(3)}
    edges = {**{("h%02d" % i, "h%02d" % (i + 1)): 1 for i in range(14)}, ("h14", "bad.net"): 1, **ring, ("c0", "bad.net"): 2}
    e = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n bigint")
    seeds = [("bad.net", "distrust")]
    got = {r.host: r.score for r in url_filter.propagate(e, spark.createDataFrame(seeds, "host string, kind string")).collect()}
    want = brute.pagerank(edges, seeds, "distrust", 0.85, 400)
    assert got.keys() == want.keys() >= {"h00", "c1"} and all(got[h] == pytest.approx(want[h], rel=1e-4) for h in want)
    p = spark.createDataFrame([(i, f"http://h{i:02d}.example/p", f'<a href="http://{to}/p">') for i, to in enumerate([*("h%02d.example" % i for i in range(1, 15)), "bad.net"])], "page_id bigint, url string, html string")
    assert {r.verdict for r in url_filter.judge(p).collect()} == {"block"}


def test_contained(spark, docs, rows, clashing, empty):
    rng = random.Random(4)
    whole = [t for _, t in rows if t and len(t.split()) > 30]
    items = []
    for i in range(40):
        w = rng.choice(whole).split()
        k = rng.randrange(0, len(w) - 12)
        part = w[k : k + rng.choice([2, 5, 8, 12, 30, 60])]
        if i % 3 == 0:
            part[rng.randrange(len(part))] = "changed"
        items.append((i, " ".join(part).upper()))
    items += [(100, None), (101, ""), (102, "same"), (103, "same"), (103, "same")]
    t = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.nulls_first(brute.contained(rows, items))
    cols = ["doc_id", "item_id", "n_found", "n_item"]
    assert want and collected(decontamination.find(docs, t).select(*cols)) == want
    assert collected(decontamination.find(clashing, t, broadcast_bytes=0).select(*cols)) == want
    assert collected(decontamination.find(empty, t)) == [] and collected(decontamination.find(docs, t.limit(0))) == []
    kept = decontamination.drop_contaminated(docs, t)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IS NOT NULL").select("doc_id").distinct().count() == len({i for i, _ in rows if i is not None} - {w[0] for w in want})


def test_packing(docs, rows, clashing, empty):
    sizes = (16, 32, 64)
    for d, portion in ((docs, 20000), (clashing, 10)):
        out = packing.best_fit(d, sizes=sizes, portion=portion).toPandas()
        # every token lies in one place of one bin that holds it, and a bin is no larger than it needs to be
        total = {}
        for i, t in rows:
            total[i] = total.get(i, 0) + len(brute.WORD.findall(t or ""))
        assert out["length"].sum() == sum(total.values())
        for b, g in out.groupby("bin_id"):
            g = g.sort_values("bin_offset")
            assert (g["bin_offset"] == g["length"].cumsum() - g["length"]).all()
            used, size = g["length"].sum(), g["bin_size"].iloc[0]
            assert used <= size and not [s for s in sizes if used <= s < size]
        for i, g in out[out["doc_id"].notna()].groupby("doc_id"):
            if i != 206:  # two rows
                g = g.sort_values("start")
                assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == total[i]
    assert collected(packing.best_fit(empty)) == []


def test_pack_is_best_fit():
    """Against a model that looks at every open bin."""
    rng = random.Random(1)
    cost = packing.Cost(8, 64)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 33) for _ in range(60)), reverse=True)
        bins, where, left = [], [], sum(lengths)
        for n in lengths:
            fit = [(r, k) for k, r in enumerate(b[0] - b[1] for b in bins) if r >= n]
            if fit:
                k = min(fit)[1]
            else:
                k = len(bins)
                bins.append([min((s for s in (8, 16, 32) if s >= n), key=lambda s: (cost(s) / min(s, left), s)), 0])
            bins[k][1] += n
            left -= n
            where.append(k)
        got, _, final = packing.pack(lengths, [8, 16, 32], cost)
        assert got == where and final == [min(s for s in (8, 16, 32) if s >= u) for _, u in bins]
