import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import site_quality as S

D = "/root/testdata/sf0.01"


def test_held_back_quality(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    out = S.classify(docs, labels.filter("doc_id % 2 = 0"), F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    good = [r.kept for r in out if truth.get(r.doc_id) == 1]
    bad = [r.kept for r in out if truth.get(r.doc_id) == 0]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.35 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_shrinkage_by_hand(spark):
    out = S.classify(*small(spark), F.col("host"), F.col("path")).collect()
    by = {}
    for r in out:
        by.setdefault((r.host, r.path), []).append(r)
    p = {k: [round(1e6 / (1 + np.exp(-np.log(r.evidence / (1 - r.evidence))))) for r in v] for k, v in by.items() if True}
    n = sum(map(len, p.values()))
    mean = sum(map(sum, p.values())) / n / 1e6
    for v in by.values():
        for r in v:
            lo, hi = sorted((mean, np.mean([x / 1e6 for k, y in p.items() if k[0] == r.host for x in y])))
            assert lo - 1e-3 <= r.host_rate <= hi + 1e-3
            own = np.mean([x / 1e6 for x in p[r.host, r.path]])
            assert min(own, r.host_rate) - 1e-3 <= r.path_rate <= max(own, r.host_rate) + 1e-3
            odds = r.evidence / (1 - r.evidence) * r.path_rate / (1 - r.path_rate) / (mean / (1 - mean))
            assert abs(r.posterior - odds / (1 + odds)) < 5e-3


def small(spark):
    rows = [(k, "plain words here " * 5 if k % 3 else "JUNK!! " * 12, f"h{k % 4}" if k % 11 else None, f"p{k % 7}" if k % 13 else None) for k in range(300)]
    rows += [(900, None, "h0", "p0"), (901, "", "lonely", "x"), (None, "plain words", "h1", "p1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0 or k % 10 == 0)) for k in range(150)] + [(None, 1), (3, None)], "doc_id long, quality int")
    return docs, labels


def test_no_labels_and_no_rows(spark):
    docs, labels = small(spark)
    none = S.classify(docs, labels.limit(0), F.col("host"), F.col("path")).collect()
    assert len(none) == 303 and {r.evidence for r in none} == {0.5} and all(abs(r.posterior - 0.5) < 1e-5 for r in none)
    assert S.classify(docs.limit(0), labels, F.col("host"), F.col("path")).count() == 0


def test_sites_of_url(spark):
    df = spark.createDataFrame([("http://A.example.com/fr/8?x=1",), ("https://b.org",), (None,)], "url string")
    host, path = S.sites_of_url(F.col("url"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("a.example.com", "a.example.com/fr"), ("b.org", "b.org/"), (None, None)]


def brute(rows, labels):
    """(evidence, host rate, path rate, posterior) of each row by plain loops, from the measures and the fitted weights."""
    known = {}
    for d, y in labels:
        if d is not None and y is not None:
            known[d] = min(y, known.get(d, 1))
    one = {}
    for r in rows:
        if r.doc_id in known:
            m = tuple(r[k] for k in S.MEASURES)
            one[r.doc_id] = tuple(map(min, m, one.get(r.doc_id, m)))
    order = sorted((*m, known[d]) for d, m in one.items())
    data = np.array(order, dtype=float)
    w, b = S.fit(data[:, :-1], data[:, -1])
    logit = [min(20.0, max(-20.0, round(b + sum(r[k] * x for k, x in zip(S.MEASURES, w.tolist())), 6))) for r in rows]
    p = [1 / (1 + np.exp(-z)) for z in logit]
    sites = [(r.host, r.path) for r in rows]
    mean = np.mean(p)

    def level(keys, parent):
        groups = {}
        for k, x in zip(keys, p):
            groups.setdefault(k, []).append(x)
        inside = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values())
        n = len(p)
        within = inside / (n - len(groups))
        between = (sum(len(g) * (np.mean(g) - parent(k)) ** 2 for k, g in groups.items()) - within * len(groups)) / n
        strength = min(S.STRONGEST, max(S.WEAKEST, within / between)) if between > 0 else S.STRONGEST
        return {k: (sum(g) + strength * parent(k)) / (len(g) + strength) for k, g in groups.items()}

    host = level([h for h, _ in sites], lambda k: mean)
    path = level(sites, lambda k: host[k[0]])
    odds = [np.exp(z) * path[k] / (1 - path[k]) / (mean / (1 - mean)) for z, k in zip(logit, sites)]
    return [(x, host[k[0]], path[k], o / (1 + o)) for x, k, o in zip(p, sites, odds)]


def sparse(spark, n=1500, seed=4):
    """Many sites of one to three documents and a few large ones; good hosts hold mostly good texts."""
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for k in range(n):
        h = int(r.integers(0, 10)) if k % 3 == 0 else 100 + int(r.integers(0, n // 2))
        good = r.random() < (0.9 if h % 2 else 0.2)
        junk = 3 if r.random() < 0.3 else int(6 * (not good))
        rows.append((k, "plain words here and there " * 5 + "JUNK!! " * junk, f"h{h}" if h != 4 else None, f"p{int(r.integers(0, 3))}"))
        labels.append((k, int(good)))
    rows += [(7, "plain WORDS", "h101", "p0"), (None, "no id", "h1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").selectExpr("*", "1 AS n", "2 AS p", "3 AS y", "4 AS s")
    return docs, labels


def test_all_rows_against_brute_force(spark):
    docs, labels = sparse(spark)
    known = [x for x in labels if x[0] % 2 == 0] + [(3, None), (None, 1), (6, 0)]
    out = S.classify(docs, spark.createDataFrame(known, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    measured = S.measures(docs, F.col("host"), F.col("path")).collect()
    want = brute(measured, known)
    key = lambda d, h, q, e: (d is None, d or 0, h or "", q or "", round(e, 5))
    left = sorted((key(r.doc_id, r.host, r.path, w[0]), w) for r, w in zip(measured, want))
    right = sorted((key(r.doc_id, r.host, r.path, r.evidence), (r.evidence, r.host_rate, r.path_rate, r.posterior)) for r in out)
    assert len(left) == len(right) == 1502
    for (a, w), (b, g) in zip(left, right):
        assert a[:4] == b[:4] and np.allclose(w, g, atol=5e-5), (a, w, g)


def test_sites_help_where_texts_do_not_say(spark):
    """On held-back documents of sparse sites too, the posterior orders better than the evidence alone."""
    docs, labels = sparse(spark, 4000)
    out = S.classify(docs, spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    truth = {d: y for d, y in labels if d % 2}

    def auc(column, some):
        good, bad = ([r[column] for r in some if truth[r.doc_id] == v] for v in (1, 0))
        return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])

    held = [r for r in out if r.doc_id in truth]
    large = [r for r in held if r.host is None or len(r.host) == 2]
    assert auc("posterior", large) > auc("evidence", large) + 0.03
    assert auc("posterior", held) > auc("evidence", held)
