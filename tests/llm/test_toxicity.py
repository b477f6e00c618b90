import itertools
import random
import zlib

import numpy as np

from gridloom.llm import toxicity as T

D = "/root/testdata/sf0.1"


def test_marginals_against_enumeration():
    r = np.random.default_rng(3)
    chain = T.Chain(r.normal(size=1 << T.BITS), 0.3, r.normal(size=(2, 2)))
    feats = r.integers(0, 1 << T.BITS, size=(17, 3)).astype(np.int32)
    first = np.array([0, 4, 4, 5, 12, 17])
    got, clean, joint = chain.marginals(feats, first, pairs=True)
    want, want_moves, none = [], np.zeros((2, 2)), []
    for a, b in zip(first, first[1:]):
        if a == b:
            none.append(1.0)
            continue
        e = chain.weight[feats[a:b]].sum(axis=1) + chain.bias
        total, one, pair, zero = 0.0, np.zeros(b - a), np.zeros((2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[k] for k in range(b - a) if y[k]) + sum(chain.move[i, j] for i, j in zip(y, y[1:])))
            total += w
            zero += w * (not any(y))
            one += w * np.array(y)
            for i, j in zip(y, y[1:]):
                pair[i, j] += w
        want += (one / total).tolist()
        want_moves += pair / total
        none.append(zero / total)
    assert np.allclose(got, want) and np.allclose(joint.sum(axis=1).reshape(2, 2), want_moves)
    assert np.allclose(np.exp(-chain.evidence(clean, first)), none)


def test_long_chain_is_a_plain_recursion():
    r = np.random.default_rng(4)
    chain = T.Chain(r.normal(size=1 << T.BITS) * 2, -2.0, np.array([[1.0, -1.0], [-0.5, 1.5]]))
    feats = r.integers(0, 1 << T.BITS, size=(3000, 3)).astype(np.int32)
    e = np.clip(chain.weight[feats].sum(axis=1) + chain.bias, -30, 30)
    t, n = np.exp(chain.move), len(feats)
    f, b = np.ones((n, 2)), np.ones((n, 2))
    for k in range(n):
        f[k] = (f[k - 1] @ t if k else np.ones(2)) * [1, np.exp(e[k])]
        f[k] /= f[k].sum()
    for k in range(n - 2, -1, -1):
        b[k] = t @ (b[k + 1] * [1, np.exp(e[k + 1])])
        b[k] /= b[k].sum()
    p = f * b
    assert np.allclose(chain.marginals(feats, np.array([0, n]))[0], p[:, 1] / p.sum(axis=1))


def test_fitting_gains_likelihood_under_the_constraints(monkeypatch):
    """Each label's documents grow likelier: clean ones to be clean throughout, toxic ones to hold a toxic token."""
    r = np.random.default_rng(5)
    toxic = np.arange(120) % 3 == 0
    docs = [r.integers(10, 1 << T.BITS, size=(int(r.integers(1, 30)), len(T.FEATURES))).astype(np.int32) for _ in toxic]
    for d, y in zip(docs, toxic):
        d[:, 0] = r.integers(0, 8, size=len(d))  # eight common features, and one that only toxic documents have
        if y:
            d[int(r.integers(len(d))), 1] = 9

    def likelihood(steps):
        monkeypatch.setattr(T, "STEPS", steps)
        c = T.Chain.learn(docs, toxic)
        e = np.array([c.evidence(c.marginals(d, np.array([0, len(d)]))[1], np.array([0, len(d)]))[0] for d in docs])
        return np.log(-np.expm1(-e[toxic])).mean() - e[~toxic].mean(), c

    runs = [likelihood(n) for n in (1, 10, 40)]
    assert runs[0][0] < runs[1][0] < runs[2][0]
    weight = runs[2][1].weight
    assert weight[9] > 3 and abs(weight[:8]).max() < 0.5 * weight[9]


def brute_score(chain, text):
    """(score, marginals) of a short text: its tokens' features made one by one, all labellings enumerated."""
    feats, first, _ = T.token_features(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]))
    e = chain.weight[feats].sum(axis=1) + chain.bias
    ways = [(y, np.exp(sum(e[k] for k in range(len(e)) if y[k]) + sum(chain.move[i, j] for i, j in zip(y, y[1:])))) for y in itertools.product((0, 1), repeat=len(e))]
    total = sum(w for _, w in ways)
    evidence = -np.log(ways[0][1] / total)
    a, b = chain.curve
    return 1 / (1 + np.exp(-(a * np.log(evidence) + b))), [sum(w for y, w in ways if y[k]) / total for k in range(len(e))]


def test_scores_and_spans_against_enumeration(spark):
    r = np.random.default_rng(8)
    chain = T.Chain(r.normal(size=1 << T.BITS), -1.0, r.normal(size=(2, 2)), (1.3, -0.4))
    texts = [" ".join(r.choice(["ab", "É!", "abcdefgh", "x.", "word", "VILE"], size=int(r.integers(1, 9)))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in T.score(docs, None, chain=chain).collect():
        want, p = brute_score(chain, texts[row.doc_id])
        assert abs(row.score - want) < 1e-9
        marked = [m >= 0.5 for m in p]
        hit = [any(s.start <= a < s.end for s in row.spans) for a in np.cumsum([0] + [len(w) + 1 for w in texts[row.doc_id].split(" ")])[:-1]]
        assert hit == marked


def test_a_words_features_do_not_leave_its_document():
    both, alone = "one two".encode(), "two three".encode()
    a = T.token_features(np.frombuffer(both + alone, dtype=np.uint8), np.array([0, len(both), len(both) + len(alone)]))
    b = T.token_features(np.frombuffer(alone, dtype=np.uint8), np.array([0, len(alone)]))
    assert a[1].tolist() == [0, 2, 4] and (a[0][2:] == b[0]).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    test = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    caught = [got[r.doc_id].score >= 0.3 for r in test if r.toxic]
    false = [got[r.doc_id].score >= 0.3 for r in test if not r.toxic]
    assert len(caught) > 100 and sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.03 * len(false), (sum(caught), len(caught), sum(false), len(false))
    said = {texts[i][s.start : s.end] for i, r in got.items() for s in r.spans}
    assert any("idiot" in x for x in said) and all(x == x.strip() and x for x in said)


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 5)
    monkeypatch.setattr(T, "SAMPLE_WORDS", 3)
    given = []
    monkeypatch.setattr(T.Chain, "learn", classmethod(lambda cls, docs, toxic: given.append((docs, toxic))))
    docs = spark.range(400).selectExpr("id div 4 AS doc_id", "IF(id div 4 % 2 = 0, 'a b', 'a b c d e') AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS toxic")
    T.learn(docs, labels)
    assert 0 < len(given[0][0]) <= 10 and all(len(d) == 2 for d in given[0][0])


def test_edges(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["ok", "fine", "plain", "words"]) for _ in range(20)) + (" vile" if k % 3 == 0 else "")) for k in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vile é VILE, ok")], "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS toxic")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] + [(None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert got[900].score == got[901].score == 0.0 and got[None].score > 0.3
    assert [(s.start, s.end) for s in got[None].spans][0] == (0, 4)
    assert all((got[k].score >= 0.3) == (k % 3 == 0) for k in range(200))
    assert T.score(docs, labels.limit(0)).filter("score > 0").count() == 0 and T.score(docs.limit(0), labels).count() == 0
