import random
import re

import pytest

from gridloom.llm import neardup as N

SF = "/root/testdata/sf0.001"


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return set()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}


def brute(rows, width=4):
    sets = {i: shingles(t, width) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4:
                inter = len(a & b)
                if 100 * inter >= 80 * (len(a) + len(b) - inter):
                    p, q = sorted((root(i), root(j)))
                    comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def mutated(r, words, rate):
    return [w if r.random() > rate else w + r.choice("xyz") for w in words]


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    common = [r.choice(vocabulary) for _ in range(40)]
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 3, 5, 20, 60, 120, 400]))]
        chain = base
        for _ in range(r.randrange(1, 9)):
            chain = mutated(r, chain, r.choice([0, 0.01, 0.03, 0.06]))
            rows.append((i, " ".join(chain + (common if r.random() < 0.5 else []))))
            i += 7
    rows += [(10_001, None), (10_002, " \n"), (10_003, "One TWO"), (10_004, "one two"), (10_005, "one two three")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS comp", "3 AS v")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(df, width=4).collect()}
    assert got == brute(rows)


def test_many_copies_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(N, "ROUND_PAIRS", 5000)
    monkeypatch.setattr(N, "SMALL_IDS", 3)
    r = random.Random(9)
    base = [f"w{r.randrange(900)}" for _ in range(200)]
    rows = [(k, " ".join(base)) for k in range(60)] + [(k, " ".join(mutated(r, base, 0.03))) for k in range(60, 120)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute(rows)


def test_hot_sets_meet_their_class_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 5)
    t, u = " ".join(f"w{k}" for k in range(30)), "another short text of some words here"
    rows = [(3 + k, t) for k in range(9)] + [(100 + k, u) for k in range(3)] + [(50, t + " end"), (1, "alone in the world it is"), (None, t)]
    got = [(x.doc_id, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted([(3 + k, 3) for k in range(9)] + [(100 + k, 100) for k in range(3)] + [(50, 3), (1, 1)]) and (None, None) in got


def test_the_exact_option_needs_no_sketch(spark):
    """With sketches far too small for the promise, the full join alone finds every link."""
    r = random.Random(3)
    base = [[f"w{r.randrange(300)}" for _ in range(120)] for _ in range(12)]
    rows = [(k, " ".join(mutated(r, base[k % 12], r.choice([0.01, 0.03, 0.045])))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(df, width=4, kept=4, shared=4, exact=True).collect()}
    assert got == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(docs, width=4).collect()}
    assert got == brute([(x.doc_id, x.text) for x in docs.collect()])


def test_nulls_repeats_and_nothing(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component_id, x.kept) for x in N.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0
