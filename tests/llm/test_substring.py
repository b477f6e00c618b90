import hashlib
import random
import re

import pytest

from gridloom.llm import substring as S

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def random_rows(seed):
    r = random.Random(seed)
    shared = [[r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(n)] for n in (49, 50, 51, 75, 120)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(0, 4)):
            w += [r.choice(["x", "y", "zé", "q🙂"]) + str(r.randrange(50)) for _ in range(r.randrange(0, 30))]
            w += r.choice(shared)
        rows.append((i * 3 - 20, "".join(x + r.choice([" ", "\n", "\t ", "\x0b"]) for x in w)))
    return rows + [(500, None), (501, ""), (502, rows[5][1]), (503, rows[5][1])]


@pytest.mark.parametrize("seed,bits", [(1, 16), (2, 12)])
def test_against_brute_force(spark, seed, bits):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS places", "2 AS h1")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.digests(df, bits=bits).collect()}
    assert got == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.digests(docs, bits=20).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_removal_keeps_the_other_columns_and_the_order_of_text(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w), 7), (2, "first\n" + "  ".join(w) + "\nlast line", 8), (3, None, 9), (None, " ".join(w), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, places int")
    got = {r.doc_id: (r.text, r.places) for r in S.remove(df, bits=14).collect()}
    assert got == {1: (rows[0][1], 7), 2: ("first\nlast line", 8), 3: (None, 9), None: (rows[3][1], 1)}
    assert S.remove(df.limit(0), bits=14).count() == 0 and S.digests(df.limit(0), bits=14).count() == 0


def test_repeated_rows_are_one_document(spark):
    t = " ".join(f"w{k}" for k in range(55))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.digests(df, bits=14).collect()) == [(1, 0), (1, 0), (2, 55)]


def test_columns_of_any_name_survive(spark, monkeypatch):
    t = " ".join(f"w{k}" for k in range(55))
    names = ["__doc_id", "__places", "places", "row", "least", "h1", "__gone"]
    df = spark.createDataFrame([(1, t), (2, t + " more")], "doc_id long, text string").selectExpr("*", *[f"doc_id + {k} AS `{n}`" for k, n in enumerate(names)])
    for most in (S.SMALL, 0):
        monkeypatch.setattr(S, "SMALL", most)
        out = S.remove(df)
        assert out.columns == df.columns
        assert {r.doc_id: (r.text, *(r[n] for n in names)) for r in out.collect()} == {1: (t, *range(1, 8)), 2: ("more", *range(2, 9))}
        assert {r.doc_id: r.n_removed for r in S.digests(df).collect()} == {1: 0, 2: 55}


def test_a_sequence_that_a_document_repeats_is_one_row(spark):
    t = "same " * 5000
    df = spark.createDataFrame([(1, t), (2, t), (3, "other " + t)], "doc_id long, text string")
    rows = {r.doc_id: sorted(r.places) for r in S.repeated_windows(df).collect()}
    assert rows == {2: list(range(4951)), 3: list(range(1, 4952))}


def test_the_sketch_grows_with_the_corpus(spark):
    sizes = [S.sketch_bits(S.corpus_chars(spark.range(n).selectExpr("repeat('x', 100000) AS text"))) for n in (0, 1, 1000, 10_000)]
    assert sizes == [20, 20, 24, 27] and S.sketch_bits(10**15) == S.MOST_BITS


@pytest.mark.parametrize("bits", [11, 14, 20])
def test_minimisers_are_grouped_where_the_sketch_is_full(spark, monkeypatch, bits):
    """The same results whether windows are chosen by the sketch alone or by minimisers that documents really share."""
    rows = random_rows(3)
    df = spark.createDataFrame([*rows, (None, rows[7][1])], "doc_id long, text string")
    asked = []
    own = S.shared_minimisers
    monkeypatch.setattr(S, "shared_minimisers", lambda *a: asked.append(1) or own(*a))
    monkeypatch.setattr(S, "LOAD", 0)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.digests(df, bits=bits).collect()}
    want = brute(rows)
    assert asked and {k: got[k] for k in want} == want and got[None][1] == 0
