import hashlib
import random

from gridloom.llm import fingerprints as P
from gridloom.llm.fingerprints import Fingerprint


def test_order_insertion_deletion():
    r = random.Random(1)
    some = [f"unit {r.randrange(40)}" for _ in range(300)]
    f = Fingerprint.of(some)
    mixed = some[:]
    r.shuffle(mixed)
    assert Fingerprint.of(mixed) == f and f.likeness(Fingerprint.of(mixed)) == 1.0
    assert f - Fingerprint.of(some[:7]) == Fingerprint.of(some[7:])
    assert f + Fingerprint.of(["new"]) == Fingerprint.of(["new", *some])
    assert Fingerprint.of(some[:-1]) != f and Fingerprint.of([*some, some[0]]) != f
    assert Fingerprint.unpack(f.pack()) == f
    assert sum(int(x) for x in f.cells) > 0 and f.count == 300


def test_likeness_follows_what_is_shared():
    for n in (8, 40, 300, 3000):
        means = []
        for share in (0.75, 0.0):
            x = []
            for seed in range(30):
                a = [f"{seed} a {k}" for k in range(n)]
                b = a[: int(n * share)] + [f"{seed} b {k}" for k in range(n - int(n * share))]
                x.append(Fingerprint.of(a).likeness(Fingerprint.of(b)))
            means.append(sum(x) / len(x))
        assert 0.35 < means[0] < 0.85 and means[1] < 0.02


def test_likeness_of_long_texts():
    for n, seeds in ((300, 40), (3_000, 20), (20_000, 20), (300_000, 4)):
        x = []
        for seed in range(seeds):
            a = [f"{seed} a {k}" for k in range(n)]
            f, g = Fingerprint.of(a), Fingerprint.of(a[: n * 3 // 4] + [f"{seed} b {k}" for k in range(n // 4)])
            assert Fingerprint.unpack(f.pack()) == f
            x.append(f.likeness(g))
        # three quarters of either are in both: 0.6 of all
        assert abs(sum(x) / len(x) - 0.6) < 0.1 and min(x) > 0.3, (n, x)
    assert Fingerprint.unpack(Fingerprint().pack()) == Fingerprint()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        a, b, c = Fingerprint.of_text(t), Fingerprint.of_text(e), Fingerprint.of_text(n)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.pack().hex(), b.pack().hex(), a.likeness(b), a.likeness(c)))
    return sorted(out, key=str)


def test_with_next_against_brute_force(spark):
    r = random.Random(4)
    rows = [(k * 5, "".join(r.choice(["word ", "é🙂", ". ", "\n", "next. "]) for _ in range(r.randrange(0, 200)))) for k in range(150)]
    rows += [(None, "null id"), (7, None), (8, ""), (9, "same"), (9, "same"), (11, "x" * 5000)]
    r.shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS kind", "2 AS place")
        assert sorted([tuple(x) for x in P.with_next(df).collect()], key=str) == brute(rows)
    one = spark.createDataFrame([(3, "a\nb\nc" * 9)], "doc_id long, text string")
    assert [tuple(x) for x in P.with_next(one).collect()] == brute([(3, "a\nb\nc" * 9)])
    assert P.with_next(one.limit(0)).count() == 0


def test_equal_texts(spark):
    df = spark.createDataFrame([(1, "p\nq"), (2, "q\np"), (3, "p\nq\nq"), (4, None), (5, "")], "doc_id long, text string")
    f = {r.doc_id: bytes(r.fingerprint) for r in P.fingerprints(df).collect()}
    assert f[1] == f[2] != f[3] and f[4] == f[5]
