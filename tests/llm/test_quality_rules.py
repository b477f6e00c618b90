import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(x in Q.SYMBOLS for x in t), len(lines) - len(set(lines)), len(hit))


HARD = [None, "", " \n\t", "one", "a b c a b c", "a b c a b", "x\nx\n x\nx\n\n\n", "é🙂 # * $ é🙂 # * $ z", "w " * 3000, "\x0ba\x0cb\rc\x1cd", "p q r s p q r t q r s"]


def test_base_columns(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS score")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.base_columns(df).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(HARD)}


def test_all_of_a_small_table_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    grams = {}
    for r in rows:
        s = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams[r.doc_id] = [(x,) for x in s] + list(zip(s, s[1:]))
    kinds = sorted({g for gs in grams.values() for g in gs})
    pairs = spark.createDataFrame([(i, g[0], g[1] if len(g) > 1 else None) for i, g in enumerate(kinds)], "i long, a string, b string")
    n = Q.n_buckets(Q.corpus_chars(docs))
    assert n == 1 << max(14, math.ceil(math.log2(16 * math.sqrt(sum(len(r.text or "") for r in rows)) + 1)))
    hashed = pairs.select("i", F.when(F.col("b").isNull(), Q._bucket(n, F.col("a"))).otherwise(Q._bucket(n, F.col("a"), F.col("b"))).alias("h")).collect()
    bucket = {kinds[r.i]: r.h for r in hashed}
    raw = collections.Counter(bucket[g] for gs in grams.values() for g in gs)
    target = collections.Counter(bucket[g] for d, gs in grams.items() if d in good for g in gs)
    share = sum(target.values()) / sum(raw.values())
    weight = {b: max(-128, round(Q.UNIT * math.log((target[b] + Q.PRIOR) / (raw[b] * share + Q.PRIOR)))) for b in raw}
    for r in rows:
        g, x = got[r.doc_id], brute_base(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == x
        s = sum(weight[bucket[k]] for k in grams[r.doc_id]) / max(1, len(grams[r.doc_id])) / Q.UNIT
        assert g.score == pytest.approx(s, abs=1e-8)
        assert g.base_failed == (x[0] < 50 or 100 * x[4] > 50 * x[0])
        assert g.kept == (not g.base_failed and g.score >= Q.THRESHOLD)


def test_junk_goes_and_clean_text_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    j = Q.judge(docs, labels).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r.quality: r.k for r in j}
    assert rate[1] > 0.99 and rate[0] < 0.1, rate


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judge(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b " * 60), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.base_failed) for r in Q.judge(one, labels).collect()) == [(False, True), (True, True)]


def test_all_trusted_documents_count(spark, monkeypatch):
    n = 25_000
    docs = spark.range(n + 1).selectExpr("id AS doc_id", f"CASE WHEN id < {n} THEN 'abc' ELSE 'xyz' END AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    buckets, table = Q.weights(docs, labels)
    got = list(map(int, table.split(",")))
    b, other = (docs.select(Q._bucket(buckets, F.lit(w))).first()[0] for w in ("abc", "xyz"))
    share, w = n / (n + 1), lambda t, r: max(-128, round(Q.UNIT * math.log((t + Q.PRIOR) / (r * n / (n + 1) + Q.PRIOR))))
    assert len(got) == buckets and got[b] == w(n, n) and got[other] == w(0, 1) < 0 < share
    assert sum(x != 0 for x in got) <= 2
    monkeypatch.setattr(Q, "SMALL_IDS", 10)
    assert Q.weights(docs, labels) == (buckets, table)


def test_the_bucket_space_grows_with_the_corpus(spark):
    chars = [Q.corpus_chars(spark.range(n).selectExpr("repeat('x', 1000) AS text")) for n in (0, 1, 1000, 100_000)]
    assert chars == [0, 1000, 1_000_000, 100_000_000] and [Q.n_buckets(c) for c in chars] == [1 << 14, 1 << 14, 1 << 14, 1 << 18]
    assert Q.n_buckets(10**10) == 1 << 21 and Q.n_buckets(10**15) == 1 << Q.MOST_BITS


def test_words_count_whole(spark):
    """Junk before a word's ending is junk: only whole words that the trusted documents use score well."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.filter("quality = 1"), "doc_id").filter("length(text) > 1000").select("doc_id", "text").limit(20)
    bent = good.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.regexp_replace("text", r"([^\s]{1,3})(?=\s|$)", "###$1").alias("text"))
    both = Q.judge(docs.select("doc_id", "text").unionByName(bent), labels).collect()
    score = {r.doc_id: r.score for r in both}
    pairs = [(score[r.doc_id], score[r.doc_id - 1_000_000]) for r in both if r.doc_id >= 1_000_000]
    assert pairs and all(b < g - 0.05 for b, g in pairs), pairs


def test_clean_text_stays_where_few_documents_are_trusted(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    few = labels.filter("quality = 1 AND doc_id % 10 = 0")  # a tenth of the labels
    rest = labels.filter("doc_id % 10 <> 0")
    j = Q.judge(docs, few).filter("not base_failed").join(rest, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r.quality: r.k for r in j}
    assert rate[1] > 0.98 and rate[0] < 0.15, rate
