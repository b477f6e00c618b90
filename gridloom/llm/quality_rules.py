"""Quality rules (operator 3), with DataFrame functions only.

Base rules need a text's own words; the verdict on the rest is a hashed n-gram log-likelihood ratio. The
unigrams and bigrams of whole words fall into hash buckets, whose number grows with the corpus as a vocabulary does: with
the square root of its characters. One pass counts the buckets of all documents (the raw corpus) and of the
trusted ones (all with label of quality 1). Every bucket gets ``PRIOR`` trusted pseudo-counts, and as many raw ones
as that is at the trusted share of the corpus, so that a bucket of which a few trusted ones would be expected at most says
little, however few documents are trusted; the log ratio of the two multinomials is the weight of a bucket. A
document's score is the mean weight of its n-grams, in nats; it is kept from ``THRESHOLD`` on. Weights are whole numbers
of 1 / ``UNIT`` nats from -128 to 127, so scores do not depend on the order of summation, and the JVM keeps one
object for each such number, which leaves the table small enough for the processor's caches.

Scoring looks weights up in one array (at most 2 ** ``MOST_BITS`` integers, whatever the corpus), so it needs no shuffle.
Counting runs in at most ``TASKS`` tasks a core (more where a task would have over ``TASK_CHARS`` characters): each
sends a sum for every bucket, so that what is shuffled follows the buckets, not the texts.

Defined results: a null or blank text has no words, fails the base rules and scores 0; repeated rows get the
same verdict each; with no trusted document at all every weight is 0. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import WORD_BREAKS, cut, drop_cut

#: Buckets for each square root of a character of the corpus, rounded up to a power of two; the least and the most bits.
DENSITY = 16
LEAST_BITS, MOST_BITS = 14, 22
#: Trusted pseudo-counts of each bucket.
PRIOR = 3.5
THRESHOLD = -0.12
UNIT = 16
TASKS, TASK_CHARS = 4, 1 << 31
#: Ids of trusted documents that are broadcast at most (some 60 MB); more go through a shuffle join.
SMALL_IDS = 2_000_000
#: Weights that are put into one string at a time on their way to the driver.
SLICE = 4096
#: Symbols that the base rules count (fixed value).
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def n_repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""

    def of(w: Column) -> Column:
        grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def count(g: Column) -> Column:
            def covered(s: Column) -> Column:
                twice = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
                return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

            placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(placed, covered))

        return let(grams, count)

    return let(words, of).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_columns(docs: DataFrame, text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, words, and the base counts of every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(
        "doc_id",
        *carry,
        words_of(t).alias("words"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"),
    )
    return d.select("*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), n_repeat_words(F.col("words")).alias("n_repeat_words"))


def corpus_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.length(text))).first()[0] or 0


def n_buckets(chars: int) -> int:
    """Buckets for a corpus of so many characters."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(DENSITY * math.sqrt(chars) + 1))))


def _bucket(buckets: int, *parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _pairs(words: Column) -> Column:
    """(x, y) of every word x and the word y after it, null at the end."""
    return F.arrays_zip(words.alias("x"), F.slice(words, 2, F.size(words)).alias("y"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    return good.select("doc_id")


def counts(docs: DataFrame, labels: DataFrame, buckets: int, tasks: int, text: str = "text") -> DataFrame:
    """(b, raw, target): the n-grams of all and of trusted documents in each bucket that has any."""
    known = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id"))
    if known.limit(SMALL_IDS + 1).count() <= SMALL_IDS:
        known = F.broadcast(known)
    d = docs.select("doc_id", F.col(text).alias("text")).join(known, F.col("doc_id") == F.col("trusted_id"), "left")
    d = d.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    d = d.coalesce(tasks)
    d = d.select("t", F.explode(_pairs(F.col("words"))).alias("g")).select("t", "g.x", "g.y")
    one, two = _bucket(buckets, F.col("x")), F.when(F.col("y").isNotNull(), _bucket(buckets, F.col("x"), F.col("y")))
    d = d.select("t", F.explode(F.array(one, two)).alias("b")).filter("b IS NOT NULL")
    return d.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))


def weights(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[int, str]:
    """Number of buckets, and log(target / raw) of each in 1 / UNIT nats, joined by commas."""
    chars = corpus_chars(docs, text)
    buckets = n_buckets(chars)
    tasks = max(TASKS * docs.sparkSession.sparkContext.defaultParallelism, chars // TASK_CHARS)
    found = cut(counts(docs, labels, buckets, tasks, text), "counts")
    raw, target = found.agg(F.sum("raw"), F.sum("target")).first()
    if target:
        share = target / raw
        ratio = F.ln((F.col("target") + PRIOR) / (F.col("raw") * share + PRIOR))
    else:
        ratio = F.lit(0.0)
    every = docs.sparkSession.range(buckets).join(found.select(F.col("b").cast("long").alias("id"), F.greatest(F.least(F.round(UNIT * ratio), F.lit(127)), F.lit(-128)).cast("int").alias("w")), "id", "left")
    slices = every.groupBy(F.expr(f"id div {SLICE}").alias("k")).agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))).alias("w"))
    rows = slices.select("k", F.array_join(F.transform("w", lambda x: x["w"].cast("string")), ",").alias("w")).collect()  # 2 ** MOST_BITS / SLICE at most
    drop_cut(found)
    return buckets, ",".join(r.w for r in sorted(rows))


def score(words: Column, weight: tuple[int, str]) -> Column:
    """Mean weight of the n-grams of a document, in 1 / UNIT nats (null without words)."""
    buckets, table = weight[0], F.split(F.lit(weight[1]), ",").cast("array<int>")  # folded to one literal

    def of(t: Column, w: Column) -> Column:
        def add(total: Column, g: Column) -> Column:
            pair = F.get(t, _bucket(buckets, g["x"], g["y"]))
            return total + F.get(t, _bucket(buckets, g["x"])) + F.when(g["y"].isNull(), F.lit(0)).otherwise(pair)

        return F.try_divide(F.aggregate(_pairs(w), F.lit(0).cast("long"), add).cast("double"), 2 * F.size(w) - 1)

    return let(table, lambda t: let(words, lambda w: of(t, w)))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, base counts, base_failed, score and kept of every document, and the columns ``carry``."""
    weight = weights(docs, labels, text)
    d = base_columns(docs, text, carry)
    d = d.select("*", F.round(F.coalesce(score(F.col("words"), weight), F.lit(0.0)) / UNIT, 9).alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.drop("words").withColumn("base_failed", failed)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    d = d.select(*names, *[c for c in d.columns if c not in names])
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, without a shuffle."""
    judged = judge(docs, labels, text, (F.struct("*").alias("__row"),))
    return judged.filter("kept").select("__row.*")
