"""Quality classifier with hierarchical empirical Bayes over sites (operator 10).

1. Evidence. A logistic regression on a few measures of the text (rates of symbols, capitals and exclamation marks,
   distinct words, word length, size) gives each document a probability of being good. It is fitted on a
   bounded sample of labelled documents (``SAMPLE`` of either label, by hash of the id).
2. Sites. Grouped sums of these probabilities by path and by host are shrunk: a host's rate towards the global
   rate, a path's rate towards its host's, each with a prior of so many documents as the variance within groups is larger
   than the variance between them. Both are moments over all groups of that level, those of one document
   included. A site with few documents stays near its parent.
3. A document's posterior odds are its own odds times the odds of its path over the global odds.

Measures are written to one narrow table in a single pass over the texts; groups are partial aggregates, and the
document side meets them in a plain equi-join (Spark broadcasts the groups only where it finds them small).
Sums are of whole micro-units, so the result does not depend on their order.

Defined results: a null text is empty; null hosts and paths are sites of their own; labels without value or document are
not used, of several the smallest counts; of several sampled rows with one id each measure's least value is learned from; with one label only, or none, every evidence is one half; repeated
rows count as documents. ``sites_of_url`` gives host and path columns for tables with URLs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.quality_rules import SYMBOLS, let, words_of
from gridloom.llm.shared import cut

SAMPLE = 10_000
MEASURES = ("symbols", "capitals", "shouts", "distinct", "word_length", "size")
#: Prior strengths stay within these bounds (documents).
WEAKEST, STRONGEST = 1.0, 1e6
UNIT = 1_000_000


def sites_of_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, host with the first part of the path)."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1))
    return host, F.concat(host, F.lit("/"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)", 1))


def measures(docs: DataFrame, host: Column, path: Column, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    rate = lambda chars: F.coalesce(F.try_divide((n - F.length(F.translate(t, chars, ""))).cast("double"), n), F.lit(0.0))
    distinct = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), rate(SYMBOLS).alias("symbols"), rate("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"), rate("!").alias("shouts"), distinct.alias("w"), n.alias("chars"))
    w = F.col("w.n")
    return d.select(
        "doc_id", "host", "path", "symbols", "capitals", "shouts", F.coalesce(F.try_divide(F.col("w.d").cast("double"), w), F.lit(0.0)).alias("distinct"), F.coalesce(F.try_divide(F.col("chars").cast("double"), w), F.lit(0.0)).alias("word_length"), F.ln(w + 1.0).alias("size")
    )


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on standardised measures, as (weights, intercept) for the measures themselves."""
    if not len(y) or y.min() == y.max():
        return np.zeros(len(MEASURES)), 0.0
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (y - p) - 0.5 * b
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    w = b[:-1] / spread
    return w, float(b[-1] - (w * mean).sum())


def _strength(groups: DataFrame, parent: Column, mean: float) -> float:
    """Prior strength of a level, in documents: variance within over variance between its groups.

    ``groups`` has n, s and q: documents, and sums of their rates and squared rates in units. The squared distance of a
    group's rate from its parent's is expected to be the variance between groups plus the one within over n.
    """
    n, r = F.col("n"), F.col("s") / F.col("n") / UNIT
    row = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.round(UNIT * n * (r - parent) ** 2).cast("long")).alias("apart"), F.sum(F.round(F.col("q") - F.col("s") * r).cast("long")).alias("inside")
    ).first()
    if not row.n:
        return STRONGEST
    within = row.inside / UNIT / (row.n - row.groups) if row.n > row.groups else mean * (1 - mean)
    between = (row.apart / UNIT - within * row.groups) / row.n
    return min(STRONGEST, max(WEAKEST, within / between)) if between > 0 else STRONGEST


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text") -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, posterior and kept of every document."""
    table = cut(measures(docs, host, path, text), "measures")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    pick = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    known = F.broadcast(pick(1).unionByName(pick(0)))  # 2 * SAMPLE labels, and one row a document, however often it comes
    rows = sorted(tuple(r)[1:] for r in table.join(known, "doc_id").groupBy("doc_id").agg(*[F.min(c) for c in (*MEASURES, "y")]).collect())
    data = np.array(rows, dtype=float).reshape(-1, len(MEASURES) + 1)
    weights, intercept = fit(data[:, :-1], data[:, -1])

    logit = F.lit(float(intercept))
    for name, w in zip(MEASURES, weights.tolist()):
        logit = logit + F.col(name) * float(w)
    logit = F.least(F.greatest(F.round(logit, 6), F.lit(-20.0)), F.lit(20.0))
    scored = table.select("doc_id", "host", "path", logit.alias("logit")).withColumn("p", F.round(UNIT / (1 + F.exp(-F.col("logit")))).cast("long"))

    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.round(F.col("p") * F.col("p") / UNIT).cast("long")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, whole.s / whole.n / UNIT)) if whole.n else 0.5
    k_host = _strength(hosts, F.lit(mean), mean)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") / UNIT + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(paths, F.col("host_rate"), mean)
    rates = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_rate", ((F.col("s") / UNIT + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"))
    out = scored.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    rate = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("logit") + F.ln(rate / (1 - rate)) - float(np.log(mean / (1 - mean)))
    out = out.select("doc_id", "host", "path", F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), F.round(1 / (1 + F.exp(-odds)), 6).alias("posterior"))
    return out.withColumn("kept", F.col("posterior") >= 0.5)
