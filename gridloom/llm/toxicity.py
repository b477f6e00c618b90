"""Toxic spans and document scores by a linear-chain conditional random field (operator 7).

Tokens are white-space words, A-Z lower-cased, without trailing stops; a token's features are its prefixes of ``PREFIXES``
bytes, the whole word, its first six bytes with its length, and the words before and after it. Only documents are
labelled, so token labels are hidden, and the field is fitted by expectation-maximisation under the documents' constraints: a
clean document's tokens are all clean, a toxic one has at least one toxic token. Each step sets
the expected features and transitions under the constraint against those without it, both exact by forward and
backward vectors. These come from products of 2 x 2 matrices, scanned by doubling over all tokens of a
slice at once; a document's first token resets the chain. Features of fewer than ``LEAST_DOCS`` toxic documents stay at 0.

A document's evidence is -log of the probability that no token is toxic, a product of the tokens' conditional
marginals; a logistic curve fitted on the sample turns it into the score. Runs of tokens with a marginal of one half or more are
the offending spans (code points).

The sample has ``SAMPLE`` documents of either label (by hash of the id) of at most ``SAMPLE_WORDS`` words: with
``len(FEATURES)`` 4-byte features a word, that bounds what the driver gets. Rows whose crc32(doc_id as text) modulo 4 is 2 are never learned from. Language, source, id and labels are no inputs.
Defined results: a null or empty text has no evidence and scores 0; labels without a document or value are not used, of
several the largest counts; of several rows with one id one is learned from; with no toxic or no clean training document all scores are 0;
repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import _BASE, _INV, _TABLE, mix, powers, text_slices

SAMPLE = 1_500
#: Documents of more words than this are not sampled (they are scored like all others).
SAMPLE_WORDS = 1_000
BITS = 20
#: Prefix lengths in bytes (None: the whole word).
PREFIXES = (4, 5, 6, 8, None)
FEATURES = (*PREFIXES, "length", "before", "after")
#: Toxic documents that a feature occurs in at least, to have a weight.
LEAST_DOCS = 3
STEPS = 40
RATE, DECAY = 0.3, 0.01
BIAS = -7.0
THRESHOLD = 0.3
HELD_OUT = 2
_KIND = mix(np.arange(1, len(FEATURES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".,!?;:\"')#*$%&|")] = True


def token_features(data: np.ndarray, offsets: np.ndarray):
    """(feature numbers of each token, first token of each text and the end, byte spans of the tokens)."""
    n = len(data)
    if not n:
        return np.empty((0, len(FEATURES)), dtype=np.int32), np.zeros(len(offsets), dtype=np.int64), np.empty((2, 0), dtype=np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = gap[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:n]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    stop = ends.copy()
    for _ in range(4):
        stop -= _STOPS[low[stop - 1]] & (stop - starts > 1)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[low] * powers(_BASE, n)[:n], out=pre[1:])
    back = powers(_INV, n)[starts]
    columns = []
    for kind, width in enumerate(PREFIXES):
        upto = stop if width is None else np.minimum(starts + width, stop)
        h = mix((pre[upto] - pre[starts]) * back ^ _KIND[kind])
        columns.append(h)
    first = np.searchsorted(starts, offsets)
    word, six, size = columns[-1], columns[PREFIXES.index(6)], (stop - starts).astype(np.uint64)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    inside = first[:-1][first[:-1] < first[1:]]
    before[inside] = 0
    after[first[1:][first[:-1] < first[1:]] - 1] = 0
    for kind, h in enumerate((six + size, before, after), len(PREFIXES)):
        columns.append(mix(h ^ _KIND[kind]))
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in columns], axis=1), first, np.stack([starts, ends])


class Chain:
    """weight of each feature, bias, log transitions (from, to); label 0 is clean with potential 1."""

    def __init__(self, weight: np.ndarray, bias: float, move: np.ndarray, curve: tuple[float, float] = (1.0, 0.0)):
        self.weight, self.bias, self.move, self.curve = weight, bias, move, curve

    @staticmethod
    def _scan(m: np.ndarray, longest: int) -> np.ndarray:
        """Inclusive products m[0] m[1] ... m[t] of 4-row matrices (00, 01, 10, 11), up to scale, by doubling."""
        m, d = m.copy(), 1
        while d < longest:
            a, b = m[:, :-d], m[:, d:]
            c = np.empty_like(b)
            c[0] = a[0] * b[0] + a[1] * b[2]
            c[1] = a[0] * b[1] + a[1] * b[3]
            c[2] = a[2] * b[0] + a[3] * b[2]
            c[3] = a[2] * b[1] + a[3] * b[3]
            c /= c.max(axis=0)
            m[:, d:] = c
            d *= 2
            # all rows proportional: earlier tokens no longer matter
            if d >= 16 and np.abs(c[0] * c[3] - c[1] * c[2]).max() < 1e-14:
                break
        return m

    def marginals(self, feats: np.ndarray, first: np.ndarray, pairs: bool = False):
        """(probability of label 1 of each token, log of the probability of label 0 given a 0 before it), and if wanted the
        expected counts of the four transitions into each token."""
        n = len(feats)
        if not n:
            return np.empty(0), np.empty(0)
        psi = np.exp(np.clip(self.weight[feats].sum(axis=1) + self.bias, -30, 30))
        t = np.exp(self.move)
        heads = np.zeros(n, dtype=bool)
        heads[first[:-1][first[:-1] < first[1:]]] = True
        longest = int(np.diff(first).max())
        m = np.empty((4, n))
        m[0], m[1], m[2], m[3] = t[0, 0], t[0, 1] * psi, t[1, 0], t[1, 1] * psi
        m[0, heads] = m[2, heads] = 1.0
        m[1, heads] = m[3, heads] = psi[heads]
        forward = self._scan(m, longest)
        f0, f1 = forward[0] / (forward[0] + forward[1]), forward[1] / (forward[0] + forward[1])
        # beta[t] = M[t+1] ... M[end] 1: the same scan from the right, over transposed matrices
        r = np.empty((4, n))
        tails = np.zeros(n, dtype=bool)
        tails[:-1], tails[-1] = heads[1:], True
        nxt = np.append(psi[1:], 1.0)
        r[0], r[1], r[2], r[3] = t[0, 0], t[1, 0], t[0, 1] * nxt, t[1, 1] * nxt  # transposed: row = to
        r[:, tails] = 1.0
        backward = self._scan(r[:, ::-1], longest)[:, ::-1]
        b0, b1 = backward[0], backward[1]
        p1 = f1 * b1 / (f0 * b0 + f1 * b1)
        odds = np.where(heads, 1.0, t[0, 1] / t[0, 0]) * psi * b1 / b0
        clean = -np.log1p(odds)
        if not pairs:
            return p1, clean
        joint = np.zeros((4, n))
        here = np.flatnonzero(~heads)
        prev = here - 1
        joint[:, here] = f0[prev] * t[0, 0] * b0[here], f0[prev] * t[0, 1] * psi[here] * b1[here], f1[prev] * t[1, 0] * b0[here], f1[prev] * t[1, 1] * psi[here] * b1[here]
        joint[:, here] /= joint[:, here].sum(axis=0)
        return p1, clean, joint

    @staticmethod
    def evidence(clean: np.ndarray, first: np.ndarray) -> np.ndarray:
        """-log of the probability that no token of a document is toxic."""
        total = np.append(0.0, np.cumsum(-clean))
        return total[first[1:]] - total[first[:-1]]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return np.where(evidence > 0, 1 / (1 + np.exp(-np.clip(a * np.log(np.maximum(evidence, 1e-12)) + b, -30, 30))), 0.0)

    @classmethod
    def learn(cls, docs: list[np.ndarray], toxic: np.ndarray) -> Chain | None:
        """docs: feature rows of each sampled document."""
        used = [k for k, d in enumerate(docs) if len(d)]
        docs, toxic = [docs[k] for k in used], np.asarray(toxic)[used].astype(float)
        if not len(docs) or toxic.min() == toxic.max():
            return None
        size = 1 << BITS
        seen = np.zeros(size, dtype=np.int32)
        for d, y in zip(docs, toxic):
            if y:
                seen[np.unique(d)] += 1
        may = seen >= LEAST_DOCS
        feats, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        first, doc = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(len(docs)), sizes)
        names, at = np.unique(feats[may[feats]], return_inverse=True)
        column = np.full(size, len(names))
        column[names] = np.arange(len(names))
        place = column[feats]  # numbers of the features that have a weight, the last for all others
        share = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())  # both labels count alike
        chain = cls(np.zeros(size), BIAS, np.zeros((2, 2)))
        own, mean, square, step = np.zeros(len(names) + 6), np.zeros(len(names) + 6), np.zeros(len(names) + 6), 0
        own[-5] = BIAS
        for step in range(1, STEPS + 1):
            p, clean, joint = chain.marginals(feats, first, pairs=True)
            none = np.exp(-np.minimum(cls.evidence(clean, first), 700.0))  # that no token is toxic
            # expected under the constraint less expected without it, by document: a share of p and of the moves
            more = np.where(toxic > 0, none / np.maximum(1 - none, 1e-9), -1.0) * share
            g = more[doc] * p
            gm = (joint * more[doc]).sum(axis=1)
            gm[0] -= (more * np.maximum(sizes - 1, 0)).sum()
            grad = np.concatenate([np.bincount(place.ravel(), weights=np.repeat(g, len(FEATURES)), minlength=len(names) + 1)[: len(names)], [0.0, g.sum()], gm])
            grad = grad * len(docs) - DECAY * np.append(own[: len(names)], [0.0, 0.0, *own[-4:]])
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
            own = own + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-3)
            chain.weight[names], chain.bias, chain.move = own[: len(names)], float(own[-5]), own[-4:].reshape(2, 2)
        chain.curve = chain._fit_curve(feats, first, toxic)
        return chain

    def _fit_curve(self, feats: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
        """Logistic regression of the label on the log evidence."""
        e = self.evidence(self.marginals(feats, first)[1], first)
        use = e > 0
        x, y = np.log(np.maximum(e[use], 1e-12)), toxic[use].astype(float)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            ga, gb = ((y - p) * x).sum() - 0.1 * a, (y - p).sum() - 0.1 * b
            haa, hab, hbb = (w * x * x).sum() + 0.1, (w * x).sum(), w.sum() + 0.1
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
            a, b = a + scale * da, b + scale * db
        return max(a, 0.05), b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Chain | None:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = F.broadcast(pick(1).unionByName(pick(0)))  # 2 * SAMPLE rows at most

    def run(batches):
        for batch in batches:
            rows = []
            for at, data, offsets in text_slices(batch.column(1)):
                feats, first, _ = token_features(data, offsets)
                for k in range(len(offsets) - 1):
                    if first[k + 1] - first[k] <= SAMPLE_WORDS:
                        rows.append((at + k, feats[first[k] : first[k + 1]].tobytes()))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "toxic", "feats"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # one row a document, however often it comes
    got = d.mapInArrow(run, "doc_id long, toxic int, feats binary").groupBy("doc_id", "toxic").agg(F.min("feats").alias("feats")).toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return None
    return Chain.learn([np.frombuffer(x, dtype=np.int32).reshape(-1, len(FEATURES)) for x in got.column("feats").to_pylist()], np.array(got.column("toxic").to_pylist()))


SPANS = "array<struct<start:long, end:long>>"


def score(docs: DataFrame, labels: DataFrame, text: str = "text", chain: Chain | None = None) -> DataFrame:
    """doc_id, score, spans (offending code points) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(chain or learn(docs, labels, text))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        model = sent.value
        for batch in batches:
            scores, spans = [], []
            for _, data, offsets in text_slices(batch.column(1)):
                if model is None:
                    scores += [0.0] * (len(offsets) - 1)
                    spans += [[]] * (len(offsets) - 1)
                    continue
                feats, first, where = token_features(data, offsets)
                p, clean = model.marginals(feats, first)
                scores += model.score(model.evidence(clean, first)).tolist()
                found: list[list] = [[] for _ in range(len(offsets) - 1)]
                hits = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(first, hits, side="right") - 1
                for t, d in zip(hits.tolist(), doc.tolist()):
                    a, b = (len(bytes(data[offsets[d] : x]).decode()) for x in where[:, t])
                    if found[d] and found[d][-1][2] == t - 1:
                        found[d][-1][1:] = [b, t]
                    else:
                        found[d].append([a, b, t])
                spans += [[{"start": a, "end": b} for a, b, _ in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, f"doc_id long, score double, spans {SPANS}")
