"""Personal data by patterns and a skip-chain conditional random field (operator 9).

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field then labels
the tokens that hold a digit or ``@`` (all others are fixed to "other"): unary potentials from shapes and
neighbours, chain potentials between tokens next to each other, and skip potentials between tokens of a
document that are equal or share their last seven digits, however far apart: each occurrence is linked to the first one.
Loopy belief propagation passes messages over this graph until they settle, so a number that is plain in one place carries its label to its repeats.
A run of tokens of one kind whose belief reaches ``BELIEF`` becomes a further span if it can be of that kind at all
(digits, dots, ``@``) and touches no base span; base spans always stay.

Weights, that of the skip potentials included, are learned by pseudo-likelihood from the base patterns' labels on a bounded
sample: the first ``SAMPLE_TOKENS`` tokens of the ``SAMPLE_DOCS`` documents of least id hash. Half of the tokens, by
hash, hide their shapes while learning, so that their labels must come from neighbours and repeats: the skip weight
says how often tokens that look alike are alike. Every document is labelled.

Defined results: a null or empty text has no spans; repeated rows get the same spans each; with nothing to learn from
only base spans are given. Offsets are code points, ends exclusive. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at one place are listed (fixed values).
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_DOCS = 4_000
SAMPLE_TOKENS = 60_000
BELIEF = 0.6
#: Weight of a skip potential where the sample says nothing, and the pull towards it.
LINK, PULL = 3.0, 1e-5
#: Weight of the label that a base span gives its tokens.
EVIDENCE = 20.0
FEATURES = 1 << 12
STEPS = 150
#: Messages have settled when none changes by more. Loops that never settle end after ``SWEEPS``, far beyond what others need.
SETTLED = 1e-3
SWEEPS = 1000

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_RUN = re.compile(r"[0-9]+|[^\W0-9_]+|(.)\1*", re.DOTALL)
_BREAKS = frozenset(" \t\n\x0b\x0c\r")
_TRIM = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit or ``@``."""
    out = []
    for m in _MARK.finditer(text):
        a = m.start()
        while a > 0 and text[a - 1] not in _BREAKS:
            a -= 1
        out.append((a, m.end()))
    return out


def shape(word: str) -> str:
    """Letters as a and other signs as they are, runs cut to four; a run of digits as 9 and its length."""
    out = []
    for m in _RUN.finditer(word):
        c, n = m[0][0], m.end() - m.start()
        out.append(f"9x{min(n, 20)}" if "0" <= c <= "9" else ("a" if c.isalpha() else c) * min(n, 4))
    return "".join(out)


#: Number of features of a token, and the one that a token with hidden shape has instead of each.
WIDTH, HIDDEN = 10, zlib.crc32(b"hidden") % FEATURES


def features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    out = []
    for k, (a, b) in enumerate(spans):
        word = text[a:b]
        digits = sum("0" <= c <= "9" for c in word)
        before = text[max(0, a - 12) : a].split()[-1:] if k == 0 or spans[k - 1][1] < a - 1 else [shape(text[spans[k - 1][0] : spans[k - 1][1]])]
        names = [
            "bias", "shape=" + shape(word), "trim=" + shape(word.strip(_TRIM)), f"digits={min(digits, 20)}", f"at={'@' in word}", f"dots={min(word.count('.'), 5)}",
            f"lead={word[0] if not word[0].isalnum() else 'x'}", f"only={digits == len(word.strip(_TRIM))}", "prev=" + (before[0][:8] if before else ""), f"alone={not any(c.isalpha() for c in word)}",
        ]
        out.append([zlib.crc32(n.encode()) % FEATURES for n in names])
    return out


def edges(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip) edges. Equal or similar tokens are linked to the first of them: a linear number, and two steps between any."""
    chain = [(k, k + 1) for k in range(len(spans) - 1) if spans[k + 1][0] - spans[k][1] <= 1]
    skip, first = [], {}
    for k, (a, b) in enumerate(spans):
        word = text[a:b].strip(_TRIM).lower()
        digits = "".join(c for c in word if "0" <= c <= "9")
        key = digits[-7:] if len(digits) >= 7 else word  # equal words have equal digits
        if len(key) >= 5 and first.setdefault(key, k) != k:
            skip.append((first[key], k))
    return chain, sorted(skip)


def token_labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """Label of each token: the kind of the first base span that it touches."""
    out, k = [0] * len(spans), 0
    for start, kind, end in base:
        while k and spans[k - 1][1] > start:
            k -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < end:
            out[j] = out[j] or kind + 1
            j += 1
    return out


class Field:
    """Weights: unary (FEATURES x labels), chain (labels x labels), skip (one for agreeing labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def learn(cls, feats: np.ndarray, labels: np.ndarray, prev: np.ndarray, nxt: np.ndarray, agree: np.ndarray) -> Field:
        """Pseudo-likelihood by gradient steps. prev, nxt: neighbours' labels or -1; agree: labels over skip edges."""
        n, m = len(labels), len(LABELS)
        unary, chain, skip = np.zeros((FEATURES, m)), np.zeros((m, m)), LINK
        wish = np.eye(m)[labels]
        has_prev, has_next = prev >= 0, nxt >= 0
        square = [np.full_like(unary, 1e-8), np.full_like(chain, 1e-8), 1e-8]
        for _ in range(STEPS):
            z = unary[feats].sum(axis=1) + skip * agree
            z[has_prev] += chain[prev[has_prev]]
            z[has_next] += chain[:, nxt[has_next]].T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            d = (p / p.sum(axis=1, keepdims=True) - wish) / n
            gu = np.stack([np.bincount(feats.ravel(), weights=np.repeat(d[:, k], feats.shape[1]), minlength=FEATURES) for k in range(m)], axis=1) + 1e-4 * unary
            gc = 1e-6 * chain
            np.add.at(gc, prev[has_prev], d[has_prev])
            np.add.at(gc.T, nxt[has_next], d[has_next])
            gs = float((d * agree).sum()) + PULL * (skip - LINK)
            for s, g in zip(square[:2], (gu, gc)):
                s += g * g
            square[2] += gs * gs
            unary -= 0.5 * gu / np.sqrt(square[0])
            chain -= 0.5 * gc / np.sqrt(square[1])
            skip -= 0.5 * gs / np.sqrt(square[2])
        return cls(unary, chain, skip)

    def beliefs(self, feats: list[list[int]], chain: list[tuple[int, int]], skip: list[tuple[int, int]], known: list[int] | None = None) -> np.ndarray:
        """Label beliefs of each token by loopy belief propagation; labels in ``known`` other than 0 are evidence."""
        phi = self.unary[np.array(feats)].sum(axis=1)
        for k, label in enumerate(known or []):
            if label:
                phi[k, label] += EVIDENCE
        if not chain and not skip:
            phi = np.exp(phi - phi.max(axis=1, keepdims=True))
            return phi / phi.sum(axis=1, keepdims=True)
        m = len(LABELS)
        # a pair with both potentials is one edge with their sum
        linked, beside = set(skip), set(chain)
        agree = self.skip * np.eye(m)
        far = [e for e in skip if e not in beside]
        pairs = np.array([*chain, *far])
        psi = np.exp(np.stack([self.chain + agree if e in linked else self.chain for e in chain] + [agree] * len(far)))
        src = np.concatenate([pairs[:, 0], pairs[:, 1]])
        dst = np.concatenate([pairs[:, 1], pairs[:, 0]])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(src), m))
        for _ in range(SWEEPS):
            total = phi.copy()
            np.add.at(total, dst, message)
            out = total[src] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, psi))
            new -= new.max(axis=1, keepdims=True)
            new = 0.5 * message + 0.5 * new
            still = np.abs(new - message).max()
            message = new
            if still < SETTLED:
                break
        np.add.at(phi, dst, message)
        phi = np.exp(phi - phi.max(axis=1, keepdims=True))
        return phi / phi.sum(axis=1, keepdims=True)


def _possible(kind: int, word: str) -> bool:
    digits = sum("0" <= c <= "9" for c in word)
    if kind == 0:
        return "@" in word[1:-1]
    if kind == 1:
        return word.count(".") == 3 and digits >= 4
    return 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def further_spans(text: str, base: list[tuple[int, int, int]], field: Field, belief: float = BELIEF) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base ones."""
    spans = tokens(text)
    if not spans:
        return []
    chain, skip = edges(text, spans)
    b = field.beliefs(features(text, spans), chain, skip, token_labels(spans, base))
    best, sure = b.argmax(axis=1).tolist(), (b.max(axis=1) >= belief).tolist()
    taken, at, out = sorted((s, e) for s, _, e in base), 0, []
    runs: list[list[int]] = []
    for k, (a, e) in enumerate(spans):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not best[k] or not sure[k] or (at < len(taken) and taken[at][0] < e):
            continue
        if runs and runs[-1][3] == k - 1 and runs[-1][0] == best[k] - 1 and a - runs[-1][2] <= 1:
            runs[-1][2:] = [e, k]
        else:
            runs.append([best[k] - 1, a, e, k])
    for kind, a, e, _ in runs:
        while a < e and text[a] in _TRIM:
            a += 1
        while a < e and text[e - 1] in _TRIM:
            e -= 1
        if a < e and _possible(kind, text[a:e]):
            out.append((a, kind, e))
    return out


def _samples(batches):
    """Training rows: features, label, labels of chain neighbours, counts of labels over skip edges."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = tokens(text or "")
            if not spans:
                continue
            y = token_labels(spans, base_spans(text))
            chain, skip = edges(text, spans)
            prev, nxt, agree = [-1] * len(spans), [-1] * len(spans), [[0] * len(LABELS) for _ in spans]
            for i, j in chain:
                prev[j], nxt[i] = y[i], y[j]
            for i, j in skip:
                agree[i][y[j]] += 1
                agree[j][y[i]] += 1
            hide = lambda k: zlib.crc32(f"{doc_id}:{k}".encode()) % 2
            rows += [(doc_id, k, [HIDDEN] * WIDTH if hide(k) else f, y[k], prev[k], nxt[k], agree[k]) for k, f in enumerate(features(text, spans))]
        if rows:
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "k", "feats", "label", "prev", "nxt", "agree"])


def learn(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Field | None:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    ids = d.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = d.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_samples, "doc_id long, k int, feats array<int>, label int, prev int, nxt int, agree array<int>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "k", "label").limit(sample_tokens).select("feats", "label", "prev", "nxt", "agree").toArrow()
    if not got.num_rows:
        return None
    grid = lambda c: np.array(got.column(c).combine_chunks().flatten()).reshape(got.num_rows, -1)
    one = lambda c: np.array(got.column(c).combine_chunks())
    return Field.learn(grid("feats"), one("label"), one("prev"), one("nxt"), grid("agree").astype(float))


SPANS = "array<struct<start:long, kind:string, end:long, base:boolean>>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())])


def all_spans(text: str | None, field: Field | None) -> list[dict]:
    if not text:
        return []
    base = base_spans(text)
    more = further_spans(text, base, field) if field is not None else []
    found = sorted([(a, k, e, True) for a, k, e in base] + [(a, k, e, False) for a, k, e in more])
    return [{"start": a, "kind": KINDS[k], "end": e, "base": b} for a, k, e, b in found]


def find(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id and the spans of every text, by start and kind. The field is learned from ``docs`` if not given."""
    sent = docs.sparkSession.sparkContext.broadcast(field or learn(docs, text))

    def run(batches):
        for batch in batches:
            found = [all_spans(t, sent.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        out += [text[at : max(at, s["start"])], f"[{s['kind'].upper()}]"]
        at = s["end"]
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All columns of ``docs``, every span in the text replaced by its kind in brackets."""
    sent = docs.sparkSession.sparkContext.broadcast(field or learn(docs, text))

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: masked(t, all_spans(t, sent.value)) if t else t)

    return docs.withColumn(text, cleaned(F.col(text))).select(docs.columns)
