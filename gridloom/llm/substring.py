"""Substring dedup (operator 5): words covered by a 50-word window that also starts in an earlier document go.

First pass, a count-min sketch. Every window has a minimiser, the least hash of the ``SHINGLE``-word
shingles in it; equal windows have equal minimisers, so the number of documents with a minimiser never
underestimates the number with the window, and only about a tenth of the positions reach the sketch. Each
partition counts its documents' minimisers into ``DEPTH`` rows of counters that stop at two and
sends the touched cells by ranges; the ranges are merged by the executors into one bit a cell ("two or
more"), and that is what is broadcast. There are as many cells as the corpus has ``CHARS`` characters, rounded up to a power of
two, up to ``2**MOST_BITS`` (128 MB a row). A corpus that fills the sketch lets more windows pass, it never loses one.
Beyond ``LOAD`` characters a cell the minimisers that pass are grouped as well, a row for each of a document, and only
those that two documents really share go on, in a join with the texts of the documents that have any.

Second pass: only windows whose minimiser the sketch calls repeated leave the texts, as 96-bit hashes of
their word sequence with document and places; a sequence that one document repeats is one row, so a key has at most
a row a document. They are written once. A partial aggregation finds the smallest document of each; the
join with it is a plain shuffle join whose skewed keys Spark can split.

Defined results: null and blank texts have no words and nothing to remove; with fewer than 50 words nothing is
removed; rows with one doc_id are one document; a null doc_id neither removes nor loses anything. Windows are
judged on the input. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, mix, rolling, text_slices, word_hashes

WINDOW = 50
SHINGLE = 32
DEPTH = 2
CHARS = 8
LEAST_BITS, MOST_BITS = 20, 30
LOAD = 32
#: Numbers (ids and ends of removed stretches) that are broadcast to the texts at most, 8 bytes each; more go through a shuffle join.
SMALL = 4_000_000
#: Cells that a task holds before it sends them.
HELD = 1 << 21
_SALTS = [np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)]
_SECOND = np.uint64(0xA0761D6478BD642F)
_SECOND_BASE = 0xE7037ED1A0B428DB
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(h: np.ndarray, first: np.ndarray, window: int, shingle: int):
    """(starts of windows inside one document, their documents' numbers, their minimisers)."""
    if len(h) < window:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),)
    least = _sliding_min(mix(rolling(h, shingle)), window - shingle + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= first[doc + 1])
    return starts, doc[starts], least[starts]


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(values ^ _SALTS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketch_rows(bits: int, shards: int, window: int, shingle: int):
    """mapInArrow: touched cells of this partition, by row of the sketch and range of cells."""

    def send(held: list[np.ndarray]):
        values = np.concatenate(held)
        for row in range(DEPTH):
            touched, counts = np.unique(cells(values, row, bits), return_counts=True)
            at = np.searchsorted(touched, np.arange(shards + 1, dtype=np.uint64) << np.uint64(bits - (shards - 1).bit_length()))
            some = [k for k in range(shards) if at[k] < at[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row] * len(some), pa.int32()),
                    pa.array(some, pa.int32()),
                    pa.array([touched[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()),
                    pa.array([np.packbits(counts[at[k] : at[k + 1]] > 1).tobytes() for k in some], pa.binary()),
                ],
                names=["row", "shard", "cells", "more"],
            )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                h, first = word_hashes(data, offsets)
                _, doc, least = minimisers(h, first, window, shingle)
                new = _runs(least, doc)
                pairs = np.unique(np.stack([doc[new].astype(np.uint64), least[new]]), axis=1) if new.any() else np.empty((2, 0), dtype=np.uint64)
                held.append(pairs[1])
                n += pairs.shape[1]
                if n >= HELD:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return run


def _merge_range(bits: int, shards: int):
    """The sketch of one range: a bit for each cell that two or more documents touched."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = (1 << bits) // shards
        base = int(group["shard"].iloc[0]) * size
        counts = np.zeros(size, dtype=np.uint8)
        for touched, more in zip(group["cells"], group["more"]):
            at = np.frombuffer(touched, dtype=np.uint32).astype(np.int64) - base
            twice = np.unpackbits(np.frombuffer(more, dtype=np.uint8), count=len(at))
            counts[at] = np.minimum(counts[at] + 1 + twice, 2)
        return pd.DataFrame({"row": group["row"].iloc[:1].to_numpy(), "shard": group["shard"].iloc[:1].to_numpy(), "bits": [np.packbits(counts >= 2).tobytes()]})

    return run


def corpus_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.length(text))).first()[0] or 0


def sketch_bits(chars: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (chars // CHARS).bit_length()))


def sketch(docs: DataFrame, text: str, bits: int, window: int = WINDOW, shingle: int = SHINGLE) -> list[bytes]:
    """The merged sketch: for each row one bit a cell. At most DEPTH * 2**bits / 8 bytes reach the driver."""
    wanted = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(1 << (wanted - 1).bit_length(), 1 << (bits - 10))
    touched = docs.select(text).mapInArrow(_sketch_rows(bits, shards, window, shingle), "row int, shard int, cells binary, more binary")
    merged = touched.groupBy("row", "shard").applyInPandas(_merge_range(bits, shards), "row int, shard int, bits binary")
    out = [bytearray((1 << bits) // 8) for _ in range(DEPTH)]
    size = (1 << bits) // shards // 8
    for r in merged.toLocalIterator():
        out[r.row][r.shard * size : (r.shard + 1) * size] = r.bits
    return [bytes(x) for x in out]


def _passing(value: np.ndarray, rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Which minimisers the sketch calls repeated."""
    hit = np.ones(len(value), dtype=bool)
    for row, bitmap in enumerate(rows):
        c = cells(value, row, bits)
        hit &= (bitmap[c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & np.uint8(1) == 1
    return hit


def _runs(least: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a new minimiser or document begins."""
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    return new


def _minimiser_rows(sent, bits: int, window: int, shingle: int):
    """mapInArrow: the distinct minimisers of each text that the sketch lets pass."""

    def run(batches):
        rows = [np.frombuffer(x, dtype=np.uint8) for x in sent.value]
        for batch in batches:
            ids, known = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_valid())
            for at, data, offsets in text_slices(batch.column(1)):
                h, first = word_hashes(data, offsets)
                _, doc, least = minimisers(h, first, window, shingle)
                new = _runs(least, doc)
                value, of = least[new], doc[new]
                keep = _passing(value, rows, bits) & known[at + of]
                if keep.any():
                    pairs = np.unique(np.stack([of[keep].astype(np.uint64), value[keep]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(ids[at + pairs[0].astype(np.int64)].astype(np.int64))], names=["v", "doc_id"])

    return run


def shared_minimisers(docs: DataFrame, sent, text: str, bits: int, window: int, shingle: int) -> DataFrame:
    """(doc_id, shared): the minimisers of each document that another document has too."""
    rows = cut(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(_minimiser_rows(sent, bits, window, shingle), "v long, doc_id long"), "minimisers")
    twice = rows.groupBy("v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("v")
    return rows.join(twice, "v", "left_semi").groupBy("doc_id").agg(F.collect_set("v").alias("shared"))


def _candidates(sent, bits: int, window: int, shingle: int):
    """mapInArrow over (doc_id, text), windows by the sketch, or over (doc_id, text, shared), windows by the listed minimisers."""

    def run(batches):
        rows = None if sent is None else [np.frombuffer(x, dtype=np.uint8) for x in sent.value]
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            known = np.asarray(batch.column(0).is_valid())
            for at, data, offsets in text_slices(batch.column(1)):
                h, first = word_hashes(data, offsets)
                starts, doc, least = minimisers(h, first, window, shingle)
                new = _runs(least, doc)
                value, of, run_of = least[new], doc[new], np.cumsum(new) - 1
                if rows is not None:
                    hit = _passing(value, rows, bits)
                else:
                    ends = np.searchsorted(of, np.arange(len(offsets)))
                    parts = [np.isin(value[a:b], np.array(batch.column(2)[at + k].as_py(), dtype=np.int64).view(np.uint64)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
                    hit = np.concatenate(parts) if parts else np.empty(0, dtype=bool)
                take = np.flatnonzero(hit[run_of] & known[at + doc]) if len(value) else run_of
                if not len(take):
                    continue
                where = starts[take]
                h1 = rolling(h, window)[where]
                h2 = (rolling(mix(h ^ _SECOND), window, _SECOND_BASE)[where] >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((where, h2, h1, doc[take]))  # one row for each sequence of a document
                h1, h2, of, place = h1[order], h2[order], doc[take][order], (where - first[doc[take]])[order]
                new = np.ones(len(of), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at_row = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[at_row].view(np.int64)),
                        pa.array(h2[at_row].view(np.int32)),
                        pa.array(ids[at + of[at_row]].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.append(at_row, len(of)).astype(np.int32)), pa.array(place.astype(np.int32))),
                    ],
                    names=["h1", "h2", "doc_id", "places"],
                )

    return run


def repeated_windows(docs: DataFrame, text: str = "text", bits: int | None = None, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, places): where windows start that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    chars = corpus_chars(docs, text)
    bits = bits or sketch_bits(chars)
    sent = spark.sparkContext.broadcast(sketch(docs, text, bits, window, shingle))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    if chars > LOAD << bits:
        given, sent = given.join(shared_minimisers(docs, sent, text, bits, window, shingle), "doc_id").select("doc_id", "text", "shared"), None
    found = cut(given.mapInArrow(_candidates(sent, bits, window, shingle), "h1 long, h2 int, doc_id long, places array<int>"), "windows")
    least = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").drop("last")
    later = found.join(least, ["h1", "h2"]).filter("doc_id > least")
    return later.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))


def _stretches(window: int):
    """mapInArrow: the stretches of words that the windows of a document cover, as starts and stops."""

    def run(batches):
        for batch in batches:
            starts, stops = [], []
            for x in batch.column(1).to_pylist():
                p = np.unique(np.asarray(x, dtype=np.int64))
                apart = np.flatnonzero(np.diff(p) > window)
                starts.append(p[np.append(0, apart + 1)].tolist())
                stops.append((p[np.append(apart, len(p) - 1)] + window).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32()))], names=["doc_id", "starts", "stops"])

    return run


def covered(n: int, starts, stops) -> np.ndarray:
    """Which of n words lie in a stretch."""
    steps = np.zeros(n + 1, dtype=np.int64)
    steps[np.minimum(starts, n)] += 1
    steps[np.minimum(stops, n)] -= 1  # stretches are apart, so only the end of the text can repeat
    return np.cumsum(steps)[:n] > 0


def _with_stretches(docs: DataFrame, text: str, bits: int | None, window: int, shingle: int) -> DataFrame:
    """(row, starts, stops): every row of ``docs`` as one struct, so that no column of it can clash."""
    found = repeated_windows(docs, text, bits, window, shingle).mapInArrow(_stretches(window), "doc_id long, starts array<int>, stops array<int>")
    found = cut(found, "stretches")
    size = found.agg(F.sum(F.size("starts") + 1)).first()[0] or 0
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(F.broadcast(found) if size <= SMALL else found, F.col("row.doc_id") == F.col("doc_id"), "left").drop("doc_id")


def digests(docs: DataFrame, text: str = "text", bits: int | None = None, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words joined by one blank."""

    def run(batches):
        for batch in batches:
            counts, removed, digest = [], [], []
            for t, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:])):
                words = (t or "").encode().split()
                counts.append(len(words))
                if starts:
                    gone = covered(len(words), starts, stops)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append(0)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    d = _with_stretches(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")), "text", bits, window, shingle)
    return d.select("row.doc_id", "row.text", "starts", "stops").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: str, starts, stops) -> str:
    """The text without the covered words and the white space behind them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = covered(len(spans), starts, stops).tolist()
    out, at = [], 0
    for k, g in enumerate(gone):
        if g:
            out.append(text[at : spans[k][0]])
            at = spans[k + 1][0] if k + 1 < len(spans) else len(text)
    out.append(text[at:])
    return "".join(out)


def remove(docs: DataFrame, text: str = "text", bits: int | None = None, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs``, with the repeated words cut out of the text."""

    @F.pandas_udf("string")
    def shortened(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([t if a is None or t is None else cut_words(t, a, b) for t, a, b in zip(texts, starts, stops)], dtype=object)

    d = _with_stretches(docs, text, bits, window, shingle)
    left = F.col("row").getField(text)
    return d.select(F.col("row").withField(f"`{text}`", F.when(F.col("starts").isNull(), left).otherwise(shortened(left, F.col("starts"), F.col("stops")))).alias("row")).select("row.*")
