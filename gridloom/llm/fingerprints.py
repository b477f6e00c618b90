"""Document fingerprints: a homomorphic multiset hash (operator 4).

A text is the multiset of its units: paragraphs (lines), those longer than ``LONG`` characters cut at sentence
ends. A unit hashes to a wide vector, and a fingerprint is the sum of its units' vectors: the count modulo
2**32, ``LANES`` dense lanes modulo 2**64, and ``LEVELS`` x ``CELLS`` sparse cells modulo 2**16, of which each
unit touches one (level k with probability 2**-(k+1)). So the order of units does not matter, equal texts
have equal fingerprints, and units are inserted or deleted by adding or subtracting their vectors.
The dense lanes decide equality; the share of equal cells among those in use, from the lowest level that holds about
one unit a cell, estimates how much two multisets have in common.

``with_next`` pairs each document with the next one by id: one range shuffle of the texts, then every partition
streams through its sorted rows; only the last row of a partition needs the first of the next, which a small
join brings.

Defined results: a null text is an empty one (a single empty unit is no unit: count 0); rows with one doc_id go by
text; null ids come first; a single document is its own next. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import cut

LONG = 200
LANES = 8
#: As many levels as the count has bits, so that no text outgrows them.
LEVELS = 32
CELLS = 128
_EMPTY = (0, np.zeros(LANES, dtype=np.uint64), np.zeros(LEVELS * CELLS, dtype=np.uint16))


def units(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if len(line) > LONG:
            out.extend(line.split(". "))
        elif line:
            out.append(line)
    return out


class Fingerprint:
    """A sum of unit vectors. ``+`` joins two multisets, ``-`` takes one out of the other."""

    __slots__ = ("count", "lanes", "cells")

    def __init__(self, count: int = 0, lanes: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.count = count % (1 << 32)
        self.lanes = _EMPTY[1] if lanes is None else lanes
        self.cells = _EMPTY[2] if cells is None else cells

    @classmethod
    def of(cls, some: list[str]) -> Fingerprint:
        if not some:
            return cls()
        h = hashlib.blake2b
        rows = np.frombuffer(b"".join([h(u.encode()).digest() for u in some]), dtype="<u8").reshape(-1, LANES)
        low = rows[:, 0] | np.uint64(1 << (LEVELS - 1))
        level = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)
        cell = level * CELLS + (rows[:, 1] >> np.uint64(32)).astype(np.int64) % CELLS
        values = np.bincount(cell, weights=(rows[:, 2] & np.uint64(0xFFFF)).astype(np.float64), minlength=LEVELS * CELLS)
        return cls(len(some), rows.sum(axis=0, dtype=np.uint64), values.astype(np.uint64).astype(np.uint16))

    @classmethod
    def of_text(cls, text: str | None) -> Fingerprint:
        return cls.of(units(text)) if text else cls()

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.count + other.count, self.lanes + other.lanes, self.cells + other.cells)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.count - other.count, self.lanes - other.lanes, self.cells - other.cells)

    def __eq__(self, other) -> bool:
        return self.pack() == other.pack()

    def pack(self) -> bytes:
        """Count, lanes, then the cells in use: their places and their values."""
        used = np.flatnonzero(self.cells)
        return self.count.to_bytes(4, "little") + self.lanes.astype("<u8").tobytes() + used.astype("<u2").tobytes() + self.cells[used].astype("<u2").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Fingerprint:
        used, values = np.frombuffer(data, "<u2", -1, 4 + 8 * LANES).reshape(2, -1) if len(data) > 4 + 8 * LANES else ([], [])
        cells = np.zeros(LEVELS * CELLS, dtype=np.uint16)
        cells[np.asarray(used, dtype=np.int64)] = values
        return cls(int.from_bytes(data[:4], "little"), np.frombuffer(data, "<u8", LANES, 4), cells)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, else the share of equal cells among those in use in either (0 to 1)."""
        if self.count == other.count and (self.lanes == other.lanes).all():
            return 1.0
        level, most = 0, max(self.count, other.count)
        while level < LEVELS - 1 and most > CELLS << level:
            level += 1
        a, b = self.cells[level * CELLS :], other.cells[level * CELLS :]
        used = (a != 0) | (b != 0)
        n = int(used.sum())
        return float(((a == b) & used).sum() / n) if n else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _edited_fingerprint(text: str, own: Fingerprint, new: str) -> Fingerprint:
    """By deletion and insertion: only the units from the first changed line on are hashed again."""
    k = text.rfind("\n", 0, len(text) - len(text) // 4) + 1
    return own - Fingerprint.of(units(text[k:])) + Fingerprint.of(units(new[k:]))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _finish(doc_id, text: str, own: Fingerprint, next_text: str, following: Fingerprint) -> tuple:
    new = edited(text, next_text)
    changed = _edited_fingerprint(text, own, new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.pack().hex(), changed.pack().hex(), own.likeness(changed), own.likeness(following)


def _stream(batches):
    """Rows in order of id: finished ones (kind 0), and the first (1) and last (2) of the partition with their text."""
    place = TaskContext.get().partitionId()
    names = ["kind", "place", *_FIELDS, "text"]
    types = [pa.int32(), pa.int32(), *_TYPES, pa.string()]

    def send(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def border(kind, row):
        return (kind, place, row[0], None, None, None, None, None, None, row[1])

    last, out, size = None, [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = (doc_id, text or "", Fingerprint.of_text(text))
            if last is None:
                out.append(border(1, row))
            else:
                out.append((0, place, *_finish(*last, row[1], row[2]), None))
            last = row
            if len(out) >= 2000:
                yield send(out)
                out = []
    if last is not None:
        out.append(border(2, last))
    if out:
        yield send(out)


def _close(batches):
    for batch in batches:
        rows = [
            _finish(d, t, Fingerprint.of_text(t), n, Fingerprint.of_text(n)) for d, t, n in zip(*(c.to_pylist() for c in batch.columns))
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_FIELDS)


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``_RESULT``."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = cut(ordered.mapInArrow(_stream, f"kind int, place int, {_RESULT}, text string"), "streamed")
    firsts = rows.filter("kind = 1").select(F.col("place").alias("at"), F.col("text").alias("next_text"))
    over = Window.orderBy("place")  # a row for each partition, without texts
    places = rows.filter("kind = 1").select("place")
    nexts = places.select("place", F.coalesce(F.lead("place").over(over), F.min("place").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("at"))
    lasts = rows.filter("kind = 2").select("place", "doc_id", "text").join(nexts, "place").join(firsts, "at")
    closed = lasts.select("doc_id", "text", "next_text").mapInArrow(_close, _RESULT)
    return rows.filter("kind = 0").select(*_FIELDS).unionByName(closed)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint (packed) of every text, without any shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Fingerprint.of_text(t).pack() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, fingerprint binary")
