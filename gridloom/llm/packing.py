"""Best-fit packing of token pieces into sequences (operator 2).

Texts become ids and pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, ``capacity``
numbers whatever the input, reaches the driver. There a configuration linear program (how many sequences of
each filling, holding every length as often as it occurs) is solved by multiplicative weights: the lengths that a
filling covers grow cheaper, and an unbounded-knapsack dynamic program prices the best filling of one sequence at
these weights. Every set of prices also bounds the optimum from below, so the program knows its gap; it
goes over the lengths again, with those dearer whose sequences stayed short, until the gap is at most ``GAP`` or further
passes gain nothing. The solution is rounded down, fillings that still find all their lengths are taken once
more by what the rounding cost them, and best fit, longest first, packs the few pieces left.

The plan is a table of slots: for a length, ranks r0..r1 go to sequences s0.. at given offsets. The tokenizing task
counts its pieces by length as it goes, so a piece's rank is its number within the task plus what earlier tasks
have of that length: one small table, and the ids themselves are never shuffled for it.

Ids are those of the tokenizers library for the whole text, added tokens included: a text that spells one gets its
id. Where the file is a plain byte-level BPE (``_ranked`` proves it), tiktoken's loop over the same merges gives
the same ids faster; texts with very long runs without a break, and all other files, go through the library.

Defined results: a null or empty text is the end token alone; repeated rows are pieces of their own;
only texts longer than the capacity are cut, the first piece taking the remainder. An
empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import PATTERN
from gridloom.llm.shared import cut, text_slices

CAPACITY = 1024
END = 2
#: Relative gap between the program's sequences and its lower bound that is small enough.
GAP = 1e-3
#: Passes without gain after which the program stops.
PATIENCE = 3
#: How fast weights fall with cover, and how much dearer a token of the longest length is than one of the shortest.
STEP, TILT = 0.05, 0.02
#: Rows of the table of earlier ranks (a task and length each, 40 bytes) that are broadcast; more go through a shuffle join.
SMALL_RANKS = 500_000
#: Bytes without a change between white space and other text from which the library tokenizes.
LONG_RUN = 2000

_coders: dict[str, Coder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _ranked(path: str, tokenizer):
    """The file as a tiktoken encoding, or nothing unless both give equal ids for sure.

    That holds for a BPE over bytes split by PATTERN whose merges make tokens in order of id, and in which every token's own bytes merge
    to just that token: two parts that meet and spell a token are then always the two that its merge joins.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
    plain = plain and not any(file[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    plain = plain and not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or any(a != b and a in b for a in added for b in added):
        return None
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [vocab.get(t, -1) for t in merged]
    letters = _byte_letters()
    if order != sorted(set(order)) or set(vocab) != {*merged, *letters.values()}:
        return None
    if any(len(t) != 1 for t in map(tokenizer.model.tokenize, vocab)):
        return None
    byte = {letter: b for b, letter in letters.items()}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens=added)


def longest_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of the longest run of white space, or of other bytes, in each text."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    if not len(data):
        return out
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    turn = np.zeros(len(data) + 1, dtype=bool)
    turn[1:-1] = gap[1:] != gap[:-1]
    turn[offsets] = True
    at = np.flatnonzero(turn)
    np.maximum.at(out, np.searchsorted(offsets, at[:-1], side="right") - 1, np.diff(at))
    return out


class Coder:
    """Packed ids (little-endian unsigned 32-bit) of whole texts by the tokenizer in a file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = _ranked(path, self.library)

    def one(self, text: str, longest: int) -> bytes:
        if self.fast is not None and longest < LONG_RUN:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def packed_column(self, column: pa.Array) -> list[bytes]:
        runs = np.concatenate([longest_runs(data, offsets) for _, data, offsets in text_slices(column)] or [np.empty(0, dtype=np.int64)])
        return [self.one(t, r) if t else b"" for t, r in zip(column.to_pylist(), runs.tolist())]

    def packed_many(self, texts: list[str | None]) -> list[bytes]:
        return self.packed_column(pa.array(texts, pa.string()))


def coder(path: str) -> Coder:
    """The coder of this process for the file (a worker reads it once)."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and packed ids of every piece, with the task that made it and its rank there among its length."""
    tail = end.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids", "task", "rank"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        task = TaskContext.get().partitionId()
        made = [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for name, packed in zip(batch.column(0).to_pylist(), coder(tokenizer).packed_column(batch.column(1))):
                    packed += tail
                    n = len(packed) // 4
                    a, k = 0, 0
                    while a < n:
                        b = a + ((n - a - 1) % capacity + 1)
                        rows.append((name, k, a, b - a, packed[4 * a : 4 * b], task, made[b - a]))
                        made[b - a] += 1
                        a, k = b, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task long, rank long")


def best_filling(price: np.ndarray, capacity: int) -> tuple[list[int], float]:
    """The filling of most worth and that worth: unbounded knapsack over lengths 1.. by their price."""
    lengths = np.flatnonzero(price > 0)
    costs = price[lengths]
    worth = np.zeros(capacity + 1)
    taken = [0] * (capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        best, fit = worth[room - 1], upto[room]
        if fit:
            value = costs[:fit] + worth[room - lengths[:fit]]
            k = int(value.argmax())
            if value[k] > best:
                best, taken[room] = value[k], int(lengths[k])
        worth[room] = best
    out, room = [], capacity
    while room > 0:
        if taken[room]:
            out.append(taken[room])
        room -= taken[room] or 1
    return out, float(worth[capacity])


def _pass(lengths: np.ndarray, demand: np.ndarray, dear: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """One solution that holds each length exactly to its demand, and the best lower bound that its prices gave.

    A round prices the best filling and takes it until its scarcest length is used up, so there are at most as many rounds
    as lengths. A length's weight falls with the share of its demand that is covered; lengths used up leave.
    """
    left, bound = demand.copy(), 0.0
    used: dict[tuple[int, ...], float] = {}
    while left.any():
        weight = np.where(left > 0, (left / demand) ** STEP, 0.0)
        worth = weight * dear * lengths * (1 + TILT * lengths / capacity)
        price = np.zeros(capacity + 1)
        price[lengths] = worth
        filling, most = best_filling(price, capacity)
        bound = max(bound, float((worth * demand).sum()) / most)
        at, times = np.unique(np.searchsorted(lengths, filling), return_counts=True)
        amount = float((left[at] / times).min())
        used[tuple(filling)] = used.get(tuple(filling), 0.0) + amount
        left[at] -= amount * times
        left[left < 1e-9 * demand] = 0.0
    return used, bound


def configuration_program(need: dict[int, int], capacity: int, gap: float = GAP) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """(fractional numbers of each filling, lower bound on their sum), by multiplicative weights over passes.

    After a pass whose gap is too wide, each length grows dearer by the room that its sequences left open, which
    both puts it first in the next pass and raises the bound where long lengths rule.
    """
    lengths = np.array(sorted(need))
    demand = np.array([need[x] for x in lengths.tolist()], dtype=float)
    dear, best, total, bound, idle = np.ones(len(lengths)), {}, np.inf, 0.0, 0
    price = np.zeros(capacity + 1)
    price[lengths] = lengths
    bound = float((lengths * demand).sum()) / best_filling(price, capacity)[1]  # by tokens alone
    while idle < PATIENCE and total > bound * (1 + gap):
        used, least = _pass(lengths, demand, dear, capacity)
        n = sum(used.values())
        idle = 0 if n < total * (1 - gap / 10) or least > bound * (1 + gap / 10) else idle + 1
        if n < total:
            best, total = used, n
        bound = max(bound, least)
        lost = np.zeros(len(lengths))
        for filling, amount in used.items():
            for x in filling:
                lost[np.searchsorted(lengths, x)] += amount * (capacity - sum(filling)) / capacity
        dear = dear * np.exp(lost / demand)
    return list(best.items()), bound


def best_fit(need: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on the histogram: (filling, times). Work depends on lengths, not on counts."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room -> filling -> times
    for x in sorted(need, reverse=True):
        left = need[x]
        while left:
            room = next((r for r in range(x, capacity) if open_.get(r)), None)
            if room is None:
                filling, times, room = (), left, capacity
            else:
                filling, times = next(iter(open_[room].items()))
            each = room // x
            full = min(times, left // each)
            if room < capacity:
                spent = full if full else 1
                open_[room][filling] -= spent
                if not open_[room][filling]:
                    del open_[room][filling]
            if full:
                now, r = filling + (x,) * each, room - each * x
                open_.setdefault(r, {})[now] = open_.setdefault(r, {}).get(now, 0) + full
                left -= full * each
            else:
                now, r = filling + (x,) * left, room - left * x
                open_.setdefault(r, {})[now] = open_.setdefault(r, {}).get(now, 0) + 1
                left = 0
    return [(f, n) for fs in open_.values() for f, n in fs.items()]


def rounded(program: list[tuple[tuple[int, ...], float]], need: dict[int, int]) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Whole numbers of the program's fillings, and the lengths that they leave over."""
    left, out = dict(need), []
    down = [(f, int(x + 1e-9)) for f, x in program]
    up = [(f, 1) for f, _ in sorted(program, key=lambda p: int(p[1] + 1e-9) - p[1])]
    for filling, times in down + up:
        for x in set(filling):
            times = min(times, left[x] // filling.count(x))
        if times:
            out.append((filling, times))
            for x in filling:
                left[x] -= times
    return out, {x: n for x, n in left.items() if n}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) that hold each length exactly as often as ``histogram`` says."""
    need = {x: n for x, n in histogram.items() if n > 0 and x < capacity}
    whole = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    if not need:
        return whole
    fillings, left = rounded(configuration_program(need, capacity, gap)[0], need)
    return whole + fillings + best_fit(left, capacity)


def slots(fillings: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Sorted by (length, first): ranks ``first``.. of a length go ``each`` to a sequence from ``sequence`` on, at ``offset``."""
    first: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            each = filling.count(x)
            rows.append((x, first.get(x, 0), sequence, each, offset))
            first[x] = first.get(x, 0) + each * times
            offset += each * x
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, gap: float = GAP) -> DataFrame:
    """The columns of ``token_pieces`` up to the ids, with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = cut(pieces, "pieces")
    counts = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")  # capacity rows a task at most
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    sent = spark.sparkContext.broadcast(slots(plan(histogram, capacity, gap)))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("task", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    if counts.count() <= SMALL_RANKS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["task", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = sent.value
        span = np.int64(1) << 44
        at = np.searchsorted(t["length"] * span + t["first"], length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        within = rank.to_numpy() - t["first"][at]
        return pd.DataFrame({"sequence_id": t["sequence"][at] + within // t["each"][at], "offset": t["offset"][at] + within % t["each"][at] * length.to_numpy()})

    placed = ranked.withColumn("at", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, text, capacity, end), capacity)
