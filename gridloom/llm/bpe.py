"""Byte-level BPE encoding and decoding (operator 1).

A pre-token is a row of bytes; every adjacent pair of live parts has the rank of its joined bytes. A
segment tree over the byte positions holds, in each node, the smallest ``rank * width + position`` below
it, so its root is the leftmost pair of least rank. A merge takes the root, joins the right part to the
left one and does three logarithmic point updates: the merged pair, the pair before it and the dead slot.
``merge`` does this for one pre-token, ``Ranks.merge_many`` for many at a time with one tree a row of an array.

Defined results: null and empty texts give no ids; every byte has a rank, so any text can be encoded;
repeated rows give the same ids each. Ids come back as little-endian unsigned 32-bit integers in a binary
column. Only the named columns are read, so extra columns of any name pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No pair here that has a rank.
NONE = 1 << 62
#: Words kept in each of the two generations of a worker's memory.
REMEMBERED = 400_000
#: Pre-token split of the public rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than one blank or line feed between two words, with the word after it.
_ODD = regex.compile(r"(?:\s{2,}|[^\S\n ]|\A\s)\S*|\s\Z")
_WHITE = regex.compile(r"\s").match


def white(char: str) -> bool:
    """White space by the pattern's own definition, which is narrower than ``str.isspace``."""
    return char.isspace() and _WHITE(char) is not None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by merges in order of rank, leftmost first."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if n == 1:
        raise KeyError(piece)
    width = 1
    while width < n:
        width *= 2
    none = NONE
    get = ranks.get
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # where the part that starts here stops; live starts only
    prev = list(range(-1, n))  # start of the part before
    while (best := tree[1]) != none:
        i = best % width
        j = end[i]  # the part that is joined to i
        stop = end[j]
        end[i] = stop
        if stop < n:
            prev[stop] = i
            r = get(piece[i : end[stop]])
            now = none if r is None else r * width + i
        else:
            now = none
        updates = [(i, now), (j, none)]
        p = prev[i]
        if p >= 0:
            r = get(piece[p:stop])
            updates.append((p, none if r is None else r * width + p))
        for at, value in updates:
            k = width + at
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Generations:
    """Packed ids by word, of bounded size: words asked for again survive, the rest goes after two rounds."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.now) >= self.size:
            self.now, self.old = {}, self.now

    def unknown(self, words: set[str]) -> list[str]:
        """Those of ``words`` that are still to be encoded; the others are in ``now`` afterwards."""
        missing = words.difference(self.now)
        old = self.old
        if old:
            for w in missing.intersection(old):
                self.now[w] = old[w]
            missing = missing.difference(old)
        return list(missing)


class WordCoder:
    """Packed ids of whole texts from the packed ids of chunks.

    A blank or line feed between two words always starts a new pre-token, so texts are looked up chunk by chunk:
    a word with the blank or line feed before it. A text where white space comes in other forms is split into
    regular stretches and into runs of white space with the word behind them, which go through the pattern.
    ``encode_pieces`` gives the packed ids of a list of pre-tokens.
    """

    def __init__(self, encode_pieces, size: int = REMEMBERED):
        self.split = regex.compile(PATTERN).findall
        self.encode_pieces = encode_pieces
        self.chunks = Generations(size)

    @staticmethod
    def _keys(text: str) -> list[str]:
        """Chunks of a regular stretch of text. The first is as it stands; the others lack their blank."""
        return text.replace("\n", " \n").split(" ")

    def _pieces(self, key: str) -> list[str] | None:
        """Pre-tokens of a chunk, nothing where white space at its border may belong to its neighbour."""
        word = key[1:] if key[:1] == "\n" else key
        if not word or white(word[0]) or white(word[-1]):
            return None
        if word.isalpha():
            return [" " + word] if word is key else ["\n", word]
        if word[-1] in ".,!?;:" and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]] if word is key else ["\n", word[:-1], word[-1]]
        return self.split(" " + word if word is key else key)

    def _learn(self, keys: set[str], loose: set[str]) -> dict[str, bytes]:
        """Put the chunks of ``keys`` into memory (None: not regular); the packed ids of the ``loose`` strings."""
        found = {k: self._pieces(k) for k in self.chunks.unknown(keys)}
        pieces = {k: self.split(k) for k in loose}
        wanted = {p for f in found.values() if f for p in f} | {p for f in pieces.values() for p in f}
        own = [p for p in wanted if not (p[0] == " " and len(p) > 1 and p[1].isalpha())]
        words = self.chunks.unknown({p[1:] for p in wanted if p[0] == " " and len(p) > 1 and p[1].isalpha()})
        now = self.chunks.now
        packed = self.encode_pieces(own + [" " + w for w in words])
        at = dict(zip(own, packed))
        now.update(zip(words, packed[len(own) :]))
        value = lambda f: b"".join([at[p] if p in at else now[p[1:]] for p in f])
        for k, f in found.items():
            if k not in now:
                now[k] = None if f is None else value(f)
        return {k: value(f) for k, f in pieces.items()}

    def packed_many(self, texts: list[str]) -> list[bytes]:
        self.chunks.turn()
        known = self.chunks.now.get
        keys = [self._keys(t) if t else [""] for t in texts]
        found = [list(map(known, k)) for k in keys]
        unknown = {k for ks, f in zip(keys, found) if None in f for k, v in zip(ks, f) if v is None}
        unknown.discard("")
        first = self._learn(unknown, {k[0] for k in keys if k[0]})
        now = self.chunks.now
        out = []
        for text, ks, f in zip(texts, keys, found):
            if not text:
                out.append(b"")
                continue
            if None in f:
                f = [now.get(k) if v is None else v for k, v in zip(ks, f)]
            f[0] = first[ks[0]] if ks[0] and not white(ks[0][0]) and not white(ks[0][-1]) else None
            out.append(self._irregular(text) if None in f else b"".join(f))
        return out

    def _irregular(self, text: str) -> bytes:
        stretches, at = [], 0
        for m in _ODD.finditer(text):
            if m.start() > at:
                stretches.append((True, text[at : m.start()]))
            stretches.append((False, m[0]))
            at = m.end()
        if at < len(text):
            stretches.append((True, text[at:]))
        keys = [self._keys(s) if regular else [s] for regular, s in stretches]
        first = self._learn({k for ks in keys for k in ks[1:]}, {ks[0] for ks in keys if ks[0]})
        now = self.chunks.now
        return b"".join([part for ks in keys for part in (first[ks[0]] if ks[0] else b"", *[now[k] for k in ks[1:]])])


#: Pre-tokens of more bytes than this are merged one by one, the others many at a time.
WIDEST = 64


class Ranks:
    """A rank file, with the pair table that the merges of many pre-tokens at a time look ranks up in."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (self.ranks[t[:k]] << 32 | self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], dtype=np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token: the merges of ``merge``, one step of every pre-token at a time."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[k] = np.array(merge(p, self.ranks), dtype="<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for width, members in by_width.items():
            for at in range(0, len(members), 20_000):
                some = members[at : at + 20_000]
                for k, ids in zip(some, self._merge_block([pieces[k] for k in some], width)):
                    out[k] = ids
        return out

    def _merge_block(self, pieces: list[bytes], width: int) -> list[bytes]:
        rows = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(rows, width)
        ids = self.byte_id[text]
        place = np.arange(width)
        live = place[None, :] < lengths[:, None]
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        found = self._ranks_of(ids[:, :-1], ids[:, 1:])
        ok = live[:, 1:] & (found != NONE)
        tree[:, width : 2 * width - 1][ok] = (found * width + place[:-1])[ok]
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        nxt = np.where(live, place + 1, width)  # start of the next live part; the length of the piece ends it
        prev = np.broadcast_to(place - 1, (rows, width)).copy()
        flat, nxt_f, prev_f, ids_f, live_f = tree.reshape(-1), nxt.reshape(-1), prev.reshape(-1), ids.reshape(-1), live.reshape(-1)
        levels = width.bit_length() - 1

        def put(base, at, value):
            node = at + width
            flat[base + node] = value
            for _ in range(levels):
                node = node >> 1
                pair = base + 2 * node
                flat[base + node] = np.minimum(flat[pair], flat[pair + 1])

        r = np.flatnonzero(tree[:, 1] != NONE)
        while len(r):
            base, cell, stop_at = r * (2 * width), r * width, lengths[r]
            best = flat[base + 1]
            i = best % width
            j = nxt_f[cell + i]
            stop = nxt_f[cell + j]
            ids_f[cell + i] = best // width
            live_f[cell + j] = False
            nxt_f[cell + i] = stop
            more = stop < stop_at
            after = np.where(more, stop, 0)
            prev_f[(cell + after)[more]] = i[more]
            rank = np.where(more, self._ranks_of(ids_f[cell + i], ids_f[cell + after]), NONE)
            put(base, j, np.full(len(r), NONE))
            put(base, i, np.where(rank == NONE, NONE, rank * width + i))
            p = prev_f[cell + i]
            has = p >= 0
            if has.any():
                b, c, p, i = base[has], cell[has], p[has], i[has]
                rank = self._ranks_of(ids_f[c + p], ids_f[c + i])
                put(b, p, np.where(rank == NONE, NONE, rank * width + p))
            r = r[flat[base + 1] != NONE]
        packed = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)]


class RankCodec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str):
        self.table = Ranks(path)
        self.coder = WordCoder(lambda pieces: self.table.merge_many([p.encode() for p in pieces]))

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        return [p for at in range(0, len(texts), 500) for p in self.coder.packed_many(texts[at : at + 500])]

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_packed([text])[0]).cast("I").tolist()

    def decode(self, ids) -> bytes:
        tokens = self.table.tokens
        return b"".join([tokens[i] for i in ids])

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(memoryview(packed).cast("I").tolist())


_codecs: dict[str, RankCodec] = {}


def codec(path: str) -> RankCodec:
    """The codec of this process for the file (a worker reads it once)."""
    if path not in _codecs:
        _codecs[path] = RankCodec(path)
    return _codecs[path]


def _mapped(df: DataFrame, keep: list[str], column: str, added: str, work) -> DataFrame:
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches):
        for batch in batches:
            yield from work(batch)

    return df.select(*keep, F.col(column).alias("__in")).mapInArrow(run, f"{names}, {added}")


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + ``n_tokens`` + ``ids`` (packed little-endian unsigned 32-bit integers)."""

    def work(batch):
        packed = codec(ranks_path).encode_packed(batch.column(len(keep)).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
            names=[*keep, "n_tokens", "ids"],
        )

    return _mapped(df, list(keep), text, "n_tokens long, ids binary", work)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + ``decoded`` (binary) from a column of packed ids; null ids give no bytes."""

    def work(batch):
        c = codec(ranks_path)
        out = [c.decode_packed(x.as_py() or b"") for x in batch.column(len(keep))]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return _mapped(df, list(keep), ids, "decoded binary", work)


def round_trip(df: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encode and decode in one pass over the texts.

    Only digests leave the worker, so ids and bytes cross no process border.
    """

    def work(batch):
        c = codec(ranks_path)
        counts, ids, decoded = [], [], []
        for packed in c.encode_packed(batch.column(len(keep)).to_pylist()):
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(c.decode_packed(packed)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _mapped(df, list(keep), text, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
