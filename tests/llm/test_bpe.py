import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from gridloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    "", " ", "\n", "a", " a", "a ", "a\n\nb", "don't we'll  I'm", "\t\tx  y\r\n z ", "été ñandú 日本語 текст 🙂🙂", "a\x1cb \x85c\xa0 d",
    "x" * 300, " " * 50 + "q", "1234 5678,90", "foo\n bar \nbaz", "\nlead", "trail\n", "<|endoftext|> ok", "a b  c   d\n\n\ne", "\x00\x01 ﻿z",
]


def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == P.PATTERN


def test_same_ids_as_the_library():
    e, c, r = own(), bpe.codec(PATH), random.Random(7)
    texts = HARD + ["".join(r.choice("ab é\n \t'sñ1,.!🙂\x1c") for _ in range(r.randrange(80))) for _ in range(3000)]
    for t in texts:
        assert c.encode(t) == e.encode_ordinary(t), repr(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_small_memory_gives_the_same_ids():
    table = bpe.Ranks(PATH)
    small = bpe.WordCoder(lambda pieces: table.merge_many([p.encode() for p in pieces]), size=3)
    e, r = own(), random.Random(3)
    for _ in range(20):
        texts = ["".join(r.choice("ab é\n.") for _ in range(30)) for _ in range(5)]
        got = [memoryview(p).cast("I").tolist() for p in small.packed_many(texts)]
        assert got == [e.encode_ordinary(t) for t in texts]


def test_many_at_a_time_is_one_at_a_time():
    table, r = bpe.Ranks(PATH), random.Random(5)
    pieces = [bytes(r.choice(b"theinab \xc3\xa9") for _ in range(r.randrange(1, 90))) for _ in range(2000)]
    got = [memoryview(p).cast("I").tolist() for p in table.merge_many(pieces)]
    assert got == [bpe.merge(p, table.ranks) for p in pieces]


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(99, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS ids")
    e = own()
    enc = bpe.encode(df, PATH)
    back = bpe.decode(enc, PATH, keep=("doc_id", "n_tokens"))
    got = sorted((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in back.collect())
    assert got == sorted((i, len(e.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    trip = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH).collect()}
    want = {
        (i, hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e.encode_ordinary(t or ""))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    }
    assert trip == want
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [2, 3, 7, 8, 9, 31])
def test_merge_of_one_letter(n):
    e = own()
    assert bpe.merge(b"a" * n, bpe.read_ranks(PATH)) == e.encode_ordinary("a" * n)
