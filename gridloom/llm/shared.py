"""Pieces that several operators use: cut tables, and word hashing over whole Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Byte classes of ``[\x20\x09-\x0D]``; every operator that speaks of words splits at these only.
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: Texts are hashed in slices of about this many bytes, so a worker's arrays stay small.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch while a table is cut.
BATCH_ROWS = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one, but only on a local master."""
    known = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later work starts from files.

    A lost executor then costs only the tasks it ran: nothing before the table is computed again. Tables that
    ``drop_cut`` has not deleted go when the application ends. Arrow batches are of ``BATCH_ROWS`` rows meanwhile: the buffers
    of larger ones, outside the heap on either side, are what executors run out of.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    spark.conf.set(batch, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(batch, usual)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            spark = t.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


# --- word hashing ---------------------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, size=256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n (kept and grown per process)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), dtype=np.uint64)
        out[0] = 1
        filled = 1
        step = base
        while filled < len(out):
            take = min(filled, len(out) - filled)
            out[filled : filled + take] = out[:take] * _U(step)
            filled += take
            step = step * step % (1 << 64)
        _powers[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def rolling(h: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values of ``h`` (len(h) - width + 1 of them)."""
    n = len(h)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    inv = _INV if base == _BASE else pow(base, -1, 1 << 64)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(base, n)[:n], out=pre[1:])
    return (pre[width:] - pre[:-width]) * powers(inv, n)[: n - width + 1]


def text_slices(column: pa.Array):
    """Yield (first row, bytes, offsets) of slices of a string or binary column; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, raw_offsets, data = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """(hash of each word, first word of each text and the end): words are runs without WORD_BREAKS."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:n]))
    after = np.ones(n, dtype=bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, n)[:n], out=pre[1:])
    h = (pre[ends] - pre[starts]) * powers(_INV, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)
