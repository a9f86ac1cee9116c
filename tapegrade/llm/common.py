"""What the corpus operators share: the checkpoint folder, Arrow text buffers, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrade.operators.graph import packed

#: Rows and bytes of one Arrow batch between the JVM and Python; bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes that vectorised code works on at once.
SLICE = 1 << 20
U64 = np.uint64
#: ASCII white space as the word pattern has it: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and sees to a checkpoint folder.

    On a cluster the folder is the one of ``spark.checkpoint.dir``. Only a local master without that
    setting gets a temporary folder of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    _ship(sc)
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return spark


def _ship(sc) -> None:
    """Sends this package to the executors once, so that their workers can import it."""
    if getattr(sc, "_tapegrade_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "tapegrade_llm.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder in (top, os.path.join(top, "llm"), os.path.join(top, "operators")):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(archive)
    sc._tapegrade_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, size: int, each: int = 8 << 20) -> int:
    """Into how many buckets ``size`` bytes are dealt, so that a worker holds about ``each`` at once: their number follows the data."""
    return max(partitions(spark), -(-int(size) // each))


def sized(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df``, of so many counted rows of ``width`` bytes, for the small side of a join: broadcast up to 8 MB, else sorted and merged."""
    return F.broadcast(df) if rows * width <= 8 << 20 else df.hint("merge")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` saved, in as many partitions as its rows need, and their number; for tables that may be small."""
    df = saved(df)
    rows = df.count()
    return packed(df, rows), rows


#: What workers keep between partitions, by its owner; other work starts by dropping it.
HELD: dict[str, dict] = {}


def release(owner: str | None = None) -> None:
    """Drops what others than ``owner`` keep and hands freed memory back to the system: workers live on for other tasks, and what they keep adds up."""
    for name, cache in HELD.items():
        if cache and name != owner:
            cache.clear()
            gc.collect()  # encoder and memory refer to each other
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run`` over the batches of a partition, with what other work kept and freed memory released before and after."""

    def over(batches):
        release()
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            release()

    return over


def tidy(run):
    """``run(key, table)`` of a group, with freed memory released before and after."""

    def over(key, table):
        release()
        try:
            return run(key, table)
        finally:
            release()

    return over


def tidy_pair(run):
    """``run(key, left, right)`` of two groups of a key, with freed memory released before and after."""

    def over(key, left, right):
        release()
        try:
            return run(key, left, right)
        finally:
            release()

    return over


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a sum count."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def byte_codes(seed: int = 7) -> np.ndarray:
    """A fixed random 64-bit code for each byte value."""
    return mix((np.arange(256, dtype=U64) + U64(1 + 257 * seed)) * U64(0x9E3779B97F4A7C15))


_BASE = 0x9E6C63D0A13B5A4D  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(_BASE))]), dtype=U64)
            down = np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(_INVERSE))]), dtype=U64)
        _powers[size] = up, down
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hashes of data[start:end], from prefix sums of a polynomial, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(byte_codes(seed)[data] * up[: len(data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of words: runs of bytes that are not white space (or are ``inside``)."""
    word = ~SPACE[data] if inside is None else inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never crosses documents
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE):
    """The batch in runs of rows with at most ``limit`` bytes of text each, or one row that has more."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
