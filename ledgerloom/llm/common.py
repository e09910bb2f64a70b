"""Helpers of the text operators: written tables that cut lineage, and
vectorised word arrays over Arrow string batches.

Words are maximal runs of bytes outside a set of ASCII separators. All
separators are ASCII, so working on UTF-8 bytes gives the same words as
working on code points.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

WHITE = bytes([0x20, *range(0x09, 0x0E)])
LAST = (1 << 63) - 1  # stands for a null id where ids are ordered: after every other
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- written tables

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a local
    session without the setting (tests) gets a scratch folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ledgerloom-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost
    executor costs the tasks that were running, not the history. The tables
    are deleted when the Python process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write go when it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm if spark.sparkContext._jsc else None
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- text blocks

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``size``
    bytes: arrays stay bounded by ``size`` and the longest single text."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offs, offs[lo] + size, "right")) - 1, lo + 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def separator_table(separators: bytes) -> np.ndarray:
    """256 flags: is the byte part of a word?"""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


WORD_BYTES = separator_table(WHITE)


def word_spans(data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the position of each row's first word
    (one more entry than rows). Words do not cross rows."""
    w = word_bytes[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = w[inner]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[inner - 1] = w[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashes

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = int(_RNG.integers(1, 1 << 62)) * 8 + 5
_BI = pow(_B, -1, 1 << 64)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_POW_KEPT = 1 << 22  # powers that stay for the next call: 32 MB


def powers(n: int, kind: str = "up") -> np.ndarray:
    """B**i (or its inverse) modulo 2**64 for i < n."""
    if len(_POW[kind]) >= n:
        return _POW[kind][:n]
    out = np.full(max(n, 1 << 16), np.uint64(_B if kind == "up" else _BI), np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if len(out) <= _POW_KEPT:
        _POW[kind] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * B**i, one entry more than values."""
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=c[1:])
    return c


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans; equal spans get equal hashes."""
    h = (sums[ends] - sums[starts]) * powers(len(sums), "down")[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, everything else unchanged."""
    up = (data >= 65) & (data <= 90)
    return data + up.astype(np.uint8) * np.uint8(32)


#: Words up to this many bytes take the vectorised hash. Modulo 2**64 a polynomial
#: cannot tell some long words of two letters apart, so longer ones take XXH3.
SHORT_WORD = 32
#: Bytes whose running sums are held at a time, at about 36 bytes each.
STRETCH = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per word, stretch by stretch: what is held beside the words'
    places does not grow with the text."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + STRETCH, "left"))
        a, b = starts[lo:hi], ends[lo:hi]
        short = np.minimum(b, a + SHORT_WORD)  # a longer word's own hash follows
        out[lo:hi] = span_hash(prefix_sums(_BYTE[data[a[0]:short[-1]]]), a - a[0], short - a[0])
        for i in np.flatnonzero(b - a > SHORT_WORD):
            out[lo + i] = xxhash.xxh3_64_intdigest(data[a[i]:b[i]])
        lo = hi
    return out


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE[data])
