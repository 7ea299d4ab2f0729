"""Shared pieces: Arrow text buffers, byte tokenisers and vectorised hashing.

Words are hashed by a polynomial modulo the prime 2**61 - 1 with a random base,
kept as prefix sums, so the hash of any byte range costs two lookups and two
multiplications.  Structured texts (a Thue-Morse word and its complement, say)
collide under a polynomial modulo 2**64 whatever its base; under a prime modulus
two different ranges of n bytes meet with a chance of n / 2**61.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = 0x20
CHUNK_BYTES = 1 << 21
NO_DOC = np.int64(np.iinfo(np.int64).max)

PRIME = np.uint64((1 << 61) - 1)
#: A random base below the prime, the same in every process.
_BASE = 0x0B5AD4ECEDA1CE2A
_INVERSE = pow(_BASE, -1, int(PRIME))
_STEP = 0x9E3779B97F4A7C15
#: Byte ranges up to this long have exact sums in 64 bits.
_EXACT = 1 << 22
_LOW32 = np.uint64(0xFFFFFFFF)
_powers = {"low": np.ones(1, np.uint64), "high": np.zeros(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """checkpoint() needs a folder that all executors share: the cluster's
    (spark.checkpoint.dir).  A temporary one is taken only by a local session
    that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected the plans
    that made them, which may be long after; this is that collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives a worker's freed memory back; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the folder of the checkpoints, and read again."""
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(docs: DataFrame, column: str = "text", target_bytes: int = 8 << 20) -> int:
    """How many batches of about target_bytes the texts make (8 at least)."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(8, math.ceil(total / target_bytes))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for numbers below it."""
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    total = (ah * bh << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return reduced(total + (low & PRIME) + (low >> np.uint64(61)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The low 32 and the high 29 bits of the base's powers 0..n-1."""
    have = len(_powers["low"])
    if have < n:
        whole = _powers["low"] | _powers["high"] << np.uint64(32)
        while len(whole) < n:
            whole = np.concatenate([whole, times(whole, np.full(1, pow(_BASE, len(whole), int(PRIME)), np.uint64))])
        _powers["low"], _powers["high"] = whole & _LOW32, whole >> np.uint64(32)
    return _powers["low"][:n], _powers["high"][:n]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial's low and high parts; entry i covers data[:i]."""
    out = np.empty((2, len(data) + 1), np.uint64)
    value = data.astype(np.uint16) + np.uint16(1)
    for row, power in zip(out, powers(len(data)), strict=True):
        row[0] = 0
        np.multiply(power, value, out=row[1:])
        np.cumsum(row, out=row)
    return out[0], out[1]


@lru_cache(4)
def _inverses(step: int, n: int) -> np.ndarray:
    factor, out = pow(_INVERSE, step, int(PRIME)), [1]
    for _ in range(n - 1):
        out.append(out[-1] * factor % int(PRIME))
    return np.array(out, np.uint64)


def range_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Hash of each byte range, independent of where it stands."""
    out = np.empty(len(start), np.uint64)
    if len(start):
        blocks = _inverses(1, 4096), _inverses(4096, (int(start.max()) >> 22) + 1 << 10)
        for i in range(0, len(start), block):  # pieces that stay in the cache
            out[i : i + block] = _range_hash(prefix, start[i : i + block], end[i : i + block], *blocks)
    return out


def _range_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    total, at = np.zeros(len(start), np.uint64), start
    while True:  # one round unless a range is longer than the sums are exact
        stop = np.minimum(end, at + _EXACT)
        low, high = (reduced(p[stop] - p[at]) for p in prefix)
        # 2**32 times high is a rotation of its 61 bits
        total = reduced(total + low + reduced((high << np.uint64(32) & PRIME) | high >> np.uint64(29)))
        if (stop == end).all():
            break
        at = stop
    shift = times(near[start & 4095], far[start >> 12])
    return mix(times(total, shift) + (end - start).astype(np.uint64) * np.uint64(_STEP))


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column, "")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends): rows of about `limit` bytes
    together, whole texts only, with one separator byte after each text."""
    if not len(column):
        return
    data, offsets = buffer_of(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        at = offsets[a : b + 1] - offsets[a]
        yield a, b, np.insert(data[offsets[a] : offsets[b]], at[1:], SEPARATOR), at[:-1] + np.arange(b - a), at[1:] + np.arange(b - a)
        a = b


def words_of(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    edge = np.diff(letters[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sequences_hash(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive values (runs may cross texts)."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    n = len(values) - length + 1
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out ^= out >> np.uint64(32)
        out *= np.uint64(_STEP)
        out += values[i : i + n]
    return mix(out)


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
