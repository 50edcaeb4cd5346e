"""What the operators of this subpackage share: tables that cut lineage, size-checked joins, text vectors."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import materialize, release, shared_dir, small_batches  # noqa: F401

#: Rows of (long key, small payload) that may be broadcast: about 50 MB as a hashed relation.
BROADCAST_ROWS = 500_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if `df` (a materialized table of narrow rows) has at most `rows` rows; else join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (null: no bytes)."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def give_back() -> None:
    """Return freed memory to the system at a task's end: the worker stays, and other stages run beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc: nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def runs(offsets: np.ndarray, budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `budget` bytes (a longer row has a range of its own), so that vectors stay bounded."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + budget, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))


class _Powers:
    """base**i mod 2**64, longer when a longer text comes."""

    def __init__(self, base: np.uint64):
        self.base, self.p = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.p) < n:
            n = 1 << max(20, math.ceil(math.log2(n)))
            p = np.full(n, self.base, np.uint64)
            p[0] = 1
            self.p = np.multiply.accumulate(p)
        return self.p


_POW, _IPOW = _Powers(_BASE), _Powers(_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased, and the words' row offsets.

    inside: by byte, whether it belongs to a word. A word never crosses rows.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    w = inside[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[edge - 1] = w[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[raw]] * _POW(n)[:n], out=c[1:])
    h = mix((c[e + 1] - c[s]) * _IPOW(n)[s])
    return h, np.searchsorted(s, offsets).astype(np.int64)


def byte_class(separators: bytes) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


#: [^\x20\x09-\x0D]+
SPACED = byte_class(b" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles, and their row offsets.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.diff(offsets)
    out: list[np.ndarray] = []
    if len(h) >= k:
        acc = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            acc = mix(acc) + h[i : len(h) - k + 1 + i]
        acc = mix(acc)
    for row in range(len(count)):
        a, n = int(offsets[row]), int(count[row])
        if n >= k:
            out.append(np.unique(acc[a : a + n - k + 1]))
        elif n:
            x = h[a : a + 1].copy()
            for i in range(1, n):
                x = mix(x) + h[a + i : a + i + 1]
            out.append(mix(x + np.uint64(n)))
        else:
            out.append(h[:0])
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else h[:0]), np.concatenate([[0], np.cumsum(sizes)])
