"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans import session
from skein.plans.session import cut, drop, table

__all__ = ["WordHashes", "as_bytes", "chunks", "cut", "drop", "extra", "mix", "sampled", "ship", "table", "tidy", "window_hashes"]

#: Text handed to one vectorised step inside a Python worker, in bytes.
CHUNK_BYTES = 2_000_000

#: Rows and bytes of a batch between Spark and a Python worker, where the session has the defaults.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608", "67108864"),
)

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library: freed memory stays with the worker
    _libc = None


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and keep Arrow batches small.

    A session's own batch settings stay as they are.
    """
    for setting, value, default in BATCHES:
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, value)
    session.ship(spark)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    if batch.num_rows == 0:
        return
    values = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pc.binary_length(values).fill_null(0))
    total = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(array: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


#: ASCII capitals become small letters; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tidy(*caches: dict) -> None:
    """At the end of a partition: a worker that waits for its next task holds no memory of this one."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive word hashes (none if there are fewer words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # Doubling: a run of 2k words is two runs of k words.
        runs, size, done, out = words, 1, 0, None
        left = width
        while left:
            if left & 1:
                part = runs[done : done + n]
                out = part.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
                done += size
            left >>= 1
            if left:
                m = len(runs) - size
                runs = runs[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + runs[size : size + m]
                size *= 2
        return mix(out)


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` of ``total`` rows, drawn by a hash of the key: the same ones in every run.

    Rows are first thinned out to about as many, so partitions do not each send ``rows`` of them.
    """
    place = F.pmod(F.xxhash64(key, F.lit(77)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = 1.0 if total <= rows else 1.2 * rows / total
    return df.where(place <= share).orderBy(place, key).limit(rows)


def extra(df: DataFrame, kept: tuple[str, ...]) -> None:
    """Fail early and plainly when a needed column is missing."""
    missing = [c for c in kept if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
