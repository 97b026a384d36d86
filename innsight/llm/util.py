"""Shared helpers of the corpus operators: written intermediate tables and text hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from innsight.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between Spark and a Python worker; 10,000 rows (Spark's other limit) of long texts are many times that.
ARROW_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, limit: int = ARROW_BYTES) -> Iterator[None]:
    """What is planned inside sends Arrow batches of about ``limit`` bytes (one row at least); the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint directory and read back.

    Cuts lineage like ``checkpoint()``, but columnar and compressed; what reads
    it later survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ------------------------------------------------------------------ text -> hashes (numpy, whole batches)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self._base = base
        self._p = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self._p) < n:
            step = np.uint64(pow(self._base, len(self._p), 1 << 64))
            self._p = np.concatenate([self._p, self._p * step])
        return self._p[:n]


POWERS, INVERSE = Powers(_BASE), Powers(pow(_BASE, -1, 1 << 64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``h[i]`` = polynomial hash of ``data[:i]`` modulo 2**64 (length n + 1).

    The hash of ``data[s:e]`` is ``(h[e] - h[s]) * base**-s``.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.upto(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans ``[start, end)`` from their prefix hashes."""
    return mix((prefix[end] - prefix[start]) * INVERSE.upto(len(prefix))[start] + _MULT * (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def concat_text(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, part: int = 256 << 10) -> np.ndarray:
    """Hashes of the words, taken in parts of about ``part`` bytes (the prefixes, and the powers that a worker keeps, take eight to sixteen times that)."""
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + part, "right")))
        first = start[lo]
        out[lo:hi] = span_hashes(prefix_hashes(data[first:end[hi - 1]]), start[lo:hi] - first, end[lo:hi] - first)
        lo = hi
    return out


def shingle_rows(data: np.ndarray, offsets: np.ndarray, n: int = 5, part: int = 512 << 10) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingle hashes of every row: (row of each shingle, hash), sorted by row and hash.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased.  A
    row with fewer than ``n`` words gives its whole word sequence as one
    shingle, a row without words none.  The rows are taken in parts of about
    ``part`` bytes (one row at least), as the work takes about twenty times a part.
    """
    row, shingle = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + part, "right")) - 1)
        r, s = _shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], n)
        row.append(r + lo)
        shingle.append(s)
        lo = hi
    return np.concatenate(row), np.concatenate(shingle)


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = _word_hashes(data, start, end)
    first = np.searchsorted(start, offsets)  # first word of each row
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    length = np.minimum(count, n)
    seq = np.zeros(len(words), np.uint64)
    in_row = np.arange(len(words)) - np.repeat(first[:-1], count)
    starts_shingle = in_row <= np.repeat(count - length, count)
    for k in range(n):
        has = np.flatnonzero(starts_shingle & (k < np.repeat(length, count)))
        seq[has] = mix(seq[has] * np.uint64(0xD6E8FEB86659FD93) + words[has + k] + np.uint64(k + 1))
    row, seq = row[starts_shingle], seq[starts_shingle]
    order = np.lexsort((seq, row))
    row, seq = row[order], seq[order]
    new = np.ones(len(seq), bool)
    new[1:] = (seq[1:] != seq[:-1]) | (row[1:] != row[:-1])
    return row[new], seq[new]


def batches_of_bytes(batches: Iterator, text: str, limit: int = 4 << 20) -> Iterator:
    """The same rows in batches of about ``limit`` text bytes (one row at least)."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
    release_memory()


def release_memory() -> None:
    """Free memory of the Python worker goes back to the system, as the next task's worker is the same (no effect where the C library can't)."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
