"""Text columns inside Arrow batches: bounded slices, raw UTF-8, words as numpy hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the size of one Arrow batch, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def fold(column: str) -> Column:
    """crc32 of an id's decimal text, from which train and held-out parts are taken."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def carried(df: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, int, str]:
    """``keep`` columns and the text, once, so that no others travel; the text's place; the schema of ``keep``."""
    out = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`").alias("__text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:len(keep)])
    return out, keep.index(text) if text in keep else len(keep), schema


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def give_back() -> None:
    """Return freed memory to the system: workers live on, and an executor's bound counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_KEPT: dict[str, tuple[object, object]] = {}


def kept(owner: str, key, make: Callable[[], object]):
    """What this worker keeps for ``owner`` from task to task, made anew for another ``key``.

    What it kept for other owners goes: workers live on from step to step, and an executor's bound counts all they hold.
    """
    if owner not in _KEPT or _KEPT[owner][0] != key:
        _KEPT.clear()
        _KEPT[owner] = key, make()
    return _KEPT[owner][1]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``limit`` text bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each text begins; null is empty."""
    column = pc.fill_null(column, "")
    wide = column.type == pa.large_string()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    up, down = (np.cumprod(np.concatenate([one, np.full(n, f, np.uint64)]), dtype=np.uint64) for f in (BASE, inverse))
    return up, down


_CACHE: dict[str, np.ndarray] = {}
POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them; a worker keeps ``POWERS`` of each at most."""
    if n > POWERS:
        return _powers(n)
    if len(_CACHE.get("up", ())) < n + 1:
        _CACHE["up"], _CACHE["down"] = _powers(max(n, 1 << 16))
    return _CACHE["up"][:n + 1], _CACHE["down"][:n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash may serve as a bucket."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes, equal for equal bytes wherever they stand.

    The hash is h(s, e) = sum of (byte + 1) * BASE**(position - s); prefix sums give all spans
    at once. Arrays stay as long as the data, so callers pass bounded slices; a longer text
    is split into rows of at most 2**22 bytes for the sums only.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mixed(h ^ ((ends - starts).astype(np.uint64) * MULTIPLIER))


#: ASCII letters lower-cased; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters, and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text + total)."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = WORD[low]
    # a word ends where its text ends
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets[1:-1]] = True
    begin = inside[1:] & (~inside[:-1] | cut)
    end = inside[:-1] & (~inside[1:] | cut)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    first = np.searchsorted(starts, offsets)
    return low, starts, ends, first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within each text, and where each text's begin.

    A text with fewer than k words, but not none, has one shingle: all its words.
    """
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out[:len(h) - j] = out[:len(h) - j] * np.uint64(0xD6E8FEB86659FD93) + h[j:]
    keep = np.ones(len(h), bool)
    last = np.repeat(first[1:], n)
    pos = np.arange(len(h))
    keep = pos + k <= last
    short = (n > 0) & (n < k)
    if short.any():
        at = first[:-1][short]
        keep[at] = True
        with np.errstate(over="ignore"):
            for i, m in zip(at, n[short]):
                value = np.uint64(1)
                for w in h[i:i + m]:
                    value = value * np.uint64(0xD6E8FEB86659FD93) + w
                out[i] = value
    count = np.where(short, 1, np.maximum(n - k + 1, 0))
    return mixed(out[keep]), np.concatenate([[0], np.cumsum(count)])
