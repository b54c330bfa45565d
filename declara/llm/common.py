"""Helpers shared by the operators: Arrow access to texts, 64-bit hashes, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side of a join is broadcast only when a count shows that it has at most this many rows of
# a few numbers each (some 32 MB); beyond it Spark shuffles both sides, with the same result.
BROADCAST_ROWS = 1_000_000

# Working columns carry this prefix, so that extra columns of the input cannot clash with them.
OWN = "__llm_"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow table whose counted size allows it. The count stops early."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def utf8(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of every text as a view of the Arrow buffer; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()
    if len(column) == 0:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield None if null is not None and null[i] else raw[at[i] : at[i + 1]]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit factors."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_FACTORS = odd(256, 1)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """One 64-bit hash for every word (run of bytes other than white space), A-Z lower-cased."""
    global _FACTORS
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    length = edges[1::2] - edges[::2]
    if (longest := int(length.max())) > len(_FACTORS):
        _FACTORS = odd(2 * longest, 1)
    first = np.cumsum(length) - length
    codes = _LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(codes)) - np.repeat(first, length)
    return mix(np.add.reduceat(codes * _FACTORS[place], first) + length.astype(np.uint64))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; fewer words are one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    factors = odd(width, 100 + width)
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * factors[i]
    return np.unique(mix(total))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )
