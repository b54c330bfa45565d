"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor where its minimal inner s-mer (by hash) lies at its first or last
place. That depends on the k-mer alone, so an edit moves no anchor outside of the k-mers it
touches. A fingerprint lists all anchors of the text, each as ten hex digits of hash and eight of
place, ordered by place; it grows with the text. A text without any, such as one shorter than k, is
one anchor.

Likeness matches two fingerprints by position: the i-th anchor of a hash in one text is the i-th of
that hash in the other, and such pairs count where they come in the same order in both (longest
increasing subsequence); the share in the union of both is the likeness. Two empty texts are alike
(1), an empty and another one are not (0).

For its edited text every document needs the beginning of the next one. Documents are dealt into
ranges of doc_id and read in order; a range ends with a copy of the next range's first document.
Texts are shuffled once. Null ids come first, repeated ids in the order of their texts' hashes;
null texts are empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.llm.common import mix

K, S = 20, 8
BLOCK = 1 << 20
PENDING = 1 << 24  # characters of fingerprints in an Arrow batch, about


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, from running minima of blocks of the window's width."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    factors, n = mix(_powers(width)) | np.uint64(1), len(codes) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += codes[i : i + n] * factors[i]
    return mix(total)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all closed syncmers, block by block."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, places = _syncmers(text, k, s) if len(text) >= k else ((), ())
    if not len(hashes):
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.array([int.from_bytes(digest, "little") >> 24], np.uint64), np.zeros(1, np.int64)
    return hashes, places


def _syncmers(text: str, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, places = [], []
    for start in range(0, len(text) - k + 1, BLOCK):
        codes = np.frombuffer(text[start : start + BLOCK + k - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        inner = _rolling(codes, s)
        least = _slide_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s : k - s + len(least)] == least))
        # the hash of a chosen k-mer from s-mers that cover it
        h = np.zeros(len(at), np.uint64)
        for i, place in enumerate((*range(0, k - s, s), k - s)):
            h = mix(h + inner[at + place] * np.uint64(2 * i + 3))
        hashes.append(h >> np.uint64(24))
        places.append(at + start)
    return np.concatenate(hashes), np.concatenate(places)


def sketch(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all anchors, by place."""
    return anchors(text, k, s)


def as_text(found: tuple[np.ndarray, np.ndarray]) -> str:
    digits = np.empty((len(found[0]), 9), np.uint8)
    digits[:, :5] = found[0].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    digits[:, 5:] = (found[1] & 0xFFFFFFFF).astype(">u4").view(np.uint8).reshape(-1, 4)
    return digits.tobytes().hex()


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Distinct keys: every code with the number of its equals before it."""
    order = np.argsort(codes, kind="stable")
    fresh = np.diff(codes[order], prepend=-1) != 0
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
    before = np.empty(len(codes), np.int64)
    before[order] = np.arange(len(codes)) - first
    return (codes << 32) + before


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    left, right = a[0], b[0]
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    n = min(len(left), len(right))
    differ = np.flatnonzero(left[:n] != right[:n])
    same = int(differ[0]) if len(differ) else n  # equal beginnings match as they are
    codes = np.unique(np.concatenate((left[same:], right[same:])), return_inverse=True)[1].astype(np.int64).ravel()
    cut = len(left) - same
    _, at, to = np.intersect1d(_numbered(codes[:cut]), _numbered(codes[cut:]), assume_unique=True, return_indices=True)
    tails: list[int] = []
    for p in to[np.argsort(at)].tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return (same + len(tails)) / (len(left) + len(right) - same - len(to))


def ranges(documents: DataFrame, rows_per_range: int) -> list:
    """Bounds of doc_id between ranges of about that many rows; from the ids alone."""
    n = documents.count()
    cuts = min(n // rows_per_range, 100_000)
    if not cuts:
        return []
    found = documents.select(F.percentile_approx("id", F.lit([(i + 1) / (cuts + 1) for i in range(cuts)]), F.lit(10_000)).alias("c")).first().c
    return sorted(set(found or []))


def fingerprints(documents: DataFrame, rows_per_range: int = 4096, k: int = K, s: int = S) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    ``documents`` (id long, text)."""
    bounds = ranges(documents, rows_per_range)
    rows = documents.select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", F.coalesce(_range_of(bounds), F.lit(0))).withColumn("tie", F.xxhash64("text")).withColumn("ghost", F.lit(0))
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("set"), "id", "tie")).alias("first"))
    firsts = sorted(firsts.collect(), key=lambda r: r.range)  # a row per range
    if not firsts:
        return documents.limit(0).select(
            "id", *(F.lit(None).cast(kind).alias(name) for name, kind in _COLUMNS)
        )
    follow = [(firsts[(i + 1) % len(firsts)].first.id, firsts[(i + 1) % len(firsts)].first.tie, r.range) for i, r in enumerate(firsts)]
    follow = documents.sparkSession.createDataFrame(follow, "next_id long, next_tie long, of int")
    hint = F.broadcast(follow)  # as many rows as ranges
    ghosts = rows.join(hint, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("tie") == F.col("next_tie")))
    ghosts = ghosts.groupBy("of").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    ghosts = ghosts.select("id", "text", F.col("of").alias("range"), F.lit(0).cast("long").alias("tie"), F.lit(1).alias("ghost"))
    dealt = rows.unionByName(ghosts).repartition(len(firsts), "range").sortWithinPartitions("range", "ghost", F.col("id").asc_nulls_first(), "tie")

    def scan(batches):
        held = None  # the row that waits for its next one
        for b in batches:
            out, pending = [], 0
            for range_, ghost, id_, text in zip(*(b.column(c).to_pylist() for c in ("range", "ghost", "id", "text"))):
                own = sketch(text, k, s)
                if held is not None:
                    out.append(_row(*held, text, own, k, s))
                    pending += len(out[-1][3]) + len(out[-1][4])
                held = None if ghost else (id_, text, own)
                if pending >= PENDING:
                    yield _batch(out)
                    out, pending = [], 0
            if out:
                yield _batch(out)

    return dealt.mapInArrow(scan, "id long, " + ", ".join(f"{name} {kind}" for name, kind in _COLUMNS))


_COLUMNS = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW)], names=["id", *(name for name, _ in _COLUMNS)])


def _range_of(bounds: list):
    """The number of bounds not above the id."""
    limits = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        found = np.zeros(len(ids), np.int32)
        found[known] = np.searchsorted(limits, ids[known].to_numpy(dtype=np.int64), "right")
        return pd.Series(found)

    return place(F.col("id")) if bounds else F.lit(0)


def _row(id_, text, own, following, next_own, k, s):
    cut = len(text) // 4
    edited = text[: len(text) - cut] + following[:cut]
    changed = sketch(edited, k, s) if edited != text else own
    return (
        id_, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed),
        likeness(own, changed), likeness(own, next_own),
    )


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), "text")
    return fingerprints(documents).withColumnRenamed("id", "doc_id")
