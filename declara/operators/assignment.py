"""Documents against centroids: the nearest one, fuzzy memberships, mixtures of them.

A prepared model lies in the tasks as broadcast variables of a checked size, cut into pieces of
neighbouring centroids. Every document carries a running best (and, for memberships, a running sum)
through the pieces, so no table or array of documents x clusters exists, and only the answer
leaves a task. A piece with pivot p and radius r is passed over where the triangle inequality, distance
to p less r, already exceeds the best distance. Answers name clusters by their numbers, which may have gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.runtime import MODEL_BLOCK_VALUES, stage

PIECE = 256  # centroids compared together
ROWS = 4096  # documents compared together
DENSE = 4_000_000  # memberships held at once where all of them are mixed


class Piece(NamedTuple):
    centres: np.ndarray
    codes: np.ndarray
    numbers: np.ndarray  # ascending
    places: np.ndarray  # of these clusters in the order of all numbers
    pivot: np.ndarray
    radius: float


@dataclass
class Model:
    """Centroids ready for the tasks. ``numbers`` holds the cluster numbers in order."""

    numbers: np.ndarray
    shared: list  # broadcast lists of pieces

    def pieces(self) -> Iterator[Piece]:
        for block in self.shared:
            yield from block.value

    def release(self) -> None:
        for block in self.shared:
            block.unpersist()


def _leaves(centres: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Halves along the widest coordinate until a piece is small."""
    if len(at) <= PIECE:
        yield np.sort(at)
        return
    if centres.shape[1]:
        at = at[np.argsort(centres[at, centres[at].var(axis=0).argmax()], kind="stable")]
    yield from _leaves(centres, at[: len(at) // 2])
    yield from _leaves(centres, at[len(at) // 2 :])


def cut(centres: np.ndarray, codes: np.ndarray, numbers: np.ndarray, first: int = 0) -> list[Piece]:
    """Pieces of a block whose clusters come in ascending order, ``first`` of the model before it."""
    out = []
    for at in _leaves(centres, np.arange(len(centres))):
        if len(at):
            pivot = centres[at].mean(axis=0)
            radius = float(np.sqrt(((centres[at] - pivot) ** 2).sum(axis=1)).max())
            out.append(Piece(centres[at], codes[at], numbers[at], at + first, pivot, radius))
    return out


def arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.array([num for num, _ in rows], dtype=float).reshape(len(rows), -1),
        np.array([cat or [] for _, cat in rows], dtype=np.int64).reshape(len(rows), -1),
    )


def prepared_rows(spark: SparkSession, rows: list[tuple]) -> Model:
    """A model of (cluster, num, cat) rows that the driver holds already."""
    rows = sorted(rows, key=lambda r: r[0])
    width = max([1, *(len(num) + len(cat or []) for _, num, cat in rows[:1])])
    step, shared = max(1, MODEL_BLOCK_VALUES // width), []
    numbers = np.array([r[0] for r in rows], dtype=np.int32)
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        block = cut(*arrays([r[1:] for r in some]), numbers[start : start + step], start)
        shared.append(spark.sparkContext.broadcast(block))
    return Model(numbers, shared)


def prepared(model: DataFrame | Model) -> Model:
    """The centroid table (cluster, num, cat) staged once and fetched block by block; the driver and a
    message never hold more than MODEL_BLOCK_VALUES numbers at a time. A prepared model passes through."""
    if isinstance(model, Model):
        return model
    spark = model.sparkSession
    table = stage(model.select("cluster", "num", "cat"))
    size = table.agg(
        F.max(F.size("num") + F.greatest(F.size("cat"), F.lit(0))).alias("d"), F.min("cluster").alias("first"), F.max("cluster").alias("last")
    ).first()
    step = max(1, MODEL_BLOCK_VALUES // max(1, size["d"] or 1))
    numbers, shared, done = [], [], 0
    for start in range(size["first"] or 0, (size["last"] if size["last"] is not None else -1) + 1, step):
        rows = table.where((F.col("cluster") >= start) & (F.col("cluster") < start + step)).orderBy("cluster").collect()
        if rows:
            mine = np.array([r["cluster"] for r in rows], dtype=np.int32)
            shared.append(spark.sparkContext.broadcast(cut(*arrays([(r["num"], r["cat"]) for r in rows]), mine, done)))
            numbers.append(mine)
            done += len(mine)
    return Model(np.concatenate(numbers) if numbers else np.empty(0, np.int32), shared)


# -- one batch ---------------------------------------------------------------------


def mixed(x: np.ndarray, codes: np.ndarray, piece: Piece, gamma: float) -> np.ndarray:
    """Squared Euclid plus ``gamma`` per differing category. Close pairs are taken from the differences
    themselves, so that a document on a centroid gets exactly 0."""
    c = piece.centres
    scale = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)
    d = scale - 2.0 * (x @ c.T)
    i, j = np.nonzero(d < 1e-6 * scale)
    d[i, j] = ((x[i] - c[j]) ** 2).sum(axis=1)
    np.maximum(d, 0.0, out=d)
    for a in range(piece.codes.shape[1]):
        d += gamma * (codes[:, a][:, None] != piece.codes[:, a])
    return d


def best(x: np.ndarray, codes: np.ndarray, pieces: list[Piece], gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and number of the nearest centroid, the lowest number on ties."""
    found, who = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int32).max, np.int32)
    if len(pieces) == 1:
        gaps = np.zeros((len(x), 1))
    else:
        away = np.stack([np.sqrt(((x - p.pivot) ** 2).sum(axis=1)) - p.radius for p in pieces], axis=1)
        gaps = np.maximum(away * (1 - 1e-9) - 1e-9, 0.0) ** 2
    for b in np.argsort(gaps.mean(axis=0), kind="stable") if len(x) else ():
        rows = np.flatnonzero(gaps[:, b] <= found)
        if len(rows):
            d = mixed(x[rows], codes[rows], pieces[b], gamma)
            at = d.argmin(axis=1)
            d, number = d[np.arange(len(rows)), at], pieces[b].numbers[at]
            closer = (d < found[rows]) | ((d == found[rows]) & (number < who[rows]))
            found[rows[closer]], who[rows[closer]] = d[closer], number[closer]
    return found, who


def members(x: np.ndarray, codes: np.ndarray, pieces: list[Piece], gamma: float, m: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the ``k`` largest memberships, best first, the lowest number on ties. Weights
    are 1 / sum_j (d / d_j)^(2 / (m - 1)), kept up as a sum over the pieces; zero distances share the whole weight."""
    power = 2.0 / (m - 1.0)
    n = len(x)
    least, total, zeros = np.full(n, np.inf), np.zeros(n), np.zeros(n)
    top_d, top_n = np.empty((n, 0)), np.empty((n, 0), np.int32)
    for piece in pieces:
        d = mixed(x, codes, piece, gamma)
        now = np.minimum(least, d.min(axis=1))
        zeros += (d == 0).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            grown = np.where(np.isfinite(least), total * (now / least) ** power, 0.0) + ((now[:, None] / d) ** power).sum(axis=1)
        total, least = np.where(now > 0, grown, 1.0), now
        top_d = np.concatenate([top_d, d], axis=1)
        top_n = np.concatenate([top_n, np.broadcast_to(piece.numbers, d.shape)], axis=1)
        if top_d.shape[1] > 2 * k:
            top_d, top_n = _smallest(top_d, top_n, k)
    top_d, top_n = _smallest(top_d, top_n, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = (least[:, None] / top_d) ** power / total[:, None]
    return top_n, np.where(zeros[:, None] > 0, (top_d == 0) / np.maximum(zeros, 1)[:, None], weight)


def _smallest(d: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((numbers, d), axis=-1)[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(numbers, order, axis=1)


# -- Arrow columns -------------------------------------------------------------------


def _matrix(column, width: int, dtype) -> np.ndarray:
    """Rows of a list column; zeros where it is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.zeros((len(column), width), dtype)
    if column.null_count < len(column):
        known = column.is_valid().to_numpy(zero_copy_only=False)
        rows[known] = column.flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)[:, :width]
    return rows


def _missing(column) -> pa.Array:
    """Rows without a vector, whose answer is null."""
    return pa.array(column.is_null().to_numpy(zero_copy_only=False))


def batches(num, cat, pieces: list[Piece], scale: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    x, codes = _matrix(num, pieces[0].centres.shape[1], float), _matrix(cat, pieces[0].codes.shape[1], np.int64)
    if scale:
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    for at in range(0, len(x), ROWS):
        yield x[at : at + ROWS], codes[at : at + ROWS]


def _joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind) for i, kind in enumerate(kinds)]


def nearest(num: Column, cat: Column, model: DataFrame | Model, gamma: float = 1.0, scale: bool = False) -> Column:
    """The nearest centroid (ties: lowest number) as ``(d, cluster)``; ``scale`` brings the documents to length 1 first."""
    model = prepared(model)
    if not len(model.numbers):
        return F.lit(None).cast("struct<d: double, cluster: int>")

    @F.arrow_udf("struct<d: double, cluster: int>")
    def choose(num: pa.Array, cat: pa.Array) -> pa.Array:
        pieces = list(model.pieces())
        d, who = _joined([best(x, codes, pieces, gamma) for x, codes in batches(num, cat, pieces, scale)], (float, np.int32))
        return pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(who, pa.int32())], names=["d", "cluster"], mask=_missing(num))

    return choose(num, cat)


def memberships(num: Column, cat: Column, model: DataFrame | Model, m: float = 2.0, gamma: float = 1.0, k: int | None = None) -> Column:
    """The ``k`` largest fuzzy memberships (all if None) as an array of ``(cluster, weight)``, best first."""
    model = prepared(model)
    if not len(model.numbers):
        return F.lit(None).cast("array<struct<cluster: int, weight: double>>")
    kept = min(k or len(model.numbers), len(model.numbers))

    @F.arrow_udf("array<struct<cluster: int, weight: double>>")
    def weigh(num: pa.Array, cat: pa.Array) -> pa.Array:
        pieces = list(model.pieces())
        parts = [members(x, codes, pieces, gamma, m, kept) for x, codes in batches(num, cat, pieces)]
        return _listed(*_joined(parts, (np.int32, float)), len(num), kept, _missing(num))

    return weigh(num, cat)


def _listed(numbers: np.ndarray, weights: np.ndarray, n: int, kept: int, missing: pa.Array) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array(numbers.ravel(), pa.int32()), pa.array(weights.ravel(), pa.float64())], names=["cluster", "weight"])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * kept + 1, kept, dtype=np.int32)), pairs, mask=missing)


def mixture(num: Column, cats: Column, priors: Column, model: DataFrame | Model, m: float = 2.0, gamma: float = 1.0, k: int = 100) -> Column:
    """Memberships of one vector under several category hypotheses, averaged by their priors: the ``k`` best clusters
    as ``(cluster, weight)``, scaled to sum 1. ``cats`` is an array of category arrays, ``priors`` their shares."""
    model = prepared(model)
    kept = min(k, len(model.numbers))

    @F.arrow_udf("array<struct<cluster: int, weight: double>>")
    def mix(num: pa.Array, cats: pa.Array, priors: pa.Array) -> pa.Array:
        pieces, k_all = list(model.pieces()), len(model.numbers)
        x = _matrix(num, pieces[0].centres.shape[1], float)
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(cats), 0).to_numpy(zero_copy_only=False)))
        codes = _matrix(cats.flatten(), pieces[0].codes.shape[1], np.int64)
        share = priors.flatten().to_numpy(zero_copy_only=False)
        numbers, weights = np.empty((len(x), kept), np.int32), np.empty((len(x), kept))
        first = 0
        while first < len(x):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + DENSE // k_all, side="right")) - 1)
            last = min(last, len(x))
            mine = slice(ends[first], ends[last])
            row = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
            who, weight = members(x[row], codes[mine], pieces, gamma, m, k_all)
            dense = np.zeros((last - first, k_all))
            np.add.at(dense, ((row - first)[:, None], np.searchsorted(model.numbers, who)), weight * share[mine, None])
            order = np.argsort(-dense, axis=1, kind="stable")[:, :kept]
            top = np.take_along_axis(dense, order, axis=1)
            numbers[first:last], weights[first:last] = model.numbers[order], top / np.maximum(top.sum(axis=1, keepdims=True), 1e-300)
            first = last
        return _listed(numbers, weights, len(x), kept, _missing(num))

    return mix(num, cats, priors)


def distances(num: Column, cat: Column, model: DataFrame | Model, gamma: float = 1.0) -> Column:
    """Distances of a document to all centroids, in the order of the cluster numbers: for tables that ask for every pair."""
    model = prepared(model)

    @F.arrow_udf("array<double>")
    def score(num: pa.Array, cat: pa.Array) -> pa.Array:
        pieces, k = list(model.pieces()), len(model.numbers)
        found = []
        for x, codes in batches(num, cat, pieces):
            d = np.empty((len(x), k))
            for piece in pieces:
                d[:, piece.places] = mixed(x, codes, piece, gamma)
            found.append(d)
        flat = np.concatenate(found).ravel() if found else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(num) * k + 1, k, dtype=np.int32)), pa.array(flat), mask=_missing(num))

    return score(num, cat)


def numbered(distances: Column, model: Model) -> Column:
    """An array in the order of the cluster numbers as ``(cluster, d)`` pairs."""
    return F.zip_with(F.lit(model.numbers.tolist()), distances, lambda c, d: F.struct(c.cast("int").alias("cluster"), d.alias("d")))


def cosines(num: Column, model: DataFrame | Model) -> Column:
    """Cosines of a vector with all centroids, in the order of the cluster numbers; null with a zero vector."""
    model = prepared(model)

    @F.arrow_udf("array<double>")
    def score(num: pa.Array) -> pa.Array:
        pieces, k = list(model.pieces()), len(model.numbers)
        x = _matrix(num, pieces[0].centres.shape[1], float)
        out = np.empty((len(x), k))
        for piece in pieces:
            size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((piece.centres**2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[:, piece.places] = np.where(size > 0, (x @ piece.centres.T) / size, np.nan)
        flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)), flat, mask=_missing(num))

    return score(num)


def worst_overlap(num: Column, spread: Column, cluster: Column, model: Model, spreads: np.ndarray) -> Column:
    """Largest (spread + spread of another cluster) / distance of the centres over all other clusters. ``spreads`` comes in the order
    of the cluster numbers; only the extreme leaves a task."""

    @F.arrow_udf("double")
    def worst(num: pa.Array, spread: pa.Array, cluster: pa.Array) -> pa.Array:
        pieces = list(model.pieces())
        x = _matrix(num, pieces[0].centres.shape[1], float)
        own, name, best = spread.to_numpy(zero_copy_only=False), cluster.to_numpy(zero_copy_only=False), np.full(len(x), -np.inf)
        none = np.zeros((len(x), piece_width(pieces)), np.int64)
        for piece in pieces:
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (own[:, None] + spreads[piece.places]) / np.sqrt(mixed(x, none, piece, 0.0))
            ratio[name[:, None] == piece.numbers] = -np.inf
            best = np.maximum(best, ratio.max(axis=1))
        return pa.array(best, mask=~np.isfinite(best))

    return worst(num, spread, cluster)


def silhouette(num: Column, cluster: Column, model: Model, sizes: np.ndarray, squares: np.ndarray) -> Column:
    """Silhouette of a document by mean squared distances: to a cluster it is the squared distance of the centre plus the
    cluster's mean square less the centre's. ``sizes`` and ``squares`` come in the order of the cluster numbers."""

    @F.arrow_udf("double")
    def score(num: pa.Array, cluster: pa.Array) -> pa.Array:
        pieces = list(model.pieces())
        x, name = _matrix(num, pieces[0].centres.shape[1], float), cluster.to_numpy(zero_copy_only=False)
        none = np.zeros((len(x), piece_width(pieces)), np.int64)
        own, other, alone = np.zeros(len(x)), np.full(len(x), np.inf), np.zeros(len(x), bool)
        for piece in pieces:
            n = sizes[piece.places]
            d = mixed(x, none, piece, 0.0) + squares[piece.places] - (piece.centres**2).sum(axis=1)
            i, j = np.nonzero(name[:, None] == piece.numbers)
            own[i], alone[i] = d[i, j] * n[j] / np.maximum(n[j] - 1, 1), n[j] == 1
            d[i, j] = np.inf
            other = np.minimum(other, d.min(axis=1))
        most = np.maximum(own, other)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(alone | ~np.isfinite(other) | (most <= 0), 0.0, (other - own) / most)
        return pa.array(s, mask=num.is_null().to_numpy(zero_copy_only=False))

    return score(num, cluster)


def piece_width(pieces: list[Piece]) -> int:
    return pieces[0].codes.shape[1]
