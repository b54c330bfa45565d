"""Exact k-means in whole numbers behind a PCA-rotated filter.

Components become integers, floor(scale * x), and all results are integer arithmetic. One pass sums
the moments of all vectors; the eigenvectors of their covariance rotate the space, and every vector
is stored with its leading rotated coordinates and the norm of the rest. For a vector x and a
centroid c, the squared distance of the leading coordinates plus the squared difference of the two
rest norms is never more than the squared distance of x and c. A centroid whose bound, less the
rounding error of doubles, lies above a distance already found is passed over; the survivors are
compared in integers. The rotation changes the work, never the result.

Each round is one pass: tasks hand on one sum per cluster and component, so neither a large cluster
nor a third of all rows holding one vector makes a hot task. The driver sees clusters x components
numbers, both parameters.

Defined results: a vector is kept if it has exactly ``dims`` components, none null, NaN or infinite;
others have no row. Repeated rows count and come out as often as they come in. Ties of distance go to the smaller
cluster number, ties of the starting order (repeated or null ids; null is spelled ``null``) to the smaller
vector. With fewer vectors than clusters there are as many clusters as vectors, with none no row.
Integers beyond ``NARROW`` are computed without the filter in Python's whole numbers; a distance or
inertia that does not fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.llm.common import batch
from declara.runtime import stage

NARROW = 1 << 27  # components below it keep every squared distance of 64 components inside 64 bits
LIMB = 60  # totals beyond 64 bits travel as limbs of so many bits
LONGEST = (1 << 63) - 1
BLOCK = 1 << 21  # bounds computed together: rows x centroids


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column: int64, or Python's whole numbers where one is wide."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    whole = np.floor(values * scale)
    if whole.size == 0 or np.abs(whole).max() < NARROW:
        return whole.astype(np.int64)
    exact = [int(x // 1) * scale if abs(x) >= 2**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


@dataclass
class Rotation:
    """Coordinates that keep most of the spread in front."""

    mean: np.ndarray
    axes: np.ndarray  # dims x leading, orthonormal columns

    def turn(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest, row by row."""
        centred = whole.astype(np.float64) - self.mean
        lead = centred @ self.axes
        return lead, np.sqrt(np.maximum((centred**2).sum(axis=1) - (lead**2).sum(axis=1), 0))


def squared(whole: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((whole - centroid) ** 2).sum(axis=1)


def nearest(whole: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row, the smaller number on ties, and the exact squared distance."""
    if whole.dtype == object or centroids.dtype == object:
        each = [squared(whole.astype(object), c) for c in centroids.astype(object)]
        at = [min(range(len(each)), key=lambda j: (each[j][i], j)) for i in range(len(whole))]
        return np.array(at, np.int64), np.array([each[j][i] for i, j in enumerate(at)], dtype=object)
    c_lead, c_rest = rotation.turn(centroids)
    size, c_size = (lead**2).sum(axis=1), (c_lead**2).sum(axis=1)
    at, best = np.empty(len(whole), np.int64), np.empty(len(whole), np.int64)
    step = max(1, BLOCK // len(centroids))
    for start in range(0, len(whole), step):
        rows = slice(start, start + step)
        bound = size[rows, None] + c_size - 2 * (lead[rows] @ c_lead.T) + (rest[rows, None] - c_rest) ** 2
        bound -= 1e-9 * (size[rows, None] + rest[rows, None] ** 2 + c_size + c_rest**2) + 1e-6
        near = bound.argmin(axis=1)
        found = ((whole[rows] - centroids[near]) ** 2).sum(axis=1)
        for j, centroid in enumerate(centroids):
            left = np.flatnonzero((bound[:, j] <= found) & (near != j))
            if len(left):
                distance = squared(whole[rows][left], centroid)
                closer = (distance < found[left]) | ((distance == found[left]) & (j < near[left]))
                near[left[closer]], found[left[closer]] = j, distance[closer]
        at[rows], best[rows] = near, found
    return at, best


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """A whole number as (place, limb), one limb as long as it fits a long."""
    place = 0
    while not -(1 << 62) < total < 1 << 62:
        yield place, total & (1 << LIMB) - 1
        total >>= LIMB
        place += 1
    yield place, total


def _kept(vectors: DataFrame, dims: int) -> DataFrame:
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("id", "vector").where((F.size("vector") == dims) & fine)


def _rotation(kept: DataFrame, dims: int, scale: int, leading: int) -> Rotation:
    """Axes from the first and second moments of all vectors, summed per task and place."""
    schema = pa.schema([("place", pa.int32()), ("total", pa.float64())])

    def moments(batches):
        total = np.zeros((dims + 1, dims + 1))
        for b in batches:
            whole = integers(b.column(0), dims, scale).astype(np.float64)
            rows = np.hstack([np.clip(whole, -1e15, 1e15), np.ones((len(whole), 1))])
            total += rows.T @ rows
        if total[dims, dims]:
            yield batch(schema, np.arange(total.size, dtype=np.int32), total.ravel())

    found = kept.select("vector").mapInArrow(moments, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    total = np.zeros((dims + 1) ** 2)
    for r in found.collect():  # (dims + 1) squared numbers
        total[r.place] = r.total
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[dims, dims], 1.0)
    mean = total[dims, :dims] / n
    _, axes = np.linalg.eigh(total[:dims, :dims] / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :leading]))


@dataclass
class Clustering:
    rows: DataFrame  # id, cluster, distance
    centroids: list[list[int]]

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[cluster])).encode()).hexdigest()


def _array(centroids: list[list[int]]) -> np.ndarray:
    narrow = all(-NARROW < v < NARROW for c in centroids for v in c)
    return np.array(centroids, dtype=np.int64 if narrow else object)


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", leading: int = 16) -> Clustering:
    """Cluster ``vectors`` (id, vector). The start is the ``clusters`` vectors of least SHA-256 of ``seed:id``."""
    kept = _kept(vectors, dims)
    ids = kept.schema["id"].dataType.simpleString()
    kind = kept.schema["vector"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = kept.select("vector", order.alias("h")).orderBy("h", "vector").limit(clusters).collect()
    if not first:
        return Clustering(kept.sparkSession.createDataFrame([], f"id {ids}, cluster int, distance long"), [])
    centroids = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dims, scale).tolist()
    rotation = _rotation(kept, dims, scale, leading)

    def rotate(batches):
        for b in batches:
            lead, rest = rotation.turn(integers(b.column(1), dims, scale))
            width = lead.shape[1]
            rotated = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, width, dtype=np.int32)), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rotated, pa.array(rest)], names=["id", "vector", "lead", "rest"])

    coded = stage(kept.mapInArrow(rotate, f"id {ids}, vector {kind}, lead array<double>, rest double"))

    def assigned(b, model):
        whole = integers(b.column(1), dims, scale)
        lead = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)
        return whole, *nearest(whole, lead, b.column(3).to_numpy(), model, rotation)

    for _ in range(rounds):
        model = _array(centroids)

        def sums(batches, model=model):
            total: dict[tuple[int, int], int] = {}
            for b in batches:
                whole, at, _ = assigned(b, model)
                for j in np.unique(at).tolist():
                    mine = whole[at == j]
                    for place, v in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                        total[j, place] = total.get((j, place), 0) + v
            rows = [(j, place, limb, v) for (j, place), t in total.items() for limb, v in limbs(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                                 names=["cluster", "place", "limb", "total"])

        found = coded.mapInArrow(sums, "cluster int, place int, limb int, total long").groupBy("cluster", "place", "limb")
        totals: dict[tuple[int, int], int] = {}
        for r in found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # clusters x components
            totals[r.cluster, r.place] = totals.get((r.cluster, r.place), 0) + (int(r.total) << LIMB * r.limb)
        centroids = [
            [totals[j, place] // totals[j, dims] for place in range(dims)] if (j, dims) in totals else old
            for j, old in enumerate(centroids)
        ]
    model = _array(centroids)

    def assign(batches):
        for b in batches:
            _, at, distance = assigned(b, model)
            if distance.dtype == object:
                distance = [d if d <= LONGEST else None for d in distance]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return Clustering(stage(coded.mapInArrow(assign, f"id {ids}, cluster int, distance long")), centroids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = cluster(vectors)
    per = found.rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count("*").alias("n"), F.count("distance").alias("known")
    ).collect()  # a row per cluster
    inertia = {r.cluster: int(r.inertia) if r.n == r.known else None for r in per}
    whole = sum(inertia.values()) if None not in inertia.values() else None
    fits = lambda v: v if v is not None and v <= LONGEST else None
    table = spark.createDataFrame(
        [(j, fits(v), fits(whole), found.digest(j)) for j, v in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.rows.join(F.broadcast(table), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql(clusters: int = 40, rounds: int = 5) -> str:
    """The same steps as plain relations: every distance is computed."""
    parts = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id,
            [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
          WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "x AS MATERIALIZED (SELECT r, unnest(e) AS v, generate_subscripts(e, 1) AS p FROM kept)",
        f"""first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept
          QUALIFY c < {clusters})""",
        "c0 AS MATERIALIZED (SELECT c, p, v FROM first JOIN x USING (r))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT r, c, sum((x.v - c{i}.v) * (x.v - c{i}.v)) AS d FROM x JOIN c{i} USING (p) GROUP BY r, c)""")
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, c, CAST(d AS BIGINT) AS d FROM d{i}
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, p)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.p, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v
          FROM c{i} LEFT JOIN s{i} ON c{i}.c = s{i}.c AND c{i}.p = s{i}.p)""")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
          CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)"""


SQL = _sql()
