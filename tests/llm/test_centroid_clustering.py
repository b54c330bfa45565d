"""Centroid clustering against plain integer k-means, and odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from declara.llm import centroid_clustering as cc


def plain(rows, clusters, rounds, scale):
    """Every distance, in Python's whole numbers. rows: (id, vector)."""
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [v for _, v in start]

    def assign():
        out = []
        for i, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, min(range(len(d)), key=lambda j: (d[j], j)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, k, _) in zip(rows, found) if k == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    return assign(), centroids


def run(spark, rows, **options):
    found = cc.cluster(spark.createDataFrame(rows, "id long, vector array<double>"), **options)
    return sorted((r.id, r.cluster, r.distance) for r in found.rows.collect()), found.centroids


@pytest.mark.parametrize("spread", [1.0, 0.02])  # the second has many ties
def test_equals_plain_k_means(spark, spread):
    draw = random.Random(int(spread * 100))
    rows = [(i, [draw.gauss(0, spread * 3 / (p + 1)) for p in range(8)]) for i in range(400)]
    options = {"clusters": 12, "rounds": 4, "scale": 16}
    assigned, centroids = plain(rows, **options)
    found, where = run(spark, rows, dims=8, leading=3, **options)
    assert where == centroids and found == sorted(assigned)


def test_bound_never_passes_over_the_nearest():
    draw = np.random.default_rng(5)
    whole = draw.integers(-300, 300, (3000, 64))
    centroids = whole[:50] + draw.integers(-2, 3, (50, 64))
    axes, _ = np.linalg.qr(draw.normal(size=(64, 64)))
    rotation = cc.Rotation(whole.mean(axis=0), axes[:, :16])
    at, best = cc.nearest(whole, *rotation.turn(whole), centroids, rotation)
    each = ((whole[:, None] - centroids) ** 2).sum(axis=2)
    assert (at == each.argmin(axis=1)).all() and (best == each.min(axis=1)).all()


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, 5.0]), (None, [0.1, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]),
        (7, [1.0, -inf]), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 0.0]),
    ]
    kept = [(i if i is not None else "null", v) for i, v in rows if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    for clusters in (2, 40):
        assigned, centroids = plain(kept, clusters, 5, 256)
        found, where = cc_rows(spark, rows, clusters)
        assert where == centroids
        assert found == sorted(((i if i != "null" else -1, c, d) for i, c, d in assigned))


def cc_rows(spark, rows, clusters):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<float>, cluster string, lead int")
    frame = frame.withColumn("vector", frame.vector.cast("array<double>"))
    found = cc.cluster(frame, clusters=clusters, dims=2, leading=1)
    return sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in found.rows.collect()), found.centroids


def test_wide_components_stay_exact(spark):
    rows = [(i, [1e30 * (i % 3), float(i)]) for i in range(9)] + [(9, [3e8, 0.5]), (10, [3e8, 0.25])]
    assigned, centroids = plain(rows, 3, 3, 256)
    found, where = run(spark, rows, clusters=3, rounds=3, dims=2, leading=1)
    assert where == centroids
    assert found == sorted((i, c, d if d < 1 << 63 else None) for i, c, d in assigned)


def test_no_vectors(spark):
    assert run(spark, [], dims=2) == ([], [])
    assert run(spark, [(1, [1.0])], dims=2) == ([], [])


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = cc.query(spark, str(tmp_path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0
