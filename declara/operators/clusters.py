"""Mixed numeric/categorical clustering: distances, k-prototypes, memberships, scores.

A document is ``(row, num array<double>, cat array<bigint>)``, a model is
``(cluster, num, cat)`` with clusters numbered from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declara.functions import vectors as V
from declara.operators import assignment
from declara.operators.aggregations import counts
from declara.operators.assignment import Model, best, distances, members, memberships, mixture, nearest, numbered, prepared, prepared_rows  # noqa: F401
from declara.runtime import new_path, remove, stage


def no_categories() -> Column:
    return F.array().cast("array<bigint>")


# -- centroids ----------------------------------------------------------------


def numeric_centres(df: DataFrame, cluster: str, num: str) -> DataFrame:
    """Mean vector and size per cluster. Vectors are summed map-side, never exploded."""
    summary = Summarizer.metrics("mean", "count").summary(array_to_vector(F.col(num)))
    return df.groupBy(cluster).agg(summary.alias("s")).select(
        F.col(cluster).alias("cluster"), vector_to_array(F.col("s.mean")).alias("num"), F.col("s.count").alias("n")
    )


def categorical_modes(df: DataFrame, cluster: str, cat: str) -> DataFrame:
    """Most frequent code of every attribute per cluster (ties: lowest code), as an array."""
    cells = df.select(F.col(cluster).alias("cluster"), F.posexplode(cat).alias("a", "code"))
    counted = counts(cells, ["cluster", "a", "code"])
    modes = counted.groupBy("cluster", "a").agg(F.max_by("code", F.struct(F.col("n"), -F.col("code"))).alias("code"))
    return modes.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("a", "code"))), lambda s: s["code"]).alias("cat")
    )


def centroid_table(df: DataFrame, cluster: str, num: str, cat: str | None = None) -> DataFrame:
    centres = numeric_centres(df, cluster, num)
    if cat is None:
        return centres.select("cluster", "num", no_categories().alias("cat"), "n")
    modes = categorical_modes(df, cluster, cat)
    return centres.join(modes, "cluster", "left").select(
        "cluster", "num", F.coalesce("cat", no_categories()).alias("cat"), "n"
    )


def initial_prototypes(df: DataFrame, row: str, family: str, n_clusters: int, seed: int = 0) -> DataFrame:
    """One pseudo-random row for each of the n/2 most frequent families and for n - n/2
    families drawn from the rest."""
    picked = df.groupBy(family).agg(
        F.count("*").alias("_n"), F.min_by(F.struct("num", "cat"), F.xxhash64(F.lit(seed), row)).alias("_r")
    )
    families = picked.count()
    if n_clusters > families:
        raise ValueError(f"{n_clusters} clusters asked, {families} families found")
    frequent = picked.orderBy(F.col("_n").desc(), family).limit(n_clusters // 2)
    rest = picked.join(frequent.select(family), family, "left_anti")
    drawn = rest.orderBy(F.xxhash64(F.lit(seed), family), family).limit(n_clusters - n_clusters // 2)
    chosen = frequent.unionByName(drawn)
    order = Window.orderBy(F.col("_n").desc(), family)  # n_clusters rows
    return chosen.select((F.row_number().over(order) - 1).cast("int").alias("cluster"), "_r.num", "_r.cat")


def _round(data: DataFrame, model: Model, gamma: float) -> tuple[dict, dict]:
    """One pass over the documents: (sum, size) and (mode of every attribute) of the nearest cluster's
    documents, added up inside each task before a row per cluster and category leaves it."""
    def collect(arrow):
        sums: dict[int, np.ndarray] = {}
        cells: dict[tuple[int, int, int], int] = {}
        pieces = list(model.pieces())
        for b in arrow:
            known = np.flatnonzero(b.column(0).is_valid().to_numpy(zero_copy_only=False))
            b = b.take(pa.array(known))
            for x, codes in assignment.batches(b.column(0), b.column(1), pieces):
                _, who = best(x, codes, pieces, gamma)
                for c in np.unique(who).tolist():
                    mine = who == c
                    part = np.append(x[mine].sum(axis=0), mine.sum())
                    sums[c] = sums[c] + part if c in sums else part
                    for a in range(codes.shape[1]):
                        for code, n in zip(*(u.tolist() for u in np.unique(codes[mine, a], return_counts=True))):
                            cells[c, a, code] = cells.get((c, a, code), 0) + n
        n = len(sums) + len(cells)
        if n:
            empty = [None] * len(cells)
            numbers = [*sums, *(c for c, _, _ in cells)]
            vectors = [v.tolist() for v in sums.values()] + empty
            blank = [None] * len(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers, pa.int32()), pa.array(vectors, pa.list_(pa.float64())), pa.array(blank + [a for _, a, _ in cells], pa.int32()),
                pa.array(blank + [code for _, _, code in cells], pa.int64()), pa.array(blank + list(cells.values()), pa.int64()),
            ], names=["cluster", "sums", "a", "code", "n"])

    spark, schema = data.sparkSession, "cluster int, sums array<double>, a int, code long, n long"
    path = new_path(spark, "round")
    data.select("num", "cat").mapInArrow(collect, schema).write.parquet(path)
    partial = spark.read.schema(schema).parquet(path)
    summed = partial.where(F.col("a").isNull()).groupBy("cluster").agg(vector_sum("sums").alias("sums")).collect()
    counted = partial.where(F.col("a").isNotNull()).groupBy("cluster", "a", "code").agg(F.sum("n").alias("n"))
    modes = counted.groupBy("cluster", "a").agg(F.max_by("code", F.struct(F.col("n"), -F.col("code"))).alias("code")).collect()
    remove(spark, path)
    return {r["cluster"]: r["sums"] for r in summed}, {(r["cluster"], r["a"]): r["code"] for r in modes}


def k_prototypes(
    df: DataFrame, row: str, family: str, n_clusters: int, gamma: float = 1.0, max_iter: int = 20, seed: int = 0
) -> DataFrame:
    """Lloyd iterations until no centroid moves; returns the centroid table.

    A round is one pass that scores every document once. A cluster that lost all its documents keeps its
    centroid. The centroids (n_clusters rows) are a parameter's worth of numbers in the driver.
    """
    spark = df.sparkSession
    data = df.select(F.col(row), F.col(family), V.doubles(F.col("num")).alias("num"), F.col("cat").cast("array<bigint>").alias("cat"))
    first = initial_prototypes(data, row, family, n_clusters, seed).orderBy("cluster").collect()
    centres = [(r["cluster"], list(r["num"]), list(r["cat"] or [])) for r in first]
    for _ in range(max_iter):
        model = prepared_rows(spark, centres)
        sums, modes = _round(data, model, gamma)
        model.release()
        moved, now = False, []
        for c, num, cat in centres:
            if c in sums:
                *total, n = sums[c]
                mean, mode = [s / n for s in total], [modes.get((c, a), code) for a, code in enumerate(cat)]
                moved |= mode != cat or not np.allclose(mean, num, rtol=1e-12, atol=1e-12)
                num, cat = mean, mode
            now.append((c, num, cat))
        if not moved:
            break
        centres = now
    return spark.createDataFrame(centres, "cluster int, num array<double>, cat array<bigint>")


# -- memberships ----------------------------------------------------------------


def with_memberships(
    df: DataFrame, model: DataFrame | Model, num: Column, cat: Column, m: float = 2.0, gamma: float = 1.0, k: int | None = None
) -> DataFrame:
    """Adds ``members``: the k largest fuzzy memberships (all if None) as (cluster, weight), best first."""
    return df.withColumn("members", memberships(num, cat, model, m, gamma, k))


def assign(df: DataFrame, model: DataFrame | Model, num: Column, cat: Column, m: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """Adds the nearest cluster, the cluster of largest membership and that membership. Memberships fall
    with the distance, so both clusters are the first of the one best membership that leaves a task."""
    found = df.withColumn("_m", memberships(num, cat, model, m, gamma, 1)[0])
    return found.select(
        *df.columns, F.col("_m.cluster").alias("hard_cluster"), F.col("_m.cluster").alias("soft_cluster"), F.col("_m.weight").alias("cluster_weight"),
    )


def novel(assigned: DataFrame, delta: float) -> DataFrame:
    """Documents no cluster claims: largest membership at most ``delta``."""
    return assigned.where(F.col("cluster_weight") <= delta)


def nearest_by_cosine(num: Column, model: DataFrame) -> Column:
    """Cluster of largest cosine: on unit vectors the squared distance is 2 - 2 cos, so the
    nearest unit centroid is the answer."""
    centres = model.select("cluster", V.unit(F.col("num")).alias("num"), "cat")
    return nearest(num, no_categories(), centres, 0.0, scale=True)["cluster"]


def centroid_pairs(model: DataFrame, kind: str = "mixed", gamma: float = 1.0) -> DataFrame:
    """Distance of every pair of centroids (k x k by definition): mixed, or cosine distance. The table is multiplied block by block."""
    table = stage(model.select("cluster", "num", "cat"))
    ready = prepared(table)
    if not len(ready.numbers):
        return table.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"), F.lit(0.0).alias("dist"))
    if kind == "cosine":
        row = F.transform(assignment.cosines(F.col("num"), ready), lambda c: 1 - c)
    else:
        row = distances(F.col("num"), F.col("cat"), ready, gamma)
    pairs = table.select(F.col("cluster").alias("a"), F.inline(numbered(row, ready)).alias("b", "dist"))
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("dist")).alias("dist"))


def extreme_pairs(pairs: DataFrame) -> DataFrame:
    """The furthest pairs and the closest non-zero pairs, ties included."""
    once = pairs.where(F.col("a") < F.col("b"))
    far = once.select(F.max("dist")).scalar()
    near = once.where(F.col("dist") > 0).select(F.min("dist")).scalar()
    return once.select(
        "a", "b", "dist", F.when(F.col("dist") == far, "furthest").when(F.col("dist") == near, "closest").alias("kind")
    ).where(F.col("kind").isNotNull())


def representative(df: DataFrame, row: str, cluster: str, num: str, centres: DataFrame) -> DataFrame:
    """Document most and least similar (cosine) to its cluster centre."""
    dim = stage(centres.select(F.col("cluster").alias("_c"), F.col("num").alias("_centre")))
    similar = df.join(dim, F.col(cluster) == F.col("_c")).select(
        F.col(cluster).alias("cluster"), row, V.cosine(F.col(num), F.col("_centre")).alias("sim")
    )
    return similar.groupBy("cluster").agg(
        F.max_by(row, F.struct(F.col("sim"), -F.col(row))).alias("most"), F.max("sim").alias("most_sim"),
        F.min_by(row, F.struct(F.col("sim"), F.col(row))).alias("least"), F.min("sim").alias("least_sim"),
    )


# -- scores ----------------------------------------------------------------------


def _moments(df: DataFrame, cluster: str, num: str) -> DataFrame:
    """Size, centre and within-cluster sums of distance and squared distance per cluster."""
    centres = numeric_centres(df, cluster, num)
    # One row per cluster: staged, it joins the documents without shuffling them by cluster.
    dim = stage(centres.select(F.col("cluster").alias("_c"), F.col("num").alias("_centre")))
    return df.join(dim, F.col(cluster) == F.col("_c")).select(
        F.col("_c").alias("cluster"), "_centre", V.squared_distance(F.col(num), F.col("_centre")).alias("_sq")
    ).groupBy("cluster").agg(
        F.any_value("_centre").alias("num"), F.count("*").alias("n"),
        F.sum("_sq").alias("within"), F.avg(F.sqrt("_sq")).alias("spread"),
    )


def calinski_davies(df: DataFrame, cluster: str, num: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from the per-cluster moments."""
    m = stage(_moments(df, cluster, num))
    overall = df.groupBy().agg(Summarizer.metrics("mean").summary(array_to_vector(F.col(num))).alias("s")).select(
        vector_to_array(F.col("s.mean")).alias("g")
    ).scalar()
    total = m.withColumn("_g", overall).select(
        F.col("n"), "within", (F.col("n") * V.squared_distance(F.col("num"), F.col("_g"))).alias("between")
    ).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"), F.sum("between").alias("b")
    )
    spreads = {r["cluster"]: r["spread"] for r in m.select("cluster", "spread").collect()}  # a number per cluster
    ready = prepared(m.select(F.col("cluster"), "num", no_categories().alias("cat")))
    worst = assignment.worst_overlap(
        F.col("num"), F.col("spread"), F.col("cluster"), ready, np.array([spreads[c] for c in ready.numbers.tolist()]))
    worst = m.select("cluster", worst.alias("r"))
    return total.select(
        ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"),
        worst.select(F.avg("r")).scalar().alias("davies_bouldin"),
    )


def simplified_silhouette(df: DataFrame, cluster: str, num: str) -> DataFrame:
    """(silhouette): mean silhouette with squared Euclidean distance, from cluster statistics instead of pairs. A document that is a
    cluster by itself counts 0, and so do all documents of a single cluster."""
    rows = df.select(F.col(cluster).alias("cluster"), V.doubles(F.col(num)).alias("num"))
    square = F.sum(V.dot(F.col("num"), F.col("num")))
    table = stage(numeric_centres(rows, "cluster", "num").join(rows.groupBy("cluster").agg(square.alias("square")), "cluster"))
    around = {r["cluster"]: (r["n"], r["square"] / r["n"]) for r in table.select("cluster", "n", "square").collect()}  # two numbers per cluster
    ready = prepared(table.select("cluster", "num", no_categories().alias("cat")))
    sizes, squares = (np.array([around[c][i] for c in ready.numbers.tolist()], dtype=float) for i in (0, 1))
    value = assignment.silhouette(F.col("num"), F.col("cluster"), ready, sizes, squares) if len(ready.numbers) else F.lit(None).cast("double")
    return rows.select(value.alias("s")).agg(F.avg("s").alias("silhouette"))


# -- prediction mix and updates ---------------------------------------------------


def hypotheses(predictions: DataFrame, file: str = "file", variant: str = "double") -> DataFrame:
    """Prior of every combination of a file's best classes. "double": its best two effects, dysfunctions and consequences
    and its best family (best two when the best one has no name); "family first": the best family only; "direct": the
    best class of every model; "all double": the best two of every model.

    Input is the ranked prediction table; every file contributes at most 16 combinations, built
    inside its own row.
    """
    wanted = predictions.where((F.col("rank") <= 2) & F.col("model").isin("DCO", "effet", "dysfonctionnement", "consequence"))

    def of(model):
        item = F.struct(F.col("rank"), F.col("class").alias("c"), F.col("class_name").alias("n"), F.col("proba").alias("p"))
        return F.array_sort(F.collect_list(F.when(F.col("model") == model, item)))

    best = wanted.groupBy(file).agg(
        of("DCO").alias("dco"), of("effet").alias("tef"), of("dysfonctionnement").alias("tdy"), of("consequence").alias("cdy")
    )
    one = F.slice("dco", 1, 1)
    families = {
        "double": F.when(F.get("dco", F.lit(0))["n"] == "", F.col("dco")).otherwise(one), "family first": one, "direct": one, "all double": F.col("dco")
    }[variant]
    if variant == "direct":
        best = best.withColumns({c: F.slice(c, 1, 1) for c in ("tef", "tdy", "cdy")})

    def combine(d, e, t, k):
        return F.struct(
            d["c"].alias("dco"), e["c"].alias("tef"), t["c"].alias("tdy"), k["c"].alias("cdy"),
            (d["p"] * e["p"] * t["p"] * k["p"]).alias("p"),
        )

    combos = F.flatten(F.transform(families, lambda d: F.flatten(F.transform("tef", lambda e: F.flatten(
        F.transform("tdy", lambda t: F.transform("cdy", lambda k: combine(d, e, t, k)))
    )))))
    rows = best.select(file, F.inline(combos))
    return rows.withColumn("prior", F.col("p") / F.sum("p").over(Window.partitionBy(file))).drop("p")


def mix_memberships(
    hypotheses: DataFrame, file: str, prior: str, num: str, cat: str, model: DataFrame | Model, k: int = 100, m: float = 1.25, gamma: float = 1.0
) -> DataFrame:
    """(file, cluster, proba): memberships of a file's hypotheses averaged by prior; the k best clusters
    scaled to sum 1. A file has a handful of hypotheses, mixed inside its row."""
    per_file = hypotheses.groupBy(file).agg(F.first(num).alias("num"), F.sort_array(F.collect_list(F.struct(cat, prior))).alias("h"))
    best = mixture(F.col("num"), F.col(f"h.{cat}"), F.col(f"h.{prior}"), model, m, gamma, k)
    return per_file.select(file, F.inline(best)).withColumnRenamed("weight", "proba")


def best_members(df: DataFrame, row: str) -> DataFrame:
    """(row, cluster, rank, proba): the members of every document, scaled to sum 1 over those kept."""
    total = V.let(F.transform("members", lambda x: x["weight"]), lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x))
    long = df.select(row, total.alias("_total"), F.posexplode("members").alias("_at", "_x"))
    return long.select(row, F.col("_x.cluster").alias("cluster"), (F.col("_at") + 1).alias("rank"), (F.col("_x.weight") / F.col("_total")).alias("proba"))


def statistics_of(df: DataFrame, cluster: str, num: str, cat: str) -> tuple[DataFrame, DataFrame]:
    """Sufficient statistics of an assignment: numeric sums and category counts per cluster."""
    summary = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(num)))
    sums = df.groupBy(F.col(cluster).alias("cluster")).agg(summary.alias("s")).select(
        "cluster", vector_to_array(F.col("s.sum")).alias("sums"), F.col("s.count").alias("n")
    )
    cells = df.select(F.col(cluster).alias("cluster"), F.posexplode(cat).alias("a", "code"))
    return sums, counts(cells, ["cluster", "a", "code"])


def vector_sum(column: str) -> Column:
    """Element-wise sum of an array column, summed map-side as vectors."""
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(F.col(column)))["sum"])


def merge_statistics(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    sums = old[0].unionByName(new[0]).groupBy("cluster").agg(vector_sum("sums").alias("sums"), F.sum("n").alias("n"))
    cells = old[1].unionByName(new[1]).groupBy("cluster", "a", "code").agg(F.sum("n").alias("n"))
    return sums, cells


def centroids_of_statistics(stats: tuple[DataFrame, DataFrame], previous: DataFrame) -> DataFrame:
    """Mean = sum / count; a category centre changes only for a strictly larger count."""
    sums, cells = stats
    was = previous.select("cluster", F.posexplode("cat").alias("a", "kept"))
    marked = cells.join(was, ["cluster", "a"], "left")
    modes = marked.groupBy("cluster", "a").agg(
        F.max_by("code", F.struct(F.col("n"), (F.col("code") == F.col("kept")).cast("int"), -F.col("code"))).alias("code")
    )
    cat = modes.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("a", "code"))), lambda s: s["code"]).alias("cat")
    )
    num = sums.select("cluster", V.scaled(F.col("sums"), F.col("n")).alias("num"), "n")
    return num.join(cat, "cluster", "left").select("cluster", "num", F.coalesce("cat", no_categories()).alias("cat"), "n")


def _open_leaders(candidates: list, frozen: Model, opened: list[tuple], first_free: int, delta: float, gamma: float) -> None:
    """Go through the candidates (num, cat) in order; one that no cluster claims, those opened before it
    included, opens a cluster. If all seem claimed, the first opens one, so that every round moves on."""
    old, before, pieces = list(frozen.pieces()), len(opened), None

    def open_cluster(num, cat):
        opened.append((first_free + len(opened), list(num), list(cat or [])))

    for num, cat in candidates:
        if pieces is None:
            pieces = old + (assignment.cut(*assignment.arrays([r[1:] for r in opened]), np.array([r[0] for r in opened], np.int32)) if opened else [])
        x, codes = np.array([num], dtype=float), np.array([cat or []], dtype=np.int64).reshape(1, -1)
        _, weight = members(x, codes, pieces, gamma, 2.0, 1)
        if not weight.size or weight[0, 0] <= delta:
            open_cluster(num, cat)
            pieces = None
    if len(opened) == before:
        open_cluster(*candidates[0])


def incremental_update(
    new: DataFrame, row: str, num: str, cat: str, model: DataFrame, stats: tuple[DataFrame, DataFrame], delta: float,
    gamma: float = 1.0,
) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Fold a batch of new documents into a model whose old assignments stay.

    All documents are scored against the frozen centroids (m = 2); claimed ones join their cluster. The
    unclaimed ones go through leader rounds: the first rows of every category combination, one in the first round
    and twice as many in each following, open clusters on themselves unless a cluster opened before claims them;
    then the rest is scored against all clusters, and what is claimed leaves, until no document is left. New clusters are
    numbered after the old ones as they open. Returns (assignment, new centroids, new statistics).
    """
    spark = new.sparkSession
    table = stage(model.select("cluster", "num", "cat"))
    frozen = prepared(table)
    first_free = int(frozen.numbers[-1]) + 1 if len(frozen.numbers) else 0
    opened: list[tuple] = []
    claimed, left = [], new.where(F.col(num).isNotNull())
    several, now = 1, frozen
    while True:
        scored = stage(left.withColumn("_m", memberships(F.col(num), F.col(cat), now, 2.0, gamma, 1)[0]))
        mine = F.col("_m.weight") > delta
        claimed.append(scored.where(mine).select(
            *new.columns, F.col("_m.cluster").cast("long").alias("cluster"), (F.col("_m.cluster") >= first_free).alias("is_new")))
        left = scored.where(~F.coalesce(mine, F.lit(False))).select(*new.columns)
        order = Window.partitionBy(cat).orderBy(row)
        candidates = left.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= several).orderBy("_r", cat, row).select(num, cat, row).collect()
        if not candidates:
            break
        _open_leaders([(r[0], r[1]) for r in candidates], frozen, opened, first_free, delta, gamma)
        several *= 2
        if now is not frozen:
            now.release()
        now = _extended(spark, frozen, opened)
    assigned = claimed[0]
    for part in claimed[1:]:
        assigned = assigned.unionByName(part)
    merged = merge_statistics(stats, statistics_of(assigned, "cluster", num, cat))
    return assigned, centroids_of_statistics(merged, table), merged


def _extended(spark: SparkSession, frozen: Model, opened: list[tuple]) -> Model:
    more = prepared_rows(spark, opened)
    return Model(np.concatenate([frozen.numbers, more.numbers]), [*frozen.shared, *more.shared])
