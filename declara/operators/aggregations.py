"""Grouped counts, shares and label statistics. Every aggregate combines map-side;
lists are built from distinct values, so a hot group shuffles no more than a rare one."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.runtime import stage


def counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_share(counted: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """value / total of its group (null where that is zero). The window runs over aggregated rows, one per distinct label."""
    return counted.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group))))


def with_total_share(counted: DataFrame, value: str, name: str) -> DataFrame:
    """value / grand total, the total being a scalar subquery."""
    return counted.withColumn(name, F.col(value) / counted.select(F.sum(value)).scalar())


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Rank inside a group; with ``k`` every task first keeps its own k best rows."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window).cast("long"))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def cluster_weight(assigned: DataFrame, cluster: str) -> DataFrame:
    """Documents per cluster and their percentage of the corpus, 2 decimals."""
    weighted = with_total_share(counts(assigned, [cluster], "nb_docs"), "nb_docs", "share")
    return weighted.select(cluster, "nb_docs", F.round(100 * F.col("share"), 2).alias("weight"))


def label_distribution(df: DataFrame, group: str, label: str, k: int | None = None) -> DataFrame:
    """Labels of every group with count, share inside the group and rank."""
    shared = with_share(counts(df, [group, label]), [group], "n", "score")
    return top_k(shared, [group], [F.col("n").desc(), F.col(label)], k)


def word_counts(token_rows: DataFrame, group: str, term: str = "term", k: int | None = 25) -> DataFrame:
    counted = token_rows.groupBy(group, term).agg(F.count("*").alias("n"))
    return top_k(counted, [group], [F.col("n").desc(), F.col(term)], k)


def labels_by_text(df: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """Sorted distinct labels of all rows with the same text, one list per label column."""
    return df.groupBy(text).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in labels])


def first_by_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per text, the one with the smallest ``order``."""
    others = [c for c in df.columns if c != text]
    return df.groupBy(text).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row")).select(
        text, *[F.col("_row")[c].alias(c) for c in others]
    )


def multilabel_table(df: DataFrame, text: str, order: str, labels: list[str]) -> DataFrame:
    """First row of every text with the label lists of all its copies.

    Both parts come from one aggregation, so the copies are never joined to themselves.
    """
    others = [c for c in df.columns if c != text and c not in labels]
    return df.groupBy(text).agg(
        F.min_by(F.struct(*others), F.col(order)).alias("_row"),
        *[F.array_sort(F.collect_set(c)).alias(c) for c in labels],
    ).select(text, *[F.col("_row")[c].alias(c) for c in others], *labels)


def missing_rate(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Share of nulls per column, long form, in one pass."""
    wide = df.groupBy(*group).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot(group, columns, "column", "missing")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, long form."""
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)])
    long = wide.unpivot([], wide.columns, "pair", "corr")
    return long.select(
        F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr"
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return counts(df, [truth, predicted])


def crosstab(df: DataFrame, truth: str, predicted: str, margin: str = "All") -> DataFrame:
    """Counts per (truth, prediction) with margins. The cube runs over the confusion
    counts, so rows are not multiplied before they are combined."""
    cells = confusion(df.select(F.col(truth).cast("string"), F.col(predicted).cast("string")), truth, predicted)
    cubed = cells.cube(truth, predicted).agg(
        F.sum("n").alias("n"), F.grouping(truth).alias("_gt"), F.grouping(predicted).alias("_gp")
    )
    return cubed.select(
        F.when(F.col("_gt") == 1, F.lit(margin)).otherwise(F.col(truth)).alias(truth),
        F.when(F.col("_gp") == 1, F.lit(margin)).otherwise(F.col(predicted)).alias(predicted),
        "n",
    )


def micro_clusters(df: DataFrame, cluster: str, parts: dict[str, str]) -> DataFrame:
    """One row per combination of family, effect, consequence, dysfunction and manufacturer:
    its weight, majority cluster (ties: lowest) and the share of rows in that cluster."""
    names = list(parts)
    filled = df.select(
        F.col(cluster).alias("cluster"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for n, c in parts.items()],
    )
    cells = counts(filled, [*names, "cluster"])
    best = F.max_by("cluster", F.struct(F.col("n"), -F.col("cluster")))
    grouped = cells.groupBy(*names).agg(
        best.alias("macro_cluster"), F.sum("n").alias("weight"), F.max("n").alias("_top")
    )
    return grouped.select(
        F.concat_ws(" ", *names).alias("micro_label"), *names, "macro_cluster", "weight",
        (F.col("_top") / F.col("weight")).alias("score"),
    )


def macro_clusters(df: DataFrame, cluster: str, micro: DataFrame) -> DataFrame:
    """Coherence of every cluster over the micro labels it owns, 0 when it owns none."""
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("weight"))
    owned = micro.groupBy(F.col("macro_cluster").alias("cluster")).agg(
        *[F.count_distinct(c).alias(c) for c in ("dco", "tef", "tdy", "cdy", "fab")]
    )
    typology = (1 / F.col("tef") + 1 / F.col("tdy") + 1 / F.col("cdy")) / 3
    return sizes.join(owned, "cluster", "left").select(
        "cluster", "weight",
        F.coalesce(1 / F.col("dco"), F.lit(0.0)).alias("dco_score"),
        F.coalesce(typology, F.lit(0.0)).alias("typology_score"),
        F.coalesce(1 / F.col("fab"), F.lit(0.0)).alias("manufacturer_score"),
    )


def micro_macro_score(micro: DataFrame, macro: DataFrame) -> DataFrame:
    from declara.constants import MACRO_WEIGHTS as W

    mixed = (
        W["dco"] * F.col("dco_score") + W["typology"] * F.col("typology_score")
        + W["manufacturer"] * F.col("manufacturer_score")
    )
    micro_score = micro.select(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"))
    return macro.agg(
        (F.sum(F.col("weight") * mixed) / F.sum("weight")).alias("macro_score")
    ).select(micro_score.scalar().alias("micro_score"), "macro_score")


CLASS_WEIGHTS = {
    # Exponents applied to the balanced weight.
    "balanced": 1.0, "soft": 1 / 1.2, "softer": 1 / 1.5, "root": 1 / 2,
}
# Weights of classes with fewer rows than the bound, and of all larger ones.
CLASS_STEPS = ((10, 10.0), (100, 5.0), (500, 1.0), (1000, 0.5))
CLASS_STEP_LARGE = 0.1
CLASS_LOG_SHIFT = 300


def class_weight(df: DataFrame, label: str, scheme: str = "softer") -> DataFrame:
    """One row per class. Schemes: N / (k * n_c) to a power (``CLASS_WEIGHTS``), ``log`` of it after a
    shift, or ``steps`` by the number of rows."""
    counted = counts(df, [label])
    rows = counted.select(F.sum("n")).scalar()
    classes = counted.select(F.count("*")).scalar()
    balanced = rows / (classes * F.col("n"))
    if scheme == "log":
        return counted.withColumn("weight", F.log(balanced + CLASS_LOG_SHIFT))
    if scheme == "steps":
        step = F.lit(CLASS_STEP_LARGE)
        for bound, weight in reversed(CLASS_STEPS):
            step = F.when(F.col("n") < bound, weight).otherwise(step)
        return counted.withColumn("weight", step)
    return counted.withColumn("weight", F.pow(balanced, F.lit(CLASS_WEIGHTS[scheme])))


def label_embeddings(instance_labels: DataFrame, instance_features: DataFrame) -> DataFrame:
    """Label vector = normalised sum of its instances' vectors, each instance weighted by the
    normalised row of its labels. Inputs ``(i, label)`` and ``(i, feat, v)``; output ``(label, feat, v)``."""
    weight = instance_labels.groupBy("i").agg((1 / F.sqrt(F.count("*"))).alias("w"))
    summed = (
        instance_labels.join(weight, "i").join(instance_features, "i")
        .groupBy("label", "feat").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    )
    norms = summed.groupBy("label").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return summed.join(norms, "label").select("label", "feat", (F.col("s") / F.col("norm")).alias("v"))


def label_given_code(instance_codes: DataFrame, instance_labels: DataFrame) -> DataFrame:
    """Row-normalised code x label co-occurrence from ``(i, code)`` and ``(i, label)``."""
    together = counts(instance_codes.join(instance_labels, "i"), ["code", "label"])
    return with_share(together, ["code"], "n", "p")


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """Accuracy of always answering the most frequent class."""
    counted = counts(df, [label])
    return counted.agg(F.max("n").alias("n_majority"), F.sum("n").alias("n")).withColumn(
        "share", F.col("n_majority") / F.col("n")
    )


def oversample_rare(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows of classes with fewer than n rows appear n + 1 times."""
    sizes = counts(df, [label], "_n")
    # At most one row per class: staged, it joins without shuffling the rows by a hot class.
    rare = stage(sizes.where(F.col("_n") < n).select(label, F.lit(n).alias("_more")))
    return (
        df.join(rare, label, "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0)))))
        .drop("_more")
    )


def min_support(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows of classes with more than n rows."""
    kept = stage(counts(df, [label], "_n").where(F.col("_n") > n).select(label))
    return df.join(kept, label, "left_semi")
