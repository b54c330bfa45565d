"""Scores of predictions. Metrics start from confusion counts, never from row pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.operators.aggregations import counts
from declara.runtime import with_global_cumsum


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def accuracy(df: DataFrame, truth: str, predicted: str, group: list[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy")
    )


def per_class(df: DataFrame, truth: str, predicted: str, group: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction."""
    cells = counts(df, [*group, truth, predicted])
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    # Every confusion cell counts once for its truth and once for its answer, in the same pass.
    sides = F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("answers"), hit.cast("long").alias("hits")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("answers"), F.lit(0).cast("long").alias("hits")),
    )
    summed = cells.select(*group, F.inline(sides)).groupBy(*group, "class").agg(
        F.sum("support").alias("support"), F.sum("answers").alias("answers"), F.sum("hits").alias("hits")
    )
    return summed.select(
        *group, "class", "support",
        _ratio(F.col("hits"), F.col("answers")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("answers") + F.col("support")).alias("f1"),
    )


def summary(df: DataFrame, truth: str, predicted: str, group: list[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and weighted F1 from one confusion table."""
    classes = per_class(df, truth, predicted, group)
    seen = F.col("support") > 0
    return classes.groupBy(*group).agg(
        F.sum("support").alias("n"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def binary_f1(df: DataFrame, truth: str, predicted: str, positive) -> DataFrame:
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    sums = df.agg(
        F.sum((t & p).cast("int")).alias("tp"), F.sum(t.cast("int")).alias("pos"), F.sum(p.cast("int")).alias("ans")
    )
    return sums.select("tp", "pos", "ans", _ratio(2 * F.col("tp"), F.col("pos") + F.col("ans")).alias("f1"))


def group_scores(df: DataFrame, truth: str, predicted: str, group: str) -> DataFrame:
    """Scores of every group and over all rows, from a single pass over the rows."""
    both = df.withColumn("_g", F.explode(F.array(F.col(group).cast("string"), F.lit("all"))))
    return summary(both, truth, predicted, ["_g"]).withColumnRenamed("_g", "scope")


def unused_classes(report: DataFrame) -> DataFrame:
    """Share of classes without support and of classes with F1 0."""
    return report.agg(
        F.count("*").alias("classes"), F.avg((F.col("support") == 0).cast("int")).alias("no_support"),
        F.avg((F.col("f1") == 0).cast("int")).alias("zero_f1"),
    )


def never_predicted(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Classes by where they occur: only in truth, only in predictions, or in both."""
    cells = counts(df, [truth, predicted])
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )))
    return sides.groupBy("class").agg(F.max("t").alias("t"), F.max("p").alias("p")).select(
        "class", F.when(F.col("p") == 0, "never predicted").when(F.col("t") == 0, "never true").otherwise("both").alias("seen")
    )


def samples_scores(df: DataFrame, truth: str, predicted: str, group: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 of label sets per row, averaged over rows."""
    both = F.size(F.array_intersect(truth, predicted))
    t, p = F.size(F.array_distinct(truth)), F.size(F.array_distinct(predicted))
    rows = df.select(
        *group, _ratio(both, p).alias("pr"), _ratio(both, t).alias("re"), _ratio(2 * both, t + p).alias("f1")
    )
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg("f1").alias("f1")
    )


def label_sets(scored: DataFrame, row: str, label: str, proba: str, threshold: float) -> DataFrame:
    """Predicted set of every row: labels whose probability reaches the threshold."""
    inside = F.when(F.col(proba) >= threshold, F.col(label))
    return scored.groupBy(row).agg(F.collect_set(inside).alias("predicted"))


def threshold_sweep(df: DataFrame, truth: str, scores: str, thresholds: list[float]) -> DataFrame:
    """Samples scores per threshold. ``scores`` is an array of ``(label, proba)`` structs; the
    thresholds are expanded inside the row as small numbers, labels are not copied."""
    at = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    chosen = F.transform(
        F.filter(scores, lambda s: s["proba"] >= F.col("threshold")), lambda s: s["label"]
    )
    return samples_scores(at.withColumn("_p", chosen), truth, "_p", ["threshold"])


def topk_accuracy(ranked: DataFrame, row: str, truth: str, label: str, rank: str, ks: list[int]) -> DataFrame:
    """Share of rows whose truth is among the first k predictions, for every k."""
    where = ranked.groupBy(row).agg(F.min(F.when(F.col(label) == F.col(truth), F.col(rank))).alias("at"))
    hist = where.groupBy("at").agg(F.count("*").alias("n"))
    total = hist.select(F.sum("n")).scalar()
    per_k = hist.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return per_k.groupBy("k").agg(F.sum(F.when(F.col("at") <= F.col("k"), F.col("n")).otherwise(0)).alias("hits")).select(
        "k", "hits", (F.col("hits") / total).alias("accuracy")
    )


def precision_recall_at_k(ranked: DataFrame, row: str, relevant: str, rank: str, truths: DataFrame, n_true: str, kmax: int) -> DataFrame:
    """P@k and R@k averaged over rows, k = 1..kmax. ``relevant`` is 0/1 per ranked label,
    ``truths`` gives the number of true labels per row."""
    hits = ranked.where(F.col(rank) <= kmax).groupBy(row).agg(
        F.collect_list(F.when(F.col(relevant) == 1, F.col(rank))).alias("at")
    )
    rows = truths.select(row, n_true).join(hits, row, "left")
    expanded = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax))))
    found = F.size(F.filter(F.coalesce("at", F.array().cast("array<bigint>")), lambda r: r <= F.col("k")))
    return expanded.groupBy("k").agg(
        F.avg(found / F.col("k")).alias("precision"), F.avg(found / F.col(n_true)).alias("recall")
    )


def auc_ap(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Exact ROC AUC and average precision. Equal scores are combined first, the running
    totals go range by range, so neither ties nor size gather in one task."""
    cells = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q")
    )
    run = with_global_cumsum(cells, [F.col("s").desc()], {"tp": F.col("p"), "fp": F.col("q")})
    sums = run.agg(
        F.sum("p").alias("pos"), F.sum("q").alias("neg"),
        F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("above"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    return sums.select(
        "pos", "neg", (F.col("above") / (F.col("pos") * F.col("neg"))).alias("auc"),
        (F.col("ap") / F.col("pos")).alias("average_precision"),
    )
