"""Invariants of trained models on the smallest tables."""

import pytest
from checks import DATA
from pyspark.sql import functions as F

import __spark_entry__ as entry
from declara.operators import models as M

FOLDER = f"{DATA}/sf0.001"
QUERIES = entry.queries()


def rows(spark, name):
    return QUERIES[name](spark, FOLDER)


def test_topic_weights_sum_to_one(spark):
    sums = rows(spark, "ml_lda").groupBy("doc_id").agg(F.sum("weight").alias("s"))
    assert sums.count() == 200 and sums.where(F.abs(F.col("s") - 1) > 1e-6).isEmpty()


@pytest.mark.parametrize("name", ["ml_svm_calibrated", "ml_svm_platt"])
def test_calibrated_probabilities_sum_to_one(spark, name):
    out = rows(spark, name).groupBy("vec_id").agg(F.sum("proba").alias("s"), F.count("*").alias("n"))
    assert out.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("n") != 10)).isEmpty() and not out.isEmpty()


def test_ordinal_levels_sum_to_one(spark):
    out = rows(spark, "ml_ordinal").groupBy("vec_id").agg(F.sum("proba").alias("s"), F.count("*").alias("n"))
    assert out.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("n") != 5)).isEmpty() and not out.isEmpty()


def test_clusters_and_anomalies(spark):
    assert rows(spark, "ml_kmeans").select("cluster").distinct().count() == 10
    assert rows(spark, "ml_kprototypes").where(~F.col("cluster_weight").between(0, 1)).isEmpty()
    flags = rows(spark, "ml_anomaly_reconstruction").agg(F.count_if("is_anomaly").alias("k"), F.count("*").alias("n")).first()
    assert flags["n"] == 500 and flags["k"] == 25
    assert rows(spark, "ml_label_tree").select("leaf").distinct().count() == 8


def test_pca_axes_are_scaled(spark):
    ends = rows(spark, "ft_pca2").agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    assert abs(ends["x"] - 1) < 1e-9 and abs(ends["y"] - 1) < 1e-9


def test_svd_keeps_every_document_with_terms(spark):
    assert rows(spark, "ft_svd").groupBy("doc_id").count().where("count <> 8").isEmpty()


def test_sweeps_and_baselines(spark):
    assert rows(spark, "tune_param_sweep").count() == 4
    assert rows(spark, "ml_gmm").where("bic < aic").isEmpty()
    assert {r["model"] for r in rows(spark, "ml_baseline_classifiers").collect()} == {"naive bayes", "logistic regression", "linear svm"}


def test_multilabel_models_score_every_label(spark):
    for name in ("ml_ovr_multilabel", "ml_classifier_chain"):
        assert rows(spark, name).groupBy("vec_id").count().where("count <> 7").isEmpty()


def test_sweeps_answer_every_point(spark):
    topics = rows(spark, "tune_topics").collect()
    assert len(topics) == 9 and all(r["coherence"] <= 0.7 and r["terms"] > 0 for r in topics) and len({r["terms"] for r in topics}) >= 2
    clusters = sorted(rows(spark, "tune_clusters").collect())
    assert [r["clusters"] for r in clusters] == [2, 4, 6, 8, 10] and all(0 < r["used"] <= r["clusters"] for r in clusters)
    assert clusters[0]["inertia"] > clusters[-1]["inertia"]
    sizes = sorted(rows(spark, "tune_tfidf").collect())
    assert [r["size"] for r in sizes] == [50, 500, 5000] and sizes[-1]["accuracy"] > 0.9 and sizes[0]["terms"] <= 50


def test_sweep_failures_are_raised(spark):
    from declara.operators.sweeps import grid

    def job(point):
        if point["a"] == 2:
            raise ValueError("two")
        return {"b": float(spark.range(point["a"]).count())}

    assert sorted(tuple(r) for r in grid(spark, [{"a": 1}, {"a": 3}], job, "a int, b double").collect()) == [(1, 1.0), (3, 3.0)]
    with pytest.raises(ValueError):
        grid(spark, [{"a": 1}, {"a": 2}], job, "a int, b double")


def test_reconstruction_cosine(spark):
    import numpy as np

    from declara.operators import models as M

    x = np.random.default_rng(3).normal(size=(60, 6)) * [5, 3, 2, 1, 1, 1] + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "row long, num array<double>")
    train = df.where("row < 40")
    got = {r["row"]: r["cosine"] for r in M.reconstruction_cosine(train, df, "row", "num", 3).collect()}
    mean = x[:40].mean(axis=0)
    axes = np.linalg.svd(x[:40] - mean, full_matrices=False)[2][:3].T
    back = mean + (x - mean) @ axes @ axes.T
    want = (x * back).sum(axis=1) / (np.linalg.norm(x, axis=1) + 1e-6) / (np.linalg.norm(back, axis=1) + 1e-6)
    assert np.allclose([got[i] for i in range(60)], want, rtol=1e-9) and got[99] is None


def test_word_vectors_read_the_words_once(spark):
    """The vocabulary, the learning and the means share one reading of the texts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        seen.add(1)
        return text.split()

    frame = spark.createDataFrame([(i, "one two three") for i in range(6)], "row long, text string")
    out = M.word_vectors(frame.select("row", split("text").alias("words")), "row", "words", 4).collect()
    assert seen.value == 6 and sorted(r["row"] for r in out) == [*range(6)]
    assert len({tuple(r["vector"]) for r in out}) == 1 and len(out[0]["vector"]) == 4
