"""Models trained with MLlib: clusters, calibrated classifiers, decompositions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from declara.functions import vectors as V
from declara.operators import linear as L
from declara.operators.encode import hash_bucket, stratified_folds
from declara.operators.quantiles import quantile_column
from declara.runtime import stage


# -- vectors --------------------------------------------------------------------------------


def standardise(df: DataFrame, num: str, out: str) -> DataFrame:
    """Zero mean, unit (population) variance per dimension; constant dimensions become 0."""
    stats = df.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(num))).alias("s")).select(
        F.struct(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n")).alias("s")
    )
    moved = df.withColumn("_s", stats.scalar())
    spread = F.sqrt(F.col("_s.n").cast("double") - 1) / F.sqrt(F.col("_s.n").cast("double"))
    deviations = V.let(spread, lambda r: F.transform("_s.v", lambda v: F.sqrt(v) * r))
    centred = F.zip_with(num, "_s.m", lambda x, m: x - m)
    return moved.withColumn(out, F.zip_with(centred, deviations, lambda x, d: F.when(d == 0, 0.0).otherwise(x / d))).drop("_s")


def pca_axes(centroids: DataFrame, cluster: str, num: str, standard: bool = False) -> DataFrame:
    """(cluster, x, y): first two principal axes of the centroids, scaled by the largest absolute
    value. The sign of an axis is arbitrary; the heavier side is turned to the positive."""
    table = standardise(centroids, num, num) if standard else centroids
    features = table.select(cluster, array_to_vector(F.col(num)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(features)
    xy = model.transform(features).select(cluster, vector_to_array("p").alias("p"))
    centre = xy.agg(F.avg(F.col("p")[0]).alias("a"), F.avg(F.col("p")[1]).alias("b"))
    moved = xy.select(
        cluster, (F.col("p")[0] - centre.select("a").scalar()).alias("x"), (F.col("p")[1] - centre.select("b").scalar()).alias("y")
    )
    ends = moved.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("hi", F.max), ("lo", F.min))])

    def scaled(c):
        hi, lo = ends.select(f"hi{c}").scalar(), ends.select(f"lo{c}").scalar()
        return (F.col(c) / F.when(hi >= -lo, hi).otherwise(lo)).alias(c)

    return moved.select(cluster, scaled("x"), scaled("y"))


def word_vectors(df: DataFrame, row: str, words: str, size: int = 50, min_count: int = 3, seed: int = 1029) -> DataFrame:
    """Mean word vector of every text, the vectors learned on the same corpus."""
    df = stage(df.select(row, words))  # the vocabulary, the learning and the means each read the words
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, inputCol=words, outputCol="_v", maxIter=1, numPartitions=4).fit(df)
    return model.transform(df).select(row, vector_to_array("_v").alias("vector"))


def reconstruction_error(train: DataFrame, df: DataFrame, row: str, num: str, k: int) -> DataFrame:
    """Mean squared error of a vector against its projection on the k leading axes of ``train``."""
    mean = train.agg(Summarizer.metrics("mean").summary(array_to_vector(F.col(num))).alias("s")).select(vector_to_array("s.mean").alias("m"))

    def centred(table):
        c = F.zip_with(num, "_m", lambda x, m: x - m)
        return table.withColumn("_m", mean.scalar()).select(row, c.alias("c"), array_to_vector(c).alias("features"))

    model = PCA(k=k, inputCol="features", outputCol="p").fit(centred(train))
    scored = model.transform(centred(df))
    # The axes are orthonormal, so the lost part of the squared length is the squared error.
    lost = V.dot(F.col("c"), F.col("c")) - V.dot(F.col("_p"), F.col("_p"))
    return scored.withColumn("_p", vector_to_array("p")).select(row, (F.greatest(lost, F.lit(0.0)) / F.size("c")).alias("error"))


def anomalies(train: DataFrame, df: DataFrame, row: str, num: str, k: int, q: float = 0.99) -> DataFrame:
    """Rows whose error exceeds the q-quantile of the training errors."""
    errors = stage(reconstruction_error(train, train, row, num, k))
    cut = quantile_column(errors, [], "error", q, "cut").select("cut").scalar()
    return reconstruction_error(train, df, row, num, k).withColumn("is_anomaly", F.col("error") > cut)


def reconstruction_cosine(train: DataFrame, df: DataFrame, row: str, num: str, k: int) -> DataFrame:
    """(row, cosine) of a vector and its reconstruction from the k leading axes of ``train``: low for unusual rows."""
    vectors = train.select(array_to_vector(F.col(num)).alias("features"))
    mean = np.array(vectors.agg(Summarizer.metrics("mean").summary(F.col("features")).alias("s")).select(vector_to_array("s.mean")).first()[0])
    axes = PCA(k=k, inputCol="features", outputCol="p").fit(vectors).pc.toArray()  # dimensions x k

    @F.arrow_udf("double")
    def cosine(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
        back = mean + (x - mean) @ axes @ axes.T if len(x) else x
        out = np.full(len(known), np.nan)
        out[known] = (x * back).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) + 1e-6) / (np.sqrt((back * back).sum(axis=1)) + 1e-6)
        return pa.array(out, mask=~known)

    return df.select(row, cosine(V.doubles(F.col(num))).alias("cosine"))


# -- clusters ----------------------------------------------------------------------------------


def k_means(df: DataFrame, row: str, num: str, k: int, seed: int = 1029) -> DataFrame:
    features = df.select(row, num, array_to_vector(F.col(num)).alias("features"))
    return KMeans(k=k, seed=seed).fit(features).transform(features).select(row, num, F.col("prediction").alias("cluster"))


def mixture_sweep(df: DataFrame, num: str, ks: list[int], seed: int = 1029, max_iter: int = 100) -> DataFrame:
    """Log-likelihood, BIC and AIC of Gaussian mixtures of several sizes."""
    features = df.select(array_to_vector(F.col(num)).alias("features"))
    n, d = df.select(F.count("*"), F.max(F.size(num))).first()
    out = []
    for k in ks:
        likelihood = float(GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(features).summary.logLikelihood)
        free = k * d + k * d * (d + 1) / 2 + k - 1
        out.append((k, likelihood, _log(n) * free - 2 * likelihood, 2 * free - 2 * likelihood))
    return df.sparkSession.createDataFrame(out, "k int, log_likelihood double, bic double, aic double")


def _log(x):
    from math import log

    return log(x)


def label_tree(label_vectors: DataFrame, label: str, num: str, leaves: int, seed: int = 1029) -> DataFrame:
    """Leaf of every label in a tree of two-way splits on normalised vectors."""
    features = label_vectors.select(label, array_to_vector(V.unit(F.col(num))).alias("features"))
    model = BisectingKMeans(k=leaves, seed=seed).fit(features)
    return model.transform(features).select(label, F.col("prediction").alias("leaf"))


# -- classifiers ----------------------------------------------------------------------------------


def _features(df: DataFrame, num: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(num)))


def _balanced(df: DataFrame, target: Column) -> DataFrame:
    """0/1 column ``y`` and the weight that makes both sides equally heavy."""
    marked = df.withColumn("y", target.cast("double"))
    share = marked.select(F.avg("y")).scalar()
    return marked.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def svm_scores(train: DataFrame, df: DataFrame, row: str, label: str, num: str, passes: int = 60) -> DataFrame:
    """(row, class, score): margins of balanced linear SVMs, one per class, fitted together."""
    classes = L.class_list(train, F.col(label))
    model = L.fit(stage(L.prepared(train, row, num, label, classes)), classes, passes=passes)
    return L.scores(L.prepared(df, row, num, None, classes), row, model, train.schema[label].dataType)


def calibrated_svm(
    train: DataFrame, df: DataFrame, row: str, label: str, num: str, folds: int = 3, how: str = "isotonic", passes: int = 60
) -> DataFrame:
    """(row, class, proba): SVM margins turned into probabilities on held-out folds, by isotonic or
    sigmoid regression per class, averaged over the folds and scaled to sum 1 per row. All classes
    and folds are columns of one fit."""
    classes = L.class_list(train, F.col(label))
    split = stratified_folds(train, [label], row, folds)
    data = stage(L.prepared(split, row, num, label, classes, "fold"))
    model = L.fit(data, classes, folds, passes=passes)
    curves = L.isotonic(L.held_out(data, model)) if how == "isotonic" else L.sigmoid(data, model)
    return L.probabilities(L.prepared(df, row, num, None, classes), row, model, curves, train.schema[label].dataType)


def ordinal(train: DataFrame, df: DataFrame, row: str, level: str, num: str, levels: int, max_iter: int = 10) -> DataFrame:
    """(row, level, proba) from levels-1 binary models of "above level i":
    P0 = 1 - p0, Pi = p(i-1) - pi, Plast = p(last-1). Values may be negative and stay raw."""
    fitted, scored = _features(train, num).select(level, "features").persist(), _features(df, num).select(row, "features")
    above = []
    for i in range(levels - 1):
        side = _balanced(fitted, F.col(level) > i)
        model = LogisticRegression(labelCol="y", weightCol="w", maxIter=max_iter, regParam=0.01, probabilityCol=f"q{i}",
                                   rawPredictionCol=f"r{i}", predictionCol=f"p{i}").fit(side)
        scored = model.transform(scored).drop(f"r{i}", f"p{i}")
        above.append(vector_to_array(f"q{i}")[1])
    fitted.unpersist()
    probas = [1 - above[0]] + [above[i - 1] - above[i] for i in range(1, levels - 1)] + [above[-1]]
    return scored.select(row, F.posexplode(F.array(*probas)).alias("level", "proba"))


def one_vs_rest_labels(train: DataFrame, df: DataFrame, row: str, labels: str, num: str, passes: int = 60) -> DataFrame:
    """(row, label, score): linear SVMs of a label-set column, one per label, fitted together."""
    names = L.class_list(train, F.explode(labels))
    model = L.fit(stage(L.prepared(train, row, num, labels, names)), names, passes=passes)
    return L.scores(L.prepared(df, row, num, None, names), row, model, train.schema[labels].dataType.elementType, "label")


def classifier_chains(
    train: DataFrame, df: DataFrame, row: str, labels: str, num: str, chains: int = 10, seed: int = 1029, passes: int = 60
) -> DataFrame:
    """(row, label, score): mean vote of chains of logistic regressions in random orders; in a chain every model also sees the labels
    before it, true ones in training and predicted ones in use. Since the true labels are known in training, all models
    of all chains are columns of one fit, in which a column's weights on later labels stay 0."""
    from random import Random

    names = L.class_list(train, F.explode(labels))
    kind, element = df.schema[row].dataType, train.schema[labels].dataType.elementType
    k, orders = len(names), [Random(seed + c).sample(range(len(names)), len(names)) for c in range(chains)]
    seen = F.array(*[F.coalesce(F.array_contains(labels, F.lit(n)), F.lit(False)).cast("double") for n in names]) if names else F.array().cast("array<double>")
    data = stage(L.prepared(train.withColumn("_x", F.concat(V.doubles(F.col(num)), seen)), row, "_x", labels, names))
    width = (data.agg(F.max(F.size("x"))).first()[0] or k) - k
    mask = np.ones((width + k + 1, chains * k))
    for c, order in enumerate(orders):
        for place, label in enumerate(order):
            mask[width + np.array(order[place:], int), c * k + label] = 0.0
    model = L.fit(data, names, chains, "logistic", passes=passes, held=False, mask=mask)

    def vote(batches):
        listed = pa.array(names, to_arrow_type(element))
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            votes = np.zeros((len(x), k))
            for c, order in enumerate(orders):
                w, said = model.of_fold(c), np.zeros((len(x), k))
                for label in order:
                    said[:, label] = x @ w[:width, label] + said @ w[width:-1, label] + w[-1, label] > 0
                votes += said
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), listed.take(pa.array(np.tile(np.arange(k), len(x)))), pa.array((votes / chains).ravel())],
                names=[row, "label", "score"])

    rows = df.select(row, V.doubles(F.col(num)).alias("x")).where("x IS NOT NULL")
    return rows.mapInArrow(vote, f"`{row}` {kind.simpleString()}, label {element.simpleString()}, score double")


def compare_baselines(df: DataFrame, row: str, label: str, num: str, folds: int = 3) -> DataFrame:
    """Mean accuracy of naive Bayes, logistic regression and linear SVM over stratified folds."""
    spark = df.sparkSession
    codes = spark.createDataFrame([(c, float(i)) for i, c in enumerate(L.class_list(df, F.col(label)))], StructType(
        [StructField("_class", df.schema[label].dataType), StructField("y", DoubleType())]))
    lowest = df.select(F.min(F.array_min(num))).scalar()
    # Naive Bayes needs non-negative features; a common shift keeps the others unaffected.
    shifted = df.withColumn("_lo", lowest).withColumn("_n", F.transform(num, lambda x: x - F.col("_lo"))).drop("_lo")
    coded = _features(shifted, "_n").join(codes, F.col(label) == F.col("_class")).drop("_class")
    data = stage(stratified_folds(coded, [label], row, folds))
    measure = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    out = []
    for f in range(folds):
        fit, held = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        for name, learner in (("naive bayes", NaiveBayes(labelCol="y")), ("logistic regression", LogisticRegression(labelCol="y", maxIter=10))):
            out.append((name, f, float(measure.evaluate(learner.fit(fit).transform(held)))))
        best = svm_scores(fit, held, row, label, num).groupBy(row).agg(F.max_by("class", "score").alias("p"))
        right = best.join(held.select(row, label), row).select(F.avg((F.col("p") == F.col(label)).cast("double")))
        out.append(("linear svm", f, float(right.first()[0])))
    table = spark.createDataFrame(out, "model string, fold int, accuracy double")
    return table.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("folds"))


def parameter_sweep(df: DataFrame, label: str, num: str, reg: list[float], iterations: list[int], folds: int = 2) -> DataFrame:
    """Cross-validated score of every parameter combination."""
    data = _features(df, num).withColumn("label", F.col(label).cast("double"))
    learner = LogisticRegression(labelCol="label")
    grid = ParamGridBuilder().addGrid(learner.regParam, reg).addGrid(learner.maxIter, iterations).build()
    model = CrossValidator(
        estimator=learner, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds,
        seed=1029, parallelism=4,
    ).fit(data)
    rows = [(float(p[learner.regParam]), int(p[learner.maxIter]), float(m)) for p, m in zip(grid, model.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "reg double, iterations int, f1 double")


def split_rows(df: DataFrame, key: str, test_percent: int = 20, seed: int = 1029) -> tuple[DataFrame, DataFrame]:
    is_test = hash_bucket([key], 100, seed) < test_percent
    return df.where(~is_test), df.where(is_test)
