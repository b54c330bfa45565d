"""Trained models on whole tables. Their results depend on the optimiser, so most have no SQL;
tests check their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara.functions import text as T
from declara.operators import clusters as C
from declara.operators import density as D
from declara.operators import encode as E
from declara.operators import evaluate as EV
from declara.operators import features as X
from declara.operators import lda as L
from declara.operators import models as M
from declara.operators import svd as SV
from declara.operators import sweeps as SW
from declara.plans import views as W
from declara.plans.registry import Tables, query
from declara.plans.views import r6
from declara.runtime import shuffles_removed, stage, unstage


def _docs(t: Tables):
    return t.texts.select("doc_id", "lang", "source", T.tokens(F.col("text")).alias("words"))


def _vocabulary(t: Tables, docs):
    bow = X.doc2bow(docs, "doc_id", F.col("words"))
    return stage(X.vocabulary(X.term_stats(bow), t.documents.select(F.count("*")).scalar()))


TOPICS = 150


def _topics(t: Tables, k: int = TOPICS):
    docs = stage(_docs(t))  # the vocabulary and the counts read the same words
    vocabulary = _vocabulary(t, docs)
    vectors = stage(L.count_rows(docs, "doc_id", "words", vocabulary))  # read in every pass
    return vocabulary, vectors, L.fit(vectors, vocabulary.count(), k, passes=5)


def _benchmark_rows(t: Tables, vocabulary):
    return L.count_rows(t.benchmark.select("item_id", T.tokens(F.col("text")).alias("words")), "item_id", "words", vocabulary)


@query("ml_lda")
def _(t: Tables):
    _, vectors, model = _topics(t)
    return L.distribution(vectors, "doc_id", model).select("doc_id", F.posexplode("weights").alias("topic", "weight"))


@query("ml_lda_predict")
def _(t: Tables):
    vocabulary, _, model = _topics(t)
    weights = L.distribution(_benchmark_rows(t, vocabulary), "item_id", model)
    return weights.select("item_id", F.posexplode("weights").alias("topic", "weight"))


@query("ml_lda_update")
def _(t: Tables):
    vocabulary, _, older = _topics(t)
    model = L.fit(stage(_benchmark_rows(t, vocabulary)), len(older.lam), older.k, passes=2, older=older)
    return L.top_words(model, vocabulary)


@query("ml_topic_words")
def _(t: Tables):
    vocabulary, _, model = _topics(t)
    return L.top_words(model, vocabulary)


@query("ml_topic_svm_eval")
def _(t: Tables):
    _, vectors, model = _topics(t)
    weights = L.distribution(vectors, "doc_id", model)
    data = stage(weights.join(t.documents.select("doc_id", "lang", F.md5("text").alias("text")), "doc_id"))
    train, test = M.split_rows(data, "text")
    scores = M.svm_scores(train, test, "doc_id", "lang", "weights")
    best = scores.groupBy("doc_id").agg(F.max_by("class", "score").alias("predicted")).join(test.select("doc_id", "lang"), "doc_id")
    return EV.summary(best, "lang", "predicted").select("n", "accuracy", "balanced_accuracy")


@query("ft_standardize", """
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, i, round((x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i), 6) AS z FROM e""")
def _(t: Tables):
    z = M.standardise(W.vectors(t), "num", "z")
    return z.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", F.col("i").cast("long").alias("i"), r6("z").alias("z"))


@query("ft_svd")
def _(t: Tables):
    with shuffles_removed(t.spark):
        bow = stage(X.doc2bow(_docs(t), "doc_id", F.col("words")))
        terms = stage(X.term_stats(bow).where("df >= 2"))
        entries = stage(X.tfidf(bow, "doc_id", terms, t.documents.select(F.count("*")).scalar()).select("doc_id", "term", "value"))
        unstage(bow, terms)
    vectors, _ = SV.truncated_svd(entries, "doc_id", 8)
    return vectors.select("doc_id", F.posexplode("vector").alias("axis", "x"))


@query("ft_pca2")
def _(t: Tables):
    return M.pca_axes(C.centroid_table(W.vectors(t), "label", "num"), "cluster", "num")


@query("ft_word_vectors")
def _(t: Tables):
    return M.word_vectors(_docs(t), "doc_id", "words", 16).select("doc_id", F.posexplode("vector").alias("axis", "x"))


@query("ml_kmeans")
def _(t: Tables):
    return M.k_means(W.vectors(t), "vec_id", "num", 10).select("vec_id", "cluster")


@query("ml_gmm")
def _(t: Tables):
    return M.mixture_sweep(W.vectors(t), "num", [2, 3, 4])


@query("ml_dbscan", """
WITH RECURSIVE e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS MATERIALIZED (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM e),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, sum((a.z - b.z) * (a.z - b.z)) AS d FROM z a JOIN z b USING (i) GROUP BY ALL HAVING d <= 85.5625),
core AS MATERIALIZED (SELECT a AS c FROM near GROUP BY a HAVING count(*) >= 4),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT c AS a, c AS root FROM core UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.a WHERE reach.root < links.b),
roots AS (SELECT a, min(root) AS root FROM reach GROUP BY a),
border AS (SELECT near.a, arg_min(root, (d, near.b)) AS root FROM near JOIN roots ON roots.a = near.b WHERE near.a NOT IN (FROM core) GROUP BY near.a),
found AS (SELECT a, root, TRUE AS is_core FROM roots UNION ALL SELECT a, root, FALSE FROM border),
numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots))
SELECT vec_id, coalesce(cluster, -1) AS cluster, coalesce(is_core, FALSE) AS is_core
FROM embeddings LEFT JOIN found ON a = vec_id LEFT JOIN numbers USING (root)""")
def _(t: Tables):
    return D.dbscan(M.standardise(W.vectors(t), "num", "z"), "vec_id", "z", 9.25, 4)


@query("ml_label_tree")
def _(t: Tables):
    return M.label_tree(W.vectors(t), "vec_id", "num", 8)


def _mixed(t: Tables):
    i = F.col("vec_id")
    return W.vectors(t).select("vec_id", "label", "num", F.array(i % 5, i % 2, i % 4, i % 3).alias("cat"))


@query("ml_kprototypes")
def _(t: Tables):
    df = _mixed(t)
    model = C.k_prototypes(df, "vec_id", "label", 10)
    return C.assign(df, model, F.col("num"), F.col("cat")).select("vec_id", "hard_cluster", "soft_cluster", "cluster_weight")


@query("ml_incremental_update")
def _(t: Tables):
    df = _mixed(t)
    old, new = df.where(F.col("vec_id") % 4 != 0), df.where(F.col("vec_id") % 4 == 0)
    model = C.centroid_table(old, "label", "num", "cat")
    assigned, centroids, _ = C.incremental_update(new, "vec_id", "num", "cat", model, C.statistics_of(old, "label", "num", "cat"), 0.12)
    return assigned.join(centroids.select("cluster", "n"), "cluster").select("vec_id", "cluster", "is_new", "n")


@query("ml_anomaly_reconstruction")
def _(t: Tables):
    df = W.vectors(t)
    return M.anomalies(df, df, "vec_id", "num", 8, 0.95)


@query("ml_anomaly_auc")
def _(t: Tables):
    """AUC and average precision of the reconstruction cosine, two labels being the unusual ones."""
    df = W.vectors(t)
    scored = M.reconstruction_cosine(df.where("label < 8"), df, "vec_id", "num", 8).join(df.select("vec_id", (F.col("label") >= 8).cast("int").alias("y")), "vec_id")
    return EV.auc_ap(scored.withColumn("s", -F.col("cosine")), "s", "y")


@query("ml_svm_calibrated")
def _(t: Tables):
    train, test = M.split_rows(W.vectors(t), "vec_id")
    return M.calibrated_svm(train, test, "vec_id", "label", "num", how="isotonic")


@query("ml_svm_platt")
def _(t: Tables):
    train, test = M.split_rows(W.vectors(t), "vec_id")
    return M.calibrated_svm(train, test, "vec_id", "label", "num", how="sigmoid")


@query("ml_baseline_classifiers")
def _(t: Tables):
    return M.compare_baselines(W.vectors(t), "vec_id", "label", "num")


@query("ml_ordinal")
def _(t: Tables):
    train, test = M.split_rows(W.vectors(t).withColumn("level", F.floor(F.col("label") / 2).cast("int")), "vec_id")
    return M.ordinal(train, test, "vec_id", "level", "num", 5, 5)


def _label_sets(t: Tables):
    flags = F.filter(F.array(*[F.when(F.col("num")[i] > 0, f"L{i}") for i in range(7)]), lambda x: x.isNotNull())
    return W.vectors(t).withColumn("labels", flags)


@query("ml_ovr_multilabel")
def _(t: Tables):
    train, test = M.split_rows(_label_sets(t), "vec_id")
    return M.one_vs_rest_labels(train, test, "vec_id", "labels", "num")


@query("ml_classifier_chain")
def _(t: Tables):
    train, test = M.split_rows(_label_sets(t), "vec_id")
    return M.classifier_chains(train, test, "vec_id", "labels", "num")


@query("tune_param_sweep")
def _(t: Tables):
    return M.parameter_sweep(W.vectors(t), "label", "num", [0.0, 0.1], [3, 6])


@query("tune_topics")
def _(t: Tables):
    tokens = T.tokens(F.col("text"))
    columns = {"words": tokens, "distinct words": F.array_distinct(tokens), "word pairs": X.word_grams(tokens, 2, 2)}
    return SW.topic_sweep(t.texts, "doc_id", columns, [20, 50, 150])


@query("tune_clusters")
def _(t: Tables):
    return SW.cluster_sweep(_mixed(t), "vec_id", "label", [2, 4, 6, 8, 10])


@query("tune_tfidf")
def _(t: Tables):
    return SW.tfidf_sweep(t.texts, "doc_id", T.tokens(F.col("text")), "lang", [50, 500, 5000])
