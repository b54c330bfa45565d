"""Topics, clusters and their scores on the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara.functions import text as T
from declara.functions import vectors as V
from declara.operators import aggregations as A
from declara.operators import clusters as C
from declara.operators import evaluate as EV
from declara.operators import quantiles as Q
from declara.operators import topics as TP
from declara.plans import views as W
from declara.plans.registry import Tables, query
from declara.plans.views import r6


def _long(c: str):
    return F.col(c).cast("long").alias(c)


def _model(t: Tables):
    """Class means of the embeddings as a centroid table."""
    return C.centroid_table(W.vectors(t), "label", "num")


# -- topics ------------------------------------------------------------------------------


@query("flt_significant_topic", f"""
WITH {W.TOPIC_ROWS} SELECT vec_id, topic, round(weight, 6) AS weight FROM topic_rows WHERE weight > 0.03""")
def _(t: Tables):
    return TP.significant(W.topic_rows(t), 0.03).select("vec_id", _long("topic"), r6("weight").alias("weight"))


TOPIC_WEIGHT_SQL = W.TOPIC_ROWS + """,
topic_weight AS (SELECT topic, sum(weight) / (SELECT sum(weight) FROM topic_rows) AS weight FROM topic_rows GROUP BY topic)"""


@query("agg_topic_weight", f"WITH {TOPIC_WEIGHT_SQL} SELECT topic, round(weight, 6) AS weight FROM topic_weight")
def _(t: Tables):
    return TP.topic_weight(W.topic_rows(t)).select(_long("topic"), r6("weight").alias("weight"))


@query("ml_topic_display_order", f"""
WITH {TOPIC_WEIGHT_SQL} SELECT topic, row_number() OVER (ORDER BY weight DESC, topic) AS display, round(weight, 6) AS weight FROM topic_weight""")
def _(t: Tables):
    return TP.display_order(TP.topic_weight(W.topic_rows(t))).select(_long("topic"), "display", r6("weight").alias("weight"))


@query("win_doc_topics", f"""
WITH {W.TOPIC_ROWS} SELECT vec_id, topic, round(weight, 6) AS weight, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, topic) AS rank
FROM topic_rows QUALIFY rank <= 5""")
def _(t: Tables):
    top = TP.document_topics(W.topic_rows(t), "vec_id")
    return top.select("vec_id", _long("topic"), r6("weight").alias("weight"), "rank")


@query("win_topic_docs", f"""
WITH {W.TOPIC_ROWS},
rows AS (SELECT r.*, d.n_chars AS words, d.source AS declaration FROM topic_rows r JOIN documents d ON d.doc_id = r.vec_id),
kept AS (SELECT * FROM rows WHERE words > (SELECT quantile_cont(words, 0.25) FROM (SELECT DISTINCT vec_id, words FROM rows))),
cut AS (SELECT topic, quantile_cont(weight, 0.75) AS cut FROM kept GROUP BY topic),
ups AS (SELECT * FROM kept JOIN cut USING (topic) WHERE weight >= cut)
SELECT topic, declaration, vec_id, round(weight, 6) AS weight FROM ups
QUALIFY row_number() OVER (PARTITION BY topic, declaration ORDER BY weight DESC, vec_id) = 1""")
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("n_chars").alias("words"), F.col("source").alias("declaration"))
    long = W.topic_rows(t).join(docs, "vec_id")
    out = TP.topic_documents(long, "vec_id", "declaration", "words")
    return out.select(_long("topic"), "declaration", "vec_id", r6("weight").alias("weight"))


@query("agg_cluster_topics", f"""
WITH {W.TOPIC_ROWS}, c AS (SELECT label AS cluster, topic, count(*) AS n FROM topic_rows WHERE weight > 0.03 GROUP BY label, topic),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic) AS rank FROM c QUALIFY rank <= 10)
SELECT cluster, topic, n, rank, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS score FROM k""")
def _(t: Tables):
    rows = W.topic_rows(t).withColumnRenamed("label", "cluster")
    return TP.cluster_topics(rows, "cluster", 0.03, 10).select("cluster", _long("topic"), "n", "rank", r6("score").alias("score"))


@query("agg_topic_wordcloud", f"""
WITH {W.BOW}, {W.TOPIC_ROWS},
f AS (SELECT topic, term, sum(tf * weight) AS freq FROM bow JOIN topic_rows ON vec_id = doc_id GROUP BY topic, term),
tot AS (SELECT term, sum(tf) AS total FROM bow WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY term)
SELECT topic, term, round(freq, 6) AS freq, round(freq / total, 6) AS lift,
  row_number() OVER (PARTITION BY topic ORDER BY round(freq, 9) DESC, term) AS rank FROM f JOIN tot USING (term) QUALIFY rank <= 30""")
def _(t: Tables):
    docs = t.texts.select("doc_id", T.tokens(F.col("text")).alias("words"))
    weights = W.doc_topics(t).select(F.col("vec_id").alias("doc_id"), "weights")
    best = TP.expected_top_words(docs.join(weights, "doc_id"), "words", "weights", 30)
    return best.select(_long("topic"), "term", r6("freq").alias("freq"), r6("lift").alias("lift"), "rank")


# -- centroids and distances ----------------------------------------------------------------


@query("agg_cluster_centers", f"WITH {W.CENTRES} SELECT cluster, i, round(c, 6) AS c FROM centres")
def _(t: Tables):
    centres = _model(t)
    return centres.select("cluster", F.posexplode("num").alias("i", "c")).select("cluster", _long("i"), r6("c").alias("c"))


@query("agg_class_centroid", f"""
WITH {W.CENTRES}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT cluster, n, round(sqrt(sum(c * c)), 6) AS norm FROM centres JOIN n ON label = cluster GROUP BY cluster, n""")
def _(t: Tables):
    return _model(t).select("cluster", "n", r6(V.norm(F.col("num"))).alias("norm"))


@query("jn_doc_centroid", f"WITH {W.DISTANCES} SELECT vec_id, cluster, round(d, 6) AS d FROM distances")
def _(t: Tables):
    model = C.prepared(_model(t))
    d = C.numbered(C.distances(F.col("num"), C.no_categories(), model), model)
    return W.vectors(t).select("vec_id", F.inline(d)).select("vec_id", "cluster", r6("d").alias("d"))


@query("fn_vector_ops", f"""
WITH {W.CENTRES}
SELECT vec_id, round(sum(x * c), 6) AS dot, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) AS cosine,
  round(sum((x - c) * (x - c)), 6) AS squared, count(*) FILTER (sign(x) <> sign(c))::INT AS hamming
FROM entries JOIN centres USING (i) WHERE label = cluster GROUP BY vec_id""")
def _(t: Tables):
    dim = _model(t).select(F.col("cluster").alias("label"), F.col("num").alias("c"))
    x, c = F.col("num"), F.col("c")
    signs = [F.transform(v, lambda e: F.signum(e)) for v in (x, c)]
    return W.vectors(t).join(dim, "label").select(
        "vec_id", r6(V.dot(x, c)).alias("dot"), r6(V.norm(x)).alias("norm"), r6(V.cosine(x, c)).alias("cosine"),
        r6(V.squared_distance(x, c)).alias("squared"), V.hamming(*signs).alias("hamming"),
    )


PAIRS_SQL = W.CENTRES + """,
pairs AS (SELECT x.cluster AS a, y.cluster AS b, sum((x.c - y.c) * (x.c - y.c)) AS mixed,
  CASE WHEN x.cluster = y.cluster THEN 0 ELSE 1 - sum(x.c * y.c) / (sqrt(sum(x.c * x.c)) * sqrt(sum(y.c * y.c))) END AS cosine
  FROM centres x JOIN centres y USING (i) GROUP BY x.cluster, y.cluster)"""


@query("jn_centroid_pairs", f"WITH {PAIRS_SQL} SELECT a, b, round(mixed, 6) AS dist FROM pairs")
def _(t: Tables):
    return C.centroid_pairs(_model(t)).select("a", "b", r6("dist").alias("dist"))


@query("ml_cluster_distance", f"WITH {PAIRS_SQL} SELECT a, b, round(cosine, 6) AS dist FROM pairs")
def _(t: Tables):
    return C.centroid_pairs(_model(t), "cosine").select("a", "b", r6("dist").alias("dist"))


@query("win_furthest_closest", f"""
WITH {PAIRS_SQL}, once AS (SELECT * FROM pairs WHERE a < b)
SELECT a, b, round(mixed, 6) AS dist, CASE WHEN mixed = (SELECT max(mixed) FROM once) THEN 'furthest' ELSE 'closest' END AS kind FROM once
WHERE mixed = (SELECT max(mixed) FROM once) OR mixed = (SELECT min(mixed) FROM once WHERE mixed > 0)""")
def _(t: Tables):
    return C.extreme_pairs(C.centroid_pairs(_model(t))).select("a", "b", r6("dist").alias("dist"), "kind")


@query("win_most_least_representative", f"""
WITH {W.CENTRES},
sims AS (SELECT vec_id, cluster, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS sim FROM entries JOIN centres USING (i)
  WHERE label = cluster GROUP BY vec_id, cluster),
long_docs AS (SELECT s.* FROM sims s JOIN documents d ON d.doc_id = vec_id WHERE n_chars > (SELECT quantile_cont(n_chars, 0.25) FROM documents))
SELECT cluster, arg_max(vec_id, (sim, -vec_id)) AS most, round(max(sim), 6) AS most_sim, arg_min(vec_id, (sim, vec_id)) AS least, round(min(sim), 6) AS least_sim
FROM long_docs GROUP BY cluster""")
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "n_chars")
    cut = Q.quantile_column(docs, [], "n_chars", 0.25, "q").select("q").scalar()
    long_docs = docs.where(F.col("n_chars") > cut).select("vec_id")
    df = W.vectors(t).join(long_docs, "vec_id", "left_semi")
    out = C.representative(df, "vec_id", "label", "num", _model(t))
    return out.select("cluster", "most", r6("most_sim").alias("most_sim"), "least", r6("least_sim").alias("least_sim"))


# -- memberships ------------------------------------------------------------------------------


WEIGHTS_SQL = W.DISTANCES + """,
weights AS (SELECT vec_id, label, cluster, d, pow(d, -2) / sum(pow(d, -2)) OVER (PARTITION BY vec_id) AS w FROM distances)"""


@query("ml_soft_weights", f"WITH {WEIGHTS_SQL} SELECT vec_id, cluster, round(w, 6) AS w FROM weights")
def _(t: Tables):
    df = C.with_memberships(W.vectors(t), _model(t), F.col("num"), C.no_categories())
    return df.select("vec_id", F.inline("members")).select("vec_id", "cluster", r6("weight").alias("w"))


ASSIGN_SQL = WEIGHTS_SQL + """,
assigned AS (SELECT vec_id, label, arg_min(cluster, (d, cluster)) AS hard_cluster, arg_max(cluster, (w, -cluster)) AS soft_cluster, max(w) AS cluster_weight
  FROM weights GROUP BY vec_id, label)"""


def _assigned(t: Tables):
    return C.assign(W.vectors(t), _model(t), F.col("num"), C.no_categories())


@query("ml_assign_clusters", f"""
WITH {ASSIGN_SQL} SELECT vec_id, hard_cluster, soft_cluster, round(cluster_weight, 6) AS cluster_weight FROM assigned""")
def _(t: Tables):
    return _assigned(t).select("vec_id", "hard_cluster", "soft_cluster", r6("cluster_weight").alias("cluster_weight"))


@query("ml_novelty", f"""
WITH {ASSIGN_SQL} SELECT vec_id, round(cluster_weight, 6) AS cluster_weight FROM assigned WHERE cluster_weight <= 0.105""")
def _(t: Tables):
    return C.novel(_assigned(t), 0.105).select("vec_id", r6("cluster_weight").alias("cluster_weight"))


@query("win_cluster_docs", f"""
WITH {ASSIGN_SQL}
SELECT soft_cluster, vec_id, round(cluster_weight, 6) AS cluster_weight,
  row_number() OVER (PARTITION BY soft_cluster ORDER BY round(cluster_weight, 9) DESC, vec_id) AS rank FROM assigned QUALIFY rank <= 100""")
def _(t: Tables):
    top = A.top_k(_assigned(t), ["soft_cluster"], [F.round("cluster_weight", 9).desc(), F.col("vec_id")], 100)
    return top.select("soft_cluster", "vec_id", r6("cluster_weight").alias("cluster_weight"), "rank")


@query("win_topk_clusters", f"""
WITH {WEIGHTS_SQL}, k AS (SELECT vec_id, cluster, w, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, cluster) AS rank FROM weights QUALIFY rank <= 4)
SELECT vec_id, cluster, rank, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS proba FROM k""")
def _(t: Tables):
    df = C.with_memberships(W.vectors(t), _model(t), F.col("num"), C.no_categories(), k=4)
    return C.best_members(df, "vec_id").select("vec_id", "cluster", "rank", r6("proba").alias("proba"))


NEAREST_SQL = """
entries AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
centres AS (SELECT label AS cluster, i, avg(x) AS c FROM entries WHERE vec_id % 2 = 0 GROUP BY ALL),
cos AS (SELECT vec_id, label, cluster, sum(x * c) / sqrt(sum(c * c)) AS s FROM entries JOIN centres USING (i) WHERE vec_id % 2 = 1 GROUP BY ALL),
predicted AS (SELECT vec_id, label, arg_max(cluster, (s, -cluster)) AS predicted FROM cos GROUP BY vec_id, label)"""


def _nearest(t: Tables):
    """Odd vectors classified by the class means of the even ones."""
    df = W.vectors(t)
    model = C.centroid_table(df.where(F.col("vec_id") % 2 == 0), "label", "num")
    test = df.where(F.col("vec_id") % 2 == 1)
    return test.select("vec_id", "label", C.nearest_by_cosine(F.col("num"), model).alias("predicted"))


@query("ml_nearest_centroid", f"WITH {NEAREST_SQL} SELECT vec_id, label, predicted FROM predicted")
def _(t: Tables):
    return _nearest(t)


@query("ev_accuracy", f"WITH {NEAREST_SQL} SELECT count(*) AS n, round(avg((label = predicted)::INT), 6) AS accuracy FROM predicted")
def _(t: Tables):
    return EV.accuracy(_nearest(t), "label", "predicted").select("n", r6("accuracy").alias("accuracy"))


@query("ev_balanced_accuracy", f"""
WITH {NEAREST_SQL} SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT avg((label = predicted)::INT) AS r FROM predicted GROUP BY label)""")
def _(t: Tables):
    return EV.summary(_nearest(t), "label", "predicted").select(r6("balanced_accuracy").alias("balanced_accuracy"))


# -- cluster quality -------------------------------------------------------------------------------


@query("ev_calinski_davies", f"""
WITH {W.CENTRES},
sq AS (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS s FROM entries JOIN centres USING (i) WHERE label = cluster GROUP BY ALL),
m AS (SELECT cluster, count(*) AS n, sum(s) AS within, avg(sqrt(s)) AS spread FROM sq GROUP BY cluster),
g AS (SELECT i, avg(x) AS g FROM entries GROUP BY i),
b AS (SELECT cluster, sum((c - g) * (c - g)) AS q FROM centres JOIN g USING (i) GROUP BY cluster),
tot AS (SELECT count(*) AS k, sum(n) AS n, sum(within) AS w, sum(n * q) AS b FROM m JOIN b USING (cluster)),
r AS (SELECT x.cluster, max((mx.spread + my.spread) / sqrt(dd.d)) AS r FROM (SELECT DISTINCT cluster FROM m) x
  JOIN (SELECT p.cluster AS a, q.cluster AS b, sum((p.c - q.c) * (p.c - q.c)) AS d FROM centres p JOIN centres q USING (i) GROUP BY ALL) dd ON dd.a = x.cluster AND dd.b <> x.cluster
  JOIN m mx ON mx.cluster = dd.a JOIN m my ON my.cluster = dd.b GROUP BY x.cluster)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin FROM tot""")
def _(t: Tables):
    out = C.calinski_davies(W.vectors(t), "label", "num")
    return out.select(r6("calinski_harabasz").alias("calinski_harabasz"), r6("davies_bouldin").alias("davies_bouldin"))


@query("ev_silhouette", """
WITH entries AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
y AS (SELECT label AS cluster, i, sum(x) AS y FROM entries GROUP BY ALL),
o AS (SELECT vec_id, label, sum(x * x) AS sq FROM entries GROUP BY ALL),
c AS (SELECT label AS cluster, sum(sq) AS psi, count(*) AS n FROM o GROUP BY label),
dots AS (SELECT vec_id, cluster, sum(x * y) AS dot FROM entries JOIN y USING (i) GROUP BY ALL),
d AS (SELECT o.vec_id, o.label, dots.cluster, o.sq + (psi - 2 * dot) / n AS avg_d, n FROM o JOIN dots USING (vec_id) JOIN c ON c.cluster = dots.cluster),
s AS (SELECT vec_id, max(CASE WHEN label = cluster THEN avg_d * n / (n - 1) END) AS a, min(CASE WHEN label <> cluster THEN avg_d END) AS b FROM d GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def _(t: Tables):
    return C.simplified_silhouette(W.vectors(t), "label", "num").select(r6("silhouette").alias("silhouette"))


@query("ev_group_scores", f"""
WITH {NEAREST_SQL}, scoped AS (SELECT (vec_id % 3)::VARCHAR AS scope, label, predicted FROM predicted UNION ALL SELECT 'all', label, predicted FROM predicted),
recalls AS (SELECT scope, label, count(*) AS n, avg((label = predicted)::INT) AS r FROM scoped GROUP BY ALL)
SELECT scope, CAST(sum(n) AS BIGINT) AS n, round(sum(r * n) / sum(n), 6) AS accuracy, round(avg(r), 6) AS balanced_accuracy FROM recalls GROUP BY scope""")
def _(t: Tables):
    df = _nearest(t).withColumn("scope_key", F.col("vec_id") % 3)
    return EV.group_scores(df, "label", "predicted", "scope_key").select(
        "scope", "n", r6("accuracy").alias("accuracy"), r6("balanced_accuracy").alias("balanced_accuracy")
    )


@query("ev_majority_baseline", """
SELECT max(n) AS n_majority, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)""")
def _(t: Tables):
    return A.majority_share(t.embeddings, "label").select("n_majority", "n", r6("share").alias("share"))
