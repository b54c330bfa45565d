"""The analysis API on documents joined to their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.analysis.api import Corpus
from declara.functions import text as T
from declara.operators import clusters as C
from declara.plans import views as W
from declara.plans.clustering import ASSIGN_SQL
from declara.plans.registry import Tables, query
from declara.plans.views import r6


def _corpus(t: Tables) -> Corpus:
    """Documents that have a vector, with their topics and their nearest class centroid."""
    words = T.tokens(F.col("text"))
    docs = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit("R"), "doc_id").alias("declaration"),
        F.concat(F.lit("R"), "doc_id", F.lit(" - "), "source").alias("doc_name"), F.col("lang").alias("family"), "text",
        words.alias("words"), F.size(words).cast("long").alias("n_words"),
    )
    model = C.centroid_table(W.vectors(t), "label", "num")
    assigned = C.assign(W.vectors(t).select(F.col("vec_id").alias("row_id"), "num"), model, F.col("num"), C.no_categories()).drop("num")
    weights = W.topic_rows(t).select(F.col("vec_id").alias("row_id"), "topic", "weight")
    vectors = W.vectors(t).select(F.col("vec_id").alias("row_id"), "num")
    return Corpus(docs, weights, assigned, model, vectors)


def _sections(df: DataFrame):
    return df.select("section", "key", r6("value").alias("value"))


CORPUS_SQL = f"""
{W.DISTANCES.strip()},
hard AS (SELECT vec_id AS row_id, arg_min(cluster, (d, cluster)) AS cluster FROM distances GROUP BY vec_id),
docs AS (SELECT doc_id AS row_id, 'R' || doc_id || ' - ' || source AS doc_name, lang AS family, {W.sql_tokens('text')} AS words
  FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
fam AS (SELECT cluster, family, count(*) AS n FROM docs JOIN hard USING (row_id) GROUP BY ALL)"""


@query("api_cluster_families", f"""
WITH {CORPUS_SQL}
SELECT cluster, family, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS score, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, family) AS rank FROM fam""")
def _(t: Tables):
    return _corpus(t).cluster_families().select("cluster", "family", "n", r6("score").alias("score"), "rank")


@query("api_family_clusters", f"""
WITH {CORPUS_SQL}, s AS (SELECT cluster, family, n, n / sum(n) OVER (PARTITION BY cluster) AS score FROM fam)
SELECT family, cluster, n, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, cluster) AS rank FROM s WHERE family = 'fr'""")
def _(t: Tables):
    return _corpus(t).family_clusters("fr").select("family", "cluster", "n", r6("score").alias("score"), "rank")


@query("api_cluster_wordcloud", f"""
WITH {CORPUS_SQL}, c AS (SELECT cluster, term, count(*) AS n FROM (SELECT row_id, unnest(words) AS term FROM docs) JOIN hard USING (row_id) GROUP BY ALL)
SELECT cluster, term, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 25""")
def _(t: Tables):
    return _corpus(t).cluster_wordcloud()


@query("api_topic_weights", f"""
WITH {W.TOPIC_ROWS}, n AS (SELECT doc_id, len({W.sql_tokens('text')}) AS n FROM documents),
m AS (SELECT topic, sum(weight * n) AS mass FROM topic_rows JOIN n ON doc_id = vec_id GROUP BY topic)
SELECT topic, row_number() OVER (ORDER BY mass DESC, topic) AS display, round(mass / (SELECT sum(mass) FROM m), 6) AS weight FROM m""")
def _(t: Tables):
    return _corpus(t).topic_weights().select(F.col("topic").cast("long").alias("topic"), "display", r6("weight").alias("weight"))


# -- complete summaries ---------------------------------------------------------------------

# One row per figure of every cluster; ``part`` is the section.
SUMMARY_SQL = CORPUS_SQL + ASSIGN_SQL.removeprefix(W.DISTANCES) + """,
topic_rows AS (SELECT vec_id, i AS topic, abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id) AS weight FROM entries),
sizes AS (SELECT cluster, count(*) AS n FROM hard GROUP BY cluster),
held AS (SELECT soft_cluster AS cluster, vec_id, cluster_weight FROM assigned WHERE vec_id IN (SELECT row_id FROM docs)
  QUALIFY row_number() OVER (PARTITION BY soft_cluster ORDER BY round(cluster_weight, 9) DESC, vec_id) <= 100),
tops AS (SELECT cluster, topic, count(*) AS n FROM topic_rows JOIN hard ON row_id = vec_id WHERE weight > 0.1 GROUP BY ALL),
terms AS (SELECT cluster, term, count(*) AS n FROM (SELECT row_id, unnest(words) AS term FROM docs) JOIN hard USING (row_id) GROUP BY cluster, term
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) <= 25),
summary AS (
  SELECT cluster, 'weight' AS section, n::VARCHAR AS key, round(100 * n / (SELECT sum(n) FROM sizes), 2)::DOUBLE AS value FROM sizes
  UNION ALL SELECT cluster, 'document', vec_id::VARCHAR, cluster_weight FROM held
  UNION ALL SELECT cluster, 'topic', topic::VARCHAR, n / sum(n) OVER (PARTITION BY cluster) FROM tops
  UNION ALL SELECT cluster, 'family', family, n / sum(n) OVER (PARTITION BY cluster) FROM fam
  UNION ALL SELECT cluster, 'word', term, n FROM terms)"""


@query("api_cluster_complete", f"WITH {SUMMARY_SQL} SELECT section, key, round(value, 6) AS value FROM summary WHERE cluster = 3")
def _(t: Tables):
    return _sections(_corpus(t).cluster_complete(3))


@query("api_compare_clusters", f"""
WITH {SUMMARY_SQL}, s AS (SELECT * FROM summary WHERE section NOT IN ('weight', 'document'))
SELECT section, key, round(a.value, 6) AS a, round(b.value, 6) AS b
FROM (SELECT * FROM s WHERE cluster = 1) a FULL JOIN (SELECT * FROM s WHERE cluster = 2) b USING (section, key)""")
def _(t: Tables):
    return _corpus(t).compare_clusters(1, 2).select("section", "key", r6("a").alias("a"), r6("b").alias("b"))


TOPIC_MASS_SQL = f"""
{W.TOPIC_ROWS}, docs AS (SELECT doc_id AS row_id, {W.sql_tokens('text')} AS words FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
m AS (SELECT topic, sum(weight * len(words)) AS mass FROM topic_rows JOIN docs ON row_id = vec_id GROUP BY topic),
topic_weight AS (SELECT topic, mass / (SELECT sum(mass) FROM m) AS weight FROM m)"""


@query("api_review_sample", f"""
WITH {TOPIC_MASS_SQL}, q AS (SELECT quantile_cont(weight, 0.45) AS lo, quantile_cont(weight, 0.55) AS hi FROM topic_weight),
r AS (SELECT 'best' AS section, topic::VARCHAR AS key, weight AS value FROM topic_weight QUALIFY row_number() OVER (ORDER BY weight DESC, topic) <= 15
  UNION ALL SELECT 'worst', topic::VARCHAR, weight FROM topic_weight QUALIFY row_number() OVER (ORDER BY weight, topic) <= 15
  UNION ALL SELECT 'middle', topic::VARCHAR, weight FROM topic_weight, q WHERE weight > lo AND weight < hi
  UNION ALL SELECT 'document', row_id::VARCHAR, len(words) FROM docs QUALIFY row_number() OVER (ORDER BY md5('7:' || row_id), row_id) <= 20)
SELECT section, key, round(value, 6) AS value FROM r""")
def _(t: Tables):
    corpus = _corpus(t)
    return _sections(corpus.review_sample(corpus.topic_weights(), "topic", "weight", 15, 20))


@query("api_document_complete", f"""
WITH {SUMMARY_SQL}
SELECT 'words' AS section, doc_name AS key, len(words)::DOUBLE AS value FROM docs WHERE row_id = 20
UNION ALL SELECT 'topic', topic::VARCHAR, round(weight, 6) FROM (SELECT * FROM topic_rows WHERE vec_id = 20 ORDER BY weight DESC, topic LIMIT 5)
UNION ALL SELECT 'cluster', soft_cluster::VARCHAR, round(cluster_weight, 6) FROM assigned WHERE vec_id = 20 AND vec_id IN (SELECT row_id FROM docs)""")
def _(t: Tables):
    return _sections(_corpus(t).document_complete("R20"))


# -- the topic model and the clustering as a whole -----------------------------------------------

TOPWORDS_SQL = TOPIC_MASS_SQL + """,
bag AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(words) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT topic, term, sum(tf * weight) AS freq FROM bag JOIN topic_rows ON vec_id = row_id GROUP BY ALL),
top AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(freq, 9) DESC, term) AS rank FROM freq QUALIFY rank <= 20)"""

TOPIC_MODEL_SQL = TOPWORDS_SQL + """,
seen AS (SELECT row_id, topic, rank FROM bag JOIN top USING (term)),
single AS (SELECT topic, rank, count(*) AS d FROM seen GROUP BY ALL),
co AS (SELECT x.topic, x.rank AS i, y.rank AS j, count(*) AS d FROM seen x JOIN seen y ON x.row_id = y.row_id AND x.topic = y.topic AND y.rank < x.rank GROUP BY ALL),
pairs AS (SELECT x.topic, x.rank AS i, y.rank AS j FROM top x JOIN top y ON x.topic = y.topic AND y.rank < x.rank),
coherence AS (SELECT p.topic, avg(ln((coalesce(co.d, 0) + 1) / s.d)) AS coherence
  FROM pairs p LEFT JOIN co USING (topic, i, j) JOIN single s ON s.topic = p.topic AND s.rank = p.j GROUP BY p.topic),
sets AS (SELECT topic, list(term) AS ts FROM top GROUP BY topic)"""


@query("api_topic_topwords", f"WITH {TOPWORDS_SQL} SELECT topic, term, rank FROM top")
def _(t: Tables):
    return _corpus(t).topic_topwords().select(F.col("topic").cast("long").alias("topic"), "term", "rank")


TOPIC_DOCS_SQL = TOPIC_MASS_SQL + """,
sized AS (SELECT row_id, len(words) AS n_words FROM docs),
kept AS (SELECT topic, row_id, weight FROM topic_rows JOIN sized ON row_id = vec_id WHERE n_words > (SELECT quantile_cont(n_words, 0.25) FROM sized)),
cut AS (SELECT topic, quantile_cont(weight, 0.75) AS cut FROM kept GROUP BY topic),
topic_docs AS (SELECT topic, 'R' || row_id AS declaration, row_id, weight FROM kept JOIN cut USING (topic) WHERE weight >= cut),
bag AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(words) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT topic, term, sum(tf * weight) AS freq FROM bag JOIN topic_rows ON vec_id = row_id GROUP BY ALL),
cloud AS (SELECT topic, term, freq, freq / total AS lift, row_number() OVER (PARTITION BY topic ORDER BY round(freq, 9) DESC, term) AS rank
  FROM freq JOIN (SELECT term, sum(tf) AS total FROM bag GROUP BY term) USING (term) QUALIFY rank <= 30)"""


@query("api_topic_documents", f"WITH {TOPIC_DOCS_SQL} SELECT topic, declaration, row_id, round(weight, 6) AS weight FROM topic_docs")
def _(t: Tables):
    return _corpus(t).topic_documents().select(F.col("topic").cast("long").alias("topic"), "declaration", "row_id", r6("weight").alias("weight"))


@query("api_topic_wordcloud", f"WITH {TOPIC_DOCS_SQL} SELECT topic, term, round(freq, 6) AS freq, round(lift, 6) AS lift, rank FROM cloud")
def _(t: Tables):
    cloud = _corpus(t).topic_wordcloud()
    return cloud.select(F.col("topic").cast("long").alias("topic"), "term", r6("freq").alias("freq"), r6("lift").alias("lift"), "rank")


@query("api_topic_complete", f"""
WITH {TOPIC_DOCS_SQL}, r AS (
  SELECT 'weight' AS section, display::VARCHAR AS key, weight AS value, topic FROM (SELECT topic, weight, row_number() OVER (ORDER BY weight DESC, topic) AS display FROM topic_weight)
  UNION ALL SELECT 'document', row_id::VARCHAR, weight, topic FROM topic_docs UNION ALL SELECT 'word', term, freq, topic FROM cloud)
SELECT section, key, round(value, 6) AS value FROM r WHERE topic = 5""")
def _(t: Tables):
    return _sections(_corpus(t).topic_complete(5))


@query("api_topic_model", f"""
WITH {TOPIC_MODEL_SQL}, r AS (
  SELECT 'nb_topics' AS section, 'topics' AS key, count(*)::DOUBLE AS value FROM topic_weight
  UNION ALL SELECT 'coherence', topic::VARCHAR, coherence FROM coherence
  UNION ALL SELECT 'weight', topic::VARCHAR, weight FROM topic_weight
  UNION ALL SELECT 'distance', x.topic || '|' || y.topic, 1 - len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts)))
    FROM sets x JOIN sets y ON x.topic < y.topic)
SELECT section, key, round(value, 6) AS value FROM r""")
def _(t: Tables):
    return _sections(_corpus(t).topic_model_complete())


@query("api_cluster_model", f"""
WITH {CORPUS_SQL}, e AS (SELECT vec_id, h.cluster, i, x FROM entries JOIN hard h ON row_id = vec_id),
cc AS (SELECT cluster, i, avg(x) AS c FROM e GROUP BY ALL),
sq AS (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS s FROM e JOIN cc USING (cluster, i) GROUP BY ALL),
m AS (SELECT cluster, count(*) AS n, sum(s) AS within, avg(sqrt(s)) AS spread FROM sq GROUP BY cluster),
g AS (SELECT i, avg(x) AS g FROM e GROUP BY i),
b AS (SELECT cluster, sum((c - g) * (c - g)) AS q FROM cc JOIN g USING (i) GROUP BY cluster),
tot AS (SELECT count(*) AS k, sum(n) AS n, sum(within) AS w, sum(n * q) AS b FROM m JOIN b USING (cluster)),
dd AS (SELECT p.cluster AS a, q.cluster AS b, sum((p.c - q.c) * (p.c - q.c)) AS d FROM cc p JOIN cc q USING (i) WHERE p.cluster <> q.cluster GROUP BY ALL),
db AS (SELECT a, max((mx.spread + my.spread) / sqrt(d)) AS r FROM dd JOIN m mx ON mx.cluster = a JOIN m my ON my.cluster = b GROUP BY a),
r AS (
  SELECT 'nb_clusters' AS section, 'clusters' AS key, count(DISTINCT cluster)::DOUBLE AS value FROM centres
  UNION ALL SELECT 'score', 'calinski_harabasz', (b / (k - 1)) / (w / (n - k)) FROM tot
  UNION ALL SELECT 'score', 'davies_bouldin', avg(r) FROM db
  UNION ALL SELECT 'weight', cluster::VARCHAR, round(100 * n / sum(n) OVER (), 2) FROM m
  UNION ALL SELECT 'distance', x.cluster || '|' || y.cluster, sum((x.c - y.c) * (x.c - y.c)) FROM centres x JOIN centres y USING (i) WHERE x.cluster < y.cluster GROUP BY x.cluster, y.cluster)
SELECT section, key, round(value, 6) AS value FROM r""")
def _(t: Tables):
    return _sections(_corpus(t).cluster_model_complete())


@query("api_cluster_axes")
def _(t: Tables):
    return _corpus(t).cluster_axes()
