"""Batch prediction: score tables of all models, corrected and ranked, with clusters and topics, up to the result row."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara import constants as K
from declara.analysis import predict as PR
from declara.operators import clusters as C
from declara.operators import predictions as P
from declara.plans import views as W
from declara.plans.clustering import WEIGHTS_SQL
from declara.plans.registry import Tables, query
from declara.plans.scoring import FILES_SQL, _files, _sql_text
from declara.plans.views import r6
from declara.runtime import stage

MODELS = ("gravité_ordinale", "gravité_binaire")


def _forms(t: Tables):
    """An order is a declaration; the document of its number is its text."""
    key = F.col("o_orderkey")
    return t.orders.join(t.documents.select("doc_id", "text"), F.col("doc_id") == key, "left").select(
        key.alias("file"), F.when(key % 2 == 0, K.PROFESSIONAL).otherwise(K.CITIZEN).alias("TYPE_DECLARANT"),
        F.when(key % 5 == 0, F.concat(F.lit("Nation_"), key % 25)).otherwise("autre").alias("LIBELLE_COMMERCIAL"),
        F.when(key % 3 == 0, F.concat(F.lit(" NATION _"), (key + 1) % 25)).alias("DM"),
        F.coalesce("text", F.lit("rien")).alias("DESCRIPTION_INCIDENT"), F.when(key % 40 == 0, "patient decede").otherwise("stable").alias("ETAT_PATIENT"),
    )


def _scores(t: Tables):
    severity = _severities(t).select("file", "model", "class", "proba")
    return W.predictions(t).select("file", "model", "class", F.round("proba", 12).alias("proba")).unionByName(severity)


def _severities(t: Tables):
    p = (F.col("o_custkey") % 97) / 97
    return t.orders.select(F.col("o_orderkey").alias("file"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("class"), x.alias("proba")) for m in MODELS for c, x in (("NULLE", p), ("SEVER", 1 - p))
    ])).alias("x")).select("file", "x.*")


def _names(t: Tables):
    """Labels of all classes: some families are virology, one consequence a false negative, some dysfunctions retired.
    A line's classes are known before anything is summed."""
    number = F.regexp_extract("class", "([0-9]+)$", 1).try_cast("int")
    name = F.when((F.col("model") == "DCO") & (number % 3 == 0), F.concat(F.lit("Virologie : "), "class")).when(
        (F.col("model") == "consequence") & (F.col("class") == "C0"), "Faux negatif").when(
        (F.col("model") == "dysfonctionnement") & (number % 11 == 0), "INACTIF").otherwise(F.concat(F.lit("label "), "class"))
    classes = W.prediction_items(t, deal=False).select("model", "class").unionByName(_severities(t).select("model", "class"))
    return stage(classes.distinct().select("model", "class", name.alias("class_name")))


def _predicted(t: Tables):
    devices = t.nation.select(F.col("n_nationkey").alias("DCO_ID"), F.col("n_name").alias("LIBELLE"))
    return PR.all_models(_scores(t), _names(t), _forms(t), devices)


PREDICT_SQL = W.PREDICTIONS + f""",
severity AS (SELECT o_orderkey AS file, m.model, class, p AS proba
  FROM (SELECT o_orderkey, 'NULLE' AS class, (o_custkey % 97) / 97 AS p FROM orders UNION ALL SELECT o_orderkey, 'SEVER', 1 - (o_custkey % 97) / 97 FROM orders) s,
  (VALUES ('gravité_ordinale'), ('gravité_binaire')) m(model)),
scores AS (SELECT file, model, class, proba FROM predictions UNION ALL SELECT file, model, class, proba FROM severity),
labelled AS (SELECT *, CASE WHEN model = 'DCO' AND class::INT % 3 = 0 THEN 'Virologie : ' || class WHEN model = 'consequence' AND class = 'C0' THEN 'Faux negatif'
  WHEN model = 'dysfonctionnement' AND substr(class, 2)::INT % 11 = 0 THEN 'INACTIF' ELSE 'label ' || class END AS class_name FROM scores),
named AS (SELECT *, row_number() OVER (PARTITION BY file, model ORDER BY proba DESC, class) AS rank FROM labelled WHERE class_name <> 'INACTIF'),
forms AS (SELECT o_orderkey AS file, o_orderkey % 2 = 0 AS professional, CASE WHEN o_orderkey % 5 = 0 THEN 'Nation_' || (o_orderkey % 25) ELSE 'autre' END AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN ' NATION _' || ((o_orderkey + 1) % 25) END AS device,
  coalesce(text, 'rien') || '. ' || CASE WHEN o_orderkey % 40 = 0 THEN 'patient decede' ELSE 'stable' END AS text
  FROM orders LEFT JOIN documents ON doc_id = o_orderkey),
ref AS (SELECT replace({W.sql_fold('n_name')}, ' ', '') AS m, max(n_nationkey) AS id FROM nation GROUP BY ALL),
decided AS (SELECT file, coalesce(a.id, b.id) AS id FROM forms LEFT JOIN ref a ON a.m = replace({W.sql_fold('label')}, ' ', '')
  LEFT JOIN ref b ON b.m = replace({W.sql_fold('device')}, ' ', '') WHERE professional AND coalesce(a.id, b.id) IS NOT NULL),
families AS (SELECT file, model, rank, class, class_name, proba FROM named WHERE model <> 'DCO' OR file NOT IN (SELECT file FROM decided)
  UNION ALL SELECT file, 'DCO', 1, id::VARCHAR, n_name, 1.0 FROM decided JOIN nation ON n_nationkey = id),
viro AS (SELECT file FROM families WHERE rank = 1 GROUP BY file HAVING max(CASE WHEN model = 'DCO' THEN starts_with(lower(class_name), 'virologie')::INT END) = 1
  AND max(CASE WHEN model = 'consequence' THEN (lower(class_name) = 'faux negatif')::INT END) = 1),
critical AS (SELECT file FROM forms WHERE regexp_matches({W.sql_fold('text')}, '{"|".join(K.DEATH_STEMS)}') UNION SELECT file FROM viro),
predicted AS (SELECT file, model, rank, class, class_name, proba FROM families WHERE NOT starts_with(model, 'gravité') OR file NOT IN (SELECT file FROM critical)
  UNION ALL SELECT file, m.model, 1, 'CRITI', 'CRITI', 1.0 FROM critical, (VALUES ('gravité_ordinale'), ('gravité_binaire')) m(model))"""


@query("api_predict_all", f"WITH {PREDICT_SQL} SELECT file, model, rank, class, class_name, round(proba, 6) AS proba FROM predicted")
def _(t: Tables):
    return _predicted(t).select("file", "model", F.col("rank").cast("long").alias("rank"), "class", "class_name", r6("proba").alias("proba"))


@query("api_predict_model", f"""
WITH {PREDICT_SQL} SELECT file, rank, class, class_name, round(100 * proba, 2) AS percent FROM predicted WHERE model = 'dysfonctionnement' AND rank <= 10""")
def _(t: Tables):
    return PR.one_model(_predicted(t), "dysfonctionnement").select("file", F.col("rank").cast("long").alias("rank"), "class", "class_name", "percent")


@query("api_predict_severity", f"""
WITH {PREDICT_SQL} SELECT file, model, rank, class, round(proba, 6) AS proba FROM predicted WHERE starts_with(model, 'gravité')""")
def _(t: Tables):
    return PR.severity(_predicted(t)).select("file", "model", F.col("rank").cast("long").alias("rank"), "class", r6("proba").alias("proba"))


def _clustered(t: Tables):
    vectors = W.vectors(t)
    names = C.centroid_table(vectors, "label", "num").select("cluster", F.concat(F.lit("groupe "), "cluster").alias("title"))
    return PR.clustering(vectors, "vec_id", F.col("num"), C.no_categories(), C.centroid_table(vectors, "label", "num"), stage(names))


def _topical(t: Tables):
    names = t.embeddings.select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("topic")).distinct()
    return PR.topics(W.topic_rows(t), "vec_id", stage(names.select("topic", F.concat(F.lit("theme "), "topic").alias("title"))))


CLUSTER_SQL = WEIGHTS_SQL + """,
kept AS (SELECT vec_id AS file, cluster, w, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, cluster) AS rank FROM weights QUALIFY rank <= 3),
clustered AS (SELECT file, 'cluster' AS model, rank, cluster::VARCHAR AS class, 'groupe ' || cluster AS class_name, w / sum(w) OVER (PARTITION BY file) AS proba FROM kept)"""


@query("api_predict_clustering", f"""
WITH {CLUSTER_SQL} SELECT file, rank, class, class_name, round(proba, 6) AS proba FROM clustered""")
def _(t: Tables):
    return _clustered(t).select("file", "rank", "class", "class_name", r6("proba").alias("proba"))


_ALL = {"DCO": (None, False), "dysfonctionnement": ("D0", False), "consequence": ("C0", True), "effet": ("E1213", True), "gravité_ordinale": (None, False),
        "gravité_binaire": (None, False), "topics": (None, False), "cluster": (None, False)}


@query("api_predict_result_rows", f"""
WITH {PREDICT_SQL}, {FILES_SQL},
{CLUSTER_SQL.strip()},
topical AS (SELECT vec_id AS file, 'topics' AS model, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, topic) AS rank, topic::VARCHAR AS class,
  'theme ' || topic AS class_name, w AS proba FROM (SELECT vec_id, i AS topic, abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id) AS w FROM entries)),
every AS (SELECT * FROM predicted UNION ALL SELECT * FROM clustered UNION ALL SELECT * FROM topical),
best AS (SELECT file, {", ".join(f"max({{'class': class, 'class_name': class_name, 'proba': round(proba, 12)}}) FILTER (model = '{m}' AND rank = {r}) AS {m}_{r}" for m in _ALL for r in (1, 2))}
  FROM every WHERE rank <= 2 GROUP BY file)
SELECT file, vigilance, {", ".join(_sql_text(m, *v) for m, v in _ALL.items())} FROM files JOIN best USING (file)""")
def _(t: Tables):
    """Every model, severity, topics and cluster of a declaration in one row."""
    columns = ["file", "model", "rank", "class", "class_name", "proba"]
    rows = _predicted(t).select(*columns).unionByName(_clustered(t).select(*columns)).unionByName(_topical(t).select(*columns))
    return P.result_rows(rows.withColumn("proba", F.round("proba", 12)), _files(t))
