"""Prediction rules, evaluation, ensembles and label codes, mostly on orders as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import vectors as V
from declara.operators import aggregations as A
from declara.operators import clusters as C
from declara.operators import evaluate as EV
from declara.operators import joins as J
from declara.operators import labels as L
from declara.operators import predictions as P
from declara.plans import views as W
from declara.plans.registry import Tables, query
from declara.plans.relational import PAIRS_SQL, truth_pairs
from declara.plans.textual import DEATH_SQL, _death_text
from declara.plans.views import r6

# -- picking and naming classes -----------------------------------------------------------


@query("win_skip_default_class", f"""
WITH {W.PREDICTIONS}
SELECT file, CASE WHEN c1 = 'E1213' AND c2 IS NOT NULL THEN c2 ELSE c1 END AS class,
  round(CASE WHEN c1 = 'E1213' AND c2 IS NOT NULL THEN p2 ELSE p1 END, 6) AS proba
FROM (SELECT file, max(class) FILTER (rank = 1) AS c1, max(class) FILTER (rank = 2) AS c2,
  max(proba) FILTER (rank = 1) AS p1, max(proba) FILTER (rank = 2) AS p2 FROM ranked WHERE model = 'effet' GROUP BY file)""")
def _(t: Tables):
    effects = W.ranked(t, 2).where(F.col("model") == "effet")
    return P.skip_default(effects, ["file"], K.DEFAULT_EFFECT).select("file", "class", r6("proba").alias("proba"))


FILES_SQL = "files AS (SELECT o_orderkey AS file, CASE WHEN o_orderstatus = 'F' THEN 'Réactovigilance' ELSE 'Matériovigilance' END AS vigilance FROM orders)"


def _files(t: Tables):
    vigilance = F.when(F.col("o_orderstatus") == "F", "Réactovigilance").otherwise("Matériovigilance")
    return t.orders.select(F.col("o_orderkey").alias("file"), vigilance.alias("vigilance"))


def _sql_text(model: str, default: str | None, reacto: bool) -> str:
    skip = "false" if default is None else f"c1.class = '{default}' AND c2.class IS NOT NULL" + (
        " AND lower(vigilance) IN ('réactovigilance', 'reactovigilance')" if reacto else "")
    skip = skip.replace("c1", f"{model}_1").replace("c2", f"{model}_2")
    one, two = f"{model}_1", f"{model}_2"
    return (
        f"CASE WHEN {skip} THEN {two}.class ELSE {one}.class END AS {model}_class, "
        f"CASE WHEN {skip} THEN {two}.class_name || '  (' || round({two}.proba, 3) || ')' ELSE {one}.class_name || '  (' || round({one}.proba, 3) || ')' END AS {model}"
    )


_RESULT = {"DCO": (None, False), "dysfonctionnement": ("D0", False), "consequence": ("C0", True), "effet": ("E1213", True)}


@query("post_result_row", f"""
WITH {W.PREDICTIONS}, {FILES_SQL},
best AS (SELECT file, {", ".join(f"max({{'class': class, 'class_name': class_name, 'proba': round(proba, 12)}}) FILTER (model = '{m}' AND rank = {r}) AS {m}_{r}" for m in _RESULT for r in (1, 2))}
  FROM ranked WHERE rank <= 2 GROUP BY file)
SELECT file, vigilance, {", ".join(_sql_text(m, *v) for m, v in _RESULT.items())} FROM files JOIN best USING (file)""")
def _(t: Tables):
    models = {m: P.RESULT_MODELS[m] for m in _RESULT}
    return P.result_rows(W.ranked(t, 2), _files(t), models)


@query("api_rank_predictions", """
WITH s AS (SELECT l_orderkey AS file, 'DCO' AS model, s_nationkey AS code, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
p AS (SELECT file, model, code, round(v / sum(v) OVER (PARTITION BY file), 12) AS proba FROM s)
SELECT file, n_name AS class, 'region ' || n_regionkey AS class_name, round(proba, 6) AS proba,
  row_number() OVER (PARTITION BY file ORDER BY proba DESC, n_name) AS rank FROM p JOIN nation ON n_nationkey = code""")
def _(t: Tables):
    summed = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(
        F.col("l_orderkey").alias("file"), F.lit("DCO").alias("model"), F.col("s_nationkey").alias("code")
    ).agg(F.sum("l_extendedprice").alias("v"))
    shared = A.with_share(summed, ["file"], "v", "proba").withColumn("proba", F.round("proba", 12))
    encoder = t.nation.select(F.lit("DCO").alias("model"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("class"))
    names = t.nation.select(F.lit("DCO").alias("model"), F.col("n_name").alias("class"), F.concat(F.lit("region "), "n_regionkey").alias("class_name"))
    out = P.rank_predictions(shared, ["file", "model"], names, encoder)
    return out.select("file", "class", "class_name", r6("proba").alias("proba"), "rank")


@query("api_distance", f"""
WITH {W.CENTRES}
SELECT vec_id, round(sum((x - c) * (x - c)) + 0.5 * (CASE WHEN vec_id % 4 <> cluster % 4 THEN 1 ELSE 0 END
  + CASE WHEN vec_id % 3 <> cluster % 3 THEN 1 ELSE 0 END), 6) AS d FROM entries JOIN centres USING (i) WHERE label = cluster GROUP BY vec_id, cluster""")
def _(t: Tables):
    model = C.centroid_table(W.vectors(t), "label", "num").select(F.col("cluster").alias("label"), F.col("num").alias("c"))
    codes = lambda c: F.array(F.col(c) % 4, F.col(c) % 3)
    d = V.mixed_distance(F.col("num"), F.col("c"), codes("vec_id"), codes("label"), 0.5)
    return W.vectors(t).join(model, "label").select("vec_id", r6(d).alias("d"))


# -- rules across models --------------------------------------------------------------------


@query("post_dco_override", f"""
WITH forms AS (SELECT c_custkey AS file, CASE WHEN c_custkey % 2 = 0 THEN '{K.PROFESSIONAL}' ELSE '{K.CITIZEN}' END AS declarant,
  CASE WHEN c_custkey % 5 = 0 THEN 'Nation_' || (c_nationkey + 1) ELSE c_mktsegment END AS label,
  CASE WHEN c_custkey % 3 = 0 THEN ' NATION _' || c_nationkey END AS device FROM customer),
ref AS (SELECT replace({W.sql_fold('n_name')}, ' ', '') AS m, max(n_nationkey) AS id FROM nation GROUP BY ALL)
SELECT file, coalesce(a.id, b.id) AS class, 1.0::DOUBLE AS proba FROM forms
LEFT JOIN ref a ON a.m = replace({W.sql_fold('label')}, ' ', '') LEFT JOIN ref b ON b.m = replace({W.sql_fold('device')}, ' ', '')
WHERE contains(lower(declarant), 'professionnel') AND coalesce(a.id, b.id) IS NOT NULL""")
def _(t: Tables):
    key = F.col("c_custkey")
    forms = t.customer.select(
        key.alias("file"), F.when(key % 2 == 0, K.PROFESSIONAL).otherwise(K.CITIZEN).alias("declarant"),
        F.when(key % 5 == 0, F.concat(F.lit("Nation_"), F.col("c_nationkey") + 1)).otherwise(F.col("c_mktsegment")).alias("label"),
        F.when(key % 3 == 0, F.concat(F.lit(" NATION _"), "c_nationkey")).alias("device"),
    )
    return P.family_override(forms, "file", "declarant", "label", "device", t.nation, "n_nationkey", "n_name")


SEVERITY_SQL = """
severity AS (SELECT doc_id AS file, m.model, class, class AS class_name, p AS proba, row_number() OVER (PARTITION BY doc_id, m.model ORDER BY p DESC, class) AS rank
  FROM (SELECT doc_id, 'NULLE' AS class, (n_chars % 97) / 97 AS p FROM documents UNION ALL SELECT doc_id, 'SEVER', 1 - (n_chars % 97) / 97 FROM documents) s,
  (VALUES ('gravité_ordinale'), ('gravité_binaire')) m(model))"""


def _severity(t: Tables):
    p = (F.col("n_chars") % 97) / 97
    rows = t.documents.select(F.col("doc_id").alias("file"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(c).alias("class"), F.lit(c).alias("class_name"), x.alias("proba"))
        for m in ("gravité_ordinale", "gravité_binaire") for c, x in (("NULLE", p), ("SEVER", 1 - p))
    ])).alias("x")).select("file", "x.*")
    return P.rank_predictions(rows, ["file", "model"])


@query("post_death_override", f"""
WITH {SEVERITY_SQL},
deaths AS (SELECT doc_id AS file FROM documents WHERE regexp_matches({W.sql_fold(DEATH_SQL)}, '{'|'.join(K.DEATH_STEMS)}'))
SELECT file, model, rank, class, round(proba, 6) AS proba FROM severity WHERE file NOT IN (SELECT file FROM deaths)
UNION ALL SELECT file, model, 1, 'CRITI', 1.0 FROM deaths, (VALUES ('gravité_ordinale'), ('gravité_binaire')) m(model)""")
def _(t: Tables):
    out = P.death_override(_severity(t), t.documents, "doc_id", _death_text())
    return out.select("file", "model", "rank", "class", r6("proba").alias("proba"))


VIRO_SQL = W.PREDICTIONS + """,
named AS (SELECT file, model, rank, class, CASE WHEN model = 'DCO' AND class::INT % 3 = 0 THEN 'Virologie : ' || class
  WHEN model = 'consequence' AND class = 'C0' THEN 'Faux negatif' ELSE class_name END AS class_name, proba FROM ranked WHERE model IN ('DCO', 'consequence')
  ),
viro AS (SELECT file FROM named WHERE rank = 1 GROUP BY file HAVING max(CASE WHEN model = 'DCO' THEN starts_with(lower(class_name), 'virologie')::INT END) = 1
  AND max(CASE WHEN model = 'consequence' THEN (lower(class_name) = 'faux negatif')::INT END) = 1)"""


@query("post_virology_override", f"""
WITH {VIRO_SQL}, sev AS (SELECT o_orderkey AS file, m.model, o_orderpriority AS class FROM orders, (VALUES ('gravité_ordinale'), ('gravité_binaire')) m(model))
SELECT file, model, CASE WHEN file IN (SELECT file FROM viro) THEN 'CRITI' ELSE class END AS class,
  CASE WHEN file IN (SELECT file FROM viro) THEN 1.0 ELSE 0.5 END::DOUBLE AS proba FROM sev""")
def _(t: Tables):
    ranked = W.ranked(t).where(F.col("model").isin("DCO", "consequence"))
    name = F.when((F.col("model") == "DCO") & (F.col("class").try_cast("int") % 3 == 0), F.concat(F.lit("Virologie : "), "class")).when(
        (F.col("model") == "consequence") & (F.col("class") == "C0"), "Faux negatif").otherwise(F.col("class_name"))
    severity = t.orders.select(
        F.col("o_orderkey").alias("file"), F.explode(F.array(F.lit("gravité_ordinale"), F.lit("gravité_binaire"))).alias("model"),
        F.lit(1).cast("long").alias("rank"), F.col("o_orderpriority").alias("class"), F.col("o_orderpriority").alias("class_name"), F.lit(0.5).alias("proba"),
    )
    table = ranked.withColumn("class_name", name).select(*severity.columns).unionByName(severity)
    out = P.virology_override(table)
    return out.where(F.col("model").isin("gravité_ordinale", "gravité_binaire")).select("file", "model", "class", "proba")


ALLOWED_SQL = W.PREDICTIONS + """,
allowed AS (SELECT DISTINCT o_orderpriority AS family, l_suppkey::VARCHAR AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_returnflag = 'A' AND l_quantity > 45),
r AS (SELECT k.*, o_orderpriority AS family, o_orderstatus AS status FROM ranked k JOIN orders ON o_orderkey = file WHERE model = 'DCO')"""


def _allowed(t: Tables):
    lines = t.lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).select("l_orderkey", "l_suppkey")
    pairs = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("family"), F.col("l_suppkey").cast("string").alias("label")
    )
    return J.allowed_labels(pairs, "family", "label")


def _family_ranked(t: Tables):
    ranked = W.ranked(t).where(F.col("model") == "DCO")
    return ranked.join(t.orders.select(
        F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("status")
    ), "file")


@query("post_allowed_rerank", f"""
WITH {ALLOWED_SQL},
m AS (SELECT r.*, a.label IS NOT NULL AND status = 'F' AND class NOT IN ('23', '18') AS usable FROM r LEFT JOIN allowed a ON a.family = r.family AND a.label = class)
SELECT file, coalesce(arg_min(class, rank) FILTER (usable), arg_min(class, rank)) AS class,
  round(coalesce(arg_min(proba, rank) FILTER (usable), arg_min(proba, rank)), 6) AS proba, bool_or(usable) AS reranked FROM m GROUP BY file""")
def _(t: Tables):
    out = P.allowed_rerank(
        _family_ranked(t), "file", "family", _allowed(t), "label", F.col("status") == "F", ["23", "18"]
    )
    return out.select("file", "class", r6("proba").alias("proba"), "reranked")


@query("post_constrained_argmax", f"""
WITH {ALLOWED_SQL}
SELECT file, arg_min(class, rank) AS class, round(arg_min(proba, rank), 6) AS proba FROM r JOIN allowed a ON a.family = r.family AND a.label = class GROUP BY file""")
def _(t: Tables):
    out = P.constrained_argmax(_family_ranked(t), "file", "family", _allowed(t), "label")
    return out.select("file", "class", r6("proba").alias("proba"))


# -- hypotheses -----------------------------------------------------------------------------


HYPO_SQL = W.PREDICTIONS + """,
top AS (SELECT file, model, class, CASE WHEN model = 'DCO' AND class::INT % 7 = 0 THEN '' ELSE class_name END AS name, proba, rank FROM ranked WHERE rank <= 2),
first_dco AS (SELECT file, name FROM top WHERE model = 'DCO' AND rank = 1),
combos AS (SELECT d.file, d.class AS dco, e.class AS tef, y.class AS tdy, c.class AS cdy, d.proba * e.proba * y.proba * c.proba AS p
  FROM top d JOIN first_dco f USING (file) JOIN top e USING (file) JOIN top y USING (file) JOIN top c USING (file)
  WHERE d.model = 'DCO' AND e.model = 'effet' AND y.model = 'dysfonctionnement' AND c.model = 'consequence' AND (d.rank = 1 OR f.name = '')),
hypotheses AS (SELECT file, dco, tef, tdy, cdy, p / sum(p) OVER (PARTITION BY file) AS prior FROM combos)"""


def _hypotheses(t: Tables, variant: str = "double"):
    name = F.when((F.col("model") == "DCO") & (F.col("class").try_cast("int") % 7 == 0), "").otherwise(F.col("class_name"))
    return C.hypotheses(W.ranked(t, 2).withColumn("class_name", name), variant=variant)


@query("jn_hypotheses", f"WITH {HYPO_SQL} SELECT file, dco, tef, tdy, cdy, round(prior, 10) AS prior FROM hypotheses")
def _(t: Tables):
    return _hypotheses(t).select("file", "dco", "tef", "tdy", "cdy", F.round("prior", 10).alias("prior"))


def _variant_sql(family: str, others: str) -> str:
    kept = HYPO_SQL.replace("AND (d.rank = 1 OR f.name = '')", f"AND {family} AND {others}")
    assert kept != HYPO_SQL
    return f"WITH {kept} SELECT file, dco, tef, tdy, cdy, round(prior, 6) AS prior FROM hypotheses"


@query("jn_hypotheses_direct", _variant_sql("d.rank = 1", "e.rank = 1 AND y.rank = 1 AND c.rank = 1"))
def _(t: Tables):
    return _hypotheses(t, "direct").select("file", "dco", "tef", "tdy", "cdy", r6("prior").alias("prior"))


@query("jn_hypotheses_family_first", _variant_sql("d.rank = 1", "true"))
def _(t: Tables):
    return _hypotheses(t, "family first").select("file", "dco", "tef", "tdy", "cdy", r6("prior").alias("prior"))


@query("jn_hypotheses_all_double", _variant_sql("true", "true"))
def _(t: Tables):
    return _hypotheses(t, "all double").select("file", "dco", "tef", "tdy", "cdy", r6("prior").alias("prior"))


@query("ml_hypothesis_mix", f"""
WITH {HYPO_SQL}, {W.CENTRES.strip()},
cats AS (SELECT label, unnest([0, 1, 2, 3]) AS a, unnest([vec_id % 5, vec_id % 2, vec_id % 4, vec_id % 3]) AS code FROM embeddings),
modes AS (SELECT label AS cluster, a, arg_max(code, (n, -code)) AS code FROM (SELECT label, a, code, count(*) AS n FROM cats GROUP BY ALL) GROUP BY label, a),
euclid AS (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS d FROM entries JOIN centres USING (i) GROUP BY ALL),
hyp AS (SELECT *, row_number() OVER () AS h FROM hypotheses WHERE file IN (SELECT vec_id FROM embeddings)),
hcat AS (SELECT h, unnest([0, 1, 2, 3]) AS a, unnest([dco::BIGINT % 5, CASE WHEN tef = 'E1213' THEN 1 ELSE 0 END, substr(tdy, 2)::BIGINT % 4, substr(cdy, 2)::BIGINT % 3]) AS code FROM hyp),
ham AS (SELECT h, cluster, count(*) FILTER (hcat.code <> modes.code) AS n FROM hcat JOIN modes USING (a) GROUP BY ALL),
dist AS (SELECT hyp.h, file, prior, cluster, d + n AS d FROM hyp JOIN euclid ON vec_id = file JOIN ham USING (h, cluster)),
w AS (SELECT file, prior, cluster, pow(d, -8) / sum(pow(d, -8)) OVER (PARTITION BY h) AS w FROM dist),
mix AS (SELECT file, cluster, sum(prior * w) AS p FROM w GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p DESC, cluster) AS rank FROM mix QUALIFY rank <= 5)
SELECT file, cluster, round(p / sum(p) OVER (PARTITION BY file), 6) AS proba FROM k""")
def _(t: Tables):
    i = F.col("vec_id")
    corpus = W.vectors(t).withColumn("cat", F.array(i % 5, i % 2, i % 4, i % 3))
    model = C.centroid_table(corpus, "label", "num", "cat")
    codes = F.array(
        F.col("dco").cast("long") % 5, F.when(F.col("tef") == "E1213", 1).otherwise(0).cast("long"),
        F.substring("tdy", 2, 20).cast("long") % 4, F.substring("cdy", 2, 20).cast("long") % 3,
    )
    guesses = _hypotheses(t).join(W.vectors(t).select(F.col("vec_id").alias("file"), "num"), "file")
    mixed = C.mix_memberships(guesses.select("file", "prior", "num", codes.alias("cat")), "file", "prior", "num", "cat", model, 5)
    return mixed.select("file", "cluster", r6("proba").alias("proba"))


# -- evaluation --------------------------------------------------------------------------------


SETS_SQL = """
truths AS (SELECT l_orderkey AS i, list(DISTINCT l_suppkey) AS t FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
probas AS (SELECT l_orderkey AS i, l_suppkey AS label, sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY l_orderkey) AS p FROM lineitem GROUP BY l_orderkey, l_suppkey),
guesses AS (SELECT i, list(label) FILTER (p >= 0.12) AS s FROM probas GROUP BY i),
both_sets AS (SELECT i, t, coalesce(s, []) AS s FROM truths LEFT JOIN guesses USING (i))"""


def _probas(t: Tables):
    summed = t.lineitem.groupBy(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("label")).agg(F.sum("l_extendedprice").alias("v"))
    return A.with_share(summed, ["i"], "v", "p")


def _truths(t: Tables):
    return t.lineitem.where(F.col("l_returnflag") != "R").groupBy(F.col("l_orderkey").alias("i")).agg(F.collect_set("l_suppkey").alias("truth"))


@query("ev_f1_samples", f"""
WITH {SETS_SQL}, n AS (SELECT len(list_intersect(t, s)) AS b, len(t) AS t, len(s) AS s FROM both_sets)
SELECT count(*) AS n, round(avg(CASE WHEN s = 0 THEN 0 ELSE b / s END), 6) AS precision, round(avg(CASE WHEN t = 0 THEN 0 ELSE b / t END), 6) AS recall,
  round(avg(CASE WHEN t + s = 0 THEN 0 ELSE 2 * b / (t + s) END), 6) AS f1 FROM n""")
def _(t: Tables):
    guesses = EV.label_sets(_probas(t), "i", "label", "p", K.LABEL_THRESHOLDS["TEF"])
    rows = _truths(t).join(guesses, "i", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<bigint>")))
    return EV.samples_scores(rows, "truth", "predicted").select("n", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("ev_threshold_sweep", f"""
WITH {SETS_SQL}, th AS (SELECT unnest(range(1, 17)) / 20 AS threshold),
g AS (SELECT threshold, i, coalesce(list(label) FILTER (p >= threshold), []) AS s FROM probas, th GROUP BY threshold, i),
n AS (SELECT threshold, len(list_intersect(t, g.s)) AS b, len(t) AS t, len(g.s) AS s FROM truths JOIN g USING (i))
SELECT threshold, count(*) AS n, round(avg(CASE WHEN s = 0 THEN 0 ELSE b / s END), 6) AS precision, round(avg(b / t), 6) AS recall,
  round(avg(2 * b / (t + s)), 6) AS f1 FROM n GROUP BY threshold""")
def _(t: Tables):
    scores = _probas(t).groupBy("i").agg(F.collect_list(F.struct("label", F.col("p").alias("proba"))).alias("scores"))
    out = EV.threshold_sweep(_truths(t).join(scores, "i"), "truth", "scores", [x / 20 for x in range(1, 17)])
    return out.select("threshold", "n", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("ev_f1_weighted", f"WITH {PAIRS_SQL} SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM report")
def _(t: Tables):
    return EV.summary(truth_pairs(t), "truth", "pred").select(r6("f1_weighted").alias("f1_weighted"))


@query("ev_f1_binary", f"""
WITH {PAIRS_SQL} SELECT count(*) FILTER (truth = 'R' AND pred = 'R') AS tp, count(*) FILTER (truth = 'R') AS pos, count(*) FILTER (pred = 'R') AS ans,
  round(2 * count(*) FILTER (truth = 'R' AND pred = 'R') / (count(*) FILTER (truth = 'R') + count(*) FILTER (pred = 'R')), 6) AS f1 FROM pairs""")
def _(t: Tables):
    return EV.binary_f1(truth_pairs(t), "truth", "pred", "R").select("tp", "pos", "ans", r6("f1").alias("f1"))


@query("ev_per_class_report", f"""
WITH {PAIRS_SQL} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round((SELECT avg((support = 0)::INT) FROM report), 6) AS no_support, round((SELECT avg((f1 = 0)::INT) FROM report), 6) AS zero_f1 FROM report""")
def _(t: Tables):
    report = EV.per_class(truth_pairs(t), "truth", "pred")
    unused = EV.unused_classes(report)
    return report.select(
        "class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")],
        r6(unused.select("no_support").scalar()).alias("no_support"), r6(unused.select("zero_f1").scalar()).alias("zero_f1"),
    )


@query("ev_topk_accuracy", f"""
WITH {W.PREDICTIONS}, truth AS (SELECT l_orderkey AS file, arg_min(l_suppkey, (l_linenumber, l_suppkey))::VARCHAR AS truth FROM lineitem GROUP BY ALL),
places AS (SELECT file, min(rank) FILTER (class = truth) AS place FROM ranked JOIN truth USING (file) WHERE model = 'DCO' GROUP BY file),
ks AS (SELECT unnest(range(0, 36))::INT AS k)
SELECT k, count(*) FILTER (place <= k) AS hits, round(count(*) FILTER (place <= k) / count(*), 6) AS accuracy FROM places, ks GROUP BY k""")
def _(t: Tables):
    truth = t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).cast("string").alias("truth"))
    ranked = W.ranked(t).where(F.col("model") == "DCO").join(truth, "file")
    return EV.topk_accuracy(ranked, "file", "truth", "class", "rank", list(range(36))).select("k", "hits", r6("accuracy").alias("accuracy"))


@query("ev_precision_recall_at_k", f"""
WITH {W.PREDICTIONS}, t AS (SELECT DISTINCT l_orderkey AS file, l_suppkey::VARCHAR AS class FROM lineitem WHERE l_returnflag <> 'R'),
n AS (SELECT file, count(*) AS n FROM t GROUP BY file), ks AS (SELECT unnest(range(1, 11))::INT AS k),
hits AS (SELECT file, k, count(*) FILTER (rank <= k) AS c FROM ranked JOIN t USING (file, class), ks WHERE model = 'DCO' GROUP BY ALL)
SELECT ks.k, round(avg(coalesce(c, 0) / ks.k), 6) AS precision, round(avg(coalesce(c, 0) / n), 6) AS recall
FROM n CROSS JOIN ks LEFT JOIN hits ON hits.file = n.file AND hits.k = ks.k GROUP BY ks.k""")
def _(t: Tables):
    pairs = t.lineitem.where(F.col("l_returnflag") != "R").select(
        F.col("l_orderkey").alias("file"), F.col("l_suppkey").cast("string").alias("class")).distinct()
    ranked = W.ranked(t, 10).where(F.col("model") == "DCO").join(pairs.withColumn("hit", F.lit(1)), ["file", "class"], "left")
    truths = A.counts(pairs, ["file"], "n_true")
    out = EV.precision_recall_at_k(ranked, "file", "hit", "rank", truths, "n_true", 10)
    return out.select("k", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("ev_auc_ap", """
WITH s AS (SELECT l_extendedprice AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), c AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY s),
r AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp FROM c)
SELECT CAST(sum(p) AS BIGINT) AS pos, CAST(sum(q) AS BIGINT) AS neg, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auc,
  round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM r""")
def _(t: Tables):
    df = t.lineitem.select(F.col("l_extendedprice").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return EV.auc_ap(df, "s", "y").select("pos", "neg", r6("auc").alias("auc"), r6("average_precision").alias("average_precision"))


# -- ensembles -----------------------------------------------------------------------------------


TWO_SQL = """
a AS (SELECT l_orderkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey AS i, l_suppkey AS j, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
s AS (SELECT 0 AS t, * FROM a UNION ALL SELECT 1, * FROM b),
rel AS (SELECT t, i, j, v, (SELECT max(c) FROM (SELECT count(*) AS c FROM s GROUP BY t, i)) - (row_number() OVER (PARTITION BY t, i ORDER BY v DESC, j) - 1) AS r FROM s)"""


def _two(t: Tables):
    keys = [F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j")]
    a = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("v"))
    b = t.lineitem.where(F.col("l_returnflag") != "R").groupBy(*keys).agg(F.sum("l_extendedprice").alias("v"))
    return [a, b]


@query("ens_average", f"WITH {TWO_SQL} SELECT i, j, round(sum(v) / 2, 4) AS v FROM s GROUP BY i, j")
def _(t: Tables):
    return P.average(_two(t), "i", "j", "v").select("i", "j", F.round("v", 4).alias("v"))


@query("ens_rank_average", f"WITH {TWO_SQL} SELECT i, j, round(sum(r) / 2, 6) AS v FROM rel GROUP BY i, j")
def _(t: Tables):
    return P.rank_average(_two(t), "i", "j", "v").select("i", "j", r6("v").alias("v"))


@query("ens_round_robin", f"WITH {TWO_SQL} SELECT i, j, round(max(r + (2 - t) / 3) / 2, 6) AS v FROM rel GROUP BY i, j")
def _(t: Tables):
    return P.round_robin(_two(t), "i", "j", "v").select("i", "j", r6("v").alias("v"))


@query("ens_folds", f"WITH {TWO_SQL} SELECT t AS fold, i, j, round(v, 4) AS v FROM s")
def _(t: Tables):
    return P.fold_predictions(_two(t)).select("fold", "i", "j", F.round("v", 4).alias("v"))


@query("win_topk_sparse", f"""
WITH {TWO_SQL} SELECT i, j, round(v, 4) AS v FROM a QUALIFY row_number() OVER (PARTITION BY i ORDER BY v DESC, j) <= 3""")
def _(t: Tables):
    return L.top_k_sparse(_two(t)[0], 3).select("i", "j", F.round("v", 4).alias("v"))


@query("win_rank_relevance", f"""
WITH {TWO_SQL} SELECT i, j, ((SELECT max(c) FROM (SELECT count(*) AS c FROM a GROUP BY i)) - (row_number() OVER (PARTITION BY i ORDER BY v DESC, j) - 1))::DOUBLE AS relevance FROM a""")
def _(t: Tables):
    return P.relevance(_two(t)[0], ["i"], "j", "v").select("i", "j", "relevance")


# -- label codes and trees ---------------------------------------------------------------------------


COORD_SQL = """
il AS (SELECT DISTINCT l_orderkey AS i, l_suppkey AS label FROM lineitem),
f AS (SELECT l_orderkey AS i, p_brand AS feat, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
ic AS (SELECT DISTINCT l_orderkey AS i, l_partkey % 16 AS code FROM lineitem)"""


def _instance_labels(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("label")).distinct()


def _instance_features(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").alias("i"), F.col("p_brand").alias("feat")).agg(F.sum("l_quantity").alias("v"))


def _instance_codes(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") % 16).alias("code")).distinct()


@query("agg_pifa", f"""
WITH {COORD_SQL}, w AS (SELECT i, 1 / sqrt(count(*)) AS w FROM il GROUP BY i),
s AS (SELECT label, feat, sum(w * v) AS s FROM il JOIN w USING (i) JOIN f USING (i) GROUP BY label, feat)
SELECT label, feat, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS v FROM s""")
def _(t: Tables):
    return A.label_embeddings(_instance_labels(t), _instance_features(t)).select("label", "feat", r6("v").alias("v"))


GIVEN_SQL = COORD_SQL + """,
given AS (SELECT code, label, n, n / sum(n) OVER (PARTITION BY code) AS p FROM (SELECT code, label, count(*) AS n FROM ic JOIN il USING (i) GROUP BY ALL))"""


@query("agg_label_given_code", f"WITH {GIVEN_SQL} SELECT code, label, n, round(p, 6) AS p FROM given")
def _(t: Tables):
    return A.label_given_code(_instance_codes(t), _instance_labels(t)).select("code", "label", "n", r6("p").alias("p"))


@query("ml_count_model", f"""
WITH {GIVEN_SQL}, s AS (SELECT i, label, sum(p / 2) AS score FROM ic JOIN given USING (code) GROUP BY i, label)
SELECT i, label, round(score, 6) AS score, row_number() OVER (PARTITION BY i ORDER BY round(score, 12) DESC, label) AS rank FROM s QUALIFY rank <= 5""")
def _(t: Tables):
    given = A.label_given_code(_instance_codes(t), _instance_labels(t))
    out = L.count_model(_instance_codes(t).withColumn("w", F.lit(0.5)), given, 5)
    return out.select("i", "label", r6("score").alias("score"), "rank")


@query("ml_optimal_codes", f"""
WITH {COORD_SQL}, s AS (SELECT i, label % 7 AS code, count(*) AS c FROM il GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, code) AS r FROM s QUALIFY r <= 2)
SELECT i, code, round(c / sum(c) OVER (PARTITION BY i), 6) AS w FROM k""")
def _(t: Tables):
    labels = _instance_labels(t)
    codes = labels.select("label").distinct().withColumn("code", F.col("label") % 7)
    return L.optimal_codes(labels, codes, 2).select("i", "code", r6("w").alias("w"))


DIMS_SQL = """
z AS (SELECT label, d, round(sum(CASE WHEN substr(md5('1:' || feat || ':' || d), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN v ELSE -v END), 9) AS z
  FROM (SELECT vec_id AS label, unnest(range(len(embedding))) AS feat, unnest(embedding)::DOUBLE AS v FROM embeddings), (SELECT unnest([0, 1, 2, 3]) AS d) GROUP BY label, d)"""


def _dims(t: Tables):
    """All coordinates of every vector, projected on four axes."""
    entries = t.embeddings.select(F.col("vec_id").alias("label"), F.posexplode("embedding").alias("feat", "v"))
    return L.project(entries.withColumn("v", F.col("v").cast("double")), 4, 1).withColumn("z", F.round("z", 9))


@query("ml_label_codes", f"""
WITH {DIMS_SQL}, n AS (SELECT count(*) AS n FROM embeddings),
b AS (SELECT label, d, (row_number() OVER (PARTITION BY d ORDER BY z, label) - 1) // CAST(ceil(n / 8) AS BIGINT) AS bin FROM z, n)
SELECT label, CAST(sum(bin * pow(8, d)) AS BIGINT) AS code FROM b GROUP BY label""")
def _(t: Tables):
    return L.ordinal_codes(_dims(t), 4, 8, t.embeddings.count())


@query("ml_label_codes_uniform", f"""
WITH {DIMS_SQL}, e AS (SELECT d, min(z) AS lo, max(z) AS hi FROM z GROUP BY d)
SELECT label, CAST(sum(CASE WHEN z >= hi THEN 7 ELSE floor((z - lo) / ((hi - lo) / 7)) END * pow(8, d)) AS BIGINT) AS code FROM z JOIN e USING (d) GROUP BY label""")
def _(t: Tables):
    return L.uniform_codes(_dims(t), 8)


@query("ml_label_codes_random", f"""
WITH {COORD_SQL}, w AS (SELECT i, 1 / sqrt(count(*)) AS w FROM il GROUP BY i),
s AS (SELECT label, feat, sum(w * v) AS s FROM il JOIN w USING (i) JOIN f USING (i) GROUP BY label, feat),
u AS (SELECT label, feat, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS v FROM s),
z AS (SELECT label, d, round(sum(CASE WHEN substr(md5('1:' || feat || ':' || d), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN v ELSE -v END), 9) AS z
  FROM u, (SELECT unnest([0, 1, 2, 3]) AS d) GROUP BY label, d),
e AS (SELECT d, min(z) AS lo, max(z) AS hi FROM z GROUP BY d)
SELECT label, CAST(sum(CASE WHEN z >= hi THEN 7 ELSE floor((z - lo) / ((hi - lo) / 7)) END * pow(8, d)) AS BIGINT) AS code,
  ('0x' || substr(md5('1:' || label), 1, 8))::BIGINT % 16 AS drawn FROM z JOIN e USING (d) GROUP BY label""")
def _(t: Tables):
    vectors = A.label_embeddings(_instance_labels(t), _instance_features(t))
    projected = L.project(vectors, 4, 1).withColumn("z", F.round("z", 9))
    drawn = L.random_codes(projected.select("label").distinct(), 16, 1)
    return L.uniform_codes(projected, 8).join(drawn.withColumnRenamed("code", "drawn"), "label")


@query("ml_beam_search", """
WITH s AS (SELECT l_orderkey AS i, p_type AS a, p_type || '/' || p_brand AS b, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
n1 AS (SELECT i, a AS node, 1 / (1 + exp(-(sum(q) / 20 - 2))) AS s FROM s GROUP BY ALL),
k1 AS (SELECT * FROM n1 QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, node) <= 2),
n2 AS (SELECT i, a, b AS node, 1 / (1 + exp(-(sum(q) / 20 - 2))) AS s FROM s GROUP BY ALL),
c AS (SELECT n2.i, n2.node, k1.s * n2.s AS s FROM k1 JOIN n2 ON n2.i = k1.i AND n2.a = k1.node),
k2 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, node) <= 3)
SELECT i, node, round(s, 6) AS score FROM k2""")
def _(t: Tables):
    leaf = F.concat_ws("/", "p_type", "p_brand")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("i"), F.col("p_type").alias("type"), leaf.alias("leaf"), F.col("l_quantity").alias("q"))

    def level(column):
        return lines.groupBy("i", F.col(column).alias("node")).agg((F.sum("q") / 20 - 2).alias("v"))

    types = t.part.select(F.lit("root").alias("parent"), F.col("p_type").alias("node")).distinct()
    leaves = t.part.select(F.col("p_type").alias("parent"), leaf.alias("node")).distinct()
    root = t.orders.select(F.col("o_orderkey").alias("i"), F.lit("root").alias("node"), F.lit(1.0).alias("score"))
    first = L.beam_level(root, types, level("type"), 2)
    return L.beam_level(first, leaves, level("leaf"), 3).select("i", "node", r6("score").alias("score"))
