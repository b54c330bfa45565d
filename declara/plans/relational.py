"""Projections, filters, reference joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import text as T
from declara.operators import aggregations as A
from declara.operators import encode as E
from declara.operators import evaluate as EV
from declara.operators import joins as J
from declara.operators import projections as P
from declara.operators import quantiles as Q
from declara.plans import views as W
from declara.plans.registry import Tables, query
from declara.runtime import new_path
from declara.sources import readers as R
from declara.sources import writers as S
from declara.plans.views import r6
from declara.runtime import draw, stage, with_global_rank

# -- flagship: families of every cluster -------------------------------------------


@query("agg_cluster_dcos", """
WITH c AS (SELECT source AS cluster, lang AS dco, count(*) AS n FROM documents GROUP BY ALL)
SELECT cluster, dco, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS score,
       row_number() OVER (PARTITION BY cluster ORDER BY n DESC, dco) AS rank FROM c""")
def _(t: Tables):
    docs = t.documents.select(F.col("source").alias("cluster"), F.col("lang").alias("dco"))
    return A.label_distribution(docs, "cluster", "dco").select("cluster", "dco", "n", r6("score").alias("score"), "rank")


@query("agg_dco_clusters", """
WITH c AS (SELECT source AS cluster, lang AS dco, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS score FROM c)
SELECT dco, cluster, round(score, 6) AS score,
       row_number() OVER (PARTITION BY dco ORDER BY round(score, 9) DESC, cluster) AS rank FROM s""")
def _(t: Tables):
    docs = t.documents.select(F.col("source").alias("cluster"), F.col("lang").alias("dco"))
    shared = A.with_share(A.counts(docs, ["cluster", "dco"]), ["cluster"], "n", "score")
    ranked = A.top_k(shared, ["dco"], [F.round("score", 9).desc(), F.col("cluster")], None)
    return ranked.select("dco", "cluster", r6("score").alias("score"), "rank")


# -- 2.1 scans --------------------------------------------------------------------


@query("src_csv_usecols", "SELECT doc_id, lang FROM documents")
def _(t: Tables):
    """Two columns of a CSV file; the scan parses no others."""
    path = new_path(t.spark, "columns")
    S.csv(t.documents, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.documents.schema)
    return R.declarations_csv(t.spark, path, schema).select("doc_id", "lang")


@query("src_parquet", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(t: Tables):
    return t.part


# -- 2.3 projections and filters ---------------------------------------------------


@query("prj_fill_null", f"""
WITH {W.DECLARATIONS}
SELECT doc_id, coalesce(effect, '') AS effect, coalesce(severity, 'NON RENSEIGNE') AS severity FROM declarations""")
def _(t: Tables):
    filled = P.fill_null(W.declarations(t), ["effect"], "")
    return P.fill_null(filled, ["severity"], K.NOT_FILLED).select("doc_id", "effect", "severity")


@query("prj_label_defaults", f"""
WITH {W.DECLARATIONS}
SELECT doc_id, coalesce(effect, 'E1213') AS tef, coalesce(severity, 'D0') AS tdy,
       coalesce(CASE WHEN n_chars > 1000 THEN 'C1' END, 'C0') AS cdy FROM declarations""")
def _(t: Tables):
    df = W.declarations(t).select(
        "doc_id", F.col("effect").alias("tef"), F.col("severity").alias("tdy"),
        F.when(F.col("n_chars") > 1000, "C1").alias("cdy"),
    )
    return P.label_defaults(df, "tef", "tdy", "cdy")


@query("prj_blank_to_default", """
SELECT doc_id, CASE WHEN a = '' THEN 'NON RENSEIGNE' ELSE a END AS first_word,
       CASE WHEN lang = '' THEN 'NON RENSEIGNE' ELSE lang END AS lang
FROM (SELECT doc_id, lang, regexp_extract(text, '^([a-z]*)', 1) AS a FROM documents)""")
def _(t: Tables):
    return P.blank_to_default(t.documents.select(
        "doc_id", F.regexp_extract("text", "^([a-z]*)", 1).alias("first_word"), "lang"
    ))


@query("prj_text_concat", """
SELECT doc_id, regexp_replace(text || '. ' || source, '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", P.text_concat(F.col("text"), F.col("source")).alias("text"))


@query("prj_compound_text", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", P.compound_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text"))


@query("prj_cast_dco_id", """
SELECT p_partkey, coalesce(TRY_CAST(regexp_replace(raw, '\\.0$', '') AS INTEGER), -1) AS dco_id
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_partkey || '.0' WHEN p_size % 3 = 1 THEN p_partkey::VARCHAR
      WHEN p_size % 2 = 0 THEN 'nan' END AS raw FROM part)""")
def _(t: Tables):
    raw = (
        F.when(F.col("p_size") % 3 == 0, F.concat("p_partkey", F.lit(".0")))
        .when(F.col("p_size") % 3 == 1, F.col("p_partkey").cast("string"))
        .when(F.col("p_size") % 2 == 0, "nan")
    )
    return t.part.select("p_partkey", P.family_id(raw).alias("dco_id"))


NAMES_SQL = "SELECT p_partkey, 'R' || p_partkey || ' - ' || replace(p_name || '/' || p_type, '/', '-') AS doc_name FROM part"


def _doc_names(t: Tables):
    family = F.concat("p_name", F.lit("/"), "p_type")
    return t.part.select("p_partkey", P.document_name(F.concat(F.lit("R"), "p_partkey"), family).alias("doc_name"))


@query("prj_doc_name", NAMES_SQL)
def _(t: Tables):
    return _doc_names(t)


@query("prj_parse_doc_name", f"""
SELECT p_partkey, trim(split_part(doc_name, '-', 1)) AS declaration FROM ({NAMES_SQL})""")
def _(t: Tables):
    return _doc_names(t).select("p_partkey", P.declaration_of_name(F.col("doc_name")).alias("declaration"))


@query("prj_number_from_filename", """
SELECT page_id, coalesce(list_extract(g, -1), 'INCONNU') AS number
FROM (SELECT page_id, regexp_extract_all(string_split(url, '/')[-1], '[0-9]+') AS g FROM pages)""")
def _(t: Tables):
    return t.pages.select("page_id", P.number_from_file_name(F.col("url")).alias("number"))


FILES_SQL = """
files AS (SELECT doc_id, 'in/' || source || CASE doc_id % 4 WHEN 0 THEN '_MATÉRIOvigilance' WHEN 1 THEN '_REACTOvigilance'
          WHEN 2 THEN '_bacterio' ELSE '' END || '.pdf' AS path,
          CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'autre' END AS given,
          CASE WHEN doc_id % 5 = 0 THEN 'Déclaration de Réactovigilance (PS)' WHEN doc_id % 5 = 1 THEN 'Materiovigilance'
               WHEN doc_id % 5 = 2 THEN text END AS title FROM documents),
named AS (SELECT *, translate(lower(string_split(path, '/')[-1]), 'éèê', 'eee') AS name FROM files),
typed AS (SELECT *, CASE WHEN contains(name, 'materio') THEN 'matériovigilance'
          WHEN contains(name, 'reacto') OR contains(name, 'bacterio') THEN 'réactovigilance' ELSE '' END AS by_name FROM named)"""


def _files(t: Tables):
    i = F.col("doc_id")
    path = F.concat(F.lit("in/"), "source", F.when(i % 4 == 0, "_MATÉRIOvigilance").when(i % 4 == 1, "_REACTOvigilance")
                    .when(i % 4 == 2, "_bacterio").otherwise(""), F.lit(".pdf"))
    return t.documents.select(
        "doc_id", path.alias("path"), F.when(i % 3 == 0, "").when(i % 3 == 1, "autre").alias("given"),
        F.when(i % 5 == 0, "Déclaration de Réactovigilance (PS)").when(i % 5 == 1, "Materiovigilance")
        .when(i % 5 == 2, F.col("text")).alias("title"),
    )


@query("prj_vigilance_from_name", f"WITH {FILES_SQL} SELECT doc_id, by_name AS vigilance FROM typed")
def _(t: Tables):
    return _files(t).select("doc_id", P.vigilance_from_file_name(F.col("path")).alias("vigilance"))


@query("prj_vigilance_default", f"WITH {FILES_SQL} SELECT doc_id, coalesce(nullif(given, ''), by_name) AS vigilance FROM typed")
def _(t: Tables):
    return _files(t).select(
        "doc_id", P.or_default(F.col("given"), P.vigilance_from_file_name(F.col("path"))).alias("vigilance")
    )


@query("prj_vigilance_from_title", f"""
WITH {FILES_SQL}
SELECT doc_id, CASE WHEN contains({W.sql_fold('title')}, 'reactovigilance') THEN 'réactovigilance'
  WHEN contains({W.sql_fold('title')}, 'materiovigilance') THEN 'matériovigilance' ELSE by_name END AS vigilance FROM typed""")
def _(t: Tables):
    return _files(t).select("doc_id", P.vigilance_from_title(F.col("title"), F.col("path")).alias("vigilance"))


@query("prj_declarant_from_title", f"""
WITH {FILES_SQL}
SELECT doc_id, CASE WHEN title IS NULL THEN '' WHEN contains(lower(title), '(ps)') THEN '{K.PROFESSIONAL}'
  ELSE '{K.CITIZEN}' END AS declarant FROM typed""")
def _(t: Tables):
    return _files(t).select("doc_id", P.declarant_from_title(F.col("title")).alias("declarant"))


@query("prj_case_ids", "SELECT s_suppkey, lower(s_name) AS declaration FROM supplier")
def _(t: Tables):
    return t.supplier.select("s_suppkey", F.lower("s_name").alias("declaration"))


@query("prj_binary_flags", f"""
WITH {W.DECLARATIONS}
SELECT doc_id, CASE WHEN effect IS NOT NULL AND effect <> 'E1213' THEN 1 ELSE 0 END AS has_effect,
       CASE WHEN severity IS NOT NULL THEN 1 ELSE 0 END AS has_severity FROM declarations""")
def _(t: Tables):
    flags = {"has_effect": ("effect", K.DEFAULT_EFFECT), "has_severity": ("severity", None)}
    return P.presence_flags(W.declarations(t), flags).select("doc_id", "has_effect", "has_severity")


@query("flt_drop_labels", f"""
WITH {W.DECLARATIONS} SELECT doc_id, effect FROM declarations WHERE effect IS NULL OR effect NOT IN ('E1454')""")
def _(t: Tables):
    return P.drop_labels(W.declarations(t), "effect", ["E1454"]).select("doc_id", "effect")


@query("flt_label_notnull", f"WITH {W.DECLARATIONS} SELECT doc_id, severity FROM declarations WHERE severity IS NOT NULL")
def _(t: Tables):
    return W.declarations(t).dropna(subset=["severity"]).select("doc_id", "severity")


@query("flt_label_exclude", f"""
WITH {W.DECLARATIONS} SELECT doc_id, coalesce(effect, 'E0') AS effect FROM declarations
WHERE coalesce(effect, 'E0') NOT IN ({W.sql_list(K.GENERIC_EFFECTS)})""")
def _(t: Tables):
    df = W.declarations(t).fillna({"effect": "E0"})
    return P.drop_labels(df, "effect", K.GENERIC_EFFECTS).select("doc_id", "effect")


@query("flt_doc_by_id_or_name", """
SELECT s_suppkey, s_name FROM supplier WHERE s_name = 'Supplier#000000007' OR s_suppkey::VARCHAR = 'Supplier#000000007'""")
def _(t: Tables):
    df = t.supplier.withColumn("id", F.col("s_suppkey").cast("string"))
    return P.document_by_id_or_name(df, "Supplier#000000007", "id", "s_name").select("s_suppkey", "s_name")


@query("flt_declarant", f"""
WITH {W.DECLARATIONS} SELECT doc_id, declarant FROM declarations WHERE declarant = '{K.CITIZEN}'""")
def _(t: Tables):
    return P.by_declarant(W.declarations(t), "declarant", K.CITIZEN).select("doc_id", "declarant")


@query("flt_anonymise", """
SELECT conv_id, turn, translate(role, chr(9) || chr(10) || chr(13), '   ') AS role, text FROM conversations
WHERE lower(translate(role, chr(9) || chr(10) || chr(13), '   ')) NOT IN ('system', 'nom')""")
def _(t: Tables):
    return P.anonymise(t.conversations.select("conv_id", "turn", "role", "text"), "role", ["System", "Nom"])


@query("flt_class_min_support", """
SELECT doc_id, source FROM documents QUALIFY count(*) OVER (PARTITION BY source) > 15""")
def _(t: Tables):
    return A.min_support(t.documents.select("doc_id", "source"), "source", 15)


@query("flt_min_words", f"""
WITH n AS (SELECT doc_id, len({W.sql_tokens('text')}) AS n_words FROM documents)
SELECT doc_id, n_words FROM n WHERE n_words > (SELECT quantile_cont(n_words, 0.25) FROM n)""")
def _(t: Tables):
    n = stage(t.texts.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words")))
    cut = Q.quantile_column(n, [], "n_words", 0.25, "q").select("q").scalar()
    return n.where(F.col("n_words") > cut)


@query("flt_topic_threshold", f"""
WITH {W.TOPIC_ROWS}, cut AS (SELECT topic, quantile_cont(weight, 0.75) AS cut FROM topic_rows GROUP BY topic)
SELECT vec_id, topic, round(weight, 6) AS weight FROM topic_rows JOIN cut USING (topic) WHERE weight >= cut""")
def _(t: Tables):
    rows = W.topic_rows(t)
    cut = Q.quantile_column(rows, ["topic"], "weight", 0.75, "cut")
    return rows.join(cut, "topic").where(F.col("weight") >= F.col("cut")).select(
        "vec_id", F.col("topic").cast("long").alias("topic"), r6("weight").alias("weight")
    )


@query("flt_inactive_reference", """
SELECT l_orderkey, l_linenumber, p_name AS class_name FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size > 10""")
def _(t: Tables):
    reference = t.part.select("p_partkey", "p_name", (F.col("p_size") > 10).alias("active"))
    named = J.label_name(t.lineitem, "l_partkey", reference, "p_partkey", "p_name", "TDY_ID", F.col("l_partkey") == -1, "active")
    return named.where(F.col("class_name") != "INACTIF").select("l_orderkey", "l_linenumber", "class_name")


# -- 2.4 joins -------------------------------------------------------------------


@query("jn_label_name", """
SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN p_name WHEN l_partkey = 0 THEN ''
       ELSE 'Libelle inconnu; DCO_ID = ' || l_partkey END AS class_name
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey > 0 AND p_type <> 'PROMO') ON l_partkey = p_partkey""")
def _(t: Tables):
    reference = t.part.where((F.col("p_partkey") > 0) & (F.col("p_type") != "PROMO"))
    named = J.label_name(t.lineitem, "l_partkey", reference, "p_partkey", "p_name", "DCO_ID", F.col("l_partkey") == 0)
    return named.select("l_orderkey", "l_linenumber", "class_name")


@query("jn_dco_name_default", """
SELECT s_suppkey, coalesce(n_name, 'NON_LISTE') AS family
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""")
def _(t: Tables):
    listed = t.nation.where(F.col("n_regionkey") < 3)
    return J.family_name(t.supplier, "s_nationkey", listed, "n_nationkey", "n_name", "family").select("s_suppkey", "family")


@query("jn_label_to_id", f"""
WITH reference AS (SELECT replace({W.sql_fold('n_name')}, ' ', '') AS m, max(n_nationkey) AS id FROM nation GROUP BY ALL)
SELECT c_custkey, id AS dco_id FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' nation _' || c_nationkey
  WHEN c_custkey % 3 = 0 THEN 'Nätion_' || c_nationkey ELSE c_mktsegment END AS label FROM customer)
LEFT JOIN reference ON replace({W.sql_fold('label')}, ' ', '') = m""")
def _(t: Tables):
    key = F.col("c_custkey")
    label = F.when(key % 2 == 0, F.concat(F.lit(" nation _"), "c_nationkey")).when(
        key % 3 == 0, F.concat(F.lit("Nätion_"), "c_nationkey")).otherwise(F.col("c_mktsegment"))
    return J.label_to_id(t.customer.select("c_custkey", label.alias("label")), "label", t.nation, "n_nationkey", "n_name", "dco_id").select("c_custkey", "dco_id")


MULTILABEL_SQL = f"""
WITH {W.DECLARATIONS},
grouped AS (SELECT text, array_to_string(list_sort(list(DISTINCT effect) FILTER (effect IS NOT NULL)), ',') AS effects,
       array_to_string(list_sort(list(DISTINCT severity) FILTER (severity IS NOT NULL)), ',') AS severities FROM declarations GROUP BY text)"""


@query("agg_multilabel", MULTILABEL_SQL + """
SELECT text, coalesce(effects, '') AS effects, coalesce(severities, '') AS severities FROM grouped""")
def _(t: Tables):
    grouped = A.labels_by_text(W.declarations(t), "text", ["effect", "severity"])
    return grouped.select("text", F.array_join("effect", ",").alias("effects"), F.array_join("severity", ",").alias("severities"))


@query("jn_multilabel_merge", MULTILABEL_SQL + """
SELECT min(doc_id) AS doc_id, coalesce(any_value(effects), '') AS effects, coalesce(any_value(severities), '') AS severities
FROM declarations JOIN grouped USING (text) GROUP BY text""")
def _(t: Tables):
    df = W.declarations(t).select("doc_id", "text", "effect", "severity")
    merged = A.multilabel_table(df, "text", "doc_id", ["effect", "severity"])
    return merged.select("doc_id", F.array_join("effect", ",").alias("effects"), F.array_join("severity", ",").alias("severities"))


SYNONYMS_SQL = """
synonyms AS (SELECT DISTINCT p_type AS canonical, p_name AS alias FROM part WHERE p_size = 1),
mapping AS (SELECT alias, arg_min(canonical, (own, canonical)) AS canonical FROM (
  SELECT canonical, alias, 1 AS own FROM synonyms UNION ALL SELECT canonical, canonical, 0 FROM synonyms) GROUP BY alias)"""


@query("jn_synonym_map", f"""
WITH {SYNONYMS_SQL}
SELECT p_partkey, m.canonical AS label FROM part LEFT JOIN mapping m ON m.alias = CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END""")
def _(t: Tables):
    synonyms = t.part.where(F.col("p_size") == 1).select(F.col("p_type").alias("canonical"), F.col("p_name").alias("alias")).distinct()
    df = t.part.withColumn("raw", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")))
    return J.synonym(df, "raw", synonyms, "label").select("p_partkey", "label")


@query("jn_allowed_labels", """
SELECT DISTINCT p_type AS family, l_suppkey AS label FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t: Tables):
    lines = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    pairs = lines.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return J.allowed_labels(pairs.select(F.col("p_type").alias("family"), F.col("l_suppkey").alias("label")), "family", "label")


@query("jn_prediction_in_allowed", """
WITH pairs AS (SELECT p_type AS family, l_suppkey AS label, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
allowed AS (SELECT DISTINCT family, label FROM pairs WHERE l_returnflag = 'A'),
marked AS (SELECT p.family, a.label IS NOT NULL AS inside FROM pairs p LEFT JOIN allowed a USING (family, label))
SELECT count(*) AS n, count(*) FILTER (inside) AS n_in, round(count(*) FILTER (inside) / count(*), 6) AS share FROM marked""")
def _(t: Tables):
    pairs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("family"), F.col("l_suppkey").alias("label"), "l_returnflag"
    )
    allowed = J.allowed_labels(pairs.where(F.col("l_returnflag") == "A"), "family", "label")
    return J.inside_allowed(pairs, allowed, ["family", "label"]).select("n", "n_in", r6("share").alias("share"))


@query("jn_manufacturer_fuzzy", """
WITH known AS (SELECT DISTINCT lower(s_name) AS known FROM supplier WHERE s_suppkey % 3 = 0),
names AS (SELECT DISTINCT lower(s_name) AS name FROM supplier),
scored AS (SELECT name, known, 1 - levenshtein(name, known) / greatest(length(name), length(known)) AS ratio FROM names, known)
SELECT name, arg_min(known, (-ratio, known)) AS known, round(max(ratio), 6) AS ratio FROM scored GROUP BY name""")
def _(t: Tables):
    names = t.supplier.select(F.lower("s_name").alias("raw"))
    known = t.supplier.where(F.col("s_suppkey") % 3 == 0).select(F.lower("s_name").alias("listed"))
    return J.closest_manufacturer(names, "raw", known, "listed").select("name", "known", r6("ratio").alias("ratio"))


@query("jn_cluster_members", """
SELECT vec_id, label AS cluster, d.source, d.lang FROM embeddings JOIN documents d ON d.doc_id = vec_id""")
def _(t: Tables):
    return t.embeddings.select("vec_id", F.col("label").alias("cluster")).join(
        t.documents.select(F.col("doc_id").alias("vec_id"), "source", "lang"), "vec_id"
    )


@query("jn_anti_new_vocab", f"""
WITH {W.WORDS}
SELECT doc_id, term, count(*) AS tf FROM words WHERE lang = 'fr' AND term IN (SELECT term FROM words WHERE lang = 'en')
GROUP BY ALL""")
def _(t: Tables):
    words = W.words(t)
    old = words.where(F.col("lang") == "en").select("term").distinct()
    new = words.where(F.col("lang") == "fr").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return J.keep_known_terms(new, old)


PAIRS_SQL = """
pairs AS (SELECT l_returnflag AS truth, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'R'
  WHEN l_discount > 0.05 THEN 'A' WHEN l_tax > 0.07 THEN 'X' ELSE 'N' END AS pred, l_linestatus AS grp FROM lineitem),
cells AS (SELECT truth, pred, count(*) AS n FROM pairs GROUP BY ALL),
classes AS (SELECT class, sum(support) AS support, sum(answers) AS answers, sum(hits) AS hits FROM (
  SELECT truth AS class, n AS support, 0 AS answers, CASE WHEN truth = pred THEN n ELSE 0 END AS hits FROM cells
  UNION ALL SELECT pred, 0, n, 0 FROM cells) GROUP BY class),
report AS (SELECT class, CAST(support AS BIGINT) AS support,
  CASE WHEN answers = 0 THEN 0 ELSE hits / answers END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
  CASE WHEN answers + support = 0 THEN 0 ELSE 2 * hits / (answers + support) END AS f1 FROM classes)"""


def truth_pairs(t: Tables):
    """Line items as (truth, prediction): the return flag, and a rule that guesses it."""
    pred = F.when(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"), "R").when(
        F.col("l_discount") > 0.05, "A").when(F.col("l_tax") > 0.07, "X").otherwise("N")
    return t.lineitem.select(F.col("l_returnflag").alias("truth"), pred.alias("pred"), F.col("l_linestatus").alias("grp"))


@query("jn_metric_report", f"""
WITH {PAIRS_SQL}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, coalesce(n, 0) AS n
FROM report LEFT JOIN (SELECT truth AS class, count(*) AS n FROM pairs GROUP BY ALL) USING (class)""")
def _(t: Tables):
    df = truth_pairs(t)
    sizes = A.counts(df, ["truth"]).withColumnRenamed("truth", "class")
    return EV.per_class(df, "truth", "pred").join(sizes, "class", "left").select(
        "class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# -- 2.5 aggregations ---------------------------------------------------------------


@query("agg_count_docs", """
SELECT count(*) AS docs, count(DISTINCT label) AS clusters, max(len(embedding))::BIGINT AS topics FROM embeddings""")
def _(t: Tables):
    return t.embeddings.agg(
        F.count("*").alias("docs"), F.count_distinct("label").alias("clusters"),
        F.max(F.size("embedding")).cast("long").alias("topics"),
    )


@query("agg_cluster_weight", """
SELECT label AS cluster, count(*) AS nb_docs, round(100 * count(*) / sum(count(*)) OVER (), 2) AS weight
FROM embeddings GROUP BY label""")
def _(t: Tables):
    return A.cluster_weight(t.embeddings.select(F.col("label").alias("cluster")), "cluster")


@query("agg_cluster_wordcount", f"""
WITH {W.WORDS}, c AS (SELECT source, term, count(*) AS n FROM words GROUP BY ALL)
SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 25""")
def _(t: Tables):
    return A.word_counts(W.words(t).select("source", "term"), "source")


@query("agg_wordcloud_text", f"""
SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex({W.sql_fold('text')}, '[^a-z]+'),
  lambda w: w <> '' AND w NOT IN ({W.sql_list(K.STOP_WORDS)}))) AS term FROM documents)
GROUP BY term ORDER BY n DESC, term LIMIT 30""")
def _(t: Tables):
    words = t.texts.select(F.explode(F.split(T.fold(F.col("text")), "[^a-z]+")).alias("term"))
    kept = words.where((F.col("term") != "") & ~F.col("term").isin(K.STOP_WORDS))
    return A.counts(kept, ["term"]).orderBy(F.col("n").desc(), "term").limit(30)


@query("agg_list_labels", f"""
WITH {W.DECLARATIONS}
SELECT text, array_to_string(list_sort(list(DISTINCT manufacturer)), ',') AS labels, count(*) AS copies FROM declarations GROUP BY text""")
def _(t: Tables):
    return t.documents.groupBy("text").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("labels"), F.count("*").alias("copies")
    )


@query("agg_dedup_text", """
SELECT doc_id, text, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(t: Tables):
    return A.first_by_text(t.documents.select("doc_id", "text", "source", "lang"), "text", "doc_id")


@query("agg_distinct_values", "SELECT DISTINCT source, lang FROM documents")
def _(t: Tables):
    return t.documents.select("source", "lang").distinct()


@query("agg_label_histogram", """
SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source""")
def _(t: Tables):
    counted = A.counts(t.documents, ["source"])
    return with_global_rank(counted, [F.col("n").desc(), F.col("source")])


@query("agg_missing_rate", f"""
WITH {W.DECLARATIONS}, wide AS (SELECT family, avg((effect IS NULL)::INT) AS effect, avg((severity IS NULL)::INT) AS severity,
  avg((text IS NULL)::INT) AS text FROM declarations GROUP BY family)
SELECT family, name AS "column", round(value, 6) AS missing FROM (UNPIVOT wide ON effect, severity, text)""")
def _(t: Tables):
    rates = A.missing_rate(W.declarations(t), ["family"], ["effect", "severity", "text"])
    return rates.select("family", "column", r6("missing").alias("missing"))


@query("agg_describe", """
SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min,
  quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS max
FROM documents GROUP BY lang""")
def _(t: Tables):
    return Q.describe(t.documents.select("lang", "n_chars"), ["lang"], "n_chars").select(
        "lang", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", "q25", "q50", "q75"
    )


@query("agg_correlation", f"""
WITH {W.DECLARATIONS}, f AS (SELECT (effect = 'E1454')::INT AS effect, (severity = 'CRITI')::INT AS severity,
  (declarant = '{K.CITIZEN}')::INT AS citizen FROM declarations WHERE effect IS NOT NULL)
SELECT 'effect' AS a, 'severity' AS b, round(corr(effect, severity), 6) AS corr FROM f
UNION ALL SELECT 'effect', 'citizen', round(corr(effect, citizen), 6) FROM f
UNION ALL SELECT 'severity', 'citizen', round(corr(severity, citizen), 6) FROM f""")
def _(t: Tables):
    d = W.declarations(t).where(F.col("effect").isNotNull())
    flags = d.select(
        (F.col("effect") == "E1454").cast("int").alias("effect"), (F.col("severity") == "CRITI").cast("int").alias("severity"),
        (F.col("declarant") == K.CITIZEN).cast("int").alias("citizen"),
    )
    return A.correlations(flags, ["effect", "severity", "citizen"]).select("a", "b", r6("corr").alias("corr"))


@query("agg_crosstab", f"""
WITH {PAIRS_SQL}
SELECT CASE WHEN grouping(truth) = 1 THEN 'All' ELSE truth END AS truth,
       CASE WHEN grouping(pred) = 1 THEN 'All' ELSE pred END AS pred, count(*) AS n
FROM pairs GROUP BY CUBE (truth, pred)""")
def _(t: Tables):
    return A.crosstab(truth_pairs(t), "truth", "pred")


@query("agg_confusion", f"WITH {PAIRS_SQL} SELECT truth, pred, n FROM cells")
def _(t: Tables):
    return A.confusion(truth_pairs(t), "truth", "pred")


MICRO_SQL = """
mrv AS (SELECT p_type AS dco, l_returnflag AS tef, l_linestatus AS tdy, n_name AS fab,
  CASE WHEN p_size > 25 THEN 'big' ELSE ' ' END AS cdy, CAST(substr(p_brand, 7) AS INTEGER) AS cluster
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT dco, tef, cdy, tdy, fab, cluster, count(*) AS n FROM mrv GROUP BY ALL),
micro AS (SELECT dco || ' ' || tef || ' ' || cdy || ' ' || tdy || ' ' || fab AS micro_label, dco, tef, cdy, tdy, fab,
  arg_max(cluster, (n, -cluster)) AS macro_cluster, CAST(sum(n) AS BIGINT) AS weight, max(n) / sum(n) AS score FROM g GROUP BY ALL),
owned AS (SELECT macro_cluster AS cluster, 1 / count(DISTINCT dco) AS dco_score,
  (1 / count(DISTINCT tef) + 1 / count(DISTINCT tdy) + 1 / count(DISTINCT cdy)) / 3 AS typology_score,
  1 / count(DISTINCT fab) AS manufacturer_score FROM micro GROUP BY ALL),
macro AS (SELECT cluster, weight, coalesce(dco_score, 0) AS dco_score, coalesce(typology_score, 0) AS typology_score,
  coalesce(manufacturer_score, 0) AS manufacturer_score
  FROM (SELECT cluster, count(*) AS weight FROM mrv GROUP BY ALL) LEFT JOIN owned USING (cluster))"""

MICRO_PARTS = {"dco": "dco", "tef": "tef", "cdy": "cdy", "tdy": "tdy", "fab": "fab"}


def mrv(t: Tables):
    """Line items as clustered declarations: part type, flags and nation as labels, brand as cluster."""
    return (
        t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("p_type").alias("dco"), F.col("l_returnflag").alias("tef"), F.when(F.col("p_size") > 25, "big").alias("cdy"),
            F.col("l_linestatus").alias("tdy"), F.col("n_name").alias("fab"),
            F.substring("p_brand", 7, 9).cast("int").alias("cluster"),
        )
    )


@query("agg_micro_clusters", f"""
WITH {MICRO_SQL} SELECT micro_label, macro_cluster, weight, round(score, 6) AS score FROM micro""")
def _(t: Tables):
    return A.micro_clusters(mrv(t), "cluster", MICRO_PARTS).select("micro_label", "macro_cluster", "weight", r6("score").alias("score"))


@query("agg_macro_clusters", f"""
WITH {MICRO_SQL}
SELECT cluster, weight, round(dco_score, 6) AS dco_score, round(typology_score, 6) AS typology_score,
  round(manufacturer_score, 6) AS manufacturer_score FROM macro""")
def _(t: Tables):
    df = mrv(t)
    macro = A.macro_clusters(df, "cluster", A.micro_clusters(df, "cluster", MICRO_PARTS))
    return macro.select("cluster", "weight", *[r6(c).alias(c) for c in ("dco_score", "typology_score", "manufacturer_score")])


@query("agg_micro_macro_score", f"""
WITH {MICRO_SQL}
SELECT (SELECT round(sum(weight * score) / sum(weight), 6) FROM micro) AS micro_score,
  round(sum(weight * (0.5 * dco_score + 0.3 * typology_score + 0.2 * manufacturer_score)) / sum(weight), 6) AS macro_score FROM macro""")
def _(t: Tables):
    df = mrv(t)
    micro = A.micro_clusters(df, "cluster", MICRO_PARTS)
    return A.micro_macro_score(micro, A.macro_clusters(df, "cluster", micro)).select(
        r6("micro_score").alias("micro_score"), r6("macro_score").alias("macro_score")
    )


@query("agg_class_weight", """
SELECT source, count(*) AS n, round(pow(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 1 / 1.5), 6) AS weight
FROM documents GROUP BY source""")
def _(t: Tables):
    return A.class_weight(t.documents, "source").select("source", "n", r6("weight").alias("weight"))


CLASS_SCHEMES = ("balanced", "soft", "root", "log", "steps")


@query("agg_class_weight_schemes", """
WITH c AS (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY ALL),
w AS (SELECT p_size, p_brand, n, sum(n) OVER () / (count(*) OVER () * n) AS b FROM c)
SELECT p_size, p_brand, n, round(b, 6) AS balanced, round(pow(b, 1 / 1.2), 6) AS soft, round(sqrt(b), 6) AS root, round(ln(b + 300), 6) AS log,
  CAST(CASE WHEN n < 10 THEN 10 WHEN n < 100 THEN 5 WHEN n < 500 THEN 1 WHEN n < 1000 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS steps FROM w""")
def _(t: Tables):
    labelled = t.part.select(F.struct("p_size", "p_brand").alias("label"))
    tables = [A.class_weight(labelled, "label", s).withColumn("scheme", F.lit(s)) for s in CLASS_SCHEMES]
    long = tables[0]
    for table in tables[1:]:
        long = long.unionByName(table)
    wide = long.groupBy("label", "n").pivot("scheme", list(CLASS_SCHEMES)).agg(r6(F.first("weight")))
    return wide.select("label.p_size", "label.p_brand", "n", *CLASS_SCHEMES)


@query("agg_seq_stats", f"""
SELECT lang, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median
FROM (SELECT lang, len({W.sql_tokens('text')}) AS n FROM documents) GROUP BY lang""")
def _(t: Tables):
    n = stage(t.texts.select("lang", F.size(T.tokens(F.col("text"))).cast("long").alias("n")))
    half = Q.quantile_column(n, ["lang"], "n", 0.5, "median")
    return n.groupBy("lang").agg(F.min("n").alias("min"), F.max("n").alias("max"), r6(F.avg("n")).alias("mean")).join(half, "lang")


@query("agg_review_scores", """
SELECT quality AS score, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality""")
def _(t: Tables):
    shared = A.with_total_share(A.counts(t.labels.select(F.col("quality").alias("score")), ["score"]), "n", "share")
    return shared.select("score", "n", r6("share").alias("share"))


# -- 2.6 windows and ranks ---------------------------------------------------------


@query("win_rank_predictions", f"""
WITH {W.PREDICTIONS} SELECT file, model, class, round(proba, 6) AS proba, rank FROM ranked""")
def _(t: Tables):
    return W.ranked(t).select("file", "model", "class", r6("proba").alias("proba"), "rank")


@query("win_topk_predictions", f"""
WITH {W.PREDICTIONS} SELECT file, model, class_name, round(100 * proba, 2) AS percent, rank FROM ranked WHERE rank <= 10""")
def _(t: Tables):
    from declara.operators.predictions import as_percentages

    return as_percentages(W.ranked(t, 10)).select("file", "model", "class_name", "percent", "rank")


@query("win_top2_predictions", f"""
WITH {W.PREDICTIONS} SELECT file, model, class, round(proba, 6) AS proba, rank FROM ranked WHERE rank <= 2""")
def _(t: Tables):
    return W.ranked(t, 2).select("file", "model", "class", r6("proba").alias("proba"), "rank")


@query("win_share", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem""")
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    shared = A.with_share(lines, ["l_orderkey"], "l_extendedprice", "share")
    return shared.select("l_orderkey", "l_linenumber", r6("share").alias("share"))


@query("win_majority_cluster", f"WITH {MICRO_SQL} SELECT micro_label, macro_cluster FROM micro")
def _(t: Tables):
    return A.micro_clusters(mrv(t), "cluster", MICRO_PARTS).select("micro_label", "macro_cluster")


@query("win_quantile_band", f"""
WITH {W.WORDS}, s AS (SELECT term, count(*) AS n FROM words GROUP BY term),
q AS (SELECT quantile_cont(n, 0.45) AS lo, quantile_cont(n, 0.55) AS hi FROM s)
(SELECT term, n, 'best' AS band FROM s ORDER BY n DESC, term LIMIT 15) UNION ALL
(SELECT term, n, 'worst' FROM s ORDER BY n, term LIMIT 15) UNION ALL
SELECT term, n, 'middle' FROM s, q WHERE n > lo AND n < hi""")
def _(t: Tables):
    from declara.operators.topics import review_band

    return review_band(stage(A.counts(W.words(t), ["term"])), "term", "n", 15)


@query("win_rank_slice", """
SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source
QUALIFY rank BETWEEN 6 AND 15""")
def _(t: Tables):
    ranked = with_global_rank(A.counts(t.documents, ["source"]), [F.col("n").desc(), F.col("source")])
    return ranked.where(F.col("rank").between(6, 15))


@query("win_random_sample", "SELECT doc_id, source, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def _(t: Tables):
    return t.documents.select("doc_id", "source", "lang").orderBy(draw(7, "doc_id"), "doc_id").limit(50)


@query("srt_by_length", """
SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS place FROM documents""")
def _(t: Tables):
    sized = t.documents.select("doc_id", F.length("text").cast("long").alias("n"))
    return with_global_rank(sized, [F.col("n"), F.col("doc_id")], "place")


# -- 2.7 set operations ---------------------------------------------------------------


@query("set_union_corpora", """
SELECT doc_id, text, lang, NULL::VARCHAR AS source FROM documents WHERE lang = 'fr'
UNION ALL SELECT doc_id, text, lang, source FROM documents WHERE lang <> 'fr'""")
def _(t: Tables):
    old = t.documents.where(F.col("lang") != "fr").select("doc_id", "text", "lang", "source")
    new = t.documents.where(F.col("lang") == "fr").select("doc_id", "text", "lang")
    return old.unionByName(new, allowMissingColumns=True)


@query("set_union_files", "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def _(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("id"), "text").unionByName(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("set_label_new_keys", """
SELECT DISTINCT p_name AS value FROM part WHERE p_size > 40 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 3)""")
def _(t: Tables):
    old = t.part.where(F.col("p_size") <= 3).select(F.col("p_name").alias("value")).distinct()
    return E.new_values(old, t.part.where(F.col("p_size") > 40), "p_name")


@query("set_never_predicted", f"""
WITH {PAIRS_SQL}
SELECT class, CASE WHEN p = 0 THEN 'never predicted' WHEN t = 0 THEN 'never true' ELSE 'both' END AS seen FROM (
  SELECT class, max(t) AS t, max(p) AS p FROM (SELECT truth AS class, 1 AS t, 0 AS p FROM cells
  UNION ALL SELECT pred, 0, 1 FROM cells) GROUP BY class)""")
def _(t: Tables):
    return EV.never_predicted(truth_pairs(t), "truth", "pred")


@query("set_stopword_union", f"""
WITH {W.WORDS}, frequent AS (SELECT term FROM words GROUP BY term HAVING count(DISTINCT doc_id) > 0.5 * (SELECT count(*) FROM documents))
SELECT term FROM frequent UNION SELECT {W.sql_fold('lang')} FROM documents""")
def _(t: Tables):
    distinct = t.texts.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    stats = distinct.groupBy("term").agg(F.count("*").alias("df"))
    frequent = stats.where(F.col("df") > 0.5 * t.documents.select(F.count("*")).scalar()).select("term")
    return frequent.unionByName(t.documents.select(T.fold(F.col("lang")).alias("term"))).distinct()


@query("set_oversample_rare", """
WITH s AS (SELECT source, count(*) AS c FROM documents GROUP BY source)
SELECT doc_id, source, unnest(range(0, CASE WHEN c < 60 THEN 61 ELSE 1 END))::INT AS copy
FROM (SELECT doc_id, source FROM documents) JOIN s USING (source)""")
def _(t: Tables):
    return A.oversample_rare(t.documents.select("doc_id", "source"), "source", 60)
