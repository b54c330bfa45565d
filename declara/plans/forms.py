"""Forms, sources and sinks. Files are written from the driver tables into a fresh shared path
and read back, so every reader and writer works on data that grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara.operators import forms as FM
from declara.operators import topics as TP
from declara.plans import views as W
from declara.plans.registry import Tables, query
from declara.plans.views import r6
from declara.runtime import new_path
from declara.sources import readers as R
from declara.sources import writers as S


def _rows(t: Tables):
    """Conversations as forms: conversation = file, turn = order, role = question, text = answer."""
    return t.conversations.select(
        F.col("conv_id").alias("file"), F.col("turn").alias("seq"), F.col("role").alias("key"),
        F.when(F.col("turn") == 3, "None").otherwise(F.col("text")).alias("value"),
    )


ANSWERS_SQL = """
answers AS (SELECT conv_id AS file, role AS key, arg_max(replace(text, chr(10), ' '), turn) AS value FROM conversations
  WHERE turn <> 3 AND text <> 'None' GROUP BY ALL)"""


@query("src_form_csv", f"""
WITH {ANSWERS_SQL}
SELECT file, max(value) FILTER (key = 'user') AS "user", max(value) FILTER (key = 'assistant') AS assistant, max(value) FILTER (key = 'system') AS system
FROM answers GROUP BY file""")
def _(t: Tables):
    return FM.to_wide(FM.last_answers(_rows(t)), ["user", "assistant", "system"])


@query("src_form_csv_files", f"""
WITH {ANSWERS_SQL}
SELECT file, max(value) FILTER (key = 'user') AS "user", max(value) FILTER (key = 'assistant') AS assistant, max(value) FILTER (key = 'system') AS system
FROM answers GROUP BY file""")
def _(t: Tables):
    """The same forms, each from a key/value CSV file of its own."""
    path = new_path(t.spark, "forms")
    rows = _rows(t).repartition("file").sortWithinPartitions("file", "seq").select("file", F.col("key").alias("Column0"), F.col("value").alias("Column1"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("file").csv(path)
    answers = FM.last_answers(R.form_csv(t.spark, path))
    named = answers.withColumn("file", F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long"))
    return FM.to_wide(named, ["user", "assistant", "system"])


def _mapping(t: Tables):
    """Field mapping derived from the roles that occur: every field lists its questions in order."""
    entries = {"DESCRIPTION": ["user", "assistant"], "ETAT": ["system", "user"], "NOTE": ["system"]}
    rows = F.array(*[
        F.struct(F.lit(target).alias("target"), F.lit(i).alias("ord"), F.lit(source).alias("source"))
        for target, sources in entries.items() for i, source in enumerate(sources)
    ])
    roles = t.conversations.select(F.col("role").alias("r")).distinct()
    return roles.select("r", F.inline(rows)).where(F.col("source") == F.col("r")).drop("r")


@query("prj_field_mapping", f"""
WITH {ANSWERS_SQL}, mapping AS (SELECT * FROM (VALUES ('DESCRIPTION', 0, 'user'), ('DESCRIPTION', 1, 'assistant'), ('ETAT', 0, 'system'),
  ('ETAT', 1, 'user'), ('NOTE', 0, 'system')) m(target, ord, source))
SELECT file, target, nullif(trim(string_agg(trim(value), ' ' ORDER BY ord)), '') AS value FROM answers JOIN mapping ON key = source GROUP BY ALL""")
def _(t: Tables):
    return FM.map_fields(FM.last_answers(_rows(t)), _mapping(t))


@query("prj_declarant_from_keys", f"""
WITH {ANSWERS_SQL}
SELECT file, CASE WHEN count(*) FILTER (key = 'system') > 0 THEN 'Etablissements et professionnels de santé'
  WHEN count(*) FILTER (key = 'user') > 0 THEN 'Citoyen' END AS declarant FROM answers GROUP BY file""")
def _(t: Tables):
    answers = FM.last_answers(_rows(t))
    asked = F.when(F.col("key") == "system", "Profession").when(F.col("key") == "user", "Nom").otherwise("Autre")
    return FM.declarant(answers.withColumn("key", asked))


def _escape(c):
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", " ")


def _cda(t: Tables):
    """One clinical document per conversation, each turn a table row of four cells."""
    text = F.trim(F.regexp_replace("text", r"[\x00-\x20]+", " "))
    cells = F.concat(
        F.lit("<tr><td>"), "role", F.lit("</td><td>"), _escape(text), F.lit("</td><td>turn "), F.col("turn").cast("string"),
        F.lit("</td><td>done</td><td>odd</td></tr>"),
    )
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cells.alias("x")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["x"]), "")
    return rows.select("conv_id", F.concat(
        F.lit('<ClinicalDocument><id extension="R'), F.col("conv_id").cast("string"), F.lit('"/><title>Réactovigilance (PS)</title>'
              "<component><structuredBody><component><section><text><table><tbody>"),
        body, F.lit("</tbody></table></text></section></component></structuredBody></component></ClinicalDocument>"),
    ).alias("xml"))


CELLS_SQL = r"""
cells AS (SELECT conv_id, turn, role AS key, trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g')) AS value FROM conversations
  UNION ALL SELECT conv_id, turn, 'turn ' || turn, 'done' FROM conversations)"""


@query("src_form_xml", f"""
WITH {CELLS_SQL} SELECT 'r' || conv_id AS declaration, key, value, count(*) AS n FROM cells WHERE value <> '' GROUP BY ALL""")
def _(t: Tables):
    parsed = FM.parse_cda(_cda(t), "conv_id", F.col("xml"))
    rows = FM.cda_rows(parsed).join(parsed.select("file", "declaration"), "file")
    return rows.where(F.col("value") != "").groupBy("declaration", "key", "value").agg(F.count("*").alias("n"))


@query("src_form_xml_soap", f"""
WITH {CELLS_SQL}
SELECT conv_id AS file, CASE WHEN conv_id % 2 = 0 THEN 'materiovigilance' END AS vigilance, CASE WHEN conv_id % 2 = 0 THEN 'ref-' || conv_id END AS declaration,
  count(*) FILTER (value <> '') AS answers FROM cells GROUP BY ALL""")
def _(t: Tables):
    soap = F.concat(
        F.lit("<soap:Envelope><soap:Body><ns8:typeSignalement>MATERIOVIGILANCE</ns8:typeSignalement><ns14:referenceDeclaration>REF-"),
        F.col("conv_id").cast("string"), F.lit("</ns14:referenceDeclaration><ns8:cda>"), F.base64(F.col("xml").cast("binary")),
        F.lit("</ns8:cda></soap:Body></soap:Envelope>"),
    )
    files = _cda(t).select("conv_id", F.when(F.col("conv_id") % 2 == 0, soap).otherwise(F.col("xml")).alias("xml"))
    opened = FM.unwrap_soap(files, "conv_id", F.col("xml"))
    rows = FM.cda_rows(FM.parse_cda(opened, "file", F.col("xml"))).where(F.col("value") != "")
    counted = rows.groupBy("file").agg(F.count("*").alias("answers"))
    return opened.select("file", "vigilance", "declaration").join(counted, "file")


# -- sources and sinks, written and read back -----------------------------------------------------


def _declarations(t: Tables):
    filled = {"NUMERO_DECLARATION": F.concat(F.lit("R"), "doc_id"), "DESCRIPTION_INCIDENT": F.col("text"),
              "FABRICANT": F.col("source"), "DCO": F.col("lang")}
    return t.documents.select(*[
        filled.get(c, F.lit(None).cast("string")).alias(c) for c in R.DECLARATION_COLUMNS
    ])


@query("src_csv_declarations", """
SELECT 'R' || doc_id AS NUMERO_DECLARATION, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS DESCRIPTION_INCIDENT,
  source AS FABRICANT, lang AS DCO FROM documents""")
def _(t: Tables):
    path = new_path(t.spark, "declarations")
    S.csv(_declarations(t), path)
    read = R.declarations_csv(t.spark, path)
    return read.select(
        "NUMERO_DECLARATION", F.regexp_replace("DESCRIPTION_INCIDENT", "\r\n?", "\n").alias("DESCRIPTION_INCIDENT"), "FABRICANT", "DCO"
    )


@query("src_csv_reference", "SELECT n_nationkey AS DCO_ID, 'Réactif ' || n_name AS LIBELLE FROM nation")
def _(t: Tables):
    path = new_path(t.spark, "reference")
    named = t.nation.select(F.col("n_nationkey").alias("DCO_ID"), F.concat(F.lit("Réactif "), "n_name").alias("LIBELLE"))
    named.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return R.reference_csv(t.spark, path, R.DEVICES)


@query("src_csv_pipe", "SELECT p_name AS Column0, p_brand AS Column1 FROM part")
def _(t: Tables):
    path = new_path(t.spark, "pipe")
    S.csv(t.part.select(F.col("p_partkey").cast("int").alias("_index"), F.col("p_name").alias("Column0"), F.col("p_brand").alias("Column1")), path, "|")
    return R.pipe_csv(t.spark, path, R.FORM_ROWS)


@query("src_json_frame", "SELECT s_suppkey::VARCHAR AS row, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def _(t: Tables):
    path = new_path(t.spark, "columns")
    key = F.col("s_suppkey").cast("string")
    # One object per part of the table: a column-oriented file holds its rows as one value.
    part = F.pmod(F.xxhash64("s_suppkey"), F.lit(16))
    objects = t.supplier.groupBy(part.alias("p")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, "s_name"))).alias("name"),
        F.map_from_entries(F.collect_list(F.struct(key, F.col("s_nationkey").cast("string")))).alias("nation"),
    )
    objects.select(F.to_json(F.struct("name", "nation")).alias("value"), "p").repartition("p").write.partitionBy("p").text(path)
    return R.column_json(t.spark, f"{path}/p=*", ["name", "nation"])


def _file_tree(t: Tables):
    path = new_path(t.spark, "tree")
    t.documents.select("text", "lang", "source").write.partitionBy("lang", "source").text(path)
    return path


@query("src_list_files", "SELECT lang, count(DISTINCT source) AS folders FROM documents GROUP BY lang")
def _(t: Tables):
    found = R.list_files(t.spark, _file_tree(t), "PART-*.TXT")
    lang = F.regexp_extract("path", "lang=([^/]+)", 1)
    source = F.regexp_extract("path", "source=([^/]+)", 1)
    return found.groupBy(lang.alias("lang")).agg(F.count_distinct(source).alias("folders"))


@query("src_detect_format", """
SELECT p_brand AS brand, CASE WHEN brand_no % 3 = 0 THEN 'pdf' WHEN brand_no % 3 = 1 THEN 'csv' END AS format
FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no FROM part)""")
def _(t: Tables):
    path = new_path(t.spark, "formats")
    number = F.substring("p_brand", 7, 9).cast("int")
    texts = t.part.groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("no", number)
    body = F.concat(F.when(F.col("no") % 3 == 0, "%PDF-1.4 ").otherwise("n "), F.col("n").cast("string"))
    lines = texts.select(body.alias("value"), F.regexp_replace("p_brand", "#", "_").alias("brand"), (F.col("no") % 3).alias("kind"))
    lines.where("kind = 1").select("value", "brand").write.partitionBy("brand").csv(f"{path}/a")
    lines.where("kind <> 1").select("value", "brand").write.partitionBy("brand").text(f"{path}/b")
    found = R.detect_format(t.spark, path)
    brand = F.replace(F.regexp_extract("path", "brand=([^/]+)", 1), F.lit("_"), F.lit("#"))
    return found.select(brand.alias("brand"), "format")


@query("src_skip_processed", """
SELECT doc_id, 'in/declaration_' || doc_id || '.xml' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t: Tables):
    listing = t.documents.select("doc_id", F.concat(F.lit("in/declaration_"), "doc_id", F.lit(".xml")).alias("path"))
    done = t.labels.select(F.concat(F.lit("out/declaration_"), "doc_id", F.lit(".csv")).alias("path"))
    return R.skip_processed(listing, done)


@query("src_sparse_matrix", "SELECT l_orderkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL")
def _(t: Tables):
    path = new_path(t.spark, "matrix")
    cells = t.lineitem.groupBy(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    S.parquet(cells, path)
    return R.coordinates(t.spark, path)


@query("src_libsvm", """
SELECT label::DOUBLE AS label, i, count(*) AS n, round(sum(x), 4) AS total
FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i""")
def _(t: Tables):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    path = new_path(t.spark, "libsvm")
    rows = t.embeddings.select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows.write.format("libsvm").save(path)
    read = R.libsvm(t.spark, path, 64).select("label", F.posexplode(vector_to_array("features")).alias("i", "x"))
    return read.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("snk_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t: Tables):
    path = new_path(t.spark, "csv")
    S.csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return t.spark.read.schema("s_suppkey long, s_name string, s_acctbal double").option("header", True).csv(path)


@query("snk_json", "SELECT vec_id, label, unnest(range(len(embedding))) AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def _(t: Tables):
    path = new_path(t.spark, "json")
    S.json(t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")), path)
    read = t.spark.read.schema("vec_id long, label int, embedding array<double>").json(path)
    return read.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select("vec_id", "label", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query("snk_parquet", "SELECT doc_id, text, lang, source FROM documents")
def _(t: Tables):
    path = new_path(t.spark, "parquet")
    S.parquet(t.documents.select("doc_id", "text", "lang", "source"), path)
    return t.spark.read.parquet(path)


@query("snk_train_test", """
SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts, 0::BIGINT AS straddling, TRUE AS a_fifth FROM documents""")
def _(t: Tables):
    from declara.operators.encode import split_by_text

    path = new_path(t.spark, "split")
    S.train_test(split_by_text(t.documents.select("doc_id", "text", "source"), "text").drop("text"), "is_test", path)
    both = [t.spark.read.schema("doc_id long, source string").option("header", True).option("sep", "|").csv(f"{path}/{side}").withColumn("test", F.lit(i))
            for i, side in enumerate(("train", "test"))]
    rows = both[0].unionByName(both[1]).join(t.documents.select("doc_id", F.md5("text").alias("text")), "doc_id")
    texts = rows.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("test").alias("sides"), F.max("test").alias("test"))
    return texts.agg(
        F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.count("*").alias("texts"), F.count_if(F.col("sides") > 1).alias("straddling"),
        F.avg("test").between(0.1, 0.3).alias("a_fifth"))


@query("snk_versioned_append", """
SELECT doc_id, lang, CASE WHEN lang <> 'fr' THEN source END AS source FROM documents""")
def _(t: Tables):
    path = new_path(t.spark, "version")
    old = t.documents.where(F.col("lang") != "fr").select("doc_id", "lang", "source")
    S.versioned_union(old, t.documents.where(F.col("lang") == "fr").select("doc_id", "lang"), path)
    return t.spark.read.parquet(path)


@query("snk_result_sheet", f"""
WITH {W.PREDICTIONS}
SELECT file, class AS dco_id, class_name || '  (' || round(proba, 3) || ')' AS dco FROM ranked WHERE model = 'DCO' AND rank = 1""")
def _(t: Tables):
    from declara.operators import predictions as P

    path = new_path(t.spark, "sheet")
    files = t.orders.select(F.col("o_orderkey").alias("file"))
    S.csv(P.result_rows(W.ranked(t, 2), files, {"DCO": (None, None)}), path)
    read = t.spark.read.schema("file long, DCO_class string, DCO string").option("header", True).csv(path)
    return read.select("file", F.col("DCO_class").alias("dco_id"), F.col("DCO").alias("dco"))


@query("snk_metrics", "SELECT count(*) AS n, round(avg(quality), 6) AS quality FROM labels")
def _(t: Tables):
    path = new_path(t.spark, "metrics")
    S.metrics(t.labels.agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("quality")), path)
    return t.spark.read.schema("n long, quality double").json(path)


@query("snk_topic_docs", f"""
WITH {W.TOPIC_ROWS} SELECT topic::INT AS topic, vec_id, round(weight, 6) AS weight FROM topic_rows WHERE weight > 0.03""")
def _(t: Tables):
    path = new_path(t.spark, "topics")
    S.topic_documents(TP.significant(W.topic_rows(t), 0.03).select("topic", "vec_id", r6("weight").alias("weight")), path)
    return t.spark.read.schema("vec_id long, weight double, topic int").parquet(path)
