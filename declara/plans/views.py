"""The driver tables in the roles of declarations, topic matrix and predictions, each as
a DataFrame and as the SQL that defines the same rows.

documents -> declarations: doc_id row id, text description, source manufacturer and cluster,
lang device family, labels severity and effect. embeddings -> document x topic matrix, the
label being the cluster. lineitem -> class predictions of orders. conversations -> forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import text as T
from declara.functions import vectors as V
from declara.plans.registry import Tables


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_text(value: str) -> str:
    """A SQL literal; control characters are spelled as chr() so that the text stays plain."""
    parts, plain = [], ""
    for ch in value:
        if ord(ch) < 32 or 127 <= ord(ch) < 160:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


# -- text expressions in SQL ---------------------------------------------------


def sql_deaccent(x: str) -> str:
    for ligature, letters in K.LIGATURES.items():
        x = f"replace({x}, '{ligature}', '{letters}')"
    return f"translate({x}, '{K.ACCENTED}', '{K.UNACCENTED}')"


def sql_fold(x: str) -> str:
    return sql_deaccent(f"lower({x})")


def sql_tokens(x: str, stop=tuple(K.STOP_WORDS + K.MEASURE_WORDS)) -> str:
    words = f"list_filter(string_split_regex({sql_fold(x)}, '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({sql_list(stop)}))"
    letters = f"flatten(list_transform({words}, lambda w: string_split_regex(w, '[0-9]+')))"
    return f"list_filter({letters}, lambda w: length(w) > 2)"


# -- declarations ----------------------------------------------------------------

SEVERITIES = list(K.SEVERITY_CODES)


def declarations(t: Tables) -> DataFrame:
    """Documents with their labels: severity, effect and declarant are null without a label."""
    labels = t.labels
    return t.documents.join(labels, "doc_id", "left").select(
        "doc_id", "text", F.col("source").alias("manufacturer"), F.col("lang").alias("family"),
        F.when(F.col("quality") == 1, F.lit("E1213")).when(F.col("quality") == 0, F.lit("E1454")).alias("effect"),
        F.when(F.col("toxic") == 1, F.lit("CRITI")).when(F.col("toxic") == 0, F.lit("NULLE")).alias("severity"),
        F.when(F.col("n_chars") % 2 == 0, F.lit(K.CITIZEN)).otherwise(F.lit(K.PROFESSIONAL)).alias("declarant"),
        "n_chars",
    )


DECLARATIONS = f"""
declarations AS (
  SELECT d.doc_id, d.text, d.source AS manufacturer, d.lang AS family,
         CASE l.quality WHEN 1 THEN 'E1213' WHEN 0 THEN 'E1454' END AS effect,
         CASE l.toxic WHEN 1 THEN 'CRITI' WHEN 0 THEN 'NULLE' END AS severity,
         CASE WHEN d.n_chars % 2 = 0 THEN '{K.CITIZEN}' ELSE '{K.PROFESSIONAL}' END AS declarant,
         d.n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def words(t: Tables) -> DataFrame:
    """(doc_id, source, lang, term): one row per word of every document."""
    return t.texts.select("doc_id", "source", "lang", F.explode(T.tokens(F.col("text"))).alias("term"))


WORDS = f"""
words AS (
  SELECT doc_id, source, lang, unnest({sql_tokens('text')}) AS term FROM documents
)"""

BOW = WORDS + """,
bow AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM bow GROUP BY term)"""


# -- topics ------------------------------------------------------------------------


def doc_topics(t: Tables) -> DataFrame:
    """(vec_id, label, weights): absolute vector entries scaled to sum 1."""
    return t.embeddings.select("vec_id", "label", V.to_shares(V.doubles(F.col("embedding"))).alias("weights"))


def topic_rows(t: Tables) -> DataFrame:
    return doc_topics(t).select("vec_id", "label", F.posexplode("weights").alias("topic", "weight"))


TOPIC_ROWS = """
entries AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS topic, unnest(embedding)::DOUBLE AS x FROM embeddings
),
topic_rows AS (
  SELECT vec_id, label, topic, abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id) AS weight FROM entries
)"""


def vectors(t: Tables) -> DataFrame:
    """(vec_id, label, num): the embeddings as doubles."""
    return t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("num"))


CENTRES = """
entries AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings
),
centres AS (SELECT label AS cluster, i, avg(x) AS c FROM entries GROUP BY ALL)"""

DISTANCES = CENTRES + """,
distances AS (
  SELECT vec_id, label, cluster, sum((x - c) * (x - c)) AS d
  FROM entries JOIN centres USING (i) GROUP BY ALL
)"""


# -- predictions --------------------------------------------------------------------


def prediction_items(t: Tables, deal: bool = True) -> DataFrame:
    """(file, model, class, v): what every line says of its order, four models from one scan of lineitem.

    The lines are dealt out by order as they are, so that sums, shares, ranks and all else by file find their rows in place."""
    def of(model, name, value):
        return F.struct(F.lit(model).alias("model"), name.alias("class"), F.col(value).alias("v"))

    item = F.explode(F.array(
        of("DCO", F.col("l_suppkey").cast("string"), "l_extendedprice"),
        of("dysfonctionnement", F.concat(F.lit("D"), F.col("l_partkey")), "l_quantity"),
        of("consequence", F.concat(F.lit("C"), F.ascii("l_returnflag") - 65), "l_extendedprice"),
        of("effet", F.when(F.col("l_linestatus") == "O", "E1213").otherwise("E1454"), "l_quantity"),
    ))
    lines = t.lineitem.select(F.col("l_orderkey").alias("file"), "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    return (lines.repartition("file") if deal else lines).select("file", item.alias("x")).select("file", "x.*")


def predictions(t: Tables) -> DataFrame:
    """(file, model, class, class_name, proba): an order's suppliers by price share ('DCO'),
    parts by quantity share ('dysfonctionnement'), ship flags ('consequence') and line states
    ('effet') by price share. Four grouped shares from one scan of lineitem."""
    summed = prediction_items(t).groupBy("file", "model", "class").agg(F.sum("v").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("file", "model"))
    return summed.select("file", "model", "class", F.concat(F.lit("label "), F.col("class")).alias("class_name"), share.alias("proba"))


PREDICTIONS = """
items AS (
  SELECT l_orderkey AS file, 'DCO' AS model, l_suppkey::VARCHAR AS class, l_extendedprice AS v FROM lineitem
  UNION ALL SELECT l_orderkey, 'dysfonctionnement', 'D' || l_partkey, l_quantity FROM lineitem
  UNION ALL SELECT l_orderkey, 'consequence', 'C' || (ascii(l_returnflag) - 65), l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, 'effet', CASE WHEN l_linestatus = 'O' THEN 'E1213' ELSE 'E1454' END, l_quantity FROM lineitem
),
summed AS (SELECT file, model, class, sum(v) AS v FROM items GROUP BY ALL),
predictions AS (
  SELECT file, model, class, 'label ' || class AS class_name, round(v / sum(v) OVER (PARTITION BY file, model), 12) AS proba FROM summed
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file, model ORDER BY proba DESC, class) AS rank FROM predictions
)"""


def ranked(t: Tables, k: int | None = None) -> DataFrame:
    """Ranked predictions. Probabilities are compared on 12 decimals: equal shares tie whatever
    the order in which an engine summed them."""
    from declara.operators.predictions import rank_predictions

    rounded = predictions(t).withColumn("proba", F.round("proba", 12))
    return rank_predictions(rounded, ["file", "model"], k=k)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
