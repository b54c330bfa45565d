"""Batch prediction: score tables in, one ranked and corrected prediction table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.operators import clusters as C
from declara.operators import predictions as P
from declara.operators import topics as TP
from declara.operators.joins import family_name
from declara.operators.projections import text_concat
from declara.runtime import skew_safe_lookup


def all_models(
    scores: DataFrame, names: DataFrame, forms: DataFrame, devices: DataFrame
) -> DataFrame:
    """(file, model, rank, class, class_name, proba) for N files at once.

    ``scores`` is ``(file, model, class, proba)``, ``names`` ``(model, class, class_name)``, ``forms`` the
    declaration rows with a ``file`` column, ``devices`` the reference table (DCO_ID, LIBELLE).
    Retired dysfunctions leave; the reference-table, death and virology rules follow. The predictions are dealt out by file once;
    ranks and rules read them where they are.
    """
    named = P.rank_predictions(_named(scores, names).where(F.coalesce("class_name", F.lit("")) != "INACTIF").repartition("file"), ["file", "model"])
    listed = P.family_override(forms, "file", "TYPE_DECLARANT", "LIBELLE_COMMERCIAL", "DM", devices, "DCO_ID", "LIBELLE")
    decided = family_name(listed, "class", devices, "DCO_ID", "LIBELLE", "class_name").withColumn("class", F.col("class").cast("string"))
    with_family = P.apply_override(named, ["DCO"], decided)
    text = text_concat(F.col("DESCRIPTION_INCIDENT"), F.col("ETAT_PATIENT"))
    return P.virology_override(P.death_override(with_family, forms, "file", text))


def _named(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Scores with ``class_name``. A class is taken to hold an even share of its model's rows: those of models with few classes are
    looked up map-side, the others by class."""
    of_model = names.groupBy("model").agg((1 / F.count("*")).alias("_share"))
    shared = names.join(of_model, "model").select("model", "class", "class_name", "_share")
    return skew_safe_lookup(scores.select("file", "model", "class", "proba"), shared, ["model", "class"], "_share", F.xxhash64("file"), inner=False).drop("_share")


def one_model(table: DataFrame, model: str, k: int = 10) -> DataFrame:
    """The k best classes of one model with percentages."""
    return P.as_percentages(table.where((F.col("model") == model) & (F.col("rank") <= k)))


def severity(table: DataFrame) -> DataFrame:
    return table.where(F.col("model").isin("gravité_ordinale", "gravité_binaire"))


def clustering(documents: DataFrame, file: str, num: Column, cat: Column, model, names: DataFrame, k: int = 3, m: float = 2.0) -> DataFrame:
    """(file, model, rank, class, class_name, proba): the k clusters with the largest memberships, which sum to 1.
    ``names`` is ``(cluster, title)``."""
    best = C.best_members(C.with_memberships(documents.select(file, num.alias("num"), cat.alias("cat")), model, F.col("num"), F.col("cat"), m, k=k), file)
    named = best.join(names, "cluster", "left")
    return named.select(
        F.col(file).alias("file"), F.lit("cluster").alias("model"), F.col("rank").cast("long").alias("rank"), F.col("cluster").cast("string").alias("class"),
        F.coalesce("title", F.lit("")).alias("class_name"), "proba")


def topics(weights: DataFrame, file: str, names: DataFrame, k: int = 5) -> DataFrame:
    """The same columns for the k heaviest topics of long ``weights`` (file, topic, weight). ``names`` is ``(topic, title)``."""
    best = TP.document_topics(weights, file, k).join(names, "topic", "left")
    return best.select(
        F.col(file).alias("file"), F.lit("topics").alias("model"), F.col("rank").cast("long").alias("rank"), F.col("topic").cast("string").alias("class"),
        F.coalesce("title", F.lit("")).alias("class_name"), F.col("weight").alias("proba"))


def performances(df: DataFrame, truth: str, predicted: str, declarant: str) -> DataFrame:
    """Scores over all declarations and per declarant group."""
    from declara.operators.evaluate import group_scores

    return group_scores(df, truth, predicted, declarant)
