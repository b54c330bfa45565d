"""Look-ups in reference tables. No side is hinted: Catalyst broadcasts a table
only when its measured size is below the session's threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import text as T
from declara.operators.names import closest
from declara.runtime import stage


def first_per_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key, found by a map-side combined minimum."""
    others = [c for c in table.columns if c != key]
    first = F.min_by(F.struct(*others), F.col(order))
    return table.groupBy(key).agg(first.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in others])


def label_name(
    df: DataFrame, code: str, reference: DataFrame, key: str, name: str, what: str, empty: Column, active: str | None = None
) -> DataFrame:
    """Adds ``class_name``: the reference label of a code; '' for the empty code,
    'Libelle inconnu; <what> = code' when unknown, 'INACTIF' for retired entries."""
    columns = [F.col(key).alias("_key"), F.col(name).alias("_name")]
    if active:
        columns.append(F.col(active).alias("_active"))
    joined = df.join(reference.select(*columns), F.col(code) == F.col("_key"), "left")
    found = F.col("_name")
    if active:
        found = F.when(F.col("_active") == F.lit(False), F.lit("INACTIF")).otherwise(found)
    unknown = F.concat(F.lit(f"Libelle inconnu; {what} = "), F.col(code).cast("string"))
    named = F.when(F.col("_key").isNotNull(), found).when(empty, F.lit("")).otherwise(unknown)
    return joined.withColumn("class_name", named).drop("_key", "_name", "_active")


def family_name(df: DataFrame, code: str, reference: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Device-family label, 'NON_LISTE' when the code is not in the reference."""
    dim = reference.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    return (
        df.join(dim, F.col(code) == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_name", F.lit(K.NOT_LISTED)))
        .drop("_key", "_name")
    )


def label_to_id(df: DataFrame, label: str, reference: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Code of a free-text label by folded, space-free equality; the last entry wins on duplicates."""
    dim = reference.groupBy(T.match_key(F.col(name)).alias("_match")).agg(F.max(key).alias(out))
    return df.join(dim, T.match_key(F.col(label)) == F.col("_match"), "left").drop("_match")


def synonym(df: DataFrame, label: str, synonyms: DataFrame, out: str) -> DataFrame:
    """Canonical label of ``label``: itself when canonical, else the one that lists it, else null.
    ``synonyms`` has ``(canonical, alias)`` rows."""
    pairs = synonyms.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_to"), F.lit(1).alias("_own"))
    own = synonyms.select(F.col("canonical").alias("_alias"), F.col("canonical").alias("_to"), F.lit(0).alias("_own"))
    dim = pairs.unionByName(own).groupBy("_alias").agg(
        F.min_by("_to", F.struct("_own", "_to")).alias(out)
    )
    return df.join(dim, F.col(label) == F.col("_alias"), "left").drop("_alias")


def allowed_labels(pairs: DataFrame, family: str, label: str) -> DataFrame:
    """Distinct (family, label) pairs: the reference list of every family."""
    return pairs.select(family, label).distinct()


def inside_allowed(predictions: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows whose (family, label) is in the reference list."""
    marked = predictions.join(allowed.select(*keys, F.lit(1).alias("_in")), keys, "left")
    return marked.agg(
        F.count("*").alias("n"), F.count("_in").alias("n_in"), (F.count("_in") / F.count("*")).alias("share")
    )


def closest_manufacturer(names: DataFrame, name: str, known: DataFrame, known_name: str, block: int = 20_000) -> DataFrame:
    """For every distinct name: the known manufacturer itself when listed, else the most similar of all
    known ones by Levenshtein similarity, 1 - distance / longer length (ties by name)."""
    cleaned = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    reference = stage(known.select(F.col(known_name).alias("known")).where(F.col("known").isNotNull()).distinct())
    exact = stage(cleaned.join(reference, F.col("name") == F.col("known"), "left"))
    direct = exact.where(F.col("known").isNotNull()).select("name", "known", F.lit(1.0).alias("ratio"))
    return direct.unionByName(closest(exact.where(F.col("known").isNull()).select("name"), reference, block))


def keep_known_terms(term_rows: DataFrame, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """New documents only keep the words of the old vocabulary."""
    return term_rows.join(vocabulary.select(term), term, "left_semi")
