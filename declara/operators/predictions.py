"""The long prediction table ``(file, model, rank, class, class_name, proba)`` and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara import constants as K
from declara.functions.text import match_key, mentions_death
from declara.operators.aggregations import top_k
from declara.operators.joins import label_to_id


def rank_predictions(
    predictions: DataFrame, keys: list[str], names: DataFrame | None = None, encoder: DataFrame | None = None, k: int | None = None
) -> DataFrame:
    """Classes of every (file, model) by decreasing probability, ties by class.

    ``encoder`` ``(model, code, class)`` turns codes into classes and ``names``
    ``(model, class, class_name)`` adds labels; both are dimension tables.
    """
    out = predictions
    if encoder is not None:
        out = out.join(encoder, ["model", "code"])
    if names is not None:
        out = out.join(names, ["model", "class"], "left")
    return top_k(out, keys, [F.col("proba").desc(), F.col("class")], k)


def as_percentages(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("percent", F.round(100 * F.col("proba"), 2))


def skip_default(ranked: DataFrame, keys: list[str], default: str, may_skip: Column | None = None) -> DataFrame:
    """First class per key, or the second when the first is the default class and the rule allows it."""
    best = ranked.where(F.col("rank") <= 2).groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("class", "proba"))).alias("a"),
        F.max(F.when(F.col("rank") == 2, F.struct("class", "proba"))).alias("b"),
        F.bool_and(F.lit(True) if may_skip is None else may_skip).alias("skip"),
    )
    second = (F.col("a")["class"] == default) & F.col("skip") & F.col("b").isNotNull()
    chosen = F.when(second, F.col("b")).otherwise(F.col("a"))
    return best.select(*keys, chosen["class"].alias("class"), chosen["proba"].alias("proba"))


def result_text(name: Column, proba: Column) -> Column:
    """'label  (p)' with the probability rounded to 3 decimals and two spaces before the bracket."""
    return F.concat(name, F.lit("  ("), F.round(proba, 3).cast("string"), F.lit(")"))


# Result columns and the rules that may skip a default class: model, default class and the
# vigilance types (null: all) for which the second class is taken.
REACTO = ["réactovigilance", "reactovigilance"]
RESULT_MODELS = {
    "DCO": (None, None),
    "dysfonctionnement": (K.DEFAULT_DYSFUNCTION, None),
    "consequence": (K.DEFAULT_CONSEQUENCE, REACTO),
    "effet": (K.DEFAULT_EFFECT, REACTO),
    "gravité_ordinale": (None, None),
    "gravité_binaire": (None, None),
    "topics": (None, None),
    "cluster": (None, None),
}


def result_rows(ranked: DataFrame, files: DataFrame, models: dict[str, tuple] = RESULT_MODELS) -> DataFrame:
    """One row per file with the class and the text of every model.

    One grouped pass picks ranks 1 and 2 of all models; ``files`` ``(file, vigilance, …)`` adds the ids.
    """
    item = F.struct("class", "class_name", "proba")
    best = ranked.where((F.col("rank") <= 2) & F.col("model").isin(list(models))).groupBy("file").agg(*[
        F.max(F.when((F.col("model") == m) & (F.col("rank") == r), item)).alias(f"{m}_{r}")
        for m in models for r in (1, 2)
    ])
    joined = files.join(best, "file")
    out = [F.col(c) for c in files.columns]
    for model, (default, vigilances) in models.items():
        first, second = F.col(f"{model}_1"), F.col(f"{model}_2")
        chosen = first
        if default is not None:
            skip = (first["class"] == default) & second.isNotNull()
            if vigilances is not None:
                skip = skip & F.lower(F.col("vigilance")).isin(vigilances)
            chosen = F.when(skip, second).otherwise(first)
        out.append(chosen["class"].alias(f"{model}_class"))
        out.append(result_text(chosen["class_name"], chosen["proba"]).alias(model))
    return joined.select(*out)


def family_override(
    forms: DataFrame, file: str, declarant: str, label: str, device: str, reference: DataFrame, key: str, name: str
) -> DataFrame:
    """Files whose professional declarant names a listed device family, with that family:
    the commercial label decides, else the device. Probability 1."""
    first = label_to_id(forms, label, reference, key, name, "_by_label")
    both = label_to_id(first, device, reference, key, name, "_by_device")
    matched = both.where(F.lower(F.col(declarant)).contains("professionnel")).select(
        F.col(file).alias("file"), F.coalesce("_by_label", "_by_device").alias("class")
    )
    return matched.where(F.col("class").isNotNull()).withColumn("proba", F.lit(1.0))


def apply_override(ranked: DataFrame, model: list[str], decided: DataFrame) -> DataFrame:
    """Replace all predictions of the given models by the decided class of a file.
    ``decided`` is ``(file, class, class_name, proba)``. The predictions are read once and stay where they are."""
    columns = ["file", "model", "rank", "class", "class_name", "proba"]
    mark = decided.select("file", F.lit(True).alias("_decided")).where("file IS NOT NULL").distinct()
    kept = ranked.join(mark, "file", "left").where(~F.col("model").isin(model) | (F.col("model").isin(model) & F.col("_decided").isNull()))
    fixed = decided.repartition("file").select(  # placed like predictions that lie by file, so that their union does too
        "file", F.explode(F.array(*[F.lit(m) for m in model])).alias("model"), F.lit(1).cast("long").alias("rank"),
        "class", "class_name", "proba",
    )
    return kept.select(*columns).unionByName(fixed)


SEVERITY_MODELS = ["gravité_ordinale", "gravité_binaire"]


def critical(files: DataFrame) -> DataFrame:
    return files.select("file", F.lit("CRITI").alias("class"), F.lit("CRITI").alias("class_name"), F.lit(1.0).alias("proba"))


def death_override(ranked: DataFrame, forms: DataFrame, file: str, text: Column) -> DataFrame:
    """Declarations that speak of a death are critical in both severity models."""
    deaths = forms.where(mentions_death(text) == 1).select(F.col(file).alias("file"))
    return apply_override(ranked, SEVERITY_MODELS, critical(deaths))


def virology_files(ranked: DataFrame) -> DataFrame:
    """Files whose best family starts with 'virologie' and whose best consequence is 'faux negatif'."""
    first = ranked.where(F.col("rank") == 1).groupBy("file").agg(
        F.max(F.when(F.col("model") == "DCO", F.lower("class_name"))).alias("d"),
        F.max(F.when(F.col("model") == "consequence", F.lower("class_name"))).alias("c"),
    )
    return first.where(F.col("d").startswith("virologie") & (F.col("c") == "faux negatif")).select("file")


def virology_override(ranked: DataFrame) -> DataFrame:
    """Files that ``virology_files`` would list are critical in both severity models. A file is judged beside its rows and its
    first row brings the critical ones, so the predictions are read once."""
    columns = {"file": None, "model": "string", "rank": "long", "class": "string", "class_name": "string", "proba": "double"}
    ranked = ranked.select(*[F.col(c).cast(kind) if kind else F.col(c) for c, kind in columns.items()])
    order = Window.partitionBy("file").orderBy("rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    family, consequence = [F.max(F.when((F.col("rank") == 1) & (F.col("model") == m), F.lower("class_name"))).over(whole) for m in ("DCO", "consequence")]
    found = F.coalesce(family.startswith("virologie") & (consequence == "faux negatif"), F.lit(False))
    judged = ranked.withColumns({"_virology": found, "_row": F.row_number().over(order)})
    severe = F.col("model").isin(SEVERITY_MODELS)
    kept = F.when(~severe | (severe & (~F.col("_virology") | F.col("file").isNull())), F.array(F.struct(*columns)))
    fixed = F.array(*[
        F.struct("file", F.lit(m).alias("model"), F.lit(1).cast("long").alias("rank"), F.lit("CRITI").alias("class"), F.lit("CRITI").alias("class_name"),
                 F.lit(1.0).alias("proba")) for m in SEVERITY_MODELS])
    first = F.when(F.col("_virology") & (F.col("_row") == 1), fixed)
    return judged.select(F.inline(F.when(first.isNull(), kept).when(kept.isNull(), first).otherwise(F.concat(kept, first))))


def allowed_rerank(
    ranked: DataFrame, file: str, family: str, allowed: DataFrame, label: str, applies: Column, excluded: list = K.EXCLUDED_DYSFUNCTIONS
) -> DataFrame:
    """First class inside the family's reference list where the rule applies, else rank 1."""
    marked = ranked.join(
        allowed.select(F.col(family).alias("_f"), F.col(label).alias("_l"), F.lit(True).alias("_in")),
        (F.col(family) == F.col("_f")) & (F.col("class") == F.col("_l")), "left",
    )
    usable = F.col("_in").isNotNull() & applies & ~F.col("class").isin(excluded)
    item = F.struct("rank", "class", "proba")
    best = marked.groupBy(file).agg(
        F.min(F.when(usable, item)).alias("_inside"), F.min(item).alias("_first")
    )
    chosen = F.coalesce("_inside", "_first")
    return best.select(
        file, chosen["class"].alias("class"), chosen["proba"].alias("proba"), F.col("_inside").isNotNull().alias("reranked")
    )


def constrained_argmax(ranked: DataFrame, file: str, family: str, allowed: DataFrame, label: str) -> DataFrame:
    """Best class inside the allowed set; files without any allowed class give no row."""
    pairs = allowed.select(F.col(family).alias(family), F.col(label).alias("class"))
    inside = ranked.join(pairs, [family, "class"], "left_semi")
    best = inside.groupBy(file).agg(F.min(F.struct((-F.col("proba")).alias("m"), F.col("class"))).alias("b"))
    return best.select(file, F.col("b.class").alias("class"), (-F.col("b.m")).alias("proba"))


# -- ensembles over several prediction tables --------------------------------------


def average(tables: list[DataFrame], row: str, label: str, score: str) -> DataFrame:
    """Mean of the scores of several tables; a label missing from a table counts 0 there."""
    return _stack(tables).groupBy(row, label).agg((F.sum(score) / len(tables)).alias(score))


def rank_average(tables: list[DataFrame], row: str, label: str, score: str) -> DataFrame:
    """Mean rank relevance: the longest list of any table gives its first label the largest value."""
    stacked = relevance(_stack(tables), ["_t", row], label, score)
    return stacked.groupBy(row, label).agg((F.sum("relevance") / len(tables)).alias(score))


def round_robin(tables: list[DataFrame], row: str, label: str, score: str) -> DataFrame:
    """Largest relevance over the tables, earlier tables winning ties through an offset."""
    n = len(tables)
    stacked = relevance(_stack(tables), ["_t", row], label, score)
    shifted = F.col("relevance") + (n - F.col("_t")) / F.lit(n + 1.0)
    return stacked.groupBy(row, label).agg((F.max(shifted) / n).alias(score))


def relevance(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Rank -> relevance: longest list length minus zero-based rank."""
    ranked = top_k(df, keys, [F.col(score).desc(), F.col(label)], None, "_r")
    longest = df.groupBy(*keys).agg(F.count("*").alias("c")).select(F.max("c")).scalar()
    return ranked.withColumn("relevance", (longest - (F.col("_r") - 1)).cast("double")).drop("_r")


def _stack(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_t", F.lit(i)))
    return out


def fold_predictions(fold_tables: list[DataFrame]) -> DataFrame:
    """Predictions of all folds for one test set, side by side in long form."""
    return _stack(fold_tables).withColumnRenamed("_t", "fold")
