"""Categorical codes, indicator columns and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.runtime import draw, stage, with_global_rank


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 0: ``(value, code)``."""
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_global_rank(values, [F.col("value")], "code", start=0)


def extend_codes(old: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Old codes stay; values seen for the first time follow in sorted order."""
    fresh = new_values(old, df, column)
    numbered = with_global_rank(fresh, [F.col("value")], "_r", start=0)
    first_free = old.select(F.max("code")).scalar()
    added = numbered.select("value", (F.coalesce(first_free, F.lit(-1)) + 1 + F.col("_r")).alias("code"))
    return old.select("value", "code").unionByName(added)


def new_values(old: DataFrame, df: DataFrame, column: str) -> DataFrame:
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return values.join(old.select("value"), "value", "left_anti")


def encode(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """Code of every row, -1 for unknown values."""
    dim = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return (
        df.join(dim, F.col(column) == F.col("_value"), "left")
        .withColumn(out, F.coalesce("_code", F.lit(-1)).cast("long"))
        .drop("_value", "_code")
    )


def one_hot_rows(df: DataFrame, row: str, columns: list[str], codes: dict[str, DataFrame], factor: float) -> DataFrame:
    """Long one-hot form ``(row, column, code, v)``: unknown values yield no entry."""
    out = None
    for c in columns:
        part = encode(df.select(row, c), c, codes[c], "code").where(F.col("code") >= 0).select(
            row, F.lit(c).alias("column"), "code", F.lit(float(factor)).alias("v")
        )
        out = part if out is None else out.unionByName(part)
    return out


def indicator_rows(df: DataFrame, row: str, labels: str, codes: DataFrame) -> DataFrame:
    """Coordinate form of the multi-label indicator matrix: ``(row, code)`` for every label set."""
    exploded = df.select(row, F.explode(F.array_distinct(labels)).alias("_label"))
    return encode(exploded, "_label", codes, "code").where(F.col("code") >= 0).select(row, "code")


def hash_bucket(columns: list[str], buckets: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets))


def split_by_text(df: DataFrame, text: str, test_percent: int = 20, seed: int = 1029) -> DataFrame:
    """Adds ``is_test``: all copies of a text fall on the same side, without any shuffle."""
    return df.withColumn("is_test", hash_bucket([text], 100, seed) < test_percent)


def stratified_split(df: DataFrame, stratum: list[str], row: str, test_share: float = 0.2, seed: int = 1029) -> DataFrame:
    """Adds ``is_test`` with the share held in every stratum: rows are counted per stratum and
    hash bucket, and a row is a test row when its bucket lies in the first ``test_share`` of the stratum.

    Only buckets are ranked (at most 10 000 per stratum), so a hot stratum stays spread;
    the single bucket that straddles the border is ordered row by row.
    """
    return _bucket_rank(df, stratum, row, seed).withColumn(
        "is_test", F.col("_position") <= F.floor(F.col("_size") * test_share)
    ).drop("_position", "_size")


def stratified_folds(df: DataFrame, stratum: list[str], row: str, k: int, seed: int = 1029) -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced inside every stratum."""
    return _bucket_rank(df, stratum, row, seed).withColumn(
        "fold", F.pmod(F.col("_position") - 1, F.lit(k)).cast("int")
    ).drop("_position", "_size")


def _bucket_rank(df: DataFrame, stratum: list[str], row: str, seed: int) -> DataFrame:
    """Position of every row in the hash order of its stratum, and the stratum's size."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(row)))
    bucketed = hashed.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 16), F.lit(10_000)))
    sizes = bucketed.groupBy(*stratum, "_b").agg(F.count("*").alias("_c"))
    running = Window.partitionBy(*stratum).orderBy("_b")
    offsets = sizes.select(
        *stratum, "_b", (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*stratum)).alias("_size"),
    )
    inside = F.row_number().over(Window.partitionBy(*stratum, "_b").orderBy("_h", row))
    return (
        bucketed.join(offsets, [*stratum, "_b"])
        .withColumn("_position", inside + F.col("_before"))
        .drop("_h", "_b", "_before")
    )


def balanced_sample(df: DataFrame, label: str, row: str, seed: int = 1029) -> DataFrame:
    """Sampling with replacement with weight 1/class size: every row is repeated
    floor(mean) times or once more, so that all classes come out equally large on average. The draw
    hangs on the row key alone, so a recomputed partition draws the same rows."""
    counted = stage(df.groupBy(label).agg(F.count("*").alias("_n")))
    mean = counted.select(F.sum("_n") / F.count("*")).scalar()
    uniform = (F.conv(F.substring(draw(seed, row), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    whole = F.floor(mean / F.col("_n"))
    extra = F.when(uniform < mean / F.col("_n") - whole, 1).otherwise(0)
    drawn = df.join(counted, label).withColumn("_k", (whole + extra).cast("int"))
    return drawn.where(F.col("_k") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_k")))
    ).drop("_n", "_k")
