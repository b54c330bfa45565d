"""Sinks. Every writer takes a new path and never overwrites its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", sep).option("quote", '"').option(
        "escape", '"').option("emptyValue", '""').csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def train_test(df: DataFrame, is_test: str, path: str) -> None:
    """Train and test rows as two '|' CSV folders, from one pass each over a deterministic split."""
    csv(df.where(~F.col(is_test)).drop(is_test), f"{path}/train", "|")
    csv(df.where(F.col(is_test)).drop(is_test), f"{path}/test", "|")


def versioned_union(old: DataFrame, new: DataFrame, path: str) -> None:
    """Old and new corpus under a new version; columns missing on one side become null."""
    parquet(old.unionByName(new, allowMissingColumns=True), path)


def metrics(scores: DataFrame, path: str) -> None:
    """One-row score tables as JSON."""
    json(scores.coalesce(1), path)


def topic_documents(df: DataFrame, path: str) -> None:
    """Topic -> documents cache, one folder per topic; a hot topic may fill several files."""
    parquet(df, path, ["topic"])
