"""Registered queries and, where SQL can express them on whole tables, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from declara.runtime import spread

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of one scale folder, read lazily: ``t.documents``."""

    NAMES = (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Tables.NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    @property
    def texts(self) -> DataFrame:
        """``documents`` for work that is heavy per text, dealt out to all cores."""
        return spread(self.documents, "doc_id")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` is the same question on the same tables in DuckDB's dialect."""

    def add(plan: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add
