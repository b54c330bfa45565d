"""The corpus pipeline: quality rules, language ID, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
folder all executors share and rereads it as the next stage's ``docs``. All stages but the last
return the columns of ``documents``. Hashed n-grams, learned models and tokenizers cannot be stated
in SQL, so ``ORACLE_SQL`` is None; tests/llm checks the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from declara.llm import language_id, ngram_join, packing, quality_rules
from declara.runtime import stage

STAGES = [
    ("quality_rules", quality_rules.keep_good),
    ("language_id", language_id.keep_identified),
    ("ngram_jaccard_join", ngram_join.keep_one),
    ("packing", packing.pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir))
    return docs
