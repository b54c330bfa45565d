"""Readers with declared schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECLARATION_COLUMNS = [
    "NUMERO_DECLARATION", "TYPE_DECLARANT", "TYPE_VIGILANCE", "CLASSIFICATION", "DESCRIPTION_INCIDENT",
    "ETAT_PATIENT", "ACTION_PATIENT", "FABRICANT", "LIBELLE_COMMERCIAL", "REFERENCE_COMMERCIALE",
    "DM", "DCO", "DCO_ID", "TEF_ID", "TDY_ID", "CDY_ID", "GRAVITE",
]
DECLARATIONS = ", ".join(f"{c} string" for c in DECLARATION_COLUMNS)
DEVICES = "DCO_ID int, LIBELLE string"
EFFECTS = "TEF_ID int, TYPE_EFFET string, DCO_ID int"
DYSFUNCTIONS = "TDY_ID int, LIBELLE_DYSFONCTIONNEMENT string, DCO_ID int, SI_ACTIF boolean"
CONSEQUENCES = "CDY_ID string, CONSEQUENCE_DYSFONCTIONNEMENT string"
FORM_ROWS = "Column0 string, Column1 string"


def declarations_csv(spark: SparkSession, path: str, schema: str = DECLARATIONS) -> DataFrame:
    """Comma CSV with header and quoted fields. Records may hold line breaks, which rules out
    splitting a file, so large corpora should arrive as many files or be converted once."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option(
        "quote", '"').option("escape", '"').csv(path)


def reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reference tables: ';' separated, ISO-8859-1."""
    return spark.read.schema(schema).option("header", True).option("sep", ";").option(
        "encoding", "ISO-8859-1").csv(path)


def consequences_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONSEQUENCES).option("header", True).csv(path)


def pipe_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """'|' separated with a leading index column, which is dropped."""
    return spark.read.schema(f"_index int, {schema}").option("header", True).option("sep", "|").option(
        "multiLine", True).option("quote", '"').option("escape", '"').csv(path).drop("_index")


def form_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Key/value form files as rows ``(file, seq, key, value)``, the order inside a file kept."""
    rows = spark.read.schema(FORM_ROWS).option("header", True).option("sep", sep).option("multiLine", True).option(
        "quote", '"').option("escape", '"').csv(path)
    return rows.select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"),
        F.col("Column0").alias("key"), F.col("Column1").alias("value"),
    )


def column_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Column-oriented JSON ``{column: {row: value}}``, one object per line or file, as rows.
    A one-off conversion: later reads should take the Parquet written from it."""
    text = spark.read.text(path, wholetext=True)
    cells = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("column", "cells"))
    long = cells.select("column", F.explode("cells").alias("row", "value"))
    return long.groupBy("row").pivot("column", columns).agg(F.first("value"))


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths below ``folder`` whose file name matches a case-insensitive glob; contents are not read."""
    regex = "(?i)^" + pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").where(F.element_at(F.split("path", "/"), -1).rlike(regex))


def detect_format(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format): pdf by its magic bytes, else the extension when it is xml, pdf or csv, else null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    magic = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return files.select(
        "path", F.when(magic, "pdf").when(extension.isin("xml", "pdf", "csv"), extension).alias("format")
    )


def stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def skip_processed(listing: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Files whose stem has no output yet."""
    finished = done.select(stem(F.col(path)).alias("_stem")).distinct()
    return listing.withColumn("_stem", stem(F.col(path))).join(finished, "_stem", "left_anti").drop("_stem")


def libsvm(spark: SparkSession, path: str, features: int) -> DataFrame:
    """Sparse rows in libsvm format as ``(label, features)``."""
    return spark.read.format("libsvm").option("numFeatures", features).load(path)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Sparse matrix as a Parquet table ``(i, j, v)``."""
    return spark.read.parquet(path).select("i", "j", "v")
