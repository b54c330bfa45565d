"""Key/value forms: cleaning, last answer per question, mapping to declaration fields, XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.operators.projections import declarant_from_questions, vigilance_from_file_name


def last_answers(rows: DataFrame) -> DataFrame:
    """(file, key, value): line ends become spaces, 'None' and missing answers leave, the last answer
    to a repeated question stays. The maximum combines map-side, so a question asked a million
    times in one file costs one row per task."""
    value = F.translate("value", "\n", " ")
    kept = rows.select("file", "seq", F.translate("key", "\n", " ").alias("key"), value.alias("value")).where(
        F.col("key").isNotNull() & F.col("value").isNotNull() & (F.col("value") != "None") & (F.col("key") != "None")
    )
    return kept.groupBy("file", "key").agg(F.max_by("value", "seq").alias("value"))


def to_wide(answers: DataFrame, questions: list[str]) -> DataFrame:
    """One row per file with a column for every known question."""
    return answers.groupBy("file").pivot("key", questions).agg(F.first("value"))


def map_fields(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, target, value): for every target field the non-empty answers to its questions, in
    mapping order, separated by a space; nothing left gives null.

    ``mapping`` is ``(target, ord, source)``; a file contributes at most one answer per entry.
    """
    joined = answers.join(mapping, answers["key"] == mapping["source"])
    parts = F.array_sort(F.collect_list(F.struct("ord", F.trim("value").alias("v"))))
    text = F.array_join(F.transform(parts, lambda p: p["v"]), " ")
    out = joined.groupBy("file", "target").agg(text.alias("value"))
    return out.withColumn("value", F.nullif(F.trim("value"), F.lit("")))


def declaration_rows(answers: DataFrame, mapping: DataFrame, targets: list[str]) -> DataFrame:
    """One declaration row per file; a missing vigilance type is read off the file name."""
    wide = map_fields(answers, mapping).groupBy("file").pivot("target", targets).agg(F.first("value"))
    if "TYPE_VIGILANCE" in targets:
        wide = wide.withColumn("TYPE_VIGILANCE", F.coalesce("TYPE_VIGILANCE", vigilance_from_file_name(F.col("file"))))
    return wide


def declarant(answers: DataFrame) -> DataFrame:
    """(file, declarant) told by which questions a form holds. Only the two telling questions are kept."""
    telling = F.collect_set(F.when(F.col("key").isin("Profession", "Nom"), F.col("key")))
    return answers.groupBy("file").agg(declarant_from_questions(telling).alias("declarant"))


# The part of a clinical document that holds the answers: rows of cells, key and value in turn.
CDA = (
    "id struct<_extension: string>, title string, component struct<structuredBody: struct<component: "
    "array<struct<section: struct<text: struct<table: struct<tbody: struct<tr: array<struct<td: array<string>>>>>>>>>>>"
)


def parse_cda(documents: DataFrame, file: str, xml: Column) -> DataFrame:
    """One struct per clinical document: id, title and the list of cell rows."""
    parsed = documents.select(F.col(file).alias("file"), F.from_xml(xml, CDA, {"rowTag": "ClinicalDocument"}).alias("d"))
    sections = F.transform("d.component.structuredBody.component", lambda c: c["section"]["text"]["table"]["tbody"]["tr"])
    return parsed.select(
        "file", F.lower("d.id._extension").alias("declaration"), F.col("d.title").alias("title"),
        F.flatten(F.filter(sections, lambda s: s.isNotNull())).alias("tr"),
    )


def cda_rows(parsed: DataFrame) -> DataFrame:
    """(file, seq, key, value) of parsed documents; a last cell without partner is dropped."""
    rows = parsed.select("file", F.posexplode("tr").alias("row", "cells"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("cells.td") - 1),
        lambda i: F.struct(i.alias("i"), F.get("cells.td", i).alias("key"), F.get("cells.td", i + 1).alias("value")),
    )
    flat = rows.where(F.size("cells.td") > 1).select("file", "row", F.inline(pairs))
    return flat.where((F.col("i") % 2 == 0) & F.col("key").isNotNull() & F.col("value").isNotNull()).select(
        "file", (F.col("row") * F.lit(1_000_000).cast("long") + F.col("i")).alias("seq"), "key", "value"
    )


def unwrap_soap(documents: DataFrame, file: str, xml: Column) -> DataFrame:
    """(file, xml, vigilance, declaration): plain clinical documents pass through; a SOAP envelope
    gives the base64 document it holds and the type and reference it states."""
    def named(tag):
        return F.xpath_string(xml, F.lit(f"//*[name()='{tag}']"))

    wrapped = xml.contains("soap:Envelope")
    inner = F.unbase64(F.translate(named("ns8:cda"), "\n\r ", "")).cast("string")
    return documents.select(
        F.col(file).alias("file"), F.when(wrapped, inner).otherwise(xml).alias("xml"),
        F.when(wrapped, F.lower(named("ns8:typeSignalement"))).alias("vigilance"),
        F.when(wrapped, F.lower(named("ns14:referenceDeclaration"))).alias("declaration"),
    )
