"""Row-wise preparation of declarations (no shuffle in this module unless named)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import text as T


def fill_null(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Missing text becomes '', 'NON RENSEIGNE' or ' ', as each model expects."""
    return df.fillna({c: value for c in columns})


def label_defaults(df: DataFrame, effect: str, dysfunction: str, consequence: str) -> DataFrame:
    return df.fillna(
        {effect: K.DEFAULT_EFFECT, dysfunction: K.DEFAULT_DYSFUNCTION, consequence: K.DEFAULT_CONSEQUENCE}
    )


def blank_to_default(df: DataFrame, value: str = K.NOT_FILLED) -> DataFrame:
    """Empty strings of every string column become ``value``."""
    text_columns = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[
        F.when(F.col(c) == "", F.lit(value)).otherwise(F.col(c)).alias(c) if c in text_columns else F.col(c)
        for c in df.columns
    ])


def text_concat(description: Column, state: Column) -> Column:
    """'description. state', trimmed; null when either is null."""
    return F.regexp_replace(F.concat(description, F.lit(". "), state), r"^\s+|\s+$", "")


def compound_text(*parts: Column) -> Column:
    """Several fields in one text, separated by a space; null when any is null."""
    spaced = [p for part in parts for p in (F.lit(" "), part)][1:]
    return F.concat(*spaced)


def family_id(raw: Column) -> Column:
    """'12.0' -> 12; missing or unreadable -> -1."""
    digits = F.regexp_replace(raw, r"\.0$", "")
    return F.coalesce(digits.try_cast("int"), F.lit(-1))


def document_name(declaration: Column, family: Column) -> Column:
    return F.concat(declaration, F.lit(" - "), F.replace(family, F.lit("/"), F.lit("-")))


def declaration_of_name(name: Column) -> Column:
    return F.trim(F.split(name, "-")[0])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def number_from_file_name(path: Column) -> Column:
    """The last digit group of the file name, else 'INCONNU'."""
    groups = F.regexp_extract_all(file_name(path), F.lit("([0-9]+)"), F.lit(1))
    return F.when(F.size(groups) > 0, F.element_at(groups, -1)).otherwise(F.lit("INCONNU"))


def vigilance_from_file_name(path: Column) -> Column:
    name = T.fold(file_name(path))
    return (
        F.when(name.contains("materio"), "matériovigilance")
        .when(name.contains("reacto") | name.contains("bacterio"), "réactovigilance")
        .otherwise("")
    )


def vigilance_from_title(title: Column, path: Column) -> Column:
    """The vigilance named in the form title, else the one the file name tells."""
    folded = T.fold(title)
    return F.coalesce(
        F.when(folded.contains("reactovigilance"), "réactovigilance")
        .when(folded.contains("materiovigilance"), "matériovigilance"),
        vigilance_from_file_name(path),
    )


def or_default(value: Column, default: Column) -> Column:
    """``value`` unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def declarant_from_title(title: Column) -> Column:
    return (
        F.when(title.isNull(), "")
        .when(F.lower(title).contains("(ps)"), K.PROFESSIONAL)
        .otherwise(K.CITIZEN)
    )


def declarant_from_questions(questions: Column) -> Column:
    """A form that asks for a profession comes from a professional, one that asks for a name from a citizen."""
    return F.when(F.array_contains(questions, "Profession"), K.PROFESSIONAL).when(
        F.array_contains(questions, "Nom"), K.CITIZEN
    )


def severity_code(severity: Column, binary: bool = False) -> Column:
    codes = K.SEVERITY_BINARY_CODES if binary else K.SEVERITY_CODES
    return F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), severity)


def severity_name(code: Column, binary: bool = False) -> Column:
    names = K.SEVERITY_BINARY_NAMES if binary else {v: k for k, v in K.SEVERITY_CODES.items()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)


def one_hot_array(code: Column, classes: int) -> Column:
    """0/1 array of length ``classes`` with a single 1 at position ``code``."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == code, 1).otherwise(0))


def presence_flags(df: DataFrame, flags: dict[str, tuple[str, str | None]]) -> DataFrame:
    """0/1 columns telling whether a label is filled and differs from its default code."""
    out = df
    for name, (column, default) in flags.items():
        there = F.col(column).isNotNull()
        if default is not None:
            there = there & (F.col(column) != default)
        out = out.withColumn(name, F.when(there, 1).otherwise(0))
    return out


# -- predicates ---------------------------------------------------------------


def drop_labels(df: DataFrame, column: str, labels: list = K.UNINFORMATIVE_FAMILIES) -> DataFrame:
    """Rows whose label is not in the list; rows without label stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(labels))


def document_by_id_or_name(df: DataFrame, wanted: str, id_column: str, name_column: str) -> DataFrame:
    return df.where((F.col(id_column) == wanted) | (F.col(name_column) == wanted))


def by_declarant(df: DataFrame, column: str, declarant: str) -> DataFrame:
    return df.where(F.col(column) == declarant)


def anonymise(form: DataFrame, question: str, personal: list[str] = K.PERSONAL_QUESTIONS) -> DataFrame:
    """Drop the answers to personal questions, compared in lower case after line ends became spaces."""
    denied = [p.lower() for p in personal]
    cleaned = form.withColumn(question, F.translate(F.col(question), "\t\n\r", "   "))
    return cleaned.where(~F.lower(F.col(question)).isin(denied))
