"""Language identification with error-correcting output codes.

Every language has a codeword of -1 and +1. One linear classifier per bit tells the languages
with +1 from those with -1 by hashed character trigrams: its weights are log-ratios of the two
sides' mean trigram distributions, counted over all learning documents. A text gets one margin per
bit (mean weight over its trigrams); the language whose codeword has the least weighted logistic
loss on the margins wins, each bit weighing as much as its two sides differ. A text whose two best
codewords are hardly apart is ambiguous.

The counts are combined per task into at most languages x buckets rows; the model that reaches the
tasks has bits x buckets numbers. Long texts are read in blocks of bounded size.

Null texts and texts without a letter are ``und`` with score 0; without learning documents all
are ``und``. Case and everything but letters are ignored. Up to six languages have the exhaustive code, more of them a fixed
pseudo-random one. Of tied codewords the first language in order wins, and the text is ambiguous; repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.llm.common import mix

BUCKETS = 1 << 14
BLOCK = 1 << 20  # characters looked at together
SHARPNESS = 8.0  # scale of the margins in the loss
HELD_LANGUAGES = 64  # count vectors a task holds before it hands them on
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
    found = _LETTER[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        found[i] = chr(codes[i]).isalpha()
    return found


def trigram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hash buckets of the trigrams of letters and word edges, block by block; nothing without a letter."""
    for start in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[max(0, start - 2) : start + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(codes)
        if not letter.any():
            continue
        keep = letter | np.concatenate(([False], letter[:-1]))
        codes = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint64)
        grams = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
        yield (mix(grams) & np.uint64(buckets - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or +1
    weights: np.ndarray  # buckets x bits
    bit_weight: np.ndarray  # bits, sum 1

    def decide(self, text: str | None, ambiguous_below: float) -> tuple[str, float, bool]:
        total, n = np.zeros(self.code.shape[1]), 0
        for found in trigram_buckets(text or "", len(self.weights)):
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if not n or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -SHARPNESS * self.code * (total / n)) @ self.bit_weight
        best, second = np.argsort(loss, kind="stable")[:2]
        score = float(loss[second] / (loss[best] + loss[second]))
        return self.languages[best], score, score < ambiguous_below


def codewords(languages: int) -> np.ndarray:
    """The exhaustive code up to six languages (every way to split them once), else a fixed
    pseudo-random code with a length that grows with the logarithm of their number."""
    if languages < 2:
        return np.zeros((languages, 0), np.int64)
    if languages <= 6:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(languages)], dtype=np.int64)
    bits = 32 + 8 * languages.bit_length()
    for seed in range(1, 1000):
        draw = mix(np.arange(languages * bits, dtype=np.uint64) + np.uint64(seed << 40)).reshape(languages, bits)
        code = np.where(draw >> np.uint64(63), 1, -1)
        if len(np.unique(code, axis=0)) == languages and (abs(code.sum(axis=0)) < languages).all():
            return code
    raise ValueError("no code found")


def _count(batches):
    held: dict[str, np.ndarray] = {}

    def rows():
        for lang, seen in held.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())})
        held.clear()

    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
            for found in trigram_buckets(text.as_py() or ""):
                if lang not in held:
                    if len(held) >= HELD_LANGUAGES:
                        yield from rows()
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(found, minlength=BUCKETS)
    yield from rows()


def fit(learning: DataFrame, smoothing: float = 0.5) -> Model:
    """Learn from all rows of ``learning`` (text, lang) whose text and lang are not null."""
    counts = learning.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(_count, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    # a row per language: the label set, not the corpus
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        counts.unpersist()
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    spark = learning.sparkSession
    book = spark.createDataFrame(
        [(lang, 1.0 / (totals[lang] + smoothing * BUCKETS), [int(c) for c in code[i]]) for i, lang in enumerate(languages)],
        "lang string, share double, code array<int>",
    )
    sides = (
        counts.join(F.broadcast(book), "lang")
        .select("bucket", (F.col("n") * F.col("share")).alias("p"), F.posexplode("code").alias("bit", "side"))
        .groupBy("bit", "bucket", "side").agg(F.sum("p").alias("p"))
        .toArrow()
    )
    counts.unpersist()
    mass = np.zeros((2, BUCKETS, bits))
    for side in (0, 1):
        x = {c: sides.column(c).to_numpy()[sides.column("side").to_numpy() == 2 * side - 1] for c in ("bucket", "bit", "p")}
        mass[side, x["bucket"], x["bit"]] = x["p"]
        members = code == 2 * side - 1
        floor = np.array([smoothing / (totals[lang] + smoothing * BUCKETS) for lang in languages])
        mass[side] = (mass[side] + floor @ members) / members.sum(axis=0)
    differ = 1 - np.sqrt(mass[0] * mass[1]).sum(axis=0)
    return Model(languages, code, np.round(np.log(mass[1] / mass[0]), 5).astype(np.float32), differ / differ.sum())


def predict(documents: DataFrame, model: Model, ambiguous_below: float = 0.55) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row of ``documents`` (id, text)."""
    ids = documents.select("id").schema["id"].dataType.simpleString()

    def decide(batches):
        for b in batches:
            found = [model.decide(t.as_py(), ambiguous_below) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                names=["id", "lang_pred", "score", "ambiguous"],
            )

    return documents.select("id", "text").mapInArrow(decide, f"id {ids}, lang_pred string, score double, ambiguous boolean")


def held_out(documents: DataFrame):
    """Documents kept apart for scoring: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(documents: DataFrame) -> Model:
    return fit(documents.where(~held_out(documents) & F.col("doc_id").isNotNull()).select("text", "lang"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(documents.select(F.col("doc_id").alias("id"), "text"), fit_documents(documents)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(spark, documents: DataFrame, sf_dir: str, ambiguous_below: float = 0.55) -> DataFrame:
    """The pipeline's stage: documents with a language that is known and not ambiguous."""
    model = fit_documents(documents)

    def keep(batches):
        for b in batches:
            found = [model.decide(t.as_py(), ambiguous_below) for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array([lang != UNKNOWN and not unsure for lang, _, unsure in found], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
