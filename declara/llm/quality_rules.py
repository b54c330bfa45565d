"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Every word and every pair of neighbouring words falls into one of ``buckets`` hash
buckets. The documents trusted by the labels give one multinomial over the buckets, all documents
the other; a document scores the mean over its n-grams of log(target / raw), so its length does
not matter, and is kept at ``threshold`` or above. Base rules on length and repetition come first.

Column expressions only. Two scans of the texts and no shuffle of texts: the counts are partial
sums of at most ``buckets`` rows per task, and the weights reach the tasks as one row of
``buckets`` numbers.

Nulls and empty texts have no words and fail the base rules; without trusted rows, or without
any n-gram, the ratio says nothing and the base rules alone decide. Windows are told apart by a
64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.llm.common import OWN, broadcast_if_small

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# In a packed window the low bits hold its place, the others its hash.
PLACE_BITS = 24


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def covered(places: Column) -> Column:
    """Words under windows that begin at the (ascending) places: each adds up to three words,
    less where the next one starts sooner."""
    reach = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)


def repeated_words(windows: Column, exact: bool = False) -> Column:
    """Words inside a 3-word window that the text holds twice or more, from the windows' hashes.

    Sorted windows have their repeats as neighbours. Hash and place are packed into one number,
    which sorts fast; where the packed hash would merge different windows, or the text has too
    many of them (or ``exact``), hash and place stay apart."""

    def repeats(s: Column, key, place) -> Column:
        marked = F.transform(s, lambda x, k: F.when(
            (key(x) == key(F.get(s, k - 1))) | (key(x) == key(F.get(s, k + 1))), place(x)
        ))
        return F.array_sort(F.array_compact(marked))

    packed = F.sort_array(F.transform(
        windows, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))
    ))
    apart = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    fast = let(packed, lambda s: let(
        repeats(s, lambda x: F.shiftright(x, PLACE_BITS), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))), covered
    ))
    slow = let(apart, lambda s: let(repeats(s, lambda x: x["h"], lambda x: x["i"]), covered))
    if exact:
        return slow
    different = F.size(F.array_distinct(windows))
    short = F.size(F.array_distinct(F.transform(windows, lambda h: F.shiftright(h, PLACE_BITS))))
    return (
        F.when(different == F.size(windows), F.lit(0).cast("long"))
        .when((short == different) & (F.size(windows) < 1 << PLACE_BITS), fast)
        .otherwise(slow)
    )


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def ngram_weights(
    documents: DataFrame, trusted: DataFrame, buckets: int, smoothing: float, id_column: str, text_column: str
) -> list[float] | None:
    """log(target / raw) of every bucket, to four decimals; None without a target.

    ``trusted`` holds the ids of the trusted documents in a column ``id``. What the driver gets is
    at most ``buckets`` rows of counts."""
    ids = trusted.where("id IS NOT NULL").distinct().withColumn("_t", F.lit(1))
    rows = documents.select(F.col(id_column).alias("id"), text_column).join(broadcast_if_small(ids), "id", "left")
    rows = rows.select(F.coalesce("_t", F.lit(0)).alias("t"), word_hashes(words_of(F.col(text_column))).alias("h"))
    grams = F.concat("h", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1))))
    counts = (
        rows.select("t", F.explode(grams).alias("h"))
        .groupBy(_bucket(F.col("h"), buckets).alias("bucket"))
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
        .collect()
    )
    raw, target = [smoothing] * buckets, [smoothing] * buckets
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if sum(target) <= smoothing * buckets:
        return None
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(t) - math.log(r) + shift, 4) for r, t in zip(raw, target)]


def judge(
    documents: DataFrame,
    trusted: DataFrame,
    buckets: int = 1 << 14,
    smoothing: float = 1.0,
    threshold: float = -0.07,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``documents`` and one struct column ``__llm_quality`` of the counts, the score and the verdict."""
    fitted = ngram_weights(documents, trusted, buckets, smoothing, id_column, text_column)
    # one literal, folded to an array when the query is planned
    weights = F.split(F.lit(",".join(map(str, fitted))), ",").cast("array<double>") if fitted else None

    own = {name: f"{OWN}{name}" for name in ("words", "hashes", "windows", "quality")}
    text, hashes, q = F.col(text_column), F.col(own["hashes"]), own["quality"]
    log_ratios = F.transform(hashes, lambda x, i: (
        F.get(weights, _bucket(x, buckets)) + F.get(weights, _bucket(F.xxhash64(x, F.get(hashes, i + 1)), buckets))
    )) if fitted else None
    score = F.aggregate(log_ratios, F.lit(0.0), lambda a, b: a + b) / F.nullif(2 * F.size(hashes), F.lit(0)) if fitted else None
    counted = documents.withColumn(own["words"], words_of(text)).withColumn(own["hashes"], word_hashes(F.col(own["words"])))
    counted = counted.withColumn(own["windows"], F.slice(
        F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))),
        1, F.greatest(F.size(hashes) - 2, F.lit(0)),
    ))
    # a generated row stands between the counts and filters on them: no filter moves below it and
    # repeats the work
    counted = counted.select("*", F.explode(F.array(F.struct(
        F.size(hashes).cast("long").alias("n_words"),
        F.coalesce(F.char_length(text) - F.regexp_count(text, F.lit(f"[{BLANKS}]")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(f"[{SYMBOLS}]")), F.lit(0)).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(F.col(own["windows"])).alias("n_repeat_words"),
        (score if fitted else F.lit(None).cast("double")).alias("score"),
    ))).alias(q)).drop(own["words"], own["hashes"], own["windows"])
    failed = (F.col(q)["n_words"] < min_words) | (100 * F.col(q)["n_repeat_words"] > max_repeat_percent * F.col(q)["n_words"])
    return counted.withColumn(q, F.col(q).withField("base_failed", failed)).withColumn(
        q, F.col(q).withField("kept", ~F.col(q)["base_failed"] & F.coalesce(F.col(q)["score"] >= threshold, F.lit(True)))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The target of the ratio: documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").alias("id"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents, trusted_ids(labels)).select("doc_id", f"{OWN}quality.*")


def keep_good(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that pass, with their columns as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = judge(documents, trusted_ids(labels))
    return judged.where(F.col(f"{OWN}quality")["kept"]).drop(f"{OWN}quality")
