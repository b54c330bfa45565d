"""Vocabulary, bag of words, phrases, TF-IDF and other text features as relational jobs."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from declara.functions.text import bag
from declara.functions.vectors import let
from declara.runtime import is_staged, shuffles_removed, skew_safe_lookup, stage, unstage, with_global_rank


def token_rows(df: DataFrame, row: str, words: Column, positions: bool = False) -> DataFrame:
    """One row per word: ``(row, term)`` or ``(row, pos, term)``."""
    if positions:
        return df.select(row, F.posexplode(words).alias("pos", "term"))
    return df.select(row, F.explode(words).alias("term"))


def doc2bow(df: DataFrame, row: str, words: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """(row, term, tf), on the words of ``vocabulary`` if given. Words are counted inside the row."""
    # an inner generator would be given a filter that counts the words once more for its test of emptiness
    bow = df.select(row, F.inline_outer(bag(words))).where("tf IS NOT NULL")
    if vocabulary is not None:
        known = vocabulary.select("term", F.col("df").alias("_df"))
        bow = skew_safe_lookup(bow, known, ["term"], "_df", F.xxhash64(row)).drop("_df")
    return bow


def term_stats(bow: DataFrame) -> DataFrame:
    """Document frequency and corpus frequency; a bag holds every (row, term) once."""
    return bow.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocabulary(
    stats: DataFrame, n_docs: Column, no_below: int = 3, no_above: float = 0.8, keep_n: int = 100_000
) -> DataFrame:
    """Terms with df >= no_below and df <= no_above * N, the keep_n of highest df (ties by term)."""
    kept = stats.where((F.col("df") >= no_below) & (F.col("df") <= no_above * n_docs))
    ranked = with_global_rank(kept, [F.col("df").desc(), F.col("term")], "rank")
    return ranked.where(F.col("rank") <= keep_n)


def top_terms(stats: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """Terms with df >= min_df, the max_features of highest corpus frequency (ties by term)."""
    kept = stats.where(F.col("df") >= min_df)
    ranked = with_global_rank(kept, [F.col("cf").desc(), F.col("term")], "rank")
    return ranked.where(F.col("rank") <= max_features)


def tfidf(bow: DataFrame, row: str, terms: DataFrame, n_docs: Column, norm: str | None = "l2") -> DataFrame:
    """(row, term, tf, value): sublinear tf times smoothed idf, scaled per row."""
    known = terms.select("term", "df")
    rows = skew_safe_lookup(bow, known, ["term"], "df", F.xxhash64(row))
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    weighted = rows.select(row, "term", "tf", ((1 + F.log("tf")) * idf).alias("value"))
    if norm is None:
        return weighted
    of_row = Window.partitionBy(row)
    size = F.sum(F.abs("value")) if norm == "l1" else F.sum(F.col("value") * F.col("value"))
    scale = size.over(of_row) if norm == "l1" else F.sqrt(size.over(of_row))
    return weighted.withColumn("value", F.col("value") / scale)


def _windows(length: Column, n: int, cut) -> Column:
    """cut(i) for every start i of an n-wide window; empty when nothing fits."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), length - n + 1))
    return F.when(length >= n, F.transform(starts, lambda i: cut(i))).otherwise(F.array().cast("array<string>"))


def character_grams(text: Column, low: int, high: int, in_words: bool = False) -> Column:
    """Character n-grams of a text, optionally word by word with a space on both sides."""

    def grams_of(size):
        return lambda part: _windows(F.length(part), size, lambda i: F.substr(part, i, F.lit(size)))

    def grams(part: Column) -> Column:
        return F.concat(*[grams_of(n)(part) for n in range(low, high + 1)])

    if not in_words:
        return let(text, grams)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    spaced = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(spaced, lambda w: grams(w)))


def word_grams(words: Column, low: int, high: int) -> Column:
    """Word n-grams, joined by a space."""

    def grams_of(size):
        return lambda w: _windows(F.size(w), size, lambda i: F.array_join(F.slice(w, i, size), " "))

    return let(words, lambda w: F.concat(*[grams_of(n)(w) for n in range(low, high + 1)]))


def column_features(df: DataFrame, row: str, specs: dict[str, dict]) -> DataFrame:
    """One TF-IDF per text column, side by side in long form ``(row, column, term, value)``.

    A spec holds ``words`` (a column expression) and the options of ``top_terms``/``tfidf``.
    """
    parts = []
    n_docs = df.select(F.count("*")).scalar()
    for name, spec in specs.items():
        bow = doc2bow(df, row, spec["words"])
        terms = top_terms(term_stats(bow), spec.get("min_df", 1), spec["max_features"])
        values = tfidf(bow, row, terms, n_docs, spec.get("norm", "l2"))
        parts.append(values.select(row, F.lit(name).alias("column"), "term", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjacent_pairs(words: Column) -> Column:
    """Array of (a, b) for neighbouring words."""
    return let(words, lambda w: F.arrays_zip(
        F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)).alias("a"), F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)).alias("b")
    ))


def pair_counts(df: DataFrame, words: Column) -> DataFrame:
    pairs = df.select(F.explode(adjacent_pairs(words)).alias("p"))
    return pairs.select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))


def phrases(df: DataFrame, words: Column, min_count: int = 1, threshold: float = 2.0) -> DataFrame:
    """Pairs scoring (n_ab - min_count) * V / (n_a * n_b) above the threshold; V counts the
    distinct words and distinct pairs."""
    return _phrases(df, words, min_count, threshold)[0]


def _phrases(df: DataFrame, words: Column, min_count: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """The phrases, and the staged tables they are read from."""
    texts = df.select(words.alias("w"))
    docs = texts if is_staged(df) else stage(texts)  # the words are read twice
    # Both counts are read several times below, so each is computed once.
    unigrams = stage(docs.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    # Most pairs occur min_count times at most, score 0 or less and are only counted.
    counted, least = Observation(), min_count + 1 if threshold >= 0 else min_count
    frequent = stage(pair_counts(docs, F.col("w")).observe(counted, F.count("*").alias("n")).where(F.col("n_ab") >= least))
    v = unigrams.select(F.count("*")).scalar() + F.lit(counted.get["n"])
    first = unigrams.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    second = unigrams.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    scored = frequent.join(first, "a").join(second, "b").withColumn(
        "score", (F.col("n_ab") - min_count) * v / (F.col("n_a") * F.col("n_b"))
    )
    found = scored.where(F.col("score") > threshold).select("a", "b", "n_ab", "n_a", "n_b", "score")
    return found, [unigrams, frequent] + [docs] * is_staged(docs)


PAIR_BITS = 1 << 26  # of the table that tells pairs which cannot be phrases: 8 MB at any size of the data


def _pair_bits(phrase_table: DataFrame) -> bytes:
    """One bit per hash of a phrase, PAIR_BITS in all."""
    place = F.crc32(F.concat_ws("\x01", "a", "b").cast("binary")) % PAIR_BITS + 1
    pieces = phrase_table.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(PAIR_BITS // 8)
    for r in pieces.collect():  # at most PAIR_BITS / 32768 pieces of 4 kB
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(out)


def apply_phrases(df: DataFrame, row: str, words: Column, phrase_table: DataFrame, glue: str = "_") -> DataFrame:
    """(row, words) with learned pairs merged left to right; a word merged into the one before
    cannot open a pair itself, so in a run of pairs every second one counts.

    The phrase table may be as large as the corpus. A document sends out each of its pairs that may be a phrase once: a bit
    table of fixed size drops the others, however frequent, inside the task. What is left meets the phrase table in a join that serves
    frequent phrases map-side; a document's phrases come back as one array and are merged inside its row.
    Rows that repeat an id keep their own words. Null words stay null.
    """
    return _apply(df, row, words, phrase_table, glue)[0]


def _apply(df: DataFrame, row: str, words: Column, phrase_table: DataFrame, glue: str = "_") -> tuple[DataFrame, list[DataFrame]]:
    """The merged words, and the staged tables they are read from."""
    spark = df.sparkSession
    table = stage(phrase_table.select("a", "b", "n_ab"))
    docs = stage(df.select(row, words.alias("words")).withColumn("_doc", F.monotonically_increasing_id()))
    bits = spark.sparkContext.broadcast(_pair_bits(table))

    def candidates(batches):
        seen = bits.value
        for b in batches:
            out = []
            for doc, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for first, second in set(zip(w or (), (w or ())[1:])):
                    if first is not None and second is not None:
                        place = zlib.crc32(f"{first}\x01{second}".encode("utf-8", "surrogatepass")) % PAIR_BITS
                        if seen[place >> 3] >> (place & 7) & 1:
                            out.append((doc, first, second))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["_doc", "a", "b"])

    asked = docs.select("_doc", "words").mapInArrow(candidates, "_doc long, a string, b string")
    found = skew_safe_lookup(asked, table, ["a", "b"], "n_ab", F.xxhash64("_doc"))
    hits = found.groupBy("_doc").agg(F.collect_list(F.struct("a", "b")).alias("hits"))
    kind = docs.schema[row].dataType.simpleString()

    def merge(batches):
        for b in batches:
            out = []
            for w, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if w and hits:
                    pairs, merged, at = {(h["a"], h["b"]) for h in hits}, [], 0
                    while at < len(w):
                        joins = at + 1 < len(w) and (w[at], w[at + 1]) in pairs
                        merged.append(f"{w[at]}{glue}{w[at + 1]}" if joins else w[at])
                        at += 1 + joins
                    w = merged
                out.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=[row, "words"])

    merged = docs.join(hits, "_doc", "left").select(row, "words", "hits").mapInArrow(merge, f"`{row}` {kind}, words array<string>")
    return merged, [table, docs]


def merged_twice(df: DataFrame, row: str, words: Column, min_count: int = 1, second_min_count: int = 5, threshold: float = 2.0) -> DataFrame:
    """(row, bigrams, trigrams): words with learned pairs merged, and those merged once more by pairs learned on the result.
    Of the tables on the way only what is still to be read stays on disk."""

    def learned(texts: DataFrame, least: int) -> DataFrame:
        found, used = _phrases(texts, F.col("words"), least, threshold)
        table = stage(found.select("a", "b", "n_ab"))
        unstage(*used)
        return table

    with shuffles_removed(df.sparkSession):
        texts = stage(df.select(row, words.alias("words")))
        pairs = learned(texts, min_count)
        merged, used = _apply(texts, row, F.col("words"), pairs)
        once = stage(merged)
        unstage(texts, pairs, *used)
        pairs = learned(once, second_min_count)
        again, _ = _apply(once.select(F.struct(row, "words").alias("_row"), "words"), "_row", F.col("words"), pairs)
        unstage(once, pairs)
    return again.select(f"_row.{row}", F.col("_row.words").alias("bigrams"), F.col("words").alias("trigrams"))


def token_indices(rows: DataFrame, row: str, stats: DataFrame, top: int, length: int) -> DataFrame:
    """Frequency-ranked word indices of every row, left-padded with 0 to ``length``."""
    from declara.functions.text import pad_left

    ranked = top_terms(stats, 1, top).select("term", "cf", F.col("rank").alias("index"))
    known = skew_safe_lookup(rows, ranked, ["term"], "cf", F.xxhash64(row, "pos"))
    by_row = known.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("pos", "index"))).alias("_x"))
    ids = F.transform("_x", lambda s: s["index"].cast("int"))
    return by_row.select(row, pad_left(ids, length).alias("ids"))


def lemmatise(rows: DataFrame, row: str, lexicon: DataFrame, counts: DataFrame) -> DataFrame:
    """Word rows with the lexicon's lemma in place of the form, itself when unlisted.
    ``lexicon`` is ``(term, lemma)``, ``counts`` the corpus frequency ``(term, cf)``."""
    listed = lexicon.join(counts.select("term", "cf"), "term")
    found = skew_safe_lookup(rows, listed, ["term"], "cf", F.xxhash64(row, "pos"), inner=False)
    return found.select(row, "pos", F.coalesce("lemma", "term").alias("term"))


def keyphrases(df: DataFrame, row: str, text: Column, stop_words: list[str]) -> DataFrame:
    """Phrases between stop words and marks, scored by the sum of degree / frequency of their
    words inside the document: ``(row, phrase, score)``.

    A document is scored inside its row. Rows that share an id count as one document; only they are shuffled.
    """
    from declara.functions.text import fold

    marks = F.regexp_replace(fold(text), r"[^\p{L} ]", " | ")
    words = F.filter(F.split(marks, " +"), lambda w: w != "")
    glued = F.array_join(F.transform(words, lambda w: F.when(w.isin(stop_words), F.lit("|")).otherwise(w)), " ")
    cut = F.filter(F.transform(F.split(glued, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    shared = stage(df.groupBy(row).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(row).alias("_shared")))
    same = F.col(row).eqNullSafe(F.col("_shared"))
    alone = df.join(shared, same, "left_anti").select(row, cut.alias("phrases"))
    kind = df.schema[row].dataType.simpleString()
    scored = alone.mapInArrow(_phrase_scores, f"`{row}` {kind}, phrase string, score double")
    return scored.unionByName(_shared_keyphrases(df.join(shared, same, "left_semi"), row, cut))


def _phrase_scores(batches):
    """Rows (row, phrase, score) of batches (row, phrases): the distinct phrases of each row."""
    for b in batches:
        doc, found, scores = [], [], []
        for i, phrases in enumerate(b.column(1).to_pylist()):
            if not phrases:
                continue
            count, degree, parts = {}, {}, {}
            for phrase in phrases:
                parts[phrase] = words = parts.get(phrase) or phrase.split(" ")
                for w in words:
                    count[w] = count.get(w, 0) + 1
                    degree[w] = degree.get(w, 0) + len(words)
            doc.extend([i] * len(parts))
            found.extend(parts)
            scores.extend(sum(degree[w] / count[w] for w in words) for words in parts.values())
        names = [b.schema.field(0).name, "phrase", "score"]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=names)


def _shared_keyphrases(df: DataFrame, row: str, cut: Column) -> DataFrame:
    """The same for rows that share their ids, word by word."""
    phrase_rows = df.select(row, F.posexplode(cut).alias("at", "phrase"))
    word_rows = phrase_rows.select(
        row, "at", "phrase", F.size(F.split("phrase", " ")).alias("len"), F.explode(F.split("phrase", " ")).alias("word")
    )
    of_word = Window.partitionBy(row, "word")
    scored = word_rows.withColumn("s", F.sum("len").over(of_word) / F.count("*").over(of_word))
    return (
        scored.groupBy(row, "at", "phrase").agg(F.sum("s").alias("score"))
        .groupBy(row, "phrase").agg(F.max("score").alias("score"))
    )


def listed_terms(df: DataFrame, row: str, words: Column, terms: DataFrame, longest: int) -> DataFrame:
    """Terms of an external list found in the word sequence of a row, each once: ``(row, term)``."""
    grams = df.select(row, F.explode(F.array_distinct(word_grams(words, 1, longest))).alias("term"))
    return grams.join(terms.select("term").distinct(), "term", "left_semi")
