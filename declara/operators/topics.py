"""Questions about topics over the long table ``(row, topic, weight)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.operators.aggregations import top_k, with_share
from declara.operators.quantiles import quantile_column
from declara.runtime import stage


def long_weights(df: DataFrame, row: str, weights: Column, carry: list[str] = ()) -> DataFrame:
    """Document x topic matrix in long form, topics numbered from 0."""
    return df.select(row, *carry, F.posexplode(weights).alias("topic", "weight"))


def significant(long: DataFrame, threshold: float = 0.1) -> DataFrame:
    return long.where(F.col("weight") > threshold)


def topic_weight(long: DataFrame, words: str | None = None) -> DataFrame:
    """Share of the corpus per topic; documents count by their number of words if given."""
    mass = F.col("weight") * (F.col(words) if words else F.lit(1.0))
    summed = long.groupBy("topic").agg(F.sum(mass).alias("mass"))
    return summed.select("topic", (F.col("mass") / summed.select(F.sum("mass")).scalar()).alias("weight"))


def display_order(weights: DataFrame) -> DataFrame:
    """Topics renumbered 1.. by decreasing weight. One row per topic enters the window."""
    order = Window.orderBy(F.col("weight").desc(), "topic")
    return weights.select("topic", F.row_number().over(order).cast("long").alias("display"), "weight")


def document_topics(long: DataFrame, row: str, k: int = 5) -> DataFrame:
    return top_k(long, [row], [F.col("weight").desc(), F.col("topic")], k)


def topic_documents(long: DataFrame, row: str, declaration: str, words: str) -> DataFrame:
    """Documents of every topic: longer than the lower quartile of word counts, weight in the
    upper quartile of the remaining documents, the heaviest row per declaration."""
    long = stage(long)  # read in every pass of the quantiles
    docs = stage(long.select(row, words).dropDuplicates([row]))
    shortest = quantile_column(docs, [], words, 0.25, "q").select("q").scalar()
    remaining = long.where(F.col(words) > shortest)
    cut = stage(quantile_column(remaining, ["topic"], "weight", 0.75, "cut"))  # one row per topic
    upper = remaining.join(cut, "topic").where(F.col("weight") >= F.col("cut"))
    best = F.max_by(F.struct(row, "weight"), F.struct(F.col("weight"), -F.col(row)))
    return upper.groupBy("topic", declaration).agg(best.alias("b")).select(
        "topic", declaration, F.col(f"b.{row}").alias(row), F.col("b.weight").alias("weight")
    )


def cluster_topics(long: DataFrame, cluster: str, threshold: float = 0.1, k: int | None = None) -> DataFrame:
    """Topics that are significant in the documents of a cluster, counted, ranked, scaled to sum 1
    over the topics kept."""
    counted = significant(long, threshold).groupBy(cluster, "topic").agg(F.count("*").alias("n"))
    ranked = top_k(counted, [cluster], [F.col("n").desc(), F.col("topic")], k)
    return with_share(ranked, [cluster], "n", "score")


def topic_words(term_topic: DataFrame, topic: str, value: str, k: int = 30) -> DataFrame:
    """k heaviest words per topic."""
    return top_k(term_topic, [topic], [F.col(value).desc(), F.col("term")], k)


def expected_term_frequency(bow: DataFrame, row: str, weights: DataFrame, column: str) -> DataFrame:
    """Sum over documents of tf * P(topic | document) per (topic, term), and its lift over the
    term's total. The distributions are summed as vectors per term, so a bag entry stays one row."""
    vectors = weights.select(row, array_to_vector(F.col(column)).alias("_v"))
    summed = bow.join(vectors, row).groupBy("term").agg(
        Summarizer.metrics("sum").summary(F.col("_v"), F.col("tf").cast("double")).alias("s"),
        F.sum("tf").alias("total"),
    )
    long = summed.select("term", "total", F.posexplode(vector_to_array(F.col("s.sum"))).alias("topic", "freq"))
    return long.withColumn("lift", F.col("freq") / F.col("total"))


SUMS = 1 << 24  # numbers that a task adds up before it sends them
STEP = 1 << 18  # words of one step


def _summed_words(batches):
    """Rows (term, v, total) of batches (words, weights): the sums of the weights and the number of a term's words, added up over many rows."""
    place, sums, totals = {}, np.zeros((0, 0)), np.zeros(0)

    def sent():
        terms = list(place)
        for at in range(0, len(terms), 4096):
            some = slice(at, min(at + 4096, len(terms)))
            part = sums[some]
            ends = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(terms[some], pa.string()), pa.ListArray.from_arrays(ends, pa.array(part.ravel())), pa.array(totals[some].astype(np.int64))], names=["term", "v", "total"])

    for b in batches:
        lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(b):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - lengths[start] + STEP)))
            words, weights = b.column(0).slice(start, stop - start), b.column(1).slice(start, stop - start)
            flat = weights.flatten()
            if flat.null_count or len(set(weights.value_lengths().to_pylist())) > 1:
                raise ValueError("documents must have a weight for every topic, once")
            v = flat.to_numpy(zero_copy_only=False).reshape(len(weights), -1)
            doc = np.repeat(np.arange(len(words)), lengths[start:stop].astype(np.int64))
            found = words.flatten().dictionary_encode()
            code, terms = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
            start = stop
            if not terms:
                continue
            at = np.array([place.setdefault(t, len(place)) for t in terms])
            if len(place) > len(sums):
                more = max(len(place), 2 * len(sums))
                sums = np.concatenate([sums.reshape(len(sums), v.shape[1]), np.zeros((more - len(sums), v.shape[1]))])
                totals = np.append(totals, np.zeros(more - len(totals)))
            for j in range(v.shape[1]):
                sums[at, j] += np.bincount(code, v[doc, j], len(terms))
            totals[at] += np.bincount(code, minlength=len(terms))
            if len(place) * v.shape[1] > SUMS:
                yield from sent()
                place, sums, totals = {}, np.zeros((0, 0)), np.zeros(0)
    yield from sent()


def _best_of_batches(k: int):
    """Rows (term, total, topic, freq) of batches (term, v, total): of every batch and topic the terms that may be among the k best."""

    def best(batches):
        for b in batches:
            if not len(b):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            ranked = np.where(np.isnan(v), np.inf, v)
            if len(b) > k:  # frequencies are compared on nine decimals, so what is as near stays
                least = np.partition(ranked, len(b) - k, axis=0)[len(b) - k]
                i, j = np.nonzero(ranked >= least - 1e-8 - 1e-12 * np.abs(least))
            else:
                i, j = np.nonzero(np.ones_like(ranked, dtype=bool))
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(j.astype(np.int32)), pa.array(v[i, j])], names=["term", "total", "topic", "freq"])

    return best


def expected_top_words(docs: DataFrame, words: str, weights: str, k: int) -> DataFrame:
    """(term, total, topic, freq, lift, rank): the k terms of every topic with the largest expected frequency on nine decimals, as by
    ``expected_term_frequency``. Documents hold their words and their topics' weights in the row. Both are added up inside the task, which sends one vector per
    term, and of the table of terms x topics only what may be among the best is spelt out, so neither a bag entry nor its vector is shuffled or sorted."""
    rows = docs.where(F.col(words).isNotNull() & F.col(weights).isNotNull()).select(words, weights).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(_summed_words, "term string, v array<double>, total long")
    summed = parts.groupBy("term").agg(vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("v"))["sum"]).alias("v"), F.sum("total").alias("total"))
    long = summed.select("term", "v", "total").mapInArrow(_best_of_batches(k), "term string, total long, topic int, freq double")
    long = long.withColumn("lift", F.col("freq") / F.col("total")).withColumn("_by", F.round("freq", 9))
    return topic_words(long, "topic", "_by", k).drop("_by")


def topic_distance(top_words: DataFrame, topic: str) -> DataFrame:
    """Jaccard distance of the word sets of every pair of topics.

    Pairs are counted through the shared words; the table has one row per topic and word
    rank, so its size is fixed by the model, and pairs without common word are 1.
    """
    sizes = top_words.groupBy(topic).agg(F.count("*").alias("n"))
    a = top_words.select(F.col(topic).alias("a"), "term")
    b = top_words.select(F.col(topic).alias("b"), "term")
    common = a.join(b, "term").groupBy("a", "b").agg(F.count("*").alias("c"))
    topics = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(topic).alias("b"), F.col("n").alias("n_b")))).alias("t"))
    grid = sizes.select(F.col(topic).alias("a"), F.col("n").alias("n_a"), F.inline(topics.scalar()))
    joined = grid.join(common, ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return joined.select("a", "b", (1 - F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))).alias("dist"))


def coherence_umass(bow: DataFrame, row: str, top_words: DataFrame, topic: str, rank: str = "rank") -> DataFrame:
    """Mean over ordered word pairs (higher rank i, lower rank j < i) of
    log((D(w_i, w_j) + 1) / D(w_j)), per topic.

    Only the top words of the model take part. Each document's distinct top words are collected
    (at most topics x words of them) and combined inside the row, topic by topic.
    """
    words = stage(top_words.select(F.col(topic).alias("topic"), F.col(rank).alias("r"), "term"))
    seen = bow.select(row, "term").join(words, "term")
    per_doc = stage(seen.groupBy(row, "topic").agg(F.array_sort(F.collect_list("r")).alias("rs")))  # read twice below
    singles = per_doc.select("topic", F.explode("rs").alias("j")).groupBy("topic", "j").agg(F.count("*").alias("d_j"))
    inside = F.flatten(F.transform("rs", lambda i: F.transform(
        F.filter("rs", lambda j: j < i), lambda j: F.struct(i.alias("i"), j.alias("j"))
    )))
    together = per_doc.select("topic", F.inline(inside)).groupBy("topic", "i", "j").agg(F.count("*").alias("d_ij"))
    ranks = words.groupBy("topic").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    wanted = ranks.select("topic", F.inline(inside))
    scored = wanted.join(together, ["topic", "i", "j"], "left").join(singles, ["topic", "j"]).select(
        "topic", F.log((F.coalesce("d_ij", F.lit(0)) + 1) / F.col("d_j")).alias("s")
    )
    return scored.groupBy("topic").agg(F.avg("s").alias("coherence"), F.count("*").alias("pairs"))


def review_band(scores: DataFrame, key: str, value: str, k: int, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """k best, k worst and the rows between two quantiles, tagged by ``band``."""
    lo = quantile_column(scores, [], value, low, "q").select("q").scalar()
    hi = quantile_column(scores, [], value, high, "q").select("q").scalar()
    best = scores.orderBy(F.col(value).desc(), key).limit(k).withColumn("band", F.lit("best"))
    worst = scores.orderBy(F.col(value), key).limit(k).withColumn("band", F.lit("worst"))
    middle = scores.where((F.col(value) > lo) & (F.col(value) < hi)).withColumn("band", F.lit("middle"))
    return best.unionByName(worst).unionByName(middle)
