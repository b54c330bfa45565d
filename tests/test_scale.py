"""Jobs that must not multiply or shuffle what a row can answer by itself."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from declara.functions import text as T
from declara.operators import features as X
from declara.operators import labels as L
from declara.operators import lda as LD
from declara.operators import predictions as P
from declara.operators import sweeps as SW
from declara.operators import topics as TP
from declara.plans import textual  # noqa: F401 - registers queries
from declara.plans import views as W
from declara.plans.registry import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keyphrases_in_the_row(spark):
    rows = [(1, "alpha beta the gamma, alpha"), (2, None), (3, "alpha beta"), (3, "alpha beta"), (None, "delta the delta beta"), (4, "the")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = X.keyphrases(df, "id", F.col("text"), ["the"])
    got = {(r["id"], r["phrase"]): r["score"] for r in out.collect()}
    assert got == {(1, "alpha beta"): 3.5, (1, "gamma"): 1.0, (1, "alpha"): 1.5, (3, "alpha beta"): 8.0, (None, "delta"): 1.5, (None, "delta beta"): 3.5}
    alone = X.keyphrases(df.where("id = 1"), "id", F.col("text"), ["the"])
    assert "MapInArrow" in plan_of(alone)


def test_count_model_scores_sets_of_codes(spark):
    codes = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 1, 0.5), (2, 0, 0.5), (3, 2, 0.5), (4, 9, 0.5), (None, 1, 0.5), (5, None, 0.5), (6, 1, 0.5), (6, 1, 0.5)], "i long, code long, w double")
    given = spark.createDataFrame([(0, 7, 0.1), (0, 8, 0.2), (1, 7, 0.2), (1, 8, 0.1), (1, 9, 0.7), (2, 9, 1.0), (0, None, 0.15), (1, None, 0.1)], "code long, label long, p double")
    out = L.count_model(codes, given, 2)
    got = sorted(((r["i"] or 0, r["rank"], r["label"], round(r["score"], 6)) for r in out.collect()))
    assert got == [(0, 1, 9, 0.35), (0, 2, 7, 0.1), (1, 1, 9, 0.35), (1, 2, 7, 0.15), (2, 1, 9, 0.35), (2, 2, 7, 0.15), (3, 1, 9, 0.5), (6, 1, 9, 0.7), (6, 2, 7, 0.2)]
    assert "Window" not in plan_of(out)  # no table of instances x labels is ranked


def test_rules_read_the_predictions_once(spark):
    rows = [("f", "DCO", 1, "1", "Virologie : x", .9), ("f", "consequence", 1, "C1", "Faux negatif", .8), ("f", "gravité_binaire", 1, "a", "a", .7),
            ("g", "DCO", 1, "1", "Virologie : x", .9), ("g", "gravité_binaire", 1, "a", "a", .6), (None, "gravité_binaire", 1, "a", "a", .5),
            ("h", "DCO", 1, "1", "x", .9), ("h", "consequence", 1, "C1", "Faux negatif", .8), ("h", None, 1, "a", "a", .1)]
    ranked = spark.createDataFrame(rows, "file string, model string, rank long, class string, class_name string, proba double")
    decided = spark.createDataFrame([("h", "9", "Virologie : y", 1.0), ("h", "9", "Virologie : y", 1.0), (None, "8", "z", 1.0)], "file string, class string, class_name string, proba double")
    forms = spark.createDataFrame([("f", "patient decede"), ("g", "decede"), ("g", "decede"), ("k", "stable")], "file string, text string")
    out = P.virology_override(P.death_override(P.apply_override(ranked, ["DCO"], decided), forms, "file", F.col("text")))
    critical = [(m, "CRITI") for m in P.SEVERITY_MODELS]
    assert sorted((r["file"] or "", r["model"], r["class"]) for r in out.collect()) == sorted(
        [("", "DCO", "8"), ("", "gravité_binaire", "a"), ("f", "DCO", "1"), ("f", "consequence", "C1"), ("g", "DCO", "1"), ("h", "DCO", "9"), ("h", "DCO", "9"),
         ("h", "consequence", "C1")] + [(f, *c) for f in "fggh" for c in critical])
    assert plan_of(out).count("LogicalRDD") == 5  # the predictions once, decided and forms as marks and as rows


def test_words_are_counted_once(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "id long, text string")
    bow = X.doc2bow(df, "id", F.split("text", " "))
    assert sorted(map(tuple, bow.collect())) == [(1, "a", 1), (1, "b", 2), (3, "", 1)]
    assert plan_of(bow).count("zip_with") == 1


def test_large_models_of_a_sweep_wait(spark):
    held, most = SW.Budget(10), []

    def job(size):
        with held.of(size):
            most.append(held.used)
            time.sleep(0.05)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(job, [4, 6, 5, 20, 3, 10]))
    assert held.used == 0 and all(m <= 10 or m == 20 for m in most)


def test_arrays_of_a_pass_do_not_grow_with_the_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 400, 1, 8 * cores).select("id", F.array(F.lit(0), F.lit(1)).alias("ix"), F.array(F.lit(1.0), F.lit(2.0)).alias("n"))
    sent, added = [], LD.sums.added
    LD.sums.added = lambda df, shape: sent.append(df.count()) or added(df, shape)
    try:
        total = LD.expected_counts(rows, LD.Topics(np.ones((2, 3)), 1 / 3), 5, 1e-3)
    finally:
        LD.sums.added = added
    assert abs(total.sum() - 1200) < 1e-6 and sent[0] <= 2 * cores


def test_ranks_by_file_shuffle_the_lines_once(spark):
    rows = [(1, 7, 3, "A", "O", 10.0, 1.0), (1, 8, 3, "B", "F", 30.0, 3.0), (2, 7, 4, "A", "F", 5.0, 2.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string, l_extendedprice double, l_quantity double")
    ranked = W.ranked(SimpleNamespace(lineitem=lines))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = [(r["class"], r["rank"], r["proba"]) for r in ranked.where("file = 1 AND model = 'DCO'").orderBy("rank").collect()]
    assert got == [("8", 1, 0.75), ("7", 2, 0.25)]


def test_expected_words_are_added_up_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(TP, "STEP", 2)
    rows = [(1, ["a", "b", "a"], [0.25, 0.75]), (2, ["b"], [1.0, 0.0]), (3, None, [0.5, 0.5]), (4, [], [0.5, 0.5]), (5, ["c"], None), (6, ["c", "d"], [0.1, 0.2])]
    docs = spark.createDataFrame(rows, "id long, words array<string>, w array<double>")
    bow = X.doc2bow(docs, "id", F.col("words"))
    freq = TP.expected_term_frequency(bow, "id", docs.where("w IS NOT NULL").select("id", "w"), "w").withColumn("by", F.round("freq", 9))
    want = TP.topic_words(freq, "topic", "by", 3)
    best = TP.expected_top_words(docs, "words", "w", 3)
    both = [sorted((r["topic"], r["rank"], r["term"], round(r["freq"], 9), round(r["lift"], 9), r["total"]) for r in df.collect()) for df in (want, best)]
    assert both[0] == both[1] and len(both[0]) == 6
    assert "posexplode" not in plan_of(best) and "Generate" not in plan_of(best)  # terms x topics are not spelt out


def test_sums_of_a_task_are_sent_in_parts():
    words = pa.array([["a", "b"], ["b", "c"], ["d"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([words, pa.array([[1.0, 2.0]] * 3, pa.list_(pa.float64()))], names=["words", "w"])
    step, most, TP.STEP, TP.SUMS = TP.STEP, TP.SUMS, 2, 3
    try:
        sent = [r for b in TP._summed_words([batch]) for r in b.to_pylist()]
    finally:
        TP.STEP, TP.SUMS = step, most
    assert [(r["term"], r["v"], r["total"]) for r in sent] == [("a", [1, 2], 1), ("b", [1, 2], 1), ("b", [1, 2], 1), ("c", [1, 2], 1), ("d", [1, 2], 1)]


def test_topic_documents_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda n: seen.add(1) or n, "long")
    docs = spark.range(40).select("id", F.concat(F.lit("R"), "id").alias("name"), note(F.col("id") + 5).alias("n"), F.array(*[F.lit(x) for x in (0.2, 0.8)]).alias("w"))
    long = docs.select("id", "name", "n", F.posexplode("w").alias("topic", "weight"))
    assert TP.topic_documents(long, "id", "name", "n").count() == 2 * 30 and seen.value == 40


def test_pairs_that_cannot_be_phrases_are_only_counted(spark, monkeypatch):
    kept, real = [], X.stage
    monkeypatch.setattr(X, "stage", lambda df: kept.append(real(df)) or kept[-1])
    docs = spark.createDataFrame([("a b c d",), ("a b e f",), ("g h i j k l m n",)], "text string")
    out = X.phrases(docs, F.split("text", " "))
    assert [(r["a"], r["b"], r["n_ab"], r["score"]) for r in out.collect()] == [("a", "b", 2, (14 + 12) / 4)]
    assert [df.count() for df in kept if "n_ab" in df.columns] == [1]


def test_tokens_cut_words_at_digits(spark):
    texts = [("Les2mots de l'été, 12abc34de5fgh le2 pour",), (None,), ("",), ("123 4567",)]
    got = [r[0] for r in spark.createDataFrame(texts, "text string").coalesce(1).select(T.tokens(F.col("text"))).collect()]
    assert got == [["les", "mots", "ete", "abc", "fgh"], None, [], []]


def test_texts_are_cut_into_words_once(spark):
    rows = [(1, "alpha chats chat", "x"), (2, "chat alpha beta", "y"), (3, None, "y")]
    for name, found in (("fn_lemma_lookup", 5), ("ml_coherence_umass", 2)):
        seen = spark.sparkContext.accumulator(0)
        note = F.udf(lambda s: seen.add(1) or s).asNondeterministic()
        texts = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", note("text").alias("text"), "source")
        assert len(QUERIES[name](SimpleNamespace(texts=texts)).collect()) == found and seen.value == 3


def test_topics_need_one_weight_each():
    for weights in ([[1.0, 2.0], [1.0, 2.0, 1.0, 2.0]], [[1.0, None], [1.0, 2.0]]):
        batch = pa.RecordBatch.from_arrays([pa.array([["a"], ["b"]], pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))], names=["words", "w"])
        with pytest.raises(ValueError):
            list(TP._summed_words([batch]))


def test_ngram_apply_merges_trigrams(spark):
    texts = spark.createDataFrame([(i, "alpha beta gamma " + " ".join(f"w{c}{'xyz'[i % 3]}{'klmn'[i // 3]}" for c in "abcd")) for i in range(12)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["words"].split(" ") for r in QUERIES["fn_ngram_apply"](SimpleNamespace(texts=texts)).collect()}
    assert len(got) == 12 and all(words[0] == "alpha_beta_gamma" and len(words) == 5 for words in got.values())


def test_merging_twice_leaves_only_what_is_still_read(spark, monkeypatch):
    kept, real = [], X.stage
    monkeypatch.setattr(X, "stage", lambda df: kept.append(real(df)) or kept[-1])
    rows = [(i, ["a", "b", "c"] + [f"{x}{i % 3}{i // 3}" for x in "wxyz"]) for i in range(12)] + [(99, None), (3, ["a"])]
    out = X.merged_twice(spark.createDataFrame(rows, "id long, w array<string>"), "id", F.col("w"))
    there = [t for t in kept if os.path.exists(t._staged.removeprefix("file:"))]
    assert len(kept) >= 10 and len(there) == 2  # the second phrases and the texts they are merged in
    got = {r["id"]: (r["bigrams"], r["trigrams"]) for r in out.where("id NOT IN (3, 99)").collect()}
    assert len(got) == 11 and all(b[0] == "a_b" and t[0] == "a_b_c" for b, t in got.values())
    assert out.where("id = 99 AND trigrams IS NULL").count() == 1 and out.where("id = 3").count() == 2
