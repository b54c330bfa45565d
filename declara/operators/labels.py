"""Extreme multi-label helpers on coordinate tables ``(i, j, v)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.functions import scores as S
from declara.operators.aggregations import top_k
from declara.runtime import MODEL_BLOCK_VALUES, draw, stage, with_global_rank


def top_k_sparse(matrix: DataFrame, k: int) -> DataFrame:
    """The k largest entries of every row."""
    return top_k(matrix, ["i"], [F.col("v").desc(), F.col("j")], k).drop("rank")


def project(label_vectors: DataFrame, dims: int, seed: int) -> DataFrame:
    """(label, d, z): label embeddings ``(label, feat, v)`` under a random +-1 projection whose
    entries are functions of their position, so every task sees the same matrix."""
    d = F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("d")
    rows = label_vectors.select("label", "feat", "v", d)
    sign = F.when(F.substring(draw(seed, "feat", "d"), 1, 1).isin(list("02468ace")), 1.0).otherwise(-1.0)
    return rows.groupBy("label", "d").agg(F.sum(F.col("v") * sign).alias("z"))


def ordinal_codes(projected: DataFrame, dims: int, bins: int, n_labels: int) -> DataFrame:
    """Rank of a label in every dimension, cut into equal bins, as one mixed-radix code."""
    size = -(-n_labels // bins)
    # Every dimension holds every label once, so a global rank by (d, z) splits evenly into dimensions.
    ranked = with_global_rank(projected, [F.col("d"), F.col("z"), F.col("label")], "r", start=0)
    return _radix(ranked.withColumn("bin", F.floor(F.pmod(F.col("r"), F.lit(n_labels)) / size)), bins)


def uniform_codes(projected: DataFrame, bins: int) -> DataFrame:
    """Position between the dimension's extremes on ``bins`` evenly spaced edges, as a mixed-radix code."""
    edges = projected.groupBy("d").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (bins - 1)
    at = F.when(F.col("z") >= F.col("hi"), bins - 1).otherwise(F.floor((F.col("z") - F.col("lo")) / step))
    return _radix(projected.join(edges, "d").withColumn("bin", at), bins)


def _radix(binned: DataFrame, bins: int) -> DataFrame:
    digit = F.col("bin") * F.pow(F.lit(float(bins)), F.col("d"))
    return binned.groupBy("label").agg(F.sum(digit).cast("long").alias("code"))


def random_codes(labels: DataFrame, codes: int, seed: int) -> DataFrame:
    return labels.select("label", (F.conv(F.substring(draw(seed, "label"), 1, 8), 16, 10).cast("long") % codes).alias("code"))


CELLS = 1 << 20  # scores held at once


def count_model(instance_codes: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """Labels of every instance from its codes ``(i, code, w)`` by P(label | code), the k best. Scores are compared on
    12 decimals, ties by label.

    Instances with the same codes have the same labels, so every set of codes is scored once. A set is multiplied with the
    model in the task, block of labels by block, and only its k best leave: instances x labels is never a table. The model
    goes out in blocks of at most MODEL_BLOCK_VALUES entries, as many as it needs.
    """
    summed = instance_codes.where("code IS NOT NULL").groupBy("i", "code").agg(F.sum("w").alias("w"))
    owned = stage(summed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("code", "w"))).alias("codes")))
    sets = owned.select("codes").distinct()
    best = sets.mapInArrow(_best_labels(given, k), f"codes {owned.schema['codes'].dataType.simpleString()}, label {given.schema['label'].dataType.simpleString()}, score double, rank long")
    return owned.join(best, "codes").select("i", "label", "score", "rank")


def _best_labels(given: DataFrame, k: int):
    """A function of batches (codes) to rows (codes, label, score, rank)."""
    table = stage(given.where("code IS NOT NULL").groupBy("code", "label").agg(F.sum("p").alias("p"), F.count("p").alias("n")))
    found = table.orderBy(F.col("label").asc_nulls_first(), "code").toArrow()
    context = given.sparkSession.sparkContext
    label = found.column("label").combine_chunks()
    number = np.zeros(len(label), np.int64)  # labels are numbered in their order, so the smaller number wins a tie
    if len(label):
        number[1:] = np.cumsum(pc.fill_null(pc.not_equal(label[1:], label[:-1]), True).to_numpy(zero_copy_only=False))
        number -= np.maximum(0, np.minimum(np.arange(len(label)), label.null_count - 1))  # null is one label, and the first
    codes = {c: j for j, c in enumerate(found.column("code").unique().to_pylist())}
    place = np.array([codes[c] for c in found.column("code").to_pylist()], np.int64)
    p = found.column("p").fill_null(0.0).to_numpy()
    n_labels = int(number[-1]) + 1 if len(number) else 0
    first = np.searchsorted(number, np.arange(n_labels + 1))
    wide = max(1, MODEL_BLOCK_VALUES // max(1, len(codes)))
    shared = []
    for at in range(0, n_labels, wide):  # codes x labels of the block, absent ones as nan
        end = min(n_labels, at + wide)
        rows = slice(first[at], first[end])
        block = np.full((len(codes), end - at), np.nan)
        block[place[rows], number[rows] - at] = p[rows]
        shared.append(context.broadcast((block, label.take(pa.array(first[at:end])))))

    def of(codes_of):
        scores, labels = np.zeros(0), []
        parts = [(codes[c], w or 0.0) for c, w in codes_of if c in codes]
        for block in shared if parts else ():
            values, names = block.value
            for at in range(0, values.shape[1], CELLS):
                score, seen = np.zeros(min(CELLS, values.shape[1] - at)), False
                for j, w in parts:
                    column = values[j, at : at + CELLS]
                    there = ~np.isnan(column)
                    score += np.where(there, w * column, 0.0)
                    seen = seen | there
                score = np.where(seen, score, np.nan)
                kept = np.flatnonzero(seen)
                if not len(kept):
                    continue
                if len(kept) > k:  # all that tie with the k-th stay
                    least = -np.partition(-np.round(score[kept], 12), k - 1)[k - 1]
                    kept = kept[np.round(score[kept], 12) >= least]
                kept = kept[np.argsort(-np.round(score[kept], 12), kind="stable")[:k]]
                scores = np.append(scores, score[kept])
                labels += names.take(pa.array(at + kept)).to_pylist()
        order = np.argsort(-np.round(scores, 12), kind="stable")[:k]
        return [(labels[o], float(scores[o]), r + 1) for r, o in enumerate(order.tolist())]

    kind = label.type

    def score(batches):
        for b in batches:
            sets, out = [], []
            for at, x in enumerate(b.column(0).to_pylist()):
                rows = of([(c["code"], c["w"]) for c in x])
                sets += [at] * len(rows)
                out += rows
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(sets, pa.int64())), pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.float64()),
                pa.array([o[2] for o in out], pa.int64())], names=["codes", "label", "score", "rank"])

    return score


def optimal_codes(instance_labels: DataFrame, label_codes: DataFrame, k: int) -> DataFrame:
    """Codes of every instance through its labels, the k best, scaled to sum 1."""
    summed = instance_labels.join(label_codes, "label").groupBy("i", "code").agg(F.count("*").alias("c"))
    best = top_k(summed, ["i"], [F.col("c").desc(), F.col("code")], k)
    return best.withColumn("w", F.col("c") / F.sum("c").over(Window.partitionBy("i"))).select("i", "code", "w")


def beam_level(beam: DataFrame, children: DataFrame, node_scores: DataFrame, width: int, how: str = "mul") -> DataFrame:
    """One level of a top-down search: children ``(parent, node)`` of the kept nodes, scored by
    ``(i, node, v)`` through a sigmoid and combined with the parent's score; the best ``width`` stay."""
    # every scored node finds its parent first, so the children of a node, the root's too, are never multiplied by its instances
    placed = node_scores.join(stage(children), "node").select("i", "node", "parent", "v")
    opened = beam.select("i", F.col("node").alias("parent"), F.col("score").alias("above"))
    scored = placed.join(opened, ["i", "parent"]).select("i", "node", S.combine(F.col("above"), S.sigmoid(F.col("v")), how).alias("score"))
    return top_k(scored, ["i"], [F.col("score").desc(), F.col("node")], width).drop("rank")


def label_rows(df: DataFrame, row: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Distinct labels numbered from 0 and the coordinate table of a long label table."""
    codes = with_global_rank(df.select(F.col(label).alias("value")).distinct(), [F.col("value")], "j", start=0)
    return codes, df.join(codes, F.col(label) == F.col("value")).select(F.col(row).alias("i"), "j", F.lit(1.0).alias("v"))
