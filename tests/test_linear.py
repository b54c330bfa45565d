"""Linear models of many targets against one target at a time, and calibration against direct fits."""

import math

import numpy as np
import pytest

from declara.operators import linear as L
from declara.operators import models as M


def objective(w, x, sign, weight, reg, loss):
    m = sign * (np.hstack([x, np.ones((len(x), 1))]) @ w)
    part = np.maximum(1 - m, 0) ** 2 if loss == "squared hinge" else np.logaddexp(0, -m)
    return reg / 2 * (w @ w) + (weight * part).sum()


def minimum(x, sign, weight, reg, loss):
    """Newton steps with halving on one dense problem."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        m = sign * (z @ w)
        if loss == "squared hinge":
            g, h = -2 * weight * sign * np.maximum(1 - m, 0), 2 * weight * (m < 1)
        else:
            p = 1 / (1 + np.exp(m))
            g, h = -weight * sign * p, weight * p * (1 - p)
        gradient = z.T @ g + reg * w
        step = np.linalg.solve(z.T @ (z * h[:, None]) + reg * np.eye(len(w)), gradient)
        size = 1.0
        while objective(w - size * step, x, sign, weight, reg, loss) > objective(w, x, sign, weight, reg, loss) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(gradient).max() < 1e-10:
            break
    return w


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(5, 6)) * 1.5
    label = draw.integers(0, 5, 240)
    x = centres[label] + draw.normal(size=(240, 6))
    rows = [(i, x[i].tolist(), f"c{label[i]}", i % 3) for i in range(240)]
    return x, label, spark.createDataFrame(rows, "row long, num array<double>, label string, fold int").repartition(6).cache()


@pytest.mark.parametrize("loss", ["squared hinge", "logistic"])
@pytest.mark.parametrize("block", [None, 20])
def test_all_columns_reach_their_minimum(data, monkeypatch, loss, block):
    x, label, df = data
    if block:
        monkeypatch.setattr(L, "MODEL_BLOCK_VALUES", block)
        monkeypatch.setattr(L.sums, "SENT", 16)
    classes = L.class_list(df, df.label)
    assert classes == [f"c{i}" for i in range(5)]
    model = L.fit(L.prepared(df, "row", "num", "label", classes, "fold").cache(), classes, 3, loss, passes=200, tolerance=1e-6)
    for f in range(3):
        kept = np.arange(240) % 3 != f
        for c in range(5):
            sign = np.where(label[kept] == c, 1.0, -1.0)
            weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())
            want = minimum(x[kept], sign, weight, 0.01, loss)
            got = model.of_fold(f)[:, c]
            low = objective(want, x[kept], sign, weight, 0.01, loss)
            assert objective(got, x[kept], sign, weight, 0.01, loss) <= low * (1 + 1e-6) + 1e-9


def test_plan_does_not_grow_with_the_classes(spark):
    def plan(k):
        rows = [(i, [float(i % 7), float(i % k)], i % k) for i in range(4 * k)]
        df = spark.createDataFrame(rows, "row long, num array<double>, label long")
        out = M.svm_scores(df, df, "row", "label", "num", passes=3)
        assert out.count() == 4 * k * k
        return len(out._jdf.queryExecution().executedPlan().toString())

    assert abs(plan(300) - plan(3)) < 200


def test_isotonic_equals_pooling_all_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(c, round(float(s), 2), bool(draw.random() < 1 / (1 + math.exp(-c * s)))) for c in (1, 2, 3) for s in draw.normal(size=400)]
    curves = L.isotonic(spark.createDataFrame(rows, "column int, score double, y boolean").repartition(7))
    for c in (1, 2, 3):
        mine = sorted((s, y) for k, s, y in rows if k == c)
        at = sorted({s for s, _ in mine})
        n = np.array([sum(1 for s, _ in mine if s == a) for a in at], float)
        t = np.array([sum(y for s, y in mine if s == a) for a in at], float)
        # the least upper mean over all ranges: the definition of the isotonic fit
        up, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(t))
        want = [max(min((total[j] - total[i]) / (up[j] - up[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))]
        assert np.allclose(np.interp(at, *curves[c]), want)


def test_sigmoid_has_zero_gradient(data):
    x, label, df = data
    classes = L.class_list(df, df.label)
    prepared = L.prepared(df, "row", "num", "label", classes, "fold").cache()
    model = L.fit(prepared, classes, 3)
    curve = L.sigmoid(prepared, model)
    for f in range(3):
        held = np.arange(240) % 3 == f
        s = np.hstack([x[held], np.ones((held.sum(), 1))]) @ model.of_fold(f)
        for c in range(5):
            yes = label[held] == c
            t = np.where(yes, (yes.sum() + 1) / (yes.sum() + 2), 1 / ((~yes).sum() + 2))
            p = 1 / (1 + np.exp(-(curve[0, f * 5 + c] * s[:, c] + curve[1, f * 5 + c])))
            assert abs(((p - t) * s[:, c]).sum()) < 1e-4 and abs((p - t).sum()) < 1e-4


@pytest.mark.parametrize("how", ["isotonic", "sigmoid"])
def test_calibrated_probabilities_find_the_classes(data, how):
    x, label, df = data
    out = M.calibrated_svm(df.where("row < 160"), df.where("row >= 160"), "row", "label", "num", 3, how).collect()
    found = {}
    for r in out:
        found.setdefault(r["row"], {})[r["class"]] = r["proba"]
    assert len(found) == 80 and all(abs(sum(p.values()) - 1) < 1e-9 and len(p) == 5 for p in found.values())
    assert np.mean([max(p, key=p.get) == f"c{label[i]}" for i, p in found.items()]) > 0.75


def test_label_sets(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(200, 3))
    rows = [(i, v.tolist(), [f"L{j}" for j in range(3) if v[j] > 0.2] or None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row long, num array<double>, labels array<string>")
    out = M.one_vs_rest_labels(df, df, "row", "labels", "num").collect()
    right = np.mean([(r["score"] > 0) == (r["label"] in (rows[r["row"]][2] or [])) for r in out])
    assert len(out) == 600 and right > 0.95


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "row long, num array<double>, label string")
    assert M.svm_scores(df, df, "row", "label", "num").count() == 0


def test_chains_use_the_labels_before(spark):
    """L2 is L0 and L1, which no plane through the vectors tells; chains that come to it last see both."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 2))
    bits = np.column_stack([x[:, 0] > 0, x[:, 1] > 0, np.zeros(400, bool)])
    bits[:, 2] = bits[:, 0] & bits[:, 1]
    rows = [(i, v.tolist(), [f"L{j}" for j in range(3) if bits[i, j]]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row long, num array<double>, labels array<string>")
    out = M.classifier_chains(df, df, "row", "labels", "num", chains=10, passes=80).collect()
    score = np.zeros((400, 3))
    for r in out:
        score[r["row"], int(r["label"][1])] = r["score"]
    assert len(out) == 1200 and set(np.round(score.ravel() * 10) / 10) <= {i / 10 for i in range(11)}
    right = ((score >= 0.5) == bits).mean(axis=0)
    alone = M.one_vs_rest_labels(df, df, "row", "labels", "num").where("label = 'L2'").collect()
    assert right[:2].min() > 0.95 and right[2] > np.mean([(r["score"] > 0) == bits[r["row"], 2] for r in alone])
    one = M.classifier_chains(df, df.limit(5), "row", "labels", "num", chains=1).collect()
    assert {r["score"] for r in one} <= {0.0, 1.0}
