"""Language identification recomputed trigram by trigram."""

import math
from collections import Counter

import numpy as np
import pytest

from declara.llm import language_id as li

MASK = (1 << 64) - 1
TEXTS = {
    "en": ["The house by the river, and the old mill.", "What is the weather like in the morning?"],
    "fr": ["La maison près de la rivière et le vieux moulin.", "Quel temps fait-il le matin?"],
    "de": ["Das Haus am Fluss und die alte Mühle.", "Wie ist das Wetter am Morgen?"],
    "es": ["La casa junto al río y el viejo molino.", "¿Qué tiempo hace por la mañana?"],
}


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def buckets(text):
    """Letters in lower case, the first other character after a letter as a space, a space at either end."""
    kept, before = [" "], False
    for c in text.lower():
        if c.isalpha() or before:
            kept.append(c if c.isalpha() else " ")
        before = c.isalpha()
    kept.append(" ")
    if not any(c.isalpha() for c in text):
        return []
    codes = [ord(c) for c in kept]
    return [
        mix((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & MASK) % li.BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:])
    ]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, lang) for lang, texts in TEXTS.items() for t in texts] + [(None, "en"), ("", "fr"), ("no label", None), (TEXTS["en"][0], "en")]
    return rows, li.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))


def test_every_language_has_its_codeword():
    for n in (2, 3, 4, 6, 7, 20):
        code = li.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n and all(-n < s < n for s in code.sum(axis=0).tolist()) and set(code.ravel().tolist()) == {-1, 1}
        assert n > 6 or code.shape[1] == 2 ** (n - 1) - 1


def test_weights_and_margins_recomputed(model):
    rows, found = model
    counts = {lang: Counter() for lang in TEXTS}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(buckets(text))
    assert found.languages == sorted(TEXTS)
    share = {lang: (lambda b, c=c, total=sum(c.values()): (c[b] + 0.5) / (total + 0.5 * li.BUCKETS)) for lang, c in counts.items()}
    side = lambda bit, sign, b: np.mean([share[lang](b) for i, lang in enumerate(found.languages) if found.code[i, bit] == sign])
    used = sorted({b for c in counts.values() for b in c})[::7] + [next(b for b in range(li.BUCKETS) if not any(c[b] for c in counts.values()))]
    for bit in range(found.code.shape[1]):
        for b in used:
            assert found.weights[b, bit] == pytest.approx(math.log(side(bit, 1, b) / side(bit, -1, b)), abs=2e-5)
        differ = [1 - sum(math.sqrt(side(k, 1, b) * side(k, -1, b)) for b in range(0, li.BUCKETS)) for k in range(1)]
        assert bit or found.bit_weight[0] > 0 and differ[0] > 0
    assert found.bit_weight.sum() == pytest.approx(1)
    for text in ("the mill and the house", "le moulin et la maison", "x", "Mühle, Fluss!", "123 -- 9", "río y casa " * 50):
        at = buckets(text)
        if not at:
            assert found.decide(text, 0.55) == (li.UNKNOWN, 0.0, True)
            continue
        margin = [sum(float(found.weights[b, bit]) for b in at) / len(at) for bit in range(found.code.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-li.SHARPNESS * c * m)) for w, c, m in zip(found.bit_weight, row, margin)) for row in found.code.tolist()]
        best, second = sorted(range(4), key=lambda i: loss[i])[:2]
        lang, score, unsure = found.decide(text, 0.55)
        assert lang == found.languages[best] and score == pytest.approx(loss[second] / (loss[best] + loss[second]), rel=1e-6) and unsure == (score < 0.55)


def test_repeated_rows_and_ties_get_the_same_answer(spark, model):
    _, found = model
    rows = [(1, "the mill", "z"), (1, "the mill", "z"), (2, None, "z"), (3, "the mill", "z")]
    got = li.predict(spark.createDataFrame(rows, "id long, text string, lang_pred string"), found).collect()
    assert len(got) == 4 and len({(r.lang_pred, r.score) for r in got if r.id != 2}) == 1
    tied = li.Model(["a", "b"], np.array([[1], [1]]), np.zeros((li.BUCKETS, 1), np.float32), np.ones(1))
    assert tied.decide("any text", 0.55) == ("a", 0.5, True)
