"""Source divergence against plain counting with Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from declara.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    seen, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, words in rows:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in seen[lang].items() if n >= 3]
        sources = sorted({s for la, s, _ in rows if la == lang}, key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(whole)
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, no int, term string")
    return sorted(tuple(r) for r in sd.divergence(frame, **options).collect())


def corpus(n=300):
    draw = random.Random(3)
    words = ["le", "Été", "naïve", "a", "b", "cat", "dog", "日本", "x1y", "don't", "ZEBRA", "zebra", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(n):
        lang = draw.choice(["en", "fr", None])
        source = "hot" if draw.random() < 0.4 else draw.choice([None, "", *(f"s{j}" for j in range(40))])
        rows.append((lang, source, " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.randrange(30)))))
    return rows


@pytest.mark.parametrize("cells", [None, 7])  # the second deals the index into many slices
def test_equals_plain_counting(spark, monkeypatch, cells):
    if cells:
        monkeypatch.setattr(sd, "CELLS", cells)
        monkeypatch.setattr(sd, "DENSE", 0)
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_ranks_stop_at_the_top(spark):
    rows = corpus(120)
    assert run(spark, rows, top_terms=3) == plain(rows, top=3)


def test_odd_rows(spark):
    rows = [
        ("en", "a", None), ("en", "b", ""), ("en", "c", "..."), (None, None, None), ("de", "one", "wort wort"), ("de", "one", "wort"), ("de", "one", "wort"),
        ("it", "a", "ciao"), ("it", "b", "CIAO ciao"), ("it", "b", "CIAO ciao"), ("it", "c", "y" * 200000), ("it", "a", "ciao " * 50000),
    ]
    found = run(spark, rows)
    assert found == plain(rows)
    assert {r[4] for r in found if r[0] == "en"} == {0} and not [r for r in found if r[0] in ("", "de") and r[2] == "pair"]


def test_no_documents(spark):
    assert run(spark, []) == []


def test_large_counts_divide_exactly(spark):
    row = spark.createDataFrame([(10**16 + 7, 3 * 10**16 + 11, 5)], "n long, t long, v long")
    p = row.select(sd.share(row.n, row.t, row.v)).first()[0]
    assert p == 1 + 10**9 * (10**16 + 8) // (3 * 10**16 + 16)
    big = spark.createDataFrame([(10**9, 3)], "p long, q long")
    assert big.select(sd.excess(big.p, big.q)).first()[0] == (10**9 - 3) ** 2 // 3
