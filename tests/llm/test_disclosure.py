"""Personal data: patterns against plain regular expressions, disclosure against plain counting."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from declara.llm import disclosure as dis

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


CASES = [
    "", "a@b.c", "x a.b+c@d-e.f.g. y@z q@@r.s a@b.c@d.e @a.b é@a.b éa@b.cé", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.02.3.255 1.2.3.4567", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (743) 555-3824, 5 +1 (743) 555-3824 +123 +1 2 ++33 1 23 45 67 89.", "4465758382889437 44657583828894370", "4 4 6 5-7583-8288-9437  1", "+1.2.3.4.5.6.7.8.9 +", "日本 a@b.jp 127.0.0.1",
    "1-2-3-4-5-6-7-8-9-0-1-2-3", "12 34  56", "0000.0.0.0 1..2.3.4 .1.2.3.4.",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_match_the_patterns(text):
    assert [s[:3] for s in dis.base_spans(text)] == plain_base(text)


def test_base_spans_match_on_random_texts():
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choices("0123456789" * 3 + "..--  ()++@@ab_%é\n", k=draw.randrange(60)))
        assert [s[:3] for s in dis.base_spans(text)] == plain_base(text), text


@pytest.mark.parametrize("piece", ["1", "1 ", "1.", "+", "+1", "a", "@", "a@", "a.", "a@b.", "1-", "+1 ", "é", "("])
def test_long_runs_take_linear_time(piece):
    start = time.time()
    dis.base_spans(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 10


def corpus():
    """Two people whose town and club stand beside their address, a public address, and clean texts."""
    draw = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "de", "mi", "so") for b in ("ran", "lot", "kus") for c in ("el", "in", "o", "ut")]
    line = lambda n: " ".join(draw.choices(words, k=n))
    rows = []
    for i in range(6):
        rows.append((i, f"{line(30)} Quendolin of Brackwater reach quendolin@mail.example.org or +44 20 7946 0000 {line(30)}"))
        rows.append((100 + i, f"{line(25)} badge 7731XQ holder ip 10.20.30.40 {line(25)}"))
    rows += [(200 + i, f"{line(20)} help@public.example.org {line(20)}") for i in range(150)]
    rows += [(400 + i, line(40)) for i in range(200)]
    rows += [(700 + i, f"{line(12)} brambles {line(5)} bramwell 9999ZZ") for i in range(60)]
    rows += [(900, None), (901, ""), (902, "Brackwater " + line(40)), (None, "the Quendolin case"), (0, rows[0][1]), (903, "y" * 1500 + " !" * 30000), (904, "brackwater " * 3)]
    return rows


def plain_terms(rows, left, least, texts):
    """item -> removed, by counting documents one after the other."""
    d, c, n, seen = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for _, text in rows:
        text = text or ""
        spans = plain_base(text)
        blank = list(text)
        for _, s, e in spans:
            blank[s:e] = " " * (e - s)
        words = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+", "".join(blank))]
        for item in {w for _, w in words} | {dis.general(w) for _, w in words}:
            d[item] += 1
        near = set()
        for kind, s, e in spans:
            value = text[s:e].lower() if kind == 0 else "".join(ch for ch in text[s:e] if ch.isdigit() or ch in ".+")
            left_words = [w for at, w in words if at < s][-dis.WINDOW :]
            right_words = [w for at, w in words if at >= e][: dis.WINDOW]
            near |= {((kind, value), w) for w in (*left_words, *right_words)} | {((kind, value), None)}
        for entity, w in list(near):
            if w and dis.general(w):
                near.add((entity, dis.general(w)))
        for entity, w in near:
            if w is None:
                n[entity] += 1
            else:
                c[entity, w] += 1
                seen[entity, w].add(text)
    tell = {
        (e, w) for (e, w), k in c.items()
        if len(seen[e, w]) >= texts and math.log2(d[w] / k) <= left and math.log2(len(rows) * k / d[w] / n[e]) >= least
    }
    out = {}
    for e, w in tell:
        if not w.startswith("~"):
            out[w] = out.get(w, False) or dis.general(w) is None or (e, dis.general(w)) in tell
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, text string, item string, df int")
    return rows, frame, dis.find(frame).cache()


def test_disclosing_terms_match_plain_counting(found):
    rows, _, spans = found
    terms = plain_terms(rows, 0.5, 3.0, 2)
    assert {"brackwater", "quendolin", "7731xq"} <= set(terms) and not {"help", "baranel"} & set(terms)
    got = sorted((r.id if r.id is not None else -1, tuple((s.kind, s.start, s.end) for s in r.added)) for r in spans.collect())
    want = []
    for i, text in rows:
        text = text or ""
        hidden = {p for _, s, e in plain_base(text) for p in range(s, e)}
        mine = [(5 if terms[w] else 4, m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)
                if (w := m.group().lower()) in terms and m.start() not in hidden]
        want.append((i if i is not None else -1, tuple(sorted(mine))))
    assert got == sorted(want)


def test_classes_in_use_elsewhere_generalise(found):
    _, _, spans = found
    by = {s.by for r in spans.collect() for s in r.added}
    assert "" in by  # a class of its own tells as much as its term


def test_thresholds_move_the_terms(spark, found):
    rows, frame, _ = found
    for left, least, texts in ((0.0, 3.0, 2), (1.0, 1.0, 1), (0.5, 3.0, 7)):
        terms = plain_terms(rows, left, least, texts)
        scanned = dis._first_scan(dis._texts(frame))
        assert {r["item"]: r["removed"] for r in dis.disclosing(scanned, left, least, texts).collect()} == terms


def test_sanitised_texts(spark, found):
    rows, frame, _ = found
    out = {r.id: r.text for r in dis.sanitise(frame).collect() if r.id != 0}
    assert "[EMAIL]" in out[1] and "[PHONE]" in out[1] and "quendolin" not in out[1].lower() and "brackwater" not in out[902].lower()
    clean = {i: t for i, t in rows if i is not None and 400 <= i < 600}
    assert {i: out[i] for i in clean} == clean


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dis.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    for r in got:
        (text,) = texts[r.doc_id]
        base = plain_base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        listed = ",".join(f"{dis.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
        assert len([x for x in r.spans.split(",") if x]) == len(base) + r.n_generalised + r.n_removed


def test_no_documents(spark):
    frame = spark.createDataFrame([], "id long, text string")
    assert dis.find(frame).count() == 0 and dis.sanitise(frame).count() == 0
