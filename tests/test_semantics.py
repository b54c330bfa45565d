"""Small hand-made frames against brute force, one test per rule that is easy to get wrong."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import text as T
from declara.functions import vectors as V
from declara.operators import aggregations as A
from declara.operators import clusters as C
from declara.operators import encode as E
from declara.operators import evaluate as EV
from declara.operators import features as X
from declara.operators import forms as FM
from declara.operators import joins as J
from declara.operators import labels as L
from declara.operators import predictions as P
from declara.operators import projections as PR
from declara.operators import quantiles as Q
from declara.runtime import skew_safe_lookup, with_global_cumsum, with_global_rank


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_clean_text_keeps_the_quirks(spark):
    # Elided articles leave even inside words, accented mojibake letters are padded like marks.
    assert one(spark, "aujourd'hui", T.clean_text) == "aujourhui"
    assert one(spark, "a,b", T.clean_text) == "a  ,  b"
    assert one(spark, "a^b", T.clean_text) == "a ^ b"
    assert one(spark, "naïf", T.clean_text) == "na ï f"
    assert one(spark, "l\x92os\n\x9cil", T.clean_text) == "os oeil"


def test_preprocess_text(spark):
    assert one(spark, None, T.preprocess_text) == ""
    assert one(spark, "  Cest LAUTOMATE n° 12/3 ", T.preprocess_text) == "c'est automate n ° "
    assert one(spark, "man\x9cuvre", T.fix_misspellings) == "manoeuvre"
    assert one(spark, "l\x9cil", T.fix_misspellings) == "oeil"


def test_misspellings_are_replaced_inside_words(spark):
    assert one(spark, "hypoglycemies", T.fix_misspellings) == "hypoglycémies"


def test_normalise_spacing(spark):
    assert one(spark, "3cm\r\na/b 12", T.normalise_spacing) == "3 cm a/ b 12"


def test_tokens(spark):
    assert one(spark, "Le patient n'a PAS 12 sondes3x à l'hôpital", T.tokens) == ["patient", "sondes", "hopital"]


def test_bag_counts_like_a_counter(spark):
    rng = random.Random(3)
    words = [[rng.choice("abcde") for _ in range(n)] for n in (0, 1, 2, 30)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    got = {r["i"]: {x["term"]: x["tf"] for x in r["b"]} for r in df.select("i", T.bag(F.col("w")).alias("b")).collect()}
    assert got == {i: dict(Counter(w)) for i, w in enumerate(words)}


def test_death_rules_differ(spark):
    assert one(spark, "amortisseur", T.mentions_death) == 1  # a stem inside a word counts
    assert one(spark, None, T.mentions_death) == 0
    assert one(spark, "patient décédé", T.mentions_death) == 1
    words = lambda x: T.mentions_death_word(F.split(T.fold(x), " "))
    assert one(spark, "amortisseur", words) == 0 and one(spark, "Décès", words) == 1


def test_clean_manufacturer(spark):
    assert one(spark, "Société X-Ray France SAS (3M)", T.clean_manufacturer) == "societe ray"


def test_phrases_merge_left_to_right(spark):
    docs = spark.createDataFrame([(0, ["a", "b", "a", "b", "c"]), (1, ["b", "c", "d"]), (2, []), (3, ["a"])], "i int, w array<string>")
    table = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("b", "c", 2), ("c", "d", 1)], "a string, b string, n_ab long")
    got = {r["i"]: r["words"] for r in X.apply_phrases(docs, "i", F.col("w"), table).collect()}
    assert got == {0: ["a_b", "a_b", "c"], 1: ["b_c", "d"], 2: [], 3: ["a"]}


def test_word_and_character_grams(spark):
    assert one(spark, "a b c", lambda x: X.word_grams(F.split(x, " "), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "ab", lambda x: X.character_grams(x, 2, 3, in_words=True)) == [" a", "ab", "b ", " ab", "ab "]
    assert one(spark, "abc", lambda x: X.character_grams(x, 2, 2)) == ["ab", "bc"]


def test_padding(spark):
    ids = lambda x: F.transform(F.split(x, ""), lambda c: c.cast("int"))
    assert one(spark, "123", lambda x: T.pad_left(ids(x), 5)) == [0, 0, 1, 2, 3]
    assert one(spark, "123", lambda x: T.pad_left(ids(x), 2)) == [2, 3]
    assert one(spark, "123", lambda x: T.pad_right(ids(x), 5)) == [1, 2, 3, 0, 0]
    assert one(spark, "123", lambda x: T.head_tail(F.split(x, ""), 2)) == ["1", "3"]


# -- quantiles, ranks, skew -------------------------------------------------------------------


def test_quantile_brackets_shrink(spark, monkeypatch):
    """Skewed values, ties and infinities, with brackets of at most 12 rows and cuts into 4 parts."""
    monkeypatch.setattr(Q, "SMALL", 12)
    monkeypatch.setattr(Q, "PARTS", 4)
    draw = np.random.default_rng(7)
    groups = {
        "skew": np.exp(draw.normal(size=400) * 6), "ties": draw.integers(0, 3, 300).astype(float), "one": np.array([5.0]), "same": np.full(200, -1.5),
        "ends": np.concatenate([draw.normal(size=150), [np.inf, -np.inf, 1e300, -1e300, 5e-324]]), "two": np.array([0.0] * 100 + [1e9] * 100),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)]
    qs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {(r["g"], r["q"]): r["quantile"] for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", qs).collect()}
    assert len(got) == len(groups) * len(qs)
    for g, vs in groups.items():
        ordered = np.sort(vs)
        for q in qs:
            position = q * (len(vs) - 1)
            low, high = ordered[int(np.floor(position))], ordered[int(np.ceil(position))]
            want = low if low == high else low + (high - low) * (position - np.floor(position))
            assert got[g, q] == want or np.isclose(got[g, q], want, rtol=1e-12), (g, q)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    values = {"ties": np.repeat([1.0, 2.0, 5.0], 9000), "wide": rng.normal(size=25_000), "two": np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    qs = [0.0, 0.25, 0.45, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["q"]): r["quantile"] for r in Q.exact_quantiles(df, ["g"], "v", qs).collect()}
    for g, vs in values.items():
        for q in qs:
            assert abs(got[g, q] - np.quantile(vs, q)) < 1e-12, (g, q)


def test_global_rank_and_cumsum(spark):
    values = [random.Random(i).randrange(1000) for i in range(5000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(8)
    ranked = {r["i"]: r["rank"] for r in with_global_rank(df, [F.col("v").desc(), F.col("i")]).collect()}
    order = sorted(range(5000), key=lambda i: (-values[i], i))
    assert ranked == {i: n for n, i in enumerate(order, 1)}
    run = {r["i"]: r["s"] for r in with_global_cumsum(df, [F.col("v").desc(), F.col("i")], {"s": F.col("v")}).collect()}
    total = 0
    for i in order:
        total += values[i]
        assert run[i] == total


def test_skew_safe_lookup_with_a_hot_key(spark):
    keys = ["hot"] * 4000 + [f"k{i % 50}" for i in range(300)] + ["unknown"] * 10
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    counts = Counter(k for k in keys if k != "unknown")
    lookup = spark.createDataFrame([(k, n, k.upper()) for k, n in counts.items()], "k string, n long, up string")
    got = skew_safe_lookup(left, lookup, ["k"], "n", F.col("i")).collect()
    assert len(got) == 4300 and all(r["up"] == r["k"].upper() for r in got)
    outer = skew_safe_lookup(left, lookup, ["k"], "n", F.col("i"), inner=False)
    assert outer.count() == 4310 and outer.where(F.col("up").isNull()).count() == 10


def test_hot_group_of_copies_keeps_one_row(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"t{i}", f"E{i % 4}") for i in range(900)]
    df = spark.createDataFrame(rows, "i int, text string, tef string")
    got = {r["text"]: (r["i"], r["tef"]) for r in A.multilabel_table(df, "text", "i", ["tef"]).collect()}
    assert len(got) == 601 and got["copy"] == (0, ["E0", "E1", "E2", "E3"])


# -- tables and rules ------------------------------------------------------------------------------


def test_family_id(spark):
    for raw, want in (("12.0", 12), ("7", 7), ("nan", -1), (None, -1), ("1.5", -1)):
        assert one(spark, raw, PR.family_id) == want


def test_drop_labels_keeps_missing(spark):
    df = spark.createDataFrame([("NMV",), (None,), ("ok",)], "l string")
    assert {r["l"] for r in PR.drop_labels(df, "l").collect()} == {None, "ok"}


def test_anonymise_ignores_case(spark):
    df = spark.createDataFrame([("NOM", "x"), ("Date de\nsurvenue", "y"), ("Question", "z")], "k string, v string")
    assert [r["v"] for r in PR.anonymise(df, "k").collect()] == ["z"]
    assert len(K.PERSONAL_QUESTIONS) == 31


def test_last_answer_wins_and_none_is_missing(spark):
    rows = [("f", 1, "q", "old"), ("f", 2, "q", "new\nline"), ("f", 3, "r", "None"), ("f", 4, "s", None)]
    df = spark.createDataFrame(rows, "file string, seq int, key string, value string")
    got = [(r["key"], r["value"]) for r in FM.last_answers(df).collect()]
    assert got == [("q", "new line")]


def test_field_mapping_order(spark):
    answers = spark.createDataFrame([("f", "b", "two"), ("f", "a", " one "), ("g", "c", "  ")], "file string, key string, value string")
    mapping = spark.createDataFrame([("T", 0, "a"), ("T", 1, "b"), ("T", 2, "c")], "target string, ord int, source string")
    got = {r["file"]: r["value"] for r in FM.map_fields(answers, mapping).collect()}
    assert got == {"f": "one two", "g": None}


def test_xml_cells_odd_and_empty(spark):
    def doc(cells):
        return (
            '<ClinicalDocument><id extension="R9"/><title>Déclaration (PS)</title><component><structuredBody><component><section><text>'
            f"<table><tbody><tr>{cells}</tr></tbody></table></text></section></component></structuredBody></component></ClinicalDocument>"
        )

    df = spark.createDataFrame([
        ("a", doc("<td>k1</td><td>v1</td><td>k2</td><td>v2</td><td>odd</td>")), ("b", doc("<td>k1</td><td></td><td>k2</td><td>v2</td>"))
    ], "f string, x string")
    parsed = FM.parse_cda(df, "f", F.col("x"))
    got = sorted((r["file"], r["key"], r["value"]) for r in FM.cda_rows(parsed).collect() if r["value"])
    assert got == [("a", "k1", "v1"), ("a", "k2", "v2"), ("b", "k2", "v2")]
    assert {r["declaration"] for r in parsed.collect()} == {"r9"}
    assert one(spark, "Déclaration (PS)", PR.declarant_from_title) == K.PROFESSIONAL


def test_label_name_fallbacks(spark):
    df = spark.createDataFrame([(1,), (2,), (0,), (9,)], "c int")
    reference = spark.createDataFrame([(1, "one", True), (2, "two", False)], "id int, name string, ok boolean")
    named = J.label_name(df, "c", reference, "id", "name", "TDY_ID", F.col("c") == 0, "ok")
    assert {r["c"]: r["class_name"] for r in named.collect()} == {1: "one", 2: "INACTIF", 0: "", 9: "Libelle inconnu; TDY_ID = 9"}


def test_closest_manufacturer_against_all_pairs(spark):
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 7)))
    names, known = sorted({make() for _ in range(40)}), sorted({make() for _ in range(30)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def ratio(a, b):
        return 1 - distance(a, b) / max(len(a), len(b))

    n = spark.createDataFrame([(x,) for x in names], "n string")
    k = spark.createDataFrame([(x,) for x in known], "k string")
    for block in (20_000, 7):
        got = {r["name"]: (r["known"], r["ratio"]) for r in J.closest_manufacturer(n, "n", k, "k", block).collect()}
        for a in names:
            best = max(ratio(a, b) for b in known)
            want = min(b for b in known if abs(ratio(a, b) - best) < 1e-12)
            assert got[a][0] == want and abs(got[a][1] - best) < 1e-12


def test_names_of_all_lengths_against_all_pairs(spark, monkeypatch):
    from declara.operators import names as N

    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdé -") for _ in range(n))
    known = {make(rng.randrange(1, 60)) for _ in range(150)} | {"zz", ""}
    names = {make(rng.randrange(0, 70)) for _ in range(60)} | {"zz", "qqq", "q", ""}
    names |= {k[:-2] + "x" for k in list(known)[:30]}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert all(N.edit_distance(a, b) == distance(a, b) for a in list(names)[:25] for b in list(known)[:40])
    index = N.Index(list(known))
    for a in names:
        assert all(low <= distance(a, b) for low, b in zip(index.least_distances(a), index.known))
    monkeypatch.setattr(N, "SLICE", 11)
    n, k = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in known], "k string")
    got = {r["name"]: (r["known"], r["ratio"]) for r in J.closest_manufacturer(n, "n", k, "k", 13).collect()}
    for a in names:
        want = min((-(1 - distance(a, b) / max(len(a), len(b), 1)), b) for b in known)
        assert got[a] == (want[1], -want[0]), a
    few = spark.createDataFrame([("a",)], "n string")
    assert J.closest_manufacturer(few, "n", k.limit(0), "k").count() == 0


def test_candidates_are_few():
    """The index leaves a small part of the known names to compare."""
    from declara.operators import names as N

    rng = random.Random(3)
    index = N.Index(sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(2000)}))
    compared = []
    real, N.edit_distance = N.edit_distance, lambda a, b: compared.append(1) or real(a, b)
    try:
        for k in index.known[::40]:
            assert index.closest(k[:5] + "-" + k[6:])[1] == k
    finally:
        N.edit_distance = real
    assert len(compared) < 2 * 50


def test_oversampling_gives_n_plus_one_copies(spark):
    df = spark.createDataFrame([("rare", i) for i in range(2)] + [("common", i) for i in range(9)], "l string, i int")
    got = Counter(r["l"] for r in A.oversample_rare(df, "l", 3).collect())
    assert got == {"rare": 8, "common": 9}


def test_codes_extend_and_unknown(spark):
    old = E.label_codes(spark.createDataFrame([("b",), ("d",)], "v string"), "v")
    codes = E.extend_codes(old, spark.createDataFrame([("a",), ("b",), ("c",)], "v string"), "v")
    assert {r["value"]: r["code"] for r in codes.collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}
    unseen = E.encode(spark.createDataFrame([("zz",)], "v string"), "v", codes, "code")
    assert unseen.first()["code"] == -1


def test_micro_and_macro_scores(spark):
    rows = [("d1", "e1", 0)] * 3 + [("d1", "e1", 1)] + [("d2", "e2", 0)] * 2 + [("d3", "e1", 1)]
    df = spark.createDataFrame([(d, e, "c", "t", "f", k) for d, e, k in rows], "dco string, tef string, cdy string, tdy string, fab string, k int")
    parts = {p: p for p in ("dco", "tef", "cdy", "tdy", "fab")}
    micro = A.micro_clusters(df, "k", parts)
    macro = A.macro_clusters(df, "k", micro)
    score = A.micro_macro_score(micro, macro).first()
    assert abs(score["micro_score"] - (4 * 0.75 + 2 + 1) / 7) < 1e-12
    zero = 0.5 / 2 + 0.3 * (1 / 2 + 1 + 1) / 3 + 0.2
    assert abs(score["macro_score"] - (5 * zero + 2 * 1.0) / 7) < 1e-12


def test_virology_and_death_rules(spark):
    rows = [("f", "DCO", 1, "1", "Virologie : x", .9), ("f", "consequence", 1, "C1", "Faux negatif", .8),
            ("f", "gravité_binaire", 1, "NON CRITIQUE", "NON CRITIQUE", .7), ("g", "gravité_binaire", 1, "NON CRITIQUE", "NON CRITIQUE", .6)]
    ranked = spark.createDataFrame(rows, "file string, model string, rank long, class string, class_name string, proba double")
    out = {(r["file"], r["model"]): r["class"] for r in P.virology_override(ranked).collect()}
    assert out["f", "gravité_binaire"] == "CRITI" and out["g", "gravité_binaire"] == "NON CRITIQUE"


def test_result_row_skips_defaults_by_vigilance(spark):
    rows = [(f, "consequence", r, c, c, p) for f in ("m", "r") for r, c, p in ((1, "C0", .75), (2, "C5", .25))]
    ranked = spark.createDataFrame(rows, "file string, model string, rank long, class string, class_name string, proba double")
    files = spark.createDataFrame([("m", "matériovigilance"), ("r", "Réactovigilance")], "file string, vigilance string")
    out = P.result_rows(ranked, files, {"consequence": P.RESULT_MODELS["consequence"]})
    assert {r["file"]: r["consequence"] for r in out.collect()} == {"m": "C0  (0.75)", "r": "C5  (0.25)"}


# -- clusters ----------------------------------------------------------------------------------------


def _mixed_frame(spark, n=400, d=3, seed=0):
    rng = np.random.default_rng(seed)
    num, cat = rng.normal(size=(n, d)), rng.integers(0, 4, size=(n, 2))
    rows = [(i, int(cat[i, 0]), num[i].tolist(), cat[i].tolist()) for i in range(n)]
    return num, cat, spark.createDataFrame(rows, "i long, fam int, num array<double>, cat array<bigint>").repartition(6)


def test_distances_in_blocks(spark, monkeypatch):
    num, cat, df = _mixed_frame(spark)
    centres = [(j, num[j].tolist(), cat[j].tolist()) for j in range(5)]
    model = spark.createDataFrame(centres, "cluster int, num array<double>, cat array<bigint>")
    want = np.array([[((x - num[j]) ** 2).sum() + 0.5 * (c != cat[j]).sum() for j in range(5)] for x, c in zip(num, cat)])
    for block in (8_000_000, 10):
        monkeypatch.setattr(C.assignment, "MODEL_BLOCK_VALUES", block)
        got = df.select("i", C.distances(F.col("num"), F.col("cat"), model, 0.5).alias("d"),
                        C.nearest(F.col("num"), F.col("cat"), model, 0.5)["cluster"].alias("c")).collect()
        for r in got:
            assert np.allclose(r["d"], want[r["i"]]) and r["c"] == want[r["i"]].argmin()
    assert all(r["d"][r["i"]] == 0.0 for r in got if r["i"] < 5)  # a document on a centroid


def test_soft_weights_zero_distance_and_overflow(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0],), ([1e-60, 2e-60, 1.0],)], "d array<double>")
    a, b = [r["w"] for r in df.select(V.soft_weights(F.col("d"), 1.25).alias("w")).collect()]
    assert a == [0.5, 0.0, 0.5]
    assert abs(sum(b) - 1) < 1e-12 and abs(b[0] / b[1] - 2.0 ** 8) < 1e-6


def test_k_prototypes_reaches_a_fixed_point(spark):
    num, cat, df = _mixed_frame(spark, 200)
    model = C.k_prototypes(df, "i", "fam", 4, max_iter=50).orderBy("cluster").collect()
    m, k = np.array([r["num"] for r in model]), np.array([r["cat"] for r in model])
    d = ((num[:, None] - m[None]) ** 2).sum(2) + (cat[:, None] != k[None]).sum(2)
    label = d.argmin(1)
    for j in range(4):
        mine = label == j
        assert np.allclose(num[mine].mean(0), m[j])
        for a in range(2):
            count = Counter(cat[mine, a].tolist())
            assert k[j, a] == min(c for c in count if count[c] == max(count.values()))


def test_incremental_update(spark):
    num, cat, df = _mixed_frame(spark, 60)
    old, new = df.where("i < 40"), df.where("i >= 40")
    model = C.centroid_table(old, "fam", "num", "cat")
    assigned, centroids, _ = C.incremental_update(new, "i", "num", "cat", model, C.statistics_of(old, "fam", "num", "cat"), 0.4)
    rows = assigned.collect()
    assert {r["i"] for r in rows} == set(range(40, 60)) and any(r["is_new"] for r in rows) and not all(r["is_new"] for r in rows)
    members = {i: int(cat[i, 0]) for i in range(40)} | {r["i"]: r["cluster"] for r in rows}
    for c in centroids.collect():
        mine = [i for i, k in members.items() if k == c["cluster"]]
        assert c["n"] == len(mine) and np.allclose(c["num"], num[mine].mean(0))
    assert all(r["cluster"] >= 4 for r in rows if r["is_new"])


def test_auc_and_average_precision(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(20) / 20, rng.randrange(2)) for _ in range(500)]
    got = EV.auc_ap(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, seen, last = 0.0, 0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(p == s for p in pos)
        seen += sum(x == s for x, _ in rows)
        ap += (tp - last) / len(pos) * tp / seen
        last = tp
    assert abs(got["auc"] - auc) < 1e-12 and abs(got["average_precision"] - ap) < 1e-12


def test_splits_hold(spark):
    df = spark.createDataFrame([(i, f"t{i % 300}", "ab"[i % 2]) for i in range(1200)], "i long, t string, s string")
    sides = E.split_by_text(df, "t").groupBy("t").agg(F.count_distinct("is_test").alias("n"))
    assert sides.where("n > 1").count() == 0
    test = E.stratified_split(df, ["s"], "i").groupBy("s").agg(F.count_if("is_test").alias("n")).collect()
    assert [r["n"] for r in test] == [120, 120]
    again = E.balanced_sample(df, "s", "i").count()
    assert again == E.balanced_sample(df.repartition(5), "s", "i").count()


def test_projection_codes(spark):
    rows = [(l, f, float(l * 3 + f)) for l in range(6) for f in range(4)]
    df = spark.createDataFrame(rows, "label long, feat int, v double")
    a = {(r["label"], r["d"]): r["z"] for r in L.project(df, 3, 1).collect()}
    b = {(r["label"], r["d"]): r["z"] for r in L.project(df.repartition(5), 3, 1).collect()}
    assert a == b and len(a) == 18
    signs = {round((a[1, d] - a[0, d]) / 3) for d in range(3)}
    assert signs <= {-4, -2, 0, 2, 4}


def test_cluster_numbers_with_gaps_and_missing_vectors(spark):
    from declara.operators import clusters as C

    model = spark.createDataFrame([(1, [0.0, 0.0], [1]), (4, [5.0, 5.0], [1]), (9, [9.0, 0.0], [1])], "cluster int, num array<double>, cat array<long>")
    rows = spark.createDataFrame([(0, [5.0, 4.0], [1]), (1, None, [1]), (2, [9.0, 1.0], [1]), (3, [0.1, 0.0], [1])], "i int, num array<double>, cat array<long>")
    found = {r.i: r.n for r in rows.select("i", C.nearest(F.col("num"), F.col("cat"), model).alias("n")).collect()}
    assert (found[0].cluster, found[1], found[2].cluster, found[3].cluster) == (4, None, 9, 1)


def test_assigned_numbers_with_gaps(spark, monkeypatch):
    from declara.operators import clusters as C

    monkeypatch.setattr(C.assignment, "MODEL_BLOCK_VALUES", 3)  # a block per cluster
    model = spark.createDataFrame([(1, [0.0, 0.0], [1]), (4, [5.0, 5.0], [1]), (9, [9.0, 0.0], [1])], "cluster int, num array<double>, cat array<long>")
    rows = spark.createDataFrame([(0, [5.0, 4.0], [1]), (1, None, [1]), (2, [9.0, 1.0], [1]), (3, [0.0, 0.0], [1])], "i int, num array<double>, cat array<long>")
    found = {r.i: r for r in C.assign(rows, model, F.col("num"), F.col("cat")).collect()}
    assert [found[i].hard_cluster for i in range(4)] == [found[i].soft_cluster for i in range(4)] == [4, None, 9, 1]
    assert found[3].cluster_weight == 1.0 and found[1].cluster_weight is None
    ready = C.prepared(model)
    both = rows.select("i", C.numbered(C.distances(F.col("num"), F.col("cat"), ready), ready).alias("d"), C.memberships(F.col("num"), F.col("cat"), ready, k=2).alias("m"))
    got = {r.i: r for r in both.collect()}
    assert [x.cluster for x in got[0].d] == [1, 4, 9] and got[0].d[1].d == 1.0 and [x.cluster for x in got[2].m] == [9, 4] and got[1].m is None


def test_memberships_and_pruning_equal_full_tables(monkeypatch):
    """Pieces, running sums and skipped pieces against the whole matrix of distances."""
    from declara.operators import assignment as A

    draw = np.random.default_rng(3)
    spots = draw.normal(size=(12, 5)) * 40
    centres = np.concatenate([s + draw.normal(size=(20, 5)) for s in spots])
    codes, numbers = draw.integers(0, 3, (240, 2)), np.arange(240, dtype=np.int32) * 3 + 1
    x, mine = np.concatenate([centres[:30], draw.normal(size=(300, 5)) * 40]), draw.integers(0, 3, (330, 2))
    mine[:15] = codes[:15]
    whole = A.Piece(centres, codes, numbers, np.arange(240), centres.mean(axis=0), 1e9)
    full = A.mixed(x, mine, whole, 0.7)
    monkeypatch.setattr(A, "PIECE", 16)
    pieces = A.cut(centres, codes, numbers)
    assert len(pieces) >= 15 and sorted(np.concatenate([p.places for p in pieces])) == list(range(240))
    calls, real = [], A.mixed
    monkeypatch.setattr(A, "mixed", lambda a, *rest: calls.append(len(a)) or real(a, *rest))
    d, who = A.best(x, mine, pieces, 0.7)
    assert np.allclose(d, full.min(axis=1)) and (who == numbers[full.argmin(axis=1)]).all() and sum(calls) < 330 * len(pieces)
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.where((full == 0).any(axis=1, keepdims=True), (full == 0).astype(float), full ** -8.0)
    weights = inverse / inverse.sum(axis=1, keepdims=True)
    top, w = A.members(x, mine, pieces, 0.7, 1.25, 7)
    order = np.lexsort((np.broadcast_to(numbers, full.shape), full), axis=-1)[:, :7]
    assert (top == numbers[order]).all() and np.allclose(w, np.take_along_axis(weights, order, axis=1), rtol=1e-9)


def test_incremental_update_opens_clusters_in_leader_rounds(spark):
    """Far-apart documents of one combination get clusters of their own; the same rounds in plain Python."""
    from declara.operators import clusters as C

    draw = np.random.default_rng(11)
    spots = [(60.0, 0.0), (60.0, 40.0), (-50.0, 30.0), (90.0, -70.0)]
    old = [(i, draw.normal(size=2).tolist(), [i % 2]) for i in range(20)]
    new = [(100 + i, (np.array(spots[i % 4]) + draw.normal(size=2) * 0.1).tolist(), [1]) for i in range(24)] + [(130, [0.0, 0.1], [0]), (131, [300.0, 300.0], [0])]
    schema = "row long, num array<double>, cat array<long>"
    olds, news = spark.createDataFrame(old, schema).withColumn("fam", F.col("row") % 2), spark.createDataFrame(new, schema).repartition(4)
    model = C.centroid_table(olds, "fam", "num", "cat")
    assigned, centroids, _ = C.incremental_update(news, "row", "num", "cat", model, C.statistics_of(olds, "fam", "num", "cat"), 0.97)
    got = {r["row"]: r["cluster"] for r in assigned.collect()}

    clusters = [(r["cluster"], r["num"], r["cat"]) for r in model.collect()]

    def weight(num, cat):
        d = [((np.array(num) - c) ** 2).sum() + (cat != k) for _, c, k in clusters]
        w = np.array([float(v == 0) for v in d]) if min(d) == 0 else 1 / np.array(d) ** 2
        at = int(w.argmax())
        return w[at] / w.sum(), clusters[at][0]

    want, left, several = {}, sorted(new), 1
    while left:
        scored = [(r, *weight(r[1], r[2])) for r in left]
        want |= {r[0]: c for r, w, c in scored if w > 0.97}
        left = [r for r, w, _ in scored if w <= 0.97]
        ranks, candidates = {}, []
        for r in left:
            ranks[tuple(r[2])] = ranks.get(tuple(r[2]), 0) + 1
            if ranks[tuple(r[2])] <= several:
                candidates.append((ranks[tuple(r[2])], r[2], r[0], r))
        for *_, r in sorted(candidates):
            if weight(r[1], r[2])[0] <= 0.97:
                clusters.append((clusters[-1][0] + 1 if len(clusters) > 2 else 2, r[1], r[2]))
        several *= 2
    assert got == want and len({got[100 + i] for i in range(24)}) >= 4
    sizes = {r["cluster"]: r["n"] for r in centroids.collect()}
    for c in set(want.values()):
        assert sizes[c] == list(want.values()).count(c) + (10 if c < 2 else 0)


def test_zero_vectors_do_not_divide(spark):
    from declara.functions import vectors as V

    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = row.select(V.unit(F.col("a")).alias("u"), V.to_shares(F.col("a")).alias("s"), V.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert got.u == [0.0, 0.0] and got.s == [0.0, 0.0] and got.c is None


def test_accents_of_all_latin_letters(spark):
    from declara.functions import text as X

    words = spark.createDataFrame([("œdème cœur žluť Kovář Łódź été",)], "t string")
    assert words.select(X.deaccent(F.col("t"))).first()[0] == "oedeme coeur zlut Kovar Lodz ete"


def test_streams_read_folders(spark, tmp_path):
    from declara.plans import catalogue
    from declara.plans.registry import QUERIES, Tables

    catalogue.load()
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    seen = QUERIES["st_skip_seen"](Tables(spark, str(tmp_path)))
    assert seen.agg(F.sum("ids")).first()[0] == source.select("event_id").distinct().count()


def test_served_rows_of_a_hot_key_are_spread(spark):
    from declara.runtime import skew_safe_lookup

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(40_000).withColumn("k", F.when(F.col("id") % 10 < 9, F.lit(-1)).otherwise(F.col("id")))
        lookup = left.groupBy("k").agg(F.count("*").alias("n"))
        out = skew_safe_lookup(left, lookup, ["k"], "n", F.xxhash64("id"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "_salt" in plan.split("hashpartitioning(k", 1)[1].split(")")[0]
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / len(sizes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_class_weight_steps(spark):
    from declara.operators import aggregations as A

    sizes = {"a": 9, "b": 10, "c": 99, "d": 100, "e": 1000}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "label string")
    steps = {r.label: r.weight for r in A.class_weight(df, "label", "steps").collect()}
    assert steps == {"a": 10.0, "b": 5.0, "c": 5.0, "d": 1.0, "e": 0.1}


def test_package_is_sent_once(spark):
    from declara.runtime import ship_package

    ship_package(spark)
    ship_package(spark)
    assert len([f for f in spark.sparkContext.listFiles if f.endswith("declara.zip")]) == 1


def test_weekly_counts_keep_late_events(spark, tmp_path):
    """Files in no order, one per trigger, a year late: every event counts once, also after a second run."""
    from datetime import datetime, timedelta

    from declara.streaming import jobs as ST

    draw = random.Random(12)
    start = datetime(2024, 1, 4)
    events = [(i, start + timedelta(days=draw.randrange(400), seconds=draw.randrange(86400)), draw.choice("ab")) for i in range(600)]
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("inbox", "sink", "checkpoint"))
    schema = "id long, ts timestamp, kind string"
    for part in range(6):
        if part == 4:
            _run_weeks(spark, ST, inbox, sink, checkpoint, schema)
        spark.createDataFrame(events[part * 100 : part * 100 + 100], schema).coalesce(2).write.mode("append").parquet(inbox)
    _run_weeks(spark, ST, inbox, sink, checkpoint, schema)
    _run_weeks(spark, ST, inbox, sink, checkpoint, schema)
    want = Counter((int(ts.timestamp()) // 604800, kind) for _, ts, kind in spark.createDataFrame(events, schema).select("id", "ts", "kind").collect())
    got = {(int(r["s"]) // 604800, r["kind"]): r["n"] for r in ST.weekly_counts(spark, sink, "kind").select(F.unix_timestamp("week").alias("s"), "kind", "n").collect()}
    assert got == want and sum(got.values()) == 600


def _run_weeks(spark, ST, inbox, sink, checkpoint, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    ST.count_weeks(stream, "kind", "ts", sink, checkpoint).awaitTermination()


def test_silhouette_from_statistics(spark, monkeypatch):
    from declara.operators import clusters as C

    monkeypatch.setattr(C.assignment, "PIECE", 2)
    draw = np.random.default_rng(4)
    x, label = draw.normal(size=(60, 3)), np.append(draw.integers(0, 4, 59) * 3, 50)  # numbers with gaps, one document alone
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(label, x)], "c int, num array<double>")
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    want = []
    for i, c in enumerate(label):
        mine = label == c
        if mine.sum() == 1:
            want.append(0.0)
            continue
        a, b = d[i, mine].sum() / (mine.sum() - 1), min(d[i, label == o].mean() for o in set(label) - {c})
        want.append((b - a) / max(a, b))
    assert abs(C.simplified_silhouette(df, "c", "num").first()[0] - np.mean(want)) < 1e-9
    assert C.simplified_silhouette(df.where("c = 3"), "c", "num").first()[0] == 0.0
