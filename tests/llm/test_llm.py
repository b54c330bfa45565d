"""The operators of declara.llm against brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from declara.llm import (
    components, fingerprints, html_extraction, language_id, license_scans, ngram_join, packing, quality_rules,
    sentencepiece_nbest, token_counts, url_filters,
)

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Nulls, empties, ties, repeated rows, a very long text and a column with a clashing name."""
    prose = "the cat sat on the mat and looked at the big red moon over the quiet house near a river " * 6
    other = "el gato se sienta en la alfombra y mira la luna grande sobre la casa tranquila cerca del rio " * 6
    return [
        (1, prose, "en", "a", 1, "x"), (2, prose, "en", "a", 1, "x"), (2, prose, "en", "a", 1, "x"), (3, None, None, None, None, None),
        (4, "", "es", "b", 0, None), (None, other, "es", "b", 1, "y"), (5, other + "fin", "es", "b", 1, "y"), (6, "x " * 30000, "en", "c", 1, ""),
        (7, " \t\n", None, "c", 3, ""), (8, "123 !!", "en", None, 6, ""),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


# quality rules


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    under = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(under)


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def xx(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def grams(text):
    h = [xx(w) for w in WORD.findall(text or "")]
    return [*h, *(xx(*h[i : i + 2]) for i in range(len(h)))]


def test_quality_matches_brute_force(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.id for r in quality_rules.trusted_ids(labels).collect()}
    rows = documents.collect()
    buckets = 1 << 14
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in rows:
        at = np.array([g % buckets for g in grams(r.text)], dtype=int)
        np.add.at(raw, at, 1)
        if r.doc_id in good:
            np.add.at(target, at, 1)
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    found = {r.doc_id: r for r in quality_rules.query(spark, FOLDER).collect()}
    assert len(found) == len(rows)
    for r in rows:
        got, want = found[r.doc_id], base(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        score = np.mean([weights[g % buckets] for g in grams(r.text)])
        assert got.score == pytest.approx(score, abs=1e-4)
        if abs(score + 0.07) > 1e-3:
            assert got.kept == (not got.base_failed and score >= -0.07)


def test_quality_odd_rows(spark, odd):
    trusted = frame(spark, [(1,), (1,), (None,)], "id long")
    rows = quality_rules.judge(odd, trusted).collect()
    assert len(rows) == 10 and all(r["__llm_quality"].base_failed for r in rows if not (r.text or "").strip())
    for r in rows:
        q = r["__llm_quality"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == base(r.text)
    none = quality_rules.judge(odd, trusted.limit(0)).collect()
    assert all(r["__llm_quality"].score is None and r["__llm_quality"].kept != r["__llm_quality"].base_failed for r in none)
    assert quality_rules.judge(odd.limit(0), trusted).count() == 0


def test_repeated_words_both_ways(spark):
    random.seed(3)
    rows = [(" ".join(random.choice("abc") for _ in range(n)),) for n in (0, 1, 2, 3, 7, 50, 400)]
    from pyspark.sql import functions as F

    df = frame(spark, rows, "text string").withColumn("w", quality_rules.words_of(F.col("text")))
    windows = F.expr("transform(sequence(1, greatest(size(w) - 2, 1)), i -> xxhash64(get(w, i - 1), get(w, i), get(w, i + 1)))")
    df = df.where("size(w) > 2").withColumn("h", windows)
    for r in df.select("text", quality_rules.repeated_words(F.col("h")).alias("a"), quality_rules.repeated_words(F.col("h"), True).alias("b")).collect():
        assert r.a == r.b == base(r.text)[4]


# language identification


def test_language_held_out(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.query(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    model = language_id.fit_documents(odd)
    found = language_id.predict(odd.select(F.col("doc_id").alias("id"), "text"), model).collect()
    assert [r.lang_pred for r in found if r.id in (3, 4, 7, 8)] == ["und"] * 4 and len(found) == 10
    empty = language_id.fit_documents(odd.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd.select(F.col("doc_id").alias("id"), "text"), empty).collect()} == {"und"}
    kept = language_id.keep_identified(spark, odd, FOLDER)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 2, None, 5, 6}


def test_codewords_differ():
    for n in (1, 2, 4, 6, 7, 40, 300):
        code = language_id.codewords(n)
        assert len(code) == n and (n == 1 or len(np.unique(code, axis=0)) == n)


# n-gram join


def brute_components(rows):
    sets, parent = {}, {}
    for i, (doc, text) in enumerate(rows):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for i in sets:
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in sets), key=str)


@pytest.mark.parametrize("tile", [ngram_join.TILE, 500])
def test_join_matches_brute_force(spark, monkeypatch, tile):
    """A large group of near copies, a shared passage, copies and odd rows; in one tile and in many."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    random.seed(7)
    words = [f"w{i}" for i in range(400)]
    first = [random.choice(words) for _ in range(120)]
    rows = [(1000 + i, " ".join(w if random.random() > i / 1500 else random.choice(words) for w in first)) for i in range(60)]
    passage = " ".join(random.choice(words) for _ in range(40))
    rows += [(2000 + i, passage + " " + " ".join(random.choice(words) for _ in range(10 + i))) for i in range(25)]
    rows += [(r[0], r[1]) for r in odd_rows()] + [(30, "Two words"), (31, "two WORDS"), (32, "two")]
    found = ngram_join.ngram_join(frame(spark, rows, "id long, text string").repartition(3))
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == brute_components(rows)


def test_join_stage_keeps_one(spark, odd):
    kept = ngram_join.keep_one(spark, odd, FOLDER)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8"])
    assert ngram_join.keep_one(spark, odd.limit(0), FOLDER).count() == 0


def test_join_stage_keeps_different_texts_of_one_id(spark):
    one, two = "a b c d e f g h i j k l", "n o p q r s t u v w x y z"
    rows = [(7, one, "en", "a", 1, "x"), (7, two, "en", "a", 1, "x"), (7, one, "en", "a", 1, "y"), (8, two, "en", "a", 1, "z"), (9, None, "en", "a", 1, ""), (9, None, "en", "a", 1, "")]
    kept = ngram_join.keep_one(spark, frame(spark, rows), FOLDER).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(7, one), (7, two), (9, ""), (9, "")]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500)]
    found = {r.node: r.root for r in components.components(frame(spark, edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and {found[i] for i in (500, 501, 502)} == {500}


# packing


def check_pieces(rows, texts, size=packing.SIZE):
    encoder = packing.byte_encoder(packing.default_tokenizer())
    ids = {d: [*encoder.encode_ordinary(t or ""), 1] for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        piece = ids[r.id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.id]) and r.length > 0
    for d, pieces in by_doc.items():
        spans = sorted((r.start, r.length) for r in pieces)
        assert [s for s, _ in spans] == list(np.cumsum([0, *(n for _, n in spans[:-1])])) and sum(n for _, n in spans) == len(ids[d])
    assert set(by_doc) == set(texts)
    for s, pieces in by_sequence.items():
        spans = sorted((r.offset, r.length) for r in pieces)
        assert [o for o, _ in spans] == list(np.cumsum([0, *(n for _, n in spans[:-1])]))
        assert sum(n for _, n in spans) == size or s == max(by_sequence)
    return by_sequence


def test_tokens_equal_the_librarys(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encoder = packing.byte_encoder(packing.default_tokenizer())
    for text in [*(r.text for r in documents.limit(60).collect()), "", "<|endoftext|> it's\n\n x é中🙂  "]:
        assert encoder.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_tokens_equal_the_librarys_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "one <|endoftext|> two", 2: "a" + " " * 1_000_000 + "b", 3: "<|endoftext|><|endoftext|> x", 4: "plain é\n", 5: "x <|endof" + "y" * 9}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert ids[1] == [505, 220, 50256, 734]
    rows = spark.createDataFrame([(i, "s", t) for i, t in texts.items()], "id long, source string, text string")
    found = {r.id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.tokenized(rows, packing.default_tokenizer()).collect()}
    assert found == {i: [*x, packing.END] for i, x in ids.items()}
    edit = [(0, 0, "z")], [(500, 3, "<|endoftext|>")], [(5, 2, "")], [], [(9, 9, "text|> w")]
    rows = spark.createDataFrame([(i, t, e) for (i, t), e in zip(texts.items(), edit)], "id long, text string, edits array<struct<place: long, deleted: long, inserted: string>>")
    for r in token_counts.count_edits(rows).collect():
        text = texts[r.id]
        for place, deleted, inserted in edit[r.id - 1]:
            text = text[:place] + inserted + text[place + deleted :]
        assert (r.n_tokens, r.edited_tokens) == (len(ids[r.id]), len(library.encode(text, add_special_tokens=False).ids))


def test_packing_whole_and_in_proportion(spark, documents):
    from pyspark.sql import functions as F

    rows = documents.select(F.col("doc_id").alias("id"), "source", "text").repartition(5)
    found = packing.pack(rows).collect()
    sequences = check_pieces(found, {r.id: r.text for r in rows.collect()})
    total = Counter()
    for r in found:
        total[r.source] += r.length
    everything = sum(total.values())
    done = Counter()
    for s in sorted(sequences)[:-1]:  # carried deficits stay below one token
        for r in sequences[s]:
            done[r.source] += r.length
        for source, n in total.items():
            assert abs(done[source] - n * (s + 1) * packing.SIZE / everything) <= 1


@pytest.mark.parametrize("weighted", [False, True])
def test_packing_of_many_small_sources(spark, monkeypatch, weighted):
    """1500 small sources, one large one and one without a name: each within one quantum of its proportion."""
    from pyspark.sql import functions as F

    quantum = 16
    monkeypatch.setattr(packing, "QUANTUM", quantum)
    rows = [(3 * i + j, f"s{i}", "one two three four five six seven " * (3 + j)) for i in range(1500) for j in range(2)]
    rows += [(100_000 + i, "large", "big words here " * 900) for i in range(40)] + [(200_000, None, "a"), (200_001, "tiny", None)]
    frame = spark.createDataFrame(rows, "id long, source string, text string").repartition(6)
    weights = {s: 3 if s == "large" else 2 if s is not None and s.endswith("7") else 1 for _, s, _ in rows} if weighted else None
    found = packing.pack(frame, weights=weights).collect()
    sequences = check_pieces(found, {i: t for i, _, t in rows})
    small = [r for r in found if r.source != "large"]
    of_source = Counter()
    for r in small:
        of_source[r.source] += r.length
    share = weights or of_source
    done, left = Counter(), dict(of_source)
    for s in sorted(sequences):
        for r in sequences[s]:
            if r.source != "large":
                done[r.source] += r.length
        live = [x for x in of_source if done[x] < of_source[x]]
        if len(live) < len(of_source) - 2:  # from here on some sources are used up
            break
        time = sum(done.values()) / sum(share[x] for x in of_source)
        assert all(abs(done[x] - time * share[x]) <= 2 * quantum for x in of_source if of_source[x] > quantum)
    assert s > 3 and sum(done.values()) > 0.3 * sum(left.values())


def test_packing_refuses_missing_weights(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, source string, text string")
    with pytest.raises(ValueError, match="b"):
        packing.pack(frame, weights={"a": 1})


def test_packing_with_weights_and_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("n")).alias("source"), "text")
    rows = rows.where("source <> 'n'")
    weights = {"a": 5, "b": 3, "c": 1}
    check_pieces(packing.pack(rows, weights=weights, size=64).collect(), {r.id: r.text for r in rows.collect()}, 64)
    assert packing.pack(odd.select(F.col("doc_id").alias("id"), "source", "text").limit(0)).count() == 0
    assert packing.pack(odd.select(F.col("doc_id").alias("id"), "source", "text")).agg(F.sum("length")).first()[0] > 0


# fingerprints


def test_fingerprints(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    from pyspark.sql import functions as F

    found = {r.id: r for r in fingerprints.fingerprints(documents.select(F.col("doc_id").alias("id"), "text"), rows_per_range=37).collect()}
    assert len(found) == len(rows)
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)].text
        cut = len(r.text) // 4
        edited = r.text[: len(r.text) - cut] + following[:cut]
        got = found[r.doc_id]
        assert got.n_chars == len(r.text) and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint == fingerprints.as_text(fingerprints.sketch(r.text)) and 0 <= got.near_next <= 1
    long = [found[r.doc_id].near_edited for r in rows if len(r.text) > 600]
    assert np.mean(long) > 0.5 and np.mean([found[r.doc_id].near_next for r in rows]) < 0.1


def test_fingerprints_list_and_match_all_anchors():
    random.seed(9)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    passage = [w.upper() for w in words[:50]]
    text, other = " ".join(words), " ".join("".join(random.choice("klmnopqrst") for _ in range(6)) for _ in range(4000))
    whole = fingerprints.sketch(text)
    assert len(fingerprints.as_text(whole)) == 18 * len(fingerprints.anchors(text)[0]) > 18 * 192
    for at in range(200, 4000, 400):  # one word changed, one passage shared
        edited = " ".join([*words[:at], "zzzzzz", *words[at + 1 :]])
        assert fingerprints.as_text(fingerprints.sketch(edited)) != fingerprints.as_text(whole)
        assert 0.98 < fingerprints.likeness(whole, fingerprints.sketch(edited)) < 1
        split = other.split(" ")
        shared = [fingerprints.sketch(" ".join([*x[:at], *passage, *x[at:]])) for x in (words, split)]
        assert 0 < fingerprints.likeness(*shared) < 0.02
    assert fingerprints.likeness(fingerprints.sketch("x " * 300), fingerprints.sketch("x " * 600)) < 0.6  # repeats count
    assert fingerprints.likeness(whole, whole) == 1


def test_fingerprints_of_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    rows = fingerprints.fingerprints(odd.select(F.col("doc_id").alias("id"), "text"), rows_per_range=2).collect()
    assert len(rows) == 10 and len({r.fingerprint for r in rows if r.id in (1, 2)}) == 1
    assert all(r.fingerprint == "" for r in rows if r.id in (3, 4))
    assert fingerprints.fingerprints(odd.select(F.col("doc_id").alias("id"), "text").limit(0)).count() == 0


def test_syncmers_are_context_free():
    random.seed(5)
    text = "".join(random.choice("abcdef gh") for _ in range(3000))
    a, b = (dict(zip(p.tolist(), h.tolist())) for h, p in (fingerprints.anchors(text), fingerprints.anchors("zz" + text)))
    assert a == {p - 2: h for p, h in b.items() if p >= 2}
    k, s = fingerprints.K, fingerprints.S
    inner = fingerprints._rolling(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), s).tolist()
    assert sorted(a) == [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


# URL filters


def test_url_rules_and_verdicts(spark):
    urls = [
        ("https://A.Example.NET/en/1?x=/de/", "example.net/en/", "allow"), ("http://example.net/de/1", "net/", "block"), ("http://examplenet/", None, None),
        ("http://x.example.com/de/9#a", "example.com/de/", "block"), ("http://notexample.com/de/9", None, None), ("https://b.org/fr/2", "org/fr/", "allow"),
        ("https://b.org/fr", None, None), (None, None, "allow"), ("no url", None, "allow"), ("http://net", None, None), ("", None, "allow"),
        ("https://www.online-casino.example.org/en/1", None, "block"), ("https://thrush.example.org/en/1", None, "allow"),
    ]
    rows = url_filters.judge(frame(spark, [(i, u[0]) for i, u in enumerate(urls)], "id long, url string")).collect()
    for r in rows:
        _, rule, verdict = urls[r.id]
        assert r.rule == rule and verdict in (None, r.verdict), urls[r.id]
    assert (rows[0].host, rows[0].path) == ("a.example.net", "/en/1") and (rows[7].host, rows[7].path) == ("", "")
    assert url_filters.judge(frame(spark, [], "id long, url string")).count() == 0


# HTML extraction


def test_html_main_text(spark):
    body = [f"Paragraph {i} has its own &amp; words.\n  And more" for i in range(6)]
    pages = [
        (i, f"http://h.example/{i}", f"<html><head><title>t</title><script>x('</p>')</script></head><body><div class='top'><p>Welcome to the site</p></div>"
         f"<div id=text><h1>Title {i}</h1><p>{b}<p><b>Second {i}<br>line</p></div><div class=comments>Nice</div><footer>F</footer></body></html>")
        for i, b in enumerate(body)
    ]
    odd = [(100, None, None), (101, "http://one.example/", "plain <p>text"), (102, "http://one.example/", "<p>a<!-- x -->b</p><form>q</form>"), (103, "http://one.example/", "")]
    rows = {r.id: r for r in html_extraction.extract(frame(spark, pages + odd, "id long, url string, html string")).collect()}
    for i in range(6):
        assert rows[i].text == f"Title {i}\nParagraph {i} has its own & words. And more\nSecond {i} line"
        assert rows[i].n_chars == len(rows[i].text)
    assert [rows[i].text for i in range(100, 104)] == ["", "plain\ntext", "ab", ""]
    assert html_extraction.extract(frame(spark, [], "id long, url string, html string")).count() == 0


# license scans


def test_licenses_and_inheritance(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License.", True), ("a/b/c/x.txt", "nothing", False), ("a/b/y.txt", "Some text\nLicensed under CC BY-NC 4.0.\nmore", False),
        ("a/b/z.txt", None, None), ("d/x.txt", "", False), (None, "Released under the MIT License.", True), ("top.txt", "The license of things is unclear to me and to you", False),
        ("a/b/c/x.txt", "nothing", False),
    ]
    rows = license_scans.scan(frame(spark, files, "path string, text string, declares boolean")).collect()
    got = sorted((str(r.path), r.license, r.inherited_from) for r in rows)
    assert len(rows) == 8 and ("a/LICENSE", "MIT", None) in got and got.count(("a/b/c/x.txt", "MIT", "a")) == 2
    assert ("a/b/y.txt", "CC-BY-NC-4.0", None) in got and ("a/b/z.txt", "MIT", "a") in got and ("d/x.txt", None, None) in got
    assert license_scans.scan(frame(spark, [], "path string, text string, declares boolean")).count() == 0


def test_whole_licences_headers_and_tags(spark):
    mit = license_scans.TEMPLATES["MIT"][-1]
    broken = re.sub(r"((?:\S+ ){7})", r"\1\n * ", mit)
    notice = license_scans._gnu("GNU General Public License", "3")[-1]
    cases = {
        "// SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: Apache-2.0 */": "Apache-2.0",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os": "(MIT OR Apache-2.0)",
        "Copyright 2020 Example Ltd. All rights reserved.": "LicenseRef-proprietary", "The MIT License (MIT)": "MIT",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance': "Apache-2.0",
        "Apache License\n   Version 2.0, January 2004\n http://www.apache.org/licenses/": "Apache-2.0",
        f"Copyright 2021 A. Person\n\n * {broken}\n\nTHE SOFTWARE IS PROVIDED AS IS. import numpy as np and then some more words of code": "MIT",
        "BSD\n" + license_scans._BSD + license_scans._NO_ENDORSEMENT + license_scans._BSD_END: "BSD-3-Clause",
        "All rights reserved.\n" + license_scans._BSD + license_scans._BSD_END: "BSD-2-Clause",
        notice: "GPL-3.0", notice.replace("version 3", "version 2"): "GPL-2.0", notice.replace("General", "Lesser General").replace("program", "library"): "LGPL-3.0",
        "Licensed under the Apache License, Version 1.1": None, "Released under the Foo License.": None, "Some copyright of a license, free of charge": None,
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "the long code " * 3000 + "is licensed under the Apache License, Version 2.0, as is " + "the rest " * 3000: "Apache-2.0",
    }
    plain = [(f"p{i}", f"the house by the river and the {w} of the software is under this version", False) for i, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)]
    files = [(f"f{i}", text, False) for i, text in enumerate(cases)] + plain
    got = {r.path: r for r in license_scans.scan(frame(spark, files, "path string, text string, declares boolean")).collect()}
    assert {text: got[f"f{i}"].own_license for i, text in enumerate(cases)} == cases
    assert all(got[p].own_license is None for p, _, _ in plain)


# token counts


def test_edits_count_like_whole_texts(spark):
    random.seed(11)
    encoder = packing.byte_encoder(packing.default_tokenizer())
    alphabet = "ab é\n  '1.,Z中"
    for size in (1, 8, 64):
        text = "".join(random.choice(alphabet) for _ in range(1500))
        tree = token_counts.CountTree(text, encoder, size)
        for _ in range(60):
            place, deleted = random.randrange(0, len(text) + 3), random.randrange(0, 40)
            inserted = "".join(random.choice(alphabet) for _ in range(random.randrange(0, 30)))
            tree.edit(place, deleted, inserted)
            place = min(place, len(text))
            text = text[:place] + inserted + text[place + deleted :]
            assert "".join(tree.texts) == text and tree.chars == len(text) and tree.tokens == len(encoder.encode_ordinary(text))


def test_token_counts_of_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    rows = token_counts.count_edits(odd.select(F.col("doc_id").alias("id"), "text", token_counts.sample_edits(F.col("text")).alias("edits"))).collect()
    assert len(rows) == 10 and all(r.n_tokens == 0 for r in rows if r.id in (3, 4))


# SentencePiece


def all_segmentations(part):
    """(score, ids) of every way through the lattice, read from the model itself: best first, then the longer last pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    least = min(model.get_score(i) for i in plain.values())

    def ways(rest):
        if not rest:
            yield Fraction(0), (), ()
        for length in range(1, len(rest) + 1):
            piece, before = rest[-length:], rest[:-length]
            if piece in plain:
                x, ids = Fraction(model.get_score(plain[piece])), (plain[piece],)
            elif length == 1:
                ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in piece.encode())
                x = Fraction(least - 10) * len(ids)
            else:
                continue
            yield from ((s + x, (-length, *key), (*i, *ids)) for s, key, i in ways(before))

    return [(float(s), ids) for s, _, ids in sorted(ways(part), key=lambda w: (-w[0], w[1]))]


@pytest.fixture(scope="module")
def sentence_pieces():
    import public_tokenizers

    return sentencepiece_nbest.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


PARTS = ("▁the", "▁theory", "▁a\nb", "▁\x00", "▁aaaaaaa", "▁żółw", "▁𐍈x", "▁", "▁▁▁▁", "------", "..\x7f..", "====ab", "▁ababab")


@pytest.mark.parametrize("part", PARTS)
def test_nbest_matches_all_segmentations(sentence_pieces, part):
    want = all_segmentations(part)
    for n in (1, 3, 7):
        got = list(sentence_pieces.nbest(part, n))
        assert len(got) >= min(n, len(want))
        assert got == list(sentence_pieces.nbest(part, n)) and len(set(ids for _, ids in got[:n])) == min(n, len(want))
        assert got[0][1] == want[0][1] and all((s / sentence_pieces.unit, ids) in want for s, ids in got)
        assert [s / sentence_pieces.unit for s, _ in got[:n]] == [s for s, _ in want[:n]]
    best, ids, loss = sentence_pieces.margin(part)
    assert ids == want[0][1] and loss / sentence_pieces.unit == (pytest.approx(want[0][0] - want[1][0], abs=1e-6) if len(want) > 1 else math.inf)


def test_nbest_of_texts(sentence_pieces):
    for text in ("the theory", "a  bé", "x", "a b"):
        part = "▁" + text.replace(" ", "▁")
        got = sentence_pieces.segment(text, 4)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in all_segmentations(part)[: len(got)]])
    for text in ("the theory", "a\nb\n", "\u20ac\n𐍈 x", "  two  ", "\x7f\x80é\n", "▁"):
        assert all(sentence_pieces.decode(ids) == text.replace("▁", " ") for _, ids in sentence_pieces.segment(text, 3))
    assert sentence_pieces.segment("", 3) == [(0.0, [])]


@pytest.mark.parametrize("unit", ["-", ".", "*", " ", "ab", "=", "\x00", "a"])
def test_nbest_of_long_runs_takes_linear_time(sentence_pieces, unit):
    def seconds(length):
        import time

        start = time.perf_counter()
        found = sentence_pieces.segment(unit * (length // len(unit)), 4)
        many = 1 if unit == "\x00" else 4  # a byte has one spelling
        assert len(found) == len({tuple(ids) for _, ids in found}) == many and sentence_pieces.decode(found[0][1]) == unit * (length // len(unit))
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 12


def test_nbest_of_a_million_dashes(sentence_pieces):
    found = sentence_pieces.segment("-" * 1_000_000, 4)
    assert [len(set(ids)) <= 20 for _, ids in found] == [True] * 4 and found[0][0] >= found[3][0]


def test_nbest_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    rows = sentencepiece_nbest.encode(odd.select(F.col("doc_id").alias("id"), "text"), 3).collect()
    assert len(rows) == 10 and all(r.round_trip for r in rows)


# pipeline


def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for i, (_, apply) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(apply(spark, docs, FOLDER))
        assert docs.count() > 0 and (docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1)
