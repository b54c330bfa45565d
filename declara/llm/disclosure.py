"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by fixed
patterns. How strongly a term gives an entity away is estimated from the corpus: with N
documents, n of them holding the entity, d holding the term and c holding the term within ``WINDOW`` words of the entity,
the entity carries log2(N / n) bits and the term reveals log2(N c / (n d)) of them. A term
discloses the entity if at most ``left_bits`` remain unknown (log2(d / c)), at least ``least_bits`` are revealed - an
address that half the corpus prints is no secret - and at least ``least_texts`` different texts support it, so that
copies of one text prove nothing. A disclosing term is generalised to its class (the first three characters of
a word, the shape of a token with digits) if the class discloses none of these entities, and removed otherwise,
in every document that holds it.

Two scans read the texts. The first lists the entities with the terms around them and counts documents per term
and class, combined inside each task; the second looks for disclosing terms through a bitmap of fixed size
and hands on only what passes it, which an exact join then settles. Texts are never shuffled. Pairs are
listed per window, so they grow with the entities, not with the square of a text.

Defined results: null texts are empty. Matches of one kind are leftmost and do not overlap; those that fail their check are
dropped without another try. Terms are runs of letters and digits outside base spans, compared in lower case. Repeated
rows are documents of their own for the counts and get the same spans. Null ids stay null. No documents, no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.llm.common import broadcast_if_small
from declara.runtime import stage

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")  # base kinds first
WINDOW = 10  # words on either side of an entity
STEM = 3  # characters that a generalised word keeps
HELD = 300_000  # counted terms a task holds before it hands them on
BITS = 1 << 26  # of the bitmap that second scans look terms up in: 8 MB at any size of the data

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[+0-9][0-9+().\x20-]*")  # every number lies inside such a run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")
_FIGURE = re.compile(r"\d")


def luhn(digits: list[int]) -> bool:
    return (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, entity) by kind and start; the entity is the value without case and punctuation."""
    found = [(0, s, e, text[s:e].lower()) for s, e in _emails(text)]
    for run in _RUN.finditer(text):
        chunk, at = run.group(), run.start()
        if len(chunk) < 7:
            continue
        if chunk.count(".") >= 3:
            for m in _IP.finditer(chunk):
                parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    found.append((1, at + m.start(), at + m.end(), ".".join(parts)))
        if len(chunk) >= 13:
            for m in _CARD.finditer(chunk):
                digits = _DIGIT.findall(m.group()) if 13 <= len(m.group()) <= 37 else ()
                if 13 <= len(digits) <= 19 and luhn(list(map(int, digits))):
                    found.append((2, at + m.start(), at + m.end(), "".join(digits)))
        if "+" in chunk:
            for m in _PHONE.finditer(chunk):
                digits = _DIGIT.findall(m.group())
                if 9 <= len(digits) <= 15:
                    found.append((3, at + m.start(), at + m.end(), "+" + "".join(digits)))
    return sorted(found)


def blanked(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with spaces in place of its spans, all other places as they were."""
    parts, done = [], 0
    for _, start, end, _ in sorted(spans, key=lambda s: s[1:3]):
        parts += [text[done:start], " " * (end - max(start, done))]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if spans else text


def general(term: str) -> str | None:
    """The class of a term, marked by ~, which no term holds; None if it has none wider than itself."""
    if _FIGURE.search(term):
        return "~" + _FIGURE.sub("0", term)
    return f"~{term[:STEM]}" if len(term) > STEM else None


def pairs(text: str, spans: list[tuple[int, int, int, str]]) -> set[tuple[str, str, str | None]]:
    """(entity, item, class): the entity itself with item '', every term in its windows, and these terms' classes."""
    if not spans:
        return set()
    words = [(m.start(), m.group().lower()) for m in _WORD.finditer(blanked(text, spans))]
    starts = [s for s, _ in words]
    out = set()
    for kind, start, end, value in spans:
        entity = f"{KINDS[kind]} {value}"
        out.add((entity, "", None))
        for _, term in words[max(0, bisect_left(starts, start) - WINDOW) : bisect_left(starts, end) + WINDOW]:
            wider = general(term)
            out.add((entity, term, wider))
            if wider:
                out.add((entity, wider, None))
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def _first_scan(documents: DataFrame) -> DataFrame:
    """A row per document with its base spans and pairs (item null), and rows (item, df) of document counts."""
    ids = documents.schema["id"].dataType.simpleString()
    listed = pa.list_(pa.struct([("entity", pa.string()), ("item", pa.string()), ("wider", pa.string())]))

    def made(like, doc_ids, digests, counts, base, listing, items, df):
        n = len(doc_ids)
        columns = [pa.array(doc_ids, like), pa.array(digests, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
                   pa.array(base, pa.string()), pa.array(listing, listed), pa.array(items, pa.string()), pa.array(df, pa.int64())]
        assert all(len(c) == n for c in columns)
        names = ["id", "digest", *(f"n_{k}" for k in KINDS[:4]), "base", "pairs", "item", "df"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def counted(like, held):
        n = len(held)
        return made(like, [None] * n, [None] * n, [(None,) * 4] * n, [None] * n, [None] * n, list(held), list(held.values()))

    def scan(batches):
        held: Counter = Counter()
        like = None
        for b in batches:
            like = b.column(0).type
            counts, base, listing = [], [], []
            for text in b.column(2):
                text = text.as_py()
                spans = base_spans(text)
                kinds = [s[0] for s in spans]
                counts.append(tuple(kinds.count(k) for k in range(4)))
                base.append(_listed(spans))
                listing.append([{"entity": e, "item": i, "wider": w} for e, i, w in pairs(text, spans)])
                words = set(map(str.lower, set(_WORD.findall(blanked(text, spans)))))
                held.update(words)
                held.update(set(map(general, words)))
                if len(held) >= HELD:
                    held.pop(None, None)
                    yield counted(like, held)
                    held = Counter()
            n = len(base)
            yield made(like, b.column(0), b.column(1), counts, base, listing, [None] * n, [None] * n)
        held.pop(None, None)
        if held:
            yield counted(like, held)

    return documents.mapInArrow(scan, f"id {ids}, digest string, n_email long, n_ip long, n_card long, n_phone long, base string, "
                                "pairs array<struct<entity: string, item: string, wider: string>>, item string, df long")


def disclosing(scanned: DataFrame, left_bits: float, least_bits: float, least_texts: int) -> DataFrame:
    """(item, wider, removed, revealed): the disclosing terms of a first scan, with the most bits that each reveals."""
    near = (
        scanned.where("item is null").select("digest", F.explode("pairs").alias("p")).groupBy("p.entity", "p.item", "p.wider", "digest").agg(F.count("*").alias("c"))
        .groupBy("entity", "item", "wider").agg(F.sum("c").alias("c"), F.count("*").alias("texts"))
    )
    near = stage(near.where((F.col("item") == "") | (F.col("texts") >= least_texts)))
    entities = near.where("item = ''").select("entity", F.col("c").alias("n"))
    df = scanned.where("item is not null").groupBy("item").agg(F.sum("df").alias("d"))
    whole = scanned.where("item is null").agg(F.count("*").alias("n_docs"))
    revealed = F.log2(whole.scalar().cast("double") * F.col("c") / F.col("d") / F.col("n"))
    found = near.where("item <> ''").join(entities, "entity").join(df, "item").withColumn("revealed", revealed)
    found = stage(found.where((F.log2(F.col("d") / F.col("c")) <= left_bits) & (F.col("revealed") >= least_bits)))
    classes = found.where("item like '~%'").select("entity", F.col("item").alias("wider"), F.lit(True).alias("tells"))
    terms = found.where("item not like '~%'").join(classes, ["entity", "wider"], "left")
    return terms.groupBy("item", "wider").agg(F.max(F.col("wider").isNull() | F.col("tells").isNotNull()).alias("removed"), F.max("revealed").alias("revealed"))


def _bitmap(terms: DataFrame) -> bytearray:
    """One bit per hash of a term, BITS in all."""
    place = F.crc32(F.col("item").cast("binary")) % BITS + 1
    out = bytearray(BITS // 8)
    made = terms.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for r in made.collect():  # BITS / 32768 pieces of 4 kB at most
        out[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    return out


def _hits(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, digest, item, places) of every document and term that pass the bitmap."""
    ids = documents.schema["id"].dataType.simpleString()
    bitmap = documents.sparkSession.sparkContext.broadcast(bytes(_bitmap(terms)))
    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        bits = bitmap.value
        for b in batches:
            rows = []
            for at, text in enumerate(b.column(2)):
                text = text.as_py()
                wanted = set()
                for word in set(_WORD.findall(text)):
                    place = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BITS
                    if bits[place >> 3] >> (place & 7) & 1:
                        wanted.add(word.lower())
                if wanted:
                    found: dict[str, list] = {}
                    for m in _WORD.finditer(blanked(text, base_spans(text))):
                        if (word := m.group().lower()) in wanted:
                            found.setdefault(word, []).append({"start": m.start(), "end": m.end()})
                    rows += [(at, word, spans) for word, spans in found.items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], places)],
                names=["id", "digest", "item", "places"])

    return documents.mapInArrow(scan, f"id {ids}, digest string, item string, places array<struct<start: bigint, end: bigint>>")


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("id", F.md5(text.cast("binary")).alias("digest"), text.alias("text"))


def find(documents: DataFrame, left_bits: float = 0.5, least_bits: float = 3.0, least_texts: int = 2) -> DataFrame:
    """Spans of ``documents`` (id, text), a row for each: id, digest (MD5 of the text), n_email, n_ip, n_card, n_phone,
    base (its base spans, listed), added (kind number, start, end, replacement)."""
    documents = _texts(documents)
    scanned = stage(_first_scan(documents))
    base = scanned.where("item is null").drop("pairs", "item", "df")
    terms = stage(disclosing(scanned, left_bits, least_bits, least_texts))
    kind = F.when(F.col("removed"), KINDS.index("removed")).otherwise(KINDS.index("generalised"))
    replacement = F.when(F.col("removed"), "").otherwise(F.concat(F.substring("wider", 2, 1 << 30), F.lit("*")))
    span = F.struct(kind.alias("kind"), "p.start", "p.end", replacement.alias("by"))
    added = (
        _hits(documents, terms).join(broadcast_if_small(terms), "item").select("id", "digest", F.explode("places").alias("p"), "removed", "wider")
        .select("id", "digest", span.alias("span")).groupBy(F.col("id").alias("of"), F.col("digest").alias("text")).agg(F.sort_array(F.collect_set("span")).alias("added"))
    )
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text"))
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint, by: string>>")
    return base.join(added, same, "left").select(*base.columns, F.coalesce("added", none).alias("added"))


def listed(base: Column, added: Column) -> Column:
    """All spans as kind:start:end, base kinds first."""
    names = F.array(*map(F.lit, KINDS))
    more = F.transform(added, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", F.when(base != "", base), F.when(F.size(more) > 0, F.concat_ws(",", more)))


def replaced(text: str, base: str, added: list[dict]) -> str:
    """The text with [KIND] for base spans, classes for generalised terms and nothing for removed ones."""
    spans = [(int(s), int(e), f"[{kind.upper()}]") for kind, s, e in (x.split(":") for x in base.split(",") if x)]
    spans += [(s["start"], s["end"], s["by"]) for s in added]
    parts, done = [], 0
    for start, end, by in sorted(spans):
        if start >= done:
            parts += [text[done:start], by]
        else:
            start = done
        done = max(done, end)
    return "".join([*parts, text[done:]])


def sanitise(documents: DataFrame, **thresholds: float) -> DataFrame:
    """(id, text): every row of ``documents`` (id, text) with its spans replaced; null texts become empty."""
    found = find(documents, **thresholds).where((F.col("base") != "") | (F.size("added") > 0))
    found = broadcast_if_small(stage(found.select(F.col("id").alias("of"), F.col("digest").alias("hash"), "base", "added").distinct()), 100_000)
    texts = _texts(documents)
    joined = texts.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("hash")), "left").select("id", "text", "base", "added")

    def write(batches):
        for b in batches:
            out = [t if base is None else replaced(t, base, added) for t, base, added in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return joined.mapInArrow(write, f"id {texts.schema['id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))
    of_kind = lambda kind: F.size(F.filter("added", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        listed(F.col("base"), F.col("added")).alias("spans"), of_kind("generalised").alias("n_generalised"), of_kind("removed").alias("n_removed"),
    )
