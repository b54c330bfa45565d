"""Audit of how far the sources of a language lie apart, by Gustavson's row accumulation.

Documents fall into groups (lang, source). The kept terms of a language are those in at least
``min_documents`` of its documents; every group gives each of them a smoothed share of a milliard,
p = 1 + floor(10^9 (count + 1) / (N + V)). The divergence of a group from a peer is the sum over
all kept terms of f(p, q) = floor((p - q)^2 / q), with q the peer's share.

The counts form a sparse matrix of groups by terms, and its transpose is the term-major index. Row
accumulation takes a group's terms one after the other, looks up the peers that have the term and
adds into one dense accumulator of a number per peer, so that pairs of postings are never rows of a
table. Absent terms count as well: a zero count has its own share, p0. The sum is therefore split
into the value that all terms would have at zero counts, corrections for the terms of either side
alone, and a correction where both sides have the term:

    sum over all terms      f(p0, q0)
    + terms of the group    f(p, q0) - f(p0, q0)
    + terms of the peer     f(p0, q) - f(p0, q0)
    + terms of both         f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

Shares depend on the count alone, so the middle two are sums over each group's distinct shares
(``_baselines``); only the last needs the index (``_corrections``). The index is dealt out in slices of
whole terms; a slice has a bounded number of cells, and at least ``DENSE`` times as many as there are groups in
the language, so that accumulators are worth sending. Counting is combined inside the tasks before
anything is shuffled, therefore no source, language or word makes a hot task.

Defined results: null lang, source and text are ''. A group without terms has pairs and no terms; a language
without kept terms has value 0 for all pairs; a language with one source has no pairs. Equal values are ordered
by the item's UTF-8. Repeated rows are documents of their own. No documents, no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declara.llm.common import broadcast_if_small, utf8
from declara.runtime import stage

MILLIARD = 1_000_000_000
HELD = 300_000  # counted terms a task holds before it hands them on
CELLS = 1 << 15  # cells of the index in a slice
DENSE = 16  # a slice has at least so many times as many cells as its language has groups
ROWS = 16  # groups whose baselines are summed together
BLOCK = 1 << 20  # values of f computed at once
NORM_ROWS = 200_000  # groups (two names and five numbers each) up to which their table may be broadcast

# Everything but letters and bytes of other characters parts terms; only A-Z is lower-cased.
_TERMS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


def _counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df), combined inside each task; a key may come up in several rows."""
    fields = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())]

    def rows(held):
        for (lang, source), (n, df) in held.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()),
                     pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=[f for f, _ in fields])

    def count(batches):
        held, size = {}, 0
        for b in batches:
            for lang, source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = terms(raw.tobytes())
                n.update(found)
                df.update(set(found))
                size += len(n) - before
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return documents.mapInArrow(count, "lang string, source string, term string, n long, df long")


def _div(a: Column, b: Column) -> Column:
    """Exact whole-number division; no operand is negative."""
    return F.call_function("div", a, b).cast("long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exact; 1 where nothing is kept."""
    parts = (n.cast("decimal(20,0)") + F.lit(1)) * F.lit(MILLIARD).cast("decimal(10,0)")
    return F.when(total + kept > 0, F.lit(1) + _div(parts, (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(1).cast("long"))


def excess(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _corrections(cells: DataFrame) -> DataFrame:
    """(lang, g, h, value): terms that group and peer both have, accumulated slice by slice."""

    def accumulate(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        term = table.column("term").combine_chunks().dictionary_encode()
        term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
        no, p, p0 = (table.column(c).to_numpy() for c in ("no", "p", "p0"))
        by_term = np.argsort(term, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(term))))
        peer, q, q0 = no[by_term], p[by_term], p0[by_term]
        by_group = np.argsort(no, kind="stable")
        edges = np.flatnonzero(np.diff(no[by_group], prepend=-1, append=-1))
        width = int(no.max()) + 1
        out = []
        for start, end in zip(edges[:-1], edges[1:]):
            mine = by_group[start:end]
            group, zero = int(no[mine[0]]), p0[mine[0]]
            many = first[term[mine] + 1] - first[term[mine]]
            places = np.arange(many.sum()) + np.repeat(first[term[mine]] - (np.cumsum(many) - many), many)
            own = np.repeat(p[mine], many)
            total = np.zeros(width, np.int64)
            np.add.at(total, peer[places], _f(own, q[places]) - _f(own, q0[places]) - _f(zero, q[places]) + _f(zero, q0[places]))
            total[group] = 0
            h = np.flatnonzero(total)
            out.append((np.full(len(h), group, np.int32), h.astype(np.int32), total[h]))
        g, h, value = (np.concatenate(c) for c in zip(*out))
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": g, "h": h, "value": value})

    return cells.groupBy("lang", "slice").applyInArrow(accumulate, "lang string, g int, h int, value long")


def _baselines(norms: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, g, h, value) for all pairs: zero counts, and the terms of either side against them.
    ``shares`` (lang, no, p, terms) says how many terms of a group have which share."""
    blocks = norms.groupBy("lang").agg(F.max("no").alias("last")).select(
        "lang", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / ROWS).cast("int"))).alias("block"))
    peers = norms.select("lang", F.col("no").alias("peer"), F.col("p0").alias("zero"), "kept").join(broadcast_if_small(blocks), "lang")

    def accumulate(key, mine: pa.Table, peers: pa.Table) -> pa.Table:
        lang, block = (k.as_py() for k in key)
        zero = peers.column("zero").to_numpy()[np.argsort(peers.column("peer").to_numpy())]
        kept = peers.column("kept").to_numpy()[0]
        no, p, many = (mine.column(c).to_numpy() for c in ("no", "p", "terms"))
        out = []
        for g in range(block * ROWS, min(len(zero), (block + 1) * ROWS)):
            own, m = p[no == g], many[no == g]
            at_zero = _f(zero[g], zero)
            as_group, as_peer = (kept - m.sum()) * at_zero, -m.sum() * _f(zero, zero[g])
            step = max(1, BLOCK // len(zero))
            for start in range(0, len(own), step):
                some, times = own[start : start + step, None], m[start : start + step, None]
                as_group = as_group + (times * _f(some, zero)).sum(axis=0)
                as_peer = as_peer + (times * _f(zero, some)).sum(axis=0)
            others = np.delete(np.arange(len(zero), dtype=np.int32), g)
            same = np.full(len(others), g, np.int32)
            out += [(same, others, as_group[others]), (others, same, as_peer[others])]
        g, h, value = (np.concatenate(c) for c in zip(*out))
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": g, "h": h, "value": value})

    left = shares.select(F.col("lang").alias("of"), F.floor(F.col("no") / ROWS).cast("int").alias("part"), "no", "p", "terms")
    return left.groupBy("of", "part").cogroup(peers.groupBy("lang", "block")).applyInArrow(accumulate, "lang string, g int, h int, value long")


def divergence(documents: DataFrame, min_documents: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents`` (lang, source, text).

    Part ``pair`` gives every other source of the language, ``term`` the ``top_terms`` terms by which
    a group exceeds its language."""
    documents = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    same_term = Window.partitionBy("lang", "term")
    cells = stage(
        _counted(documents).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        .select("lang", "source", "term", "n", F.sum("n").over(same_term).alias("lang_n"), F.sum("df").over(same_term).alias("lang_df"),
                (F.col("source") == F.min("source").over(same_term)).alias("first"))
        .where(F.col("lang_df") >= min_documents).drop("lang_df")
    )
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = documents.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["total", "cells", "firsts"])
    of_lang = Window.partitionBy("lang")
    norms = (
        groups.withColumns({
            "no": F.row_number().over(of_lang.orderBy("source")) - 1, "kept": F.sum("firsts").over(of_lang), "lang_total": F.sum("total").over(of_lang),
            "slices": F.ceil(F.sum("cells").over(of_lang) / F.greatest(F.lit(CELLS), F.lit(DENSE) * F.count("*").over(of_lang))),
        })
        .withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept"))).drop("cells", "firsts")
    )
    norms = stage(norms)
    small = broadcast_if_small(norms, NORM_ROWS)
    shared = cells.join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    both = _corrections(shared.select("lang", F.pmod(F.xxhash64("term"), "slices").alias("slice"), "term", "no", "p", "p0"))
    alone = _baselines(norms, shared.groupBy("lang", "no", "p").agg(F.count("*").alias("terms")))
    sums = both.unionAll(alone).groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    name = lambda no, to: small.select("lang", F.col("no").alias(no), F.col("source").alias(to))
    order = [F.col("value").desc(), F.col("item")]
    ranked = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = sums.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = shared.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    most = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pairs.unionAll(most.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS BIGINT) AS q
    FROM cells JOIN vocabulary USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
groups AS (SELECT DISTINCT lang, source FROM d),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
exceeding AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM exceeding) QUALIFY part = 'pair' OR rank <= 200
"""
