"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window (sequence) of ``size`` tokens serves the
queues in turn; a queue's quantum is its target share of the window, and what it got too little or too
much - its deficit, always below one token - is carried to the next window. The deficits have a
closed form: after x tokens in all, the queues up to the s-th have got floor(x * A_s / T), where A_s
is their share in the total T. So a window's grants, and the place of every token, follow from the
token's position in its queue alone: no task needs another's state, deficits are carried across
partitions without passing anything on, and a lost task is run again with the same result.

With ``weights`` other than the sources' sizes some queues run dry first; the schedule then has one
phase per dry queue, in which the others share in proportion to their weights.

Texts are tokenized once and staged as 16-bit ids; positions in a queue follow the staged
partitions. Only the last sequence is padded, so padding stays below one window altogether.

A source under 1/1024 of all tokens is due less than two tokens a window. These sources are served by one further
queue, in which round-robin goes by quanta of ``QUANTUM`` tokens: the k-th quantum of a source with weight w is
due at (k - 1/2) / w, and the queue holds all quanta in the order they are due. At any time a source has then got its
proportion of that queue to within one quantum, for any number of sources and any weights. The order is a range sort of the
quanta, numbered range by range; documents of these sources are cut at quanta and meet their places in a join.
With ``weights`` the shared queue has the sum of its sources' weights until it runs dry.

Null texts are empty; null sources are a source of their own. No documents, no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declara.llm.common import broadcast_if_small
from declara.runtime import stage, with_global_cumsum

SIZE = 2048
LEAST_SHARE = 1024  # a queue of its own takes at least 1/1024 of all tokens
QUANTUM = 512  # tokens that a small source gets at a time
END = 1

LONG_SPACE = 10_000  # characters of white space in a row that are left to the library

_ENCODERS: dict = {}
_EXACT: dict = {}


class ExactEncoder:
    """The ids of the file's own library at its default setting, added tokens included. Texts without
    an added token or very long white space (which overflows the other's stack) take the faster way."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.path, self.fast, self.library = path, byte_encoder(path), None

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added) or self._long_space(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    encode_ordinary = encode

    @staticmethod
    def _long_space(text: str) -> bool:
        return len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACES.finditer(text))


_SPACES = re.compile(r"\s+")


def exact_encoder(path: str) -> ExactEncoder:
    if path not in _EXACT:
        _EXACT[path] = ExactEncoder(path)
    return _EXACT[path]


def byte_encoder(path: str):
    """The encoder of a byte-level BPE vocabulary file. The merges are ranked by their ids, which
    gives the ids of the file's own library several times faster; special strings are plain text."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if all(c in shown for c in token) and token != "<|endoftext|>"}
        _ENCODERS[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """(id, source, part, before, n, ids): ids as 16-bit little-endian with the end id, and the
    tokens of the same source before it in the same partition."""
    kind = documents.schema["id"].dataType.simpleString()

    def encode(batches):
        encoder = exact_encoder(path)
        seen: dict[str, int] = defaultdict(int)
        for b in batches:
            texts, sources = b.column("text").to_pylist(), b.column("source").to_pylist()
            before, n, packed = [], [], []
            for text, source in zip(texts, sources):
                ids = np.array([*encoder.encode(text or ""), END], dtype="<u2")
                before.append(seen[source])
                n.append(len(ids))
                packed.append(ids.tobytes())
                seen[source] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("source"), b.column("part"), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                names=["id", "source", "part", "before", "n", "ids"],
            )

    rows = documents.select("id", F.col("source").cast("string").alias("source"), F.spark_partition_id().alias("part"), "text")
    return rows.mapInArrow(encode, f"id {kind}, source string, part int, before long, n long, ids binary")


class Schedule:
    """What every queue has been granted after x tokens in all."""

    def __init__(self, tokens: list[int], weights: list[int], size: int):
        self.size, self.total = size, sum(tokens)
        left, done, at = [Fraction(t) for t in tokens], [Fraction(0)] * len(tokens), Fraction(0)
        self.starts: list[int] = []  # first integer x of each phase
        self.phases: list[tuple[int, list[int], list[int]]] = []  # denominator, prefix sums: constant, slope
        while any(left):
            live = [w if t else 0 for w, t in zip(weights, left)]
            pace = min(t / w for t, w in zip(left, live) if w)
            span = pace * sum(live)
            constant, slope, c, s = [], [], Fraction(0), 0
            for d, w in zip(done, live):
                c, s = c + d, s + w
                constant.append(c - at * Fraction(s, sum(live)))
                slope.append(Fraction(s, sum(live)))
            whole = lcm(*(f.denominator for f in (*constant, *slope)))
            self.starts.append(-(-at.numerator // at.denominator))
            self.phases.append((whole, [int(f * whole) for f in constant], [int(f * whole) for f in slope]))
            left = [t - w * pace for t, w in zip(left, live)]
            done = [d + w * pace for d, w in zip(done, live)]
            at += span
        self.windows = -(-self.total // size)

    def upto(self, queue: int, window: int) -> int:
        """Tokens granted to the queues before ``queue`` in the windows before ``window``."""
        x = min(window * self.size, self.total)
        if queue == 0 or not self.phases:
            return 0
        whole, constant, slope = self.phases[max(0, bisect_right(self.starts, x) - 1)]
        return (constant[queue - 1] + slope[queue - 1] * x) // whole

    def pieces(self, queue: int, start: int, n: int):
        """(window, place in the window, first, length) of n tokens from ``start`` of a queue on."""
        low, high = 0, self.windows - 1
        while low < high:  # the last window that begins at or before ``start``
            mid = (low + high + 1) // 2
            if self.upto(queue + 1, mid) - self.upto(queue, mid) <= start:
                low = mid
            else:
                high = mid - 1
        w, first = low, 0
        below, upper = self.upto(queue, w), self.upto(queue + 1, w)
        while first < n:
            next_below, next_upper = self.upto(queue, w + 1), self.upto(queue + 1, w + 1)
            begin, end = upper - below, next_upper - next_below  # of the window's share in the queue
            if (length := min(end - start, n) - first) > 0 and begin <= start + first:
                yield w, (next_below - below) + (start + first - begin), first, length
                first += length
            w, below, upper = w + 1, next_below, next_upper


def _by_quanta(rows: DataFrame, small: DataFrame, queue: int) -> DataFrame:
    """Documents of the small sources cut at quanta and moved to their places in the shared queue. ``small`` is
    (source, n, weight)."""
    due = (F.col("k") + 0.5) / F.col("weight")
    quanta = small.select("source", "n", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / QUANTUM))).alias("k")).select(
        "source", "k", due.alias("due"), F.least(F.lit(QUANTUM).cast("long"), F.col("n") - F.col("k") * QUANTUM).alias("size"))
    order = [F.col("due"), F.col("source").asc_nulls_first(), F.col("k")]
    ends = with_global_cumsum(quanta, order, {"upto": F.col("size")})
    places = stage(ends.select(F.col("source").alias("_s"), F.col("k").alias("_k"), (F.col("upto") - F.col("size")).alias("place")))
    cut = rows.where("n > 0").withColumn("k", F.explode(F.sequence(
        F.floor(F.col("begin") / QUANTUM), F.floor((F.col("begin") + F.col("n") - 1) / QUANTUM))))
    at = F.greatest(F.col("begin"), F.col("k") * QUANTUM)
    length = F.least(F.col("begin") + F.col("n"), (F.col("k") + 1) * QUANTUM) - at
    parts = cut.select("id", "source", "k", (at - F.col("k") * QUANTUM).alias("inside"), (at - F.col("begin")).alias("first"), length.alias("n"), "whole", "ids")
    joined = parts.withColumn("ids", F.substring("ids", (2 * F.col("first") + 1).cast("int"), (2 * F.col("n")).cast("int"))).join(
        places, F.col("source").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k")))
    return joined.select("id", "source", F.lit(queue).alias("queue"), (F.col("place") + F.col("inside")).alias("begin"), "first", "n", "whole", "ids")


def pack(documents: DataFrame, tokenizer: str | None = None, size: int = SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all ``documents`` (id, source, text): id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source.

    ``weights`` gives sources their target proportions (every source needs one); without it they
    are the sources' own token counts."""
    tokens = stage(tokenized(documents, tokenizer or default_tokenizer()))
    sizes = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    # at most LEAST_SHARE sources are that large, whatever the corpus
    large = sums.where(F.col("n") * LEAST_SHARE >= total).orderBy(F.col("source").asc_nulls_first()).collect()
    rest = total - sum(r.n for r in large)
    queues = [r.n for r in large] + ([rest] if rest else [])
    spark = documents.sparkSession
    named = spark.createDataFrame([(r.source, i) for i, r in enumerate(large)], "_s string, queue int")
    if weights:
        known = stage(spark.createDataFrame([(s, int(w)) for s, w in weights.items()], "_w string, weight long"))
        sums = sums.join(known, sums.source.eqNullSafe(known._w), "left").drop("_w")
        if (without := sums.where("weight IS NULL OR weight <= 0").limit(3).collect()):
            raise ValueError(f"sources without a positive weight: {[r.source for r in without]}")
    else:
        sums = sums.withColumn("weight", F.col("n"))
    # a source's partitions follow each other
    ordered = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(ordered), F.lit(0))).join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_s")), "left")
    bases = stage(bases.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "queue", "base"))  # a row per source and partition of the texts
    placed = tokens.join(broadcast_if_small(bases), tokens.source.eqNullSafe(bases._s) & (tokens.part == bases._p)).select(
        "id", "source", "queue", (F.col("base") + F.col("before")).alias("begin"), F.lit(0).cast("long").alias("first"), "n", F.col("n").alias("whole"), "ids"
    )
    rows = placed.where("queue IS NOT NULL")
    shares = [weights[r.source] for r in large] if weights else [r.n for r in large]
    if rest:
        small = sums.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_s")), "left").where("queue IS NULL").select("source", "n", "weight")
        shares.append(small.agg(F.sum("weight")).first()[0])
        rows = rows.unionAll(_by_quanta(placed.where("queue IS NULL"), small, len(large)))
    schedule = Schedule(queues, shares, size)
    kind = documents.schema["id"].dataType.simpleString()

    def cut(batches):
        schema = None
        for b in batches:
            source_row, out = [], [[] for _ in range(6)]
            columns = [b.column(c).to_pylist() for c in ("queue", "begin", "first", "n", "whole", "ids")]
            for i, (queue, begin, skipped, n, whole, packed) in enumerate(zip(*columns)):
                wide = np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                for w, offset, first, length in schedule.pieces(queue, begin, n):
                    source_row.append(i)
                    for column, value in zip(out, (skipped + first, length, zlib.crc32(memoryview(wide)[4 * first : 4 * (first + length)]), whole, w, offset)):
                        column.append(value)
            take = pa.array(source_row, pa.int32())
            arrays = [b.column("id").take(take), *(pa.array(c, pa.int64()) for c in out), b.column("source").take(take)]
            schema = schema or pa.schema([pa.field(name, a.type) for name, a in zip(["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"], arrays)])
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def pack_documents(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    return pack(documents.select(F.col("doc_id").alias("id"), "source", "text")).withColumnRenamed("id", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
