"""The closest known name by edit distance, through an inverted index of characters and bigrams.

Known names lie in blocks of similar length. A task holds one block's index and a bounded slice of
the names that ask for it; a name adds up, per known name, the tokens both have, which bounds the
edit distance from below: by the lengths, by the common characters and by the common bigrams. Known names
are compared in the order of their bounds only as long as a bound can still win. A first round asks the
block of a name's own length; later blocks are asked only where the lengths alone leave room for more
than the ratio found. The best match is exact, ties go to the smaller known name.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.runtime import stage, with_global_rank

SLICE = 20_000  # names that meet a block in one task


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; the columns of the table are kept as bits of two whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        distance += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = (left | ~(same | down | right)) & full, right & (same | down)
    return distance


def tokens(name: str, width: int) -> list[tuple[str, int]]:
    """Character n-grams numbered by occurrence, so that common tokens count as in multisets."""
    seen: Counter = Counter()
    out = []
    for i in range(len(name) - width + 1):
        gram = name[i : i + width]
        out.append((gram, seen[gram]))
        seen[gram] += 1
    return out


class Index:
    """Known names, sorted, with the places of every token."""

    def __init__(self, known: list[str]):
        self.known = sorted(known)
        self.lengths = np.array([len(k) for k in self.known])
        self.places = []
        for width in (1, 2):
            found = defaultdict(list)
            for i, k in enumerate(self.known):
                for token in tokens(k, width):
                    found[token].append(i)
            self.places.append({t: np.array(ids) for t, ids in found.items()})

    def least_distances(self, name: str) -> np.ndarray:
        """Lower bounds of the edit distance to all known names."""
        longer = np.maximum(self.lengths, len(name))
        common = []
        for width, places in zip((1, 2), self.places):
            n = np.zeros(len(self.known), np.int64)
            for token in tokens(name, width):
                if token in places:
                    n[places[token]] += 1
            common.append(n)
        # An edit spoils one character and at most two bigrams.
        return np.maximum(longer - common[0], -((common[1] - longer + 1) // 2))

    def closest(self, name: str, least_ratio: float = -1.0) -> tuple[float, str] | None:
        """Best (ratio, known) among those of at least ``least_ratio``."""
        longer = np.maximum(np.maximum(self.lengths, len(name)), 1)
        reach = 1 - self.least_distances(name) / longer
        best = None
        for i in np.lexsort((np.arange(len(reach)), -reach)) if len(reach) else ():
            if reach[i] < least_ratio or (best is not None and reach[i] < best[0]):
                break
            ratio = 1 - edit_distance(name, self.known[i]) / int(longer[i])
            if ratio >= least_ratio and (best is None or (-ratio, self.known[i]) < (-best[0], best[1])):
                best = (ratio, self.known[i])
        return best


def _ask(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, known, ratio): names (name, block, least) against the known names (known, block) of their block."""
    sizes = names.groupBy("block").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sliced = names.join(sizes, "block").select("block", F.pmod(F.xxhash64("name"), F.col("slices")).cast("int").alias("slice"), "name", "least")
    copies = known.join(sizes, "block").select(
        F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), "known")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        index = Index(right.column("known").to_pylist())
        asked = zip(left.column("name").to_pylist(), left.column("least").to_pylist())
        rows = [(n, *found) for n, least in asked if (found := index.closest(n, least)) is not None]
        return pa.table({"name": pa.array([r[0] for r in rows], pa.string()), "known": pa.array([r[2] for r in rows], pa.string()),
                         "ratio": pa.array([r[1] for r in rows], pa.float64())})

    return sliced.groupBy("block", "slice").cogroup(copies.groupBy("b", "s")).applyInArrow(match, "name string, known string, ratio double")


def closest(names: DataFrame, known: DataFrame, block: int = 20_000) -> DataFrame:
    """(name, known, ratio): the best known name of every distinct name; ratio = 1 - distance / longer length."""
    spark = names.sparkSession
    ranked = with_global_rank(known.select("known"), [F.length("known"), F.col("known")], "_r", start=0)
    reference = stage(ranked.select("known", F.floor(F.col("_r") / block).cast("int").alias("block")))
    # One row per block, one per length of a name.
    spans = [(r["block"], r["lo"], r["hi"]) for r in reference.groupBy("block").agg(
        F.min(F.length("known")).alias("lo"), F.max(F.length("known")).alias("hi")).orderBy("block").collect()]
    asked = stage(names.select("name", F.length("name").alias("length")))
    routes = []
    for (length,) in asked.select("length").distinct().collect():
        reach = [(1 - max(lo - length, length - hi, 0) / max(1, length, lo if lo > length else 1), b) for b, lo, hi in spans]
        home = max(reach, key=lambda r: (r[0], -r[1]), default=None)
        routes += [(length, b, r, home is not None and b == home[1]) for r, b in reach]
    table = stage(spark.createDataFrame(routes, "length int, block int, reach double, home boolean"))
    first = stage(_ask(asked.join(table.where("home"), "length").select("name", "block", F.lit(-1.0).alias("least")), reference))
    more = (
        asked.join(first, "name").join(table.where("NOT home"), "length").where(F.col("reach") >= F.col("ratio"))
        .select("name", "block", F.col("ratio").alias("least"))
    )
    found = first.unionAll(_ask(more, reference)) if len(spans) > 1 else first
    best = F.min(F.struct((-F.col("ratio")).alias("minus"), F.col("known"))).alias("b")
    return found.groupBy("name").agg(best).select("name", F.col("b.known").alias("known"), (-F.col("b.minus")).alias("ratio"))
