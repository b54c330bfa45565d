"""Exact quantiles that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declara.runtime import stage

SMALL = 10_000  # distinct values of a group that one task may order
PARTS = 256  # parts into which a bracket is cut in a round


def _brackets(rows: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys…, _n, rank, lo, hi): a first bracket for every order statistic asked for, from a mergeable sketch."""
    margin = 2.0 / SMALL
    around = [b for q in quantiles for b in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", around, SMALL).alias("_b")
    )
    asked = []
    for i, q in enumerate(quantiles):
        whole = F.col("_n") <= SMALL
        low = F.when(whole | F.lit(q - margin <= 0), F.col("_min")).otherwise(F.col("_b")[2 * i])
        high = F.when(whole | F.lit(q + margin >= 1), F.col("_max")).otherwise(F.col("_b")[2 * i + 1])
        position = F.lit(q) * (F.col("_n") - 1)
        asked += [F.struct(rank.cast("long").alias("rank"), low.alias("lo"), high.alias("hi")) for rank in (F.floor(position), F.ceil(position))]
    return sketch.select(*keys, "_n", "_min", "_max", F.explode(F.array(*asked)).alias("_x")).select(
        *keys, "_n", "_min", "_max", "_x.*").dropDuplicates([*keys, "rank"])  # two quantiles may ask for one rank


def _narrowed(rows: DataFrame, keys: list[str], states: DataFrame) -> DataFrame:
    """Every bracket shrunk to the part that holds its rank: one pass, counted map-side. A rank outside its bracket
    starts again from the whole group."""
    ratio = (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS
    part = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") <= F.col("lo"), 0).when(
        F.isnan(ratio) | (ratio >= PARTS), PARTS - 1).otherwise(F.floor(ratio)).cast("int")
    # staged by the caller, so that a small table of states meets the rows without moving them
    counted = rows.join(states, keys).where(F.col("_v") <= F.col("hi")).groupBy(*keys, "_n", "_min", "_max", "rank", "lo", "hi", part.alias("_part")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    order = Window.partitionBy(*keys, "rank", "lo", "hi").orderBy("_part")
    upto = counted.withColumn("_upto", F.sum("_c").over(order))
    holds = (F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank"))
    hit = F.max(F.when(holds & (F.col("_part") >= 0), F.struct("_first", "_last", "_c", (F.col("_upto") - F.col("_c")).alias("below")))).alias("_h")
    found = upto.groupBy(*keys, "_n", "_min", "_max", "rank", "lo", "hi").agg(hit)
    missed = F.col("_h").isNull()
    return found.select(
        *keys, "_n", "_min", "_max", "rank", F.when(missed, F.col("_min")).otherwise(F.col("_h._first")).alias("lo"),
        F.when(missed, F.col("_max")).otherwise(F.col("_h._last")).alias("hi"), F.when(missed, 0).otherwise(F.col("_h.below")).alias("below"),
        F.when(missed, F.col("_n")).otherwise(F.col("_h._c")).alias("inside"),
    )


def exact_quantiles(df: DataFrame, group: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group: one row ``(group…, q, quantile)``.

    A sketch brackets every order statistic asked for. As long as a bracket holds more than SMALL rows it is cut into
    PARTS parts, whose rows are counted map-side, and shrinks to the part that holds the rank - down to a
    single value in the end, whatever the distribution. Only then are the values of a bracket ordered. A rank that its
    bracket does not cover starts again from the whole group, and is an error if that does not cover it either.
    """
    keys = group or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*(group or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    states = stage(_brackets(rows, keys, quantiles).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("_n"))
                   .withColumn("sure", F.col("_n") <= SMALL))
    open_ = ~F.col("sure") | ((F.col("inside") > SMALL) & (F.col("lo") < F.col("hi")))
    before = None
    while (now := states.agg(F.max(F.when(open_, F.col("inside"))), F.sum(F.when(open_, F.col("inside")))).first())[0] is not None:
        if before is not None and now == before and states.where(open_ & (F.col("lo") == F.col("_min")) & (F.col("hi") == F.col("_max"))).isEmpty():
            raise RuntimeError("a quantile's bracket does not shrink")
        before = now
        closed = states.where(~open_)
        states = stage(closed.unionByName(_narrowed(rows, keys, states.where(open_).drop("below", "inside", "sure")).withColumn("sure", F.lit(True))))
    inside = rows.join(states, keys).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    counted = inside.groupBy(*keys, "_n", "rank", "below", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys, "rank").orderBy("_v")
    upto = counted.withColumn("_upto", F.sum("_c").over(order) + F.col("below"))
    at = F.max(F.when((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank")), F.col("_v"))).alias("_x")
    found = stage(upto.groupBy(*keys, "_n", "rank").agg(at))
    values = found.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.coalesce("_x", F.raise_error(F.lit("a quantile's rank is not covered")).cast("double"))))).alias("_values"))
    out = []
    for q in quantiles:
        position = F.lit(q) * (F.col("_n") - 1)
        low, high = (F.element_at("_values", rank.cast("long")) for rank in (F.floor(position), F.ceil(position)))
        between = F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))
        out.append(F.struct(F.lit(q).alias("q"), between.alias("quantile")))
    return values.select(*group, F.inline(F.array(*out)))


def quantile_column(df: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """One exact quantile per group as a table ``(group…, name)``."""
    return exact_quantiles(df, group, value, [q]).select(*group, F.col("quantile").alias(name))


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max per group."""
    quartiles = exact_quantiles(df, group, value, [0.25, 0.5, 0.75])
    basics = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    wide = quartiles.groupBy(*group).agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    if not group:
        return basics.select(
            "*", *[wide.select(n).scalar().alias(n) for n in ("q25", "q50", "q75")]
        )
    return basics.join(wide, group)
