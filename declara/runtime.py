"""The few places where the library touches the cluster itself: lineage cuts,
checked model sizes and numbering of a distributed order."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A model table (centroids, projections) may reach the tasks as a broadcast
# variable only in blocks of at most this many numbers (64 MB of doubles).
MODEL_BLOCK_VALUES = 8_000_000

# Join keys that hold at least 1/HOT_KEYS of all rows: there can be at most
# HOT_KEYS of them, whatever the size of the data.
HOT_KEYS = 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by the session in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="declara-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_SHIPPED: set[str] = set()  # applications that have the package


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they may have been started where
    it is not on their path, and functions that run in Python there are imported by name."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="declara-package-"), "declara.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder: it survives lost executors,
    and its size is known to the planner, so a small one is broadcast and a large one is not."""
    path = new_path(df.sparkSession, "stage")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def is_staged(df: DataFrame) -> bool:
    """Whether reading ``df`` again is no more than reading a staged table."""
    return hasattr(df, "_staged")


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table._staged)


_REMOVING, _LOCK, REMOVE_SHUFFLES = [], threading.Lock(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query of this block shuffles is deleted when the query ends; else it stays until the driver collects its garbage."""
    with _LOCK:
        _REMOVING.append(_REMOVING[0] if _REMOVING else spark.conf.get(REMOVE_SHUFFLES))
        spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _REMOVING.pop()
            if not _REMOVING:  # blocks of other threads may still run
                spark.conf.set(REMOVE_SHUFFLES, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``new_path`` that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan out to all cores when it has fewer splits than the cluster has
    cores, as for one file with few row groups. Scans with enough splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def draw(seed: int, *columns: str) -> Column:
    """A digest to order random draws by: the same in every engine and every attempt of a task."""
    return F.md5(F.concat_ws(":", F.lit(seed), *columns))


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Number all rows by ``order`` (which must be total) without one task seeing them all.

    The sort is a range partitioning; each partition is numbered on its own and
    shifted by the sizes of the partitions before it (one row per partition).
    """
    placed = stage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, (inside + F.col("_offset") + F.lit(start - 1)).cast("long"))
        .drop("_part", "_offset")
    )


def with_global_cumsum(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running totals over a global order, computed range by range like ``with_global_rank``."""
    placed = stage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    offsets = offsets.select(
        "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, "_part")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"_o_{n}"))
    return out.drop("_part", *[f"_o_{n}" for n in sums])


def skew_safe_lookup(
    left: DataFrame, lookup: DataFrame, keys: list[str], count: str, spread: Column, inner: bool = True
) -> DataFrame:
    """Join ``left`` to a table with unique ``keys`` whose column ``count`` says how many
    left rows each key has.

    Keys holding at least 1/HOT_KEYS of all rows (at most HOT_KEYS of them, so a
    proven bound) are joined map-side; the rest go through a shuffle in which the
    rows already served are spread by ``spread`` instead of piling up on their key.
    """
    values = [c for c in lookup.columns if c not in keys]
    lookup = stage(lookup)  # read three times below
    total = lookup.select(F.sum(count).alias("t"))
    is_hot = F.col(count) >= total.scalar() / F.lit(HOT_KEYS)
    hot = lookup.where(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    # always 0, but no constant: a literal would be folded and the salt would not be a join key
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    cold = lookup.where(~is_hot).select(*keys, zero.alias("_salt"), F.struct(*values).alias("_cold"))
    served = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise((1 + F.pmod(spread, F.lit(1024))).cast("int"))
    )
    joined = served.join(cold, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    if inner:
        joined = joined.where(found.isNotNull())
    return joined.select(*left.columns, *[found[v].alias(v) for v in values])
