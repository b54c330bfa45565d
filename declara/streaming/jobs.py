"""Arrival of new declarations as Structured Streaming jobs.

Progress lives in the checkpoint folder of each query, so a restarted job skips the files
it has handled; the folders must be shared by all executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from declara.operators import clusters as C
from declara.operators.forms import cda_rows, parse_cda, unwrap_soap


def read_forms(spark: SparkSession, folder: str, one_per_file: bool = True, files_per_batch: int = 10_000) -> DataFrame:
    """Stream of XML forms ``(path, xml)``; the batch size bounds what one trigger takes in."""
    text = spark.readStream.format("text").schema("value string").option("wholetext", one_per_file).option(
        "maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def ingest_forms(forms: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Plain and wrapped forms to key/value rows in a Parquet folder, each file once."""
    opened = unwrap_soap(forms, "path", F.col("xml"))
    parsed = parse_cda(opened, "file", F.col("xml"))
    rows = cda_rows(parsed.select(F.struct("file", "declaration").alias("file"), "title", "tr"))
    flat = rows.select("file.file", "file.declaration", "seq", "key", "value")
    return flat.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()


def skip_seen(declarations: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """First arrival of every declaration id; ids are remembered for ``horizon`` of event time."""
    return declarations.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def count_weeks(assigned: DataFrame, cluster: str, time: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Declarations per week and cluster, whatever order they arrive in. A batch writes what it adds to each week in a folder of
    its own, which a repeated batch rewrites, so no event is lost, none counts twice, and no state grows with the weeks."""

    def save(batch: DataFrame, batch_id: int) -> None:
        weeks = batch.where(F.col(time).isNotNull()).groupBy(F.window(time, "7 days").start.alias("week"), cluster).agg(F.count("*").alias("n"))
        weeks.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return assigned.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(spark: SparkSession, sink: str, cluster: str) -> DataFrame:
    """(week, cluster, n) after all batches that ``count_weeks`` has written."""
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*").groupBy("week", cluster).agg(F.sum("n").alias("n"))


def score_novelty(
    documents: DataFrame, model: DataFrame, num: str, cat: str, delta: float, sink: str, checkpoint: str, gamma: float = 1.0
) -> StreamingQuery:
    """Each batch is scored against one frozen version of the centroids: assignments with a novelty
    flag go to ``assigned`` and the batch's sufficient statistics to ``sums`` and ``cells``, from which
    ``next_version`` builds the following centroid table. The centroids are fetched once, before the first batch."""
    frozen = C.prepared(model)

    def save(batch: DataFrame, batch_id: int) -> None:
        scored = C.assign(batch, frozen, F.col(num), F.col(cat), 2.0, gamma).withColumn("is_new", F.col("cluster_weight") <= delta)
        scored.write.mode("overwrite").parquet(f"{sink}/assigned/batch={batch_id}")
        claimed = batch.sparkSession.read.parquet(f"{sink}/assigned/batch={batch_id}").where(~F.col("is_new"))
        sums, cells = C.statistics_of(claimed, "soft_cluster", num, cat)
        sums.write.mode("overwrite").parquet(f"{sink}/sums/batch={batch_id}")
        cells.write.mode("overwrite").parquet(f"{sink}/cells/batch={batch_id}")

    return documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_version(spark: SparkSession, sink: str, model: DataFrame, stats: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Centroids after all scored batches: old statistics plus what the batches added."""
    sums = spark.read.parquet(f"{sink}/sums/batch=*").select("cluster", "sums", "n")
    cells = spark.read.parquet(f"{sink}/cells/batch=*").select("cluster", "a", "code", "n")
    summed = sums.groupBy("cluster").agg(C.vector_sum("sums").alias("sums"), F.sum("n").alias("n"))
    counted = cells.groupBy("cluster", "a", "code").agg(F.sum("n").alias("n"))
    return C.centroids_of_statistics(C.merge_statistics(stats, (summed, counted)), model)
