"""Streaming jobs run to completion over the driver tables; their sinks are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara.functions import vectors as V
from declara.operators import clusters as C
from declara.plans import views as W
from declara.plans.clustering import ASSIGN_SQL
from declara.plans.forms import CELLS_SQL, _cda
from declara.plans.registry import Tables, query
from declara.plans.views import r6
from declara.runtime import new_path
from declara.streaming import jobs as ST


def _stream(t: Tables, table: str):
    """One table, a file or a folder of files, as a file stream. The stream takes a plain path for
    a folder; a pattern fits both."""
    return t.spark.readStream.schema(getattr(t, table).schema).parquet(f"{t.folder}/{table}.parque[t]")


def _events(t: Tables):
    """The event stream with its zone-less clock read as UTC."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', ts)")
    return _stream(t, "events").withColumn("ts", F.timestamp_seconds(seconds))


@query("st_ingest_forms", f"""
WITH {CELLS_SQL} SELECT 'r' || conv_id AS declaration, key, value, count(*) AS n FROM cells WHERE value <> '' GROUP BY ALL""")
def _(t: Tables):
    inbox, sink = new_path(t.spark, "inbox"), new_path(t.spark, "forms")
    _cda(t).select("xml").write.text(inbox)
    ST.ingest_forms(ST.read_forms(t.spark, inbox, one_per_file=False), sink, new_path(t.spark, "progress")).awaitTermination()
    rows = t.spark.read.schema("file string, declaration string, seq long, key string, value string").parquet(sink)
    return rows.where(F.col("value") != "").groupBy("declaration", "key", "value").agg(F.count("*").alias("n"))


@query("st_skip_seen", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def _(t: Tables):
    sink = new_path(t.spark, "seen")
    # Every event is delivered twice.
    twice = _events(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = ST.skip_seen(twice, "event_id", "ts", "400 days").select("event_id", "event_type")
    kept.writeStream.format("parquet").option("path", sink).option("checkpointLocation", new_path(t.spark, "progress")).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.schema("event_id long, event_type string").parquet(sink)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("st_weekly_cluster_counts", """
SELECT CAST(epoch(ts)::BIGINT // 604800 * 604800 AS BIGINT) AS week, event_type, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts, event_type FROM events) GROUP BY ALL""")
def _(t: Tables):
    sink = new_path(t.spark, "weeks")
    ST.count_weeks(_events(t), "event_type", "ts", sink, new_path(t.spark, "progress")).awaitTermination()
    return ST.weekly_counts(t.spark, sink, "event_type").select(F.unix_timestamp("week").alias("week"), "event_type", "n")


@query("st_score_novelty", f"""
WITH {ASSIGN_SQL}, claimed AS (SELECT soft_cluster AS cluster, count(*) AS added FROM assigned WHERE cluster_weight > 0.105 GROUP BY ALL),
sizes AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label)
SELECT vec_id, soft_cluster, round(cluster_weight, 6) AS cluster_weight, cluster_weight <= 0.105 AS is_new, CAST(n + coalesce(added, 0) AS BIGINT) AS size_after
FROM assigned LEFT JOIN sizes ON sizes.cluster = soft_cluster LEFT JOIN claimed ON claimed.cluster = soft_cluster""")
def _(t: Tables):
    corpus = W.vectors(t).withColumn("cat", C.no_categories())
    model = C.centroid_table(corpus, "label", "num")
    stream = _stream(t, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("num"), C.no_categories().alias("cat"))
    sink = new_path(t.spark, "scored")
    ST.score_novelty(stream, model, "num", "cat", 0.105, sink, new_path(t.spark, "progress")).awaitTermination()
    after = ST.next_version(t.spark, sink, model, C.statistics_of(corpus, "label", "num", "cat"))
    rows = t.spark.read.parquet(f"{sink}/assigned/batch=*")
    sizes = after.select(F.col("cluster").alias("soft_cluster"), F.col("n").alias("size_after"))
    return rows.join(sizes, "soft_cluster").select("vec_id", "soft_cluster", r6("cluster_weight").alias("cluster_weight"), "is_new", "size_after")
