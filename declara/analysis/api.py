"""The questions users ask about documents, topics, clusters and device families.

Inputs are the tables earlier jobs wrote:

* ``documents``  (row_id, declaration, doc_name, family, text, words array<string>, n_words)
* ``weights``    (row_id, topic, weight), topics numbered from 0
* ``assigned``   (row_id, hard_cluster, soft_cluster, cluster_weight)
* ``model``      (cluster, num, cat)
* ``vectors``    (row_id, num), only for the scores of the clustering

Every answer is a DataFrame. An unknown id gives an empty one, or raises with ``strict=True``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.operators import aggregations as A
from declara.operators import clusters as C
from declara.operators import topics as TP
from declara.runtime import draw, stage


def _found(df: DataFrame, strict: bool, what: str) -> DataFrame:
    if strict and df.isEmpty():
        raise ValueError(f"{what} is not known")
    return df


def _section(df: DataFrame, name: str, key: str, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), value.cast("double").alias("value"))


@dataclass
class Corpus:
    documents: DataFrame
    weights: DataFrame
    assigned: DataFrame
    model: DataFrame
    vectors: DataFrame | None = None

    # -- documents --------------------------------------------------------------------

    def document_ids(self) -> DataFrame:
        return self.documents.select("row_id", "declaration", "doc_name")

    def document(self, wanted: str, strict: bool = False) -> DataFrame:
        """Rows whose declaration id or name is ``wanted``; ids repeat, the first row answers."""
        found = self.documents.where((F.col("declaration") == wanted) | (F.col("doc_name") == wanted))
        return _found(found.orderBy("row_id").limit(1), strict, wanted)

    def document_topics(self, wanted: str, k: int = 5, strict: bool = False) -> DataFrame:
        mine = self.document(wanted, strict).select("row_id")
        long = self.weights.join(mine, "row_id", "left_semi")
        return TP.document_topics(long, "row_id", k)

    def document_cluster(self, wanted: str, strict: bool = False) -> DataFrame:
        return self.assigned.join(self.document(wanted, strict).select("row_id"), "row_id", "left_semi")

    def document_complete(self, wanted: str, strict: bool = False) -> DataFrame:
        """Text statistics, best topics and cluster of one document as (section, key, value)."""
        topics = _section(self.document_topics(wanted, 5, strict), "topic", "topic", F.col("weight"))
        cluster = _section(self.document_cluster(wanted), "cluster", "soft_cluster", F.col("cluster_weight"))
        words = _section(self.document(wanted), "words", "doc_name", F.col("n_words"))
        return words.unionByName(topics).unionByName(cluster)

    # -- the topic model -------------------------------------------------------------------

    def _kept(self) -> Corpus:
        """The same corpus, its documents' words found once for several questions about topics."""
        return replace(self, documents=stage(self.documents.select("row_id", "declaration", "words", "n_words")))

    def topic_count(self) -> DataFrame:
        return self.weights.agg(F.count_distinct("topic").alias("topics"))

    def topic_topwords(self, k: int = 20) -> DataFrame:
        return self.topic_wordcloud(k).select("topic", "term", "rank")

    def topic_coherence(self, k: int = 20, top: DataFrame | None = None) -> DataFrame:
        """Mean log conditional probability of the topics' k best words (``top``, if they are known)."""
        top = stage(self.topic_topwords(k)) if top is None else top
        words = self.documents.select("row_id", F.explode(F.array_distinct("words")).alias("term"))
        bag = words.join(top.select("term").distinct(), "term", "left_semi").distinct()  # no other words take part
        return TP.coherence_umass(bag, "row_id", top, "topic").select("topic", "coherence")

    def topic_distances(self, k: int = 20, top: DataFrame | None = None) -> DataFrame:
        return TP.topic_distance(stage(self.topic_topwords(k)) if top is None else top, "topic")

    def topic_model_complete(self, k: int = 20) -> DataFrame:
        """Number, coherence, weights and distances of the topics as (section, key, value)."""
        kept = self._kept()
        top = stage(kept.topic_topwords(k))
        pairs = self.topic_distances(k, top).where("a < b").withColumn("pair", F.concat_ws("|", "a", "b"))
        return (
            _section(self.topic_count().withColumn("key", F.lit("topics")), "nb_topics", "key", F.col("topics"))
            .unionByName(_section(kept.topic_coherence(k, top), "coherence", "topic", F.col("coherence")))
            .unionByName(_section(kept.topic_weights(), "weight", "topic", F.col("weight")))
            .unionByName(_section(pairs, "distance", "pair", F.col("dist")))
        )

    # -- topics --------------------------------------------------------------------------

    def topic_weights(self) -> DataFrame:
        """Topics with their share of the corpus, documents counting by their words, in display order."""
        sized = self.weights.join(self.documents.select("row_id", "n_words"), "row_id")
        return TP.display_order(TP.topic_weight(sized, "n_words"))

    def topic_documents(self) -> DataFrame:
        sized = self.weights.join(self.documents.select("row_id", "declaration", "n_words"), "row_id")
        return TP.topic_documents(sized, "row_id", "declaration", "n_words")

    def topic_wordcloud(self, k: int = 30) -> DataFrame:
        vectors = self.weights.groupBy("row_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("topic", "weight"))), lambda s: s["weight"]).alias("w")
        )
        return TP.expected_top_words(self.documents.select("row_id", "words").join(vectors, "row_id"), "words", "w", k)

    def topic_complete(self, topic: int, strict: bool = False) -> DataFrame:
        kept = self._kept()
        weight = _found(kept.topic_weights().where(F.col("topic") == topic), strict, f"topic {topic}")
        docs = kept.topic_documents().where(F.col("topic") == topic)
        cloud = kept.topic_wordcloud().where(F.col("topic") == topic)
        return _section(weight, "weight", "display", F.col("weight")).unionByName(
            _section(docs, "document", "row_id", F.col("weight"))).unionByName(_section(cloud, "word", "term", F.col("freq")))

    # -- clusters -----------------------------------------------------------------------------

    def cluster_count(self) -> DataFrame:
        return self.model.agg(F.count("*").alias("clusters"))

    def cluster_weights(self) -> DataFrame:
        return A.cluster_weight(self.assigned.select(F.col("hard_cluster").alias("cluster")), "cluster")

    def cluster_documents(self, k: int = 100) -> DataFrame:
        """The k documents of every cluster with the largest membership."""
        named = self.assigned.join(self.documents.select("row_id", "doc_name"), "row_id")
        return A.top_k(named, ["soft_cluster"], [F.round("cluster_weight", 9).desc(), F.col("row_id")], k)

    def cluster_topics(self, threshold: float = 0.1, k: int | None = None) -> DataFrame:
        rows = self.weights.join(self.assigned.select("row_id", F.col("hard_cluster").alias("cluster")), "row_id")
        return TP.cluster_topics(rows, "cluster", threshold, k)

    def cluster_families(self, k: int | None = None) -> DataFrame:
        rows = self.documents.join(self.assigned, "row_id").select(F.col("hard_cluster").alias("cluster"), "family")
        return A.label_distribution(rows, "cluster", "family", k)

    def cluster_wordcloud(self, k: int = 25) -> DataFrame:
        words = self.documents.select("row_id", F.explode("words").alias("term"))
        rows = words.join(self.assigned.select("row_id", F.col("hard_cluster").alias("cluster")), "row_id")
        return A.word_counts(rows, "cluster", "term", k)

    def cluster_scores(self) -> DataFrame:
        """Calinski-Harabasz and Davies-Bouldin of the hard assignment."""
        rows = self.vectors.join(self.assigned.select("row_id", "hard_cluster"), "row_id")
        return C.calinski_davies(rows, "hard_cluster", "num")

    def cluster_axes(self) -> DataFrame:
        """Two principal axes of the centroids."""
        from declara.operators.models import pca_axes

        return pca_axes(self.model, "cluster", "num")

    def cluster_model_complete(self) -> DataFrame:
        """Number, scores, weights and distances of the clusters as (section, key, value)."""
        pairs = self.cluster_distances().where("a < b").withColumn("pair", F.concat_ws("|", "a", "b"))
        scores = self.cluster_scores().unpivot([], ["calinski_harabasz", "davies_bouldin"], "key", "value")
        return (
            _section(self.cluster_count().withColumn("key", F.lit("clusters")), "nb_clusters", "key", F.col("clusters"))
            .unionByName(_section(scores, "score", "key", F.col("value")))
            .unionByName(_section(self.cluster_weights(), "weight", "cluster", F.col("weight")))
            .unionByName(_section(pairs, "distance", "pair", F.col("dist")))
        )

    def cluster_distances(self, kind: str = "mixed") -> DataFrame:
        return C.centroid_pairs(self.model, kind)

    def cluster_complete(self, cluster: int, strict: bool = False) -> DataFrame:
        """Weight, documents, topics, families and words of one cluster as (section, key, value).
        The filter on the cluster reaches the scans of the assignment table."""
        weight = _found(self.cluster_weights().where(F.col("cluster") == cluster), strict, f"cluster {cluster}")
        return (
            _section(weight, "weight", "nb_docs", F.col("weight"))
            .unionByName(_section(self.cluster_documents().where(F.col("soft_cluster") == cluster), "document", "row_id", F.col("cluster_weight")))
            .unionByName(_section(self.cluster_topics().where(F.col("cluster") == cluster), "topic", "topic", F.col("score")))
            .unionByName(_section(self.cluster_families().where(F.col("cluster") == cluster), "family", "family", F.col("score")))
            .unionByName(_section(self.cluster_wordcloud().where(F.col("cluster") == cluster), "word", "term", F.col("n")))
        )

    def compare_clusters(self, a: int, b: int) -> DataFrame:
        """Two cluster summaries side by side."""
        def side(cluster, name):
            return self.cluster_complete(cluster).where(~F.col("section").isin("weight", "document")).withColumnRenamed("value", name)

        return side(a, "a").join(side(b, "b"), ["section", "key"], "full")

    # -- device families ----------------------------------------------------------------------------

    def family_clusters(self, family: str, k: int | None = None, strict: bool = False) -> DataFrame:
        """Clusters in which a family occurs, by its share of the cluster."""
        mine = _found(self.cluster_families().where(F.col("family") == family).drop("rank"), strict, family)
        return A.top_k(mine, ["family"], [F.col("score").desc(), F.col("cluster")], k)

    # -- review ---------------------------------------------------------------------------------------

    def review_sample(self, scores: DataFrame, key: str, value: str, k: int, documents: int, seed: int = 7) -> DataFrame:
        """Topics to review (best, worst, middle band) and a random draw of documents, as (section, key, value)."""
        band = TP.review_band(scores, key, value, k)
        drawn = self.documents.orderBy(draw(seed, "row_id"), "row_id").limit(documents)
        return band.select(F.col("band").alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")).unionByName(
            _section(drawn, "document", "row_id", F.col("n_words")))
