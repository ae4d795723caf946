"""Anomaly detectors; each gives rows of one schema, told apart by type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["type", "cluster_id", "subject", "measure", "detail", "requires_review"]


def _finding(df: DataFrame, kind: str, measure: Column | None = None, detail: Column | None = None, review: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"), "cluster_id", F.col("label").alias("subject"), (F.lit(None) if measure is None else measure).cast("double").alias("measure"),
        (F.lit("") if detail is None else detail).alias("detail"), (F.lit(False) if review is None else review).alias("requires_review"),
    )


def low_coherence(clusters: DataFrame, below: float = 0.5) -> DataFrame:
    return _finding(clusters.where(F.col("coherence") < below), "coherence_anomaly", F.col("coherence"))


def unusual_density(clusters: DataFrame, low: float = 0.3, high: float = 0.95) -> DataFrame:
    odd = clusters.where((F.col("density") < low) | (F.col("density") > high))
    return _finding(odd, "density_anomaly", F.col("density"), F.when(F.col("density") < low, "low").otherwise("high"))


def orphans(clusters: DataFrame, bridges: DataFrame) -> DataFrame:
    """Clusters at no end of any bridge."""
    ends = bridges.select(F.explode(F.array("cluster_a", "cluster_b")).alias("cluster_id")).distinct()
    return _finding(clusters.join(ends, "cluster_id", "left_anti"), "orphan_cluster")


def _sources(members: DataFrame, blank: str | None) -> DataFrame:
    """``(cluster_id, source, n)``; with ``blank`` the name that null and empty sources get."""
    source = F.col("source") if blank is None else F.when(F.trim(F.coalesce("source", F.lit(""))) == "", blank).otherwise(F.col("source"))
    return members.select("cluster_id", source.alias("s")).groupBy("cluster_id", F.col("s").alias("source")).agg(F.count("*").alias("n"))


def contradictions(clusters: DataFrame, members: DataFrame, coherence: float = 0.8, sources: int = 3) -> DataFrame:
    """Coherent clusters fed by many sources; an empty source is one, a null isn't."""
    per = _sources(members, None).where("source is not null").groupBy("cluster_id").agg(F.count("*").alias("k"), F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("names"))
    found = clusters.where(F.col("coherence") > coherence).join(per.where(F.col("k") > sources), "cluster_id")
    return _finding(found, "source_contradiction", F.col("k"), F.col("names"), F.lit(False))


def label_mismatches(clusters: DataFrame) -> DataFrame:
    found = clusters.where(F.coalesce(F.col("taxonomy.label_warning"), F.lit("")) != "")
    return _finding(found, "label_mismatch", None, F.col("taxonomy.label_warning"), F.lit(True))


def oversampling(clusters: DataFrame, members: DataFrame, above: float = 0.7, review: float = 0.9) -> DataFrame:
    """One of several sources holds most of a cluster."""
    per = _sources(members, "unknown").groupBy("cluster_id").agg(F.count("*").alias("k"), (F.max("n") / F.sum("n")).alias("top"), F.max_by("source", F.struct("n", "source")).alias("s"))
    found = clusters.join(per.where((F.col("k") >= 2) & (F.col("top") > above)), "cluster_id")
    return _finding(found, "source_oversampling", F.col("top"), F.col("s"), F.col("top") > review)


def summary_artifacts(clusters: DataFrame) -> DataFrame:
    """Labels that only repeat the topic of summarising text."""
    topic = F.col("taxonomy.topic")
    ok = (F.col("taxonomy.mode") == "meta_descriptive_summary") & (topic != "") & (topic != "general") & F.contains(F.lower("label"), F.split(topic, "_")[0])
    return _finding(clusters.where(F.coalesce(ok, F.lit(False))), "summary_template_artifact", None, topic)


def embedding_bias(clusters: DataFrame, members: DataFrame, density: float = 0.95) -> DataFrame:
    """Very dense clusters of a single source."""
    per = _sources(members, "unknown").groupBy("cluster_id").agg(F.count("*").alias("k"), F.first("source").alias("s"))
    return _finding(clusters.where(F.col("density") > density).join(per.where("k = 1"), "cluster_id"), "embedding_bias_suspected", F.col("density"), F.col("s"))


def all_findings(clusters: DataFrame, bridges: DataFrame, members: DataFrame, coherence: float = 0.5, low: float = 0.3, high: float = 0.95, oversampled: float = 0.7) -> DataFrame:
    """Rows of all detectors, at the given thresholds."""
    parts = [
        low_coherence(clusters, coherence), unusual_density(clusters, low, high), orphans(clusters, bridges), contradictions(clusters, members),
        label_mismatches(clusters), oversampling(clusters, members, oversampled), summary_artifacts(clusters), embedding_bias(clusters, members, high),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


SAYS = {
    "coherence_anomaly": "the points hardly point one way; views that contradict each other may lie together", "density_anomaly": "the points lie unusually far apart, or so close that they may be copies",
    "orphan_cluster": "nothing bridges this cluster and any other", "source_contradiction": "many sources say nearly the same", "label_mismatch": "the label names something else than the content",
    "source_oversampling": "one source holds most of the cluster", "summary_template_artifact": "summaries of a topic, not the topic itself", "embedding_bias_suspected": "one source, very dense",
}


def as_findings(found: DataFrame) -> DataFrame:
    """Anomalies in the form of findings, with what their kind means and the detail as chain."""
    says = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in SAYS.items()])
    chain = F.concat_ws(": ", says, F.nullif("detail", F.lit("")))
    return found.select("type", "subject", chain.alias("reasoning_chain"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("is_anomaly"), "requires_review", F.array(F.col("cluster_id").cast("int")).alias("clusters"))


def anomaly_score(kind: str = "type", coherence: str = "coherence", density: str = "density") -> Column:
    return (
        F.when(F.col(kind) == "coherence_anomaly", 1 - F.col(coherence)).when(F.col(kind) == "density_anomaly", F.abs(F.col(density) - 0.7))
        .when(F.col(kind) == "orphan_cluster", 0.9).when(F.col(kind) == "source_contradiction", 0.95).otherwise(0.5)
    )
