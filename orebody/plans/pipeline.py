"""The whole analysis: sample, cluster, relate, classify, detect, reason, report; and runs of it."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions.columns import usable
from orebody.operators import anomalies, cluster, reasoning, relations, taxonomy
from orebody.operators.current import latest_rows
from orebody.operators.report import Report, pairs_with_reasoning, store_findings, with_reasoning
from orebody.operators.sampling import capped, random_sample, sample
from orebody.sources.batches import RunBatches
from orebody.sources.payload import ledger, normalise_payload, read_payloads, read_points, stamp, unprocessed
from orebody.sources.settings import RunConfig, interval_seconds
from orebody.workspace import materialise, released


def chosen(points: DataFrame, config: RunConfig) -> DataFrame:
    """The points to analyse: current, usable, sampled. A diverse sample is chosen from a pool half as large again."""
    now = latest_rows(points) if "seq" in points.columns else points
    now = now.where(usable("embedding", None))
    if config.strategy == "diverse" and config.sample_size:
        now = random_sample(now, config.pool_size(), config.seed)
    return capped(sample(now, config.sample_size, config.strategy, config.seed), config.topology_cap, seed=config.seed)


def analyse(points: DataFrame, config: RunConfig) -> Report:
    """Report over the current points with usable vectors; the reasoner, if there is one, names clusters and bridges and explains them and moats."""
    config.validate()
    now = materialise(chosen(points, config), "sampled")
    if "seq" not in now.columns:
        now = now.withColumn("seq", F.col("id").cast("long"))
    members = cluster.cluster_members(now, config.epsilon, config.min_pts, config.reduce_to)
    clusters = materialise(cluster.describe_clusters(members), "clusters")
    if config.reasoner is not None and config.semantic_labels:
        clusters = materialise(reasoning.named(clusters, members, config.reasoner), "named")
    pairs = materialise(relations.cluster_pairs(clusters), "pairs")
    bridges = relations.bridges(pairs).withColumn("label", F.lit(None).cast("string"))
    bridges = materialise(relations.with_support(relations.with_links(bridges, relations.sample_links(bridges, members))), "bridges")
    moats = materialise(relations.moats(pairs), "moats")
    spark = points.sparkSession
    told = spark.createDataFrame([], reasoning.FINDINGS)
    if config.reasoner is not None:
        told = materialise(reasoning.findings(clusters, bridges, moats, members, config.reasoner), "told")
        ends = told.withColumns({"cluster_id": F.col("clusters")[0], "cluster_a": F.col("clusters")[0], "cluster_b": F.try_element_at("clusters", F.lit(2))})
        clusters = reasoning.promote_clusters(clusters, ends.where("type = 'cluster_analysis'"))
        bridges = reasoning.promote_bridges(bridges, ends.where("type = 'bridge_analysis'"))
    clusters = materialise(taxonomy.classify_clusters(clusters, members), "classified")
    odd = materialise(anomalies.all_findings(clusters, bridges, members), "anomalies")
    findings = materialise(told.unionByName(anomalies.as_findings(odd)), "findings")
    return Report(
        findings=findings, members=members.select("cluster_id", "id"), clusters=with_reasoning(clusters, findings), bridges=pairs_with_reasoning(bridges, findings, "bridge_analysis"),
        moats=pairs_with_reasoning(moats, findings, "moat_analysis"), anomalies=odd,
    )


@dataclass
class Run:
    """What a run has written: its id, the folder of its report, and the number of points analysed."""

    run_id: str
    report: str
    points: int


def run_once(spark: SparkSession, config: RunConfig) -> Run:
    """Extract, analyse, write the report, store the findings and stamp the points; each step replaces what the same run wrote before.

    An incremental run takes points without a stamp only. Points are stamped last, so those of a run that
    failed are taken again.
    """
    config.validate()
    run_id = time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + "-" + uuid.uuid4().hex[:6]
    points = normalise_payload(read_payloads(spark, config.source, config.strict), config.vector_name, config.vector_combine) if config.payload else read_points(spark, config.source, strict=config.strict)
    stamps = f"{config.output_dir}/ledger"
    if config.incremental:
        points = unprocessed(points, ledger(spark, stamps))
    batches = RunBatches(spark, run_id)
    try:
        with released():
            batches.store(0, points)
            taken = batches.load()
            made = analyse(taken, config)
            folder = made.write(f"{config.output_dir}/{run_id}")
            made.write_json(f"{folder}/report.json", config.source, run_id)
            store_findings(made.findings, f"{config.output_dir}/findings", run_id, made.members)
            done = chosen(taken, config).select("id") if config.sample_size else taken.select("id")
            stamp(done, stamps, run_id)
            return Run(run_id, folder, done.distinct().count())
    finally:
        batches.delete()


def watch(job: Callable[[], object], every: str, cycles: int = 0, stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run ``job`` again and again, ``every`` so long after it ended; a cycle that fails doesn't stop the next. Returns the cycles that succeeded."""
    pause, cycle, good = interval_seconds(every), 0, 0
    while not stopped():
        cycle += 1
        try:
            job()
            good += 1
        except Exception as e:
            print(f"cycle {cycle} failed: {e}", file=sys.stderr)
        if cycles and cycle >= cycles:
            break
        sleep(pause)
    return good
