"""Command line: ``python -m orebody run|query|search|export``."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from orebody.operators.reasoning import HttpReasoner, OfflineReasoner
from orebody.operators.report import Report, export, listed, search
from orebody.operators.taxonomy import matches
from orebody.plans.pipeline import run_once, watch
from orebody.sources.settings import RunConfig, load_env
from orebody.workspace import ship_package


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="orebody")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="analyse stored points")
    run.add_argument("source")
    run.add_argument("--output", default="./findings")
    run.add_argument("--sample", type=int, default=0, help="points to analyse; 0 takes all")
    run.add_argument("--strategy", default="random", help="random, stratified, proportional, diverse or temporal")
    run.add_argument("--seed", type=int, default=42)
    run.add_argument("--epsilon", type=float, default=0.3)
    run.add_argument("--min-cluster-size", type=int, default=5)
    run.add_argument("--pca-dims", type=int, default=50)
    run.add_argument("--topology-cap", type=int, default=0, help="most points to cluster; 0 has no cap")
    run.add_argument("--payload", action="store_true", help="the source holds raw payloads as JSON lines")
    run.add_argument("--vector-name", default="")
    run.add_argument("--vector-combine", action="store_true")
    run.add_argument("--strict", action="store_true", help="fail on malformed input")
    run.add_argument("--incremental", action="store_true", help="only points without a stamp")
    run.add_argument("--watch", default="", help="run again so long after each run, such as 5m")
    run.add_argument("--cycles", type=int, default=0, help="with --watch: end after so many runs")
    run.add_argument("--semantic-labels", action="store_true")
    run.add_argument("--offline-reasoner", action="store_true")
    run.add_argument("--reasoner-url", default="", help="chat-completions endpoint; its key is read from OREBODY_REASONER_KEY")
    run.add_argument("--reasoner-model", default="")
    query = commands.add_parser("query", help="clusters of a report by taxonomy")
    query.add_argument("report")
    for name in ("topic", "mode", "posture"):
        query.add_argument(f"--{name}", default="")
    query.add_argument("--mismatch", action="store_true")
    find = commands.add_parser("search", help="entries of a report that contain a text")
    find.add_argument("report")
    find.add_argument("text")
    out = commands.add_parser("export", help="a table of a report as one JSON file")
    out.add_argument("report")
    out.add_argument("table", choices=Report.TABLES)
    out.add_argument("--folder", default="./exports")
    return parser


def settings(a: argparse.Namespace) -> RunConfig:
    reasoner = None
    if a.reasoner_url:
        reasoner = HttpReasoner(a.reasoner_url, os.environ.get("OREBODY_REASONER_KEY", ""), a.reasoner_model)
    elif a.offline_reasoner:
        reasoner = OfflineReasoner()
    return RunConfig(
        source=a.source, output_dir=a.output, sample_size=a.sample, strategy=a.strategy, seed=a.seed, epsilon=a.epsilon, min_pts=a.min_cluster_size, reduce_to=a.pca_dims,
        topology_cap=a.topology_cap, payload=a.payload, vector_name=a.vector_name, vector_combine=a.vector_combine, strict=a.strict, incremental=a.incremental,
        trigger_interval=a.watch, semantic_labels=a.semantic_labels, reasoner=reasoner,
    ).validate()


def main(argv: list[str] | None = None) -> int:
    load_env(".env")
    a = arguments().parse_args(argv)
    config = settings(a) if a.command == "run" else None
    spark = SparkSession.builder.appName("orebody").getOrCreate()
    ship_package(spark)
    if config is not None:

        def job() -> None:
            done = run_once(spark, config)
            print(f"{done.points} points analysed in run {done.run_id}")
            print(Report.read(spark, done.report).markdown(config.source))

        if config.trigger_interval:
            return 0 if watch(job, config.trigger_interval, a.cycles) else 1
        job()
        return 0
    report = Report.read(spark, a.report)
    if a.command == "export":
        print(export(report.tables[a.table], a.folder, a.table, time.strftime("%Y%m%dT%H%M%S", time.gmtime())))
        return 0
    if a.command == "query":
        rows = listed(report.tables["clusters"].where(matches(a.topic, a.mode, a.posture, a.mismatch))).toJSON()
    else:
        rows = search(report.tables["clusters"], report.tables["bridges"], report.tables["anomalies"], a.text).toJSON()
    for r in rows.toLocalIterator():
        print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
