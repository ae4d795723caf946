"""Findings as tables, reports and exports, and the queries over a report."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.workspace import materialise

WITH_MEMBERS = ("cluster_analysis", "bridge_analysis", "density_anomaly", "coherence_anomaly")
SORTS = ("coherence", "density", "size", "cluster_id")


def subject_clusters(subject: str | Column = "subject") -> Column:
    """Ids named by subjects such as "Cluster 3: label" or "Bridge: 3 ↔ 5"; an empty array for others."""
    c = F.col(subject) if isinstance(subject, str) else subject
    one, pair = F.regexp_extract(c, r"^Cluster (\d+):", 1), [F.regexp_extract(c, r"^(?:Bridge|Moat): (\d+) [↔⊥] (\d+)", i) for i in (1, 2)]
    none = F.array().cast("array<int>")
    return F.when(one != "", F.array(one.cast("int"))).when(pair[0] != "", F.array(*[p.cast("int") for p in pair])).otherwise(none)


def finding_cluster(subject: str = "subject", clusters: str = "clusters") -> Column:
    """The cluster a finding is about: named by its subject, else the first listed, else 0. A moat is about no cluster."""
    pair_of_moat = F.col(subject).contains("⊥")
    named = F.when(~pair_of_moat, F.get(subject_clusters(subject), F.lit(0)))
    return F.coalesce(F.nullif(named, F.lit(0)), F.get(F.col(clusters), F.lit(0)), F.lit(0))


def with_reasoning(clusters: DataFrame, findings: DataFrame) -> DataFrame:
    """Clusters with ``reasoning`` of the finding about each (empty without one), ``is_anomaly`` if that says so, and ``has_anomaly`` if any finding does."""
    own = findings.where("type = 'cluster_analysis'").select(F.get(subject_clusters(), F.lit(0)).alias("cluster_id"), "reasoning_chain", "is_anomaly").where("cluster_id > 0")
    own = own.groupBy("cluster_id").agg(F.min("reasoning_chain").alias("reasoning"), F.bool_or("is_anomaly").alias("is_anomaly"))
    odd = findings.where("is_anomaly").select(finding_cluster().alias("cluster_id")).distinct().withColumn("has_anomaly", F.lit(True))
    joined = clusters.drop("reasoning", "is_anomaly", "has_anomaly").join(own, "cluster_id", "left").join(odd, "cluster_id", "left")
    return joined.withColumns({"reasoning": F.coalesce("reasoning", F.lit("")), "is_anomaly": F.coalesce("is_anomaly", F.lit(False)), "has_anomaly": F.coalesce("has_anomaly", F.lit(False))})


def pairs_with_reasoning(pairs: DataFrame, findings: DataFrame, kind: str) -> DataFrame:
    """Bridges or moats with ``reasoning`` of the finding of that kind about their pair, whichever way round."""
    ends = lambda f: f("cluster_a", "cluster_b")
    about = findings.where(F.col("type") == kind).withColumn("__e", F.sort_array(subject_clusters())).where(F.size("__e") == 2)
    chains = about.groupBy(F.col("__e")[0].alias("__lo"), F.col("__e")[1].alias("__hi")).agg(F.min("reasoning_chain").alias("reasoning"))
    joined = pairs.drop("reasoning").join(chains, (ends(F.least) == F.col("__lo")) & (ends(F.greatest) == F.col("__hi")), "left")
    return joined.drop("__lo", "__hi").withColumn("reasoning", F.coalesce("reasoning", F.lit("")))


def projected_anomalies(findings: DataFrame) -> DataFrame:
    """The findings that are anomalies, each with the cluster it is about (0 if there is none)."""
    return findings.where("is_anomaly").withColumn("cluster_id", finding_cluster())


def summary(clusters: DataFrame, bridges: DataFrame, moats: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row with the number of each."""
    parts = [d.agg(F.count("*").alias(n)) for n, d in (("clusters", clusters), ("bridges", bridges), ("moats", moats), ("anomalies", anomalies))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


def search(clusters: DataFrame, bridges: DataFrame, anomalies: DataFrame, text: str) -> DataFrame:
    """``(kind, place, title)`` whose title or reasoning contains the text, whatever its case; an empty text finds all."""
    hit = lambda *cs: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in cs))
    link = F.format_string("Cluster %d ↔ %d (%s)", "cluster_a", "cluster_b", "link_type")
    own = lambda d: F.col("reasoning") if "reasoning" in d.columns else F.lit("")
    found = [
        clusters.where(hit(F.col("label"), own(clusters))).select(F.lit("cluster").alias("kind"), F.lit(0).alias("place"), F.col("label").alias("title")),
        bridges.where(hit(link, own(bridges))).select(F.lit("bridge").alias("kind"), F.lit(1).alias("place"), link.alias("title")),
        anomalies.where(hit(F.col("subject"), own(anomalies))).select(F.lit("anomaly").alias("kind"), F.lit(2).alias("place"), F.col("subject").alias("title")),
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


def listed(clusters: DataFrame, by: str = "coherence", descending: bool = True, anomalies: DataFrame | None = None) -> DataFrame:
    """Clusters in the order of a field, ties by id; with ``anomalies`` only those that have one."""
    if by not in SORTS:
        raise ValueError(f"sort by one of {SORTS}")
    if anomalies is not None:
        clusters = clusters.join(anomalies.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return clusters.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), "cluster_id")


def with_places(ordered: DataFrame) -> DataFrame:
    """``ordered`` (a sorted table) with ``place`` of each row from 1; sorted parts are counted, no task holds all rows."""
    rows = materialise(ordered.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "listed")
    starts, before = [], 0
    for part, n in sorted((r[0], r[1]) for r in rows.groupBy("__p").count().collect()):  # a row a partition
        starts.append((part, before))
        before += n
    starts = ordered.sparkSession.createDataFrame(starts, "__p int, __start long")
    within = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "__p").withColumn("place", (F.col("__start") + within + 1).cast("int")).drop("__p", "__i", "__start")


def titled(df: DataFrame, clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Add ``title``: the cluster's label, or # and its id."""
    names = clusters.select(F.col("cluster_id").alias("__c"), F.col("label").alias("__l"))
    return df.join(names, F.col(cluster) == F.col("__c"), "left").withColumn("title", F.coalesce("__l", F.concat(F.lit("#"), F.col(cluster).cast("string")))).drop("__c", "__l")


def finding_members(findings: DataFrame, members: DataFrame) -> DataFrame:
    """``(finding_id, member_id)``: distinct members of a finding's clusters, for the kinds that carry members.

    A row a member, so that a huge cluster needs no huge array.
    """
    rows = findings.where(F.col("type").isin(*WITH_MEMBERS)).select("finding_id", F.explode("clusters").alias("cluster_id"))
    return rows.join(members.select("cluster_id", F.col("id").alias("member_id")), "cluster_id").select("finding_id", "member_id").distinct()


def numbered(findings: DataFrame, run_id: str) -> DataFrame:
    """Findings with ``finding_id`` from their run, kind and subject; the same finding has the same id."""
    return findings.withColumn("finding_id", F.concat_ws("-", F.lit(run_id), F.sha2(F.concat_ws("\u0001", "type", "subject", F.col("clusters").cast("string")), 256).substr(1, 16)))


def store_findings(findings: DataFrame, path: str, run_id: str, members: DataFrame | None = None) -> None:
    """Add findings under their run, and the members of their clusters as rows of their own; a repeated run replaces its own."""
    rows = numbered(findings, run_id)
    tables = {"findings": rows.withColumns({"stored_at": F.current_timestamp(), "clusters_text": F.array_join(F.col("clusters").cast("array<string>"), ",")})}
    if members is not None:
        ends = F.when(F.size("clusters") > 0, F.col("clusters")).otherwise(subject_clusters())
        tables["members"] = finding_members(rows.withColumn("clusters", ends), members)
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def write_text(spark: SparkSession, path: str, pieces) -> str:
    """Pieces of text, one after another, as one file of whatever file system the path is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out = jvm.java.io.BufferedWriter(jvm.java.io.OutputStreamWriter(stream, "UTF-8"))
    for p in pieces:
        out.write(p)
    out.close()
    return path


def _items(df: DataFrame):
    """The rows as JSON texts with commas between, a partition at a time."""
    for i, row in enumerate(df.toJSON().toLocalIterator()):
        yield (",\n" if i else "") + row


class Report:
    """Tables of one analysis below a folder: written as Parquet, and as one JSON document and Markdown for readers."""

    TABLES = ("clusters", "bridges", "moats", "anomalies")

    def __init__(self, findings: DataFrame | None = None, members: DataFrame | None = None, **tables: DataFrame):
        self.tables = {n: tables[n] for n in self.TABLES}
        self.findings, self.members = findings, members

    def write(self, folder: str) -> str:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return folder

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Report:
        return cls(**{n: spark.read.parquet(f"{folder}/{n}") for n in cls.TABLES})

    def joined(self) -> dict[str, DataFrame]:
        """The tables with the reasoning about their rows, and anomalies of all findings."""
        if self.findings is None:
            return self.tables
        clusters = with_reasoning(self.tables["clusters"], self.findings)
        bridges, moats = (pairs_with_reasoning(self.tables[n], self.findings, k) for n, k in (("bridges", "bridge_analysis"), ("moats", "moat_analysis")))
        return {"clusters": clusters, "bridges": bridges, "moats": moats, "anomalies": projected_anomalies(self.findings)}

    def write_json(self, path: str, collection: str, stamp: str) -> str:
        """One document: stamp, collection, totals, and every row of the joined tables."""
        tables = self.joined()
        spark = self.tables["clusters"].sparkSession
        totals = summary(**tables).first().asDict()

        def pieces():
            yield json.dumps({"timestamp": stamp, "collection": collection, "summary": {f"total_{k}": v for k, v in totals.items()}}, ensure_ascii=False)[:-1]
            for name, df in tables.items():
                yield f', "{name}": [\n'
                yield from _items(df)
                yield "\n]"
            yield "}\n"

        return write_text(spark, path, pieces())

    def markdown(self, collection: str, most: int | None = None) -> str:
        """The report in words, with the reasoning about each entry; ``most`` limits the entries of a list, totals are of all."""
        tables = self.joined()
        total = summary(**tables).first().asDict()
        lines = [f"# Findings of {collection}", "", *(f"- {n}: {v}" for n, v in total.items()), "", "## Clusters", ""]
        some = lambda df: (df if most is None else df.limit(most)).toLocalIterator()

        def told(r) -> list[str]:
            text = (r.reasoning or "").strip() if "reasoning" in r else ""
            return [f"  > {line}" for line in text.splitlines()]

        for r in some(listed(tables["clusters"])):
            lines += [f"- **{r.cluster_id}** {r.label}: {r.size or 0} points, coherence {r.coherence or 0:.2f}, density {r.density or 0:.2f}", *told(r)]
        lines += ["", "## Bridges", ""]
        for r in some(tables["bridges"].orderBy(F.desc("strength"), "cluster_a", "cluster_b")):
            lines += [f"- {r.cluster_a} ↔ {r.cluster_b}: {r.strength or 0:.2f} ({r.link_type})", *told(r)]
        lines += ["", "## Moats", ""]
        for r in some(tables["moats"].orderBy(F.desc("distance"), "cluster_a", "cluster_b")):
            lines += [f"- {r.cluster_a} ↔ {r.cluster_b}: {r.distance or 0:.2f}", *told(r)]
        lines += ["", "## Anomalies", ""]
        for r in some(tables["anomalies"].orderBy("type", "cluster_id")):
            lines.append(f"- {r.type}: cluster {r.cluster_id}, {r.subject}")
        return "\n".join(lines) + "\n"


def export(df: DataFrame, folder: str, kind: str, stamp: str) -> str:
    """A shown list, whole, in an envelope, as one JSON file; returns its name."""
    count = df.count()
    head = json.dumps({"kind": kind, "exported_at": stamp, "count": count}, ensure_ascii=False)[:-1]

    def pieces():
        yield head + ', "items": [\n'
        yield from _items(df)
        yield "\n]}\n"

    return write_text(df.sparkSession, f"{folder}/export_{kind}_{stamp}.json", pieces())
