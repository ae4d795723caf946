"""Bridges and moats between clusters, their sample links, and the cross-check of bridges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.vectors import bridge_support, dot, link_type, normalised
from orebody.workspace import materialise

BRIDGE, MOAT = 0.3, 0.1
BLOCK = 512


def cluster_pairs(clusters: DataFrame, centroid: str = "centroid", cluster: str = "cluster_id") -> DataFrame:
    """``(cluster_a, cluster_b, similarity)`` of all pairs a < b, one row a cluster on either side.

    Every pair is asked for, so this is quadratic in clusters by definition, not in points. Centroids are
    scaled to length one once; blocks of about BLOCK clusters are compared with each other by matrix
    products, each pair of blocks once. Null, empty and all-zero centroids, and those of other lengths, have
    similarity 0.
    """
    kind = dict(clusters.dtypes)[cluster]
    rows = materialise(clusters.select(F.col(cluster).alias("c"), normalised(F.coalesce(F.col(centroid), F.array())).alias("v")).where("c is not null"), "centroids")
    blocks = max(1, math.ceil(rows.count() / BLOCK))
    placed = rows.withColumn("g", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    sides = placed.select("c", "v", "g", every).select(F.least("g", "o").alias("ga"), F.greatest("g", "o").alias("gb"), (F.col("g") <= F.col("o")).alias("first"), (F.col("g") == F.col("o")).alias("both"), "c", "v")

    def compare(table: pa.Table) -> pa.Table:
        ids, vectors = table.column("c").to_numpy(), table.column("v").to_pylist()
        first, both = (table.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("first", "both"))
        a, b = np.flatnonzero(first), np.flatnonzero(~first | both)
        length = np.array([len(v) for v in vectors])
        similarity = np.zeros((len(a), len(b)))
        for n in np.unique(length[length > 0]):
            i, j = np.flatnonzero(length[a] == n), np.flatnonzero(length[b] == n)
            if len(i) and len(j):
                x, y = (np.array([vectors[k] for k in side]) for side in (a[i], b[j]))
                similarity[np.ix_(i, j)] = np.nan_to_num(x.astype(np.float64)) @ np.nan_to_num(y.astype(np.float64)).T
        p, q = np.nonzero(ids[a][:, None] < ids[b][None, :] if both.any() else ids[a][:, None] != ids[b][None, :])
        low, high = np.minimum(ids[a][p], ids[b][q]), np.maximum(ids[a][p], ids[b][q])
        return pa.table({"cluster_a": low, "cluster_b": high, "similarity": similarity[p, q]})

    return sides.groupBy("ga", "gb").applyInArrow(compare, f"cluster_a {kind}, cluster_b {kind}, similarity double")


def bridges(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("similarity") > BRIDGE).select("cluster_a", "cluster_b", F.col("similarity").alias("strength"), link_type("similarity").alias("link_type"))


def moats(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("similarity") < MOAT).select(
        "cluster_a", "cluster_b", (1 - F.col("similarity")).alias("distance"), F.lit("the clusters share no direction").alias("explanation")
    )


def sample_links(bridge: DataFrame, members: DataFrame, per_side: int = 50, most: int = 5, vector: str = "embedding") -> DataFrame:
    """``(cluster_a, cluster_b, rank, chunk_a_id, chunk_b_id, similarity)``: most similar members across each bridge.

    At most ``per_side`` members of a cluster are looked at, the first by id; ties to the smaller ids.
    """
    first = Window.partitionBy("cluster_id").orderBy("id")
    m = members.select("cluster_id", "id", F.col(vector).alias("v")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_side).drop("r")
    m = materialise(m.withColumn("v", normalised("v")), "sides")  # scaled once, not once a pair
    a, b = (m.select(F.col("cluster_id").alias(f"cluster_{x}"), F.col("id").alias(f"chunk_{x}_id"), F.col("v").alias(f"v{x}")) for x in "ab")
    pairs = bridge.select("cluster_a", "cluster_b").join(a, "cluster_a").join(b, "cluster_b").withColumn("similarity", F.coalesce(F.when(F.size("va") == F.size("vb"), dot("va", "vb")), F.lit(0.0))).drop("va", "vb")
    w = Window.partitionBy("cluster_a", "cluster_b").orderBy(F.desc("similarity"), "chunk_a_id", "chunk_b_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select("cluster_a", "cluster_b", "rank", "chunk_a_id", "chunk_b_id", "similarity")


def with_links(bridge: DataFrame, links: DataFrame) -> DataFrame:
    packed = links.groupBy("cluster_a", "cluster_b").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_a_id", "chunk_b_id", "similarity"))).alias("l"))
    joined = bridge.join(packed, ["cluster_a", "cluster_b"], "left")
    return joined.withColumn("sample_links", F.transform("l", lambda x: F.struct(x["chunk_a_id"].alias("chunk_a_id"), x["chunk_b_id"].alias("chunk_b_id"), x["similarity"].alias("similarity")))).drop("l")


def with_support(bridge: DataFrame, threshold: float = 0.5) -> DataFrame:
    return bridge.withColumn("support", bridge_support("sample_links", threshold))


def crosscheck(bridge: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: bridges, those with a sample link of ``threshold`` or more, those without, and the supported share (0 if none)."""
    ok = F.coalesce(F.exists("sample_links", lambda x: x["similarity"] >= threshold), F.lit(False))
    agg = bridge.select(ok.alias("ok")).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("supported"))
    return agg.select("total", "supported", (F.col("total") - F.col("supported")).alias("semantic_only"), F.when(F.col("total") > 0, F.col("supported") / F.col("total")).otherwise(0.0).alias("ratio"))


def strongest(bridge: DataFrame, most: int = 10) -> DataFrame:
    return bridge.orderBy(F.desc("strength"), "cluster_a", "cluster_b").limit(most)


def widest(moat: DataFrame, most: int = 5) -> DataFrame:
    return moat.orderBy(F.desc("distance"), "cluster_a", "cluster_b").limit(most)
