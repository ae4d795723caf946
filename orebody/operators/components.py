"""Connected components without collecting edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.workspace import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of the nodes 0..n-1, by repeated minima and halving of paths."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        label = label[label]
        if (label == before).all():
            return label


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each task as stars around the least vertex of what they join."""

    def run(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = (np.concatenate([held, batch.column(i).to_numpy(zero_copy_only=False)]) for i, held in ((0, a), (1, b)))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = forest(len(names), at[: len(a)], at[len(a) :])
            leaf = np.flatnonzero(label != np.arange(len(names)))
            a, b = names[leaf], names[label[leaf]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)``: for each vertex of an edge its component's least vertex; vertices are whole numbers.

    Alternating large-star and small-star rounds, after each of which every task contracts the edges it
    holds; each round is written to the shared folder, the rounds grow with the logarithm of the graph,
    and edges that one task holds are done at once. Minima are aggregated before the shuffle; the join of
    a vertex' edges with its minimum can be split by adaptive execution if the vertex is hot.
    Null ends and loops are left out, an empty table gives an empty result.
    """
    work = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    work = materialise(_contracted(_clean(work)), "edges")
    seen = None
    for _ in range(max_rounds):
        if len(work.inputFiles()) <= 1:
            break
        work = materialise(_contracted(_clean(_small_star(_clean(_large_star(work))))), "edges")
        mark = work.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return work.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        work.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
