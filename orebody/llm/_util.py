"""Helpers of this subpackage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.functions.columns import layer_category, source_category, usable
from orebody.operators.current import latest_rows

DIM = 96


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_draw(seed: int, *keys: str):
    """A number in (0, 1) from the hash of the keys; the same in every run and partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def current_categories(points: DataFrame) -> DataFrame:
    """``(id, source, layer)`` of the current points as categories; reads four narrow columns."""
    now = latest_rows(points.select("id", "seq", "source", "layer"))
    return now.select("id", source_category().alias("source"), layer_category().alias("layer"))


def current_vectors(points: DataFrame, *extra: str, dim: int | None = DIM) -> DataFrame:
    """``(id, embedding, *extra)`` of the current points with usable embedding."""
    now = latest_rows(points.select("id", "seq", "embedding", *extra))
    return now.where(usable("embedding", dim)).select("id", "embedding", *extra)


def hash_sample(df: DataFrame, rows: int, want: int, seed: int) -> DataFrame:
    """About ``want`` of the ``rows`` rows of df, chosen by the hash of their id alone; all if there aren't more."""
    return df if rows <= want else df.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) < F.lit(int(want / rows * (1 << 40))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double."""
    x = x.astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def smallest_per_group(df: DataFrame, group: list[str], key: str, quota: str, rows: int) -> DataFrame:
    """Of each group the ``quota`` rows with the smallest ``key`` in (0, 1), ties by all columns; quota is a column of df.

    Counts by (group, bucket of the key) are aggregated before the shuffle, so a group with a third of
    all rows is never in one task; only the one bucket in which the quota ends is ranked. Buckets grow
    with ``rows``, the number of rows of df, so that one has about 4,096 rows where keys are even.
    """
    buckets = max(512, math.ceil(rows / 4096))
    bucket = F.floor(F.col(key) * buckets)
    counted = df.withColumn("__b", bucket)
    sizes = counted.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sizes = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__bb"), "__n", "__before")
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__b") == F.col("__bb")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = counted.join(sizes, cond).where(F.col("__before") < F.col(quota))
    inside = joined.where(F.col("__before") + F.col("__n") <= F.col(quota)).select(*df.columns)
    rank = Window.partitionBy(*group, "__b").orderBy(key, *[c for c in df.columns if c != key])
    edge = joined.where(F.col("__before") + F.col("__n") > F.col(quota)).withColumn("__r", F.row_number().over(rank))
    return inside.unionByName(edge.where(F.col("__r") + F.col("__before") <= F.col(quota)).select(*df.columns))
