"""Samples that are the same in every run and partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.workspace import materialise

POOL = 15_000


def order_key(seed: int = 42, key: str = "id"):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def random_sample(df: DataFrame, size: int, seed: int = 42, key: str = "id") -> DataFrame:
    """The rows with the smallest hashes."""
    return df.orderBy(order_key(seed, key), key).limit(size)


def _first_per(df: DataFrame, by, size: int, seed: int, key: str, quota: str | None = None) -> DataFrame:
    """The first ``size`` rows of each group; the limit is a number, so it holds before the shuffle too. ``quota`` limits groups further."""
    w = Window.partitionBy(*by).orderBy(order_key(seed, key), key)
    ranked = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size)
    return (ranked if quota is None else ranked.where(F.col("__r") <= F.col(quota))).drop("__r")


def stratified_sample(df: DataFrame, size: int, by: str = "source", allocation: str = "equal", seed: int = 42, key: str = "id") -> DataFrame:
    """Equal places for each stratum, rounded down, or places in proportion to its rows, rounded up at a half."""
    if allocation == "equal":
        strata = df.select(by).distinct().count()
        return _first_per(df, [by], size // strata if strata else 0, seed, key)
    counts = materialise(df.groupBy(F.col(by).alias("__s")).agg(F.count("*").alias("__n")), "strata")
    total, largest = counts.agg(F.sum("__n"), F.max("__n")).first()
    quota = F.floor(F.col("__n") * size / F.lit(max(total or 0, 1)) + 0.5)
    # a stratum without a place has no rows in the sample; there are at most 2 * size others
    wanted = counts.withColumn("__q", quota).where(F.col("__q") > 0)
    rows = df.join(F.broadcast(wanted), F.col(by).eqNullSafe(F.col("__s")))
    return _first_per(rows, [by], int((largest or 0) * size / max(total or 0, 1) + 0.5), seed, key, "__q").drop("__s", "__n", "__q")


def temporal_sample(df: DataFrame, per_window: int, at: str, width: str = "1 day", seed: int = 42, key: str = "id") -> DataFrame:
    """So many rows of each window of time; rows without time are left out."""
    return _first_per(df.where(F.col(at).isNotNull()).withColumn("__w", F.window(at, width).getField("start")), ["__w"], per_window, seed, key).drop("__w")


def diverse_sample(df: DataFrame, size: int, vector: str = "embedding", seed: int = 42, key: str = "id", pool: int = POOL) -> DataFrame:
    """Farthest-first by Euclidean distance over a pool of at most ``pool`` rows, starting from the first by hash."""
    rows = random_sample(df.where(F.col(vector).isNotNull()), pool, seed, key).select(key, order_key(seed, key).alias("o"), vector)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", key]).reset_index(drop=True)
        x = np.stack(pdf[vector].to_list()).astype(np.float64)
        near, taken = ((x - x[0]) ** 2).sum(axis=1), [0]
        near[0] = -1
        while len(taken) < min(size, len(x)):
            i = int(near.argmax())
            taken.append(i)
            near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
            near[taken] = -1
        return pdf.loc[taken, [key]]

    kind = dict(df.dtypes)[key]
    chosen = rows.groupBy(F.lit(0).alias("g")).applyInPandas(run, f"{key} {kind}")
    return df.join(F.broadcast(chosen), key)  # at most POOL ids


def capped(df: DataFrame, most: int, order: str = "id", seed: int = 42, key: str = "id") -> DataFrame:
    """At most ``most`` rows, chosen by hash, in their original order; 0 keeps all. A cap for engines that hold all in memory: off by default."""
    return df if most <= 0 else random_sample(df, most, seed, key).orderBy(order)


def sample(df: DataFrame, size: int, strategy: str = "random", seed: int = 42, key: str = "id", **options) -> DataFrame:
    """Dispatch by name; a size of 0 or one that isn't smaller than the table keeps all, an unknown name is random."""
    if size <= 0 or df.count() <= size:
        return df
    if strategy == "stratified":
        return stratified_sample(df, size, seed=seed, key=key, **options)
    if strategy == "proportional":
        return stratified_sample(df, size, allocation="proportional", seed=seed, key=key, **options)
    if strategy == "diverse":
        return diverse_sample(df, size, seed=seed, key=key, **options)
    if strategy == "temporal":
        return temporal_sample(df, size, seed=seed, key=key, **options)
    return random_sample(df, size, seed, key)
