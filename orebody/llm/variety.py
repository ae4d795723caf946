"""A varied subset of given size: distributed farthest-first k-center selection.

Rows are spread by hash over parts of bounded size. Each part selects representatives greedily, each next
one farthest from those it has; the parts' representatives are pooled and the selection runs again on the
pool, by regions of bounded size: the places go to the rows that were farthest when taken, over all regions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.columns import layer_category, source_category
from orebody.llm._util import hash_sample, smallest_per_group
from orebody.llm.neighbours import FIT_PER_LIST, FIT_ROWS, CentroidGraph, balanced_centroids
from orebody.llm.vectors import current_codes, decode
from orebody.workspace import materialise

PART_ROWS = 16_384
OVERSAMPLE = 2.0
TURNS, MAX_TURNS = 3, 12
SEED = 53


def farthest_first(x: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Indices of ``size`` rows: ``first``, then again and again the row farthest from those taken; ties to the lower index."""
    return farthest_order(x, first, size)[0]


def farthest_order(x: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``farthest_first``, and how similar each row was to the nearest one taken before it: -2 for ``first``."""
    n = len(x)
    size = min(size, n)
    taken = list(dict.fromkeys(int(i) for i in first))[:size] or ([0] if size else [])
    near = np.full(n, -2.0, np.float32)
    for i in range(0, len(taken), 64):
        near = np.maximum(near, (x @ x[taken[i : i + 64]].T).max(axis=1))
    near[taken] = np.inf
    at = [-2.0] * len(taken)
    while len(taken) < size:
        i = int(near.argmin())
        taken.append(i)
        at.append(float(near[i]))
        np.maximum(near, x @ x[i], out=near)
        near[i] = np.inf
    return np.array(taken, dtype=np.int64), np.array(at)


def _select(rows: DataFrame) -> DataFrame:
    """``(id, nearest)``: farthest-first in each ``part`` of (part, size, must, id, code), the must rows and up to ``size`` in all."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        x = decode(table.column("code"))[0]
        must = np.flatnonzero(table.column("must").to_numpy(zero_copy_only=False).astype(bool))
        taken, nearest = farthest_order(x, must, max(int(table.column("size")[0].as_py()), len(must)))
        return pa.table({"id": table.column("id").take(pa.array(taken)), "nearest": pa.array(np.where(np.isin(taken, must), -2.0, nearest))})

    return rows.select("part", "size", "must", "id", "code").groupBy("part").applyInArrow(run, "id long, nearest double")


def _of_each_category(rows: DataFrame, *group: str) -> DataFrame:
    """(id): of each source and of each layer, within ``group``, the row with the smallest hash."""
    found = None
    for c in ("source", "layer"):
        best = rows.groupBy(*group, c).agg(F.min_by("id", F.struct(F.xxhash64(F.lit(SEED), "id"), "id")).alias("id")).select("id")
        found = best if found is None else found.unionByName(best)
    return found.distinct()


def varied_subset(points: DataFrame, share: float = 0.01) -> DataFrame:
    """``(id, source, layer)``: ``share`` of the current points with usable vectors, rounded up.

    Every source and layer category is in it as long as there are places for them. A large group of
    similar points gets a place only where it is farther from the chosen than all else, whatever its
    size; a second copy comes only when nothing different is left. Empty tables give an empty result.
    """
    codes = current_codes(points, "source", "layer")
    rows = materialise(codes.select("id", source_category().alias("source"), layer_category().alias("layer"), "code"), "rows")
    n = rows.count()
    size = math.ceil(share * n)
    parts = max(1, math.ceil(n / PART_ROWS))
    spread = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(parts)).cast("int"))
    marked = spread.join(_of_each_category(spread, "part").withColumn("must", F.lit(True)), "id", "left").withColumn("must", F.coalesce("must", F.lit(False)))
    per_part = math.ceil(OVERSAMPLE * size / parts)
    pool = _select(marked.withColumn("size", F.lit(per_part))).select("id")
    pool = materialise(rows.join(pool, "id"), "pool")
    must = _of_each_category(pool).orderBy("id").limit(size).withColumn("must", F.lit(True))
    pool = materialise(pool.join(must, "id", "left").withColumn("must", F.coalesce("must", F.lit(False))), "marked")
    chosen = _farthest_of(pool, pool.count(), size)
    return rows.join(chosen.select("id"), "id").drop("code")


def _farthest_of(pool: DataFrame, pooled: int, size: int) -> DataFrame:
    """``(id)``: the must rows and the rows farthest from those taken before them, ``size`` in all.

    The pool is divided into regions that fit one task, each is taken in farthest-first order, and the
    places go to the rows that were farthest when taken, whatever their region. With one region this is
    farthest-first over the pool. With several, two rows on the sides of a border don't see each other:
    half of the surplus rows stay, and are taken again in regions with other borders, until the last
    pass takes ``size`` rows.
    """
    for turn in range(MAX_TURNS):
        regions = max(1, math.ceil(pooled / (PART_ROWS // 2)))
        parts, pieces = _regions(pool, pooled, regions, SEED + 1 + turn)
        last = regions == 1 or turn == MAX_TURNS - 1 or (turn >= TURNS - 1 and pieces == 1)
        keep = min(pooled, size if last else size + max(0, pooled - size) // 2)
        picked = _select(parts.withColumn("size", F.lit(pooled))).withColumn("all", F.lit(0))
        key = F.when(F.col("nearest") <= -2, 1e-9).otherwise(F.greatest(F.lit(2e-9), F.least(F.lit(1 - 1e-9), (F.col("nearest") + 1) / 2)))
        picked = materialise(picked.withColumn("key", key).withColumn("quota", F.lit(keep)), "picked")
        chosen = materialise(smallest_per_group(picked, ["all"], "key", "quota", pooled).select("id"), "chosen")
        if last:
            return chosen
        pool, pooled = materialise(pool.join(chosen, "id"), "pool"), keep


def _regions(pool: DataFrame, pooled: int, regions: int, seed: int) -> tuple[DataFrame, int]:
    """The pool with region as ``part`` (split where larger than PART_ROWS), and the most pieces of a region."""
    if regions == 1 and pooled <= PART_ROWS:
        return pool.withColumn("part", F.lit(0).cast("long")), 1
    spark = pool.sparkSession
    sample = sorted(hash_sample(pool.select("id", "code"), pooled, max(FIT_ROWS, FIT_PER_LIST * regions), seed).collect())
    sent = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(decode([r[1] for r in sample])[0], regions, seed=seed)))  # 480 bytes a region

    def nearest(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                best = sent.value.search(decode(part.column(1))[0], 1)[0][:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32))], ["id", "region"])

    placed = materialise(pool.select("id", "code").mapInArrow(nearest, "id long, region int"), "regions")
    counts = {r[0]: r[1] for r in placed.groupBy("region").count().collect()}  # a row a region
    split = [(g, max(1, math.ceil(c / PART_ROWS))) for g, c in counts.items()]
    parts = placed.join(F.broadcast(spark.createDataFrame(split, "region int, pieces int")), "region")
    part = F.col("region").cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("pieces"))
    return pool.join(parts.select("id", part.alias("part")), "id"), max(n for _, n in split)
