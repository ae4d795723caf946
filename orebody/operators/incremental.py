"""Work on new or changed rows only, by comparing Merkle trees over key ranges.

The range of a row is the leading bits of its key's hash, so ranges are even whatever the keys are.
A leaf's digest is the exclusive-or of its rows' digests, so it needs no order and is aggregated
before the shuffle; an inner node hashes its children in order. Only (key, order, digests) are ever
shuffled, never the rows themselves.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions.columns import stored_digest
from orebody.workspace import materialise

ARITY_BITS = 4
ROWS_PER_LEAF = 64
PREFIX_BITS = 8


def row_digests(df: DataFrame, fields: list[str], key: str = "id", order: str | None = None) -> DataFrame:
    """``(key[, order], h1, h2)``: 128 bits over the fields as stored, made in the scan."""
    arrays = tuple(n for n, t in df.dtypes if t.startswith("array"))
    cols = [F.col(key)] + ([F.col(order)] if order else [])
    return df.select(*cols, stored_digest(*fields, seed=1, arrays=arrays).alias("h1"), stored_digest(*fields, seed=2, arrays=arrays).alias("h2"))


def depth_for(rows: int) -> int:
    """Levels below the root so that a leaf has about ROWS_PER_LEAF rows."""
    return max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_LEAF + 1, 2**ARITY_BITS)))


def with_leaf(digests: DataFrame, depth: int, key: str = "id") -> DataFrame:
    return digests.withColumn("leaf", F.expr(f"shiftrightunsigned(xxhash64({key}), {64 - ARITY_BITS * depth})"))


def build_tree(rows: DataFrame, depth: int, key: str = "id") -> DataFrame:
    """``(level, node, n, d1, d2)`` of all levels; level 0 is the root, ``depth`` has the leaves."""
    level = rows.groupBy(F.col("leaf").alias("node")).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, "h1")).alias("d1"), F.bit_xor(F.xxhash64(key, "h2", F.lit(7))).alias("d2")
    )
    level = materialise(level, "leaves")
    out = level.withColumn("level", F.lit(depth))
    for at in range(depth - 1, -1, -1):
        # at most 2**ARITY_BITS children in a node
        level = level.groupBy(F.shiftright("node", ARITY_BITS).alias("node")).agg(
            F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("node", "d1", "d2"))).alias("c")
        )
        level = level.select("node", "n", F.xxhash64("c.node", "c.d1").alias("d1"), F.xxhash64("c.node", "c.d2").alias("d2"))
        out = out.unionByName(level.withColumn("level", F.lit(at)))
    return materialise(out.select("level", "node", "n", "d1", "d2"), "tree")


def changed_leaves(now: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """``(leaf)`` whose digests differ, found by descending from the root through differing nodes only.

    The trees are joined once, on (level, node); each level then keeps the nodes below a node kept.
    """
    mine = now.select("level", "node", F.col("d1").alias("a1"), F.col("d2").alias("a2"))
    theirs = saved.select("level", "node", F.col("d1").alias("b1"), F.col("d2").alias("b2"))
    same = F.col("a1").eqNullSafe(F.col("b1")) & F.col("a2").eqNullSafe(F.col("b2"))
    differing = materialise(mine.join(theirs, ["level", "node"], "full").where(~same).select("level", "node"), "differing")
    open_nodes = differing.where(F.col("level") == 0).select("node")
    for at in range(1, depth + 1):
        below = differing.where(F.col("level") == at).select("node", F.shiftright("node", ARITY_BITS).alias("parent"))
        open_nodes = below.join(open_nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node")
    return open_nodes.select(F.col("node").alias("leaf"))


def due_rows(now: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """``(key)`` that are new or changed between two tables of row digests (one row a key).

    A key only in ``saved`` isn't due. Null keys are left out; an empty ``saved`` makes all due.
    """
    now, saved = (materialise(d.where(F.col(key).isNotNull()), "digests") for d in (now, saved))
    depth = depth_for(now.count())
    now, saved = with_leaf(now, depth, key), with_leaf(saved, depth, key)
    leaves = materialise(changed_leaves(build_tree(now, depth, key), build_tree(saved, depth, key), depth), "changed")
    mine, theirs = (d.join(leaves, "leaf", "left_semi") for d in (now, saved))
    theirs = theirs.select(key, F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    same = F.col("h1").eqNullSafe(F.col("s1")) & F.col("h2").eqNullSafe(F.col("s2"))
    return mine.join(theirs, key, "left").where(F.col("s1").isNull() | ~same).select(key)


def due_since(now: DataFrame, tree: DataFrame, saved, depth: int, key: str = "id") -> DataFrame:
    """``due_rows`` by a published tree of ``depth``: ``saved(leaves)`` gives the saved digests of changed leaves only."""
    now = with_leaf(now, depth, key)
    leaves = materialise(changed_leaves(build_tree(now, depth, key), tree, depth), "changed")
    theirs = saved(leaves).select(key, F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    same = F.col("h1").eqNullSafe(F.col("s1")) & F.col("h2").eqNullSafe(F.col("s2"))
    return now.join(leaves, "leaf", "left_semi").join(theirs, key, "left").where(F.col("s1").isNull() | ~same).select(key)


def succeeded_stamps(stamps: DataFrame, runs: DataFrame) -> DataFrame:
    """``(id, seq)``: each id's greatest seq with a stamp of a succeeded attempt."""
    status = F.lower(F.regexp_replace("status", r"^\s+|\s+$", ""))
    good = runs.where(status == "succeeded").select("run_id", "attempt").distinct()
    return stamps.join(good, ["run_id", "attempt"], "left_semi").where("id is not null").groupBy("id").agg(F.max("seq").alias("seq"))


def due_points(points: DataFrame, stamps: DataFrame, runs: DataFrame, fields=("embedding", "fragment", "source", "layer")) -> DataFrame:
    """``(id)`` of the points that are new or changed since the work of succeeded runs.

    A point is compared, as stored, with the row at its greatest succeeded stamp. Stamps of rows that
    no longer exist leave the point due. Repeated rows and stamps count once; attempts without a run,
    or whose status is null, don't count.
    """
    digests = materialise(row_digests(points, list(fields), order="seq").where("id is not null"), "rows")
    newest = digests.groupBy("id").agg(F.max_by(F.struct("h1", "h2"), F.coalesce("seq", F.lit(-(2**63)))).alias("h"))
    done = succeeded_stamps(stamps, runs)
    at_stamp = digests.join(done, ["id", "seq"]).groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"))
    return due_rows(newest.select("id", "h.*"), at_stamp.select("id", "h.*"))


@dataclass
class MerkleStore:
    """Saved trees and outputs of an incremental job below one folder.

    ``run`` hands the new or changed rows to ``work`` and writes its output, the new digests and their tree
    into a folder of its own. Then a pointer file with the version's number is created, which fails if it
    exists and needs no folder to be renamed: output and tree are published together or not at all. A failure before leaves the last version in force, so the next run takes the same rows again;
    after it, none again. Digests are stored by the leading bits of their leaf, and a run reads those of
    changed leaves only.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> dict[int, str]:
        """Folders of the published versions by number. A pointer without content was never published."""
        fs, path = self._fs()
        at = path(f"{self.path}/published")
        if not fs.exists(at):
            return {}
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        found = {}
        for s in fs.listStatus(at):
            stream = fs.open(s.getPath())
            folder = read(stream, "UTF-8")
            stream.close()
            if folder:
                found[int(s.getPath().getName())] = f"{self.path}/{folder}"
        return dict(sorted(found.items()))

    def _next(self) -> int:
        fs, path = self._fs()
        at = path(f"{self.path}/published")
        return max([int(s.getPath().getName()) for s in fs.listStatus(at)], default=0) + 1 if fs.exists(at) else 1

    def _publish(self, number: int, folder: str) -> None:
        fs, path = self._fs()
        try:
            pointer = fs.create(path(f"{self.path}/published/{number}"), False)
        except Exception as e:
            raise RuntimeError("another run published this version") from e
        pointer.writeBytes(folder)
        pointer.close()

    def digests(self, folder: str, prefixes: list[int] | None = None) -> DataFrame:
        """Saved digests, of leaves with the given leading bits only."""
        saved = self.spark.read.parquet(f"{folder}/digests")
        return saved if prefixes is None else saved.where(F.col("prefix").isin(prefixes))

    def _due(self, digests: DataFrame, key: str) -> DataFrame:
        done = list(self.versions().values())
        if not done:
            return digests.select(key)
        tree = self.spark.read.parquet(f"{done[-1]}/tree")
        depth = tree.agg(F.max("level")).first()[0]
        if depth is None:  # nothing was saved
            return digests.select(key)

        def saved(leaves: DataFrame) -> DataFrame:
            prefixes = [r[0] for r in leaves.select(_prefix(depth).alias("p")).distinct().collect()]  # at most 2**PREFIX_BITS
            return self.digests(done[-1], prefixes).join(leaves, "leaf", "left_semi")

        return due_since(digests, tree, saved, depth, key)

    def run(self, df: DataFrame, fields: list[str], work, key: str = "id") -> DataFrame:
        """Output of ``work`` over the due rows of ``df`` (one row a key)."""
        digests = materialise(row_digests(df, fields, key).where(F.col(key).isNotNull()), "digests")
        due = self._due(digests, key)
        number, folder = self._next(), uuid.uuid4().hex
        at = f"{self.path}/{folder}"
        work(df.join(due, key, "left_semi")).write.parquet(f"{at}/output")
        depth = depth_for(digests.count())
        placed = with_leaf(digests, depth, key)
        placed.withColumn("prefix", _prefix(depth)).repartition("prefix").write.partitionBy("prefix").parquet(f"{at}/digests")
        build_tree(placed, depth, key).write.parquet(f"{at}/tree")
        self._publish(number, folder)
        return self.spark.read.parquet(f"{at}/output")


def _prefix(depth: int):
    """The leading bits of a leaf of a tree of this depth, by which digests are stored."""
    return F.shiftrightunsigned("leaf", max(0, ARITY_BITS * depth - PREFIX_BITS)).cast("int")
