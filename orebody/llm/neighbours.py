"""Most similar vectors of every vector: balanced posting lists with a graph over their centroids.

Centroids are fitted on a sample of FIT_ROWS rows, or FIT_PER_LIST for each list where that is more, split
and merged until the lists are balanced. Lists grow with the rows at LIST_ROWS rows a list, and beyond
about 100 million rows with their square root, so that centroids fit into memory. Every vector is put into the list of its nearest centroid, and as a boundary vector into further lists whose centroid is
nearly as near and not better covered by one already taken. A query finds near centroids by best-first
search in a graph of centroids and opens those whose distance is within a ratio of the nearest. Lists and
queries meet in blocks of bounded size, compared by matrix products of codes. Whatever the error bound of
the codes leaves possible among the k best stays a candidate and is ranked by exact cosine in double;
queries with many such rows are ranked in their block on the stored vectors. Identical vectors are one
class and searched once. What pruning can miss, ``exact=True`` finds: every query then opens every list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.llm._util import DIM, hash_sample, unit
from orebody.llm.vectors import CODE_BYTES, current_codes, decode, exact_similarities, stored_vectors
from orebody.workspace import materialise

FIT_ROWS = 16_384
FIT_PER_LIST = 8
LIST_ROWS = 1536
LISTS_PER_ROOT = 6.5
FLAT = 4096  # centroids up to which all are compared with all when they are fitted
BLOCK = 8192
TASK_BYTES = 8_000_000
MANY_FLOOR, MANY = 64, 256  # candidates of a query in a block, with a floor and without, beyond which they are ranked there on their vectors
SEED = 31


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 6, seed: int = SEED, flat: int = FLAT) -> np.ndarray:
    """Unit centroids of about equally large clusters: Lloyd rounds in which large clusters take over small ones.

    More than ``flat`` lists are fitted in two levels, each first cluster getting lists by its size.
    """
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    if lists > flat:
        first = balanced_centroids(x, math.isqrt(lists), rounds, seed, flat)
        own = _nearest(x, first)
        size = np.bincount(own, minlength=len(first))
        return np.concatenate([balanced_centroids(x[own == g], max(1, round(lists * n / len(x))), rounds, seed + 1 + g, flat) for g, n in enumerate(size) if n])
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for round_ in range(rounds):
        best = _nearest(x, c)
        size = np.bincount(best, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        filled = size > 0
        c[filled] = total[filled] / np.maximum(np.linalg.norm(total[filled], axis=1, keepdims=True), 1e-12)
        if round_ == rounds - 1:
            break
        mean = len(x) / lists
        small, large = np.argsort(size, kind="stable"), np.argsort(-size, kind="stable")
        free = list(small[size[small] < mean / 3])
        for g in large:
            share = int(size[g] // (1.5 * mean))
            own = np.flatnonzero(best == g)
            while share > 0 and free:
                c[free.pop(0)] = x[rng.choice(own)]
                share -= 1
            if not free:
                break
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64)] + [(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])


class CentroidGraph:
    """Nearest-neighbour graph over the centroids with a sparse upper layer of entry points.

    More than ``flat`` centroids look for their neighbours only among those of the 16 groups nearest to them.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 24, flat: int = FLAT):
        self.c = centroids
        k = len(centroids)
        self.degree = min(degree, max(k - 1, 1))
        near = np.empty((k, self.degree), np.int32)
        if k > flat:
            tops = balanced_centroids(centroids, math.isqrt(k), 3, flat=flat)
            own = _nearest(centroids, tops)
            groups = [np.flatnonzero(np.isin(own, np.argsort(-(tops @ t), kind="stable")[:16])) for t in tops]
            parts = [(np.flatnonzero(own == g), among) for g, among in enumerate(groups)]
        else:
            parts = [(np.arange(i, min(i + 1024, k)), np.arange(k)) for i in range(0, k, 1024)]
        for rows, among in parts:
            s = centroids[rows] @ centroids[among].T
            s[rows[:, None] == among[None, :]] = -2 if k > 1 else 0
            best = among[np.argsort(-s, axis=1, kind="stable")[:, : self.degree]]
            near[rows] = np.pad(best, ((0, 0), (0, self.degree - best.shape[1])), mode="edge")
        self.near = near
        self.entries = np.random.default_rng(SEED).choice(k, min(k, 2 * math.isqrt(k) + 1), replace=False)

    def search(self, q: np.ndarray, want: int, width: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` most similar centroids found for each row, most similar first; missing ones have similarity -2."""
        n, k = len(q), len(self.c)
        width = max(width, want)
        hops = max(12, want)
        seen = np.zeros((n, k), bool)
        start = q @ self.c[self.entries].T
        top = np.argsort(-start, axis=1)[:, : min(4, start.shape[1])]
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -2, np.float32)
        done = np.zeros((n, width), bool)
        row = np.arange(n)
        ids[:, : top.shape[1]], sims[:, : top.shape[1]] = self.entries[top], np.take_along_axis(start, top, axis=1)
        seen[row[:, None], ids[:, : top.shape[1]]] = True
        for _ in range(hops):
            score = np.where(done | (ids < 0), -3, sims)
            pick = score.argmax(axis=1)
            live = np.flatnonzero(score[row, pick] > -2.5)
            if not len(live):
                break
            done[live, pick[live]] = True
            new = self.near[ids[live, pick[live]]]
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            value = np.where(fresh, np.matmul(self.c[new], q[live][:, :, None])[:, :, 0], -3).astype(np.float32)
            all_ids, all_sims = np.concatenate([ids[live], new], axis=1), np.concatenate([sims[live], value], axis=1)
            all_done = np.concatenate([done[live], np.zeros(new.shape, bool)], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], done[live] = (np.take_along_axis(v, best, axis=1) for v in (all_ids, all_sims, all_done))
            ids[live] = np.where(sims[live] <= -2.5, -1, ids[live])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every centroid, most similar first: for queries whose ratio bound may open any list."""
        s = q @ self.c.T
        order = np.argsort(-s, axis=1, kind="stable")
        return order, np.take_along_axis(s, order, axis=1)


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sim, 0))


def replicas(graph: CentroidGraph, q: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the nearest list of each row, and boundary lists not covered by a centroid already taken."""
    ids, sims = graph.search(q, 4 * most)
    d = _distance(sims)
    take = np.zeros(ids.shape, bool)
    take[:, 0] = True
    for j in range(1, ids.shape[1]):
        ok = (ids[:, j] >= 0) & (d[:, j] <= ratio * d[:, 0] + 1e-6) & (take.sum(axis=1) < most)
        for i in range(j):
            between = _distance(np.einsum("ij,ij->i", graph.c[ids[:, i]], graph.c[ids[:, j]]))
            ok &= ~take[:, i] | (between > 0.8 * d[:, j])
        take[:, j] = ok
    row, at = np.nonzero(take)
    return row, ids[row, at]


def opened(graph: CentroidGraph, q: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists a query opens, pruned by the ratio of their distance to the nearest one's."""
    ids, sims = graph.all(q) if most >= len(graph.c) else graph.search(q, most)
    d = _distance(sims)
    take = (ids >= 0) & (d <= ratio * d[:, :1] + 1e-6)
    take[:, most:] = False
    row, at = np.nonzero(take)
    return row, ids[row, at]


def _routed(codes: DataFrame, graph, choose, most: int, ratio: float) -> DataFrame:
    """``(list, id, code, near)`` for each list of each row; ``near`` is its first, the nearest."""

    def run(batches):
        for b in batches:
            step = min(2048, max(64, (1 << 25) // len(graph.value.c)))  # a search marks the centroids that each row has seen
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                row, list_ = choose(graph.value, decode(part.column(1))[0], most, ratio)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), part.column(0).take(at), part.column(1).take(at), pa.array(np.r_[True, row[1:] != row[:-1]][: len(row)])], ["list", "id", "code", "near"])

    return codes.select("id", "code").mapInArrow(run, "list int, id long, code binary, near boolean")


def _sizes(routed: DataFrame, lists: int) -> np.ndarray:
    out = np.zeros(lists, np.int64)
    for r in routed.groupBy("list").count().collect():  # a row a list
        out[r[0]] = r[1]
    return out


def _blocks(df: DataFrame, own: str, other: str, own_n, other_n, lists: int, rows: int = BLOCK, *extra: str) -> DataFrame:
    """Rows of one side with (block of this side, block of the other side): bounded groups, hot lists split."""
    spark = df.sparkSession
    splits = [(i, max(1, math.ceil(own_n[i] / rows)), max(1, math.ceil(other_n[i] / rows))) for i in range(lists) if own_n[i] > rows or other_n[i] > rows]
    table = F.broadcast(spark.createDataFrame(splits or [(-1, 1, 1)], "list int, own_blocks int, other_blocks int"))  # only lists that are split
    df = df.join(table, "list", "left")
    mine = F.pmod(F.xxhash64("id"), F.coalesce("own_blocks", F.lit(1))).cast("int").alias(own)
    return df.select("list", "id", "code", *extra, mine, F.explode(F.sequence(F.lit(0), F.coalesce("other_blocks", F.lit(1)) - 1)).alias(other))


def in_blocks(sides: DataFrame, own_n: np.ndarray, other_n: np.ndarray, rows: int):
    """Both sides grouped by block, in so many partitions that a task reads about TASK_BYTES whatever the session's setting is."""
    own_blocks, other_blocks = (np.maximum(1, -(-n // rows)) for n in (own_n, other_n))
    total = int((own_n * other_blocks + other_n * own_blocks).sum()) * (CODE_BYTES + 24)
    parts = max(int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    return sides.repartition(parts, "list", "block", "q_block").groupBy("list", "block", "q_block")


def possible(s: np.ndarray, error: np.ndarray, k: int, floor) -> np.ndarray:
    """Which columns of each row may be among its k greatest and reach the floor (one, or a column of them), if ``s`` is off by at most ``error``."""
    high = s + error
    ok = high >= floor
    many = np.flatnonzero(ok.sum(axis=1) > k)
    if len(many):
        low = s[many] - error[many]
        ok[many] &= high[many] >= np.partition(low, low.shape[1] - k, axis=1)[:, -k, None]
    return ok


def possible_pairs(s: np.ndarray, lost_q: np.ndarray, lost_m: np.ndarray, k: int, floors: np.ndarray, differ) -> tuple[np.ndarray, ...]:
    """(row, column, similarity, error) of ``possible`` where floors leave little, without the whole matrix of errors.

    ``differ(row, column)`` tells pairs of two points from a point with itself.
    """
    r, c = np.nonzero(s >= (floors - (lost_q + lost_m.max(initial=0)) * np.float32(1.05) - np.float32(2e-5))[:, None])
    value, error = s[r, c], (lost_q[r] + lost_m[c]) * np.float32(1.05) + np.float32(1e-5)
    keep = (value + error >= floors[r]) & differ(r, c)
    r, c, value, error = r[keep], c[keep], value[keep], error[keep]
    order = np.lexsort((error - value, r))
    row = r[order]
    at = order[np.arange(len(row)) - np.searchsorted(row, row) == k - 1]
    least = np.full(len(s), -np.inf)
    least[r[at]] = value[at] - error[at]
    keep = value + error >= least[r]
    return r[keep], c[keep], value[keep], error[keep]


def exact_best(q_ids: np.ndarray, q: np.ndarray, m_ids: np.ndarray, m: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of the k most similar members of each query, in double, ties to the smaller id."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(0, len(q), 512):
        own = q_ids[i : i + 512]
        s = q[i : i + 512] @ m.T
        s[own[:, None] == m_ids[None, :]] = -3
        r, c = np.nonzero(possible(s, np.full_like(s, 1e-12), k, floor))
        value = np.concatenate([np.empty(0)] + [np.einsum("ij,ij->i", q[i + r[j : j + BLOCK]], m[c[j : j + BLOCK]]) for j in range(0, len(r), BLOCK)])
        order = np.lexsort((m_ids[c], -value, r))
        r, c, value = r[order], c[order], value[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((own[r[best]], m_ids[c[best]], value[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


class VectorIndex:
    """Index over the current usable vectors of ``points``; every row is indexed.

    ``neighbours`` gives ``(id, neighbour, similarity, rank)``. Points without usable embedding aren't
    in it; an empty table gives an empty result; ties go to the smaller id; identical vectors are
    neighbours of similarity 1.
    """

    def __init__(self, points: DataFrame, list_rows: int = LIST_ROWS, copies: int = 3, copy_ratio: float = 1.12):
        self.points, self.spark = points, points.sparkSession
        self.codes = current_codes(points)
        copied = self.codes.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        self.members = materialise(self.codes.select("id", "h1", "h2").join(copied, ["h1", "h2"]).select("id", "rep"), "members")
        self.reps = self.codes.select("id", "code").join(self.members.where("id <> rep").select("id"), "id", "left_anti")
        rows = self.codes.count()
        lists = int(max(1, min(rows // list_rows, LISTS_PER_ROOT * math.sqrt(rows))))
        sample = hash_sample(self.reps.select("id", "code"), rows, max(FIT_ROWS, FIT_PER_LIST * lists), SEED).collect()
        x = decode([r[1] for r in sorted(sample)])[0] if sample else np.zeros((1, DIM), np.float32)
        self.graph = CentroidGraph(balanced_centroids(x, lists))
        self.lists = len(self.graph.c)
        self.sent = self.spark.sparkContext.broadcast(self.graph)  # 480 bytes a list
        self.copies, self.copy_ratio = copies, copy_ratio

    def candidates(self, queries: DataFrame, k: int, open_lists: int, ratio: float, min_similarity: float | None) -> DataFrame:
        """``(a, b)``, a < b: class representatives that may be neighbours of a query.

        Without a floor the nearest list comes first: what it holds for sure is a floor for the others.
        """
        postings = materialise(_routed(self.reps, self.sent, replicas, self.copies, self.copy_ratio), "postings")
        asked = materialise(_routed(queries, self.sent, opened, open_lists, ratio), "asked")
        if min_similarity is not None:
            pairs = self._met(postings, asked.withColumn("floor", F.lit(float(min_similarity))), k, min_similarity)
        else:
            low = self._best(self._met(postings, asked.where("near").withColumn("floor", F.lit(-2.5)), k, -2.5), k)
            floors = low.where("r = 1").select(F.col("q").alias("id"), F.col("least").alias("floor"))
            others = asked.where("not near").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.5)))
            pairs = low.select("q", "c", "low", "high").unionByName(self._met(postings, others, k, -2.5))
            pairs = self._best(pairs, k).where("least is null or high >= least")
        return materialise(pairs.select(F.least("q", "c").alias("a"), F.greatest("q", "c").alias("b")).distinct(), "candidates")

    @staticmethod
    def _best(pairs: DataFrame, k: int) -> DataFrame:
        """Pairs once each with ``r``, their place among the query's by what is sure, and ``least``, what its k-th has for sure (null if there is none)."""
        pairs = pairs.groupBy("q", "c").agg(F.max("low").alias("low"), F.min("high").alias("high"))
        ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "c")))
        return materialise(ranked.withColumn("least", F.max(F.when(F.col("r") == k, F.col("low"))).over(Window.partitionBy("q"))), "best")

    def _met(self, postings: DataFrame, asked: DataFrame, k: int, floor: float) -> DataFrame:
        """``(q, c, low, high)``: members of the lists that may be among a query's k best of its block and reach its ``floor``."""
        members, asking = _sizes(postings, self.lists), _sizes(asked, self.lists)
        wanted = postings.withColumn("floor", F.lit(0.0))
        if (asking[members > 0] == 0).any():
            wanted = wanted.join(F.broadcast(asked.select("list").distinct()), "list", "left_semi")  # a row a list
        left = _blocks(wanted, "block", "q_block", members, asking, self.lists, BLOCK, "floor").withColumn("asks", F.lit(False))
        right = _blocks(asked, "q_block", "block", asking, members, self.lists, BLOCK, "floor").withColumn("asks", F.lit(True))
        # without a floor a block gives many rows, of which the best of all lists spare most
        most = MANY_FLOOR if floor > -1 else MANY
        names = ["list", "block", "q_block", "q", "c", "low", "high"]

        def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            """Pairs with bounds; rows without c are queries with too many, rows without q what these need."""
            asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids, (x, lost) = table.column("id").to_numpy(zero_copy_only=False), decode(table.column("code"))
            m, q = np.flatnonzero(~asks), np.flatnonzero(asks)
            floors = table.column("floor").to_numpy(zero_copy_only=False)
            pairs, left_over, needed = [], [], np.zeros(len(m), bool)
            x_m = x[m]
            for i in range(0, len(q) if len(m) else 0, 512):
                own = q[i : i + 512]
                s, differ = x[own] @ x_m.T, lambda r, c, own=own: ids[own[r]] != ids[m[c]]
                if floors[own].min() > -1:
                    r, c, value, error = possible_pairs(s, lost[own], lost[m], k, floors[own].astype(np.float32), differ)
                else:
                    errors = (lost[own][:, None] + lost[m][None, :]) * np.float32(1.05) + np.float32(1e-5)
                    s[ids[own][:, None] == ids[m][None, :]] = -3
                    r, c = np.nonzero(possible(s, errors, k, floors[own][:, None]))
                    value, error = s[r, c], errors[r, c]
                over = np.bincount(r, minlength=len(own)) > most
                needed[c[over[r]]] = True
                left_over.append(ids[own[over]])
                few = ~over[r]
                r, c, value, error = r[few], c[few], value[few], error[few]
                pairs.append((ids[own[r]], ids[m[c]], value - error, value + error))
            both = [np.concatenate(v) for v in zip(*pairs)] if pairs else [np.empty(0, np.int64)] * 2 + [np.empty(0, np.float32)] * 2
            over, need = np.concatenate([np.empty(0, np.int64), *left_over]), ids[m[needed]]
            n = len(both[0]) + len(over) + len(need)
            cells = [pa.array(np.full(n, v.as_py(), np.int32)) for v in key]
            qs = pa.concat_arrays([pa.array(both[0]), pa.array(over), pa.nulls(len(need), pa.int64())])
            cs = pa.concat_arrays([pa.array(both[1]), pa.nulls(len(over), pa.int64()), pa.array(need)])
            bounds = [pa.concat_arrays([pa.array(v.astype(np.float64)), pa.nulls(len(over) + len(need), pa.float64())]) for v in both[2:]]
            return pa.Table.from_arrays([*cells, qs, cs, *bounds], names)

        columns = ["list", "block", "q_block", "asks", "floor", "id", "code"]
        schema = "list int, block int, q_block int, q long, c long, low double, high double"
        sides = left.select(columns).unionByName(right.select(columns))
        found = materialise(in_blocks(sides, members, asking, BLOCK).applyInArrow(group, schema), "found")
        pairs = found.where("q is not null and c is not null").select("q", "c", "low", "high")
        crowded = found.where("q is null or c is null")
        return pairs if crowded.isEmpty() else pairs.unionByName(self._crowded(crowded, k, floor))

    def _crowded(self, crowded: DataFrame, k: int, floor: float) -> DataFrame:
        """``(q, c, low, high)``: the k best of a block by exact cosine, for its queries whose codes leave too many possible."""
        rows = crowded.select("list", "block", "q_block", F.col("q").isNotNull().alias("asks"), F.coalesce("q", "c").alias("id"))
        stored = stored_vectors(self.points, self.codes, materialise(rows.select("id").distinct(), "crowded"))

        def rank(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids = table.column("id").to_numpy(zero_copy_only=False)
            x = unit(np.asarray(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, DIM))
            q, c, value = exact_best(ids[asks], x[asks], ids[~asks], x[~asks], k, floor - 1e-9)
            return pa.table({"q": q, "c": c, "low": value - 1e-9, "high": value + 1e-9})

        return rows.join(stored, "id").groupBy("list", "block", "q_block").applyInArrow(rank, "q long, c long, low double, high double")

    def neighbours(self, k: int = 5, queries: DataFrame | None = None, open_lists: int = 5, ratio: float = 1.15, min_similarity: float | None = None, exact: bool = False) -> DataFrame:
        """The k most similar other points of each query id (all points if None), if given those of ``min_similarity`` or more.

        ``exact`` opens every list for every query: nothing is missed, and the work is queries times rows, in blocks.
        """
        if exact:
            open_lists, ratio = self.lists, math.inf
        asked = self.reps
        if queries is not None:
            wanted = queries.select("id").distinct()
            wanted = wanted.join(self.members, "id", "left").select(F.coalesce("rep", "id").alias("id")).distinct()
            asked = self.reps.join(wanted, "id", "left_semi")
        pairs = exact_similarities(self.points, self.codes, self.candidates(asked, k, open_lists, ratio, min_similarity))
        if min_similarity is not None:
            pairs = pairs.where(F.col("similarity") >= min_similarity)
        pairs = materialise(pairs, "pairs")
        both = pairs.select(F.col("a").alias("q"), F.col("b").alias("rep"), "similarity").unionByName(pairs.select(F.col("b").alias("q"), F.col("a").alias("rep"), "similarity"))
        # of a class of identical vectors no query needs more than the k + 1 smallest ids
        least = self.members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
        classes = both.join(least, "rep", "left").select("q", F.coalesce("member", "rep").alias("neighbour"), "similarity")
        own = least.select(F.col("rep").alias("q"), F.col("member").alias("neighbour"), F.lit(1.0).alias("similarity"))
        order = [F.desc("similarity"), "neighbour"]
        best = classes.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
        each = best.join(self.members.select(F.col("rep").alias("q"), "id"), "q", "left").select(F.coalesce("id", "q").alias("id"), "neighbour", "similarity").where("id <> neighbour")
        if queries is not None:
            each = each.join(queries.select("id").distinct(), "id", "left_semi")
        return each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)


def similar_pairs(points: DataFrame, k: int = 5, min_similarity: float = 0.95) -> DataFrame:
    """``(chunk_a_id, chunk_b_id, similarity)``: links of which one end is among the other's k most similar."""
    found = VectorIndex(points).neighbours(k, min_similarity=min_similarity)
    return found.select(F.least("id", "neighbour").alias("chunk_a_id"), F.greatest("id", "neighbour").alias("chunk_b_id"), "similarity").dropDuplicates(["chunk_a_id", "chunk_b_id"])
