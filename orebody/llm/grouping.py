"""Clusters of mutually similar vectors by a Gaussian mixture.

All rows are projected on the leading principal components of the whole collection and standardised. A
mixture with diagonal covariances, shrunk to the pooled one, is fitted by expectation-maximisation over
all rows, several sizes in the same passes; the Bayesian information criterion chooses the number of
components, and the chosen mixture is fitted until its likelihood hardly grows. Sizes grow with the square
root of the rows. The members of highest density stand for a component. A row belongs to the components of
highest posterior; of many components only those of the groups densest at a row are looked at. Rows are
linked to similar representatives first, then those that no representative of their component explains are
compared with all rows of their components in blocks, and links are closed to groups. Codes decide where they can; pairs too close to the threshold are decided on the vectors.
Similar rows that share no component can be missed; ``exact=True`` finds these too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.llm._util import DIM, hash_sample, unit
from orebody.llm.neighbours import _blocks, balanced_centroids, in_blocks
from orebody.llm.vectors import CODE_BYTES, current_codes, decode, decoded, exact_similarities, raw_rows, stored_vectors
from orebody.operators.components import connected_components, forest
from orebody.workspace import materialise

FEATURES = 32
CHOICE_ROUNDS, MAX_ROUNDS = 2, 8
GAIN = 0.05  # of the log likelihood of a row, under which fitting ends
START_ROWS, START_PER_COMPONENT = 16_384, 8
SHRINK = 40.0
REPRESENTATIVES = 8
CELL_ROWS = 8192
FLAT, OPENED = 1024, 16  # components up to which a row looks at all; groups of components that it opens beyond that
HELD = 1 << 20
SIMILARITY, MIN_SIZE = 0.8, 5
SEED = 41


def _chunk(components: int) -> int:
    """Rows whose densities under so many components are held at once."""
    return min(4096, max(64, (1 << 19) // components))


def _total(df: DataFrame, partial, width: int, parts: int = 8, step: int = 4096) -> np.ndarray:
    """Sum of a vector of doubles over all tasks: added up in ``parts`` tasks, then on the driver."""

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            for i in range(0, b.num_rows, step):
                total += partial(decode(b.column(0).slice(i, step))[0])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("x").to_pylist()
        return pa.table({"x": pa.array([sum(np.frombuffer(r) for r in rows).tobytes()], pa.binary())})

    sums = df.select("code").mapInArrow(run, "x binary").withColumn("p", F.pmod(F.xxhash64("x"), F.lit(parts))).groupBy("p").applyInArrow(lambda t: add(t), "x binary")
    return sum((np.frombuffer(r[0]) for r in sums.toLocalIterator()), np.zeros(width))


def _powers(f: np.ndarray) -> np.ndarray:
    """Squares, numbers and one of each row: products with them are densities, or the sums that a fit needs."""
    return np.concatenate([f * f, f, np.ones((len(f), 1), f.dtype)], axis=1)


@dataclass
class Mixture:
    """Standardising projection and the parameters of a diagonal mixture."""

    mean: np.ndarray
    axes: np.ndarray
    weight: np.ndarray
    centre: np.ndarray
    variance: np.ndarray
    bic: float = math.inf
    likelihood: float = -math.inf

    def features(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.axes).astype(np.float32)

    def log_parts(self, f: np.ndarray) -> np.ndarray:
        """Log of weight times density, row by component."""
        return _powers(f) @ self.factors()

    def factors(self) -> np.ndarray:
        """What the powers of a row are multiplied with."""
        const = np.log(np.maximum(self.weight, 1e-12)) - 0.5 * (np.log(2 * np.pi * self.variance) + self.centre**2 / self.variance).sum(axis=1)
        return np.concatenate([-0.5 / self.variance, self.centre / self.variance, const[:, None]], axis=1).T.astype(np.float32)

    def update(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> Mixture:
        rows = n.sum()
        centre = np.where(n[:, None] > 1e-6, s1 / np.maximum(n, 1e-6)[:, None], self.centre)
        spread = np.maximum(s2 - n[:, None] * centre**2, 0)
        pooled = spread.sum(axis=0) / max(rows, 1) + 1e-4
        variance = (spread + SHRINK * pooled) / (n[:, None] + SHRINK) + 1e-4
        return Mixture(self.mean, self.axes, (n + 1) / (rows + len(n)), centre, variance)


class Nearby:
    """The components that count for a row: all up to ``flat``, beyond that those of the groups that are densest at the row.

    No group has more components than twice the square root of their number. A group's density is that of the
    one Gaussian with its mean and variance; ``opened`` groups are looked at, so the work of a row grows with
    the square root of the components instead of with them.
    """

    def __init__(self, g: Mixture, flat: int = FLAT, opened: int = OPENED):
        k = len(g.weight)
        self.mixture, self.members, self.opened, self.step = g, [np.arange(k)], 1, _chunk(k)
        if k > flat:
            self.members = _parted(g.centre.astype(np.float32), 2 * math.isqrt(k))
            weight = np.array([g.weight[m].sum() for m in self.members])
            mean, square = (np.array([g.weight[m] @ v[m] for m in self.members]) / weight[:, None] for v in (g.centre, g.variance + g.centre**2))
            self.top = Mixture(g.mean, g.axes, weight, mean, np.maximum(square - mean**2, 1e-4)).factors()
            self.opened, self.step = min(opened, len(self.members)), 2048  # the sums of a step are as large as the mixture
        factors = g.factors()
        self.parts = [np.ascontiguousarray(factors[:, m]) for m in self.members]

    def blocks(self, powers: np.ndarray) -> list[tuple]:
        """(rows, components, log of weight times density) of each group that a row opens."""
        if len(self.members) == 1:
            return [(np.arange(len(powers)), self.members[0], powers @ self.parts[0])]
        opens = np.zeros((len(powers), len(self.members)), bool)
        np.put_along_axis(opens, np.argpartition(-(powers @ self.top), self.opened - 1, axis=1)[:, : self.opened], True, axis=1)
        rows = [np.flatnonzero(o) for o in np.ascontiguousarray(opens.T)]
        return [(r, m, powers[r] @ f) for r, m, f in zip(rows, self.members, self.parts) if len(r)]

    def expected(self, powers: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums of the powers by component, weighted with the posterior, and the log likelihood."""
        blocks = self.blocks(powers)
        most, total = np.full(len(powers), -np.inf, np.float32), np.zeros(len(powers), np.float32)
        for rows, _, p in blocks:
            most[rows] = np.maximum(most[rows], p.max(axis=1))
        for rows, _, p in blocks:
            p -= most[rows, None]
            np.maximum(p, -50, out=p)  # products of numbers near the least ones take a hundred times as long
            np.exp(p, out=p)
            total[rows] += p.sum(axis=1)
        sums, shared = np.zeros((len(self.mixture.weight), powers.shape[1])), powers / total[:, None]
        for rows, members, p in blocks:
            sums[members] += p.T @ shared[rows]
        return sums, float((np.log(total) + most).sum(dtype=np.float64))

    def best(self, powers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` components of highest density of each row, and the logs of weight times density; -inf where there are fewer."""
        n = len(powers)
        comp, value, filled = np.zeros((n, self.opened * most), np.int64), np.full((n, self.opened * most), -np.inf, np.float32), np.zeros(n, np.int64)
        for rows, members, p in self.blocks(powers):
            m = min(most, p.shape[1])
            at = np.argpartition(-p, m - 1, axis=1)[:, :m]
            place = filled[rows][:, None] + np.arange(m)
            comp[rows[:, None], place], value[rows[:, None], place] = members[at], np.take_along_axis(p, at, axis=1)
            filled[rows] += m
        top = np.argpartition(-value, most - 1, axis=1)[:, :most]
        return np.take_along_axis(comp, top, axis=1), np.take_along_axis(value, top, axis=1)


def _lloyd(f: np.ndarray, k: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A few Lloyd rounds: the mean each row was nearest to, the rows and sums of each mean, and the means."""
    rng = np.random.default_rng(SEED + k)
    c = f[rng.choice(len(f), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0.5 * (c * c).sum(axis=1)
        best = np.concatenate([(f[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(f), 4096)])
        n = np.bincount(best, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, best, f)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return best, n, s, c


def _parted(c: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows that are near each other, in groups of at most ``most``."""
    todo, done = [np.arange(len(c))], []
    while todo:
        m = todo.pop()
        if len(m) <= most:
            done.append(m)
            continue
        own = _lloyd(c[m], math.ceil(2 * len(m) / most))[0]
        parts = [m[own == t] for t in np.unique(own)]
        todo += parts if len(parts) > 1 else np.array_split(m, 2)
    return done


def _start(base: tuple, f: np.ndarray, k: int) -> Mixture:
    """Means of a few Lloyd rounds over the starting sample."""
    best, n, s, c = _lloyd(f, k)
    square = np.zeros(c.shape)
    np.add.at(square, best, f.astype(np.float64) ** 2)
    blank = Mixture(*base, np.full(k, 1 / k), c.astype(np.float64), np.ones(c.shape))
    return blank.update(n.astype(np.float64), s.astype(np.float64), square)


def fit_mixture(codes: DataFrame, rows: int) -> Mixture:
    """The mixture with the least information criterion; every pass covers all rows.

    Only where EM starts from comes from a sample, of about START_ROWS rows or START_PER_COMPONENT for
    each component where that is more. Sizes tried: half, all and twice the square root of the number of
    rows. After CHOICE_ROUNDS the best goes on alone, until a round gains less than GAIN a row, or
    MAX_ROUNDS are done.
    """
    spark = codes.sparkSession

    def moments(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    m = _total(codes, moments, 1 + DIM + DIM * DIM)
    n = max(m[0], 1)
    mean = m[1 : DIM + 1] / n
    values, vectors = np.linalg.eigh(m[DIM + 1 :].reshape(DIM, DIM) / n - np.outer(mean, mean))
    top = np.argsort(-values)[:FEATURES]
    base = (mean.astype(np.float32), (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-9))).astype(np.float32))
    root = math.isqrt(rows) + 1
    sample = sorted(hash_sample(codes.select("id", "code"), rows, max(START_ROWS, START_PER_COMPONENT * 2 * root), SEED).collect())
    f = ((decode([r[1] for r in sample])[0] - base[0]) @ base[1]).astype(np.float32)
    models = [_start(base, f, k) for k in sorted({max(1, min(k, len(f))) for k in (root // 2, root, 2 * root)})]
    for turn in range(MAX_ROUNDS):
        shape = [(len(g.weight), FEATURES) for g in models]
        width = sum(k * (1 + 2 * d) + 1 for k, d in shape)
        nearby = [Nearby(g) for g in models]
        sent = spark.sparkContext.broadcast(nearby)

        def expectation(x: np.ndarray) -> np.ndarray:
            out = []
            powers = _powers(sent.value[0].mixture.features(x))
            for g in sent.value:
                sums, likelihood = g.expected(powers)
                d = (powers.shape[1] - 1) // 2
                out += [sums[:, -1], sums[:, d:-1].ravel(), sums[:, :d].ravel(), [likelihood]]
            return np.concatenate(out)

        sums, at, fitted = _total(codes, expectation, width, step=min(g.step for g in nearby)), 0, []
        for g, (k, d) in zip(models, shape):
            own = sums[at : at + k * (1 + 2 * d) + 1]
            at += len(own)
            new = g.update(own[:k], own[k : k + k * d].reshape(k, d), own[k + k * d : -1].reshape(k, d))
            new.likelihood = float(own[-1])  # as the criterion, of the parameters before this update
            new.bic = -2 * new.likelihood + (k * (1 + 2 * d) - 1) * math.log(max(rows, 2))
            fitted.append(new)
        sent.unpersist()
        last, models = models, fitted
        if turn + 1 >= CHOICE_ROUNDS:
            best = min(range(len(models)), key=lambda i: models[i].bic)
            last, models = last[best], [models[best]]
            if models[0].likelihood - last.likelihood < GAIN * rows:
                break
    return models[0]


def _comparison(similarity: float, held: int = HELD):
    """Links of the rows of one block: a forest of what is similar for sure, and the pairs that codes leave open.

    About ``held`` similarities, and as many open pairs, are in memory at once. Sure pairs join their rows as
    they are found, so that pairs of joined rows are not looked at again; rows with one root are joined already.
    """

    def pairs(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, raw = table.column("id").to_numpy(zero_copy_only=False), raw_rows(table.column("code"), CODE_BYTES + 8)
        root = np.ascontiguousarray(raw[:, CODE_BYTES:]).view("<i8")[:, 0]
        x, lost = decoded(raw)
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        names, node = np.unique(np.where(root == NONE, ids, root), return_inverse=True)  # an asking row is a member too
        label = np.arange(len(names), dtype=np.int32)
        # where asking rows are members too, each pair of them is compared once: rows before it are done
        both = (asks & member).any()
        q, m = np.flatnonzero(asks), np.concatenate([np.flatnonzero(asks & member), np.flatnonzero(~asks & member)])
        x_q, x_m, worst = x[q], x[m], lost.max(initial=0)
        step = min(512, max(1, held // max(len(m), 1)))
        open_ = np.empty((2, 0), np.int32)
        for i in range(0, len(q), step):
            done = i if both else 0
            own, others = q[i : i + step], m[done:]
            s = x_q[i : i + step] @ x_m[done:].T
            near = s >= similarity - 1.05 * (lost[own].max() + worst)
            near &= label[node[own]][:, None] != label[node[others]][None, :]
            r, c = np.nonzero(near)
            a, b, value = own[r], others[c], s[r, c]
            off = 1.05 * (lost[a] + lost[b])
            yes, maybe = value >= similarity + off, np.abs(value - similarity) < off
            if yes.any():
                label = forest(len(names), label[node[a[yes]]], label[node[b[yes]]]).astype(np.int32)[label]
            open_ = np.concatenate([open_, np.stack([a[maybe], b[maybe]]).astype(np.int32)], axis=1)
            if open_.shape[1] > held or i + step >= len(q):
                open_ = open_[:, label[node[open_[0]]] != label[node[open_[1]]]]
            if open_.shape[1] > held:
                yield pairs(ids[open_].min(axis=0), ids[open_].max(axis=0), False)
                open_ = open_[:, :0]
        tied = np.flatnonzero(label != np.arange(len(names)))
        yield pairs(names[tied], names[label[tied]], True)
        yield pairs(ids[open_].min(axis=0), ids[open_].max(axis=0), False)

    return compare


class Clusters:
    """Groups of current points with usable vectors, chained by cosine similarity of at least ``similarity``.

    Points that are similar to nobody, or whose group has fewer than ``min_size`` points, belong nowhere.
    An empty table gives no groups; repeated deliveries count once; identical vectors are similar.
    ``exact`` compares beyond components too, wherever distances from pivots leave it possible that rows
    of different groups are similar: then no link is missed, and the work may grow with the square of
    the rows.
    """

    def __init__(self, points: DataFrame, similarity: float = SIMILARITY, min_size: int = MIN_SIZE, components: int = 4, exact: bool = False):
        self.points, self.similarity, self.min_size, self.per_row = points, similarity, min_size, components
        self.spark = points.sparkSession
        self.codes = current_codes(points)
        rows = self.codes.count()
        self.mixture = fit_mixture(self.codes, rows) if rows else None
        self.labels = self._link() if rows else self.spark.createDataFrame([], "id long, component long")
        if rows and exact:
            self.labels = self._completed(self.labels, rows)

    def _placed(self, sent):
        """Per batch: codes, log densities, and (row, component) of the components of highest posterior."""
        per_row = self.per_row

        def place(codes):
            g = sent.value
            x, lost = decode(codes)
            top, value = g.best(_powers(g.mixture.features(x)), min(per_row, len(g.mixture.weight)))
            row, at = np.nonzero(value >= value.max(axis=1, keepdims=True) - 30.0)
            return x, lost, row, top[row, at], value[row, at]

        return place

    def _representatives(self, place, step: int):
        """At most REPRESENTATIVES members of highest density of each component, best of each task first."""
        k = len(self.mixture.weight)

        def run(batches):
            held: dict = {}
            least = np.full(k, -np.inf)  # of the representatives of a component, once it has all
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    _, _, row, comp, value = place(part.column(1))
                    ids, codes = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                    order = np.lexsort((ids[row], -value, row))
                    first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
                    order = first[np.lexsort((ids[row[first]], -value[first], comp[first]))]
                    start = np.r_[0, np.flatnonzero(np.diff(comp[order])) + 1] if len(order) else order
                    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
                    taken = order[(rank < REPRESENTATIVES) & (value[order] >= least[comp[order]])]
                    for j in taken:
                        held.setdefault(int(comp[j]), []).append((-float(value[j]), int(ids[row[j]]), codes[int(row[j])].as_py()))
                    for c in np.unique(comp[taken]).tolist():
                        held[c] = sorted(held[c])[:REPRESENTATIVES]
                        if len(held[c]) == REPRESENTATIVES:
                            least[c] = -held[c][-1][0]
            out = [(c, v, i, code) for c, rows in held.items() for v, i, code in rows]
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["comp", "v", "id", "code"])

        best = Window.partitionBy("comp").orderBy("v", "id")
        found = self.codes.select("id", "code").mapInArrow(run, "comp int, v double, id long, code binary")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= REPRESENTATIVES).select("comp", "id", "code").collect()  # REPRESENTATIVES a component

    def _link(self) -> DataFrame:
        similarity = self.similarity
        k = len(self.mixture.weight)
        nearby = Nearby(self.mixture)
        sent, step = self.spark.sparkContext.broadcast(nearby), nearby.step
        place = self._placed(sent)
        reps: dict = {}
        for r in sorted(self._representatives(place, step), key=lambda r: (r[0], r[1])):
            reps.setdefault(r[0], []).append(r)
        # by component, in rows of REPRESENTATIVES; a place that is not taken is similar to nothing
        r_x, r_lost, r_root = np.zeros((k, REPRESENTATIVES, DIM), np.float32), np.full((k, REPRESENTATIVES), np.inf, np.float32), np.full((k, REPRESENTATIVES), NONE)
        for c, rows in reps.items():
            x, lost = decode([r[2] for r in rows])
            ids = np.array([r[1] for r in rows])
            a, b = np.nonzero(x @ x.T - (lost[:, None] + lost) * 1.05 >= similarity)
            r_x[c, : len(ids)], r_lost[c, : len(ids)], r_root[c, : len(ids)] = x, lost, ids[forest(len(ids), a, b)]
        stand = self.spark.sparkContext.broadcast((r_x, r_lost, r_root))

        def explain(batches):
            """Per row its components, in each the representative that explains it (NONE if none does), and its links."""
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    x, lost, row, comp, _ = place(part.column(1))
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(comp, kind="stable")
                    row, comp = row[order], comp[order]
                    r_x, r_lost, r_root = stand.value
                    near = np.zeros((len(row), REPRESENTATIVES), bool)
                    for j in range(0, len(row), 2048):
                        r, c = row[j : j + 2048], comp[j : j + 2048]
                        near[j : j + 2048] = np.matmul(r_x[c], x[r][:, :, None])[:, :, 0] - (lost[r][:, None] + r_lost[c]) * 1.05 >= similarity
                    has = near.any(axis=1)
                    root = r_root[comp, near.argmax(axis=1)]
                    m, h = np.nonzero(near)
                    links = np.stack([ids[row[m]], r_root[comp[m], h]], axis=1)
                    links = links[links[:, 0] != links[:, 1]]
                    links = links[np.lexsort(links.T)]
                    links = links[np.r_[True, (links[1:] != links[:-1]).any(axis=1)]] if len(links) else links
                    by_row = np.argsort(row, kind="stable")
                    lists = _list_array(row[by_row], part.num_rows, pa.array(comp[by_row].astype(np.int32)))
                    roots = _list_array(row[by_row], part.num_rows, pa.array(np.where(has, root, NONE)[by_row]))
                    tied = np.searchsorted(ids[by_id := np.argsort(ids, kind="stable")], links[:, 0])
                    owner = by_id[tied] if len(links) else tied
                    order = np.argsort(owner, kind="stable")
                    joined = _list_array(owner[order], part.num_rows, pa.array(links[order, 1]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, roots, joined], ["id", "code", "lists", "roots", "links"])

        # one row an id, so that its code is written once; it is repeated per component only on the way to the blocks
        placed = materialise(self.codes.select("id", "code").mapInArrow(explain, "id long, code binary, lists array<int>, roots array<long>, links array<long>"), "placed")
        cells = placed.select("id", "code", F.explode(F.arrays_zip("lists", "roots")).alias("at")).select(F.col("at.lists").alias("list"), "id", "code", F.col("at.roots").alias("root"))
        narrow = cells.select("list", "id", "root")
        # where one representative explains most rows of a component, only the other rows ask
        counts = narrow.where(F.col("root") != NONE).groupBy("list", "root").count()
        main = counts.groupBy("list").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        cells = cells.join(F.broadcast(main), "list", "left").withColumn("asks", (F.col("root") == NONE) | F.coalesce(F.col("root") != F.col("main"), F.lit(True))).drop("main")  # main: a row a component
        flags = narrow.join(F.broadcast(main), "list", "left").select("list", ((F.col("root") == NONE) | F.coalesce(F.col("root") != F.col("main"), F.lit(True))).alias("asks"))
        members, asking = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for r in flags.groupBy("list").agg(F.count("*"), F.sum(F.col("asks").cast("int"))).collect():  # a row a component
            members[r[0]], asking[r[0]] = r[1], r[2]
        cells = cells.select("list", "id", _appended("code", F.col("root")).alias("code"), "asks")
        split = [int(i) for i in np.flatnonzero((members > CELL_ROWS) | (asking > CELL_ROWS))]
        is_split = F.col("list").isin(split) if split else F.lit(False)
        columns = ["list", "block", "q_block", "asks", "member", "id", "code"]
        # in a component of one block a row is sent once and is both sides; a split one has its two sides apart
        whole = cells.where(~is_split).withColumns({"block": F.lit(0), "q_block": F.lit(0), "member": F.lit(True)})
        # where most rows ask, both sides have the same blocks, and two blocks meet once: an asking member goes to those up to its own
        asking = np.where(2 * asking >= members, members, asking)
        uneven = [i for i in split if -(-members[i] // CELL_ROWS) != max(1, -(-asking[i] // CELL_ROWS))]
        once = F.col("asks") & (F.col("q_block") > F.col("block")) & (~F.col("list").isin(uneven) if uneven else F.lit(True))
        left = _blocks(cells.where(is_split), "block", "q_block", members, asking, k, CELL_ROWS, "asks").where(~once).withColumns({"asks": F.lit(False), "member": F.lit(True)})
        right = _blocks(cells.where(is_split & F.col("asks")), "q_block", "block", asking, members, k, CELL_ROWS).withColumns({"asks": F.lit(True), "member": F.lit(False)})

        sides = whole.select(columns).unionByName(left.select(columns)).unionByName(right.select(columns))
        found = in_blocks(sides, members, asking, CELL_ROWS).applyInArrow(_comparison(similarity), "a long, b long, sure boolean")
        found = materialise(found, "links")
        copies = self.codes.groupBy("h1", "h2").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = self.codes.select("id", "h1", "h2").join(copies, ["h1", "h2"]).select(F.col("id").alias("a"), "b")
        edges = placed.select(F.col("id").alias("a"), F.explode("links").alias("b")).unionByName(found.where("sure").select("a", "b")).unionByName(copies)
        labels = materialise(connected_components(edges), "labels")
        return self._joined(labels, found.where("not sure").select("a", "b"))

    def _joined(self, labels: DataFrame, open_: DataFrame, sure: DataFrame | None = None) -> DataFrame:
        """Labels closed over the pairs that are similar: the ``sure`` ones, and of ``open_`` those that are by their vectors.

        Pairs too close to call matter only between two groups.
        """
        one, two = (labels.select(F.col("id").alias(n), F.col("component").alias(f"g_{n}")) for n in ("a", "b"))

        def between(pairs: DataFrame) -> DataFrame:
            pairs = pairs.select("a", "b").distinct().join(one, "a", "left").join(two, "b", "left")
            return pairs.select("a", "b", F.coalesce("g_a", "a").alias("g_a"), F.coalesce("g_b", "b").alias("g_b")).where("g_a <> g_b")

        close = exact_similarities(self.points, self.codes, between(open_)).where(F.col("similarity") >= self.similarity).drop("similarity")
        close = materialise(close if sure is None else close.unionByName(between(sure)), "close")
        merged = connected_components(close.select("g_a", "g_b"), "g_a", "g_b")
        whole = labels.unionByName(close.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id")))
        joined = whole.join(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
        return materialise(joined.select("id", F.coalesce("top", "component").alias("component")), "labels")

    def _completed(self, labels: DataFrame, rows: int) -> DataFrame:
        """Labels closed over all similar pairs.

        A row is a member of the list of its nearest pivot. It asks its own list, and of those before it
        each whose farthest member can be within reach by the triangle inequality.
        """
        similarity, reach = self.similarity, math.sqrt(max(2 - 2 * self.similarity, 0))
        sample = sorted(hash_sample(self.codes.select("id", "code"), rows, START_ROWS, SEED + 1).collect())
        pivots = balanced_centroids(decode([r[1] for r in sample])[0], math.isqrt(rows) + 1)

        def distances(codes):
            x, lost = decode(codes)
            square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
            return np.sqrt(np.maximum(square, 0)), lost

        def own(batches):
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    part = b.slice(i, 4096)
                    d, lost = distances(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1).astype(np.float64)), pa.array(lost.astype(np.float64))], ["id", "code", "list", "d", "lost"])

        labelled = self.codes.select("id", "code").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = materialise(self.codes.select("id", "code").mapInArrow(own, "id long, code binary, list int, d double, lost double"), "pivots")
        radius, off, members = np.full(len(pivots), -np.inf), 0.0, np.zeros(len(pivots), np.int64)
        for r in placed.groupBy("list").agg(F.max("d"), F.max("lost"), F.count("*")).collect():  # a row a pivot
            radius[r[0]], off, members[r[0]] = r[1], max(off, r[2]), r[3]

        def asking(batches):
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    part = b.slice(i, 4096)
                    d, lost = distances(part.column(1))
                    near = (d <= radius[None, :] + reach + lost[:, None] + off + 1e-4) & (np.arange(len(pivots))[None, :] <= d.argmin(axis=1)[:, None])
                    row, at = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), part.column(0).take(pa.array(row))], ["list", "id"])

        asked = materialise(placed.select("id", "code").mapInArrow(asking, "list int, id long"), "asked")
        asks = np.zeros(len(pivots), np.int64)
        for r in asked.groupBy("list").count().collect():  # a row a pivot
            asks[r[0]] = r[1]
        full = labelled.select("id", _appended("code", F.col("component")).alias("code"))
        sides = [(placed.select("list", "id").join(full, "id"), "block", "q_block", members, asks, False), (asked.join(full, "id"), "q_block", "block", asks, members, True)]
        columns = ["list", "block", "q_block", "asks", "member", "id", "code"]
        left, right = (_blocks(df, mine, other, n, m, len(pivots), CELL_ROWS).withColumns({"asks": F.lit(side), "member": F.lit(not side)}).select(columns) for df, mine, other, n, m, side in sides)
        found = in_blocks(left.unionByName(right), members, asks, CELL_ROWS).applyInArrow(_comparison(similarity), "a long, b long, sure boolean")
        found = materialise(found, "links")
        return self._joined(labels, found.where("not sure"), found.where("sure"))

    def members(self) -> DataFrame:
        """``(group_id, id)``: a row for each point of each group of at least min_size; group_id is its smallest id."""
        large = self.labels.groupBy(F.col("component").alias("group_id")).agg(F.count("*").alias("n")).where(F.col("n") >= self.min_size)
        return self.labels.select(F.col("component").alias("group_id"), "id").join(large.select("group_id"), "group_id")

    def describe(self) -> DataFrame:
        """``(group_id, size, coherence, centroid)``: mean of the unit vectors, and the mean cosine to it; in double, of the stored vectors."""
        members = materialise(self.members(), "grouped")
        rows = members.join(stored_vectors(self.points, self.codes, members.select("id")), "id").select("group_id", "embedding")

        def sums(batches):
            for b in batches:
                names, place_ = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                total = np.zeros((len(names), DIM))
                np.add.at(total, place_, unit(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, DIM)))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(place_, minlength=len(names))), pa.array(list(total), pa.list_(pa.float64()))], ["group_id", "n", "s"])

        def add(table: pa.Table) -> pa.Table:
            s = np.array(table.column("s").to_pylist()).sum(axis=0)
            n = sum(table.column("n").to_pylist())
            # the mean of the cosines of unit vectors to their mean is the length of the mean
            return pa.table({"group_id": [table.column("group_id")[0].as_py()], "size": [n], "coherence": [float(np.linalg.norm(s) / n)], "centroid": pa.array([s / n], pa.list_(pa.float64()))})

        partial = rows.mapInArrow(sums, "group_id long, n long, s array<double>")  # a row a group and batch
        return partial.groupBy("group_id").applyInArrow(lambda t: add(t), "group_id long, size long, coherence double, centroid array<double>")

    def typical(self, most: int = 5) -> DataFrame:
        """``(group_id, rank, id, log_density)``: the members of each group at which the mixture is densest, ties to the smaller id."""
        dense = self.densities().join(self.members(), "id")
        best = Window.partitionBy("group_id").orderBy(F.desc("log_density"), "id")
        return dense.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("group_id", "rank", "id", "log_density")

    def densities(self) -> DataFrame:
        """``(id, component, log_density)``: the component of highest posterior of each point, and the log of its weighted density there."""
        if self.mixture is None:
            return self.spark.createDataFrame([], "id long, component int, log_density double")
        sent, step = self.spark.sparkContext.broadcast(self.mixture), _chunk(len(self.mixture.weight))

        def density(batches):
            for b in batches:
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    g = sent.value
                    p = g.log_parts(g.features(decode(part.column(1))[0]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1).astype(np.float64))], ["id", "component", "log_density"])

        return self.codes.select("id", "code").mapInArrow(density, "id long, component int, log_density double")

    def components(self, most: int = 5) -> DataFrame:
        """``(component, size, mean_log_density, typical_ids)`` of the mixture itself: every point in the component of highest posterior."""
        placed = materialise(self.densities(), "placed")
        best = Window.partitionBy("component").orderBy(F.desc("log_density"), "id")
        named = placed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).groupBy("component")
        named = named.agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda v: v["id"]).alias("typical_ids"))
        return placed.groupBy("component").agg(F.count("*").alias("size"), F.avg("log_density").alias("mean_log_density")).join(named, "component")

    def member_lists(self, part_rows: int = 4096) -> DataFrame:
        """``(group_id, part, vector_ids)``: the members in lists of about ``part_rows``, so no list grows with a group."""
        sizes = self.members().groupBy("group_id").agg(F.count("*").alias("n"))
        parts = self.members().join(sizes, "group_id").withColumn("part", (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % F.ceil(F.col("n") / part_rows)).cast("int"))
        return parts.groupBy("group_id", "part").agg(F.sort_array(F.collect_list("id")).alias("vector_ids"))


NONE = -(2**63)


def _list_array(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values in order of their rows as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _appended(code: str, number):
    """The 8 bytes of a whole number, least first, behind a binary column."""
    hex_ = F.lpad(F.hex(number), 16, "0")
    parts = [F.unhex(F.substring(hex_, 15 - 2 * i, 2)) for i in range(8)]
    return F.concat(F.col(code), *parts)


def grouped_points(points: DataFrame) -> DataFrame:
    return Clusters(points).members()
