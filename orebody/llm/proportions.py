"""Samples whose category shares match given targets: raked weights, weighted exponential keys, repair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.columns import category
from orebody.llm._util import current_categories, smallest_per_group, unit_draw
from orebody.workspace import materialise

SEED = 11


def targets_of(sample_targets: DataFrame) -> DataFrame:
    """Targets with categories in normal form; a null source or layer means any and stays null.

    A blank name stands for the category of blanks. Rows without plan or share are left out.
    """
    norm = lambda c, missing: F.when(F.col(c).isNotNull(), category(c, missing))
    return sample_targets.where("plan_name is not null and target_share is not null and sample_share is not null").select(
        "target_id", "plan_name", norm("source", "unknown").alias("source"), norm("layer", "surface").alias("layer"),
        F.col("target_share").cast("double"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.col("sample_share").cast("double"),
    )


def rake(counts: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Cell shares fitted to all margins by iterative proportional fitting, starting from the counts.

    margins: for each one the category index of every cell (-1: in none, weight 0) and the wanted shares.
    A category without rows keeps share 0; the rest are scaled to sum to one.
    """
    w = counts.astype(np.float64)
    for index, _ in margins:
        w = np.where(index >= 0, w, 0)
    if w.sum() == 0:
        return w
    w /= w.sum()
    for _ in range(rounds):
        last = w.copy()
        for index, share in margins:
            have = np.bincount(index[index >= 0], w[index >= 0], minlength=len(share))
            factor = np.divide(share, have, out=np.zeros(len(share)), where=have > 0)
            w = np.where(index >= 0, w * factor[np.maximum(index, 0)], 0)
        total = w.sum()
        w = w / total if total > 0 else w
        if np.abs(w - last).max() < tol:
            break
    return w


class Plan:
    """One plan's targets over the cells (source, layer) of the collection: weights, and repair of a draw.

    Cells with the same source and layer in all targets are one cell, so there are few of them.
    """

    def __init__(self, targets: list, cells: list, total: int):
        self.targets, self.cells, self.total = targets, cells, total
        self.counts = np.array([c["n"] for c in cells], dtype=np.int64)
        self.name, self.size = targets[0]["plan_name"], round(targets[0]["sample_share"] * total)
        self.margins: list[tuple[np.ndarray, np.ndarray]] = []  # category of each cell (-1: none), share of each category
        self.least: list[np.ndarray] = []  # rows each category must have
        self.own: dict = {}
        for pattern in sorted({(t["source"] is not None, t["layer"] is not None) for t in targets}):
            of_pattern = [t for t in targets if (t["source"] is not None, t["layer"] is not None) == pattern]
            place: dict = {}
            for t in of_pattern:  # a category named twice is one category with the summed share
                place.setdefault((t["source"], t["layer"]), len(place))
            index = np.array([place.get((c["source"] if pattern[0] else None, c["layer"] if pattern[1] else None), -1) for c in cells], dtype=np.int64)
            share, least = np.zeros(len(place)), np.zeros(len(place), np.int64)
            for t in of_pattern:
                at = place[t["source"], t["layer"]]
                share[at] += t["target_share"]
                least[at] = max(least[at], t["min_rows"])
                self.own[t["target_id"]] = index == at
            if share.sum() > 0:
                share /= share.sum()
            self.margins.append((index, share))
            self.least.append(least)
        fitted = rake(self.counts, [(i, s) for i, s in self.margins if s.sum() > 0]) if len(cells) else self.counts
        #: Draw weight of a row of each cell.
        self.weight = np.divide(fitted, self.counts, out=np.zeros(len(cells)), where=self.counts > 0)
        self.size = int(min(self.size, self.counts[self.weight > 0].sum()))

    def threshold(self) -> float:
        """The key -ln(u) / weight below which the plan's size is expected to lie; it scales keys into (0, 1)."""
        live = self.weight > 0
        if not live.any() or not self.size:
            return 1.0
        low, high = 0.0, 1.0
        expected = lambda t: (self.counts[live] * -np.expm1(-self.weight[live] * t)).sum()
        while expected(high) < self.size - 1e-6 and high < 1e18:
            high *= 2
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < self.size else (low, middle)
        return high

    def _have(self, drawn: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(index[index >= 0], drawn[index >= 0], minlength=len(share)) for index, share in self.margins]

    def repaired(self, drawn: np.ndarray) -> np.ndarray:
        """The draw with rows moved between cells until no category lacks what other categories can spare.

        First each category's ``min_rows``, then the whole rows of its share too. A move takes from a cell
        whose categories have more than they need and gives to one with rows left; the size stays.
        """
        drawn = drawn.astype(np.int64).copy()
        for shares in (False, True):
            goals = []
            for (index, share), least in zip(self.margins, self.least):
                stock = np.bincount(index[index >= 0], self.counts[index >= 0], minlength=len(share))
                goals.append(np.minimum(np.maximum(least, np.floor(share * self.size + 1e-9) if shares else 0), stock).astype(np.int64))
            stuck: set = set()
            while True:
                have = self._have(drawn)
                lack = [(int(goal[c] - h[c]), m, c) for m, (goal, h) in enumerate(zip(goals, have)) for c in range(len(goal)) if goal[c] > h[c] and (m, c) not in stuck]
                if not lack:
                    break
                need, m, c = max(lack, key=lambda x: (x[0], -x[1], -x[2]))
                takes = np.flatnonzero((self.margins[m][0] == c) & (self.counts > drawn))
                gives = np.flatnonzero((self.margins[m][0] != c) & (drawn > 0))
                room = np.minimum((self.counts - drawn)[takes][:, None], drawn[gives][None, :]).astype(np.float64)
                for (index, _), goal, h in zip(self.margins, goals, have):
                    spare = np.append(np.maximum(h - goal, 0), np.inf)[index[gives]]  # cells of no category give freely
                    room = np.minimum(room, np.where(index[takes][:, None] == index[gives][None, :], np.inf, spare[None, :]))
                most = int(min(room.max(initial=0), need))
                if most <= 0:
                    stuck.add((m, c))
                    continue
                # of the moves that can be made, the one between the cells that differ most from their weights
                gap = (self.weight * self.counts * self.size - drawn)
                score = np.where(room >= 1, gap[takes][:, None] - gap[gives][None, :], -np.inf)
                r, d = np.unravel_index(int(score.argmax()), score.shape)
                moved = int(min(room[r, d], need, max(1, abs(score[r, d]) // 2 if np.isfinite(score[r, d]) else 1)))
                drawn[takes[r]] += moved
                drawn[gives[d]] -= moved
        return drawn

    def report(self, drawn: np.ndarray) -> list[tuple]:
        """A row of each target. ``unmet``: rows that lack even if the repair took all that the draw has left of the category."""
        got, out = max(int(drawn.sum()), 1), []
        for t in self.targets:
            own = self.own[t["target_id"]]
            need = max(float(t["min_rows"]), t["target_share"] * t["sample_share"] * self.total)
            have, left = int(drawn[own].sum()), int((self.counts - drawn)[own].sum())
            unmet = max(0.0, need - have - left)
            out.append((t["target_id"], t["plan_name"], t["source"], t["layer"], float(t["target_share"]), have + left, have, need, unmet, have / got, have / got - t["target_share"], unmet <= 0))
        return out


REPORT = "target_id long, plan_name string, source string, layer string, target_share double, available long, drawn long, needed double, unmet double, actual_share double, gap double, met boolean"


class ProportionalSample:
    """A sample of the current points for each plan.

    Row weights are raked over the plan's margins; the rows with the smallest weighted exponential keys
    -ln(u) / weight are drawn, u from the id's hash, so a run can be repeated. Categories below their
    minimum or below the whole rows of their share are then repaired: the draw goes on in them, and the
    rows drawn last are given back in categories with more than their due. A plan without matching rows
    draws none. Null categories are ``unknown`` and ``surface``; repeated deliveries count once; empty
    tables give an empty result.
    """

    def __init__(self, points: DataFrame, sample_targets: DataFrame, seed: int = SEED):
        self.spark, self.seed = points.sparkSession, seed
        self.now = materialise(current_categories(points), "categories")
        targets = targets_of(sample_targets).orderBy("plan_name", "target_id").collect()  # as small as the list of targets
        sources, layers = ({t[k] for t in targets if t[k] is not None} for k in ("source", "layer"))
        # categories that no target names fall into one cell, so there are at most (targets + 1) squared cells
        fold = lambda c, known: F.when(F.col(c).isin(*known), F.col(c)) if known else F.lit(None).cast("string")
        self.folded = self.now.select("id", fold("source", sources).alias("source"), fold("layer", layers).alias("layer"))
        cells = sorted(self.folded.groupBy("source", "layer").agg(F.count("*").alias("n")).collect(), key=lambda r: (r[0] or "", r[1] or ""))
        self.total = sum(c["n"] for c in cells)
        self.plans = [Plan([t for t in targets if t["plan_name"] == name], cells, self.total) for name in sorted({t["plan_name"] for t in targets})]
        drawn = self._drawn()
        self.final = {p.name: p.repaired(drawn[p.name]) for p in self.plans}

    def _keyed(self, columns: str, rows: list[tuple]) -> DataFrame:
        """Each row with its uniform number once for each plan that weighs its cell, and the plan's ``columns``."""
        cells = self.spark.createDataFrame(rows, f"plan_name string, cell int, q_source string, q_layer string, {columns}")
        on = F.col("source").eqNullSafe(F.col("q_source")) & F.col("layer").eqNullSafe(F.col("q_layer"))
        joined = self.folded.join(F.broadcast(cells), on)  # plans times cells
        return joined.select("plan_name", "cell", "id", unit_draw(self.seed, "plan_name", "id").alias("u"), *[c.split()[0] for c in columns.split(", ")])

    def _drawn(self) -> dict[str, np.ndarray]:
        """Rows of each cell among the ``size`` smallest keys of each plan."""
        rows = [(p.name, i, c["source"], c["layer"], float(p.weight[i] * p.threshold()), p.size) for p in self.plans for i, c in enumerate(p.cells) if p.weight[i] > 0]
        # t / (1 + t) keeps the order of the keys t and lies in (0, 1); half is where the draw is expected to end
        t = -F.log("u") / F.col("scaled")
        keyed = self._keyed("scaled double, size long", rows).withColumn("key", t / (1 + t)).drop("u", "scaled")
        first = smallest_per_group(keyed, ["plan_name"], "key", "size", self.total)
        out = {p.name: np.zeros(len(p.cells), np.int64) for p in self.plans}
        for r in first.groupBy("plan_name", "cell").count().collect():  # plans times cells
            out[r[0]][r[1]] = r[2]
        return out

    def report(self) -> DataFrame:
        """Per target: rows available, needed and drawn, the rows that can't be had, the actual share, its gap, and whether the target is met."""
        return self.spark.createDataFrame([row for p in self.plans for row in p.report(self.final[p.name])], REPORT)

    def sample(self) -> DataFrame:
        """``(plan_name, id, source, layer)``: of each cell the rows with the smallest keys, as many as the repaired draw has."""
        rows = [(p.name, i, c["source"], c["layer"], int(self.final[p.name][i])) for p in self.plans for i, c in enumerate(p.cells) if self.final[p.name][i] > 0]
        # within a cell all weights are equal, so -ln(u) orders its rows as the keys do
        keyed = self._keyed("quota long", rows).withColumn("key", 1 - F.col("u")).drop("u")
        chosen = smallest_per_group(keyed, ["plan_name", "cell"], "key", "quota", self.total)
        return chosen.select("plan_name", "id").join(self.now, "id")


def target_report(points: DataFrame, sample_targets: DataFrame) -> DataFrame:
    return ProportionalSample(points, sample_targets).report()


def proportional_sample(points: DataFrame, sample_targets: DataFrame, seed: int = SEED) -> DataFrame:
    return ProportionalSample(points, sample_targets, seed).sample()


def unmet_targets(points: DataFrame, sample_targets: DataFrame) -> DataFrame:
    """``(target_id)`` of targets that the repaired sample can't meet, whatever is left of their category."""
    return target_report(points, sample_targets).where("unmet > 0").select("target_id")
