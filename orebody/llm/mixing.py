"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.columns import source_category
from orebody.llm._util import unit_draw
from orebody.workspace import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BUDGET_SHARE = 0.4
SEED = 23
SLICE_ROWS = 20_000


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)`` with tokens of a public tokenizer; null and empty texts have none.

    The driver reads the vocabulary (about 1 MB) and sends it to the tasks.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        encode = _encoding(ranks.value).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return documents.select("doc_id", source_category().alias("source"), "text").mapInArrow(count, "doc_id long, source string, tokens long")


def target_weights(mix_targets: DataFrame) -> DataFrame:
    """``(source, weight, max_repeats)``: sources in normal form, shares of one source summed, null repeats one."""
    return mix_targets.where("target_share is not null").groupBy(source_category().alias("source")).agg(
        F.sum("target_share").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )


def source_totals(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """``(source, weight, max_repeats, tokens, documents, longest)``: per target source what its documents hold."""
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("tokens").alias("longest"))
    return weights.join(have, "source", "left").select("source", "weight", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "longest")])


def spent_at(budget: float, sources: list[tuple[float, float]]) -> float:
    """The virtual time until which sources of (weight, tokens to give) have given ``budget``; infinite if they can't."""
    ends = sorted((limit / weight, weight) for weight, limit in sources if weight > 0)
    given, at, active = 0.0, 0.0, sum(w for _, w in ends)
    for end, weight in ends:
        if given + (end - at) * active >= budget:
            return at + (budget - given) / active
        given, at, active = given + (end - at) * active, end, active - weight
    return math.inf


def _running(df: DataFrame, group: list[str], slice_: str, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` in the group's order. Slices are summed first, so no task holds a whole group."""
    sums = df.groupBy(*group, slice_).agg(F.sum(value).alias("__s"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__s").over(over.orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*group, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [*group, slice_]).withColumn(name, F.col("__base") + F.sum(value).over(inside)).drop("__base")


def queued(tokens: DataFrame, totals: DataFrame, until: float, rows: int, seed: int = SEED) -> DataFrame:
    """The allowed copies of each document whose virtual finish time is at most ``until``.

    The documents of a source are shuffled by a hash; pass r comes after all of pass r - 1. Finish time:
    the source's tokens so far divided by its weight. Later copies are never made.
    """
    targets = F.broadcast(totals.where("weight > 0 and max_repeats > 0").select("source", "weight", "max_repeats", F.col("tokens").alias("__all")))  # one row a target
    docs = tokens.join(targets, "source")
    docs = docs.withColumn("__u", unit_draw(seed, "doc_id")).withColumn("__slice", F.floor(F.col("__u") * max(1, math.ceil(rows / SLICE_ROWS))))
    docs = _running(docs, ["source"], "__slice", ["__u", "doc_id"], "tokens", "__done")
    last = F.floor((F.lit(until) * F.col("weight") - F.col("__done")) / F.col("__all")) + 2 if math.isfinite(until) else F.col("max_repeats")
    passes = F.least(F.col("max_repeats").cast("long"), F.when(F.col("__all") > 0, last).otherwise(F.col("max_repeats")).cast("long"))
    copies = docs.where(passes >= 1).withColumn("pass", F.explode(F.sequence(F.lit(1), passes.cast("int"))))
    copies = copies.select("doc_id", "source", "pass", "tokens", (((F.col("pass") - 1) * F.col("__all") + F.col("__done")) / F.col("weight")).alias("finish"))
    return copies.where(F.col("finish") <= F.lit(until))


class Mixture:
    """The queue of all documents, cut at the budget.

    ``used``: ``(doc_id, source, pass, tokens, finish)``, the copies used, sorted by ``finish``. All
    copies are put in order of virtual finish time by slices of it, and cut where their tokens reach
    ``budget_share`` of the tokens of all documents. A source that runs out leaves its share to the
    others in proportion to their weights. Documents of sources without target aren't used; those
    without tokens finish with the one before. Shares that sum to more than one are spent sooner. Empty
    tables give an empty result.
    """

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, budget_share: float = BUDGET_SHARE, tokenizer: str = TOKENIZER, seed: int = SEED):
        tokens = materialise(token_counts(documents, tokenizer), "tokens")
        self.totals = materialise(source_totals(tokens, target_weights(mix_targets)), "totals")
        total, rows = tokens.agg(F.sum("tokens"), F.count("*")).first()
        self.budget = budget_share * (total or 0)
        each = self.totals.collect()  # one row a target
        # each source is at most one document short of its due, so by then the budget is spent
        slack = sum(r["longest"] for r in each)
        until = spent_at(self.budget + slack, [(r["weight"], float(r["tokens"] * max(r["max_repeats"], 0))) for r in each])
        queue = materialise(queued(tokens, self.totals, until, rows, seed), "queue")
        last, copies = queue.agg(F.max("finish"), F.count("*")).first()
        sliced = queue.withColumn("__slice", F.floor(F.col("finish") / F.lit(last or 1.0) * max(1, math.ceil(copies / SLICE_ROWS))))
        summed = _running(sliced, [], "__slice", ["finish", "source", "pass", "doc_id"], "tokens", "__sum")
        used = summed.where(F.col("__sum") <= F.lit(self.budget)).drop("__sum", "__slice")
        self.used = materialise(used.repartitionByRange("finish").sortWithinPartitions("finish", "source", "pass", "doc_id"), "mixture")

    def report(self) -> DataFrame:
        """Per target source its target and actual share of the mixture, tokens used, and whether it falls short.

        A source falls short if the cut has left none of its copies over, and they are fewer tokens than its due.
        """
        per = self.used.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("pass").alias("passes"), F.count("*").alias("copies"))
        everything = self.used.agg(F.sum("tokens")).first()[0] or 0
        rows = self.totals.join(per, "source", "left").na.fill(0, ["used_tokens", "passes", "copies"])
        short = (F.col("copies") >= F.col("documents") * F.greatest("max_repeats", F.lit(0))) & (F.col("used_tokens") < F.col("weight") * F.lit(self.budget))
        actual = F.col("used_tokens") / F.lit(everything) if everything else F.lit(0.0)
        return rows.select("source", F.col("weight").alias("target_share"), "used_tokens", "passes", actual.alias("actual_share"), short.alias("falls_short"))


def mixture(documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    return Mixture(documents, mix_targets, **options).used


def mixture_report(documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    return Mixture(documents, mix_targets, **options).report()


def short_sources(documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    """``(source)`` whose last allowed copy is used before the source has given its share of the budget.

    Sources without any token are among them.
    """
    return mixture_report(documents, mix_targets, **options).where("falls_short").select("source")
