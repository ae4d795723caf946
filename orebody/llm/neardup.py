"""Near-duplicate texts: exact tiled comparison of bit fingerprints.

A text's fingerprint is the parity sketch of its set of word shingles: each distinct shingle flips one
of 256 bits. The bits in which two sketches differ are at most the shingles in which the sets differ,
so Jaccard similarity t needs at most (|A| + |B|) (1 - t) / (1 + t) differing bits: comparing sketches by
exclusive-or and bit count never loses a pair. Rows meet in tiles. A tile holds the texts that have one
of the rarest shingles of both in common (prefix filtering: two sets of similarity t share one of the
first |A| - ceil(t |A|) + 1 shingles in any fixed order, here by counts over the whole corpus), sorted by
population count; tile pairs whose counts differ by more than the radius are skipped. What is left is
verified on the shingle sets. Equal sets are one class, compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.text import run_hashes, run_owners, word_hashes
from orebody.operators.components import connected_components
from orebody.operators.current import latest_rows
from orebody.workspace import materialise

SHINGLE, SIMILARITY, MIN_WORDS = 5, 0.8, 5
WORDS64 = 4  # 256 bits
TILE = 1024
COPIES = 32
SKETCH_BITS = (16, 24)
U64 = np.uint64


def shingle_sets(texts: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """``(id, class_hi, class_lo, words, n, shingles)``: sorted hashes of the distinct shingles of texts long enough.

    ``words`` is a digest of the words in their order.
    """

    def sets(batches):
        for b in batches:
            hashes, lengths = word_hashes(b.column(1).to_pylist())
            runs, (inside, owner) = run_hashes(hashes, shingle), run_owners(lengths, shingle)
            ok = lengths[owner] >= min_words
            owner, runs = owner[ok], runs[inside[ok]]
            order = np.lexsort((runs, owner))
            owner, runs = owner[order], runs[order]
            if len(runs):
                first = np.r_[True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])]
                owner, runs = owner[first], runs[first]
            which, start = np.unique(owner, return_index=True)
            ends = np.r_[start[1:], len(owner)].astype(np.int64)
            raw = [xxhash.xxh3_128_digest(runs[s:e].tobytes()) for s, e in zip(start, ends)]
            pair = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            begin = np.r_[0, np.cumsum(lengths)].astype(np.int64)
            words = np.array([xxhash.xxh3_64_intdigest(hashes[begin[i] : begin[i + 1]].tobytes()) for i in which], U64).view(np.int64)
            offsets = pa.array(np.r_[start, len(owner)].astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(words), pa.array((ends - start).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(runs.view(np.int64)))],
                ["id", "class_hi", "class_lo", "words", "n", "shingles"],
            )

    return texts.mapInArrow(sets, "id long, class_hi long, class_lo long, words long, n int, shingles array<long>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of an Arrow list column as unsigned, and the row of each."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(U64), np.repeat(np.arange(len(column)), lengths)


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def corpus_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """Occurrences over all texts of the shingles in each of 2**bits hash places, on a scale of 8 steps per doubling.

    The array has a fixed size whatever the corpus holds; each task counts its share, slices are summed
    in parallel. The counts only set the order of shingles, so places shared by several lose nothing.
    """
    parts = 64
    width = (1 << bits) // parts

    def count(batches):
        have = np.zeros(1 << bits, np.uint32)
        for b in batches:
            flat, _ = _lists(b.column(0))
            have += np.bincount(_place(flat, bits), minlength=1 << bits).astype(np.uint32)
        rows = [have[i * width : (i + 1) * width] for i in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([_pack(r) for r in rows], pa.binary())], ["part", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((_unpack(x, width).astype(np.uint64) for x in pdf["counts"]), np.zeros(width, np.uint64))
        scale = np.where(total > 0, np.minimum(1 + np.round(8 * np.log2(np.maximum(total, 1))), 255), 0).astype(np.uint8)
        return pd.DataFrame({"part": [int(key[0])], "counts": [scale.tobytes()]})

    summed = sets.select("shingles").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in summed.toLocalIterator():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return out


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.astype(np.uint32).tobytes(), 1)


def _unpack(x: bytes, width: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x, max_output_size=width * 4), np.uint32)


def _sketch(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WORDS64), U64)
    place = (flat & U64(64 * WORDS64 - 1)).astype(np.int64)
    np.bitwise_xor.at(out, (row, place >> 6), U64(1) << (place & 63).astype(U64))
    return out


def _postings(reps: DataFrame, rarity, bits: int, similarity: float) -> DataFrame:
    """``(token, tile_a, tile_b, own, id, n, sketch)``: each class once per tile pair of each of its prefix shingles.

    A shingle whose place was counted once is in no other text. A shingle counted more than TILE times
    gets ceil(count / TILE) tiles, and each row goes to the tile pairs of its own tile.
    """

    def post(batches):
        scale = rarity.value
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            flat, row = _lists(b.column(2))
            sketch = _sketch(flat, row, len(ids))
            count = scale[_place(flat, bits)]
            order = np.lexsort((flat, count, row))
            flat, row, count = flat[order], row[order], count[order]
            start = np.r_[0, np.cumsum(n)[:-1]]
            prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            keep = (np.arange(len(flat)) - start[row] < prefix[row]) & (count > 1)
            flat, row, count = flat[keep], row[keep], count[keep]
            tiles = np.ceil(2.0 ** ((count.astype(np.float64) - 1) / 8) / TILE).astype(np.int64)
            own = np.where(tiles > 1, (ids[row].astype(np.uint64) * U64(0x9E3779B97F4A7C15) >> U64(33)).astype(np.int64) % tiles, 0)
            at = np.repeat(np.arange(len(flat)), tiles)
            other = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(tiles)[:-1]], tiles) if len(at) else at
            lo, hi = np.minimum(own[at], other), np.maximum(own[at], other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at].view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(own[at].astype(np.int32)), pa.array(ids[row[at]]), pa.array(n[row[at]].astype(np.int32)),
                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS64), len(at), [None, pa.py_buffer(np.ascontiguousarray(sketch[row[at]]))]).cast(pa.binary())],
                ["token", "tile_a", "tile_b", "own", "id", "n", "sketch"],
            )

    return reps.select("id", "n", "shingles").mapInArrow(post, "token long, tile_a int, tile_b int, own int, id long, n int, sketch binary")


def compare_tiles(token, lo, hi, own, ids, n, sketch, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same tile pair whose sketches differ by at most the radius.

    Rows are sorted by tile pair and population count; the d-th step compares every row with the d-th
    after it at once, and a row drops out as soon as its tile pair ends or the counts differ too much.
    """
    pop = np.bitwise_count(sketch).sum(axis=1).astype(np.int64)
    order = np.lexsort((pop, hi, lo, token))
    token, lo, hi, own, ids, n, sketch, pop = (x[order] for x in (token, lo, hi, own, ids, n, sketch, pop))
    factor = (1 - similarity) / (1 + similarity)
    at, left, right = np.arange(len(ids) - 1), [], []
    step = 1
    while len(at):
        at = at[at + step < len(ids)]
        to = at + step
        # sets of similarity t differ in size by a factor of t at most
        widest = np.floor(n[at] * (1 + 1 / similarity) * factor + 1e-9)
        go = (token[at] == token[to]) & (lo[at] == lo[to]) & (hi[at] == hi[to]) & (pop[to] - pop[at] <= widest)
        at, to = at[go], to[go]
        ok = (lo[at] == hi[at]) | (own[at] != own[to])
        radius = np.floor((n[at] + n[to]) * factor + 1e-9)
        a, b = at[ok & (pop[to] - pop[at] <= radius)], to[ok & (pop[to] - pop[at] <= radius)]
        hit = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= np.floor((n[a] + n[b]) * factor + 1e-9)
        left.append(ids[a[hit]])
        right.append(ids[b[hit]])
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _tiled(postings: DataFrame, similarity: float) -> DataFrame:
    """Candidates of all tile pairs; whole tile pairs are taken together from the sorted stream."""

    def run(batches):
        held: list = []

        def out(rows):
            cols = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            sketch = np.frombuffer(b"".join(rows.column(6).to_pylist()), U64).reshape(-1, WORDS64)
            a, b = compare_tiles(*cols[:4], cols[4], cols[5].astype(np.int64), sketch, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            if held:
                last = [held[-1].column(i)[-1].as_py() for i in range(3)]
                if any(last[i] != key[i][0] for i in range(3)):
                    new = np.r_[0, new]
            cut = int(new[-1]) if len(new) else None
            if cut is None:
                held.append(batch)
                continue
            held.append(batch.slice(0, cut))
            yield out(pa.Table.from_batches(held).combine_chunks())
            held = [batch.slice(cut)]
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    grouped = postings.repartition("token", "tile_a", "tile_b").sortWithinPartitions("token", "tile_a", "tile_b")
    return grouped.mapInArrow(run, "a long, b long")


class NearDuplicates:
    """Classes of equal shingle sets, and the pairs of classes whose similarity reaches the threshold.

    Texts with fewer than ``min_words`` words (null and empty ones too) are in no class. ``texts`` has
    ``id`` and ``text``, one row an id; other columns are ignored.
    """

    def __init__(self, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, min_words: int = MIN_WORDS):
        self.similarity = similarity
        spark = texts.sparkSession
        self.sets = materialise(shingle_sets(texts.select(F.col("id").cast("long"), "text").where("text is not null"), shingle, max(min_words, shingle)), "shingles")
        classes = self.sets.groupBy("class_hi", "class_lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        copied = classes.where("copies > 1")
        self.members = materialise(self.sets.select("id", "class_hi", "class_lo", "words").join(copied, ["class_hi", "class_lo"]).select("id", "rep", "words", "copies"), "members")
        reps = self.sets.join(self.members.where("id <> rep").select("id"), "id", "left_anti")
        total = self.sets.agg(F.sum("n")).first()[0] or 0
        bits = min(max(math.ceil(math.log2(2 * total + 1)), SKETCH_BITS[0]), SKETCH_BITS[1])
        rarity = spark.sparkContext.broadcast(corpus_counts(reps, bits))  # at most 2**24 bytes
        candidates = materialise(_tiled(_postings(reps, rarity, bits, similarity), similarity).distinct(), "candidates")
        self.pairs = materialise(self._verified(candidates), "pairs")

    def _verified(self, candidates: DataFrame) -> DataFrame:
        wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.sets.join(wanted, "id").select("id", "n", "shingles")
        a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in ("a", "b"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        return candidates.join(a, "a").join(b, "b").select("a", "b", (common / (F.col("n_a") + F.col("n_b") - common)).alias("similarity")).where(F.col("similarity") >= self.similarity)

    def text_pairs(self, copies: int = COPIES) -> DataFrame:
        """``(id_a, id_b, similarity)``, id_a < id_b: pairs of texts, and of copies of one text.

        Of each text (the same words in the same order) the ``copies`` smallest ids have all their pairs.
        Each further copy has one row, which names the text's smallest id: whatever that is paired with,
        the copy is too. Links between different texts are never lost, also where their shingle sets are
        equal. ``groups`` has a row for each text instead.
        """
        rank = Window.partitionBy("rep", "words").orderBy("id")
        member = materialise(self.members.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= copies).select("rep", "words", "id"), "expanded")
        more = self.members.groupBy("rep", "words").agg(F.min("id").alias("first"), F.count("*").alias("same")).where(F.col("same") > copies)
        further = self.members.join(more, ["rep", "words"]).join(member.select("id"), "id", "left_anti").select(F.col("first").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
        one, two = (member.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}")) for x in ("a", "b"))
        between = self.pairs.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"), "similarity")
        within = one.join(two.withColumnRenamed("b", "a"), "a").where("id_a < id_b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"), F.lit(1.0).alias("similarity"))
        return between.unionByName(within).unionByName(further).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")

    def groups(self) -> DataFrame:
        """``(id, class_id, group_id, links)``: a row for each text with a partner; group_id is the smallest id of its group."""
        edges = self.pairs.select("a", "b").unionByName(self.members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
        degree = self.pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
        found = connected_components(edges).join(self.members.select("id", F.col("rep")), "id", "left")
        found = found.select("id", F.coalesce("rep", "id").alias("class_id"), F.col("component").alias("group_id"))
        return found.join(degree, "class_id", "left").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def fragments(points: DataFrame) -> DataFrame:
    return latest_rows(points.select("id", "seq", "fragment")).select("id", F.col("fragment").alias("text"))
