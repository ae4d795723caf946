"""Evaluation texts inside long training texts: size-partitioned MinHash containment search.

A passage is a run of 12 consecutive words of an item, or all of a shorter item. Passages are put
into partitions by their length and number of distinct shingles. For each partition the documents are
cut into windows of 2 n - 1 words at every n-th word, so that each run of n words lies in one window.
A passage in a window shares all its shingles with it, which bounds their resemblance from below by
q / (q + others); the partition gets as many MinHash bands of one row as make a miss rarer than MISS. Each
window that shares a band with a passage is then searched for the passage itself, by the hashes of
its runs of n words; of what is found, the words are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.text import run_hashes, run_owners, word_hashes, words

PASSAGE = 12
MISS = 1e-7
MAX_BANDS = 256
BLOCK_ITEMS = 20_000
U64 = np.uint64
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def _shingle(n: int) -> int:
    return max(1, min(5, n // 2))


def _bands(distinct: int, n: int) -> int:
    """Bands for passages of n words with so many distinct shingles at least."""
    others = (2 * n - _shingle(n)) - (n - _shingle(n) + 1)
    like = distinct / (distinct + others)
    return 1 if like >= 1 else min(MAX_BANDS, math.ceil(math.log(MISS) / math.log(1 - like)))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    draw = rng.integers(0, 2**63, (2, MAX_BANDS), dtype=np.uint64)
    return (draw[0] | U64(1))[:count], draw[1][:count]


def _mixed(h: np.ndarray, a, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h * a + b
        return x ^ (x >> U64(31))


class PassageIndex:
    """Partitions of the passages of a block of items, small enough to be sent to every task."""

    def __init__(self, item_ids: list, texts: list):
        hashes, lengths = word_hashes(texts)
        self.texts = dict(zip(item_ids, texts))
        self.parts = []
        for n in sorted({min(PASSAGE, int(x)) for x in lengths if x}):
            runs = run_hashes(hashes, n)
            inside, owner = run_owners(lengths, n)
            ok = lengths[owner] >= PASSAGE if n == PASSAGE else lengths[owner] == n
            place, owner = inside[ok], owner[ok]
            k = _shingle(n)
            shingles = run_hashes(hashes, k)
            rows = shingles[place[:, None] + np.arange(n - k + 1)]
            distinct = 1 + (np.diff(np.sort(rows, axis=1), axis=1) != 0).sum(axis=1)
            for low, high in self._sizes(distinct):
                take = (distinct >= low) & (distinct < high)
                bands = _bands(int(distinct[take].min()), n)
                a, b = _permutations(bands)
                keys = [np.unique(_mixed(rows[take], a[i], b[i]).min(axis=1)) for i in range(bands)]
                order = np.argsort(runs[place[take]], kind="stable")
                self.parts.append((n, k, keys, runs[place[take]][order], np.asarray(item_ids, dtype=np.int64)[owner[take]][order]))

    @staticmethod
    def _sizes(distinct: np.ndarray) -> list[tuple[int, int]]:
        """Partitions of the sizes, each twice as wide as the one below."""
        top, out = int(distinct.max()) + 1 if len(distinct) else 0, []
        while top > 1:
            low = max(1, top - max(1, top // 2))
            if ((distinct >= low) & (distinct < top)).any():
                out.append((low, top))
            top = low
        return out

    def search(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text index, item id) of all passages found."""
        hashes, lengths = word_hashes(texts)
        found: list[np.ndarray] = []
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        for n, k, keys, passages, items in self.parts:
            shingles, (inside, _) = run_hashes(hashes, k), run_owners(lengths, k)
            # each text is padded to whole blocks of n words; places without shingle hold the greatest value
            blocks = -(-lengths // n)
            first = np.r_[0, np.cumsum(blocks)[:-1]].astype(np.int64)
            total = int(blocks.sum())
            if not total:
                continue
            owner = np.repeat(np.arange(len(lengths)), lengths)
            where = first[owner] * n + np.arange(len(hashes)) - starts[owner]
            grid = np.zeros(total * n, U64)
            valid = np.zeros(total * n, bool)
            grid[where[inside]], valid[where[inside]] = shingles[inside], True
            text_of = np.repeat(np.arange(len(lengths)), blocks)
            follows = np.r_[text_of[1:] == text_of[:-1], False]
            tail = n - k  # shingles of the next block that lie in the window
            hit = np.zeros(total, bool)
            a, b = _permutations(len(keys))
            for i, key in enumerate(keys):
                mixed = np.where(valid, _mixed(grid, a[i], b[i]), _TOP).reshape(total, n)
                least = mixed.min(axis=1)
                if tail:
                    after = np.r_[mixed[1:, :tail].min(axis=1), _TOP]
                    least = np.where(follows, np.minimum(least, after), least)
                at = np.minimum(np.searchsorted(key, least), len(key) - 1)
                hit |= key[at] == least
            found.append(self._verify(np.flatnonzero(hit), text_of, first, starts, lengths, hashes, n, passages, items))
        rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        same = np.array([self._contains(texts[i], int(item)) for i, item in rows.tolist()], dtype=bool)
        return rows[same, 0], rows[same, 1]

    def _contains(self, text: str, item: int) -> bool:
        """Whether the words of a passage of the item stand in the text one after another."""
        of_item, of_text = words(self.texts[item]), words(text)
        n = min(PASSAGE, len(of_item))
        passages = {tuple(of_item[i : i + n]) for i in range(len(of_item) - n + 1)}
        return any(tuple(of_text[i : i + n]) in passages for i in range(len(of_text) - n + 1))

    @staticmethod
    def _verify(windows, text_of, first, starts, lengths, hashes, n, passages, items) -> np.ndarray:
        """The hash of each run of n words that starts in the block, looked up among the passages."""
        text = text_of[windows]
        at = (starts[text] + (windows - first[text]) * n)[:, None] + np.arange(n)
        ok = at + n <= (starts[text] + lengths[text])[:, None]
        at, text = at[ok], np.repeat(text, n).reshape(-1, n)[ok]
        if not len(at):
            return np.empty((0, 2), np.int64)
        runs = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for i in range(n):
                runs = (runs ^ hashes[at + i]) * U64(0x9E3779B97F4A7C15)
                runs ^= runs >> U64(29)
        low, high = np.searchsorted(passages, runs, "left"), np.searchsorted(passages, runs, "right")
        many = high - low
        row = np.repeat(np.arange(len(runs)), many)
        slot = np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many).astype(np.int64)
        return np.stack([text[row], items[slot]], axis=1)


def leaks(documents: DataFrame, eval_items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id)``: documents that contain a passage of the item, each pair once.

    Items without words are no case; one text under several ids is found under each. Items are the
    stated queries, searched in blocks of ``block_items``, so what is sent to the tasks is bounded.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    out, block = None, []

    def search_block(rows):
        index = spark.sparkContext.broadcast(PassageIndex([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                text, item = index.value.search(b.column(1).to_pylist())
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[text], pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

        return docs.mapInArrow(run, "doc_id long, item_id long")

    for r in eval_items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append(r)
        if len(block) == block_items:
            found = search_block(block)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = search_block(block)
        out = found if out is None else out.unionByName(found)
    return out


def leak_report(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Per item that leaks: its benchmark and the number of documents concerned."""
    found = leaks(documents, eval_items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return eval_items.select("item_id", "benchmark").join(found, "item_id")
