"""Words of a text and their hashes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash

_RUN = re.compile(r"[^\W_]+")
_DROP = {0x00AD: None, 0x200B: None}


def words(text: str | None) -> list[str]:
    """Runs of Unicode letters and digits of the lower-cased text, without U+00AD and U+200B.

    Null and empty texts have no words.
    """
    if not text:
        return []
    return _RUN.findall(text.translate(_DROP).lower() if "­" in text or "​" in text else text.lower())


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and the number of words of each text."""
    parts = [words(t) for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = [w for p in parts for w in p]
    if not flat:
        return np.empty(0, np.uint64), lengths
    codes, vocabulary = pd.factorize(np.array(flat, dtype=object))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    return hashes[codes], lengths


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours; the last n - 1 places have none and are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ hashes[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def run_owners(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of ``n`` in texts laid end to end: the places that stay in one text, and its index."""
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if total < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.flatnonzero(owner[: total - n + 1] == owner[n - 1 :])
    return inside, owner[inside]
