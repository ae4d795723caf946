"""Compact vector codes, and exact similarities of chosen pairs.

A code is 104 bytes instead of 384: the unit vector in 8-bit steps, the step, and the length of what
the rounding lost. For two codes the true cosine differs from theirs by at most
e_a + e_b + e_a e_b, so a threshold can be applied to codes without losing a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.columns import stored_digest
from orebody.llm._util import DIM, unit
from orebody.operators.current import latest_rows
from orebody.workspace import materialise

CODE_BYTES = DIM + 8
U64 = np.uint64


def encode(u: np.ndarray) -> np.ndarray:
    """Codes of unit rows."""
    step = np.maximum(np.abs(u).max(axis=1, keepdims=True) / 127, 1e-12).astype(np.float32)
    whole = np.rint(u / step).astype(np.int8)
    lost = np.linalg.norm(u - whole * step.astype(np.float64), axis=1).astype(np.float32) + np.float32(1e-6)
    out = np.empty((len(u), CODE_BYTES), np.uint8)
    out[:, :DIM] = whole.view(np.uint8)
    out[:, DIM : DIM + 4] = step.view(np.uint8).reshape(-1, 4)
    out[:, DIM + 4 :] = lost.reshape(-1, 1).view(np.uint8).reshape(-1, 4)
    return out


def raw_rows(column, width: int) -> np.ndarray:
    """The bytes of a binary Arrow column without nulls whose values are all ``width`` long, a row a value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.empty((0, width), np.uint8)
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(-1, width)


def decoded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``decode`` of rows of bytes, of which those behind a code are left alone."""
    step = np.ascontiguousarray(raw[:, DIM : DIM + 4]).view(np.float32)
    lost = np.ascontiguousarray(raw[:, DIM + 4 : CODE_BYTES]).view(np.float32)[:, 0]
    return np.ascontiguousarray(raw[:, :DIM]).view(np.int8).astype(np.float32) * step, lost


def decode(codes) -> tuple[np.ndarray, np.ndarray]:
    """Rows in float32, and what the rounding lost, of a binary Arrow column or a list of bytes."""
    if isinstance(codes, (pa.Array, pa.ChunkedArray)):
        return decoded(raw_rows(codes, CODE_BYTES))
    return decoded(np.frombuffer(b"".join(codes), np.uint8).reshape(-1, CODE_BYTES))


def binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def usable_rows(column) -> np.ndarray:
    """Which rows of an Arrow list column have DIM numbers, none null or NaN, not all zero."""
    ok = (pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == DIM)
    flat = column.filter(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, DIM)  # nulls become NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok


def current_codes(points: DataFrame, *extra: str) -> DataFrame:
    """``(id, seq, h1, h2, code, *extra)``, extra columns of strings, of the current points with usable embedding.

    Codes are made in the scan, so that the choice of the current rows shuffles them and not the vectors.
    h1 and h2 are digests of the stored vector. An unusable current row hides an older usable one.
    """

    def run(batches):
        for b in batches:
            ok = usable_rows(b.column(4))
            x = np.asarray(b.column(4).filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, DIM)
            codes = binary(encode(unit(x)))
            at = np.cumsum(ok) - 1
            code = codes.take(pa.array(np.where(ok, at, 0), mask=~ok)) if len(codes) else pa.nulls(len(ok), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), code, *(b.column(5 + i) for i in range(len(extra)))], ["id", "seq", "h1", "h2", "code", *extra])

    arrays = ("embedding",)
    rows = points.select("id", "seq", stored_digest("embedding", seed=1, arrays=arrays).alias("h1"), stored_digest("embedding", seed=2, arrays=arrays).alias("h2"), F.col("embedding").cast("array<float>"), *extra)
    schema = "id long, seq long, h1 long, h2 long, code binary" + "".join(f", {n} string" for n in extra)
    coded = rows.where("id is not null").mapInArrow(run, schema)
    return materialise(latest_rows(coded).where("code is not null"), "codes")


def _spots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = (ids.astype(np.int64).view(U64) ^ U64(0x5851F42D4C957F2D)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
    return (h >> U64(64 - bits)).astype(np.int64), (h & U64((1 << bits) - 1)).astype(np.int64)


def only_ids(df: DataFrame, ids: DataFrame, expected: int, max_bits: int = 27) -> DataFrame:
    """Rows of ``df`` whose first column is probably among ``ids``: a Bloom filter of at most 2**max_bits bits.

    It only spares shuffling; an exact join follows. Slices of the filter are merged in parallel.
    """
    import zstandard

    bits = min(max(math.ceil(math.log2(16 * expected + 1)), 20), max_bits)
    parts = 16
    width = (1 << bits) // 8 // parts

    def mark(batches):
        have = np.zeros(1 << bits, bool)
        for b in batches:
            for s in _spots(b.column(0).to_numpy(zero_copy_only=False), bits):
                have[s] = True
        packed = np.packbits(have)
        rows = [zstandard.compress(packed[i * width : (i + 1) * width].tobytes(), 1) for i in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(rows, pa.binary())], ["part", "marks"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.uint8)
        for m in pdf["marks"]:
            out |= np.frombuffer(zstandard.decompress(m, max_output_size=width), np.uint8)
        return pd.DataFrame({"part": [int(key[0])], "marks": [out.tobytes()]})

    merged = ids.select(ids.columns[0]).mapInArrow(mark, "part int, marks binary").groupBy("part").applyInPandas(merge, "part int, marks binary")
    filter_ = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.toLocalIterator():
        filter_[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["marks"], np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(filter_)

    def keep(batches):
        for b in batches:
            marks = sent.value
            ok = np.ones(b.num_rows, bool)
            for s in _spots(b.column(0).to_numpy(zero_copy_only=False), bits):
                ok &= (marks[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            yield b.filter(pa.array(ok))

    return df.mapInArrow(keep, df.schema)


def stored_vectors(points: DataFrame, codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, embedding)`` of the current rows of the ``wanted`` ids."""
    expected = wanted.count()
    now = codes.select("id", "seq").join(wanted, "id")
    rows = points.where("id is not null and embedding is not null").select("id", "seq", F.col("embedding").cast("array<float>").alias("embedding"))
    stored = only_ids(rows, wanted, expected).join(now, ["id", "seq"]).dropDuplicates(["id"]).select("id", "embedding")
    return materialise(stored, "vectors")


def exact_similarities(points: DataFrame, codes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``similarity``: cosine in double of the stored vectors of the current rows."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    stored = stored_vectors(points, codes, wanted)
    one, two = (stored.select(F.col("id").alias(x), F.col("embedding").alias(f"v_{x}")) for x in ("a", "b"))
    joined = pairs.join(one, "a").join(two, "b").select(*pairs.columns, "v_a", "v_b")
    kept = pairs.columns

    def run(batches):
        for b in batches:
            x, y = (unit(np.asarray(b.column(len(kept) + i).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, DIM)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(np.einsum("ij,ij->i", x, y))], [*kept, "similarity"])

    schema = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    return joined.mapInArrow(run, f"{schema}, similarity double")
