"""Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(name: str | Column, missing: str) -> Column:
    """Trimmed and lower-cased; null or blank becomes ``missing``."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c.isNull() | (c == ""), F.lit(missing)).otherwise(c)


def source_category(name: str | Column = "source") -> Column:
    return category(name, "unknown")


def layer_category(name: str | Column = "layer") -> Column:
    return category(name, "surface")


def usable(name: str = "embedding", dim: int | None = 96) -> Column:
    """The vector has ``dim`` numbers (any number if None), none null or NaN, not all zero."""
    c = F.col(name)
    size = F.size(c) > 0 if dim is None else F.size(c) == dim
    return F.coalesce(
        c.isNotNull() & size & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(c, lambda x: x != 0), F.lit(False)
    )


def stored_digest(*names: str, seed: int = 0, arrays: tuple[str, ...] = ()) -> Column:
    """64-bit digest of the values as stored. Null, empty and a null at any place of an array all differ."""
    parts: list[Column] = [F.lit(seed)]
    for n in names:
        c = F.col(n)
        parts += [c.isNull(), c]
        if n in arrays:
            nulls = F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
            parts += [F.size(c), F.when(nulls, c.cast("string"))]
    return F.xxhash64(*parts)
