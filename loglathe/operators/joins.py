"""Attaching a per-group row to many rows, whatever the group sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage

# A broadcast side is limited to this many bytes, by the widths of its columns.
BROADCAST_BYTES = 32 << 20
# A key with more than one in so many rows is hot; there cannot be more hot keys than this.
HOT_SHARE = 1000
_TEXT_WIDTH = 64


def row_width(schema: T.StructType) -> int:
    """About how many bytes a row takes in memory; texts and nested values count as short ones."""
    flat = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return 16 + sum(8 if isinstance(f.dataType, flat) else _TEXT_WIDTH for f in schema)


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``small`` (a few narrow rows per group) to ``big`` on ``keys``.

    Up to ``broadcast_bytes`` ``small`` is broadcast. Otherwise the rows of ``big`` are counted by
    key. Keys that have more than a thousandth of them, and so fewer than a thousand keys, are
    joined where their rows are, as only their part of ``small`` is broadcast; all others are
    shuffled. ``rows`` is the size of ``small`` if known; else it is counted, so ``small`` should be
    a staged table or plain configuration, and ``big`` too where ``small`` is large. Null keys match
    nothing.
    """
    keys = list(keys)
    width = row_width(small.schema)
    if (small.count() if rows is None else rows) * width <= broadcast_bytes:
        return big.join(F.broadcast(small), keys, how)
    sizes = stage(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = stage(sizes.where(F.col("_n") * HOT_SHARE > total).select(*keys), "hot-keys")  # fewer than HOT_SHARE rows
    theirs = stage(small.join(F.broadcast(hot), keys, "left_semi"), "hot-rows")
    if theirs.count() * width > BROADCAST_BYTES:  # not a few rows per group: left to adaptive execution
        return big.join(small, keys, how)
    here = big.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(theirs), keys, how)
    return big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how).unionByName(here)
