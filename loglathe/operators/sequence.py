"""Running count and time since the previous match, without putting a source into one task.

A window over a whole source would sort a whole log file in a single task. Instead the hits are
shuffled once by (source, spec, block). Within a block a window gives the local position and the
previous timestamp; a summary of one row per block gives what came before the block; the two are
joined. Blocks are bounded, so the work spreads however unevenly the sources are sized. The summary
is run through the same scheme again, in spans of blocks.

The hits are stored first: whatever columns a query then uses, the lines are read once. Lines with a
bad timestamp are counted on the way by the tasks that read them and not stored. Only if there are
more of them in all than one series may have, a second pass counts them by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.timestamps import floor_millis, micros_to_ts, whole_millis
from ..sources.staging import stage
from .extract import TOLERATED_BAD_TIMESTAMPS

_SERIES = ["source", "spec_id"]
_BLOCK = [*_SERIES, "block"]
_SPAN = [*_SERIES, "span"]
_SPAN_BITS = 16


def number_hits(hits: DataFrame) -> DataFrame:
    """``hits`` to ``records(source, spec_id, block, seq, ts, value, count, delta)``.

    ``count`` and ``delta`` run over all matches of a (source, spec) in line order, including those
    whose text is no number; these yield no record. The hits are computed when this is called; it
    raises when a (source, spec) has more bad timestamps than tolerated (see :func:`stored`).
    """
    placed = stored(hits, "block", "seq").repartition(*_BLOCK)
    us = F.col("us")

    local = Window.partitionBy(*_BLOCK).orderBy("seq")
    inside = placed.select(
        *_BLOCK,
        "seq",
        "us",
        "value",
        F.row_number().over(local).alias("position"),
        F.lag("us").over(local).alias("previous_us"),
    )

    blocks = placed.groupBy(*_BLOCK).agg(
        F.count("us").alias("n"),
        F.count("value").alias("n_values"),
        F.max_by("us", "seq").alias("last_us"),
    )
    before = _before_blocks(blocks)
    previous = F.coalesce("previous_us", "carried_us")
    return inside.join(before, _BLOCK).where("value is not null").select(
        *_BLOCK,
        "seq",
        micros_to_ts(floor_millis(us)).alias("ts"),
        "value",
        (F.col("position") + F.col("offset")).alias("count"),
        whole_millis(us - previous).cast("double").alias("delta"),
    )


def stored(hits: DataFrame, *places: str) -> DataFrame:
    """``(source, spec_id, *places, us, value)`` of the matches among hits, written once.

    Rows with a bad timestamp (``us`` NULL) are counted by the job that writes the others. Raises
    when a series has more of them than tolerated.
    """
    seen = Observation()
    narrow = hits.select(*_SERIES, *places, "us", "value")
    counted = narrow.observe(seen, F.count_if(F.col("us").isNull()).alias("bad"))
    matches = stage(counted.where(F.col("us").isNotNull()), "hits")
    if seen.get["bad"] > TOLERATED_BAD_TIMESTAMPS:
        bad = hits.where(F.col("us").isNull()).groupBy(*_SERIES).agg(F.count(F.lit(1)).alias("bad"))
        bad.where(tolerated(F.col("bad"))).collect()  # no row, or the error
    return matches


def tolerated(bad: Column) -> Column:
    """False; raises for a series with more bad timestamps than a job puts up with."""
    message = F.concat(F.lit("no valid timestamp in "), bad.cast("string"), F.lit(" lines of "), F.col("source"))
    return F.assert_true(bad <= TOLERATED_BAD_TIMESTAMPS, message).isNotNull()


def summary(hits: DataFrame) -> DataFrame:
    """``(source, spec_id, count, min, max, mean)`` of the values of hits.

    One aggregation with partial sums, in which the bad timestamps are counted too: no match is
    numbered, shuffled or stored for it.
    """
    totals = hits.groupBy(*_SERIES).agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.count_if(F.col("us").isNull()).alias("bad"),
    )
    return totals.where(~tolerated(F.col("bad")) & (F.col("count") > 0)).drop("bad")


def plain_values(hits: DataFrame) -> DataFrame:
    """``(source, spec_id, value)`` of all matches with a number, stored, without numbering them."""
    return stored(hits).where("value is not null").drop("us")


def _before_blocks(blocks: DataFrame) -> DataFrame:
    """Per block: ``offset`` matches before it and ``carried_us`` of the last of them. Blocks
    without a value are left out.

    The same two steps once more, with spans of 65 536 consecutive block numbers: however many
    blocks a series has (one per row, if its order key is sparse), no task sees them all. Again
    both sides read one shuffle.
    """
    span = F.shiftright("block", _SPAN_BITS)
    placed = blocks.withColumn("span", span).repartition(*_SPAN)
    rows_before = Window.unboundedPreceding, -1

    inside = Window.partitionBy(*_SPAN).orderBy("block").rowsBetween(*rows_before)
    local = (
        placed.select(
            *_SPAN,
            "block",
            "n_values",
            F.sum("n").over(inside).alias("n_before"),
            F.last("last_us", ignorenulls=True).over(inside).alias("us_before"),
        )
        .where("n_values > 0")
        .drop("n_values")
    )

    earlier = Window.partitionBy(*_SERIES).orderBy("span").rowsBetween(*rows_before)
    last_block = F.when(F.col("last_us").isNotNull(), F.col("block"))
    spans = (
        placed.groupBy(*_SPAN)
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_values").alias("n_values"),
            F.max_by("last_us", last_block).alias("last_us"),
        )
        .select(
            *_SPAN,
            "n_values",
            F.sum("n").over(earlier).alias("n_earlier"),
            F.last("last_us", ignorenulls=True).over(earlier).alias("us_earlier"),
        )
        .where("n_values > 0")
        .drop("n_values")
    )
    zero = F.lit(0).cast("bigint")
    return local.join(spans, _SPAN).select(
        *_BLOCK,
        (F.coalesce("n_before", zero) + F.coalesce("n_earlier", zero)).alias("offset"),
        F.coalesce("us_before", "us_earlier").alias("carried_us"),
    )


def values_of(records: DataFrame, measure: str = "value") -> DataFrame:
    """The measured numbers (``value``, ``count`` or ``delta``) with their place in the series.

    A first match has no delta and so yields no number.
    """
    y = F.col(measure).cast("double")
    return records.where(y.isNotNull()).select(
        "source", "spec_id", "count", y.alias("value")
    )
