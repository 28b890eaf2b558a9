"""Statistics of measured values per group: summary, exact quantiles, histogram.

Groups are (source, spec) by default and may be of any size: nothing here sorts or collects a hot
group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ulp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .joins import attach

SERIES = ("source", "spec_id")
PROBABILITIES = {"median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
BUCKETS = 10
BAR_WIDTH = 50
BAR = "∎"

# Distinct values that one task ranks, and in how many places a piece with more is cut.
PIECE_ROWS = 1 << 20
CUTS = 64


def match_counts(records: DataFrame, series: DataFrame) -> DataFrame:
    """Records per (source, spec) of ``series``, 0 for those without any."""
    counted = records.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    joined = series.join(counted, list(SERIES), "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def summary(values: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Count, minimum, maximum and mean per group: one aggregation with partial sums."""
    return values.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
    )


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Lower and upper order statistic (1-based) of quantile ``p`` and the weight of the upper.

    Hyndman-Fan type 8, h = (n + 1/3) p + 1/3, clamped to the smallest and largest value.
    """
    h = (n + F.lit(1.0 / 3.0)) * F.lit(p) + F.lit(1.0 / 3.0)
    whole = h.cast("bigint")
    lowest = (whole <= 0) | F.lit(p == 0.0)
    highest = (whole >= n) | F.lit(abs(p - 1.0) <= 4 * ulp(1.0))
    one = F.lit(1).cast("bigint")
    lower = F.when(lowest, one).when(highest, n).otherwise(whole)
    upper = F.when(lowest, one).when(highest, n).otherwise(whole + 1)
    weight = F.when(lowest | highest, F.lit(0.0)).otherwise(h - whole.cast("double"))
    return lower, upper, weight


def quantiles(
    values: DataFrame,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    probabilities: dict[str, float] | None = None,
    piece_rows: int = PIECE_ROWS,
    cuts: int = CUTS,
) -> DataFrame:
    """Exact interpolated quantiles per group (type 8), one column per entry of ``probabilities``.

    Equal values are first counted together, so that a group is a list of (value, how often). All
    wanted ranks of all groups are then closed in on together: a piece, at first a whole group, with
    more than ``piece_rows`` distinct values is cut at some ``cuts`` approximate quantiles of its
    own; counting the parts tells which of them hold a wanted rank, and only these go on to the next
    round. When every piece is bounded, a window ranks each of them. The approximation decides how
    even the parts are, never what comes out; each round leaves a small share of what it cut.

    ``values`` is read once. NaN is above all numbers; nulls do not count.
    """
    probabilities = dict(probabilities or PROBABILITIES)
    keys = list(keys)
    values = values.select(*keys, F.col(value).alias("v")).where(F.col("v").isNotNull())
    counted = stage(values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), "counted")
    groups = stage(counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("size")), "groups")
    n_groups = groups.count()
    whole, zero = F.lit("").alias("piece"), F.lit(0).cast("bigint").alias("before")
    rows, pieces = counted.select(*keys, whole, "v", "c"), groups.select(*keys, whole, zero, "n", "size")
    bounded = []
    while True:
        large = stage(pieces.where(F.col("size") > piece_rows).drop("size"), "large")
        n_large = large.count()
        here = [*keys, "piece"]
        if not n_large:
            bounded.append((rows, pieces))
            break
        bounded.append((attach(rows, large.select(*here), here, "left_anti", rows=n_large), pieces))
        rows, pieces = _narrowed(attach(rows, large.select(*here), here, rows=n_large), large, n_large, keys, probabilities, cuts)
    ranked = [_ranked(r, p, keys) for r, p in bounded]
    ranked = attach(reduce(DataFrame.unionByName, ranked), groups.select(*keys, "n"), keys, rows=n_groups)
    return _interpolated(ranked, keys, probabilities)


def _interpolated(ranked: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """From (keys, v, upto, n), ``upto`` = number of values <= v, to the quantiles.

    The k-th value is the smallest v with ``upto`` >= k.
    """
    picks = []
    for i, p in enumerate(probabilities.values()):
        lower, upper, weight = _ranks(F.col("n"), p)
        picks += [
            F.min(F.when(F.col("upto") >= lower, F.col("v"))).alias(f"low_{i}"),
            F.min(F.when(F.col("upto") >= upper, F.col("v"))).alias(f"high_{i}"),
        ]
    picked = ranked.groupBy(*keys).agg(F.first("n").alias("n"), *picks)
    out = []
    for i, (name, p) in enumerate(probabilities.items()):
        _, _, weight = _ranks(F.col("n"), p)
        low, high = F.col(f"low_{i}"), F.col(f"high_{i}")
        out.append((low + weight * (high - low)).alias(name))
    return picked.select(*keys, *out)


def _ranked(rows: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, upto): a window over each piece, after what is below the piece."""
    here = [*keys, "piece"]
    upto = Window.partitionBy(*here).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.select(*here, "v", F.sum("c").over(upto).alias("upto"))
    return attach(ranked, pieces.select(*here, "before"), here).select(
        *keys, "v", (F.col("before") + F.col("upto")).alias("upto")
    )


def _narrowed(rows, pieces, n_pieces, keys, probabilities, cuts) -> tuple[DataFrame, DataFrame]:
    """The parts of pieces that hold wanted ranks, with their rows; both are stored."""
    here = [*keys, "piece"]
    inner = [i / (cuts + 1) for i in range(1, cuts + 1)]
    # A value between the ends is a cut too: whatever the sketch says, a piece gets smaller.
    low, high = F.min("v").cast("double"), F.max("v").cast("double")
    middle = F.greatest(low, F.lit(-1.7e308)) / 2 + high / 2
    between = F.when((high < float("inf")) & (middle > low) & (middle < high), middle).otherwise(low)
    # Sketches may merge in any order, so the cuts are stored before they are used twice.
    limits = stage(
        rows.groupBy(*here).agg(
            F.array_append(F.percentile_approx(F.col("v").cast("double"), inner, 100 * cuts), between).alias("limits")
        ),
        "limits",
    )
    above = F.size(F.filter("limits", lambda limit: F.col("v") > limit))
    part = F.concat_ws(".", "piece", F.lpad(above.cast("string"), 4, "0"))
    cut = attach(rows, limits, here, rows=n_pieces).select(*here, part.alias("part"), "v", "c")

    parts = cut.groupBy(*here, "part").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("size"))
    below = Window.partitionBy(*here).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = attach(parts, pieces, here, rows=n_pieces).withColumn(
        "before", F.col("before") + F.coalesce(F.sum("total").over(below), F.lit(0))
    )
    holds = F.lit(False)
    for p in probabilities.values():
        for rank in _ranks(F.col("n"), p)[:2]:
            holds = holds | ((rank > F.col("before")) & (rank <= F.col("before") + F.col("total")))
    kept = stage(placed.where(holds).select(*keys, F.col("part").alias("piece"), "before", "n", "size"), "parts")
    renamed = cut.select(*keys, F.col("part").alias("piece"), "v", "c")
    left = attach(renamed, kept.select(*here), here, "left_semi", rows=n_pieces * (2 * len(probabilities)))
    return stage(left, "narrowed"), kept


def bucket_width(low: Column, high: Column, buckets: int, mode: str = "padded") -> Column:
    """Width of a histogram bucket.

    ``padded`` widens the range by the remainder of its whole part divided by the number of
    buckets; ``equal`` divides the range itself. So does ``padded`` where the range is beyond the
    largest number: nothing of its whole part is known then.
    """
    n = F.lit(float(buckets))
    span = high - low
    equal = F.when(span < float("inf"), span / n).otherwise(high / n - low / n)
    if mode == "equal":
        return equal
    if mode != "padded":
        raise ValueError("mode must be 'padded' or 'equal'")
    pad = F.floor(F.pmod(span, n)).cast("double")
    return F.when(span < float("inf"), (span + pad) / n).otherwise(equal)


def histogram(
    values: DataFrame,
    buckets: int = BUCKETS,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    mode: str = "padded",
) -> DataFrame:
    """``(keys, bucket, start, end, count, bar)``: equal-width buckets, empty ones included.

    Buckets are half-open; a value on the last edge goes to the last bucket. They span the finite
    values: minus infinity counts in the first bucket, infinity and NaN in the last one. One
    character of ``bar`` stands for max(1, largest count div 50). ``values`` is read twice; pass a
    stored or staged table.
    """
    keys = list(keys)
    values = values.select(*keys, F.col(value).alias("v")).where(F.col("v").isNotNull())
    low, high, v = F.col("low"), F.col("high"), F.col("v")
    finite = F.when((v > float("-inf")) & (v < float("inf")), v)
    limits = stage(
        values.groupBy(*keys)
        .agg(F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))
        .select(*keys, "low", bucket_width(low, high, buckets, mode).alias("width")),
        "limits",
    )
    width, last = F.col("width"), buckets - 1
    # Where the distance itself is beyond the largest number, its parts are divided.
    steps = F.when(v - low < float("inf"), (v - low) / width).otherwise(v / width - low / width)
    index = F.floor(F.least(steps, F.lit(float(last))))
    bucket = (
        F.when(v >= float("inf"), last)  # NaN counts as above infinity
        .when((v == float("-inf")) | (width == 0), 0)
        .otherwise(index)
    ).cast("int")
    counted = (
        attach(values, limits, keys)
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = limits.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    group = Window.partitionBy(*keys)
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    filled = frame.join(counted, [*keys, "bucket"], "left").withColumn("n", n)
    scale = F.greatest(
        F.call_function("div", F.max("n").over(group), F.lit(BAR_WIDTH)), F.lit(1)
    )

    def edge(number: Column) -> Column:
        halves = (low / 2 + number * (width / 2)) * 2  # where the whole range is beyond the largest number
        return F.when(width * F.lit(float(buckets)) < float("inf"), low + number * width).otherwise(halves)

    return filled.select(
        *keys,
        "bucket",
        edge(F.col("bucket")).alias("start"),
        edge(F.col("bucket") + 1).alias("end"),
        F.col("n").alias("count"),
        F.repeat(F.lit(BAR), F.call_function("div", F.col("n"), scale).cast("int")).alias("bar"),
    )
