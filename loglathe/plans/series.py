"""Chart-ready series: ``series(panel_ix, line_ix, title, axis, ts, y)``, one row per point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from .ranges import inside


def chart_series(
    bound: DataFrame, records: DataFrame, windows: DataFrame | None = None
) -> DataFrame:
    """The points of every bound line that has any.

    ``y`` is the value, the running count or the delta, the first delta being 0. With ``windows``
    (one row per panel, read twice: pass a staged table) only points with start <= ts <= end are
    kept, both ends included; of stored records nothing outside all windows is read.
    """
    lines = bound.select("panel_ix", "line_ix", "source", "spec_id", "title", "axis", "measure")
    if windows is not None:
        lines = lines.join(windows.select("panel_ix", "start", "end"), "panel_ix")
        records = inside(records, windows)
    points = attach(
        records.select("source", "spec_id", "ts", "value", "count", "delta"),
        lines,
        ["source", "spec_id"],
        rows=bound.count(),
    )
    if windows is not None:
        ts = F.col("ts")
        points = points.where((ts >= F.col("start")) & (ts <= F.col("end")))
    y = (
        F.when(F.col("measure") == "value", F.col("value"))
        .when(F.col("measure") == "count", F.col("count").cast("double"))
        .otherwise(F.coalesce("delta", F.lit(0.0)))
    )
    return points.select("panel_ix", "line_ix", "title", "axis", "ts", y.alias("y"))


def write_series(series: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"):
    """One folder per line of a panel, for a renderer to pick up; hot lines get several files."""
    balanced = series.hint("rebalance", "panel_ix", "line_ix")
    balanced.write.mode(mode).partitionBy("panel_ix", "line_ix").format(fmt).save(path)
