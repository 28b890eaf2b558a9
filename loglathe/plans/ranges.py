"""Time ranges of lines and panels, and their alignment.

Everything after :func:`line_ranges` works on one row per line or per panel.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import TimeFormat, epoch_micros
from ..operators.joins import attach
from ..sources.records import Window as Span
from ..sources.records import within

MODES = ("shared-full", "per-panel", "shared-overlap", "fixed")


def line_ranges(records: DataFrame) -> DataFrame:
    """``(source, spec_id, start, end, n)``: first and last record in file order, not min and max."""
    return records.groupBy("source", "spec_id").agg(
        F.min_by("ts", "count").alias("start"),
        F.max_by("ts", "count").alias("end"),
        F.count(F.lit(1)).alias("n"),
    )


def bound_line_ranges(bound: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bound lines with ``start``, ``end`` (NULL without records) and ``n``."""
    joined = bound.join(ranges, ["source", "spec_id"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def global_range(ranged_lines: DataFrame) -> DataFrame:
    """One row: earliest start and latest end; an error if no line has a record."""
    total = ranged_lines.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    message = F.lit("no line of any panel has a record, so there is no time to show")
    return total.where(F.assert_true(F.col("start").isNotNull(), message).isNull())


def panel_ranges(ranged_lines: DataFrame) -> DataFrame:
    """``(panel_ix, range_mode, start, end, full_start, full_end)`` before alignment.

    ``full``: earliest start to latest end of the panel's lines. ``best-fit``: latest start to
    earliest end, or *full* where that is empty.
    """
    start, end = F.col("start"), F.col("end")
    spans = ranged_lines.groupBy("panel_ix", "range_mode").agg(
        F.min(start).alias("full_start"),
        F.max(end).alias("full_end"),
        F.max(start).alias("fit_start"),
        F.min(end).alias("fit_end"),
    )
    fits = (F.col("range_mode") == "best-fit") & (F.col("fit_start") < F.col("fit_end"))
    return spans.select(
        "panel_ix",
        "range_mode",
        F.when(fits, F.col("fit_start")).otherwise(F.col("full_start")).alias("start"),
        F.when(fits, F.col("fit_end")).otherwise(F.col("full_end")).alias("end"),
        "full_start",
        "full_end",
    )


@dataclass(frozen=True)
class Fractions:
    """A window as two fractions of the global range."""

    start: float
    end: float

    def __post_init__(self):
        if not (0.0 <= self.start < self.end <= 1.0):
            raise ValueError("a window of fractions needs 0 <= start < end <= 1")


@dataclass(frozen=True)
class Instants:
    """A window as two timestamps."""

    start: datetime
    end: datetime


def parse_window(spark, text: str, time_format: TimeFormat = TimeFormat()) -> Fractions | Instants:
    """``"0.25,0.75"`` or two timestamps in the format of the logs, separated by a comma."""
    pieces = [piece.strip() for piece in text.split(",")]
    if len(pieces) != 2:
        raise ValueError("a window is written as two values with a comma between them")
    try:
        fractions = [float(piece) for piece in pieces]
    except ValueError:
        return Instants(*[time_format.parse_literal(spark, piece) for piece in pieces])
    return Fractions(*fractions)


def align(
    panels: DataFrame, mode: str = "shared-full", window: Fractions | Instants | None = None
) -> DataFrame:
    """``(panel_ix, range_mode, start, end)`` after alignment.

    ``per-panel`` changes nothing. ``shared-full`` gives all panels the range over all panels,
    which must not be empty. ``shared-overlap`` gives all panels the common part, if there is one.
    ``fixed`` gives all panels ``window``. What all panels together give is one row, attached to
    each of them.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if (mode == "fixed") != (window is not None):
        raise ValueError("a window goes with mode 'fixed'")
    start, end = F.col("start"), F.col("end")

    def with_total(keep: list[str], **totals) -> DataFrame:
        total = panels.agg(*[value.alias(name) for name, value in totals.items()])  # one row
        return panels.select(*keep).join(F.broadcast(total), F.lit(True))

    if mode == "shared-full":
        panels = with_total(["panel_ix", "range_mode"], start=F.min(start), end=F.max(end))
        message = F.concat(
            F.lit("the panels together do not span any time: "),
            start.cast("string"), F.lit(" "), end.cast("string"),
        )
        fine = start.isNull() | (start < end)
        panels = panels.where(F.assert_true(fine, message).isNull())
    elif mode == "shared-overlap":
        panels = with_total(["*"], low=F.max(start), high=F.min(end))
        common = F.col("low") < F.col("high")
        panels = panels.select(
            "panel_ix",
            "range_mode",
            F.when(common, F.col("low")).otherwise(start).alias("start"),
            F.when(common, F.col("high")).otherwise(end).alias("end"),
        )
    elif isinstance(window, Fractions):
        panels = with_total(["panel_ix", "range_mode"], low=F.min("full_start"), high=F.max("full_end"))
        span = epoch_micros(F.col("high")) - epoch_micros(F.col("low"))

        def at(fraction: float):
            micros = F.round(span * F.lit(float(fraction))).cast("bigint")
            return F.timestamp_add("MICROSECOND", micros, F.col("low"))

        panels = panels.select(
            "panel_ix", "range_mode", at(window.start).alias("start"), at(window.end).alias("end")
        )
    elif window is not None:
        panels = panels.withColumns(
            {
                "start": F.lit(window.start.isoformat(" ")).cast("timestamp_ntz"),
                "end": F.lit(window.end.isoformat(" ")).cast("timestamp_ntz"),
            }
        )
    return panels.select("panel_ix", "range_mode", "start", "end")


def overall(windows: DataFrame, open_end: bool = False) -> Span | None:
    """From the earliest start to the latest end of windows (one row per panel); None without any."""
    row = windows.agg(F.min("start").alias("start"), F.max("end").alias("end")).first()
    return None if row.start is None or row.end is None else Span(row.start, row.end, open_end)


def inside(records: DataFrame, windows: DataFrame, open_end: bool = False) -> DataFrame:
    """Records that may lie in one of the windows: a filter with two numbers known before the job.

    It reaches the scan of stored records, whose files are sorted by series and time, and skips
    what no window touches. Records that are not stored (without ``us``) are returned as they are.
    """
    if "us" not in records.columns:
        return records
    span = overall(windows, open_end)
    return records.where(F.lit(False)) if span is None else within(records, span)


def lines_in_range(bound: DataFrame, windows: DataFrame, records: DataFrame) -> DataFrame:
    """``(panel_ix, line_ix, source, spec_id, has_data)``: any record with start <= ts < end?

    The lines' windows go to the records, not the records to the lines; each task reduces what it
    reads to one row per line. ``windows`` is read twice; pass a staged table.
    """
    keyed = bound.select("panel_ix", "line_ix", "source", "spec_id")
    windowed = keyed.join(windows.select("panel_ix", "start", "end"), "panel_ix", "left")
    ts = F.col("ts")
    hit = attach(
        inside(records, windows, open_end=True).select("source", "spec_id", "ts"),
        windowed,
        ["source", "spec_id"],
        rows=bound.count(),
    ).where((ts >= F.col("start")) & (ts < F.col("end")))
    present = hit.groupBy("panel_ix", "line_ix").agg(F.lit(True).alias("has_data"))
    joined = keyed.join(present, ["panel_ix", "line_ix"], "left")
    return joined.withColumn("has_data", F.coalesce("has_data", F.lit(False)))
