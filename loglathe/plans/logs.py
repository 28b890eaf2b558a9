"""Whole jobs over log files: preview, cat, stat, graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import TimeFormat
from ..operators import extract, sequence, stats
from ..sources.lines import literal_path, log_file_versions, read_log_files, source_name
from ..sources.records import sorted_by_time
from ..sources.staging import fresh_path, scratch, stage
from ..spec import DELTA, FIELD, Panel
from . import layout, ranges, series


def read_series(
    spark: SparkSession,
    paths: str | Sequence[str],
    specs: Sequence,
    time_format: TimeFormat = TimeFormat(),
    bad_timestamps: str = "fail",
    **options,
) -> DataFrame:
    """Records of all specs on all files, in one pass over the files."""
    lines = read_log_files(spark, paths, **options)
    return sequence.number_hits(extract.hits(lines, specs, time_format, bad_timestamps))


def match_preview(
    spark: SparkSession,
    paths: str | Sequence[str],
    spec,
    time_format: TimeFormat = TimeFormat(),
    count: int = 5,
    **options,
) -> DataFrame:
    """What becomes of the first ``count`` guard-passing lines; see :func:`extract.preview`.

    Files are read in the order of their names, and only until the lines are found: the first one by
    itself, split by split, then twice as many at a time. The lines are read when this is called.
    """
    names = log_file_versions(spark, paths, **options).select("source").distinct().orderBy("source")
    files = (row.source for row in names.toLocalIterator())
    first: list[Row] = []
    at_once = 1
    while len(first) < count and (some := list(islice(files, at_once))):
        lines = read_log_files(spark, [literal_path(f) for f in some])
        wanted = extract.guarded_lines(lines, spec)
        if at_once > 1:
            wanted = wanted.orderBy("source", "block", "seq")
        # Of a single file the splits come in order, and a limit looks at few of them at first.
        found = wanted.limit(count - len(first)).collect()
        first += sorted(found, key=lambda row: (row.source, row.block, row.seq))
        at_once *= 2
    table = spark.createDataFrame(first, "source string, block bigint, seq bigint, line string")
    return extract.stepwise(table, spec, time_format)


def _measurable(spec) -> None:
    if spec.kind not in (FIELD, DELTA):
        raise ValueError("cat and stat take a field value or an event delta")


def cat(spark: SparkSession, paths: str | Sequence[str], spec, **reading) -> DataFrame:
    """The measured numbers with their position: ``source, spec_id, count, value``."""
    _measurable(spec)
    return sequence.values_of(read_series(spark, paths, [spec], **reading), spec.measure)


@dataclass(frozen=True)
class Statistics:
    summary: DataFrame
    quantiles: DataFrame
    histogram: DataFrame


def stat(
    spark: SparkSession,
    paths: str | Sequence[str],
    spec,
    buckets: int = stats.BUCKETS,
    mode: str = "padded",
    **reading,
) -> Statistics:
    """Summary, quantiles and histogram per file. The logs are read once.

    Values of fields are taken as they are found; only deltas need the matches numbered.
    """
    _measurable(spec)
    if spec.kind == FIELD:
        time_format = reading.pop("time_format", TimeFormat())
        bad_timestamps = reading.pop("bad_timestamps", "fail")
        lines = read_log_files(spark, paths, **reading)
        values = sequence.plain_values(extract.hits(lines, [spec], time_format, bad_timestamps))
    else:
        place = fresh_path(spark, "values")
        with scratch(spark):
            values = stage(cat(spark, paths, spec, **reading), path=place)
    return Statistics(
        stats.summary(values), stats.quantiles(values), stats.histogram(values, buckets, mode=mode)
    )


def is_pattern(spark: SparkSession, path: str) -> bool:
    """Does a path stand for several files, as a directory or glob does?"""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop_path):
        return fs.getFileStatus(hadoop_path).isDirectory()
    return literal_path(path) != path


def listed_inputs(spark: SparkSession, inputs: Sequence[str], **options) -> DataFrame:
    """``(input_ix, source)`` of all files that the inputs stand for, input by input, by name."""
    parts, n = [], 0
    for path in inputs:
        several = is_pattern(spark, path)
        files = log_file_versions(spark, path, **options) if several else log_file_versions(spark, literal_path(path))
        own = stage(layout.numbered(files), "inputs")
        parts.append(own.withColumn("input_ix", F.col("input_ix") + n))
        n += own.count()
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Graph:
    """``lines``: bound lines with range and number of records; ``windows``: one per panel."""

    lines: DataFrame
    records: DataFrame
    windows: DataFrame
    series: DataFrame


def graph(
    spark: SparkSession,
    panels: Sequence[Panel],
    inputs: str | Sequence[str],
    per_file_panels: bool = False,
    share: str = "raw",
    alignment: str = "shared-full",
    window: ranges.Fractions | ranges.Instants | None = None,
    clip: bool = True,
    **reading,
) -> Graph:
    """Bind the panels to the files, extract, align the time windows, give the series to draw.

    ``inputs`` are files, directories and globs in the order of their numbers; the files of one
    directory or glob follow each other by name. The records are stored once; ranges and series read
    them from there. A ``window`` implies alignment ``fixed``.
    """
    time_format = reading.pop("time_format", TimeFormat())
    bad_timestamps = reading.pop("bad_timestamps", "fail")
    panels = [
        replace(
            panel,
            lines=[
                line if line.file_name is None
                else replace(line, file_name=source_name(spark, line.file_name))
                for line in panel.lines
            ],
        )
        for panel in panels
    ]
    inputs = [inputs] if isinstance(inputs, str) else list(inputs)
    named = {line.file_name: None for panel in panels for line in panel.lines if line.file_name is not None}
    if any(is_pattern(spark, path) for path in inputs):
        numbered = listed_inputs(spark, inputs, **reading)
        files = [*inputs, *(literal_path(f) for f in named)]
    else:
        numbered = [source_name(spark, path) for path in inputs]
        files = [literal_path(f) for f in dict.fromkeys([*numbered, *named])]
    bound = stage(layout.bind(spark, panels, numbered, per_file_panels, share), "bound")
    specs, sources = layout.extractions(panels, bound)
    if sources is not None:  # few files: open those that are needed, and only those
        files = [literal_path(f) for f in dict.fromkeys(f for names in sources.values() for f in names)]
    lines = read_log_files(spark, files, **reading)
    place = fresh_path(spark, "records")
    with scratch(spark):  # the stored hits are of no use once they are numbered
        found = extract.hits(lines, specs, time_format, bad_timestamps, sources)
        if sources is None:
            found = layout.only_needed(found, bound)
        records = stage(sorted_by_time(sequence.number_hits(found)), path=place)

    ranged = stage(ranges.bound_line_ranges(bound, ranges.line_ranges(records)), "lines")
    ranges.global_range(ranged).collect()  # an error if there is no record at all
    mode = alignment if window is None else "fixed"
    windows = stage(ranges.align(ranges.panel_ranges(ranged), mode, window), "windows")
    points = series.chart_series(bound, records, windows if clip else None)
    return Graph(ranged, records.drop("us"), windows, points)
