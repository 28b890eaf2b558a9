"""One query per operator, over whole tables."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.functions import patterns
from loglathe.functions.timestamps import MONTHS, TimeFormat, epoch_micros, micros_to_ts
from loglathe.operators import extract, sequence, stats
from loglathe.plans import layout, ranges, series
from loglathe.sources import records as record_tables
from loglathe.sources.lines import lines_from_text, read_log_files
from loglathe.sources.staging import fresh_path, stage
from loglathe.spec import EventCount, EventDelta, EventValue, FieldValue, Line, Panel
from loglathe.streaming.refresh import current_records, refresh_records

from .logs import INPUTS, default_stamp, event_id, event_lines, labelled, source, table, value_text

DEFAULT = TimeFormat()
RECORD = ["source", "count", "ts", "value"]


def numbered(lines: DataFrame, *specs, fmt: TimeFormat = DEFAULT, bad: str = "fail") -> DataFrame:
    return sequence.number_hits(extract.hits(lines, specs, fmt, bad))


# Lines and filters


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines_from_text(table(spark, folder, "documents"), "text", "doc_id", "source")


def table_lines(spark, folder):
    lines = text_lines(spark, folder)
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


def scan_lines(spark, folder):
    path = fresh_path(spark, "scan-lines")
    texts = table(spark, folder, "documents").select("lang", "text")
    texts.write.partitionBy("lang").text(path)
    lines = read_log_files(spark, path)
    return lines.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
        F.max(F.length("line")).cast("bigint").alias("longest"),
        F.count_distinct("line").alias("n_distinct"),
    )


def guard_filter(spark, folder):
    spec = EventCount("", guard="ung ")
    kept = text_lines(spark, folder).where(extract.guarded(spec, F.col("line")))
    return kept.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


def regex_filter(spark, folder):
    kept = text_lines(spark, folder).where(patterns.found(F.col("line"), REGEX))
    return kept.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


PARAGRAPH = r"<h1>[^<]{20,}(?:</h1>|&[[:alpha:]]+;)"
ASKED = "(?i)(?:^| )(?P<word>the|der|que) [[:alpha:]]+[?.!]$"


def page_lines(spark, folder):
    """Lines of the markup of every page, and what some patterns find in them."""
    line = F.col("line")
    lines = lines_from_text(table(spark, folder, "pages"), "html", "page_id", "url")
    return lines.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(extract.guarded(EventCount("", guard="<article"), line)).alias("n_articles"),
        F.count_if(patterns.found(line, PARAGRAPH)).alias("n_headed"),
    )


def conversation_lines(spark, folder):
    """Lines of what each role says, in the order of conversations and turns, that a pattern finds."""
    order = F.col("conv_id") * 65_536 + F.col("turn")
    lines = lines_from_text(table(spark, folder, "conversations"), "text", order, "role")
    kept = lines.where(patterns.found(F.col("line"), ASKED))
    return kept.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


REGEX = "[a-z]+(tion|keit|ado)[,.] [A-Z]"


def field_shorthand(spark, folder):
    spec = FieldValue("user")
    return numbered(event_lines(spark, folder), spec).select(*RECORD)


# The dialect of patterns at work: names of groups, properties, bracket classes and flags in the middle.
PATTERNS = {
    "named": FieldValue(r"error_module user=[[:digit:]]+ value=(?<number>\d+\.\d+)(?P<unit_of_it>\p{Ll}+)"),
    "flags": EventCount(r"(?i:CLICK)_module(?i) USER=1[[:digit:]--[5-9]] "),
    "lazy": FieldValue(r"(?U)view.* user=(\d+)(?-U) value=[\w&&[^\D]]+"),
    "property": EventCount(r"\b{start}\p{L}+_module\x20user=\d\b"),
    "name": FieldValue("us(er"),
}


def field_patterns(spark, folder):
    return labelled(numbered(event_lines(spark, folder), *PATTERNS.values()), PATTERNS).select("spec", *RECORD)


# Timestamps


def stamped(spark, folder, stamp, fmt) -> DataFrame:
    lines = extract.with_timestamp(event_lines(spark, folder, stamp), TimeFormat(fmt))
    good = F.col("us").isNotNull()
    return lines.select(
        "source",
        event_id().alias("event_id"),
        micros_to_ts(F.col("us")).alias("ts"),
        F.when(good, F.col("rem")).alias("remainder"),
    )


def _piece(ts, start, length):
    return F.substring(ts.cast("string"), start, length)


def _later():
    """Events moved by 45 days, so that they include 29 February of a leap year."""
    return F.timestamp_add("DAY", F.lit(45), F.col("ts"))


def _clock12(ts):
    hour = F.hour(ts)
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    half = F.when(hour < 12, "AM").otherwise("PM")
    return F.concat(F.lpad(shown, 2, "0"), _piece(ts, 14, 6), F.lit(" "), half)


def extract_ts_yearless(spark, folder):
    ts = _later()
    names = F.array(*[F.lit(m[:3].title()) for m in MONTHS])
    month = F.element_at(names, F.month(ts))
    stamp = F.concat_ws(" ", month, _piece(ts, 9, 2), _clock12(ts))
    return stamped(spark, folder, stamp, "%b %d %I:%M:%S %p")


def extract_ts_epoch(spark, folder):
    seconds = F.floor(epoch_micros(F.col("ts")) / 1_000_000).cast("string")
    stamp = F.concat(F.lit("["), seconds, F.lit("]"))
    return stamped(spark, folder, stamp, "[%s]")


def extract_ts_doy(spark, folder):
    ts = _later()
    day = F.lpad(F.dayofyear(ts).cast("string"), 3, "0")
    return stamped(
        spark, folder, F.concat_ws(" ", _piece(ts, 1, 4), day, _clock12(ts)), "%Y %j %I:%M:%S %p"
    )


def extract_ts_time_only(spark, folder):
    lines = event_lines(spark, folder, F.substring(default_stamp(), 12, 12))
    spec = FieldValue("value")
    records = numbered(lines, spec, fmt=TimeFormat("%H:%M:%S%.3f"))
    return records.select(*RECORD, "delta")


def _broken_stamp():
    """Every 97th timestamp is unreadable."""
    return F.concat(F.when(F.col("event_id") % 97 == 0, "?").otherwise(""), default_stamp())


AUDITED = {"error": FieldValue("value", guard="error_module"), "user_1": EventCount("user=1[0-9] ")}


def bad_timestamps(spark, folder):
    lines = event_lines(spark, folder, _broken_stamp())
    return labelled(extract.bad_timestamp_counts(lines, AUDITED.values(), DEFAULT), AUDITED)


def extract_audit(spark, folder):
    number = F.when(F.col("event_id") % 7 == 0, F.lit("1.2.3")).otherwise(value_text())
    lines = event_lines(spark, folder, _broken_stamp(), number)
    return labelled(extract.audit(lines, AUDITED.values(), DEFAULT), AUDITED)


def match_preview(spark, folder):
    lines = event_lines(spark, folder, _broken_stamp())
    spec = FieldValue(r"click_module user=\d+ value=([\d\.]+)(\w+)?", guard="module user=1")
    rows = extract.preview(lines, spec, DEFAULT, count=25)
    return rows.withColumn("event_id", event_id()).drop("block", "seq", "line")


# Values, counts, deltas


def field_value(spark, folder):
    spec = FieldValue(r"value=([\d\.]+)", guard="view_module")
    return numbered(event_lines(spark, folder), spec).select(*RECORD)


def field_value_units(spark, folder):
    return numbered(event_lines(spark, folder), FieldValue("value")).select(*RECORD)


def field_value_gaps(spark, folder):
    number = F.when(F.col("event_id") % 7 == 0, F.lit("1.2.3")).otherwise(value_text())
    lines = event_lines(spark, folder, number=number)
    return numbered(lines, FieldValue("value")).select(*RECORD, "delta")


def event_value(spark, folder):
    spec = EventValue("purchase_module", yvalue=2.5)
    return numbered(event_lines(spark, folder), spec).select(*RECORD)


def event_count(spark, folder):
    spec = EventCount("error_module")
    return numbered(event_lines(spark, folder), spec).select("source", "ts", "count")


def event_delta(spark, folder):
    spec = EventDelta("(click|view)_module")
    return numbered(event_lines(spark, folder), spec).select("source", "ts", "count", "delta")


def cat(measure, spec, spark, folder):
    values = sequence.values_of(numbered(event_lines(spark, folder), spec), measure)
    return values.select("source", F.col("count").alias("position"), "value")


MIXED = {
    "error_value": FieldValue("value", guard="error_module"),
    "purchase": EventValue("purchase_module", yvalue=3.0),
    "click": EventCount("click_module"),
    "user_1": EventDelta("user=1[0-9]* "),
}


def multi_spec_scan(spark, folder):
    records = numbered(event_lines(spark, folder), *MIXED.values())
    return labelled(records, MIXED).select("spec", *RECORD, "delta")


# Layout

SHARED = {
    "click_value": FieldValue("value", guard="click_module"),
    "click_count": EventCount("value", guard="click_module"),
    "error": EventCount("error_module"),
}
SHARED_PANELS = [
    Panel(
        [
            Line(SHARED["click_value"]),
            Line(SHARED["click_count"]),
            Line(EventDelta("value", guard="click_module")),
            Line(EventDelta("error_module")),
            Line(SHARED["error"]),
        ]
    )
]


def laid_out(spark, folder, panels, per_file_panels=False):
    """Bound lines and the records of all their extractions (one pass)."""
    bound = layout.bind(spark, panels, INPUTS, per_file_panels)
    specs, sources = layout.extractions(panels, bound)
    lines = event_lines(spark, folder)
    records = sequence.number_hits(extract.hits(lines, specs, DEFAULT, "fail", sources))
    return bound, records


def shared_records(spark, folder):
    bound, records = laid_out(spark, folder, SHARED_PANELS)
    totals = records.groupBy("source", "spec_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("count").alias("last_count"),
        F.sum("delta").alias("sum_delta"),
    )
    joined = bound.join(totals, ["source", "spec_id"])
    columns = ["panel_ix", "line_ix", "source", "kind", "n", "last_count", "sum_delta"]
    return labelled(joined, SHARED).select(*columns, "spec")


BOUND_PANELS = [
    Panel(
        [
            Line(MIXED["error_value"], file_id=1),
            Line(MIXED["purchase"]),
            Line(MIXED["click"], file_name="user_3.log", yaxis="y2"),
        ],
        title="first",
    ),
    Panel([Line(EventCount("nothing like it"), file_id=0), Line(MIXED["user_1"], file_id=2)]),
    Panel([Line(MIXED["error_value"], title="errors")], title="last"),
]


def bound_lines(spark, folder, per_file_panels=False):
    bound, records = laid_out(spark, folder, BOUND_PANELS, per_file_panels)
    return stats.match_counts(records, bound)


def match_counts(spark, folder):
    counted = bound_lines(spark, folder)
    return counted.select("source", "kind", "pattern", "n").distinct()


def bind_files(spark, folder):
    counted = bound_lines(spark, folder)
    return counted.select("panel_ix", "line_ix", "input_ix", "source", "kind", "n")


def per_file_panels(spark, folder):
    counted = bound_lines(spark, folder, per_file_panels=True)
    return counted.select("panel_ix", "line_ix", "source", "kind", "panel_source", "n")


def line_titles(spark, folder):
    counted = bound_lines(spark, folder, per_file_panels=True)
    heading = F.replace("panel_titles", F.lit("\n"), F.lit(" / ")).alias("heading")
    return counted.select("panel_ix", "line_ix", "title", heading, "n")


# Statistics


def unit_hits(spark, folder):
    return extract.hits(event_lines(spark, folder), [FieldValue("value")], DEFAULT)


def stat_summary(spark, folder):
    totals = sequence.summary(unit_hits(spark, folder))
    return totals.select("source", "count", "min", "max", F.round("mean", 6).alias("mean"))


def stat_quantiles(spark, folder):
    return stats.quantiles(sequence.plain_values(unit_hits(spark, folder))).drop("spec_id")


def stat_quantiles_delta(spark, folder):
    records = numbered(event_lines(spark, folder), EventDelta("click_module"))
    values = stage(sequence.values_of(records, "delta"), "values")
    return stats.quantiles(values).drop("spec_id")


def stat_quantiles_wide(spark, folder):
    items = table(spark, folder, "lineitem")
    return stats.quantiles(items, ["l_returnflag", "l_linestatus"], "l_extendedprice")


def stat_histogram(spark, folder):
    rows = stats.histogram(sequence.plain_values(unit_hits(spark, folder))).drop("spec_id")
    return rows.withColumnsRenamed({"start": "bucket_start", "end": "bucket_end"})


def stat_histogram_wide(spark, folder):
    items = table(spark, folder, "lineitem")
    rows = stats.histogram(items, 16, ["l_returnflag"], "l_extendedprice")
    return rows.withColumnsRenamed({"start": "bucket_start", "end": "bucket_end"})


# Ranges

RANGE_PANELS = [
    Panel([Line(MIXED["error_value"]), Line(MIXED["click"])]),
    Panel(
        [
            Line(MIXED["purchase"], file_id=1),
            Line(MIXED["user_1"], file_name="user_2.log"),
            Line(EventCount("nothing like it"), file_id=0),
        ],
        range_mode="best-fit",
    ),
    Panel([Line(EventCount("user=7 "), file_id=3), Line(EventCount("user=11 "), file_id=3)],
          range_mode="best-fit"),
    Panel([Line(EventCount("nothing at all"), file_id=0)]),
]
ABSOLUTE = ranges.Instants(datetime(2024, 1, 5), datetime(2024, 1, 9, 12, 30, 0, 250000))
RELATIVE = ranges.Fractions(0.25, 0.6)
RANGE = {"start": "range_start", "end": "range_end"}


def ranged_lines(spark, folder):
    bound, records = laid_out(spark, folder, RANGE_PANELS)
    return ranges.bound_line_ranges(bound, ranges.line_ranges(records))


def line_ranges(spark, folder):
    columns = ["panel_ix", "line_ix", "source", "start", "end", "n"]
    return ranged_lines(spark, folder).select(*columns).withColumnsRenamed(RANGE)


def global_range(spark, folder):
    return ranges.global_range(ranged_lines(spark, folder)).withColumnsRenamed(RANGE)


def panel_ranges(mode, spark, folder):
    panels = ranges.panel_ranges(ranged_lines(spark, folder)).where(F.col("range_mode") == mode)
    return panels.select("panel_ix", "start", "end").withColumnsRenamed(RANGE)


def aligned(mode, window, spark, folder):
    panels = ranges.panel_ranges(ranged_lines(spark, folder))
    windows = ranges.align(panels, mode, window)
    return windows.select("panel_ix", "start", "end").withColumnsRenamed(RANGE)


def staged_layout(spark, folder, mode, window=None):
    """Records stored once, then read for the ranges and again for what the ranges select."""
    bound, records = laid_out(spark, folder, RANGE_PANELS)
    records = stage(record_tables.sorted_by_time(records), "records")
    panels = ranges.panel_ranges(
        ranges.bound_line_ranges(bound, ranges.line_ranges(records))
    )
    windows = stage(ranges.align(panels, mode, window), "windows")
    return bound, records, windows


def aligned_absolute(spark, folder):
    """The window of every panel, and how many records of its lines lie in it."""
    bound, records, windows = staged_layout(spark, folder, "fixed", ABSOLUTE)
    near = ranges.inside(records, windows, open_end=True)
    drawn = near.select("source", "spec_id", "ts").join(bound, ["source", "spec_id"]).join(windows, "panel_ix")
    drawn = drawn.where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    counted = windows.join(drawn.groupBy("panel_ix").agg(F.count("*").alias("n")), "panel_ix", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint").alias("n_records")
    return counted.select("panel_ix", "start", "end", n).withColumnsRenamed(RANGE)


def lines_in_range(spark, folder):
    bound, records, windows = staged_layout(spark, folder, "fixed", ABSOLUTE)
    found = ranges.lines_in_range(bound, windows, records)
    return found.select("panel_ix", "line_ix", "source", "has_data")


# Series and records


def chart_series(spark, folder):
    bound, records = laid_out(spark, folder, RANGE_PANELS)
    return series.chart_series(bound, records)


def chart_series_clipped(spark, folder):
    bound, records, windows = staged_layout(spark, folder, "fixed", RELATIVE)
    return series.chart_series(bound, records, windows)


def records_export(spark, folder):
    records = numbered(event_lines(spark, folder), MIXED["error_value"])
    return record_tables.export_columns(records, "source")


def records_roundtrip(spark, folder):
    records = numbered(event_lines(spark, folder), *MIXED.values())
    path = fresh_path(spark, "records-csv")
    record_tables.write_records_csv(records, path)
    back = labelled(record_tables.read_records_csv(spark, path), MIXED)
    return back.select("spec", *RECORD, "delta")


def refreshed(spark, folder):
    """Logs of two users are extracted, two more arrive, only these are extracted next."""
    logs, store = fresh_path(spark, "logs"), fresh_path(spark, "store")
    lines = event_lines(spark, folder).select(
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("user"), "line"
    )
    specs = [MIXED["error_value"], MIXED["click"]]
    for low, high in ((0, 1), (2, 3)):
        arriving = lines.where(F.col("user").between(low, high))
        arriving.write.mode("append").partitionBy("user").text(logs)
        refresh_records(spark, logs, specs, store, bad_timestamps="ignore")
    rows = current_records(spark, logs, store)
    user = F.regexp_extract("source", r"/user=(\d+)/", 1).alias("user")
    totals = labelled(rows, MIXED).groupBy(user, "spec").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 6).alias("total"),
        F.count_distinct("run").alias("runs"),
    )
    return totals


QUERIES = {
    "table_lines": table_lines,
    "scan_lines": scan_lines,
    "guard_filter": guard_filter,
    "regex_filter": regex_filter,
    "page_lines": page_lines,
    "conversation_lines": conversation_lines,
    "field_shorthand": field_shorthand,
    "field_patterns": field_patterns,
    "extract_ts": lambda spark, folder: stamped(spark, folder, default_stamp(), DEFAULT.text),
    "extract_ts_yearless": extract_ts_yearless,
    "extract_ts_epoch": extract_ts_epoch,
    "extract_ts_doy": extract_ts_doy,
    "extract_ts_time_only": extract_ts_time_only,
    "bad_timestamps": bad_timestamps,
    "extract_audit": extract_audit,
    "match_preview": match_preview,
    "field_value": field_value,
    "field_value_units": field_value_units,
    "field_value_gaps": field_value_gaps,
    "event_value": event_value,
    "event_count": event_count,
    "event_delta": event_delta,
    "cat_field": partial(cat, "value", MIXED["error_value"]),
    "cat_delta": partial(cat, "delta", EventDelta("purchase_module")),
    "multi_spec_scan": multi_spec_scan,
    "shared_records": shared_records,
    "match_counts": match_counts,
    "bind_files": bind_files,
    "per_file_panels": per_file_panels,
    "line_titles": line_titles,
    "stat_summary": stat_summary,
    "stat_quantiles": stat_quantiles,
    "stat_quantiles_delta": stat_quantiles_delta,
    "stat_quantiles_wide": stat_quantiles_wide,
    "stat_histogram": stat_histogram,
    "stat_histogram_wide": stat_histogram_wide,
    "line_ranges": line_ranges,
    "global_range": global_range,
    "panel_ranges_full": partial(panel_ranges, "full"),
    "panel_ranges_best_fit": partial(panel_ranges, "best-fit"),
    "align_per_panel": partial(aligned, "per-panel", None),
    "align_shared_full": partial(aligned, "shared-full", None),
    "align_shared_overlap": partial(aligned, "shared-overlap", None),
    "align_fixed_relative": partial(aligned, "fixed", RELATIVE),
    "align_fixed_absolute": aligned_absolute,
    "lines_in_range": lines_in_range,
    "chart_series": chart_series,
    "chart_series_clipped": chart_series_clipped,
    "records_export": records_export,
    "records_roundtrip": records_roundtrip,
    "refresh_records": refreshed,
}
