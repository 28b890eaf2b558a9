"""Timestamped text logs to time series, statistics and chart data on Spark."""

from .functions.timestamps import DEFAULT_FORMAT, TimeFormat
from .plans.logs import Graph, Statistics, cat, graph, match_preview, read_series, stat
from .plans.ranges import Fractions, Instants, parse_window
from .sources.lines import lines_from_table, lines_from_text, read_log_files
from .sources.records import Window
from .sources.staging import scratch
from .spec import EventCount, EventDelta, EventValue, FieldValue, Line, Panel
from .streaming.refresh import clean_store, compact_records, current_records, refresh_records

__all__ = [
    "DEFAULT_FORMAT",
    "EventCount",
    "EventDelta",
    "EventValue",
    "FieldValue",
    "Fractions",
    "Graph",
    "Instants",
    "Line",
    "Panel",
    "Statistics",
    "TimeFormat",
    "Window",
    "cat",
    "clean_store",
    "compact_records",
    "current_records",
    "graph",
    "lines_from_table",
    "lines_from_text",
    "match_preview",
    "parse_window",
    "read_log_files",
    "read_series",
    "refresh_records",
    "scratch",
    "stat",
]
