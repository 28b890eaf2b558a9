from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from loglathe import Fractions, Instants
from loglathe.plans import ranges


def t(text):
    hour, minute, second = (int(x) for x in text.split(":"))
    return datetime(2025, 1, 1, hour, minute, second)


def ranged(spark, *panels):
    """panels: (mode, [(start, end) or None, ...])"""
    rows = []
    for panel_ix, (mode, spans) in enumerate(panels):
        for span in spans:
            start, end = (t(span[0]), t(span[1])) if span else (None, None)
            rows.append((panel_ix, mode, start, end))
    return spark.createDataFrame(
        rows, "panel_ix int, range_mode string, start timestamp_ntz, end timestamp_ntz"
    )


def windows(frame):
    return [(r.start, r.end) for r in frame.orderBy("panel_ix").collect()]


INNER, OUTER = ("05:20:00", "05:45:30"), ("04:15:10", "09:00:00")


def test_full_and_best_fit(spark):
    apart = [("10:00:00", "11:00:00"), ("12:00:00", "13:00:00")]
    frame = ranged(
        spark, ("full", [INNER, OUTER]), ("best-fit", [INNER, OUTER]), ("best-fit", apart),
        ("full", [None, INNER]), ("best-fit", [None]),
    )
    got = windows(ranges.align(ranges.panel_ranges(frame), "per-panel"))
    assert got == [
        tuple(map(t, OUTER)), tuple(map(t, INNER)), (t("10:00:00"), t("13:00:00")), tuple(map(t, INNER)), (None, None),
    ]


def test_shared_full_reaches_empty_panels(spark):
    frame = ranged(spark, ("full", [("02:30:00", "03:00:00")]), ("full", [("17:00:00", "17:45:00")]), ("full", [None]))
    got = windows(ranges.align(ranges.panel_ranges(frame)))
    assert got == [(t("02:30:00"), t("17:45:00"))] * 3


def test_shared_overlap(spark):
    meeting = ranged(spark, ("full", [("10:00:00", "12:00:00")]), ("full", [("11:00:00", "13:00:00")]))
    got = windows(ranges.align(ranges.panel_ranges(meeting), "shared-overlap"))
    assert got == [(t("11:00:00"), t("12:00:00"))] * 2
    apart = ranged(spark, ("full", [("10:00:00", "11:00:00")]), ("full", [("12:00:00", "13:00:00")]))
    got = windows(ranges.align(ranges.panel_ranges(apart), "shared-overlap"))
    assert got == [(t("10:00:00"), t("11:00:00")), (t("12:00:00"), t("13:00:00"))]


def test_fixed(spark):
    frame = ranged(spark, ("best-fit", [("10:00:00", "12:00:00"), ("11:00:00", "20:00:00")]), ("full", [None]))
    panels = ranges.panel_ranges(frame)
    assert windows(ranges.align(panels, "fixed", Fractions(0.1, 0.5))) == [(t("11:00:00"), t("15:00:00"))] * 2
    window = Instants(datetime(2025, 1, 1), datetime(2025, 1, 2, 0, 0, 0, 5))
    assert windows(ranges.align(panels, "fixed", window)) == [(window.start, window.end)] * 2
    third = windows(ranges.align(panels, "fixed", Fractions(0.0, 1 / 3)))
    assert third[0][1] == t("10:00:00") + timedelta(microseconds=12_000_000_000)


def test_range_errors(spark):
    instant = ranged(spark, ("full", [("10:00:00", "10:00:00")]))
    with pytest.raises(PySparkException, match="do not span any time"):
        ranges.align(ranges.panel_ranges(instant)).collect()
    with pytest.raises(PySparkException, match="no line of any panel"):
        ranges.global_range(ranged(spark, ("full", [None]))).collect()
    for bad in ((0.5, 0.5), (-0.1, 0.5), (0.5, 1.5)):
        with pytest.raises(ValueError):
            Fractions(*bad)
    with pytest.raises(ValueError):
        ranges.align(instant, "fixed")


def records(spark, *rows):
    schema = "source string, spec_id string, ts timestamp_ntz, value double, count bigint, delta double"
    return spark.createDataFrame([("f", spec, t(ts), 1.0, count, 0.0) for spec, ts, count in rows], schema)


def test_line_range_is_first_to_last_in_file_order(spark):
    rows = records(spark, ("a", "12:00:00", 1), ("a", "09:00:00", 2), ("a", "11:00:00", 3), ("b", "08:00:00", 4))
    got = {r.spec_id: (r.start, r.end, r.n) for r in ranges.line_ranges(rows).collect()}
    assert got == {"a": (t("12:00:00"), t("11:00:00"), 3), "b": (t("08:00:00"), t("08:00:00"), 1)}


def test_lines_in_range_end_is_exclusive(spark):
    rows = records(spark, ("a", "10:00:00", 1), ("b", "11:00:00", 1), ("c", "09:59:59", 1), ("d", "10:59:59", 1))
    bound = spark.createDataFrame(
        [(0, i, "f", s) for i, s in enumerate("abcde")], "panel_ix int, line_ix int, source string, spec_id string"
    )
    window = spark.createDataFrame(
        [(0, t("10:00:00"), t("11:00:00"))], "panel_ix int, start timestamp_ntz, end timestamp_ntz"
    )
    got = ranges.lines_in_range(bound, window, rows).orderBy("line_ix").collect()
    assert [r.has_data for r in got] == [True, False, False, True, False]
