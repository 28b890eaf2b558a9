from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglathe import FieldValue, TimeFormat, parse_window
from loglathe.functions.timestamps import date_text, epoch_micros, micros_to_ts, time_text
from loglathe.operators.extract import with_timestamp


def parsed(spark, log, fmt, *lines):
    rows = with_timestamp(log(*lines), TimeFormat(fmt)).orderBy("block", "seq")
    return [(r.ts, r.rem) for r in rows.select(micros_to_ts(F.col("us")).alias("ts"), "rem").collect()]


NOON = datetime(2022, 6, 18, 12, 0, 7)
LEAP = datetime(2024, 2, 29, 23, 58, 1)


def epoch(moment):
    return int((moment - datetime(1970, 1, 1)).total_seconds())


CASES = [
    ("%Y-%m-%d %H:%M:%S%.3f", "2022-06-18 12:00:07.940 [a]", NOON.replace(microsecond=940000), " [a]"),
    ("%Y-%m-%d %H:%M:%S%.3f", "2022-06-18 12:00:07 [a]", NOON, " [a]"),
    ("%Y-%m-%d %H:%M:%S%.3f", "2022-6-18   12:0:7.9876543rest", NOON.replace(microsecond=987654), "rest"),
    ("%FT%T%.f", "2024-02-29T23:58:01.5Z", LEAP.replace(microsecond=500000), "Z"),
    ("%d/%m/%Y %H:%M:%S", "29/02/2024 23:58:01 |", LEAP, " |"),
    ("%m-%d %H:%M:%S", "06-18 12:00:07 |", NOON.replace(year=2025), " |"),
    ("%b %d %I:%M:%S %p", "Jun 18 12:00:07 PM\tz", NOON.replace(year=2025), "\tz"),
    ("%b %d %I:%M:%S %p", "jun 18 12:00:07 am z", NOON.replace(year=2025, hour=0), " z"),
    ("%B %e %Y %H:%M", "February 29 2024 23:58|", LEAP.replace(second=0), "|"),
    ("%j %I:%M:%S %p", "169 12:00:07 PM z", NOON.replace(year=2025), " z"),
    ("%Y %j %I:%M:%S %p", "2024 060 11:58:01 PM z", LEAP, " z"),
    ("[%s]", f"[{epoch(LEAP)}] z", LEAP, " z"),
    ("[%s%.3f]", f"[{epoch(NOON)}.75] z", NOON.replace(microsecond=750000), " z"),
    ("%H:%M:%S", "23:58:01 z", datetime(2025, 1, 1, 23, 58, 1), " z"),
    ("%I:%M:%S %p", "11:58:01 PM z", datetime(2025, 1, 1, 23, 58, 1), " z"),
    ("%y%m%d %H%M%S,%3f", "240229 235801,004 z", LEAP.replace(microsecond=4000), " z"),
    ("%a %b %e %H:%M:%S %Y", "Sat Jun 18 12:00:07 2022 z", NOON, " z"),
    ("%Y-%m-%dT%H:%M:%S%.f%:z", "2022-06-18T12:00:07.1+02:00 z", NOON.replace(microsecond=100000), " z"),
    # bad ones
    ("%Y-%m-%d %H:%M:%S%.3f", "2023-02-29 10:20:30 x", None, None),
    ("%Y-%m-%d %H:%M:%S%.3f", "x 2023-02-28 10:20:30", None, None),
    ("%Y-%m-%d %H:%M:%S%.3f", "2023-02-28 24:00:00", None, None),
    ("%Y-%m-%d %H:%M:%S%.3f", "2023-02-28 10:20:30. x", None, None),
    ("%Y-%m-%d %H:%M:%S%.3f", "", None, None),
    ("%b %d %H:%M:%S", "Feb 29 10:20:30 x", None, None),
    ("%j %H:%M:%S", "366 10:20:30 x", None, None),
    ("%I:%M:%S %p", "14:02:03 PM x", None, None),
    ("%H:%M:%S %p", "14:02:03 AM x", None, None),
    ("%a %b %e %H:%M:%S %Y", "Fri Jun 18 12:00:07 2022 x", None, None),
    ("[%s]", "[100.333] x", None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_formats(spark, log, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        by_format = {}
        for fmt, line, ts, rest in CASES:
            by_format.setdefault(fmt, []).append((line, ts, rest))
        for fmt, cases in by_format.items():
            got = parsed(spark, log, fmt, *[line for line, _, _ in cases])
            for (line, ts, rest), (got_ts, got_rest) in zip(cases, got):
                assert got_ts == ts, (fmt, line)
                if ts is not None:
                    assert got_rest == rest, (fmt, line)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_daylight_saving_gap(new_york, log):
    """02:30 does not exist in the session zone on that day; it must survive every step."""
    lines = log("2025-03-09 02:30:00.250 a", "2025-03-09 03:30:00.250 b")
    ts = micros_to_ts(F.col("us"))
    rows = with_timestamp(lines, TimeFormat()).orderBy("seq").select(
        ts.cast("string").alias("text"), date_text(ts).alias("d"), time_text(ts).alias("t"),
        epoch_micros(ts).alias("back"), "us",
    ).collect()
    assert rows[0].text == "2025-03-09 02:30:00.25"
    assert (rows[0].d, rows[0].t) == ("2025-03-09", "02:30:00.250")
    assert rows[1].us - rows[0].us == 3_600_000_000
    assert all(r.back == r.us for r in rows)


@pytest.mark.parametrize(
    "fmt", ["%Q", "%Y-%m-%d", "%H", "%I:%M:%S", "%d %H:%M:%S", "%U %H:%M:%S", "%Y %Y %j %H:%M:%S"]
)
def test_useless_or_unknown_formats_are_refused(fmt):
    with pytest.raises(ValueError):
        TimeFormat(fmt).regex


def test_has_date():
    assert TimeFormat("%H:%M %b").has_date and TimeFormat("[%s]").has_date
    assert not TimeFormat("%H:%M:%S%.3f").has_date


def test_windows(spark):
    window = parse_window(spark, "0.25, 0.5")
    assert (window.start, window.end) == (0.25, 0.5)
    window = parse_window(spark, "2025-01-01 00:00:00,2025-01-02 00:00:00.5")
    assert window.end == datetime(2025, 1, 2, 0, 0, 0, 500000)
    window = parse_window(spark, "08:00:00,09:30:00", TimeFormat("%H:%M:%S"))
    assert window.start == datetime(2025, 1, 1, 8)
    for bad in ("0.5,0.25", "-0.1,0.5", "0.5", "0,1,2", "yesterday,today"):
        with pytest.raises(ValueError):
            parse_window(spark, bad)


def test_seconds_too_large_for_a_timestamp_are_bad(extracted):
    found = extracted(FieldValue("x"), "[99999999999999] x=1", "[1700000000] x=2", fmt="[%s]", bad="ignore")
    assert [r[0] for r in found] == [2.0]
