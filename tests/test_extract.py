from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from loglathe import EventCount, EventDelta, EventValue, FieldValue, TimeFormat
from loglathe.operators import extract
from loglathe.operators.sequence import number_hits

STAMP = datetime(2023, 11, 6, 21, 40, 17, 305000)


def at(text, stamp=STAMP):
    return f"{stamp:%Y-%m-%d %H:%M:%S}.{stamp.microsecond // 1000:03d} {text}"


def test_shorthand_field(extracted):
    line = at("cache[3] evict age=86.25ms kept=7")
    assert extracted(FieldValue("age", guard="evict"), line) == [(86.25, 1, None, STAMP)]
    assert extracted(FieldValue("kept", guard="evict"), line)[0][0] == 7.0


def test_regex_picks_its_number(extracted):
    lines = [at(f"flush: wrote {n} pages, waited:{n * 40}us; synced:{n}s") for n in (3, 8)]
    waited = extracted(FieldValue(r"waited:(\d+)(\w+)"), *lines)
    synced = extracted(FieldValue(r"synced:(\d+)(\w+)"), *lines)
    assert [r[0] for r in waited] == [n * 40 / 1000 for n in (3, 8)]
    assert [r[0] for r in synced] == [n * 1000.0 for n in (3, 8)]


@pytest.mark.parametrize("column", range(5))
@pytest.mark.parametrize("fmt", ["%b %d %I:%M:%S %p", "[%s]", "%j %I:%M:%S %p", "%H:%M:%S"])
def test_column_by_position(extracted, fmt, column):
    """A table of numbers, one column of which is counted off; the stamp is written by strftime."""
    moment = datetime(2025, 10, 27, 16, 5, 59)
    seconds = int((moment - datetime(1970, 1, 1)).total_seconds())
    stamp = f"[{seconds}]" if fmt == "[%s]" else moment.strftime(fmt)
    cells = ["12.5", "0.75", "40960", "3", "99.125"]
    pattern = rf"^ (?:[^|]+\|){{{column}}} *([\d.]+) *(?:\||$)"
    found = extracted(FieldValue(pattern), f"{stamp} {' | '.join(cells)}", fmt=fmt)
    day = moment if fmt != "%H:%M:%S" else moment.replace(month=1, day=1)
    assert found == [(float(cells[column]), 1, None, day)]


def test_counts_and_deltas(extracted):
    """Irregular steps, one of them back in time; the blocks may be of any size."""
    steps = [0, 5, 1300, -250, 86_400_001, 64]
    moments, values = [], [0.5, 4.0, 0.125, 16.0, 2.0, 32.0]
    for step in steps:
        moments.append((moments[-1] if moments else STAMP) + timedelta(milliseconds=step))
    lines = []
    for moment, value in zip(moments, values):
        lines += [at(f"sensor temp={value}", moment), at("sensor idle", moment)]
    for size in (1, 3, 64):
        rows = extracted(FieldValue("temp", guard="sensor"), *lines, rows_per_block=size)
        assert [r[:3] for r in rows] == list(zip(values, range(1, 7), [None, *map(float, steps[1:])]))
        assert [r[3] for r in rows] == moments


def test_units(extracted):
    values = ["540.5µs", "540.5μs", "7microseconds", "8ns", "9s", "10ms", "11", "12min"]
    rows = extracted(FieldValue("d"), *[at(f"d={v}") for v in values])
    assert [r[0] for r in rows] == [0.5405, 0.5405, 0.007, 8 / 1e6, 9000.0, 10.0, 11.0, 12.0]


def test_text_that_is_no_number_counts_but_gives_no_record(extracted):
    texts = ["1.5", "1.2.3", "1d", "0x1p3", "nan", "-2e3", ".5", "7.", "1f", "+4"]
    rows = extracted(FieldValue(r"v=(\S+)"), *[at(f"v={t}") for t in texts])
    assert [(r[0], r[1]) for r in rows] == [(1.5, 1), (-2000.0, 6), (0.5, 7), (7.0, 8), (4.0, 10)]


def test_optional_number_group_means_zero(extracted):
    spec = FieldValue(r"load(?: is (\d+))?")
    assert [r[0] for r in extracted(spec, at("load"), at("load is 3"))] == [0.0, 3.0]


def test_empty_number_group_gives_no_record(extracted):
    assert extracted(FieldValue(r"x=(\d*);"), at("x=;"), at("x=4;"))[0][:2] == (4.0, 2)


def test_guard_sees_the_timestamp_and_case(extracted):
    assert len(extracted(EventCount("up", guard="17.305"), at("up"))) == 1
    assert extracted(EventCount("up", guard="UP"), at("up")) == []


def test_pattern_sees_only_the_remainder(extracted):
    assert extracted(EventCount("2023"), at("nothing")) == []
    assert len(extracted(EventCount("^ up$"), at("up"), at("up and up"))) == 1


def test_event_value_and_substring_pattern(extracted):
    rows = extracted(EventValue("Elect", yvalue=7.5), at("state=LeaderElected"), at("other"))
    assert [r[0] for r in rows] == [7.5]


def test_time_only_delta_can_be_negative(extracted):
    rows = extracted(EventDelta("x"), "23:59:59 x", "00:00:01 x", fmt="%H:%M:%S")
    assert [r[2] for r in rows] == [None, -86398000.0]


def test_delta_uses_full_precision_and_truncates(extracted):
    rows = extracted(
        EventDelta("x"), "2025-01-01 00:00:00.0009 x", "2025-01-01 00:00:00.0024 x",
        "2025-01-01 00:00:00.0005 x", fmt="%Y-%m-%d %H:%M:%S%.f",
    )
    assert [r[2] for r in rows] == [None, 1.0, -1.0]
    assert rows[1][3] == datetime(2025, 1, 1, 0, 0, 0, 2000)


def test_field_names_are_whole_words(extracted):
    rows = extracted(FieldValue("dur"), at("xdur=1 dur=2"))
    assert [r[0] for r in rows] == [2.0]


def test_named_groups(extracted):
    assert extracted(FieldValue(r"took (?P<number>\d+)(?P<unit>s)"), at("took 3s"))[0][0] == 3000.0


def test_bad_timestamps_up_to_three_are_tolerated(extracted):
    good, bad = at("request x"), "no timestamp, request x"
    spec = EventCount("x", guard="request")
    unguarded = "no timestamp and no guard x"
    rows = extracted(spec, bad, good, bad, unguarded, unguarded, good, bad, rows_per_block=2)
    assert [r[1] for r in rows] == [1, 2]
    with pytest.raises(PySparkException, match="4 lines of input.log"):
        extracted(spec, bad, good, bad, bad, good, bad, rows_per_block=2)
    with pytest.raises(PySparkException, match="no valid timestamp"):
        extracted(spec, *[bad] * 9)
    assert len(extracted(spec, bad, good, bad, bad, good, bad, bad="ignore")) == 2


def test_previous_match_is_found_across_bad_lines_and_empty_blocks(extracted):
    lines = ["2025-01-01 00:00:00 x", "bad x", "2025-01-01 00:00:01 other", "2025-01-01 00:00:02 other",
             "2025-01-01 00:00:05 x", "bad x"]
    rows = extracted(EventDelta("x"), *lines, rows_per_block=1)
    assert [r[2] for r in rows] == [None, 5000.0]


def test_one_pass_for_many_specs(spark, log):
    lines = log(at("a v=1s"), at("b v=2"), at("a b"), "bad b")
    specs = [FieldValue("v", guard="a"), EventCount("b"), EventCount("nothing"), FieldValue("v")]
    records = number_hits(extract.hits(lines, specs, TimeFormat()))
    got = {(s.spec_id, r["count"]): r["value"] for s in specs for r in records.collect()
           if r["spec_id"] == s.spec_id}
    assert got == {
        (specs[0].spec_id, 1): 1000.0, (specs[1].spec_id, 1): 1.0, (specs[1].spec_id, 2): 1.0,
        (specs[3].spec_id, 1): 1000.0, (specs[3].spec_id, 2): 2.0,
    }


@pytest.mark.parametrize("bad", ["fail", "ignore"])
def test_specs_as_a_table_equal_specs_spelled_out(spark, log, bad):
    specs = [FieldValue("v", guard="a"), EventCount("b"), EventCount("nothing"), FieldValue("v"), FieldValue(r"load(?: is (\d+)(k)?)?"),
             FieldValue(r"(?i)V=(\d+)(?<u>us)"), EventValue(r"^ a\b", yvalue=2.5), EventDelta("c|d", guard="v="), EventCount("v=1")]
    texts = ["a v=1s", "b v=2", "a b", "load", "load is 7k", "V=12us c", "v=3 d", "", "a v=x", "none of it", "a v=1.2.3"]
    lines = log(*map(at, texts), "bad a v=1", "bad b", None, source="x.log").unionByName(log(*map(at, texts[:4]), source="y.log"))
    limits = {specs[0].spec_id: ["y.log"], specs[1].spec_id: [], specs[3].spec_id: ["x.log", "y.log"]}
    for sources in (None, limits):
        spelled = extract.hits(lines, specs, TimeFormat(), bad, sources)
        table = extract.hits(lines, specs, TimeFormat(), bad, sources, unrolled=0)
        assert table.columns == spelled.columns and spelled.count() > 10
        assert table.exceptAll(spelled).isEmpty() and spelled.exceptAll(table).isEmpty()


def test_the_plan_of_many_specs_does_not_grow(spark, log):
    def plan(n):
        specs = [FieldValue("v", guard=f"user={i} ") for i in range(n)]
        return extract.hits(log(at("user=3 v=4")), specs, TimeFormat(), "ignore")._jdf.queryExecution().optimizedPlan().treeString()

    assert len(plan(400).splitlines()) == len(plan(40).splitlines())
    (row,) = extract.hits(log(at("user=3 v=4")), [FieldValue("v", guard=f"user={i} ") for i in range(400)], TimeFormat()).collect()
    assert row.value == 4.0


def test_specs_limited_to_sources(spark, log):
    lines = log(at("x"), source="a.log").unionByName(log(at("x"), source="b.log"))
    spec = EventCount("x")
    found = extract.hits(lines, [spec], TimeFormat(), sources={spec.spec_id: ["b.log"]})
    assert [r.source for r in found.collect()] == ["b.log"]


def test_audit(log):
    lines = log(at("g v=1"), at("g v=1.2.3"), at("g none"), "bad g v=1", at("v=2"))
    (row,) = extract.audit(lines, [FieldValue("v", guard="g")], TimeFormat()).collect()
    assert (row["lines"], row["guard_hits"], row["bad_timestamps"]) == (5, 4, 1)
    assert (row["pattern_misses"], row["matches"], row["records"]) == (1, 2, 1)


def test_preview_spends_its_limit_on_guard_hits(log):
    lines = log(at("no"), at("g none"), "bad g v=1", at("g v=2s"), at("g v=x"), at("g v=5"))
    rows = extract.preview(lines, FieldValue("v", guard="g"), TimeFormat(), count=3)
    got = [(r["ts_ok"], r["matched"], r["value_text"], r["unit"], r["value"]) for r in rows.collect()]
    assert got == [
        (True, False, None, None, None), (False, False, None, None, None), (True, True, "2", "s", 2000.0)
    ]
