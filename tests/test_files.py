import gzip
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import loglathe as ll
from loglathe.plans.logs import read_series
from loglathe.sources.lines import local_path, source_name
from loglathe.sources.records import (
    read_records, read_records_csv, write_records, write_records_csv,
)
from loglathe.plans.series import write_series


def stamp(i):
    return f"2025-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}.{i % 1000:03d}"


def write(path, lines, newline="\n"):
    path.write_bytes("".join(line + newline for line in lines).encode())
    return str(path)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a b+c.log").write_bytes(b"one\r\ntwo\rthree\n\nlast")
    (tmp_path / "bad.log").write_bytes(b"fine\nb\xffd\nfine again\n")
    (tmp_path / "empty.log").write_bytes(b"")
    with gzip.open(tmp_path / "z.log.gz", "wt") as f:
        f.write("zipped\n")
    rows = ll.read_log_files(spark, str(tmp_path)).orderBy("source", "block", "seq").collect()
    got = {}
    for row in rows:
        got.setdefault(os.path.basename(local_path(row.source)), []).append(row.line)
    assert got == {
        "a b+c.log": ["one", "two\rthree", "", "last"],
        "bad.log": ["fine", "b�d", "fine again"],
        "z.log.gz": ["zipped"],
    }
    assert source_name(spark, str(tmp_path / "a b+c.log")) in {r.source for r in rows}


def test_texts_read_like_files(spark):
    texts = spark.createDataFrame([(0, "a\r\nb\n"), (1, ""), (70000, "\n\nc"), (2, None)], "i bigint, t string")
    lines = ll.lines_from_text(texts, "t", "i", F.lit("s"))
    assert [r.line for r in lines.orderBy("block", "seq").collect()] == ["a", "b", "", "", "c"]


def test_order_over_many_splits_and_files(small_splits, tmp_path):
    spark = small_splits
    for name, n in (("big.log", 900), ("mid.log", 90), ("one.log", 1)):
        write(tmp_path / name, [f"{stamp(i)} m x={i} event" for i in range(n)])
    records = read_series(spark, str(tmp_path), [ll.FieldValue("x"), ll.EventDelta("event")])
    rows = records.collect()
    assert len(rows) == 2 * 991
    assert len({r.block for r in rows if r.source.endswith("big.log")}) > 10
    for r in rows:
        if r.spec_id == ll.FieldValue("x").spec_id:
            assert r["count"] == r.value + 1
        i = r["count"] - 1
        step = 1001 if i % 1000 else 1
        assert r.delta == (None if i == 0 else step)


def demo_logs(tmp_path, n=40):
    paths = []
    for k in range(3):
        lines = [f"{stamp(i * 10 + k)} pump x={i}.5ms" if i % 2 else f"{stamp(i * 10 + k)} foo valve shut"
                 for i in range(n)]
        paths.append(write(tmp_path / f"log{k}.log", lines))
    return paths


def test_cat_and_stat(spark, tmp_path):
    paths = demo_logs(tmp_path)
    spec = ll.FieldValue("x", guard="pump")
    values = [r.value for r in ll.cat(spark, paths[0], spec).orderBy("count").collect()]
    assert values == [i + 0.5 for i in range(1, 40, 2)]
    deltas = ll.cat(spark, paths[0], ll.EventDelta("valve shut")).collect()
    assert [r.value for r in deltas] == [20020.0] * 19
    result = ll.stat(spark, paths, spec, buckets=4)
    assert {(r["count"], r["min"], r["max"], r["mean"]) for r in result.summary.collect()} == {(20, 1.5, 39.5, 20.5)}
    assert {r.median for r in result.quantiles.collect()} == {20.5}
    assert result.histogram.count() == 12
    with pytest.raises(ValueError):
        ll.cat(spark, paths, ll.EventCount("x"))


def test_preview_of_a_file(spark, tmp_path):
    path = write(tmp_path / "a.log", [f"{stamp(1)} g x=1s", "g no time", f"{stamp(2)} other"])
    rows = ll.match_preview(spark, path, ll.FieldValue("x", guard="g")).collect()
    assert [(r.ts_ok, r.matched, r.value) for r in rows] == [(True, True, 1000.0), (False, False, None)]


def test_preview_opens_only_the_files_it_needs(spark, tmp_path):
    """The last files are broken archives: opening one is an error."""
    for k in range(4):
        write(tmp_path / f"{k}.log", [f"{stamp(i)} g x={10 * k + i}" for i in range(2)])
    for k in range(4, 9):
        (tmp_path / f"{k}.log.gz").write_bytes(b"no archive")
    spec = ll.FieldValue("x", guard="g")
    for count in range(1, 7):
        rows = ll.match_preview(spark, str(tmp_path), spec, count=count).collect()
        assert [r.value for r in rows] == [0.0, 1.0, 10.0, 11.0, 20.0, 21.0][:count]
    with pytest.raises(Exception, match="gzip|GZIP|header"):
        ll.match_preview(spark, str(tmp_path), spec, count=9).collect()


def test_preview_of_many_splits_is_in_line_order(small_splits, tmp_path):
    spark = small_splits
    path = write(tmp_path / "a.log", [f"{stamp(i)} {'g' if i % 50 == 7 else 'o'} x={i}" for i in range(2000)])
    for count in (1, 3, 30):
        rows = ll.match_preview(spark, path, ll.FieldValue("x", guard="g"), count=count).collect()
        assert [r.value for r in rows] == [7.0 + 50 * k for k in range(count)]
    assert ll.match_preview(spark, path, ll.FieldValue("x", guard="nowhere")).collect() == []


def test_graph(spark, tmp_path):
    paths = demo_logs(tmp_path)
    extra = write(tmp_path / "extra.log", [f"{stamp(5000)} foo valve shut"])
    panels = [
        ll.Panel([ll.Line(ll.FieldValue("x", guard="pump")), ll.Line(ll.EventCount("valve shut"), yaxis="y2")]),
        ll.Panel([ll.Line(ll.EventDelta("valve shut"), file_name=extra), ll.Line(ll.EventCount("nothing"), file_id=1)]),
    ]
    result = ll.graph(spark, panels, paths)
    assert [(r.start, r.end) for r in result.windows.collect()] == [
        (datetime(2025, 1, 1), datetime(2025, 1, 1, 1, 23, 20))
    ] * 2
    points = result.series.collect()
    assert len(points) == 3 * 20 * 2 + 1
    assert {p.title for p in points if p.panel_ix == 0 and p.axis == "y2"} == {
        f"count of valve shut (log{k}) | y2" for k in range(3)
    }
    assert [(p.line_ix, p.y) for p in points if p.panel_ix == 1] == [(0, 0.0)]
    counts = sorted(p.y for p in points if p.panel_ix == 0 and p.line_ix == 3)
    assert counts == [float(i) for i in range(1, 21)]
    assert {r.n for r in result.lines.where("panel_ix = 1").collect()} == {0, 1}

    zoomed = ll.graph(spark, panels, paths, window=ll.Fractions(0.0, 0.01), per_file_panels=True)
    assert {r.end for r in zoomed.windows.collect()} == {datetime(2025, 1, 1, 0, 0, 50)}
    assert {p.panel_ix for p in zoomed.series.collect()} == {0, 1, 2}
    assert max(p.ts for p in zoomed.series.collect()) <= datetime(2025, 1, 1, 0, 0, 50)

    write_series(result.series, str(tmp_path / "series"))
    assert spark.read.parquet(str(tmp_path / "series")).count() == len(points)


def test_graph_with_many_files_per_spec(spark, tmp_path, monkeypatch):
    paths = demo_logs(tmp_path)
    panels = [ll.Panel([ll.Line(ll.FieldValue("x"), file_id=0), ll.Line(ll.EventCount("x"))])]
    listed = ll.graph(spark, panels, paths).records
    monkeypatch.setattr("loglathe.plans.layout.LISTED", 0)
    joined = ll.graph(spark, panels, paths).records
    assert listed.exceptAll(joined).isEmpty() and joined.exceptAll(listed).isEmpty()
    assert {r.n for r in joined.groupBy("source", "spec_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {20}
    assert joined.select("source", "spec_id").distinct().count() == 3


def test_graph_of_directories_and_globs(spark, tmp_path):
    paths = demo_logs(tmp_path)
    panels = [ll.Panel([ll.Line(ll.FieldValue("x")), ll.Line(ll.EventCount("valve shut"), file_id=2)])]
    columns = ["panel_ix", "line_ix", "title", "axis", "ts", "y"]
    truth = ll.graph(spark, panels, paths, per_file_panels=True).series.select(*columns)
    for inputs in (str(tmp_path), f"{tmp_path}/log*.log", [paths[0], f"{tmp_path}/log[12].log"]):
        got = ll.graph(spark, panels, inputs, per_file_panels=True).series.select(*columns)
        assert got.exceptAll(truth).isEmpty() and truth.exceptAll(got).isEmpty()


def test_records_survive_storage(spark, tmp_path):
    paths = demo_logs(tmp_path)
    specs = [ll.FieldValue("x", guard="pump"), ll.EventDelta("valve shut")]
    records = read_series(spark, paths, specs)
    write_records(records, str(tmp_path / "store"))
    back = read_records(spark, str(tmp_path / "store")).select(records.columns)
    assert back.exceptAll(records).isEmpty() and records.exceptAll(back).isEmpty()
    write_records_csv(records, str(tmp_path / "csv"))
    csv = read_records_csv(spark, str(tmp_path / "csv"))
    wanted = records.select("source", "spec_id", "ts", "value", "count", F.coalesce("delta", F.lit(0.0)).alias("delta"))
    assert csv.exceptAll(wanted).isEmpty() and wanted.exceptAll(csv).isEmpty()


def test_single_csv_file(spark, tmp_path):
    path = write(tmp_path / "some.csv", [
        "date,time,value,count,delta", "2021-08-30,04:59:59.900,7.25,1,0", "2021-08-30,05:00:01.150,8,3,1250",
    ])
    rows = read_records_csv(spark, path).orderBy("count").collect()
    assert [r.ts for r in rows] == [datetime(2021, 8, 30, 4, 59, 59, 900000), datetime(2021, 8, 30, 5, 0, 1, 150000)]
    assert [(r.value, r.delta) for r in rows] == [(7.25, 0.0), (8.0, 1250.0)]


def test_refresh(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    field, count = ll.FieldValue("x"), ll.EventCount("x=")

    def present():
        rows = ll.current_records(spark, str(logs), store).groupBy("source", "spec_id").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("runs"), F.sum("value").alias("v"))
        return {(os.path.basename(r.source), r.spec_id): (r.n, r.runs, r.v) for r in rows.collect()}

    write(logs / "a.log", [f"{stamp(1)} x=1", f"{stamp(2)} x=2"])
    assert ll.refresh_records(spark, str(logs), [field], store) == 1
    assert ll.refresh_records(spark, str(logs), [field], store) == 0
    write(logs / "b.log", [f"{stamp(1)} x=5"])
    assert ll.refresh_records(spark, str(logs), [field, count], store) == 3
    assert present() == {
        ("a.log", field.spec_id): (2, 1, 3.0), ("a.log", count.spec_id): (2, 1, 2.0),
        ("b.log", field.spec_id): (1, 1, 5.0), ("b.log", count.spec_id): (1, 1, 1.0),
    }
    write(logs / "a.log", [f"{stamp(1)} x=100"])
    os.utime(logs / "a.log", (1_900_000_000, 1_900_000_000))
    assert ll.refresh_records(spark, str(logs), [field, count], store) == 2
    assert present()[("a.log", field.spec_id)] == (1, 1, 100.0)
    assert ll.refresh_records(spark, str(logs), [field], store, force=True) == 2
    assert present()[("b.log", field.spec_id)] == (1, 1, 5.0)


def test_names_with_glob_characters_are_names(spark, tmp_path):
    for name, n in (("app1.log", 1), ("app[1].log", 2), ("a*.log", 3)):
        (tmp_path / name).write_text("".join(f"[{1_700_000_000 + k}] x=1\n" for k in range(n)))
    spec, epoch = ll.FieldValue("x"), ll.TimeFormat("[%s]")
    store = str(tmp_path / "store")
    assert ll.refresh_records(spark, str(tmp_path / "*.log"), [spec], store, epoch) == 3
    current = ll.current_records(spark, str(tmp_path / "*.log"), store)
    assert sorted(r["count"] for r in current.groupBy("source").count().collect()) == [1, 2, 3]
    inputs = [str(tmp_path / name) for name in ("app1.log", "app[1].log")]
    panel = ll.Panel([ll.Line(spec, file_id=0), ll.Line(spec, file_id=1)])
    graph = ll.graph(spark, [panel], inputs, time_format=epoch, alignment="shared-full")
    assert sorted(r["count"] for r in graph.records.groupBy("source").count().collect()) == [1, 2]


def test_lines_are_scanned_once_whatever_columns_are_used(spark, tmp_path):
    (tmp_path / "a.log").write_text("[1700000000] x=1\n[1700000001] x=2\n")
    values = ll.cat(spark, str(tmp_path / "a.log"), ll.FieldValue("x"), time_format=ll.TimeFormat("[%s]"))
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert "a.log" not in plan and "FileScan text" not in plan
