import pytest

from pyspark.sql import functions as F

from loglathe import EventCount, EventDelta, EventValue, FieldValue, Line, Panel
from loglathe.plans import layout
from loglathe.plans.layout import bind, extractions, file_stem, numbered

ABC = ["A", "B", "C"]


@pytest.fixture
def bind_rows(spark):
    """Bound lines as rows in the order of their numbers."""

    def make(panels, inputs, per_file_panels=False, **options):
        return bind(spark, panels, inputs, per_file_panels, **options).orderBy("panel_ix", "line_ix").collect()

    return make


def line(name, **params):
    return Line(EventCount(name), **params)


@pytest.fixture
def files(bind_rows):
    def make(panels, inputs=ABC, **options):
        out = []
        for row in bind_rows(panels, inputs, **options):
            while len(out) <= row["panel_ix"]:
                out.append([])
            assert row["line_ix"] == len(out[row["panel_ix"]])
            out[row["panel_ix"]].append((row["pattern"], row["source"]))
        return out

    return make


def test_unbound_line_reads_every_input(files):
    assert files([Panel([line("x"), line("y")])]) == [
        [("x", "A"), ("x", "B"), ("x", "C"), ("y", "A"), ("y", "B"), ("y", "C")]
    ]


def test_bound_by_index_or_name(files):
    panel = Panel([line("x", file_id=1), line("y"), line("z", file_name="Z", file_id=9)])
    assert files([panel]) == [[("x", "B"), ("y", "A"), ("y", "B"), ("y", "C"), ("z", "Z")]]


@pytest.mark.parametrize("per_file", [False, True])
def test_unknown_index_is_an_error(bind_rows, per_file):
    with pytest.raises(ValueError, match="file_id 3"):
        bind_rows([Panel([line("x", file_id=3), line("y")])], ABC, per_file)


def test_per_file_panels_put_bound_lines_first(files):
    panels = [Panel([line("x"), line("y", file_id=1)]), Panel([line("z", file_id=2)]), Panel([line("w")])]
    assert files(panels, per_file_panels=True) == [
        [("y", "B"), ("x", "A")], [("y", "B"), ("x", "B")], [("y", "B"), ("x", "C")],
        [("z", "C")],
        [("w", "A")], [("w", "B")], [("w", "C")],
    ]


def test_no_inputs(files):
    assert files([Panel([line("x", file_name="F"), line("y")])], inputs=[]) == [[("x", "F")]]


@pytest.mark.parametrize(
    "specs, n",
    [
        ([FieldValue("d", guard="g")], 1),
        ([FieldValue("d"), EventCount("d"), EventDelta("d")], 1),
        ([EventCount("d"), EventDelta("d")], 1),
        ([FieldValue("d"), EventValue("d", yvalue=1.0)], 2),
        ([EventValue("d", yvalue=y) for y in (1.0, 2.0, 3.0)], 3),
        ([EventValue("d", yvalue=2.0), EventCount("d")], 1),
        ([FieldValue("d"), EventCount("d", guard="g")], 2),
        ([FieldValue("d"), EventCount("other")], 2),
        ([FieldValue("d"), FieldValue("d")], 1),
    ],
)
def test_shared_extractions(spark, specs, n):
    panels = [Panel([Line(spec) for spec in specs])]
    bound = bind(spark, panels, ["A", "B"])
    found, sources = extractions(panels, bound)
    assert len(found) == n and {row["spec_id"] for row in bound.collect()} == set(sources)
    assert all(names == ["A", "B"] for names in sources.values())


def test_sharing_needs_the_same_file(spark, bind_rows, monkeypatch):
    panels = [Panel([Line(FieldValue("d"), file_id=0), Line(EventCount("d"))])]
    rows = bind_rows(panels, ["A", "B"])
    bound = bind(spark, panels, ["A", "B"])
    field, count = FieldValue("d").spec_id, EventCount("d").spec_id
    assert [(r["kind"], r["source"], r["spec_id"]) for r in rows] == [
        ("field", "A", field), ("count", "A", field), ("count", "B", count)
    ]
    assert extractions(panels, bound)[1] == {field: ["A"], count: ["B"]}
    monkeypatch.setattr(layout, "LISTED", 1)
    specs, sources = extractions(panels, bound)
    assert sources is None and [s.spec_id for s in specs] == [field, count]
    hits = spark.createDataFrame([(f, s) for f in "AB" for s in (field, count)], "source string, spec_id string")
    assert {(r.source, r.spec_id) for r in layout.only_needed(hits, bound).collect()} == {("A", field), ("B", count)}
    rows = bind_rows(panels, ["A", "B"], share="regex")
    assert [r["spec_id"] for r in rows] == [field, count, count]


def test_a_first_event_value_is_shared_where_there_is_no_field(bind_rows):
    first, second = EventValue("d", yvalue=2.0), EventValue("d", yvalue=3.0)
    panels = [Panel([Line(EventDelta("d"))]), Panel([Line(second, file_id=1), Line(first)])]
    rows = [(r["source"], r["spec_id"]) for r in bind_rows(panels, ["A", "B"]) if r["kind"] == "delta"]
    assert rows == [("A", first.spec_id), ("B", second.spec_id)]


def brute_force(panels, inputs, per_file_panels):
    """(panel, line, input, source, pattern) by walking through panels and inputs."""
    out, panel_ix = [], 0
    for panel in panels:
        free = [line for line in panel.lines if not line.bound]
        repeated = per_file_panels and free
        for copy in range(len(inputs)) if repeated else [None]:
            lines = [x for x in panel.lines if x.bound] + free if repeated else panel.lines
            line_ix = 0
            for x in lines:
                if x.file_name is not None:
                    targets = [(None, x.file_name)]
                elif x.file_id is not None:
                    targets = [(x.file_id, inputs[x.file_id])]
                else:
                    targets = list(enumerate(inputs)) if copy is None else [(copy, inputs[copy])]
                for number, source in targets:
                    out.append((panel_ix, line_ix, number, source, x.spec.raw))
                    line_ix += 1
            panel_ix += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("per_file", [False, True])
@pytest.mark.parametrize("n", [0, 1, 4])
def test_numbers_equal_a_walk_through_the_panels(bind_rows, per_file, n):
    panels = [
        Panel([line("a"), line("b", file_name="X"), line("c")]), Panel([line("d", file_name="Y")]),
        Panel([line("e"), line("f"), line("g", file_name="X")]), Panel([]), Panel([line("h")]),
    ]
    if n:
        panels.append(Panel([line("i", file_id=n - 1), line("j"), line("k", file_id=0)]))
    inputs = [f"in{k}" for k in range(n)]
    rows = bind_rows(panels, inputs, per_file)
    got = sorted(((r["panel_ix"], r["line_ix"], r["input_ix"], r["source"], r["pattern"]) for r in rows), key=str)
    assert got == brute_force(panels, inputs, per_file)


def test_many_inputs_are_numbered_without_gaps(spark):
    names = spark.range(20_000).select(F.format_string("f%07d", (F.col("id") * 7919) % 20_000).alias("source")).repartition(9)
    inputs = numbered(names)
    assert inputs.where(F.col("source") != F.format_string("f%07d", "input_ix")).count() == 0 and inputs.count() == 20_000
    bound = bind(spark, [Panel([line("x"), line("y", file_id=19_999)]), Panel([line("z")])], inputs, per_file_panels=True)
    assert bound.count() == 3 * 20_000
    numbers = bound.agg(F.max("panel_ix"), F.count_distinct("panel_ix")).first()
    assert tuple(numbers) == (39_999, 40_000)
    assert bound.where("pattern = 'y' and source != 'f0019999'").count() == 0
    assert bound.where("panel_titles != concat('[', panel_source, ']')").count() == 0


def test_stems(spark):
    names = ["/a/b.log", "c.tar.gz", "/x/.hidden", "plain", "/y/z/", ".a.b", "/d.d/e"]
    from pathlib import PurePosixPath

    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", file_stem(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in rows} == {n: PurePosixPath(n).stem for n in names}


def test_titles(bind_rows):
    panels = [
        Panel([Line(FieldValue("x", guard="pump")), Line(EventValue("OPEN", guard="lid"), yaxis="y2"),
               Line(EventDelta("e", guard="g")), Line(EventCount("e")), Line(EventCount("e"), title="own")],
              title="top"),
        Panel([Line(EventCount("e"), file_id=0)]),
    ]
    one = bind_rows(panels, ["/logs/first.log"])
    assert [r["title"] for r in one[:5]] == [
        "value of pump x", "presence of lid OPEN | y2", "delta g e", "count of e", "own"
    ]
    two = bind_rows(panels, ["/logs/first.log", "b"], per_file_panels=True)
    assert [r["title"] for r in two[:2]] == ["value of pump x (first)", "presence of lid OPEN (first) | y2"]
    assert [r["panel_titles"] for r in two] == ["top\n[first]"] * 5 + ["top\n[b]"] * 5 + [""]


def test_bound_table(spark):
    table = bind(spark, [Panel([line("x"), line("y", file_id=0)])], ABC)
    assert table.count() == 4
    assert {r["input_ix"] for r in table.collect()} == {0, 1, 2}
