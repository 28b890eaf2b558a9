"""Binding the lines of panels to input files.

The configuration (panels and their lines) is small and comes from the driver as a local table; the
inputs are a table ``(input_ix, source)`` of any length, numbered without gaps. Which row gets which
number follows from the configuration and the number of inputs alone, so binding is one join of the
two and needs no ordering of the result. It gives

``bound(panel_ix, line_ix, input_ix, source, kind, guard, pattern, own_id, spec_id, measure, title,
axis, panel_titles, panel_source, range_mode)``

which is joined to data-sized tables (records, ranges, counts) on ``(source, spec_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..sources.staging import stage, tiny_table
from ..spec import COUNT, DELTA, FIELD, VALUE, Panel

SHARING = ("raw", "regex")
# panel_titles holds the lines of a panel's heading, separated by this.
HEADING_SEPARATOR = "\n"
# Extractions limited to more files than this are filtered by a join instead of lists in the plan.
LISTED = 1000

_COLUMNS = (
    "panel_ix", "line_ix", "input_ix", "source", "kind", "guard", "pattern", "own_id", "spec_id", "measure", "title",
    "axis", "panel_titles", "panel_source", "range_mode",
)
# A line's numbers are base + each * (number of inputs) [+ the input's own number].
_LINES = {
    "panel_base": "bigint", "panel_each": "bigint", "panel_copies": "boolean", "line_base": "bigint",
    "line_each": "bigint", "free": "boolean", "file_id": "int", "file_name": "string", "kind": "string",
    "guard": "string", "pattern": "string", "own_id": "string", "measure": "string", "line_title": "string",
    "axis": "string", "panel_title": "string", "range_mode": "string",
}


def numbered(sources: DataFrame) -> DataFrame:
    """``(input_ix, source)`` for a table of names, numbered in the order of the names.

    The names are dealt out in ranges; each range counts its own, and the ranges' counts, one number
    per task, say where each one begins.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = sources.select("source").repartitionByRange("source").sortWithinPartitions("source")
    ranges = stage(placed.select("source", F.spark_partition_id().alias("range"), row.alias("row")), "inputs")
    sizes = {r["range"]: r["count"] for r in ranges.groupBy("range").count().collect()}
    starts = [sum(n for other, n in sizes.items() if other < k) for k in sizes]
    begin = tiny_table(sources.sparkSession, {"range": list(sizes), "begin": starts}, "range int, begin bigint")
    return ranges.join(F.broadcast(begin), "range").select((F.col("begin") + F.col("row")).cast("int").alias("input_ix"), "source")


def input_table(spark: SparkSession, inputs: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(inputs, DataFrame):
        return inputs.select(F.col("input_ix").cast("int").alias("input_ix"), "source")
    return tiny_table(spark, {"input_ix": list(range(len(inputs))), "source": list(inputs)}, "input_ix int, source string")


def _lines(panels: Sequence[Panel], per_file_panels: bool, n_inputs: int) -> list[dict]:
    """The configuration, a row per line of a panel, with what its numbers are made of."""
    rows = []
    panel_base = panel_each = 0
    for panel in panels:
        free = [line for line in panel.lines if not line.bound]
        copies = per_file_panels and bool(free)
        ordered = sorted(panel.lines, key=lambda line: not line.bound) if copies else panel.lines
        line_base = line_each = 0
        for line in ordered:
            if line.file_name is None and line.file_id is not None and not 0 <= line.file_id < n_inputs:
                raise ValueError(f"file_id {line.file_id} is not one of {n_inputs} inputs")
            spec = line.spec
            rows.append(
                {
                    "panel_base": panel_base, "panel_each": panel_each, "panel_copies": copies, "line_base": line_base,
                    "line_each": line_each, "free": not line.bound,
                    "file_id": line.file_id if line.file_name is None else None, "file_name": line.file_name,
                    "kind": spec.kind, "guard": spec.guard, "pattern": spec.raw, "own_id": spec.spec_id,
                    "measure": spec.measure, "line_title": spec.title if line.title is None else line.title,
                    "axis": line.yaxis, "panel_title": panel.title, "range_mode": panel.range_mode,
                }
            )
            if line.bound or copies:
                line_base += 1
            else:
                line_each += 1
        panel_each += copies
        panel_base += not copies
    return rows


def bind(
    spark: SparkSession,
    panels: Sequence[Panel],
    inputs: Sequence[str] | DataFrame,
    per_file_panels: bool = False,
    share: str = "raw",
) -> DataFrame:
    """Bind every line to its files.

    A line with a file name reads that file, also if it is no input; one with a file index reads
    that input; any other reads every input. With ``per_file_panels`` a panel with an unbound line
    is repeated once per input, its bound lines first.

    ``spec_id`` is the extraction whose records a line reads. With ``share='raw'`` count and delta
    lines read those of a field line with the same guard, pattern text and file, else of the first
    event-value line, else their own (and so count what that line matches). With
    ``share='regex'`` only identical extractions are shared.

    ``inputs`` is read several times; a table of many should be staged (see :func:`numbered`).
    """
    if share not in SHARING:
        raise ValueError(f"share must be one of {SHARING}")
    inputs = input_table(spark, inputs)
    n = inputs.count()
    config = _lines(panels, per_file_panels, n)
    columns = {name: [row[name] for row in config] for name in _LINES}
    lines = tiny_table(spark, columns, ", ".join(f"{name} {kind}" for name, kind in _LINES.items()))

    # Free lines, and all lines of a copied panel, have a row for every input; others have one.
    many, own = F.col("free") | F.col("panel_copies"), inputs.withColumnsRenamed({"input_ix": "i", "source": "s"})
    each = own.join(F.broadcast(lines.where(many)), F.lit(True))
    one = lines.where(~many).select("*", F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("s"))
    placed = each.unionByName(one)
    named = inputs.withColumnsRenamed({"input_ix": "file_id", "source": "file_source"})
    if any(row["file_id"] is not None for row in config):
        wanted = [row["file_id"] for row in config if row["file_id"] is not None]
        named = F.broadcast(named.where(F.col("file_id").isin(wanted)))  # a row per bound line at most
        placed = placed.join(named, "file_id", "left")
    else:
        placed = placed.withColumn("file_source", F.lit(None).cast("string"))

    free, copies = F.col("free"), F.col("panel_copies")
    source = F.when(free, F.col("s")).otherwise(F.coalesce("file_name", "file_source"))
    copied = F.when(copies, F.col("s"))
    panel_ix = F.col("panel_base") + F.col("panel_each") * n + F.when(copies, F.col("i")).otherwise(0)
    line_ix = F.col("line_base") + F.col("line_each") * n + F.when(free & ~copies, F.col("i")).otherwise(0)
    title = F.col("line_title")
    if n > 1:
        title = F.concat(title, F.lit(" ("), file_stem(source), F.lit(")"))
    heading = F.concat_ws(HEADING_SEPARATOR, "panel_title", F.concat(F.lit("["), file_stem(copied), F.lit("]")))
    bound = placed.select(
        panel_ix.cast("int").alias("panel_ix"), line_ix.cast("int").alias("line_ix"),
        F.when(free, F.col("i")).otherwise(F.col("file_id")).alias("input_ix"), source.alias("source"),
        "kind", "guard", "pattern", "own_id", F.col("own_id").alias("spec_id"), "measure",
        F.when(F.col("axis") == "y2", F.concat(title, F.lit(" | y2"))).otherwise(title).alias("title"), "axis",
        heading.alias("panel_titles"), copied.alias("panel_source"), "range_mode",
    )
    kinds = {row["kind"] for row in config}
    if share == "raw" and kinds & {COUNT, DELTA} and kinds & {FIELD, VALUE}:
        bound = _shared(bound)
    return bound.select(*_COLUMNS)


def _shared(bound: DataFrame) -> DataFrame:
    """Count and delta lines read the records of the first field (else event-value) line with their
    guard, pattern text and file."""
    keys = ["guard", "pattern", "source"]
    first = F.struct((F.col("kind") != FIELD).alias("later"), "panel_ix", "line_ix")
    known = bound.where(F.col("kind").isin(FIELD, VALUE)).groupBy(*keys).agg(F.min_by("own_id", first).alias("shared_id"))
    known = known.withColumnsRenamed({k: f"known_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]
    joined = bound.join(known, F.col("kind").isin(COUNT, DELTA) & same[0] & same[1] & same[2], "left")
    return joined.withColumn("spec_id", F.coalesce("shared_id", "own_id"))


def extractions(panels: Sequence[Panel], bound: DataFrame) -> tuple[list, dict[str, list[str]] | None]:
    """The specs to extract for bound lines and, per spec id, the files it is needed on (None if
    these are too many to list: see :func:`only_needed`)."""
    by_id = {line.spec.spec_id: line.spec for panel in panels for line in panel.lines}
    needed = bound.select("spec_id", "source").distinct()
    listed = needed.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        found = {r.spec_id for r in listed}
        sources = {i: sorted(r.source for r in listed if r.spec_id == i) for i in by_id if i in found}
    else:
        found, sources = {r.spec_id for r in needed.select("spec_id").distinct().collect()}, None
    return [by_id[i] for i in by_id if i in found], sources


def only_needed(hits: DataFrame, bound: DataFrame) -> DataFrame:
    """Hits of (file, spec) pairs that a bound line reads."""
    return attach(hits, bound.select("source", "spec_id").distinct(), ["source", "spec_id"], "left_semi")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension; a leading dot is part of the name."""
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
