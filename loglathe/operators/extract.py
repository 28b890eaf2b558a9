"""From lines to hits: guard, timestamp, pattern, value; audit and preview of the same steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, patterns
from ..functions.timestamps import TimeFormat, epoch_micros, micros_to_ts

# Guard-passing lines of one source without a valid timestamp that a job tolerates per spec.
TOLERATED_BAD_TIMESTAMPS = 3

BadTimestamps = ("fail", "ignore")
# More specs than this are met as a table: a plan with all of them spelled out outgrows what the
# JVM compiles as one method.
UNROLLED_SPECS = 24


def guarded(spec, line: Column) -> Column | None:
    return None if spec.guard is None else F.contains(line, F.lit(spec.guard))


def with_timestamp(lines: DataFrame, time_format: TimeFormat) -> DataFrame:
    """Add ``us`` (epoch microseconds, NULL for a bad timestamp) and ``rem`` (the rest of the line)."""
    keep = lines.columns
    line, prefix = F.col("line"), F.col("prefix")
    cut = lines.select(*keep, time_format.prefix(line).alias("prefix"))
    split = cut.select(*keep, "prefix", time_format.fields(prefix).alias("fields"))
    ts = time_format.timestamp(prefix, F.col("fields"))
    return split.select(
        *keep, epoch_micros(ts).alias("us"), time_format.remainder(line, prefix).alias("rem")
    )


def captured_text(spec, rem: Column) -> tuple[Column, Column]:
    """The number text and the unit text of a field spec (for a matching remainder)."""
    regex = patterns.java_regex(spec.regex)
    number = F.regexp_extract(rem, regex, 1)
    if patterns.first_group_optional(spec.regex):
        number = F.when(number == "", F.lit("0")).otherwise(number)
    if patterns.group_count(spec.regex) < 2:
        return number, F.lit("")
    return number, F.regexp_extract(rem, regex, 2)


# What the value of a match is made of: a constant, or captured texts.
_READING = (("constant", "double"), ("number", "string"), ("unit", "string"))


def reading_of(spec, rem: Column, number: Column | None = None) -> list[Column]:
    """The reading of a matching remainder; ``number`` if group 1 has been captured already."""
    if spec.constant is not None:
        parts = F.lit(spec.constant), F.lit(None), F.lit(None)
    else:
        captured, unit = captured_text(spec, rem)
        parts = F.lit(None), captured if number is None else number, unit
    return [part.cast(kind).alias(name) for part, (name, kind) in zip(parts, _READING)]


def value_of(constant="constant", number="number", unit="unit") -> Column:
    """The measured number of a reading; NULL if the captured text is no number."""
    parsed = numbers.parse_number(F.col(number))
    return F.coalesce(F.col(constant), numbers.to_millis(parsed, F.col(unit)))


def _reading(lines: DataFrame) -> DataFrame:
    """Key columns made non-nullable: joins on them then need no null filters."""
    return lines.select(
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("block", F.lit(0).cast("bigint")).alias("block"),
        F.coalesce("seq", F.lit(0).cast("bigint")).alias("seq"),
        "line",
    )


def hits(
    lines: DataFrame,
    specs: Sequence,
    time_format: TimeFormat,
    bad_timestamps: str = "fail",
    sources: Mapping[str, Sequence[str] | None] | None = None,
    unrolled: int = UNROLLED_SPECS,
) -> DataFrame:
    """One row per (line, spec) match: ``source, spec_id, block, seq, us, value``.

    One pass over the lines serves all specs; with more than ``unrolled`` of them, a line meets them
    as a table (see :func:`_outcomes_by_table`). ``value`` is NULL when the captured text is no
    number: such a hit still counts as a match. With ``bad_timestamps='fail'`` the guard-passing
    lines without a timestamp stay in the result with ``us`` NULL, for whoever reads it to count
    them. With ``'ignore'`` they are dropped here. ``sources`` limits a spec to some sources.
    """
    if bad_timestamps not in BadTimestamps:
        raise ValueError(f"bad_timestamps must be one of {BadTimestamps}")
    by_id = {spec.spec_id: spec for spec in specs}
    patterns.check_patterns(lines.sparkSession, [s.regex for s in by_id.values()])
    keep_bad = bad_timestamps == "fail"
    if len(by_id) > unrolled:
        return _outcomes_by_table(lines, list(by_id.values()), time_format, keep_bad, sources or {})
    line, rem, us = F.col("line"), F.col("rem"), F.col("us")

    def selected(spec) -> Column | None:
        """Tests on the raw line alone, cheap ones before any regex."""
        tests = []
        names = (sources or {}).get(spec.spec_id)
        if names is not None:
            tests.append(F.col("source").isin(list(names)))
        if spec.guard is not None:
            tests.append(guarded(spec, line))
        literal = patterns.required_text(spec.regex)
        if not keep_bad and literal and literal != spec.guard:
            tests.append(F.contains(line, F.lit(literal)))
        return reduce(Column.__and__, tests) if tests else None

    specs = list(by_id.values())
    chosen = [selected(spec) for spec in specs]
    reading = _reading(lines)
    if all(test is not None for test in chosen):
        reading = reading.where(reduce(Column.__or__, chosen))
    else:
        reading = reading.where(line.isNotNull())
    if len(specs) == 1:
        chosen = [None]
    chosen = [F.lit(True) if test is None else test for test in chosen]
    stamped = with_timestamp(reading, time_format)

    # Where capturing group 1 already tells whether the pattern matches, one regex pass does both.
    captures, outcomes = [], []
    for i, (spec, test) in enumerate(zip(specs, chosen)):
        good, spec_id = test & us.isNotNull(), F.lit(spec.spec_id).alias("spec_id")
        if spec.constant is None and patterns.first_group_tells_match(spec.regex):
            literal = patterns.required_text(spec.regex)
            if keep_bad and literal:
                good = good & F.contains(rem, F.lit(literal))
            number = F.regexp_extract(rem, patterns.java_regex(spec.regex), 1)
            captures.append(F.when(good, number).alias(f"number_{i}"))
            good, number = F.col(f"number_{i}") != "", F.col(f"number_{i}")
        else:
            good, number = good & patterns.found(rem, spec.regex), None
        outcome = F.when(good, F.struct(spec_id, *reading_of(spec, rem, number)))
        if keep_bad:
            nothing = [F.lit(None).cast(t).alias(n) for n, t in _READING]
            outcome = outcome.when(test & us.isNull(), F.struct(spec_id, *nothing))
        outcomes.append(outcome)

    keys = ["source", "block", "seq"]
    exploded = stamped.select("*", *captures).select(
        *keys, "us", F.explode(F.array_compact(F.array(*outcomes))).alias("hit")
    )
    matches = exploded.select(
        *keys,
        F.coalesce("hit.spec_id", F.lit("")).alias("spec_id"),
        "us",
        *[f"hit.{name}" for name, _ in _READING],
    )
    return matches.select("source", "spec_id", "block", "seq", "us", value_of().alias("value"))


def _outcomes_by_table(
    lines: DataFrame, specs: list, time_format: TimeFormat, keep_bad: bool, sources: Mapping[str, Sequence[str] | None]
) -> DataFrame:
    """:func:`hits` for many specs: the plan is of one size, however many there are.

    The specs are an array of constants. A line keeps those whose guard and required text it has and
    is copied for these alone, so that the dear part, regex and number, grows with the candidates
    and not with the specs. Lines without a candidate never have their timestamp parsed.
    """
    entries = []
    for spec in specs:
        literal, names = patterns.required_text(spec.regex), sources.get(spec.spec_id)
        field = spec.constant is None
        fields = {
            "spec_id": F.lit(spec.spec_id),
            "guard": F.lit(spec.guard or ""),
            "literal": F.lit("" if literal == spec.guard else literal),
            "sources": F.lit(None).cast("array<string>") if names is None else F.array(*map(F.lit, names)).cast("array<string>"),
            "pattern": F.lit(patterns.java_regex(spec.regex)),
            "groups": F.lit(min(patterns.group_count(spec.regex), 2) if field else 0),
            "optional": F.lit(field and patterns.first_group_optional(spec.regex)),
            "constant": F.lit(spec.constant).cast("double"),
        }
        entries.append(F.struct(*[value.alias(name) for name, value in fields.items()]))
    line, rem, us, spec = F.col("line"), F.col("rem"), F.col("us"), F.col("spec")

    def candidate(entry: Column) -> Column:
        here = entry["sources"].isNull() | F.array_contains(entry["sources"], F.col("source"))
        test = here & F.contains(line, entry["guard"])
        return test if keep_bad else test & F.contains(line, entry["literal"])

    met = _reading(lines).where(line.isNotNull()).select("*", F.filter(F.array(*entries), candidate).alias("specs"))
    stamped = with_timestamp(met.where(F.size("specs") > 0), time_format)
    if keep_bad:
        fits = F.filter("specs", lambda entry: us.isNull() | F.contains(rem, entry["literal"]))
    else:
        stamped, fits = stamped.where(us.isNotNull()), F.col("specs")
    keys = ["source", "block", "seq", "us", "rem"]
    each = stamped.select(*keys, F.explode(fits).alias("spec"))
    taken = each.where(us.isNull() | F.regexp_like(rem, spec["pattern"]))

    def captured(group: int) -> Column:
        text = F.call_function("regexp_extract", rem, spec["pattern"], F.lit(group))
        return F.when(us.isNotNull() & (spec["groups"] >= group), text)

    number = captured(1)
    read = taken.select(
        *keys[:-1],
        spec["spec_id"].alias("spec_id"),
        F.when(us.isNotNull(), spec["constant"]).alias("constant"),
        F.when(spec["optional"] & (number == ""), F.lit("0")).otherwise(number).alias("number"),
        F.coalesce(captured(2), F.lit("")).alias("unit"),
    )
    return read.select("source", F.coalesce("spec_id", F.lit("")).alias("spec_id"), "block", "seq", "us", value_of().alias("value"))


def audit(lines: DataFrame, specs: Sequence, time_format: TimeFormat) -> DataFrame:
    """Per (source, spec): lines, guard hits, bad timestamps, pattern misses, matches, records.

    One aggregation with partial sums: each line contributes to a few counters, not to rows.
    """
    line, rem, us = F.col("line"), F.col("rem"), F.col("us")
    by_id = {spec.spec_id: spec for spec in specs}
    patterns.check_patterns(lines.sparkSession, [s.regex for s in by_id.values()])
    stamped = with_timestamp(_reading(lines).where(line.isNotNull()), time_format)
    ids = range(len(by_id))
    steps = []
    for i, spec in enumerate(by_id.values()):
        guard = guarded(spec, line)
        guard = F.lit(True) if guard is None else guard
        steps.append(guard.alias(f"guard_{i}"))
        hit = guard & us.isNotNull() & patterns.found(rem, spec.regex)
        steps.append(F.when(hit, F.struct(*reading_of(spec, rem))).alias(f"hit_{i}"))
    stepped = stamped.select("source", us.isNull().alias("bad"), *steps)
    counters = [F.count(F.lit(1)).alias("lines")]
    for i in ids:
        guard, hit = F.col(f"guard_{i}"), F.col(f"hit_{i}")
        value = value_of(*[f"hit_{i}.{part}" for part in ("constant", "number", "unit")])
        counters += [
            F.count_if(guard).alias(f"guard_{i}"),
            F.count_if(guard & F.col("bad")).alias(f"bad_{i}"),
            F.count_if(guard & ~F.col("bad") & hit.isNull()).alias(f"miss_{i}"),
            F.count(hit).alias(f"match_{i}"),
            F.count(value).alias(f"rec_{i}"),
        ]
    counted = stepped.groupBy("source").agg(*counters)
    per_spec = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(spec_id).alias("spec_id"),
                    F.col(f"guard_{i}").alias("guard_hits"),
                    F.col(f"bad_{i}").alias("bad_timestamps"),
                    F.col(f"miss_{i}").alias("pattern_misses"),
                    F.col(f"match_{i}").alias("matches"),
                    F.col(f"rec_{i}").alias("records"),
                )
                for i, spec_id in enumerate(by_id)
            ]
        )
    )
    return counted.select("source", "lines", per_spec)


def bad_timestamp_counts(lines: DataFrame, specs: Sequence, time_format: TimeFormat) -> DataFrame:
    """Per (source, spec): guard-passing lines without a valid timestamp, and the verdict.

    Only guards and timestamps are looked at; each task adds up its lines.
    """
    by_id = {spec.spec_id: spec for spec in specs}
    line, bad = F.col("line"), F.col("us").isNull()
    stamped = with_timestamp(_reading(lines).where(line.isNotNull()), time_format)
    guards = [guarded(spec, line) for spec in by_id.values()]
    counters = [F.count_if(bad if guard is None else guard & bad) for guard in guards]
    counted = stamped.groupBy("source").agg(*[c.alias(f"bad_{i}") for i, c in enumerate(counters)])
    per_spec = F.inline(
        F.array(
            *[
                F.struct(F.lit(spec_id).alias("spec_id"), F.col(f"bad_{i}").alias("bad_timestamps"))
                for i, spec_id in enumerate(by_id)
            ]
        )
    )
    return counted.select("source", per_spec).withColumn(
        "aborts", F.col("bad_timestamps") > TOLERATED_BAD_TIMESTAMPS
    )


def guarded_lines(lines: DataFrame, spec) -> DataFrame:
    """The lines that a preview of the spec looks at."""
    patterns.check_patterns(lines.sparkSession, [spec.regex])
    guard = guarded(spec, F.col("line"))
    return _reading(lines).where(F.col("line").isNotNull() if guard is None else guard)


def preview(lines: DataFrame, spec, time_format: TimeFormat, count: int = 5) -> DataFrame:
    """How the first ``count`` guard-passing lines fare, step by step.

    Lines that fail a step use up the limit too. A top-n by line order, computed per partition
    and merged; for files see :func:`plans.logs.match_preview`, which reads only what it needs.
    """
    first = guarded_lines(lines, spec).orderBy("source", "block", "seq").limit(count)
    return stepwise(first, spec, time_format)


def stepwise(lines: DataFrame, spec, time_format: TimeFormat) -> DataFrame:
    """Guard-passing lines with the outcome of every further step."""
    us, rem = F.col("us"), F.col("rem")
    place = ["source", "block", "seq", "line", "us"]
    matched = with_timestamp(lines, time_format).select(
        *place,
        F.when(us.isNotNull(), rem).alias("remainder"),
        (us.isNotNull() & patterns.found(rem, spec.regex)).alias("matched"),
        *reading_of(spec, rem),
    )
    hit = F.col("matched")
    return matched.select(
        *place[:-1],
        us.isNotNull().alias("ts_ok"),
        micros_to_ts(us).alias("ts"),
        "remainder",
        "matched",
        F.when(hit, F.col("number")).alias("value_text"),
        F.when(hit, F.col("unit")).alias("unit"),
        F.when(hit, value_of()).alias("value"),
    )
