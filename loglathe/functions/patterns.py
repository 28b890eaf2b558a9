"""User patterns: the field shorthand, checks, and the literals that spare regex work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import PatternError, escape, parse

MOST_GROUPS = 2
# Fixed value: what follows the name of a field, a number and perhaps a unit.
_FIELD_NUMBER = r"=([\d\.]+)(\w+)?"


def field_regex(field: str) -> str:
    """The regular expression of a field: itself if it has 1-2 capture groups, else ``name=number``.

    Text that is no valid pattern, or has no capture group, is taken as a field name.
    """
    try:
        groups = parse(field).groups
    except PatternError:
        groups = 0
    if groups > MOST_GROUPS:
        raise ValueError(f"a field takes a number and a unit from a line, but {field!r} has {groups} groups")
    return field if groups else rf"\b{escape(field)}{_FIELD_NUMBER}"


def group_count(regex: str) -> int:
    return parse(regex).groups


def java_regex(regex: str) -> str:
    """The pattern for Spark's regex functions."""
    return parse(regex).java


def is_plain_text(regex: str) -> bool:
    return not set(regex) & set("\\.^$|?*+()[]{}")


def required_text(regex: str) -> str:
    """A literal every match contains (``''`` if none is evident).

    Testing for it first is a plain byte search; most lines never reach the regex engine.
    """
    return parse(regex).required


def first_group_optional(regex: str) -> bool:
    """True if a match may leave group 1 out (it then counts as the number 0)."""
    return parse(regex).first_group_optional


def first_group_tells_match(regex: str) -> bool:
    """True if every match has non-empty text in group 1: capturing it is also the match test."""
    return parse(regex).first_group_tells_match


def found(text: Column, regex: str) -> Column:
    """Does the pattern match anywhere in the text?"""
    if is_plain_text(regex):
        return F.contains(text, F.lit(regex))
    hit = F.regexp_like(text, F.lit(java_regex(regex)))
    literal = required_text(regex)
    return F.contains(text, F.lit(literal)) & hit if literal else hit


def check_patterns(spark, regexes) -> None:
    """Let the JVM compile every pattern once, before a long job starts, and count its groups.

    A pattern that the JVM refuses (an unknown script, say) or counts otherwise is an error.
    """
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    for regex in dict.fromkeys(regexes):
        parsed = parse(regex)
        try:
            groups = compiler.compile(parsed.java).matcher("").groupCount()
        except Exception as refusal:
            raise PatternError(regex, 0, f"the JVM refuses the pattern ({_reason(refusal)})") from refusal
        if groups != parsed.groups:
            raise PatternError(regex, 0, f"{parsed.groups} groups are {groups} for the JVM")


def _reason(refusal: Exception) -> str:
    text = str(getattr(refusal, "java_exception", refusal))
    return text.splitlines()[0].rpartition("Exception: ")[2]
