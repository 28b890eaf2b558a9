"""Numbers in log lines and their time units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> divisor or factor that turns a time into milliseconds. Both micro signs
# (U+00B5 and U+03BC) are accepted; any other unit leaves the number as it is.
SECONDS = ("s",)
MICROS = ("us", "\u00b5s", "\u03bcs", "microseconds")
NANOS = ("ns",)

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """Text to DOUBLE, NULL unless it is a plain decimal number.

    The regex keeps out what Spark's cast alone would take: ``1d``, ``1f``, blanks, hex floats.
    """
    return F.when(F.regexp_like(text, F.lit(_NUMBER)), text.try_cast("double"))


def to_millis(number: Column, unit: Column) -> Column:
    return (
        F.when(unit.isin(*SECONDS), number * 1000.0)
        .when(unit.isin(*MICROS), number / 1000.0)
        .when(unit.isin(*NANOS), number / 1000000.0)
        .otherwise(number)
    )
