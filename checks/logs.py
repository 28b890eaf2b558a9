"""The test tables seen as logs: events rendered as log lines of four sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.functions.timestamps import millis_text
from loglathe.sources.lines import ROWS_PER_BLOCK, lines_from_table

INPUTS = [f"user_{i}.log" for i in range(4)]
UNITS = {"error": "s", "click": "us", "purchase": "ns", "signup": "ms"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def value_text() -> Column:
    return F.col("value").cast("decimal(18,2)").cast("string")


def payload(number: Column | None = None) -> Column:
    kind = F.col("event_type")
    unit = F.lit("")
    for event_type, text in UNITS.items():
        unit = F.when(kind == event_type, text).otherwise(unit)
    number = value_text() if number is None else number
    user = F.col("user_id").cast("string")
    return F.concat(kind, F.lit("_module user="), user, F.lit(" value="), number, unit)


def default_stamp() -> Column:
    return millis_text(F.col("ts"))


def source() -> Column:
    return F.concat(F.lit("user_"), (F.col("user_id") % 4).cast("string"), F.lit(".log"))


def event_lines(
    spark: SparkSession,
    folder: str,
    stamp: Column | None = None,
    number: Column | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``<timestamp> <type>_module user=<id> value=<number><unit>``, ordered by event_id."""
    stamp = default_stamp() if stamp is None else stamp
    line = F.concat(stamp, F.lit(" "), payload(number))
    # The generator keeps filters on the line above it, so that each line is rendered once.
    rendered = table(spark, folder, "events").select(
        "event_id", source().alias("source"), F.explode(F.array(line)).alias("line")
    )
    return lines_from_table(rendered, "line", "event_id", "source", rows_per_block)


def event_id() -> Column:
    """The order key back from (block, seq)."""
    return F.col("block") * ROWS_PER_BLOCK + F.col("seq")


def labelled(frame: DataFrame, specs: dict[str, object]) -> DataFrame:
    """Replace the spec_id column by the short names used in the SQL."""
    name = F.lit(None).cast("string")
    for label, spec in specs.items():
        name = F.when(F.col("spec_id") == spec.spec_id, F.lit(label)).otherwise(name)
    return frame.withColumn("spec", name).drop("spec_id")
