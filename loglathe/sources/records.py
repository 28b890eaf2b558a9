"""The records table: layout, export, import and incremental refresh.

``records(source, spec_id, block, seq, ts, value, count, delta)``

Stored records have one more column, ``us``, the time as a number: Parquet readers skip row groups
and pages by the limits of whole numbers, but not by those of timestamps without a zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import date_text, epoch_micros, parse_date_time, time_text

EXPORT_COLUMNS = ("date", "time", "value", "count", "delta")
_CSV_SCHEMA = "date STRING, time STRING, value DOUBLE, count BIGINT, delta DOUBLE"


def export_columns(records: DataFrame, *keep: str) -> DataFrame:
    """Rows as exported: date and time as text, the first delta as 0."""
    return records.select(
        *keep,
        date_text(F.col("ts")).alias("date"),
        time_text(F.col("ts")).alias("time"),
        "value",
        "count",
        F.coalesce("delta", F.lit(0.0)).alias("delta"),
    )


@dataclass(frozen=True)
class Window:
    """Times from ``start`` to ``end``, both included unless ``open_end``."""

    start: datetime
    end: datetime
    open_end: bool = False


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def within(stored: DataFrame, window: Window) -> DataFrame:
    """Stored records in a window known before the job: the scan skips what lies outside."""
    us, end = F.col("us"), _micros(window.end)
    return stored.where((us >= _micros(window.start)) & (us < end if window.open_end else us <= end))


def sorted_by_time(records: DataFrame) -> DataFrame:
    """Records with ``us``, every task's rows in the order of series and time: no shuffle."""
    return records.withColumn("us", epoch_micros(F.col("ts"))).sortWithinPartitions("spec_id", "source", "us", "count")


def laid_out(records: DataFrame) -> DataFrame:
    """Records with ``us``, in ranges of (series, time): few files hold any stretch of a series,
    and a series with most of the rows is as many ranges as its share."""
    timed = records.withColumn("us", epoch_micros(F.col("ts")))
    order = ["spec_id", "source", "us", "count"]
    return timed.repartitionByRange(*order).sortWithinPartitions(*order)


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Store records as Parquet, one folder per spec, laid out so that windows read little."""
    laid_out(records).write.mode(mode).partitionBy("spec_id").parquet(path)


def read_records(spark: SparkSession, path: str, window: Window | None = None) -> DataFrame:
    rows = spark.read.schema(stored_schema()).parquet(path)
    return (rows if window is None else within(rows, window)).drop("us")


def stored_schema(*extra: str) -> str:
    """Schema of a stored records table, for readers that must not infer partition types."""
    fields = (
        "source STRING", "block BIGINT", "seq BIGINT", "ts TIMESTAMP_NTZ", "value DOUBLE",
        "count BIGINT", "delta DOUBLE", "us BIGINT", *extra, "spec_id STRING",
    )
    return ", ".join(fields)


def write_records_csv(
    records: DataFrame, path: str, mode: str = "errorifexists", file_rows: int = 5_000_000
) -> None:
    """Export as CSV with a header, one folder per (source, spec); source names are URL-encoded.

    The files of a folder, in the order of their names, hold the records in record order; none has
    more than ``file_rows`` rows.
    """
    rows = export_columns(records, "source", "spec_id").withColumn("source", F.url_encode("source"))
    order = ["source", "spec_id", "count"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = placed.write.mode(mode).option("maxRecordsPerFile", file_rows)
    writer.partitionBy("source", "spec_id").csv(path, header=True)


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read exported CSV (header-driven): a folder of :func:`write_records_csv` or a single file."""
    rows = spark.read.options(header=True, enforceSchema=False, mode="FAILFAST")
    frame = rows.schema(_CSV_SCHEMA).csv(path)
    partitioned = "source=" in path or _has_partitions(spark, path)
    if partitioned:
        frame = rows.schema(_CSV_SCHEMA + ", source STRING, spec_id STRING").csv(path)
        source, spec_id = F.url_decode("source"), F.col("spec_id")
    else:
        source, spec_id = F.col("_metadata.file_path"), F.lit("")
    return frame.select(
        source.alias("source"),
        spec_id.alias("spec_id"),
        parse_date_time(F.col("date"), F.col("time")).alias("ts"),
        "value",
        "count",
        "delta",
    )


def _has_partitions(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(
        status.isDirectory() and status.getPath().getName().startswith("source=")
        for status in fs.listStatus(folder)
    )


def stale_series(versions: DataFrame, spec_ids: list[str], done: DataFrame | None) -> DataFrame:
    """``(source, mtime, spec_id)`` not extracted yet: current files x specs without a stored key.

    A file counts as unchanged as long as its modification time in seconds is the same.
    """
    ids = F.explode(F.array(*[F.lit(spec_id) for spec_id in spec_ids])).alias("spec_id")
    current = versions.select("source", "mtime", ids)
    if done is None:
        return current
    return current.join(done, ["source", "mtime", "spec_id"], "left_anti")
