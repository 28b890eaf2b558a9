"""Log lines: ``lines(source STRING, block BIGINT, seq BIGINT, line STRING)``.

``(block, seq)`` is the line order inside a source. A block is a bounded piece of a source (an
input split, or a range of an order key); order-dependent operators work block by block and never
need a whole source in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1 << 16
_POSITION_BITS = 40
# monotonically_increasing_id() has the row number within the task in its lower bits.
_ROW_BITS = 33


def source_name(spark: SparkSession, path: str) -> str:
    """The ``source`` value that lines of this file carry: the fully qualified path."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(fs.makeQualified(hadoop_path).toString())


def literal_path(path: str) -> str:
    """A pattern that matches only the file of this name."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _decoded_path() -> Column:
    """``_metadata.file_path`` is URL-encoded; decode ``%xx`` (if there is any) but keep ``+``."""
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(path, F.lit("%")), decoded).otherwise(path)


def read_log_files(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Lines of text files, directories or globs.

    A line ends with ``\\n``; one trailing ``\\r`` is dropped. Uncompressed files are split at the
    usual split size; a gzip file is read by a single task. A block is a run of lines of one split:
    its number is the split's byte offset plus the row number in the task div 65536, which stays
    below the offset of the file's next split because a task never has more rows than such a split
    has bytes. Undecodable bytes are replaced and reading goes on. ``options`` go to the reader
    (``recursiveFileLookup``, ``pathGlobFilter``, ``modifiedAfter``, ...).
    """
    raw = spark.read.options(**options).text([paths] if isinstance(paths, str) else list(paths),
                                             lineSep="\n")
    others = [c for c in raw.columns if c != "value"]
    placed = raw.select(
        _decoded_path().alias("source"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        _without_cr(F.col("value")).alias("line"),
        *others,
    )
    row = F.col("seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    block = F.col("start") + F.call_function("div", row, F.lit(ROWS_PER_BLOCK))
    return placed.select("source", block.alias("block"), "seq", "line", *others)


def log_file_versions(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """``(source, mtime)`` of the files; lists the files and reads none of their content."""
    names = spark.read.format("binaryFile").options(**options).load(
        [paths] if isinstance(paths, str) else list(paths)
    )
    return names.select(
        F.regexp_replace("path", r"^file:/+", "file:/").alias("source"),
        F.unix_seconds("modificationTime").alias("mtime"),
    )


def lines_from_table(
    table: DataFrame,
    line: Column | str,
    order: Column | str,
    source: Column | str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Lines held in a column, one per row; ``order`` is an integer key, unique in a source."""
    order, line, source = _col(order), _col(line), _col(source)
    block, offset = _block_of(order, rows_per_block)
    return table.select(
        F.coalesce(source.cast("string"), F.lit("")).alias("source"),
        block.alias("block"),
        offset.alias("seq"),
        line.alias("line"),
    )


def lines_from_text(
    table: DataFrame,
    text: Column | str,
    order: Column | str,
    source: Column | str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Lines of multi-line texts, in the order (``order``, position in the text).

    Each text is read like a file: the newline at its end starts no further line.
    """
    order, text, source = _col(order), _col(text), _col(source)
    block, offset = _block_of(order, rows_per_block)
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.left(text, F.length(text) - 1)).otherwise(text)
    lines = F.split(body, "\n", -1)
    exploded = table.where(text != "").select(
        F.coalesce(source.cast("string"), F.lit("")).alias("source"),
        block.alias("block"),
        offset.alias("offset"),
        F.posexplode(lines).alias("position", "raw"),
    )
    return exploded.select(
        "source",
        "block",
        F.shiftleft("offset", _POSITION_BITS).bitwiseOR(F.col("position").cast("bigint")).alias("seq"),
        _without_cr(F.col("raw")).alias("line"),
    )


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _block_of(order: Column, rows_per_block: int) -> tuple[Column, Column]:
    if not 0 < rows_per_block <= 1 << (63 - _POSITION_BITS):
        raise ValueError("rows_per_block is out of range")
    order = F.coalesce(order.cast("bigint"), F.lit(0))
    offset = F.pmod(order, F.lit(rows_per_block))
    return F.call_function("div", order - offset, F.lit(rows_per_block)), offset


def _without_cr(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)


def local_path(source: str) -> str:
    """The plain path of a ``file:`` source (for messages and tests)."""
    return unquote(source.removeprefix("file:"))
