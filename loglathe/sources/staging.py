"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only for a local master without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loglathe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Everything staged inside goes to a folder of its own, which is deleted at the end.

    ``folder`` is where that folder is made (default: the shared folder). What is to be used after
    the block must be computed or written elsewhere within it: a table that still reads staged ones
    fails later.
    """
    path = f"{(folder or _scratch.get() or shared_folder(spark)).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop_path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{(_scratch.get() or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return the table read back.

    Later passes read only the columns they need, lost executors cost no recomputation, and the
    size of the result is known to the planner. Inside :func:`scratch` the tables go when it ends;
    others stay until the cluster's clean-up of its scratch area. ``path`` puts the table elsewhere.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tiny_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """Driver-side configuration (specs, panels, input names) as a local relation."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    frame = pd.DataFrame({f.name: pd.Series(columns[f.name], dtype=object) for f in struct})
    return spark.createDataFrame(frame, struct)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside.

    A batch is held by a task's JVM side and by its Python worker at once, so wide rows cost an
    executor several times the batch. The session's setting, if smaller, stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
