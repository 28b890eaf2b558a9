"""Incremental extraction: only files (or specs) not seen before are read.

A store is a folder with the files of runs and a log that says which runs are live (:mod:`runs`):

``records/run=<run>/spec_id=<spec>``  the records of a run, in the layout of stored records
``keys/run=<run>``                    ``(source, mtime, spec_id)``: the file versions it extracted
``log``                               the live runs, oldest first

A run becomes visible by one commit after its files are complete. A run that fails leaves files that
no reader looks at; repeating it is safe, and :func:`clean_store` removes them. Where several live
runs have a series, the last one in the log counts. :func:`compact_records` merges runs that have
little left that counts, so that neither the log nor what readers skip keeps growing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import TimeFormat
from ..operators.extract import hits
from ..operators.joins import attach
from ..operators.sequence import number_hits
from ..sources.lines import literal_path, log_file_versions, read_log_files
from ..sources.records import Window, laid_out, stale_series, stored_schema, within
from ..sources.staging import scratch, stage, tiny_table
from .runs import RunLog, new_run

_KEYS = "source STRING, mtime BIGINT, spec_id STRING, run STRING"
_SERIES = ["source", "spec_id"]


def _keys(spark: SparkSession, store: str, live: Sequence[str]) -> DataFrame | None:
    """Keys of the live runs; the files of others are not opened."""
    if not live:
        return None
    keys = spark.read.schema(_KEYS).parquet(f"{store}/keys")
    return keys.where(F.col("run").isin(list(live)))


def _write_keys(keys: DataFrame, n: int, store: str, run: str) -> None:
    keys.select("source", "mtime", "spec_id").coalesce(1 + n // 1_000_000).write.parquet(f"{store}/keys/run={run}")


def _write_records(records: DataFrame, store: str, run: str) -> None:
    laid_out(records).write.partitionBy("spec_id").parquet(f"{store}/records/run={run}")


def refresh_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    specs: Sequence,
    store: str,
    time_format: TimeFormat = TimeFormat(),
    bad_timestamps: str = "fail",
    force: bool = False,
    **options,
) -> int:
    """Extract what the store lacks; returns the number of (file, spec) pairs extracted.

    A file is read again when its modification time (in seconds) has changed, and for specs it was
    not read for. ``force`` reads everything again. A file that changes or goes while it is read
    gets no key, and so is read again next time.
    """
    with scratch(spark):
        return _refreshed(spark, paths, specs, store, time_format, bad_timestamps, force, options)


def _refreshed(spark, paths, specs, store, time_format, bad_timestamps, force, options) -> int:
    by_id = {spec.spec_id: spec for spec in specs}
    log = RunLog(spark, store)
    versions = log_file_versions(spark, paths, **options)
    done = None if force else _keys(spark, store, log.latest().live)
    stale = stage(stale_series(versions, list(by_id), done), "stale")
    n_stale = stale.count()
    if not n_stale:
        return 0
    # The list of files to open is needed on the driver anyway, like the listing itself.
    files = [literal_path(row.source) for row in stale.select("source").distinct().toLocalIterator()]
    wanted = {row.spec_id for row in stale.select("spec_id").distinct().collect()}
    run = new_run()

    found = hits(read_log_files(spark, files), [by_id[i] for i in by_id if i in wanted], time_format, bad_timestamps)
    records = number_hits(attach(found, stale, _SERIES, "left_semi", rows=n_stale))
    _write_records(records, store, run)
    present = log_file_versions(spark, paths, **options)  # as it is after the reading
    read = stage(stale.join(present, ["source", "mtime"], "left_semi"), "read")
    n_read = read.count()
    if not n_read:
        return 0
    _write_keys(read, n_read, store, run)
    log.add(run)
    return n_read


def _counting(spark: SparkSession, store: str, live: Sequence[str], versions: DataFrame | None) -> DataFrame:
    """``(source, mtime, spec_id, run)``: for every series, the key of the last live run that has it
    (of those for present versions, if given)."""
    keys = _keys(spark, store, live)
    if versions is not None:
        keys = keys.join(versions, ["source", "mtime"], "left_semi")
    places = tiny_table(spark, {"run": list(live), "place": list(range(len(live)))}, "run string, place int")
    last = F.max_by(F.struct("mtime", "run"), "place").alias("last")
    return keys.join(places, "run").groupBy(*_SERIES).agg(last).select(*_SERIES, "last.mtime", "last.run")


def _records_of(spark: SparkSession, store: str, counting: DataFrame) -> DataFrame:
    """The records that count, read from the runs that have any."""
    runs = sorted(row.run for row in counting.select("run").distinct().collect())  # live runs at most
    rows = spark.read.schema(stored_schema("run STRING")).parquet(f"{store}/records")
    return attach(rows.where(F.col("run").isin(runs)), counting.select(*_SERIES, "run"), [*_SERIES, "run"], "left_semi")


def current_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    store: str,
    window: Window | None = None,
    **options,
) -> DataFrame:
    """Records of the present versions of the files, with the ``run`` that extracted them.

    Only runs with such records are read, and with a ``window`` only the parts of their files that
    reach into it.
    """
    live = RunLog(spark, store).latest().live
    if not live:
        raise ValueError(f"nothing has been extracted into {store!r}")
    versions = log_file_versions(spark, paths, **options)
    counting = stage(_counting(spark, store, live, versions), "latest")
    rows = _records_of(spark, store, counting)
    return (rows if window is None else within(rows, window)).drop("us")


def compact_records(
    spark: SparkSession,
    store: str,
    paths: str | Sequence[str] | None = None,
    least_live: float = 0.5,
    most_runs: int = 100,
    **options,
) -> list[str]:
    """Merge runs; returns those that are no longer live.

    Runs whose series are all superseded go. Of the others, those with less than ``least_live`` of
    their series still counting are merged into one run, and the smallest ones too if more than
    ``most_runs`` would be left. With ``paths``, series of files that are no longer present in the
    stored version count as superseded. Readers and other writers may work meanwhile: runs that are
    committed during a compaction stay behind the merged one.
    """
    with scratch(spark):
        return _compacted(spark, store, paths, least_live, most_runs, options)


def _compacted(spark, store, paths, least_live, most_runs, options) -> list[str]:
    log = RunLog(spark, store)
    live = log.latest().live
    if not live:
        return []
    versions = None if paths is None else log_file_versions(spark, paths, **options)
    counting = stage(_counting(spark, store, live, versions), "counting")
    total = {r["run"]: r["count"] for r in _keys(spark, store, live).groupBy("run").count().collect()}
    left = {r["run"]: r["count"] for r in counting.groupBy("run").count().collect()}
    thin = {run for run in live if left.get(run, 0) < max(least_live * total.get(run, 0), 1)}
    full = sorted((run for run in live if run not in thin), key=lambda run: left[run])
    surplus = len(full) + bool(thin) - most_runs
    merged = thin | set(full[: surplus + 1] if surplus > 0 else ())
    if not merged:
        return []
    kept = counting.where(F.col("run").isin(sorted(merged)))
    n = kept.count()
    if not n:
        log.replace(merged, None)
        return sorted(merged)
    run = new_run()
    _write_records(_records_of(spark, store, kept).drop("run"), store, run)
    _write_keys(kept, n, store, run)
    log.replace(merged, run)
    return sorted(merged)


def clean_store(spark: SparkSession, store: str, older_than: float = 86_400.0) -> list[str]:
    """Delete files of runs that are not live: merged ones, and those of runs that failed.

    ``older_than`` seconds must pass before, so that readers that started with an earlier version
    and runs under way keep their files. Returns the names of the runs.
    """
    return RunLog(spark, store).remove_dead(("records", "keys"), older_than)
