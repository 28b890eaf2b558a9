import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def new_york(spark):
    """A session zone with daylight-saving time."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.fixture
def log(spark):
    """Lines of one source from Python strings."""
    from loglathe import lines_from_table

    def make(*lines, source="input.log", rows_per_block=1 << 16):
        rows = spark.createDataFrame(list(enumerate(lines)), "place bigint, line string")
        from pyspark.sql import functions as F

        return lines_from_table(rows, "line", "place", F.lit(source), rows_per_block)

    return make


@pytest.fixture
def extracted(log):
    """Records of one spec on some lines, as (value, count, delta, ts) tuples in line order."""
    from loglathe import TimeFormat
    from loglathe.operators.extract import hits
    from loglathe.operators.sequence import number_hits

    def make(spec, *lines, fmt=None, bad="fail", rows_per_block=1 << 16):
        time_format = TimeFormat(fmt) if fmt else TimeFormat()
        found = hits(log(*lines, rows_per_block=rows_per_block), [spec], time_format, bad)
        rows = number_hits(found).orderBy("count").collect()
        return [(r["value"], r["count"], r["delta"], r["ts"]) for r in rows]

    return make
