import math
import random

import pytest
from pyspark.sql import functions as F

from loglathe.operators import joins, stats
from loglathe.sources.staging import stage


def type8(values, p):
    """Hyndman-Fan type 8 by sorting."""
    x, n = sorted(values), len(values)
    h = (n + 1 / 3) * p + 1 / 3
    k = math.floor(h)
    if k <= 0:
        return x[0]
    if k >= n:
        return x[-1]
    return x[k - 1] + (h - k) * (x[k] - x[k - 1])


def groups(seed):
    rng = random.Random(seed)
    return {
        "hot": [rng.gauss(0, 1) for _ in range(3000)],
        "heavy": [7.0] * 1500 + [rng.random() for _ in range(500)],
        "steps": [float(rng.randrange(4)) for _ in range(1200)],
        "tail": [rng.random() ** -3 for _ in range(900)],
        "small": [3.0, 1.0, 2.0],
        "pair": [1.0, 2.0],
        "one": [5.0],
    }


def table(spark, data):
    rows = [(k, "s", float(v)) for k, values in data.items() for v in values]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "source string, spec_id string, value double")


@pytest.mark.parametrize("piece_rows, cuts", [(1 << 20, 64), (100, 8), (1, 3)])
def test_quantiles_equal_sorting(spark, piece_rows, cuts):
    data = groups(5)
    rows = stats.quantiles(table(spark, data), piece_rows=piece_rows, cuts=cuts).collect()
    assert {r["source"] for r in rows} == set(data) and len(rows) == len(data)
    for row in rows:
        for name, p in stats.PROBABILITIES.items():
            assert row[name] == pytest.approx(type8(data[row["source"]], p), rel=1e-15), (row, name)


def test_pieces_are_narrowed_until_all_are_bounded(spark, monkeypatch):
    """Three rounds and more; each goes on with a small share of the rows, none with a large piece."""
    rounds, narrowed = [], stats._narrowed

    def watched(rows, *more):
        left, kept = narrowed(rows, *more)
        rounds.append((rows.count(), left.count(), max([r["size"] for r in kept.collect()], default=0)))
        return left, kept

    monkeypatch.setattr(stats, "_narrowed", watched)
    data = {"long": [float(i * i) for i in range(4000)], "twice": [float(i % 900) for i in range(1800)], "few": [1.0, 4.0]}
    rows = stats.quantiles(table(spark, data), piece_rows=4, cuts=9).collect()
    for row in rows:
        for name, p in stats.PROBABILITIES.items():
            assert row[name] == pytest.approx(type8(data[row["source"]], p), rel=1e-15)
    assert len(rounds) >= 3 and rounds[-1][2] <= 4
    assert all(after < before for before, after, _ in rounds) and rounds[1][1] < rounds[0][0] / 10


def test_quantiles_of_odd_values(spark):
    nan, inf = math.nan, math.inf
    data = {"ends": [-inf] * 3 + [1.0, 2.0] + [inf] * 3, "nan": [1.0, nan, nan, nan], "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51]}
    for piece_rows in (1, 1 << 20):
        found = {r["source"]: r for r in stats.quantiles(
            table(spark, data), probabilities={"low": 0.1, "half": 0.5, "high": 0.9}, piece_rows=piece_rows, cuts=2).collect()}
        assert (found["ends"]["half"], found["nan"]["low"]) == (1.5, 1.0) and math.isnan(found["nan"]["high"])
        assert found["close"]["half"] == 1.0 + 2**-52
    with_nulls = table(spark, {"g": [1.0, 3.0]}).unionByName(
        spark.createDataFrame([("g", "s", None)], "source string, spec_id string, value double"))
    assert stats.quantiles(with_nulls, probabilities={"half": 0.5}).first()["half"] == 2.0


def test_quantile_definition(spark):
    """n = 1130: h = 848.08333 for q75, that is 1/12 of the way between two neighbours."""
    data = {"g": [float(i) for i in range(1, 1131)]}
    (row,) = stats.quantiles(table(spark, data)).collect()
    assert row["q75"] == pytest.approx(848 + 1 / 12) and row["median"] == 565.5


def test_quantiles_beyond_the_ends(spark):
    data = {"g": [1.0, 2.0, 3.0]}
    wanted = {"lowest": 0.0, "low": 0.01, "high": 0.99, "highest": 1.0}
    for piece_rows in (1, 1 << 20):
        (row,) = stats.quantiles(table(spark, data), probabilities=wanted, piece_rows=piece_rows).collect()
        assert [row[n] for n in wanted] == [1.0, 1.0, 3.0, 3.0]


def test_nothing_to_rank(spark):
    assert stats.quantiles(table(spark, {})).collect() == []
    assert stats.histogram(table(spark, {})).collect() == []


def test_summary(spark):
    (row,) = stats.summary(table(spark, {"g": [1.0, 2.0, 6.0]})).collect()
    assert (row["count"], row["min"], row["max"], row["mean"]) == (3, 1.0, 6.0, 3.0)


def test_histogram_edges(spark):
    """Range 2.98 in ten buckets: widened by 2 (its whole part modulo 10), edges 0.1331 ... 5.1142."""
    values = [0.13308, 0.5, 0.7, 3.114183, 2.0, 2.0]
    rows = stats.histogram(table(spark, {"g": values})).orderBy("bucket").collect()
    edges = [round(r["start"], 4) for r in rows] + [round(rows[-1]["end"], 4)]
    assert edges[:2] == [0.1331, 0.6312] and edges[-1] == 5.1142 and len(rows) == 10
    assert [r["count"] for r in rows] == [2, 1, 0, 2, 0, 1, 0, 0, 0, 0]
    assert [len(r["bar"]) for r in rows] == [2, 1, 0, 2, 0, 1, 0, 0, 0, 0]


def test_histogram_bars_scale_with_the_largest_bucket(spark):
    values = [0.0] * 250 + [9.0] * 12 + [10.0] * 9
    rows = stats.histogram(table(spark, {"g": values}), mode="equal").orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [250] + [0] * 8 + [21]  # the last edge is in the last bucket
    assert (len(rows[0]["bar"]), len(rows[-1]["bar"])) == (50, 4)


def test_histogram_of_equal_values(spark):
    rows = stats.histogram(table(spark, {"g": [4.0] * 3}), 4).orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [3, 0, 0, 0]
    assert all(r["start"] == r["end"] == 4.0 for r in rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_with_hot_keys_equal_a_broadcast_join(spark, how):
    big = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"),
        (F.col("id") % 10).alias("v"),
    )
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k33", 3), ("k33", 5), ("k9", 4), (None, 6)], "k string, x int")
    broadcast = joins.attach(big, small, ["k"], how)
    split = joins.attach(big, small, ["k"], how, broadcast_bytes=0)
    assert split.columns == broadcast.columns
    assert split.exceptAll(broadcast).isEmpty() and broadcast.exceptAll(split).isEmpty()


def test_a_hot_group_of_equal_rows_is_joined_where_it_is(spark):
    """Two thirds of all rows are one and the same; none of them is shuffled to meet its group."""
    big = spark.range(30_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.lit(1).alias("v")
    )
    small = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.lit(2).alias("x"))
    small = small.unionByName(spark.createDataFrame([("hot", 9)], small.schema))
    joined = joins.attach(stage(big), stage(small), ["k"], broadcast_bytes=0)
    places = joined.where("x = 9").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in places) == 20_000 and len(places) == 6
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 3
    assert joined.count() == 30_000


@pytest.mark.parametrize(
    "values, counts",
    [
        ([0.0, 1e19], [1, 0, 0, 1]),
        ([-1.7e308, 0.0, 1.7e308], [1, 0, 1, 1]),  # the range itself is beyond the largest number
        ([0.0, 8.0, math.inf, math.inf], [1, 0, 0, 3]),
        ([2.0, -math.inf, 3.0, math.nan], [2, 0, 0, 2]),
        ([math.inf, -math.inf, math.nan], [1, 0, 0, 2]),
    ],
)
def test_histogram_of_huge_and_infinite_values(spark, values, counts):
    rows = stats.histogram(table(spark, {"g": values}), 4, mode="equal").orderBy("bucket").collect()
    assert [r["count"] for r in rows] == counts
    assert all(math.isfinite(r["start"]) and r["start"] <= r["end"] for r in rows)
    padded = stats.histogram(table(spark, {"g": values}), 4).collect()
    assert sum(r["count"] for r in padded) == len(values)
