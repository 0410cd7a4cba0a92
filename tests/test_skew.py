"""The skew-proof operators against the plain form of the same thing."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators import quantiles, skew


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def events(spark):
    """Key `hot` owns half of the rows, over many time slices."""
    rng = random.Random(7)
    data = []
    for i in range(4000):
        key = "hot" if i % 2 else f"k{rng.randrange(200)}"
        second = rng.randrange(5 * 86400)
        value = rng.choice([None, rng.randrange(5)])
        data.append((i, key, second, value, rng.uniform(-1e4, 1e4)))
    df = spark.createDataFrame(data, "id long, key string, second long, value int, x double")
    return df.withColumn("ts", F.timestamp_seconds("second")).cache()


def test_previous_row(events):
    window = Window.partitionBy("key").orderBy("ts", "id")
    plain = events.withColumn("prev_id", F.lag("id").over(window)).withColumn(
        "prev_x", F.lag("x").over(window)
    )
    ours = skew.with_previous(events, ["key"], "ts", ["id"], ["id", "x"], slice_seconds=600)
    assert rows(ours.na.fill(-1), "id", "prev_id", "prev_x") == rows(plain.na.fill(-1), "id", "prev_id", "prev_x")


@pytest.fixture(scope="module")
def burst(spark):
    """A third of the rows belongs to one key within two seconds; one instant repeats; some times are missing."""
    rng = random.Random(11)
    data = []
    for i in range(9000):
        if i % 3 == 0:
            key, micros = "hot", 7_200_000_000 + rng.randrange(2_000_000)
        elif i % 50 == 1:
            key, micros = "tied", 7_300_000_000
        else:
            key, micros = rng.choice([None, *(f"k{n}" for n in range(20))]), rng.randrange(6 * 3_600_000_000)
        data.append((i, key, None if i % 97 == 0 else micros, rng.choice([None, rng.randrange(5)])))
    df = spark.createDataFrame(data, "id long, key string, micros long, value int")
    return df.withColumn("ts", F.timestamp_micros("micros")).cache()


@pytest.mark.parametrize("bound", [-1, 32 << 20])
def test_a_burst_within_one_slice_is_cut_by_volume(spark, burst, bound, monkeypatch):
    monkeypatch.setattr(skew, "LOOKUP_BYTES", bound)  # -1: cuts are joined, not broadcast
    sliced = skew.time_slices(burst, ["key"], "ts", max_rows=100)
    sizes = sliced.filter("ts is not null").groupBy("key", "_slice").agg(
        F.count("*").alias("n"), F.min("micros").alias("low"), F.max("micros").alias("high")).collect()
    assert sum(r.n for r in sizes) == burst.filter("ts is not null").count() and sliced.count() == burst.count()
    assert max(r.n for r in sizes if r.key != "tied") <= 100
    assert {r.n for r in sizes if r.key == "tied"} == {burst.filter("key = 'tied' and ts is not null").count()}
    for key in {r.key for r in sizes}:
        own = sorted((r._slice, r.low, r.high) for r in sizes if r.key == key)
        assert all(a[0] <= a[1] <= a[2] < b[0] for a, b in zip(own, own[1:]))
    window = Window.partitionBy("key").orderBy("ts", "id")
    plain = burst.withColumn("prev_id", F.lag("id").over(window)).withColumn(
        "found", F.last("value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    ours = skew.with_previous(burst, ["key"], "ts", ["id"], ["id"], max_rows=100)
    assert rows(ours.na.fill(-1), "id", "prev_id") == rows(plain.na.fill(-1), "id", "prev_id")
    timed = burst.filter("key is not null and ts is not null")
    carried = skew.carry_forward(timed, ["key"], "ts", ["id"], "value", "found", max_rows=100)
    assert rows(carried.na.fill(-1), "id", "found") == rows(plain.filter("key is not null and ts is not null").withColumn(
        "found", F.last("value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))).na.fill(-1), "id", "found")


def test_tasks_of_a_burst_are_even(spark, burst):
    """The widest window group of the burst's key is under twice the median of its groups' bound."""
    sliced = skew.time_slices(burst.filter("key = 'hot' and ts is not null"), ["key"], "ts", max_rows=100)
    sizes = sorted(r["count"] for r in sliced.groupBy("_slice").count().collect())
    assert sizes[-1] <= 100 and len(sizes) > 50 and sizes[-1] <= 2 * max(1, sizes[len(sizes) // 2])


def test_carry_forward(events):
    window = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = events.withColumn("found", F.last("value", ignorenulls=True).over(window))
    ours = skew.carry_forward(events, ["key"], "ts", ["id"], "value", "found", slice_seconds=900)
    assert rows(ours.na.fill(-1), "id", "found") == rows(plain.na.fill(-1), "id", "found")


def test_admit_first(events):
    limited = events.withColumn("limit", F.when(F.col("key") == "hot", 37).otherwise(2))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("ts", "id"))
    plain = limited.withColumn("ok", rank <= F.col("limit"))
    ours = skew.admit_first(limited, ["key"], ["ts", "id"], "limit", "ok", salts=8)
    assert rows(ours, "id", "ok") == rows(plain, "id", "ok")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_beyond_the_broadcast_bound(spark, events, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k7", 4)], "key string, tag int")
    condition = (F.col("r.tag") != 2) | (F.col("l.x") > 0)
    expected = skew.lookup_join(events, small, ["key"], condition, how)
    salted = skew.lookup_join(events, small, ["key"], condition, how, max_rows=1, salts=8)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
    names = [c for c in expected.columns if c not in ("value",)]
    assert rows(expected.na.fill(-1), *names) == rows(salted.na.fill(-1), *names)


@pytest.mark.parametrize("percent", [1, 25, 50, 95, 99.9])
def test_exact_quantile(events, percent):
    plain = events.groupBy("key").agg(F.percentile("x", percent / 100).alias("v"))
    ours = quantiles.exact_quantile(events, ["key"], "x", percent, "v")
    for a, b in zip(rows(plain, "key", "v"), rows(ours, "key", "v"), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-12, abs=1e-9)
    whole = events.agg(F.percentile("x", percent / 100)).first()[0]
    assert quantiles.exact_quantile(events, [], "x", percent, "v").first()[0] == pytest.approx(whole)


def test_lower_rank_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, -8, 0, 0]], "x double")
    found = quantiles.exact_quantile(df, [], "x", 95, "v", method="lower", total="n").first()
    assert (found["v"], found["n"]) == (4.0, 8)


def test_coarse_key_keeps_order(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 10.0, 9.999999999999998, 1000.0, 999.9999999999999, 1e-300, 1e300, -1e300]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    keyed = df.select("x", quantiles.coarse_key(F.col("x")).alias("k")).collect()
    ordered = [r["k"] for r in sorted(keyed, key=lambda r: r["x"])]
    assert ordered == sorted(ordered)


def test_group_without_numbers(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    found = quantiles.exact_quantile(df, ["g"], "x", 50, "v")
    assert rows(found.na.fill(-1.0), "g", "v") == [("a", -1.0), ("b", 3.0)]
