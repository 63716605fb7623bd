import random
import statistics

import pytest

from bondwise.operators import order


def test_medians_of_large_and_small_groups(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random(), 0.5])) for k in "aaaaaaaaaaab" for _ in range(9)] + [("c", 1.0), ("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    want = {k: statistics.median(v for j, v in rows if j == k) for k in "abc"}
    assert {r.k: r.m for r in order.medians(df, ["k"], "v", "m").collect()} == pytest.approx(want)
    every = sorted(v for _, v in rows if v is not None)
    assert order.medians(df.limit(0), ["k"], "v", "m").count() == 0 and order.upper_median(df.limit(0), "v", "m").first().m is None
    assert order.medians(df, [], "v", "m").first().m == pytest.approx(statistics.median(every))
    assert order.upper_median(df, "v", "m").first().m == every[len(every) // 2]


def test_one_hot_key_at_one_instant_spreads(spark):
    """Nine tenths of the rows share key and value; no part holds more than twice the mean, and sums and ranks are exact."""
    n = 20_000
    df = spark.range(n).selectExpr("id", "if(id % 10 = 0, id % 7, 99) as k", "if(id % 10 = 0, id, 5) as time", "1 as delta").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = [r["count"] for r in order.in_parts(df, ["k"], ["time"]).groupBy("part").count().collect()]
        assert len(sizes) > 4 and max(sizes) <= 2 * n / len(sizes)
        got = order.running_sum(df, ["k"], ["time"], "delta", "s").groupBy("k").agg({"s": "max", "id": "count"}).collect()
        assert all(r["max(s)"] == r["count(id)"] for r in got) and sum(r["count(id)"] for r in got) == n
        ranks = order.ranked(df, ["k"], "time").selectExpr("k", "rank", "n").distinct().groupBy("k", "n").count().collect()
        assert all(r["n"] == r["count"] for r in ranks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_merges_of_many_rows_take_more_parts(spark, monkeypatch):
    """the rows of a task stay the same however many there are, and every row keeps its neighbours."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(order, "PART_ROWS", 1_000, raising=False)
    rows = spark.range(20_000).select((F.col("id") / 100).alias("at"), "id")
    points = spark.range(0, 200, 3).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    met = order.between(rows, points, "at").select("row.id", "at", "before.x", F.col("after.x").alias("next"), F.spark_partition_id().alias("task")).cache()
    sizes = [r["count"] for r in met.groupBy("task").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2_500
    assert met.filter("x != floor(at / 3) * 3 or (x < 198 and next != x + 3) or (x = 198 and next is not null)").count() == 0
