"""The skew-safe building blocks against plain Spark or NumPy on skewed input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.operators import windows as W
from eventcast.operators.attach import attach, table_bytes
from eventcast.operators.rank import global_rank, kth_keys, running_total
from eventcast.operators.stats import box_stats, exact_percentiles


def skewed(spark, n=3000):
    """A third of the rows on one key and one day, and a null key."""
    rows = spark.range(n)
    return rows.select(
        F.col("id").alias("eventid"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.when(F.col("id") % 3 == 1, F.lit("2001-01-05")).otherwise(
            F.date_format(F.date_add(F.lit("2001-01-01"), (F.col("id") % 200).cast("int")), "yyyy-MM-dd")
        ).cast("date").alias("date"),
        (F.col("id") * 37 % 101).cast("double").alias("v"),
    )


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(columns) == sorted(b.columns)
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("size", [0, 1 << 20])
def test_attach_equals_plain_join(spark, how, size):
    facts = skewed(spark)
    lookup = facts.filter("key is not null and key <> 'k7'").groupBy("key").agg(F.avg("v").alias("m"))
    same(attach(facts, lookup, "key", how, broadcast_bytes=size, hot_keys=10), facts.join(lookup, "key", how))


def test_chained_attaches_keep_one_copy_of_the_facts(spark, tmp_path):
    skewed(spark).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    lookup = facts.filter("key is not null").groupBy("key").agg(F.avg("v").alias("m"))
    for name in ("a", "b", "c"):
        facts = attach(facts, lookup.withColumnRenamed("m", name), "key", broadcast_bytes=0)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_attach_splits_hot_keys_without_salting_the_rest(spark):
    facts = skewed(spark)
    lookup = facts.filter("key is not null").groupBy("key").agg(F.avg("v").alias("m"))
    plan = attach(facts, lookup, "key", broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan


def test_attach_deals_hot_and_null_keys_over_parts(spark):
    facts = skewed(spark)
    lookup = facts.filter("key is not null").groupBy("key").agg(F.avg("v").alias("m"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = attach(facts, lookup, "key", broadcast_bytes=0, hot_keys=20).groupBy(
            F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 3000 / 3


def test_table_bytes_grows_with_content(spark):
    small = spark.createDataFrame([("a",)], "s string")
    large = spark.createDataFrame([("a" * 1000,)], "s string")
    assert table_bytes(large) - table_bytes(small) == 999
    assert table_bytes(small.filter("false")) == 0
    deep = "a array<string>, s struct<t: string, u: array<array<string>>>, m map<string, binary>"
    few = spark.createDataFrame([(["x"], ("y", [["z"]]), {"k": b"v"})], deep)
    many = spark.createDataFrame([(["x" * 500] * 4, ("y" * 300, [["z" * 200] * 3]), {"k": b"v" * 100})], deep)
    assert table_bytes(many) - table_bytes(few) > 2000 + 300 + 600 + 90
    assert table_bytes(spark.createDataFrame([(None, None, None)], deep)) > 0


@pytest.mark.parametrize("by", [[], ["key"]])
def test_rank_and_running_total_equal_windows(spark, by):
    rows = skewed(spark).filter("key is not null").select("eventid", "key", "date", "v")
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("date", "eventid")
    same(
        global_rank(rows, ["date", "eventid"], by),
        rows.withColumn("position", F.row_number().over(order) - 1),
    )
    frame = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same(
        running_total(rows, ["date", "eventid"], by, "v"),
        rows.withColumn("running", F.sum("v").over(frame)),
    )


def test_kth_keys_inside_a_hot_day(spark):
    rows = skewed(spark)
    ordered = [(r["date"], r["eventid"]) for r in rows.orderBy("date", "eventid").collect()]
    found = kth_keys(rows, "date", ["eventid"], lambda n: [F.lit(100), F.floor(n * 0.5), n]).first()
    assert (found["cut0"]["date"], found["cut0"]["eventid"]) == ordered[100]
    assert (found["cut1"]["date"], found["cut1"]["eventid"]) == ordered[1500]
    assert found["cut2"] is None


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("block", [31, 100_000])
def test_event_lags_equal_windows(spark, by, block):
    rows = skewed(spark).filter("key is not null")
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("date", "eventid")
    expected = rows.withColumns({f"v_lag_{k}": F.lag("v", k).over(order) for k in (1, 7, 30)})
    same(W.event_lags(rows, "v", order=["date", "eventid"], by=by, block=block), expected)


def test_event_rolling_needs_a_full_window(spark):
    rows = skewed(spark, 40)
    found = W.event_rolling(rows, ["v"], order=["date", "eventid"], block=5).orderBy("date", "eventid").collect()
    values = [r["v"] for r in found]
    for i, r in enumerate(found):
        assert r["v_lag1"] == (values[i - 1] if i else None)
        if i < 2:
            assert r["v_rolling_mean"] is None and r["v_rolling_std"] is None
        else:
            assert r["v_rolling_mean"] == pytest.approx(np.mean(values[i - 2:i + 1]))
            assert r["v_rolling_std"] == pytest.approx(np.std(values[i - 2:i + 1], ddof=1))


def test_exact_percentiles_equal_numpy(spark):
    rows = skewed(spark).filter("key is not null")
    data = rows.select("key", "v").toPandas()
    wanted = [0.0, 0.25, 0.5, 0.9, 1.0]
    whole = exact_percentiles(rows, "v", wanted).first()
    assert list(whole) == pytest.approx(list(np.quantile(data["v"], wanted)))
    for r in exact_percentiles(rows, "v", wanted, ["key"]).collect():
        assert list(r)[1:] == pytest.approx(list(np.quantile(data[data["key"] == r["key"]]["v"], wanted)))


def test_box_stats_of_one_value(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 100.0)], "g string, v double")
    found = {r["g"]: r for r in box_stats(rows, "v", "g").collect()}
    assert found["a"]["q1"] == found["a"]["high_whisker"] == 5.0 and found["a"]["outliers"] == 0
    assert found["b"]["outliers"] == 1 and found["b"]["high_whisker"] == 3.0
