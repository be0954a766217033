import pytest
from pyspark.sql import functions as F

from mailgrid.operators import relational as rel


def test_repeat_rows_splits_large_counts(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 25), ("d", -1), ("e", None)], "k string, n int")
    out = rel.repeat_rows(df, "n", chunk=10)
    counts = {r.k: (r.rows, r.lo, r.hi, r.kinds) for r in out.groupBy("k").agg(
        F.count("*").alias("rows"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"),
        F.count_distinct("ordinal").alias("kinds")).collect()}
    assert counts == {"a": (3, 1, 3, 3), "c": (25, 1, 25, 25)}


def test_repeat_rows_spreads_a_huge_row(spark):
    out = rel.repeat_rows(spark.createDataFrame([("a", 200000)], "k string, n int"), "n", chunk=1000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200000 and max(sizes) < 150000


def test_dedup_latest_keeps_exactly_one(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "2026-01-01"), ("a", 2, "2026-01-02"), ("a", 3, "2026-01-02"), ("b", 9, None),
         ("b", 8, None), (None, 1, "2026-01-01"), (None, 2, "2026-01-03")],
        "k string, v int, ts string",
    )
    once = rel.dedup_latest(df, ["k"], ["ts"])
    assert rows(once, "k", "v") == [("a", 2), ("b", 8), (None, 2)]
    assert rows(rel.dedup_latest(once, ["k"], ["ts"])) == rows(once)


def test_max_over_group_null_key_stays_null(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 7)], "k string, v int")
    assert rows(rel.max_over_group(df, ["k"], "v", "m"), "k", "v", "m") == [
        ("a", 1, 5), ("a", 5, 5), (None, 7, None)]


def test_count_over_group_null_key_is_a_group(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 7), (None, 8)], "k string, v int")
    assert {r[-1] for r in rows(rel.count_over_group(df, ["k"], "n"))} == {2}


def test_classify_flags(spark, rows):
    data = [("t", True), ("t", True), ("f", False), ("m", True), ("m", False), ("n", True), ("n", None)]
    df = spark.createDataFrame(data, "k string, is_default boolean")
    assert rows(rel.classify_flags(df, ["k"])) == [
        ("f", "none"), ("m", "mixed"), ("n", "mixed"), ("t", "all")]


def test_with_row_id_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ids = rel.with_row_id(df, ["v"]).orderBy("v").collect()
    assert [r.id for r in ids] == list(range(1, 1001))
    assert rel.with_row_id(df.limit(0), ["v"]).count() == 0


def test_with_row_id_of_equal_values_is_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("v"), "id")
    out = rel.with_row_id(df, ["v", "id"], "n")
    assert [r.n for r in out.orderBy("id").collect()] == list(range(1, 4001))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_week_ordinal_is_one_window(spark, rows):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 1), ("b", 2, 1)], "k string, week int, count_request int")
    out = rel.week_ordinal(df, ["k"])
    assert rows(out, "k", "week", "week_no") == [("a", 1, 1), ("a", 3, 2), ("b", 2, 1)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Window [") == 1


def test_series_for_empty_list_selects_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "run_id int, m string")
    assert rel.series_for(df, run_id=1, m=["a", "b"]).count() == 2
    assert rel.series_for(df, run_id=1, m=[]).count() == 0


def test_conform_and_stamp(spark):
    df = spark.createDataFrame([("7", "x")], "Old string, extra string")
    out = rel.stamp(rel.conform(df, "a int, b string", {"Old": "a", "extra": "b"}), 3, "2026-01-01")
    assert out.dtypes == [("a", "int"), ("b", "string"), ("run_id", "int"), ("updated_at", "timestamp_ntz")]


def test_require_rows(spark):
    df = spark.range(1)
    assert rel.require_rows(df, "no") is df
    with pytest.raises(ValueError, match="empty delta"):
        rel.require_rows(df.limit(0), "empty delta")


def test_number_in_groups_equals_a_window(spark):
    """One group holds most rows; NULL is a group; equal values are told apart by the id."""
    df = spark.range(5000, numPartitions=5).select(
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 10 < 9, "hot")
        .otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") % 13).alias("v"), "id")
    out = rel.number_in_groups(df, ["g"], [F.col("v").desc(), F.col("id")], "place")
    assert out.columns == ["g", "v", "id", "place"]
    found = {r.id: (r.g, r.place) for r in out.collect()}
    groups = {}
    for i in range(5000):
        g = None if i % 7 == 0 else "hot" if i % 10 < 9 else f"g{i % 50}"
        groups.setdefault(g, []).append((-(i % 13), i))
    wanted = {i: (g, n + 1) for g, ids in groups.items() for n, (_, i) in enumerate(sorted(ids))}
    assert found == wanted
    assert rel.number_in_groups(df.limit(0), ["g"], [F.col("id")], "n").count() == 0


def test_no_group_is_held_by_one_task(spark):
    df = spark.range(8000, numPartitions=4).select(F.lit("hot").alias("g"), "id")
    out = rel.number_in_groups(df, ["g"], [F.col("id")], "place")
    assert "Window" in out._jdf.queryExecution().optimizedPlan().toString()
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 8000


def test_counted_rows_run_the_plan_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(10).mapInArrow(count, "id long")
    kept = rel.counted_rows(df, "none")
    assert kept.count() == 10 and kept.agg(F.sum("id")).first()[0] == 45
    assert seen.value == 10
    with pytest.raises(ValueError, match="empty delta"):
        rel.counted_rows(df.filter("id > 10"), "empty delta")


def test_null_safe_hot_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    got = rel.hot_join(left, right, ["k"], "left", nulls=True)
    assert sorted(map(repr, map(tuple, got.select("k", "v", "w").collect()))) == sorted(
        map(repr, [("a", 1, 10), (None, 2, 20), ("b", 3, None)]))


def test_series_for_a_frame(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "run_id int, m string")
    runs = spark.createDataFrame([(1,), (1,), (None,)], "run_id int")
    assert [r.m for r in rel.series_for(df, run_id=runs).collect()] == ["a"]
    assert rel.series_for(df, run_id=runs.limit(0)).count() == 0
