import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailgrid.operators import merge

NOW = "2026-02-10 12:00:00"
SCHEMA = "k string, v int, updated_at timestamp_ntz"


def day(n):
    return dt.datetime(2026, 1, n)


def test_upsert_rules(spark, rows):
    target = spark.createDataFrame(
        [("old", 1, day(1)), ("same", 2, day(2)), ("new", 3, day(3)), ("twice", 4, day(1)),
         ("twice", 5, day(1)), (None, 6, day(1)), ("alone", 7, None), ("null_ts", 8, None)],
        SCHEMA,
    )
    source = spark.createDataFrame(
        [("old", 11, day(2)), ("same", 12, day(2)), ("new", 13, day(2)), ("twice", 14, day(2)),
         (None, 16, day(2)), (None, 15, day(1)), ("added", 17, day(1)), ("dup", 18, day(1)), ("dup", 19, day(2)),
         ("null_ts", 20, day(5))],
        SCHEMA,
    )
    out = merge.merge_upsert(target, source, ["k"])
    assert rows(out, "k", "v") == [
        ("added", 17), ("alone", 7), ("dup", 19), ("new", 3), ("null_ts", 8), ("old", 11),
        ("same", 2), ("twice", 14), ("twice", 14), (None, 15), (None, 16), (None, 6)]


def test_upsert_is_idempotent_without_null_keys(spark, rows):
    target = spark.createDataFrame([("a", 1, day(1)), ("b", 2, day(5))], SCHEMA)
    source = spark.createDataFrame([("a", 3, day(2)), ("c", 4, day(1))], SCHEMA)
    once = merge.merge_upsert(target, source, ["k"])
    assert rows(merge.merge_upsert(once, source, ["k"])) == rows(once)


def test_upsert_does_not_shuffle_a_large_target(spark):
    """A small source reaches the target by broadcast: its rows are not exchanged."""
    target = spark.range(100000).select(
        F.col("id").cast("string").alias("k"), F.lit(1).alias("v"),
        F.lit(day(1)).cast("timestamp_ntz").alias("updated_at"))
    source = spark.createDataFrame([("5", 2, day(2))], SCHEMA)
    plan = merge.merge_upsert(target, source, ["k"])._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("Union")[1]
    assert "BroadcastHashJoin" in kept


def test_guard(spark):
    target = spark.createDataFrame([("a", 1, day(1))], SCHEMA)
    with pytest.raises(ValueError, match="nothing for 2026-02"):
        merge.guarded_merge(target, target.limit(0), ["k"], "nothing for 2026-02")


def test_deletes_are_null_safe(spark, rows):
    df = spark.createDataFrame(
        [(1, None), (1, day(1)), (2, None), (None, None)], "run_id int, to_ts timestamp_ntz")
    assert rows(merge.drop_open_ended(df, 1), "run_id") == [(1,), (2,), (None,)]
    assert merge.drop_open_ended(df).count() == 1
    assert rows(merge.delete_run({"t": df}, 1)["t"], "run_id") == [(2,), (None,)]
    assert merge.truncate_staging(df).count() == 0


def test_effective_status(spark):
    data = [
        (1, "In lavorazione", "Now", dt.datetime(2026, 2, 8, 11)),
        (2, "In lavorazione", "Now", dt.datetime(2026, 2, 8, 12)),
        (3, "Schedulata", "Schedule", dt.datetime(2026, 2, 10, 12)),
        (4, "Schedulata", "Now", dt.datetime(2026, 2, 1)),
        (5, "Schedulata", "Schedule", dt.datetime(2026, 2, 11)),
        (6, None, "Now", None),
    ]
    runs = spark.createDataFrame(data, "run_id int, status string, trigger string, executed_at timestamp_ntz")
    shown = {r.run_id: r.shown_status for r in merge.effective_status(runs, NOW).collect()}
    assert shown == {1: "Non completata", 2: "In lavorazione", 3: "In lavorazione",
                     4: "Schedulata", 5: "Schedulata", 6: None}
