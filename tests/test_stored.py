"""Stored tables: only the partitions a change concerns may get new files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from mailgrid.sources import stored

SCHEMA = "k int, v int, updated_at timestamp_ntz, month string"
OLD, NEW = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)


def files_of(path):
    """Data files with the time they were written, by partition folder."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                full = os.path.join(folder, name)
                found.setdefault(os.path.basename(folder), set()).add(
                    (name, os.stat(full).st_mtime_ns)
                )
    return found


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, i, OLD, f"2026-0{i % 4 + 1}") for i in range(40)] + [(None, -1, OLD, None)]
    stored.store(spark.createDataFrame(rows, SCHEMA), path, "month")
    return path


def content(spark, path):
    return {(r.k, r.v, r.month) for r in stored.read_stored(spark, path, SCHEMA).collect()}


def test_upsert_touches_the_months_of_the_delta_only(spark, table):
    before = files_of(table)
    delta = spark.createDataFrame(
        [(1, 100, NEW, "2026-02"), (5, 100, OLD, "2026-02"), (99, 100, OLD, "2026-02"),
         (7, 7, NEW, "2026-09")], SCHEMA)
    stored.upsert_stored(delta, table, SCHEMA, ["k", "month"], "month")
    after = files_of(table)
    for month in ("2026-01", "2026-03", "2026-04"):
        assert after[f"month={month}"] == before[f"month={month}"]
    assert not after["month=2026-02"] & before["month=2026-02"]
    expected = {(i, i, f"2026-0{i % 4 + 1}") for i in range(40)} - {(1, 1, "2026-02")}
    expected |= {(1, 100, "2026-02"), (99, 100, "2026-02"), (7, 7, "2026-09"), (None, -1, None)}
    assert content(spark, table) == expected


def test_rows_without_a_month_are_added(spark, table):
    before = content(spark, table)
    delta = spark.createDataFrame([(None, 5, NEW, None)], SCHEMA)
    stored.upsert_stored(delta, table, SCHEMA, ["k", "month"], "month")
    assert content(spark, table) == before | {(None, 5, None)}


def test_delta_prunes_the_scan(spark, table):
    known = spark.createDataFrame([("2026-02",)], "month string")
    plan = stored.read_stored(spark, table, SCHEMA).join(known, "month", "left_semi")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "month" in text


def test_deleted_partitions_cost_no_rewrite(spark, table):
    before = files_of(table)
    stored.delete_stored(
        table, spark.createDataFrame([("2026-01",), (None,), ("2030-01",)], "month string"), "month"
    )
    after = files_of(table)
    assert set(after) == {"month=2026-02", "month=2026-03", "month=2026-04"}
    assert all(after[m] == before[m] for m in after)


def test_dropped_rows_rewrite_their_partitions_and_empty_ones_go(spark, table):
    before = files_of(table)
    stored.drop_rows_stored(
        spark, table, SCHEMA, (F.col("month") == "2026-01") | (F.col("k") == 2), "month"
    )
    after = files_of(table)
    assert "month=2026-01" not in after
    assert after["month=2026-02"] == before["month=2026-02"]
    assert after["month=2026-03"] != before["month=2026-03"]
    assert {r[0] for r in content(spark, table)} == {
        None, *(i for i in range(40) if i % 4 and i != 2)}


def test_staging_is_merged_once_and_emptied(spark, table, tmp_path):
    staging = str(tmp_path / "staging")
    spark.createDataFrame([(1, 100, NEW, "2026-02")], SCHEMA).write.parquet(staging)
    stored.merge_staged(spark, staging, table, SCHEMA, ["k", "month"], "month", "nothing staged")
    assert (1, 100, "2026-02") in content(spark, table)
    left = spark.read.parquet(staging)
    assert left.count() == 0 and left.columns == ["k", "v", "updated_at", "month"]
    before = files_of(table)
    with pytest.raises(ValueError, match="nothing staged"):
        stored.merge_staged(spark, staging, table, SCHEMA, ["k", "month"], "month", "nothing staged")
    assert files_of(table) == before
