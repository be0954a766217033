"""A third of all rows under one key: AQE has to split the join, and nothing may be lost."""

import datetime as dt
from contextlib import contextmanager
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.operators import merge
from mailgrid.plans import capacity, pieces

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(df):
    """Rows, and whether AQE split a skewed join."""
    rows = df.collect()
    return rows, "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def geo(spark):
    data = [(f"{i:05d}", "R", f"P{i % 50}", f"P{i % 50}", 1, Decimal("0.1")) for i in range(500)]
    return spark.createDataFrame(data, schemas.GEO)


def hot(n, cold):
    """Key column: a third of the ids share one key."""
    return F.when(F.col("id") % 3 == 0, F.lit("P0")).otherwise(
        F.concat(F.lit("P"), (F.col("id") % cold).cast("string"))
    )


def test_allocation(spark, geo):
    with small_partitions(spark):
        weekly = spark.range(60000, numPartitions=8).select(
            F.col("id").cast("string").alias("key"), hot(60000, 50).alias("province"),
            F.lit(7).cast("bigint").alias("pieces"))
        out = pieces.allocate_largest_remainder(weekly, geo).groupBy("key").agg(
            F.sum("allocated").alias("n"))
        rows, split = run(out)
    assert split and len(rows) == 60000 and {r.n for r in rows} == {7}


def test_assignment(spark, geo):
    with small_partitions(spark):
        postal = spark.range(60000, numPartitions=8).select(
            F.lit("K").alias("courier"),
            F.when(F.col("id") % 3 == 0, "00000")
            .otherwise(F.lpad((F.col("id") % 500).cast("string"), 5, "0")).alias("postal_code"),
            F.col("id").cast("int").alias("capacity"), F.lit(-1).alias("peak_capacity"),
            F.lit(None).cast("timestamp_ntz").alias("from_ts"),
            F.lit(None).cast("timestamp_ntz").alias("to_ts"), F.lit(None).cast("string").alias("products"))
        weeks = [dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 9)]
        run_capacity = spark.createDataFrame(
            [("K", w, None, 1, 0, 0, "R", "P0", True, True, w, w == weeks[0], 1) for w in weeks],
            schemas.RUN_CAPACITY)
        rows, split = run(capacity.assign_capacity(postal, run_capacity, geo, [1]))
    hot_rows = sum(1 for i in range(60000) if i % 3 == 0 or i % 500 % 50 == 0)
    assert split and len(rows) == 60000 + hot_rows
    assert sum(r.capacity == -1 for r in rows) == hot_rows


def test_merge_with_a_hot_target_key(spark):
    with small_partitions(spark):
        old = dt.datetime(2026, 1, 1)
        target = spark.range(60000, numPartitions=8).select(
            hot(60000, 5000).alias("k"), F.col("id").alias("v"),
            F.lit(old).cast("timestamp_ntz").alias("updated_at"))
        source = spark.range(3000, numPartitions=4).select(
            F.concat(F.lit("P"), F.col("id").cast("string")).alias("k"), F.lit(-1).cast("bigint").alias("v"),
            F.lit(dt.datetime(2026, 1, 2)).cast("timestamp_ntz").alias("updated_at")).unionByName(
            spark.createDataFrame([("new", -1, old)], "k string, v bigint, updated_at timestamp_ntz"))
        rows, split = run(merge.merge_upsert(target, source, ["k"]))
    updated = sum(1 for i in range(60000) if i % 3 == 0 or i % 5000 < 3000)
    assert split and len(rows) == 60001
    assert sum(r.v == -1 for r in rows) == updated + 1


@pytest.mark.parametrize("weights", ["equal", "different"])
@pytest.mark.parametrize("sorted_codes", [100, 4096])
def test_one_province_with_most_codes(spark, monkeypatch, weights, sorted_codes):
    """90 % of the codes lie in one province: no task may hold them, results stay exact."""
    monkeypatch.setattr(pieces, "SORTED_CODES", sorted_codes)
    codes = 3000
    share = "1e-4" if weights == "equal" else "(1 + id % 97) * 1e-6"
    geo = spark.range(codes, numPartitions=4).selectExpr(
        "lpad(cast(id as string), 5, '0') as postal_code", "'R' as region",
        "if(id % 10 = 0, 'cold', 'hot') as province", "if(id % 10 = 0, 'cold', 'hot') as province_name",
        "1 as pop", f"cast({share} as decimal(11,9)) as share")
    wanted = [(str(n), p, n) for p in ("hot", "cold") for n in (1, 7, 250, 5000)]
    weekly = spark.createDataFrame(wanted, "key string, province string, pieces bigint")
    with small_partitions(spark):
        table = pieces.allocation_table(weekly, geo)
        got = {(r.province, r.pieces, r.postal_code): r.allocated for r in table.collect()}
    unit = 1_000_000_000
    for _, province, n in wanted:
        rows = []
        for i in range(codes):
            if (i % 10 == 0) == (province == "cold"):
                w = 100_000 if weights == "equal" else (1 + i % 97) * 1000
                rows.append((f"{i:05d}", n * w // unit, n * w % unit))
        rows.sort(key=lambda r: (-r[2], r[0]))
        open_ = n - sum(r[1] for r in rows)
        expected = {
            code: base + (place < open_) for place, (code, base, _) in enumerate(rows)
            if base + (place < open_) > 0
        }
        assert {c: v for (p, m, c), v in got.items() if (p, m) == (province, n)} == expected


def test_assignment_is_unfolded_by_all_tasks(spark):
    """The join turns few bytes into many rows: whichever side Spark broadcasts, the rows come
    from all tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        geo = spark.range(3000).selectExpr(
            "lpad(cast(id as string), 5, '0') as postal_code", "'R' as region",
            "concat('P', id % 50) as province", "concat('P', id % 50) as province_name",
            "1 as pop", "cast(0.1 as decimal(11,9)) as share")
        postal = geo.selectExpr(
            "concat('K', cast(postal_code as int) % 7) as courier", "postal_code", "1 as capacity",
            "2 as peak_capacity", "cast(null as timestamp_ntz) as from_ts",
            "cast(null as timestamp_ntz) as to_ts", "cast(null as string) as products")
        weeks = [dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 9)]
        run_capacity = spark.createDataFrame(
            [(f"K{k}", w, None, 1, 0, 0, "R", f"P{p}", True, True, w, w == weeks[0], 1)
             for k in range(7) for p in range(50) for w in weeks], schemas.RUN_CAPACITY)
        out = capacity.assign_capacity(postal, run_capacity, geo, [1, 2])
        tasks = out.groupBy(F.spark_partition_id()).count().collect()
        lacking = capacity.uncovered_capacity(postal, run_capacity, geo, [1, 2])
        others = lacking.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(t["count"] for t in tasks) == 9000 and len(tasks) > 4
    assert sum(t["count"] for t in others) == 3000 and len(others) > 4


def test_a_demand_meets_the_codes_it_reaches(spark, monkeypatch):
    """Demands are joined by blocks of ranks, not with all codes of the province."""
    geo = spark.range(50).selectExpr(
        "lpad(cast(id as string), 5, '0') as postal_code", "'R' as region", "'P' as province",
        "'P' as province_name", "1 + id % 7 as pop", "cast((1 + id % 7) * 1e-3 as decimal(11,9)) as share")
    demand = spark.createDataFrame(
        [("P", n) for n in (*range(-1, 15), 49, 50, 51, 1000)] + [("none", 5), (None, 5), ("P", None)],
        "province string, pieces bigint")
    one = pieces.allocation_table(demand, geo, "pop").collect()
    monkeypatch.setattr(pieces, "RANK_BLOCK", 3)
    table = pieces.allocation_table(demand, geo, "pop")
    assert "_block" in table._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(table.collect()) == sorted(one)
    sums = {}
    for r in one:
        sums[r.pieces] = sums.get(r.pieces, 0) + r.allocated
    assert sums == {n: n for n in (*range(1, 15), 49, 50, 51, 1000)}
