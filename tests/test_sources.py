import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.plans import pieces
from mailgrid.sources import files, manifest, pages, tables


def data_rows(path):
    with open(path) as f:
        return max(sum(1 for _ in f) - 1, 0)


def test_read_table_pushes_the_filter_down(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.range(10).select(F.col("id").cast("int").alias("run_id"), F.lit("x").alias("wide"))
    tables.append_table(df, folder, "t")
    tables.append_table(df, folder, "t")
    out = tables.read_table(spark, folder, "t", F.col("run_id") == 3).select("run_id")
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run_id,3)" in plan and "wide" not in plan


def test_reload_dim(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("cap,reg,prov,sigla,pop,perc\n00010,Lazio,Roma,RM,5,0.250000000\n")
    tables.reload_dim(spark, str(path), str(tmp_path), "geo", schemas.GEO)
    tables.reload_dim(spark, str(path), str(tmp_path), "geo", schemas.GEO)
    row = tables.read_table(spark, str(tmp_path), "geo").collect()
    assert len(row) == 1 and row[0].postal_code == "00010" and str(row[0].share) == "0.250000000"


def test_csv_batches_hold_at_most_max_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(2500, numPartitions=2).select(F.col("id").alias("a"), (F.col("id") % 3).alias("w"))
    files.write_csv_batches(df, path, max_rows=500, by="w")
    written = glob.glob(f"{path}/w=*/*.csv")
    assert sum(map(data_rows, written)) == 2500 and max(map(data_rows, written)) <= 500
    files.write_csv_batches(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).count() == 0


def test_capacity_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "cap")
    data = [("K", "00010", 5, 6, dt.datetime(2026, 2, 2), None, None)]
    df = spark.createDataFrame(data, schemas.POSTAL_CAPACITY)
    files.write_csv_batches(files.postal_capacity_rows(df), path)
    out = files.read_capacity_csv(spark, path)
    assert [tuple(r) for r in out.collect()] == data
    assert [t for _, t in out.dtypes] == [t for _, t in df.dtypes]


def test_province_export(spark, rows):
    day = dt.datetime(2026, 2, 2)

    def row(end, p890, p_ar, default, run=1):
        return ("K", day, end, 5, 0, 0, "R", "A", p890, p_ar, day, default, run)

    df = spark.createDataFrame(
        [row(day, True, True, True), row(None, None, True, False), row(day, None, None, False),
         row(day, True, None, None, 2)], schemas.RUN_CAPACITY)
    out = files.province_capacity_rows(df, 1)
    start = "2026-02-02T00:00:00.000Z"
    assert rows(out, "peakCapacity", "activationDateFrom", "activationDateTo", "products") == [
        (5, start, start, "890,AR,RS"), (5, start, None, "AR,RS")]
    assert files.province_capacity_rows(df, modified_only=True).count() == 1


def test_latest_snapshot(spark, tmp_path):
    base = str(tmp_path)
    for day, month, n in [("2026-01-10", "2026-02", 1), ("2026-01-20", "2026-02", 2),
                          ("2026-01-25", "2026-03", 3), ("2026-02-20", "2026-02", 4)]:
        files.write_snapshot(spark.range(n), base, day, month)

    def rows_found(as_of, **kw):
        return files.read_latest_snapshot(spark, base, "2026-02", as_of, **kw).count()

    assert rows_found("2026-01-19") == 1
    assert rows_found("2026-01-20") == 2
    assert rows_found("2026-02-18") == 2  # 30 days, both ends included
    with pytest.raises(FileNotFoundError):
        rows_found("2026-02-19")
    assert rows_found("2026-02-19", required=False) == 0
    files.write_snapshot(spark.range(9), base, "2026-01-21", "2026-10")
    with pytest.raises(FileNotFoundError):  # a month is compared whole
        files.read_latest_snapshot(spark, base, "2026-1", "2026-01-21")
    out = files.read_latest_snapshot(spark, base, "2026-02", "2026-01-20")
    assert "PartitionFilters: [" in out._jdf.queryExecution().executedPlan().toString()


def test_latest_extract_folder(spark, tmp_path):
    base = str(tmp_path)

    def latest(as_of, **kw):
        return files.latest_extract_folder(spark, base, "2026-02", as_of, **kw)

    assert latest("2026-01-25", required=False) is None
    for day, month, name in [("2026/01/10", "2026-02", "a.csv"), ("2026/01/20", "2026-02", "b.csv"),
                             ("2026/01/22", "2026-02", "note.txt"), ("2026/01/25", "2026-03", "c.csv")]:
        folder = tmp_path / day / month / "cap_capacities"
        folder.mkdir(parents=True)
        (folder / name).write_text("x\n")
    assert latest("2026-01-25") == f"{base}/2026/01/20/2026-02"
    assert latest("2026-01-19") == f"{base}/2026/01/10/2026-02"
    with pytest.raises(FileNotFoundError):
        latest("2026-02-19")


def test_flatten_items_by_name(spark, rows):
    docs = [{"items": [{"b": "x", "a": 1}, {"a": 2}], "lastEvaluatedKey": {"k": 1}}, {"items": []}, {}]
    df = spark.createDataFrame([(json.dumps(d), "w") for d in docs], "body string, week string")
    out = pages.flatten_items(df, "a int, b string, c string", {"b": ""}, keep=["week"])
    assert rows(out) == [("w", 1, "x", None), ("w", 2, "", None)]


def test_malformed_page_fails(spark):
    df = spark.createDataFrame([("{oops",)], "body string")
    with pytest.raises(Exception, match="MALFORMED"):
        pages.flatten_items(df, "a int").collect()
    assert pages.flatten_items(df, "a int", on_bad="PERMISSIVE").count() == 0


def test_week_manifest(spark, tmp_path):
    for folder, name in [("2026-02-09", "a.csv"), ("2026-02-09", "b.csv"), ("2026-02-16", "c.csv"),
                         ("cap_capacities", "d.csv"), ("2026-02-16", "note.txt")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x\n")
    counts = manifest.manifest_counts(manifest.week_manifest(spark, str(tmp_path)))
    found = {r.week_no: (r.week and str(r.week), r.files, r.bytes) for r in counts.collect()}
    assert found == {1: ("2026-02-09", 2, 4), 2: ("2026-02-16", 1, 2), 3: (None, 0, 0),
                     4: (None, 0, 0), 5: (None, 0, 0), 6: (None, 0, 0)}


def test_reconcile(spark, rows):
    def names(*n):
        return spark.createDataFrame([(x,) for x in n], "file_name string")

    out = manifest.reconcile_manifest(names("a", "b"), names("b", "c", "c"))
    assert rows(out) == [("a", 1, 0, "missing"), ("b", 1, 1, "loaded"), ("c", 0, 2, "unexpected")]
    with pytest.raises(ValueError):
        manifest.require_complete(out)
    manifest.require_complete(manifest.reconcile_manifest(names("a"), names("a")))


def test_export_pieces_by_week(spark, tmp_path):
    allocated = spark.createDataFrame(
        [("k", "890", "S", "P", "00001", 0, dt.date(2026, 2, 1), 3),
         ("k", "890", "S", "P", "00001", 0, dt.date(2026, 2, 2), 1200)],
        "key string, product string, sender string, province string, postal_code string, "
        "attempt int, week date, allocated bigint")
    base = str(tmp_path / "p")
    pieces.export_pieces(pieces.explode_pieces(allocated), base, max_rows=500)
    sizes = {}
    for path in glob.glob(f"{base}/week_label=*/*.csv"):
        sizes.setdefault(path.split("week_label=")[1][:10], []).append(data_rows(path))
    assert sum(sizes["2026-02-02"]) == 3 and sum(sizes["2026-02-09"]) == 1200
    assert max(sizes["2026-02-09"]) <= 500
    header = open(glob.glob(f"{base}/week_label=2026-02-02/*.csv")[0]).readline()
    assert header.startswith('"requestId";"notificationSentAt"')


def test_damaged_pages_are_handed_over(spark, rows):
    bodies = ['{"items": [{"a": 1}, {"a": 2}]}', '{"items": [{"a": "x"}, {"a": 3}]}', "{broken",
              "{}", None, '{"items": []}', '{"items": null}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "no int, body string")
    items, rejected = pages.split_pages(df, "a int", keep=["no"])
    assert rows(items, "no", "a") == [(0, 1), (0, 2)]
    assert rows(rejected, "no", "reason") == [
        (1, "malformed"), (2, "malformed"), (3, "no items"), (4, "no body"), (6, "no items")]
    assert {r.no: r.body for r in rejected.collect()} == {i: bodies[i] for i in (1, 2, 3, 4, 6)}


def test_reconcile_files_finds_lost_and_partial_ones(spark, tmp_path):
    base = tmp_path / "in"
    for name, n in [("2026-02-02/a.csv", 3), ("2026-02-02/b.csv", 2), ("2026-02-09/c.csv", 0)]:
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("k;v\n" + "".join(f"{i};{i}\n" for i in range(n)))
    listed = manifest.listed_rows(spark, str(base))
    read = spark.read.option("recursiveFileLookup", True).option("header", True).option("sep", ";")
    all_rows = read.schema("k int, v int").csv(str(base))

    def status(loaded):
        found = manifest.reconcile_files(listed, manifest.loaded_rows(loaded))
        return {r.file and r.file[-5:]: r.status for r in found.collect()}

    every = {"a.csv": "loaded", "b.csv": "loaded", "c.csv": "loaded"}
    assert status(all_rows) == every
    assert status(all_rows.filter("k < 2")) == every | {"a.csv": "partial"}
    lost = all_rows.filter(~F.col("_metadata.file_path").endswith("b.csv"))
    assert status(lost) == every | {"b.csv": "missing"}
    (tmp_path / "e.csv").write_text("k;v\n1;1\n")
    more = read.schema("k int, v int").csv(str(tmp_path))
    assert status(more) == every | {"e.csv": "unexpected"}


def test_export_moves_allocated_rows_not_pieces(spark, tmp_path):
    """The weeks' pieces are written where they unfold, compressed, with all rows and batches."""
    allocated = spark.createDataFrame(
        [("k", "890", "S", "P", f"{i:05d}", 0, dt.date(2026, 2, 2) + dt.timedelta(7 * (i % 3)), 700)
         for i in range(9)],
        "key string, product string, sender string, province string, postal_code string, "
        "attempt int, week date, allocated bigint")
    base, plain = str(tmp_path / "z"), str(tmp_path / "p")
    pieces.export_allocation(allocated, base, max_rows=500, compression="gzip")
    pieces.export_allocation(allocated, plain, max_rows=500)
    read = spark.read.option("sep", ";").option("header", True)
    for folder, ending in ((base, ".csv.gz"), (plain, ".csv")):
        found = glob.glob(f"{folder}/week_label=*/*.csv*")
        assert found and all(f.endswith(ending) for f in found)
        back = read.csv(folder)
        assert (back.count(), back.select("requestId").distinct().count()) == (6300, 6300)
        assert {r["count"] for r in back.groupBy("week_label").count().collect()} == {2100}
    assert max(data_rows(f) for f in glob.glob(f"{plain}/week_label=*/*.csv")) <= 500
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0


def test_snapshots_of_placed_rows(spark, tmp_path):
    """Placed rows go from their tasks into the folders of their day and month."""
    df = spark.range(600, numPartitions=3).selectExpr(
        "id", "concat('2026-01-', 10 + id % 2) as extract_date", "concat('2026-0', 1 + id % 3) as month")
    for placed in (True, False):
        base = str(tmp_path / str(placed))
        files.write_snapshots(df, base, placed)
        found = files.read_latest_snapshot(spark, base, "2026-02", "2026-01-20")
        assert {r.id for r in found.collect()} == {i for i in range(600) if i % 3 == 1 and i % 2}
        assert len(glob.glob(f"{base}/extract_date=*/month=*")) == 6
    assert len(glob.glob(f"{tmp_path}/True/*/*/*.parquet")) == 18
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0


def test_manifest_and_rows_of_compressed_weeks(spark, tmp_path):
    """Compressed files are listed and counted like the others."""
    base = str(tmp_path)
    rows = spark.range(70, numPartitions=2).selectExpr(
        "id as key", "date_add(date'2026-02-02', cast(id % 2 * 7 as int)) as week_label")
    files.write_by_week(rows, base, compression="gzip", placed=True)
    listed = manifest.listed_rows(spark, base).collect()
    assert len(listed) == 4 and all(r.file.endswith(".csv.gz") for r in listed)
    assert sorted((str(r.week), r.listed) for r in listed) == sorted(
        [("2026-02-02", 18), ("2026-02-09", 17), ("2026-02-02", 17), ("2026-02-09", 18)])
    counts = manifest.manifest_counts(manifest.week_manifest(spark, base))
    assert {r.week_no: r.files for r in counts.collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}


def test_weeks_are_dealt_over_few_tasks(spark, tmp_path):
    """With ``by`` a task has the weeks of its share only, and all rows come."""
    geo = spark.range(30).selectExpr(
        "lpad(cast(id as string), 5, '0') as postal_code", "'R' as region", "'P' as province",
        "'P' as province_name", "1 + id % 7 as pop", "cast(0.1 as decimal(11,9)) as share")
    weekly = spark.range(64).selectExpr(
        "concat('k', id) as key", "'P' as province", "date_add(date'2026-02-02', cast(id * 7 as int)) as week",
        "10 + id as pieces")
    out = pieces.allocate_largest_remainder(weekly, geo, "pop", by="week")
    found = out.groupBy("key").agg(F.sum("allocated").alias("n")).collect()
    assert {r.key: r.n for r in found} == {f"k{i}": 10 + i for i in range(64)}
    tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("week").alias("n")).collect()
    assert len(tasks) > 4 and max(r.n for r in tasks) < 32
