import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.plans import capacity
from mailgrid.sources.pages import flatten_items

WEEKS = [dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 9)]


def geo(spark):
    data = [(c, "R", p, p, 1, Decimal("0.5")) for c, p in
            [("1", "A"), ("2", "B"), ("3", "C"), ("4", "D"), ("5", "E")]]
    return spark.createDataFrame(data, schemas.GEO)


def run_capacity(spark):
    flags = {"A": [True, True], "B": [False, False], "C": [True, False], "D": [None, True]}
    data = [
        ("K", week, week + dt.timedelta(days=6), 10, 0, 0, "R", province, True, True, week, flag, 1)
        for province, values in flags.items() for week, flag in zip(WEEKS, values)
    ]
    return spark.createDataFrame(data, schemas.RUN_CAPACITY)


def postal(spark):
    own = dt.datetime(2026, 1, 1)
    data = [("K", code, 7, 9, own, None, "890") for code in "12345"] + [
        ("X", "1", 7, 9, own, None, "890"), ("K", "3", None, 9, own, None, None),
        ("K", "9", 1, 2, own, None, None)]
    return spark.createDataFrame(data, schemas.POSTAL_CAPACITY)


def test_assignment_cases(spark, rows):
    out = capacity.assign_capacity(postal(spark), run_capacity(spark), geo(spark), [1])
    own, w1, w2 = dt.datetime(2026, 1, 1), *WEEKS
    assert rows(out, "courier", "postal_code", "capacity", "peak_capacity", "from_ts", "is_default") == sorted([
        ("K", "1", 7, 7, own, True),
        ("K", "2", 9, 9, own, False),
        ("K", "3", 7, 7, w1, True), ("K", "3", 9, 9, w2, False),
        ("K", "3", None, None, w1, True), ("K", "3", 9, 9, w2, False),
        ("K", "4", 0, 0, w1, None), ("K", "4", 7, 7, w2, True),
        ("K", "5", 7, 9, own, True),
        ("K", "9", 1, 2, own, True),
        ("X", "1", 7, 9, own, True),
    ], key=lambda r: [(v is None, str(v)) for v in r])
    outputs = capacity.capacity_outputs(out, "2026-02-10")
    assert outputs["table"].count() == 11 and outputs["modified"].count() == 3
    assert {r.run_id for r in outputs["table"].collect()} == {1}


def runs(spark, *ids, month="2026-06", kind="BAU", run_type="Manuale"):
    data = [(i, "r", None, None, None, None, month, kind, run_type) for i in ids]
    return spark.createDataFrame(data, schemas.RUNS)


def test_each_run_is_assigned_on_its_own(spark, rows):
    """Province A is all default in run 1 and all peak in run 2: mixed in neither."""
    one = run_capacity(spark).filter("province = 'A'")
    both = one.unionByName(one.withColumns({"run_id": F.lit(2), "is_default": F.lit(False)}))
    place = postal(spark).filter("courier = 'K' and postal_code = '1'")
    out = capacity.assign_capacity(place, both, geo(spark), [1, 2, 3])
    assert rows(out, "run_id", "capacity", "peak_capacity", "is_default") == [
        (1, 7, 7, True), (2, 9, 9, False), (3, 7, 9, True)]


def test_uncovered(spark, rows):
    out = capacity.uncovered_capacity(postal(spark), run_capacity(spark), geo(spark), [1])
    assert rows(out, "courier", "postal_code") == [("K", "5"), ("K", "9"), ("X", "1")]


def page(spark, body, **keep):
    return spark.createDataFrame([(body, *keep.values())], ["body", *keep])


def test_normalize_capacity_keeps_open_rows_with_group_maximum(spark):
    body = """{"items": [
        {"pk": "p", "capacity": 5, "peakCapacity": 8, "geoKey": "A", "products": ["890"],
         "unifiedDeliveryDriver": "K"},
        {"capacity": 9, "pk": "p", "activationDateTo": "2026-02-05", "geoKey": "A", "products": []},
        {"pk": "closed", "capacity": 1, "activationDateTo": "2026-02-05"}]}"""
    items = flatten_items(page(spark, body, week=dt.date(2026, 2, 2)), schemas.CAPACITY_ITEM, keep=["week"])
    out = capacity.normalize_capacity(items, "2026-02-10 00:00:00").collect()
    assert len(out) == 1
    r = out[0]
    assert (r.capacity, r.production_capacity, r.p890, r.p_ar, r.courier) == (5, 9, True, False, "K")
    assert (r.from_ts, r.to_ts) == (dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 8))


def used(spark, weeks, run_type, kind="BAU"):
    cells = spark.createDataFrame(
        [(1, c, "A", w, 5) for w in weeks for c in ("K", "Z")],
        "run_id int, courier string, province string, week date, capacity bigint")
    processed = spark.createDataFrame([(1, w) for w in weeks], "run_id int, week date")
    runs = spark.createDataFrame([(1, run_type, kind)], "run_id int, run_type string, capacity_type string")
    declared = spark.createDataFrame([("K",)], "courier string")
    return capacity.used_capacity(cells, processed, runs, declared, geo(spark), "2026-03-01")


def mondays(n, start=dt.date(2026, 2, 2)):
    return [start + dt.timedelta(days=7 * i) for i in range(n)]


def test_used_capacity_weeks(spark, rows):
    assert used(spark, mondays(7), "Automatizzata").count() == 7
    # second Monday of March 2026 is the 9th
    manual = used(spark, mondays(7), "Manuale", "Picco")
    assert rows(manual, "from_ts", "to_ts", "is_default", "region") == [
        (dt.datetime(2026, 3, d), dt.datetime(2026, 3, d + 6, 23, 59, 59), False, "R") for d in (16, 9)
    ][::-1]
    assert used(spark, mondays(5), "Manuale").count() == 0


def test_recording_replaces_open_rows_of_manual_runs(spark, rows):
    old = run_capacity(spark).withColumn("to_ts", F.when(F.col("province") != "A", F.col("to_ts")))
    new = used(spark, mondays(7), "Manuale")
    out = capacity.record_used_capacity(old, new, runs(spark, 1))
    assert out.count() == 6 + 2
    automated = runs(spark, 1, run_type="Automatizzata")
    assert capacity.record_used_capacity(old, new, automated).count() == 8 + 2


def test_sheet_months(spark, rows):
    days = ["2026-06-01", "2026-06-08", "2026-07-06", "2026-07-13", "2026-07-01"]
    setting = spark.createDataFrame(
        [("K", dt.datetime.fromisoformat(d), None, 1, 2, None, 9, 100, "R", "A", "A", True, False, 6) for d in days],
        "courier string, from_ts timestamp_ntz, to_ts timestamp_ntz, capacity int, peak_capacity int, "
        "production_capacity int, sum_weekly int, sum_monthly int, region string, province string, "
        "province_name string, p890 boolean, p_ar boolean, month_delivery int")
    out = capacity.capacity_sheet(setting)
    assert rows(out, "from_ts", "month", "weekly", "product", "production_capacity") == [
        (dt.datetime(2026, 6, 8), "2026-06", 50, "890", 0),
        (dt.datetime(2026, 7, 6), "2026-06", 50, "890", 0)]


def test_rs_capacity(spark, rows):
    def row(day, p890, p_rs):
        start = dt.datetime(2026, 6, day)
        return (3, "A", "t", p890, False, p_rs, "t", "K", start, 5, start, None, "pk", 4, start)

    declared = spark.createDataFrame(
        [row(1, False, True), row(8, False, True), row(8, True, True), row(8, False, False), row(15, False, True)],
        schemas.DECLARED_CAPACITY)
    for kind, value, flag in [("BAU", 3, True), ("Combinata", 3, True), ("Picco", 5, False)]:
        out = capacity.rs_capacity(declared, runs(spark, 5, kind=kind), "2026-06-01")
        assert rows(out, "run_id", "from_ts", "to_ts", "capacity", "is_default") == [
            (5, dt.datetime(2026, 6, 8), None, value, flag)]
    assert capacity.rs_capacity(declared, runs(spark, 5, month="2026-07"), "2026-06-01").count() == 0
