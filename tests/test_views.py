import datetime as dt
from decimal import Decimal

from mailgrid import schemas
from mailgrid.plans import compare, results, views

STEP = {"p": schemas.STEP_PLANNED, "r": schemas.STEP_RESIDUAL}


def geo(spark):
    data = [("1", "R", "A", "A", 1, Decimal("0.5")), ("2", "R", "A", "A", 1, Decimal("0.5")),
            ("3", "R", "B", "B", 1, Decimal("1"))]
    return spark.createDataFrame(data, schemas.GEO)


def pieces(spark):
    w1, w2 = dt.date(2026, 2, 2), dt.date(2026, 2, 9)
    data = [("1", "S", "A", "K", "p", w1), ("1", "S", "A", "K", "p", w1), ("2", "S", "A", "K", "p", w2),
            ("3", "S", "B", "K", "r", w1), ("4", "S", "B", "K", "r", w2), ("5", "S", "Q", "K", "r", w2)]
    return spark.createDataFrame(
        [(i, s, p, c, STEP[x], w, 1) for i, s, p, c, x, w in data],
        "request_id string, sender string, province string, courier string, workflow_step string, "
        "week date, run_id int")


def test_results_count_requests_once(spark, rows):
    assert rows(results.results_by_sender(pieces(spark)), "week", "count_request") == [
        (dt.date(2026, 2, 2), 1), (dt.date(2026, 2, 9), 1)]
    assert rows(results.results_by_courier(pieces(spark), geo(spark)), "label", "count_request") == [
        ("A - K", 1), ("A - K", 1)]


def test_residuals_of_the_last_week(spark, rows):
    assert rows(results.residuals_by_sender(pieces(spark)), "count_residual") == [(2,)]
    assert rows(results.residuals_by_courier(pieces(spark), geo(spark)), "province", "count_residual") == [("B", 1)]
    assert results.residual(pieces(spark), last_week_only=False).count() == 3


def declared(spark, *starts, p890=True, p_ar=False):
    data = []
    for text in starts:
        start = dt.datetime.fromisoformat(text)
        data.append((3, "A", "t", p890, p_ar, True, "t", "K", start, 5, start, None, "pk", 4, start))
    return spark.createDataFrame(data, schemas.DECLARED_CAPACITY)


def estimates(spark, *items):
    data = [("pk", dt.date.fromisoformat(d), 1, m, m, s, p, "A", dt.datetime(2026, 1, u)) for s, p, d, m, u in items]
    return spark.createDataFrame(data, schemas.ESTIMATES)


def test_setting_window_has_both_boundary_mondays(spark, rows):
    cap = declared(spark, "2026-01-26", "2026-02-02", "2026-02-23", "2026-03-02", "2026-03-02 08:00:00", "2026-03-09")
    est = estimates(spark, ("S", "890", "2026-02-01", 10, 1), ("S", "890", "2026-03-01", 7, 1))
    out = views.capacity_setting(cap, est, geo(spark))
    assert rows(out, "from_ts", "month_delivery", "sum_monthly") == [
        (dt.datetime(2026, 2, 2), 2, 10), (dt.datetime(2026, 2, 23), 2, 10),
        (dt.datetime(2026, 3, 2), 2, 10), (dt.datetime(2026, 3, 2), 3, 7),
        (dt.datetime(2026, 3, 2, 8), 3, 7), (dt.datetime(2026, 3, 9), 3, 7)]


def test_setting_products(spark, rows):
    est = estimates(spark, ("S", "890", "2026-02-01", 10, 1), ("S", "AR", "2026-02-01", 5, 1),
                    ("S", "AR", "2026-02-01", 6, 2), ("T", "AR", "2026-02-01", 1, 1), ("S", "RS", "2026-02-01", 99, 1))
    for flags, total in [((True, False), [(10,)]), ((False, True), [(7,)]), ((True, True), [(17,)]),
                         ((False, False), []), ((None, True), [(7,)])]:
        cap = declared(spark, "2026-02-09", p890=flags[0], p_ar=flags[1])
        assert rows(views.capacity_setting(cap, est, geo(spark)), "sum_monthly") == total


def result_rows(spark, counts, run=1, start=dt.date(2026, 2, 2)):
    data = [(run, "A", "R", "K", start + dt.timedelta(days=7 * i), "A - K", n) for i, n in enumerate(counts)]
    return spark.createDataFrame(
        data, "run_id int, province string, region string, courier string, week date, label string, count_request bigint")


def test_peaks(spark, rows):
    week = dt.datetime(2026, 2, 2)

    def capacity(value):
        return spark.createDataFrame(
            [("K", week, None, value, 0, 0, "R", "A", True, True, week, True, 1)], schemas.RUN_CAPACITY)

    for value, peak in [(9, 1), (10, 1), (11, 0), (None, 0)]:
        out = views.peak_table(result_rows(spark, [10, 99]), capacity(value))
        assert rows(out, "peak") == [(peak,)]


def test_peak_bands(spark):
    peaks = spark.createDataFrame(
        [(1, f"P{i}", r, "K", int(i < n)) for r, n in [("none", 0), ("low", 1), ("half", 2), ("all", 4)] for i in range(4)],
        "run_id int, province string, region string, courier string, peak int")
    found = {r.region: (r.peak_share, r.band) for r in views.peak_map(peaks).collect()}
    assert found == {"none": (0.0, "No picchi"), "low": (0.25, "<50% picchi"),
                     "half": (0.5, ">=50% picchi"), "all": (1.0, ">=50% picchi")}


def test_courier_summary(spark, rows):
    left = spark.createDataFrame([(1, "A", "R", "K", "A - K", 4)],
                                 "run_id int, province string, region string, courier string, label string, count_residual bigint")
    out = views.courier_summary(result_rows(spark, [1, 2, 3, 4, 5, 6, 7]), left)
    assert rows(out, "sum_request", "avg_request", "sum_after_5", "sum_residual") == [(28, 4.0, 13, 4)]
    out = views.courier_summary(result_rows(spark, [1, 2, 3, 4, 6]), left.limit(0))
    assert rows(out, "sum_request", "avg_request", "sum_after_5", "sum_residual") == [(16, 3.2, None, None)]


def test_courier_view_counts_two_flag_combinations_twice(spark, rows):
    cap = declared(spark, "2026-02-02").unionByName(declared(spark, "2026-02-09", p_ar=True))
    est = estimates(spark, ("S", "890", "2026-02-01", 10, 1), ("S", "AR", "2026-02-01", 3, 1))
    assert rows(views.courier_view(cap, est, geo(spark)), "product", "sum_monthly") == [("890", 20), ("AR", 3)]


def test_sender_view_keeps_positive_sums(spark, rows):
    est = estimates(spark, ("S", "890", "2026-02-01", 10, 1), ("S", "AR", "2026-02-01", 0, 1))
    assert rows(views.sender_view(est, geo(spark)), "region", "product", "sum_monthly") == [("R", "890", 10)]


def test_compare_two_runs(spark, rows):
    both = result_rows(spark, [1, 2]).unionByName(result_rows(spark, [5], 2, dt.date(2026, 2, 9))).unionByName(
        result_rows(spark, [7], 3))
    out = compare.compare_runs(both, 1, 2, ["label"])
    assert rows(out, "run_a", "run_b", "label", "week", "value_a", "value_b", "delta") == [
        (1, 2, "A - K", dt.date(2026, 2, 2), 1, None, -1), (1, 2, "A - K", dt.date(2026, 2, 9), 2, 5, 3)]


def test_overflow(spark, rows):
    # first Monday of March 2026 is the 2nd
    assert rows(compare.overflow_series(result_rows(spark, [1] * 5)), "overflows") == [(False,)]
    assert rows(compare.overflow_series(result_rows(spark, [1] * 6)), "overflows") == [(True,)]


def test_comparable_automated(spark):
    def run(i, kind, when, status="Lavorata"):
        return (i, f"r{i}", None, status, "Now", when and dt.datetime.fromisoformat(when), "2026-03", "BAU", kind)

    auto, manual = schemas.RUN_AUTOMATED, schemas.RUN_MANUAL
    runs = spark.createDataFrame([
        run(1, auto, "2026-03-09 05:00:00"), run(2, auto, "2026-03-18 05:00:00"),
        run(3, auto, "2026-03-02 05:00:00"), run(4, manual, "2026-03-20"), run(5, manual, "2026-04-01"),
        run(6, auto, "2026-03-09 07:00:00"), run(7, auto, "2026-03-25", "Bozza"), run(8, manual, None)],
        schemas.RUNS)
    found = {r.run_id: r.compare_with for r in compare.comparable_automated(runs).collect()}
    assert found == {1: 3, 2: 1, 3: None, 4: 2, 5: None, 6: 3, 7: None, 8: None}
    assert compare.comparable_runs(runs, runs.filter("run_id = 1")).count() == 6
    assert compare.non_draft_runs(runs).count() == 7
