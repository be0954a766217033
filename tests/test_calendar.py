"""Calendar columns against Python's calendar, day by day."""

import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailgrid.functions import calendar as cal
from mailgrid.plans.pieces import month_weeks
from mailgrid.schemas import MONTH_NAMES


@pytest.fixture(scope="module")
def days(spark):
    span = (dt.date(2035, 12, 31) - dt.date(2020, 1, 1)).days + 1
    return spark.range(span).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d")
    )


def monday_from(day):
    return day + dt.timedelta(days=-day.weekday() % 7)


def shift(day, months):
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return dt.date(year, month + 1, 1)


def test_single_dates(days):
    out = days.select(
        "d",
        cal.week_start("d").alias("week"),
        cal.next_monday("d").alias("label"),
        cal.monday_on_or_after("d").alias("monday"),
        cal.first_sim_monday("d").alias("sim"),
        cal.nth_monday("d", 1).alias("next1"),
        cal.nth_monday("d", 1, 2).alias("next2"),
        cal.nth_monday("d", 2).alias("after"),
        cal.future_mondays("d").alias("future"),
    ).collect()
    for r in out:
        assert r.week == r.d - dt.timedelta(days=r.d.weekday())
        assert r.label == r.week + dt.timedelta(days=7)
        assert r.monday == monday_from(r.d)
        first = monday_from(r.d.replace(day=1))
        assert r.sim == (first + dt.timedelta(days=7) if first.day == 1 else first)
        assert r.next1 == monday_from(shift(r.d, 1))
        assert r.next2 == r.next1 + dt.timedelta(days=7)
        assert r.after == monday_from(shift(r.d, 2))
        mondays = [
            x
            for x in calendar.Calendar().itermonthdates(r.d.year, r.d.month)
            if x.weekday() == 0 and x.month == r.d.month and x >= r.d
        ]
        if mondays:
            assert r.future == mondays + [mondays[-1] + dt.timedelta(days=7)]


def test_weeks_of_every_month(days):
    found = {}
    for r in month_weeks(days.select(F.trunc("d", "month").alias("month")).distinct()).collect():
        found.setdefault(r.month, []).append(r)
    assert len(found) == 16 * 12
    for month, weeks in found.items():
        weeks.sort(key=lambda r: r.week_no)
        rows = calendar.monthcalendar(month.year, month.month)
        assert [r.days for r in weeks] == [sum(1 for d in week if d) for week in rows]
        assert [r.week_start.day for r in weeks] == [min(d for d in week if d) for week in rows]
        assert [r.is_last for r in weeks] == [False] * (len(rows) - 1) + [True]
        assert {r.days_in_month for r in weeks} == {calendar.monthrange(month.year, month.month)[1]}


@pytest.mark.parametrize(
    "day, cutoff, ahead, wanted",
    [
        ("2026-01-15", 15, 0, "2026-01-01"),
        ("2026-01-16", 15, 0, "2026-02-01"),
        ("2026-12-20", 15, 1, "2027-02-01"),
        ("2026-01-31", 28, 1, "2026-02-01"),
    ],
)
def test_cut_off_day(spark, day, cutoff, ahead, wanted):
    df = spark.range(1).select(cal.sim_month(F.lit(day), cutoff, ahead).cast("string").alias("m"))
    assert df.first().m == wanted


def test_window_ends_and_labels(spark):
    start = F.lit("2026-02-02 00:00:00").cast("timestamp_ntz")
    kinds = ["six_days", "last_second", "next_week", "end_of_sunday"]
    row = spark.range(1).select(
        *[cal.window_end(start, k).cast("string").alias(k) for k in kinds],
        cal.month_label(start, MONTH_NAMES).alias("label"),
        cal.month_from_key(F.lit("2026-02")).cast("string").alias("first"),
    )
    assert tuple(row.first()) == (
        "2026-02-08 00:00:00",
        "2026-02-08 23:59:59",
        "2026-02-09 00:00:00",
        "2026-02-08 23:59:59",
        "Febbraio 2026",
        "2026-02-01",
    )
