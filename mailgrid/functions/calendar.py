"""Week and month arithmetic on date columns. Weeks run Monday to Sunday.

Every function takes and returns columns, so a calendar is computed next to the rows that
need it: no calendar table has to be joined in.
"""

from pyspark.sql import functions as F


def _date(col):
    return (F.col(col) if isinstance(col, str) else col).cast("date")


def week_start(col):
    """Monday of the week the date lies in."""
    return F.trunc(_date(col), "week")


def month_start(col, months=0):
    """First day of the month, ``months`` months away."""
    first = F.trunc(_date(col), "month")
    return F.add_months(first, months) if months else first


def monday_on_or_after(col):
    return F.next_day(F.date_sub(_date(col), 1), "MO")


def nth_monday(col, months=0, n=1):
    """The n-th Monday of the month that is ``months`` months after the date's month."""
    return F.date_add(monday_on_or_after(month_start(col, months)), 7 * (n - 1))


def first_sim_monday(col):
    """First simulated week of the date's month: a Monday on day 1 is passed over for day 8."""
    monday = nth_monday(col)
    return F.when(F.dayofmonth(monday) == 1, F.date_add(monday, 7)).otherwise(monday)


def sim_month(col, cutoff, ahead=0):
    """First day of the month to simulate: past the cut-off day it is the next month's turn."""
    day = F.add_months(_date(col), ahead)
    return month_start(F.when(F.dayofmonth(day) > cutoff, F.add_months(day, 1)).otherwise(day))


def next_monday(col):
    """Delivery-week label of a piece: the Monday after its prepare date."""
    return F.date_add(week_start(col), 7)


def future_mondays(col):
    """Array of the month's Mondays from the date on, and the first Monday after them."""
    start, end = monday_on_or_after(col), nth_monday(col, 1)
    return F.sequence(start, F.greatest(start, end), F.expr("interval 7 days"))


def weeks_in_month(col):
    """Number of weeks the month touches."""
    span = F.datediff(week_start(F.last_day(_date(col))), week_start(month_start(col)))
    return (span / 7 + 1).cast("int")


def first_week_days(col):
    """Days of the month's first week that lie in the month."""
    return 7 - F.weekday(month_start(col))


def week_in_month(col, number):
    """Start inside the month and days in the month of the month's week ``number``, from 1."""
    first, last = month_start(col), F.last_day(_date(col))
    monday = F.date_add(week_start(first), (F.lit(number) - 1) * 7)
    start = F.greatest(monday, first)
    return start, F.datediff(F.least(F.date_add(monday, 6), last), start) + 1


def days_in_month(col):
    return F.dayofmonth(F.last_day(_date(col)))


def month_key(col):
    """'yyyy-MM'."""
    return F.date_format(_date(col), "yyyy-MM")


def month_from_key(col):
    """First day of a 'yyyy-MM' month."""
    return F.to_date(F.concat(F.col(col) if isinstance(col, str) else col, F.lit("-01")))


def month_label(col, names):
    """Month name and year, e.g. 'Febbraio 2026' with the Italian names."""
    day = _date(col)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.month(day))
    return F.concat_ws(" ", name, F.year(day).cast("string"))


def midnight(col):
    """The date as a timestamp without time zone."""
    return _date(col).cast("timestamp_ntz")


def window_end(col, kind="six_days"):
    """End of a weekly window: 'six_days', 'last_second', 'next_week' or 'end_of_sunday'."""
    start = F.col(col) if isinstance(col, str) else col
    step = {
        "six_days": "interval 6 days",
        "last_second": "interval 604799 seconds",
        "next_week": "interval 7 days",
    }
    if kind == "end_of_sunday":
        return F.date_add(start.cast("date"), 6).cast("timestamp_ntz") + F.expr(
            "interval 86399 seconds"
        )
    return start.cast("timestamp_ntz") + F.expr(step[kind])
