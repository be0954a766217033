"""Run reports, comparisons of runs, and the lists offered for selection."""

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.operators.relational import distinct_values, first_by


# --- which runs to compare -----------------------------------------------------------------


def non_draft_runs(runs):
    """All runs but drafts; a run without a status is no draft."""
    return runs.filter(~F.col("status").eqNullSafe(schemas.STATUS_DRAFT))


def runs_with_postal(runs, run_postal_capacity):
    """Runs that have capacities per postal code."""
    return runs.join(run_postal_capacity.select("run_id").distinct(), "run_id", "left_semi")


def comparable_automated(runs):
    """Adds the automated run to compare each run with.

    For an automated run that is the finished automated run of the Monday a week before its
    own week, if both Mondays lie in one month. For a manual run executed in the month of its
    week's Monday it is the month's newest finished automated run. Both are joins on a key
    made unique before.
    """
    done = runs.filter(
        (F.col("run_type") == schemas.RUN_AUTOMATED) & (F.col("status") == schemas.STATUS_DONE)
    ).select("run_id", "executed_at", F.col("executed_at").cast("date").alias("_day"))
    by_day = first_by(done, ["_day"], [F.col("run_id")]).select(
        F.col("_day").alias("_week_before"), F.col("run_id").alias("_same_series")
    )
    by_month = (
        done.withColumn("_month", cal.month_start("_day"))
        .groupBy("_month")
        .agg(F.max_by("run_id", F.struct("executed_at", "run_id")).alias("_newest"))
    )
    monday = cal.week_start("executed_at")
    before = F.date_sub(monday, 7)
    automated = F.col("run_type") == schemas.RUN_AUTOMATED
    manual = F.col("run_type") == schemas.RUN_MANUAL
    keyed = runs.withColumns(
        {
            "_week_before": F.when(automated & (F.month(before) == F.month(monday)), before),
            "_month": F.when(
                manual & (F.month("executed_at") == F.month(monday)), cal.month_start(monday)
            ),
        }
    )
    return (
        keyed.join(by_day, "_week_before", "left")
        .join(by_month, "_month", "left")
        .select(
            *runs.columns,
            F.when(automated, F.col("_same_series"))
            .when(manual, F.col("_newest"))
            .alias("compare_with"),
        )
    )


def comparable_runs(runs, to=None):
    """Pairs of a run of ``to`` (all runs when not given) and a finished run of its month other
    than itself."""
    to = runs if to is None else to
    base = to.select("month", F.col("run_id").alias("compared"))
    done = runs.filter(F.col("status") == schemas.STATUS_DONE)
    return done.join(base, "month").filter(F.col("run_id") != F.col("compared"))


# --- two runs side by side -----------------------------------------------------------------


def compare_pairs(results, pairs, members, value="count_request"):
    """Weekly series of the runs ``run_a`` and ``run_b`` of each pair side by side.

    One pass over the results with an aggregate instead of a full outer join of two reads:
    values combine before the shuffle, and a missing side stays NULL.
    """
    sides = pairs.select(
        "run_a",
        "run_b",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("run_a").alias("run_id")),
                F.struct(F.lit("b").alias("side"), F.col("run_b").alias("run_id")),
            )
        ).alias("s"),
    ).select("run_a", "run_b", "s.side", "s.run_id")

    def of(side):
        return F.sum(F.when(F.col("side") == side, F.col(value)))

    return (
        results.join(sides, "run_id")
        .groupBy("run_a", "run_b", *members, "week")
        .agg(of("a").alias("value_a"), of("b").alias("value_b"))
        .withColumn(
            "delta",
            F.coalesce("value_b", F.lit(0)) - F.coalesce("value_a", F.lit(0)),
        )
    )


def compare_runs(results, run_a, run_b, members, value="count_request"):
    """Weekly series of two runs side by side, with the difference."""
    pair = results.sparkSession.range(1).select(
        F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b")
    )
    wanted = results.filter(F.col("run_id").isin(run_a, run_b))
    return compare_pairs(wanted, pair, members, value)


# --- series of a run -----------------------------------------------------------------------


def courier_week_totals(results):
    """Volume per run, courier and week."""
    return results.groupBy("run_id", "courier", "week").agg(
        F.sum("count_request").alias("count_request")
    )


def run_start(results):
    """First week of each run."""
    return results.groupBy("run_id").agg(F.min("week").alias("first_week"))


def overflow_series(results):
    """Whether a series goes past the first Monday of the month after the run's first week."""
    limit = run_start(results).select("run_id", cal.nth_monday("first_week", 1).alias("_limit"))
    series = results.groupBy("run_id", "label").agg(F.max("week").alias("_last"))
    return series.join(limit, "run_id").select(
        "run_id", "label", (F.col("_last") > F.col("_limit")).alias("overflows")
    )


# --- selection lists -----------------------------------------------------------------------


def available_months(estimates):
    """Months that have estimates, with their label."""
    month = cal.month_start("delivery_date")
    months = estimates.select(month.alias("_m")).distinct().filter(F.col("_m").isNotNull())
    return months.select(
        cal.month_key("_m").alias("month"),
        cal.month_label("_m", schemas.MONTH_NAMES).alias("label"),
    )


def provinces_of(geo, region=None):
    """Provinces of a region, or of every region."""
    places = geo if region is None else geo.filter(F.col("region") == region)
    return distinct_values(places, "region", "province_name").filter(
        F.col("province_name").isNotNull()
    )
