"""The reporting views. Row numbers without an order are not reproduced: they carry no
information and would pull the whole view into one task."""

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.operators.relational import any_flag, pick_one, sum_first_weeks
from mailgrid.plans.results import province_region


# --- capacities ----------------------------------------------------------------------------


def estimate_totals(estimates):
    """Estimates per date, product and province, repeated estimates counted once."""
    newest = [F.col(c).desc_nulls_last() for c in ("updated_at", "monthly", "weekly")]
    once = pick_one(
        estimates.select(*schemas.ESTIMATE_KEYS, "weekly", "monthly", "updated_at"),
        schemas.ESTIMATE_KEYS,
        newest,
    )
    return once.groupBy("delivery_date", "product", "province").agg(
        F.sum("weekly").alias("sum_weekly"), F.sum("monthly").alias("sum_monthly")
    )


def _estimate_weeks(estimates):
    """Totals of both products side by side, once per week in which a capacity may start."""

    def of(product, col):
        return F.sum(F.when(F.col("product") == product, F.col(col)))

    both = (
        estimate_totals(estimates)
        .groupBy("delivery_date", "province")
        .agg(
            of("890", "sum_weekly").alias("w890"),
            of("890", "sum_monthly").alias("m890"),
            of("AR", "sum_weekly").alias("w_ar"),
            of("AR", "sum_monthly").alias("m_ar"),
            F.coalesce(F.bool_or(F.col("product") == "890"), F.lit(False)).alias("has890"),
            F.coalesce(F.bool_or(F.col("product") == "AR"), F.lit(False)).alias("has_ar"),
        )
    )
    first = cal.monday_on_or_after("delivery_date")
    last = cal.monday_on_or_after(F.add_months("delivery_date", 1))
    return (
        both.withColumn("_last", last)
        .withColumn("_week", F.explode(F.sequence(first, last, F.expr("interval 7 days"))))
        .withColumn("month_delivery", F.month("delivery_date"))
    )


def capacity_setting(declared, estimates, geo):
    """Declared capacities with the estimates of the month their window starts in.

    A capacity belongs to an estimate date if it starts between the first Monday on or after
    the date and the one on or after the same day of the next month, both included. The range
    is unfolded into its weeks, so the join is on (province, week) and compares no other pairs.
    """
    names = pick_one(geo.select("province", "region", "province_name"), ["province"])
    weeks = _estimate_weeks(estimates).join(names, "province")
    capacity = declared.select(
        "courier", "from_ts", "to_ts", "capacity", "peak_capacity", "production_capacity",
        "province", "p890", "p_ar", cal.week_start("from_ts").alias("_week"),
    ).filter(F.col("p890") | F.col("p_ar"))
    use890 = F.col("p890") & F.col("has890")
    use_ar = F.col("p_ar") & F.col("has_ar")

    def both(a, b):
        a, b = F.when(use890, F.col(a)), F.when(use_ar, F.col(b))
        return F.sum(F.coalesce(a + b, a, b))

    return (
        capacity.join(weeks, ["province", "_week"])
        .filter((use890 | use_ar) & (F.col("from_ts") <= cal.midnight("_last")))
        .groupBy(
            "courier", "province", "month_delivery", "from_ts", "to_ts", "capacity",
            "peak_capacity", "production_capacity", "p890", "p_ar", "region", "province_name",
        )
        .agg(both("w890", "w_ar").alias("sum_weekly"), both("m890", "m_ar").alias("sum_monthly"))
    )


def modified_capacity_setting(run_capacity, runs, setting):
    """Run capacities beside the declared ones of the same window, products and estimate."""
    months = runs.select(
        "run_id", F.month(cal.month_from_key("month")).alias("_month")
    )
    cap = run_capacity.withColumn("_day", F.col("from_ts").cast("date")).join(
        months, "run_id", "left"
    )
    declared = setting.select(
        F.col("courier").alias("d_courier"),
        F.col("province").alias("d_province"),
        F.col("p890").alias("d_p890"),
        F.col("p_ar").alias("d_p_ar"),
        F.col("sum_monthly").alias("d_sum_monthly"),
        F.col("from_ts").alias("d_from"),
        F.col("to_ts").alias("d_to"),
        F.col("capacity").alias("d_capacity"),
        "peak_capacity",
        "production_capacity",
        "province_name",
        "month_delivery",
        F.col("from_ts").cast("date").alias("d_day"),
    )
    same = (
        (F.col("courier") == F.col("d_courier"))
        & (F.col("_day") == F.col("d_day"))
        & (F.col("province") == F.col("d_province"))
        & (F.col("p890") == F.col("d_p890"))
        & (F.col("p_ar") == F.col("d_p_ar"))
        & (F.col("sum_monthly") == F.col("d_sum_monthly"))
        & (F.col("_month") == F.col("month_delivery"))
    )
    hit = F.col("d_from").isNotNull()
    same_end = F.col("to_ts").cast("date") == F.col("d_to").cast("date")
    return cap.join(declared, same, "left").select(
        "run_id",
        "courier",
        F.when(hit, F.col("d_from")).otherwise(F.col("from_ts")).alias("from_ts"),
        F.when(same_end, F.col("d_to")).otherwise(F.col("to_ts")).alias("to_ts"),
        F.when(hit, F.col("d_capacity")).otherwise(0).alias("capacity"),
        F.col("capacity").alias("modified_capacity"),
        F.when(hit, F.col("sum_weekly")).otherwise(0).alias("sum_weekly"),
        F.col("d_sum_monthly").alias("sum_monthly"),
        "region",
        "province",
        "province_name",
        "production_capacity",
        "peak_capacity",
        "p890",
        "p_ar",
        "month_delivery",
    )


# --- peaks ---------------------------------------------------------------------------------


def volume_vs_capacity(results, run_capacity):
    """Weekly volume beside the run's capacity of that week, the smallest one if several."""
    week = F.col("from_ts")
    weekly = run_capacity.groupBy(
        "run_id", "courier", "province", week.alias("_from")
    ).agg(F.min("capacity").alias("capacity"))
    volume = results.withColumn("_from", cal.midnight("week"))
    return volume.join(weekly, ["run_id", "courier", "province", "_from"], "left").drop("_from")


def peak_table(results, run_capacity):
    """1 for series that reach their capacity in any week; an unknown capacity is no peak."""
    reached = F.col("count_request") >= F.col("capacity")
    both = volume_vs_capacity(results, run_capacity)
    return any_flag(both, schemas.SERIES_KEYS, reached, "peak")


def peak_map(peaks):
    """Share of a courier's provinces with a peak, per run and region, and its band."""
    regions = peaks.groupBy("run_id", "region", "courier").agg(
        F.sum("peak").cast("bigint").alias("peaks"),
        F.count_distinct("province").alias("provinces"),
    )
    peaks_, provinces = F.col("peaks"), F.col("provinces")
    band = (
        F.when(peaks_ * 10000 < provinces, schemas.BAND_NONE)
        .when(peaks_ * 2 < provinces, schemas.BAND_LOW)
        .otherwise(schemas.BAND_HIGH)
    )
    share = peaks_ / provinces
    return regions.withColumn("peak_share", share).withColumn("band", band)


# --- run summaries -------------------------------------------------------------------------


def weekly_summary(results, keys):
    """Total and mean weekly volume."""
    return results.groupBy(*keys).agg(
        F.sum("count_request").alias("sum_request"), F.avg("count_request").alias("avg_request")
    )


def sender_summary(results, residuals):
    """Volumes and residuals per run and sender."""
    left = residuals.select("run_id", "sender", F.col("count_residual").alias("sum_residual"))
    return weekly_summary(results, ["run_id", "sender"]).join(left, ["run_id", "sender"], "left")


def courier_summary(results, residuals):
    """Volumes, volumes after the fifth week and residuals per run, province and courier.

    What comes after the fifth week is the total minus the first five weeks, for the series
    that have more; the total is there already.
    """
    keys = schemas.SERIES_KEYS
    head = sum_first_weeks(results, keys, 5, "_head")
    left = residuals.select(*keys, F.col("count_residual").alias("sum_residual"))
    late = F.when(F.col("_weeks") > 5, F.col("sum_request") - F.col("_head"))
    return (
        results.groupBy(*keys, "label")
        .agg(
            F.sum("count_request").alias("sum_request"),
            F.avg("count_request").alias("avg_request"),
            F.count(F.lit(1)).alias("_weeks"),
        )
        .join(head, keys, "left")
        .join(left, keys, "left")
        .select(
            *keys, "label", "sum_request", "avg_request", late.alias("sum_after_5"), "sum_residual"
        )
    )


# --- planning views ------------------------------------------------------------------------


def sender_view(estimates, geo):
    """Monthly estimates per sender, region, product and date, positive ones only."""
    return (
        estimates.groupBy("sender", "province", "product", "delivery_date")
        .agg(F.sum("monthly").alias("monthly"))
        .join(province_region(geo), "province", "left")
        .groupBy("sender", "region", "product", "delivery_date")
        .agg(F.sum("monthly").alias("sum_monthly"))
        .filter(F.col("sum_monthly") > 0)
    )


def active_capacity(declared):
    """Courier, province, product flags and month of every declared capacity, once each."""
    return declared.select(
        "courier", "province", "p_ar", "p890", cal.month_key("from_ts").alias("month")
    ).distinct()


def capacity_by_product(declared):
    """One row per product an active capacity covers; two flag combinations of a courier and
    province that both cover a product give two rows."""
    products = F.array_compact(
        F.array(F.when(F.col("p_ar"), F.lit("AR")), F.when(F.col("p890"), F.lit("890")))
    )
    return active_capacity(declared).select(
        "courier", "province", "month", F.explode(products).alias("product")
    )


def courier_view(declared, estimates, geo):
    """Monthly estimates a courier can deliver per region and product, positive ones only."""
    monthly = estimates.groupBy(
        "province", "product", cal.month_key("delivery_date").alias("month")
    ).agg(F.sum("monthly").alias("monthly"))
    return (
        capacity_by_product(declared)
        .join(monthly, ["province", "product", "month"])
        .join(province_region(geo), "province", "left")
        .groupBy("courier", "region", "product", "month")
        .agg(F.sum("monthly").alias("sum_monthly"))
        .filter(F.col("sum_monthly") > 0)
    )
