"""Courier capacities: landing, base or peak assignment, used capacity, planning sheet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.functions import columns as fn
from mailgrid.operators.merge import merge_run_capacity
from mailgrid.operators.relational import (
    classify_flags,
    conform,
    count_over_group,
    hot_join,
    max_over_group,
    spread_rows,
    stamp,
)


# --- landing -------------------------------------------------------------------------------


def capacity_grid(provinces, day):
    """Cells to ask for: each province with the month's Mondays from ``day`` on and the one
    after. ``day`` is a date column of the provinces or a literal."""
    day = fn.as_col(day)
    return provinces.select("province", F.explode(cal.future_mondays(day)).alias("week"))


def landed_cells(cells, weeks, couriers, provinces):
    """The landed cells that belong to the grid of the given weeks, couriers and provinces.
    Each dimension is checked on its own, so the grid itself is never built."""
    kept = cells
    for dim, key in ((weeks, "week"), (couriers, "courier"), (provinces, "province")):
        kept = hot_join(kept, dim.select(key).distinct(), [key], "left_semi")
    return kept


def normalize_capacity(items, updated_at):
    """Weekly province capacities from landed items, with the asked week in ``week``.

    Only the row with an open end stays. Its production capacity is the largest capacity of
    its key and week, the row with a closed window included.
    """
    rows = items.select(
        F.col("capacity"),
        F.col("geoKey").alias("province"),
        F.col("tenderIdGeoKey").alias("tender_geokey"),
        *[c.alias(name) for name, c in fn.products_to_flags("products").items()],
        F.col("tenderId").alias("tender_id"),
        F.col("unifiedDeliveryDriver").alias("courier"),
        fn.parse_ts("createdAt").alias("created_at"),
        F.col("peakCapacity").alias("peak_capacity"),
        cal.midnight("week").alias("from_ts"),
        F.col("activationDateTo"),
        "pk",
    )
    open_rows = max_over_group(rows, ["pk", "from_ts"], "capacity", "production_capacity").filter(
        F.col("activationDateTo").isNull()
    )
    ended = open_rows.withColumn("to_ts", cal.window_end("from_ts", "six_days"))
    return conform(stamp(ended, updated_at=updated_at), schemas.DECLARED_CAPACITY)


def normalize_postal_capacity(items):
    """Postal capacities from landed items: the hour set to 00, products dropped."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return items.select(
        F.col("unifiedDeliveryDriver").alias("courier"),
        F.col("geoKey").alias("postal_code"),
        F.col("capacity").cast("int").alias("capacity"),
        F.col("peakCapacity").cast("int").alias("peak_capacity"),
        fn.parse_ts(fn.hour_to_zero("activationDateFrom"), iso).alias("from_ts"),
        fn.parse_ts("activationDateTo", iso).alias("to_ts"),
        F.lit(None).cast("string").alias("products"),
    )


def normalize_estimates(items, updated_at):
    """Estimates from landed items: whole monthly pieces, typed columns."""
    rows = items.select(
        "pk",
        F.to_date("deliveryDate").alias("delivery_date"),
        F.col("weeklyEstimate").alias("weekly"),
        fn.half_even("monthlyEstimate").alias("monthly"),
        F.col("originalEstimate").alias("original"),
        F.col("paId").alias("sender"),
        F.col("productType").alias("product"),
        "province",
    )
    return conform(stamp(rows, updated_at=updated_at), schemas.ESTIMATES)


# --- base or peak per postal code ----------------------------------------------------------


def with_province(postal_capacity, geo):
    """Adds the postal code's province; unknown codes get NULL."""
    return postal_capacity.join(geo.select("postal_code", "province"), "postal_code", "left")


def pairs_of_runs(postal, runs):
    """Each different courier and province of the postal capacities with each of the runs."""
    if not isinstance(runs, DataFrame):
        runs = postal.sparkSession.createDataFrame([(i,) for i in runs], "run_id int")
    pairs = postal.select("courier", "province").distinct()
    return pairs.crossJoin(runs.select(F.col("run_id").cast("int").alias("run_id")).distinct())


def uncovered_capacity(postal_capacity, run_capacity, geo, runs):
    """Postal capacities of each of the runs whose courier and province the run does not have.

    ``runs`` is a frame with run_id, or a caller's ids. Which pairs a run lacks is found among the different pairs;
    the postal capacities are multiplied by the runs in the last join only.
    """
    postal = spread_rows(with_province(postal_capacity, geo))
    keys = ["run_id", "courier", "province"]
    lacking = hot_join(pairs_of_runs(postal, runs), run_capacity.select(*keys).distinct(), keys,
                       "left_anti")
    return hot_join(postal, spread_rows(lacking), ["courier", "province"], nulls=True)


def capacity_slots(run_capacity):
    """What a run says per courier and province: one row if all its weeks agree, else one row
    per week with that week's flag and window."""
    pair = ["run_id", "courier", "province"]
    classes = classify_flags(run_capacity, pair)
    uniform = classes.filter(F.col("flag_class") != "mixed").select(
        *pair,
        "flag_class",
        (F.col("flag_class") == "all").alias("is_default"),
        F.lit(None).cast("timestamp_ntz").alias("week_from"),
        F.lit(None).cast("timestamp_ntz").alias("week_to"),
    )
    weeks = run_capacity.select(
        *pair, "is_default", F.col("from_ts").alias("week_from"), F.col("to_ts").alias("week_to")
    )
    mixed = classes.filter(F.col("flag_class") == "mixed")
    return uniform.unionByName(hot_join(weeks, mixed, pair).select(*uniform.columns))


def assign_capacity(postal_capacity, run_capacity, geo, runs):
    """Base or peak capacity of each postal code in each of the runs.

    If every week of the run's courier and province has the default capacity, the base value is
    used in both columns, and if none has, the peak value. If they differ, each postal code gets
    one row per week of the run, with that week's window; a week without a flag gets 0. Pairs
    the run does not have keep their row and count as default. ``runs`` is a frame with run_id, or a caller's ids.

    The slots of all runs are worked out for the different pairs of courier and province; one
    join multiplies the postal capacities by them, and a frequent pair can be split. Both are
    spread before, because either may be broadcast and the other's tasks then unfold all rows.
    """
    base, peak = F.col("capacity"), F.col("peak_capacity")
    mixed = F.col("flag_class") == "mixed"
    chosen = (
        F.when(F.col("is_default"), base)
        .when(~F.col("is_default"), peak)
        .otherwise((base + peak) * 0)
    )
    covered = F.col("flag_class").isNotNull()
    postal = spread_rows(with_province(postal_capacity, geo))
    slots = hot_join(
        pairs_of_runs(postal, runs), capacity_slots(run_capacity),
        ["run_id", "courier", "province"], "left",
    )
    return hot_join(postal, spread_rows(slots), ["courier", "province"], nulls=True).select(
        "run_id",
        "courier",
        "postal_code",
        F.when(covered, chosen).otherwise(base).cast("int").alias("capacity"),
        F.when(covered, chosen).otherwise(peak).cast("int").alias("peak_capacity"),
        F.when(mixed, F.col("week_from")).otherwise(F.col("from_ts")).alias("from_ts"),
        F.when(mixed, F.col("week_to")).otherwise(F.col("to_ts")).alias("to_ts"),
        "products",
        "province",
        F.when(covered, F.col("is_default")).otherwise(F.lit(True)).alias("is_default"),
    )


def peak_only(assigned):
    """Rows that use peak capacity."""
    return assigned.filter(~F.col("is_default"))


def capacity_outputs(assigned, updated_at):
    """The table rows, and the rows of the full and of the peak-only file, of each run."""
    table = conform(stamp(assigned, updated_at=updated_at), schemas.RUN_POSTAL_CAPACITY)
    plain = assigned.withColumn("products", F.lit(None).cast("string"))
    return {"table": table, "all": plain, "modified": peak_only(plain)}


# --- capacity used by a finished run -------------------------------------------------------


def used_weeks(processed, runs):
    """Weeks whose used capacity is recorded: all of an automated run, and those of a manual
    run from the second Monday of the month after its first week on, if it got that far."""
    first = processed.groupBy("run_id").agg(F.min("week").alias("_first"))
    start = first.select("run_id", cal.nth_monday("_first", 1, 2).alias("_start"))
    reached = processed.join(start, "run_id").filter(F.col("week") == F.col("_start"))
    reached = reached.select("run_id", "_start").distinct()
    weeks = (
        processed.join(runs.select("run_id", "run_type", "capacity_type"), "run_id")
        .join(reached, "run_id", "left")
        .filter(
            (F.col("run_type") == schemas.RUN_AUTOMATED)
            | ((F.col("run_type") == schemas.RUN_MANUAL) & (F.col("week") >= F.col("_start")))
        )
    )
    default = (F.col("run_type") == schemas.RUN_AUTOMATED) | ~F.col("capacity_type").eqNullSafe(
        schemas.CAPACITY_PEAK
    )
    return weeks.select("run_id", "week", default.alias("is_default")).distinct()


def used_capacity(cells, processed, runs, declared, geo, updated_at):
    """Run capacities from the cells found for a run's weeks, known couriers and provinces.

    ``cells`` has run_id, courier, province, week and the used capacity; ``processed`` the
    weeks of each run.
    """
    couriers = declared.select("courier").distinct()
    regions = geo.select("province", "region").distinct()
    found = cells.join(used_weeks(processed, runs), ["run_id", "week"])
    rows = (
        hot_join(found, couriers, ["courier"], "left_semi")
        .join(regions, "province")
        .select(
            "courier",
            cal.midnight("week").alias("from_ts"),
            cal.window_end("week", "end_of_sunday").alias("to_ts"),
            "capacity",
            "region",
            "province",
            "is_default",
            "run_id",
            *[F.lit(None).alias(c) for c in ("sum_monthly", "sum_weekly", "p890", "p_ar")],
        )
    )
    return conform(stamp(rows, updated_at=updated_at), schemas.RUN_CAPACITY)


def record_used_capacity(run_capacity, used, runs):
    """Run capacities after the runs: an automated run appends its used capacities, a manual
    one replaces its open-ended rows by an upsert of the weeks."""
    kinds = runs.select("run_id", "run_type")
    manual = kinds.filter(F.col("run_type") == schemas.RUN_MANUAL).select("run_id")
    mine = used.join(manual, "run_id", "left_semi")
    others = used.join(manual, "run_id", "left_anti")
    marked = run_capacity.join(manual.withColumn("_manual", F.lit(True)), "run_id", "left")
    kept = marked.filter(F.col("_manual").isNull() | F.col("to_ts").isNotNull()).drop("_manual")
    return merge_run_capacity(kept, mine).unionByName(others)


# --- capacities of a new run ---------------------------------------------------------------


def rs_capacity(declared, runs, updated_at):
    """Open-ended rows of each run for capacities that carry only RS mail, from the first
    simulated Monday of the run's month."""
    monday = cal.first_sim_monday("from_ts")
    rs = declared.filter(
        ~F.col("p890") & ~F.col("p_ar") & F.col("p_rs") & (F.col("from_ts") == cal.midnight(monday))
    ).withColumn("month", cal.month_key("from_ts"))
    of_run = runs.select("run_id", "month", "capacity_type")
    kind = F.col("capacity_type")
    plain = kind.isin(schemas.CAPACITY_BASE, schemas.CAPACITY_MIXED)
    rows = rs.join(of_run, "month").select(
        "courier",
        "from_ts",
        F.when(plain, F.col("capacity")).otherwise(F.col("peak_capacity")).alias("capacity"),
        "province",
        F.lit(None).alias("to_ts"),
        F.lit(None).alias("region"),
        F.lit(0).alias("sum_monthly"),
        F.lit(0).alias("sum_weekly"),
        F.lit(False).alias("p890"),
        F.lit(False).alias("p_ar"),
        (~kind.eqNullSafe(schemas.CAPACITY_PEAK)).alias("is_default"),
        "run_id",
    )
    return conform(stamp(rows, updated_at=updated_at), schemas.RUN_CAPACITY)


def capacity_for_month(setting):
    """Adds the month in whose sheet a row appears: that of its start, or the one before if it
    starts on the first Monday of its month. The sheet's month must be the row's estimate
    month; a start on day 1 is no week of its own month."""
    day = F.col("from_ts").cast("date")
    own = cal.month_start(day)
    before = cal.month_start(day, -1)
    here = (F.month(own) == F.col("month_delivery")) & (F.dayofmonth(day) != 1)
    boundary = (F.month(before) == F.col("month_delivery")) & (day == cal.nth_monday(day))
    month = F.when(here, own).when(boundary, before)
    return setting.withColumn("month", F.date_format(month, "yyyy-MM")).filter(
        F.col("month").isNotNull()
    )


def editable_capacity(modified):
    """Rows of an existing run that can be edited: with an end and both product flags."""
    return modified.filter(
        F.col("to_ts").isNotNull() & F.col("p890").isNotNull() & F.col("p_ar").isNotNull()
    )


def capacity_sheet(setting, month=None):
    """Editable capacities of a month (all months when none is given); the monthly estimate is
    spread evenly over the rows of the courier, province and product."""
    rows = capacity_for_month(setting).withColumn("product", fn.flags_to_products(style="sheet"))
    if month is not None:
        rows = rows.filter(F.col("month") == month)
    group = ["month", "courier", "region", "province", "product"]
    return count_over_group(rows, group, "_weeks").select(
        "month",
        "courier",
        "region",
        "province",
        "province_name",
        "product",
        "from_ts",
        "to_ts",
        F.col("sum_monthly").alias("monthly"),
        fn.half_even(F.col("sum_monthly") / F.col("_weeks")).alias("weekly"),
        "capacity",
        F.col("capacity").alias("original_capacity"),
        "peak_capacity",
        F.coalesce("production_capacity", F.lit(0)).alias("production_capacity"),
    )


def existing_sheet(modified, runs):
    """Editable capacities of existing runs: the stored capacity beside the declared one, and
    the stored weekly estimate. A start on day 1 of the run's own month is no week of it."""
    months = runs.select("run_id", "month")
    first = (F.dayofmonth("from_ts") == 1) & (cal.month_key("from_ts") == F.col("month"))
    rows = editable_capacity(modified).join(months, "run_id")
    return rows.filter(~F.coalesce(first, F.lit(False))).select(
        "run_id",
        "courier",
        "region",
        "province",
        "province_name",
        fn.flags_to_products(style="sheet").alias("product"),
        "from_ts",
        "to_ts",
        F.col("sum_monthly").alias("monthly"),
        F.col("sum_weekly").alias("weekly"),
        F.col("modified_capacity").alias("capacity"),
        F.col("capacity").alias("original_capacity"),
        "peak_capacity",
        F.coalesce("production_capacity", F.lit(0)).alias("production_capacity"),
    )
