"""Every registered query with the SQL that states its result.

A query takes (spark, folder) and reads the whole test tables. Dates and timestamps leave as
text and decimals as doubles, so that results compare by value with any SQL engine; ``PLAIN``
has the queries with the engine's own types.
"""

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.checks.fixture_sql import with_fixtures
from mailgrid.checks.fixtures import LOAD_DAY, UPDATED, Fixtures, week_of_year
from mailgrid.functions import calendar as cal
from mailgrid.functions import columns as fn
from mailgrid.operators import merge, ranking, relational
from mailgrid.plans import capacity, compare, named, overrides, pieces, results, views
from mailgrid.session import work_folder
from mailgrid.sources import files, manifest, pages, stored, tables

QUERIES, PLAIN, ORACLES, SHARED_SQL = {}, {}, {}, {}


def present(df):
    """Portable output types."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            col = col.cast("string")
        elif kind.startswith("decimal"):
            col = col.cast("double")
        elif kind in ("tinyint", "smallint", "int"):
            col = col.cast("bigint")
        out.append(col.alias(name))
    return df.select(*out)


def query(sql=None):
    """Registers a function of the fixtures under its own name."""

    def add(build):
        name = build.__name__
        PLAIN[name] = lambda spark, folder: build(Fixtures(spark, folder))
        QUERIES[name] = lambda spark, folder: present(build(Fixtures(spark, folder)))
        if sql:
            ORACLES[name] = sql
        return build

    return add


def oracle_sql():
    return {name: with_fixtures(sql, SHARED_SQL) for name, sql in ORACLES.items()}


# --- estimates to pieces -------------------------------------------------------------------

SHARED_SQL["all_estimates"] = """
    select * from estimates union all
    select sender || '~' || province || '~RS', max(delivery_date), 0,
           cast(floor(sum(monthly) / 50) as bigint), 0, sender, 'RS', province, max(updated_at)
    from estimates group by sender, province, date_trunc('month', delivery_date)
"""
SHARED_SQL["month_list"] = """
    select distinct cast(date_trunc('month', delivery_date) as date) as month from estimates
"""
SHARED_SQL["weeks"] = """
    select month, row_number() over (partition by month order by monday) as week_no,
           greatest(monday, month) as week_start,
           date_diff('day', greatest(monday, month), least(monday + 6, last_day(month))) + 1
               as days,
           monday = cast(date_trunc('week', last_day(month)) as date) as is_last,
           day(last_day(month)) as days_in_month
    from (select month, cast(unnest(generate_series(
              cast(date_trunc('week', month) as timestamp),
              cast(date_trunc('week', last_day(month)) as timestamp), interval 7 day)) as date)
              as monday
          from month_list)
"""
SHARED_SQL["split_rows"] = """
    select e.*, week_no, week_start, is_last,
           cast(round_even(cast(monthly as double) / days_in_month * days, 0) as bigint) as share
    from all_estimates e join weeks on month = cast(date_trunc('month', delivery_date) as date)
"""
SHARED_SQL["weekly_split_rows"] = """
    select sender || '~' || product || '~' || province as key, sender, province, product, week_no,
           week_start as week,
           case when is_last
                then monthly - cast(sum(case when is_last then 0 else share end)
                     over (partition by sender, province, product, delivery_date) as bigint)
                else share end as pieces
    from split_rows
"""
SHARED_SQL["attempt_rows"] = """
    select key, sender, province, product, week_no, week, attempt, pieces from (
        select *, cast(0 as bigint) as attempt from weekly_split_rows
        union all
        select * replace (cast(floor(pieces / 20) as bigint) as pieces), cast(1 as bigint) as attempt
        from weekly_split_rows)
    where pieces > 0
"""
SHARED_SQL["allocated_rows"] = """
    select key, sender, province, product, week_no, week, attempt, pieces, postal_code,
           base + case when place <= pieces - filled then 1 else 0 end as allocated
    from (
        select *,
               cast(sum(base) over (partition by key, week, attempt) as bigint) as filled,
               row_number() over (partition by key, week, attempt
                                  order by rest desc, postal_code) as place
        from (select a.*, postal_code, (pieces * nano) // 1000000000 as base,
                     (pieces * nano) % 1000000000 as rest
              from attempt_rows a join geo using (province)))
    where base + case when place <= pieces - filled then 1 else 0 end > 0
"""
SHARED_SQL["geo_total"] = """
    select province, cast(sum(pop) as bigint) as whole from geo group by 1
"""


def attempts(fx):
    return pieces.add_second_attempt(pieces.split_weekly(pieces.derive_rs(fx.estimates())))


def allocation(fx, by=None):
    return pieces.generate_allocation(fx.estimates(), fx.geo(), by=by)


ALLOCATION = [
    "key", "sender", "province", "product", "week_no", "week", "attempt", "pieces",
    "postal_code", "allocated",
]


@query("""
    select pk, cast(delivery_date as varchar) as delivery_date, weekly, monthly, original, sender,
           product, province, cast(updated_at as varchar) as updated_at from all_estimates
""")
def rs_derivation(fx):
    return pieces.derive_rs(fx.estimates())


@query("""
    select cast(month as varchar) as month, week_no, cast(week_start as varchar) as week_start,
           days, is_last, days_in_month from weeks
""")
def month_weeks(fx):
    return pieces.month_weeks(fx.estimates().select("delivery_date").distinct(), "delivery_date")


@query("""
    select key, sender, province, product, week_no, cast(week as varchar) as week, pieces
    from weekly_split_rows
""")
def weekly_split(fx):
    return pieces.split_weekly(pieces.derive_rs(fx.estimates()))


@query("""
    select sender, province, product, cast(week as varchar) as week, pieces
    from weekly_split_rows where pieces < 0
""")
def conservation_breaks(fx):
    return pieces.check_conservation(pieces.derive_rs(fx.estimates()))


@query("""
    select key, sender, province, product, week_no, cast(week as varchar) as week, attempt, pieces
    from attempt_rows
""")
def second_attempt(fx):
    return attempts(fx)


@query("""
    select key, sender, province, product, week_no, cast(week as varchar) as week, attempt,
           pieces, postal_code, allocated from allocated_rows
""")
def largest_remainder(fx):
    return allocation(fx).select(*ALLOCATION)


@query("""
    select key, sender, province, product, week_no, cast(week as varchar) as week, attempt,
           pieces, postal_code,
           base + case when place <= pieces - filled then 1 else 0 end as allocated
    from (
        select *,
               cast(sum(base) over (partition by key, week, attempt) as bigint) as filled,
               row_number() over (partition by key, week, attempt
                                  order by rest desc, postal_code) as place
        from (select a.*, postal_code, (pieces * pop) // whole as base,
                     (pieces * pop) % whole as rest
              from attempt_rows a join geo using (province) join geo_total using (province)))
    where base + case when place <= pieces - filled then 1 else 0 end > 0
""")
def largest_remainder_population(fx):
    return pieces.allocate_largest_remainder(attempts(fx), fx.geo(), "pop").select(*ALLOCATION)


@query("""
    select key || '~' || cast(week as varchar) || '~' || attempt || '~' || postal_code || '~' || n
               as request_id,
           cast(cast(week as timestamp) as varchar) as sent_at,
           cast(cast(week as timestamp) as varchar) as prepare_at, product, sender, province,
           postal_code, attempt,
           'IUN~' || key || '~' || cast(week as varchar) || '~' || attempt || '~' || postal_code
               || '~' || n as iun,
           'EVALUATE_SENDER_LIMIT' as workflow_step, cast(week as varchar) as week
    from (select *, unnest(generate_series(1, allocated)) as n from allocated_rows)
""")
def explode_pieces(fx):
    return pieces.explode_pieces(allocation(fx), placed=True)


@query("""
    select cast(cast(date_trunc('week', week) as date) + 7 as varchar) as week_label,
           cast(sum(allocated) as bigint) as pieces
    from allocated_rows group by 1
""")
def week_buckets(fx):
    return pieces.week_buckets(pieces.explode_pieces(allocation(fx), placed=True))


@query("""
    select key, cast(week as varchar) as week, attempt, pieces,
           cast(unnest(generate_series(1, pieces)) as bigint) as ordinal
    from attempt_rows
""")
def repeat_rows(fx):
    """One row per piece of a province and week; counts above 5 are cut into chunks."""
    weekly = attempts(fx).select("key", "week", "attempt", "pieces")
    return relational.repeat_rows(weekly, "pieces", chunk=5)


# --- calendar ------------------------------------------------------------------------------

SHARED_SQL["ship_days"] = "select distinct cast(l_shipdate as date) as day from lineitem"
SHARED_SQL["first_mondays"] = """
    select day, cast(date_trunc('month', day) as date) as m0,
           cast(date_trunc('month', day) + interval 1 month as date) as m1,
           cast(date_trunc('month', day) + interval 2 month as date) as m2,
           cast(date_trunc('month', case when day(ahead) > 15 then ahead + interval 1 month
                                         else ahead end) as date) as sim
    from (select day, day + interval 1 month as ahead from ship_days)
"""


@query("""
    select cast(day as varchar) as day,
           cast(cast(date_trunc('week', day) as date) as varchar) as week_start,
           cast(cast(date_trunc('week', day) as date) + 7 as varchar) as next_monday,
           cast(day + cast((8 - isodow(day)) % 7 as int) as varchar) as monday_on_or_after,
           cast(m0 + cast(case when isodow(m0) = 1 then 7 else 8 - isodow(m0) end as int) as varchar)
               as first_sim_monday,
           cast(m1 + cast((8 - isodow(m1)) % 7 as int) as varchar) as first_monday_next,
           cast(m1 + cast((8 - isodow(m1)) % 7 as int) + 7 as varchar) as second_monday_next,
           cast(m2 + cast((8 - isodow(m2)) % 7 as int) as varchar) as first_monday_after_next,
           strftime(day, '%Y-%m') as month_key,
           cast(len(generate_series(
               cast(day + cast((8 - isodow(day)) % 7 as int) as timestamp),
               greatest(cast(day + cast((8 - isodow(day)) % 7 as int) as timestamp),
                        cast(m1 + cast((8 - isodow(m1)) % 7 as int) as timestamp)), interval 7 day)) as bigint)
               as future_mondays,
           cast(sim as varchar) as sim_month
    from first_mondays
""")
def calendar_functions(fx):
    days = fx.table("lineitem", F.col("l_shipdate").cast("date").alias("day")).distinct()
    return days.select(
        "day",
        cal.week_start("day").alias("week_start"),
        cal.next_monday("day").alias("next_monday"),
        cal.monday_on_or_after("day").alias("monday_on_or_after"),
        cal.first_sim_monday("day").alias("first_sim_monday"),
        cal.nth_monday("day", 1).alias("first_monday_next"),
        cal.nth_monday("day", 1, 2).alias("second_monday_next"),
        cal.nth_monday("day", 2).alias("first_monday_after_next"),
        cal.month_key("day").alias("month_key"),
        F.size(cal.future_mondays("day")).alias("future_mondays"),
        cal.sim_month("day", 15, 1).alias("sim_month"),
    )


# --- landing -------------------------------------------------------------------------------


@query(f"""
    select capacity, province, tender_geokey, p890, p_ar, p_rs, tender_id, courier,
           cast(created_at as varchar) as created_at, peak_capacity,
           cast(from_ts as varchar) as from_ts, cast(to_ts as varchar) as to_ts,
           pk || '~' || cast(p890 as varchar) || '~' || cast(p_ar as varchar) as pk,
           greatest(capacity, capacity + capacity % 5 - 2) as production_capacity,
           '{UPDATED}' as updated_at
    from declared
""")
def normalize_capacity(fx):
    items = pages.flatten_items(fx.capacity_pages(), schemas.CAPACITY_ITEM, keep=["week"])
    return capacity.normalize_capacity(items, UPDATED)


@query(f"""
    select pk, cast(delivery_date as varchar) as delivery_date, weekly,
           cast(round_even(monthly + 0.5::double, 0) as bigint) as monthly, original, sender,
           product, province, '{UPDATED}' as updated_at
    from estimates
""")
def normalize_estimates(fx):
    items = pages.flatten_items(fx.estimate_pages(), schemas.ESTIMATE_ITEM)
    return capacity.normalize_estimates(items, UPDATED)


@query("""
    select courier, postal_code, capacity, peak_capacity, '2001-01-01 00:00:00' as from_ts,
           case when capacity % 2 = 0 then '2001-12-31 23:59:59' end as to_ts,
           cast(null as varchar) as products
    from postal_capacity
""")
def normalize_postal_capacity(fx):
    items = pages.flatten_items(fx.postal_pages(), schemas.CAPACITY_ITEM)
    return capacity.normalize_postal_capacity(items)


SHARED_SQL["declared_months"] = """
    select distinct province, cast(date_trunc('month', from_ts) as date) as m0,
           cast(date_trunc('month', from_ts) + interval 1 month as date) as m1
    from declared
"""


@query("""
    select province, cast(cast(unnest(generate_series(
               cast(m0 + cast(case when isodow(m0) = 1 then 7 else 8 - isodow(m0) end as int) as timestamp),
               cast(m1 + cast((8 - isodow(m1)) % 7 as int) as timestamp), interval 7 day)) as date) as varchar)
               as week
    from declared_months
""")
def capacity_grid(fx):
    months = fx.declared().select("province", cal.month_start("from_ts").alias("_m")).distinct()
    return capacity.capacity_grid(months, cal.first_sim_monday("_m"))


SHARED_SQL["cells"] = """
    select run_id, courier, province, week, count(*) as capacity from pieces group by 1, 2, 3, 4
"""


@query("""
    select run_id, courier, province, cast(week as varchar) as week, capacity from cells
    where courier in (select courier from declared where not p890)
      and province in (select province from declared where p_ar)
      and week in (select cast(from_ts as date) from declared)
""")
def landed_cells(fx):
    declared = fx.declared()
    return capacity.landed_cells(
        fx.cells(),
        declared.select(F.col("from_ts").cast("date").alias("week")),
        declared.filter(~F.col("p890")),
        declared.filter("p_ar"),
    )


# --- base or peak --------------------------------------------------------------------------

SHARED_SQL["pair_flags"] = """
    select run_id, courier, province, count(*) as n,
           count(*) filter (where is_default) as n_true,
           count(*) filter (where not is_default) as n_false
    from run_capacity group by 1, 2, 3
"""
SHARED_SQL["postal_province"] = """
    select run_id, p.*, g.province
    from postal_capacity p left join geo g using (postal_code) cross join runs
"""
SHARED_SQL["assigned"] = """
    select run_id, p.courier, postal_code, p.capacity, p.capacity as peak_capacity, p.from_ts,
           p.to_ts, province, true as is_default
    from postal_province p join pair_flags f using (run_id, courier, province) where n = n_true
    union all
    select run_id, p.courier, postal_code, p.peak_capacity, p.peak_capacity, p.from_ts, p.to_ts,
           province, false
    from postal_province p join pair_flags f using (run_id, courier, province) where n = n_false
    union all
    select run_id, p.courier, postal_code,
           case when r.is_default then p.capacity when not r.is_default then p.peak_capacity
                else 0 end,
           case when r.is_default then p.capacity when not r.is_default then p.peak_capacity
                else 0 end,
           r.from_ts, r.to_ts, province, r.is_default
    from postal_province p join pair_flags f using (run_id, courier, province)
         join run_capacity r using (run_id, courier, province)
    where n <> n_false and n <> n_true
    union all
    select run_id, p.courier, postal_code, p.capacity, p.peak_capacity, p.from_ts, p.to_ts,
           p.province, true
    from postal_province p
    where not exists (select 1 from pair_flags f where f.run_id = p.run_id
                      and f.courier = p.courier and f.province = p.province)
"""
ASSIGNED = """run_id, courier, postal_code, capacity, peak_capacity, cast(from_ts as varchar) as from_ts,
    cast(to_ts as varchar) as to_ts"""


def assigned(fx):
    return capacity.assign_capacity(
        fx.postal_capacity(), fx.run_capacity(), fx.geo(), fx.runs()
    )


@query(f"select {ASSIGNED}, province, is_default from assigned")
def assign_capacity(fx):
    return assigned(fx).drop("products")


@query("""
    select run_id, courier, postal_code, capacity, peak_capacity,
           cast(from_ts as varchar) as from_ts, cast(to_ts as varchar) as to_ts,
           cast(null as varchar) as products, province
    from postal_province p
    where not exists (select 1 from run_capacity f where f.run_id = p.run_id
                      and f.courier = p.courier and f.province = p.province)
""")
def uncovered_capacity(fx):
    return capacity.uncovered_capacity(
        fx.postal_capacity(), fx.run_capacity(), fx.geo(), fx.runs()
    )


@query(f"""
    select {ASSIGNED}, province, cast(null as varchar) as products, is_default from assigned
    where not is_default
""")
def peak_only_capacity(fx):
    return capacity.capacity_outputs(assigned(fx), UPDATED)["modified"]


@query(f"select {ASSIGNED}, province, cast(null as varchar) as products, is_default from assigned")
def all_run_capacity(fx):
    return capacity.capacity_outputs(assigned(fx), UPDATED)["all"]


@query(f"""
    select {ASSIGNED}, '{UPDATED}' as updated_at from assigned
""")
def run_postal_capacity(fx):
    return capacity.capacity_outputs(assigned(fx), UPDATED)["table"]


@query("""
    select run_id, courier, province,
           case when n = n_true then 'all' when n = n_false then 'none' else 'mixed' end
               as flag_class
    from pair_flags
""")
def classify_flags(fx):
    return relational.classify_flags(fx.run_capacity(), ["run_id", "courier", "province"])


# --- results -------------------------------------------------------------------------------


@query("select run_id, sender, cast(week as varchar) as week, count_request from sender_results")
def results_by_sender(fx):
    return results.results_by_sender(fx.pieces())


@query("""
    select run_id, province, region, courier, cast(week as varchar) as week, label, count_request
    from courier_results
""")
def results_by_courier(fx):
    return results.results_by_courier(fx.pieces(), fx.geo())


@query("select run_id, sender, count_residual from sender_residuals")
def residuals_by_sender(fx):
    return results.residuals_by_sender(fx.pieces())


@query("select run_id, province, region, courier, label, count_residual from courier_residuals")
def residuals_by_courier(fx):
    return results.residuals_by_courier(fx.pieces(), fx.geo())


@query("""
    select request_id, sender, province, postal_code,
           case when step = 'EVALUATE_PRINT_CAPACITY' then courier else '' end as courier, product,
           step as workflow_step, '0' as attempt, cast(week as varchar) as week, run_id
    from pieces
""")
def read_pieces(fx):
    """Landed planner pages; a piece without a courier gets an empty one."""
    items = pages.flatten_items(
        fx.piece_pages(), schemas.PIECE_ITEM, {"unifiedDeliveryDriver": ""}, keep=["run_id", "week"]
    )
    return results.read_pieces(items)


# --- used capacity, overrides, new runs ----------------------------------------------------

RUN_CAPACITY = """courier, cast(from_ts as varchar) as from_ts, cast(to_ts as varchar) as to_ts,
    capacity, sum_monthly, sum_weekly, region, province, p890, p_ar,
    cast(updated_at as varchar) as updated_at, is_default, run_id"""
SHARED_SQL["processed"] = """
    select year(week) * 10 + quarter(week) as run_id, week from ship_weeks
"""
SHARED_SQL["run_limits"] = """
    select run_id, m1 + cast((8 - isodow(m1)) % 7 as int) + 7 as start
    from (select run_id, cast(date_trunc('month', min(week)) + interval 1 month as date) as m1
          from processed group by 1)
"""
SHARED_SQL["used_rows"] = """
    select c.courier, cast(c.week as timestamp) as from_ts,
           cast(c.week as timestamp) + interval 6 day + interval 86399 second as to_ts,
           c.capacity, cast(null as bigint) as sum_monthly, cast(null as bigint) as sum_weekly,
           g.region, c.province, cast(null as boolean) as p890, cast(null as boolean) as p_ar,
           run_type = 'Automatizzata' or capacity_type <> 'Picco' as is_default, c.run_id
    from cells c join processed using (run_id, week) join runs using (run_id)
         join run_limits l using (run_id) join prov_reg g using (province)
    where c.courier in (select courier from declared)
      and (run_type = 'Automatizzata'
           or (run_type = 'Manuale' and c.week >= l.start
               and exists (select 1 from processed p
                           where p.run_id = c.run_id and p.week = l.start)))
"""


@query(f"""
    select {RUN_CAPACITY} from (select *, '{UPDATED}' as updated_at from used_rows)
""")
def used_capacity(fx):
    return capacity.used_capacity(
        fx.cells(), fx.processed(), fx.runs(), fx.declared(), fx.geo(), UPDATED
    )


def typed_rows(fx):
    return overrides.load_overrides(fx.override_documents())


def typed_rows_with_kind(fx):
    return typed_rows(fx).join(fx.runs().select("run_id", "capacity_type"), "run_id")


@query("""
    select run_id, courier, cast(from_ts as varchar) as from_ts, cast(to_ts as varchar) as to_ts,
           capacity, sum_monthly, sum_weekly, region, province, p890, p_ar, is_default,
           real_capacity, base_capacity
    from overrides
""")
def load_overrides(fx):
    return typed_rows(fx).drop("position")


SHARED_SQL["tails"] = f"""
    select courier, max(from_ts) + interval 7 day as from_ts, cast(null as timestamp) as to_ts,
           case when any_value(capacity_type) = 'Combinata' then arg_min(base_capacity, from_ts)
                else arg_min(real_capacity, from_ts) end as capacity,
           arg_max(sum_monthly, from_ts) as sum_monthly,
           arg_max(sum_weekly, from_ts) as sum_weekly, region, province,
           arg_max(p890, from_ts) as p890, arg_max(p_ar, from_ts) as p_ar,
           timestamp '{UPDATED}' as updated_at, any_value(capacity_type) <> 'Picco' as is_default,
           run_id
    from overrides join runs using (run_id) group by run_id, courier, region, province
"""


@query(f"select {RUN_CAPACITY} from tails")
def open_ended_tails(fx):
    return overrides.append_tails(typed_rows_with_kind(fx), "capacity_type", UPDATED)


@query(f"""
    select {RUN_CAPACITY} from (
        select courier, from_ts, to_ts, capacity, sum_monthly, sum_weekly, region, province, p890,
               p_ar, timestamp '{UPDATED}' as updated_at, is_default, run_id from overrides
        union all select * from tails)
""")
def insert_overrides(fx):
    return overrides.insert_overrides(typed_rows_with_kind(fx), "capacity_type", UPDATED)


@query(f"""
    select {RUN_CAPACITY} from (
        select r.courier, r.from_ts, r.to_ts,
               case when o.run_id is null then r.capacity else o.capacity end as capacity,
               r.sum_monthly, r.sum_weekly, r.region, r.province, r.p890, r.p_ar, r.updated_at,
               case when o.run_id is null then r.is_default else o.is_default end as is_default,
               r.run_id
        from run_capacity r left join overrides o
             on o.run_id = r.run_id and o.courier = r.courier and o.province = r.province
                and o.from_ts = r.from_ts
        where r.to_ts is not null
        union all
        select o.courier, o.from_ts, o.to_ts, o.capacity, o.sum_monthly, 0, o.region, o.province,
               o.p890, o.p_ar, timestamp '{UPDATED}', o.is_default, o.run_id
        from overrides o
        where not exists (select 1 from run_capacity r
                          where o.run_id = r.run_id and o.courier = r.courier
                            and o.province = r.province and o.from_ts = r.from_ts
                            and r.to_ts is not null)
        union all
        select * from tails)
""")
def apply_overrides(fx):
    typed = typed_rows_with_kind(fx)
    return overrides.apply_overrides(fx.run_capacity(), typed, "capacity_type", UPDATED)


SHARED_SQL["rs_rows"] = f"""
    select d.courier, d.from_ts, cast(null as timestamp) as to_ts,
           case when capacity_type in ('BAU', 'Combinata') then d.capacity else d.peak_capacity end
               as capacity,
           cast(0 as bigint) as sum_monthly, cast(0 as bigint) as sum_weekly,
           cast(null as varchar) as region, d.province, false as p890, false as p_ar,
           timestamp '{UPDATED}' as updated_at, capacity_type <> 'Picco' as is_default, r.run_id
    from (select *, cast(date_trunc('month', from_ts) as date) as m0 from declared) d
    join runs r on r.month = strftime(from_ts, '%Y-%m')
    where not p890 and not p_ar and p_rs
      and cast(from_ts as date)
          = m0 + cast(case when isodow(m0) = 1 then 7 else 8 - isodow(m0) end as int)
"""


@query(f"select {RUN_CAPACITY} from rs_rows")
def rs_capacity(fx):
    return capacity.rs_capacity(fx.declared(), fx.runs(), UPDATED)


SHARED_SQL["stored_capacity"] = "select * from run_capacity where run_id % 4 <> 3"


@query(f"""
    select {RUN_CAPACITY} from (
        select r.courier, r.from_ts, r.to_ts,
               case when o.run_id is null then r.capacity else o.capacity end as capacity,
               r.sum_monthly, r.sum_weekly, r.region, r.province, r.p890, r.p_ar, r.updated_at,
               case when o.run_id is null then r.is_default else o.is_default end as is_default,
               r.run_id
        from stored_capacity r left join overrides o
             on o.run_id = r.run_id and o.courier = r.courier and o.province = r.province
                and o.from_ts = r.from_ts
        where r.to_ts is not null
        union all
        select o.courier, o.from_ts, o.to_ts, o.capacity, o.sum_monthly,
               case when o.run_id % 4 = 3 then o.sum_weekly else 0 end, o.region, o.province,
               o.p890, o.p_ar, timestamp '{UPDATED}', o.is_default, o.run_id
        from overrides o
        where not exists (select 1 from stored_capacity r
                          where o.run_id = r.run_id and o.courier = r.courier
                            and o.province = r.province and o.from_ts = r.from_ts
                            and r.to_ts is not null)
        union all select * from tails
        union all select * from rs_rows)
""")
def save_run_capacity(fx):
    """Runs with stored capacities are updated, a quarter of them are new; all get RS rows."""
    stored = fx.run_capacity().filter(F.col("run_id") % 4 != 3)
    return overrides.save_run_capacity(
        stored, typed_rows(fx), fx.declared(), fx.runs(), UPDATED
    )


SHARED_SQL["used_delta"] = f"select *, timestamp '{UPDATED}' as updated_at from used_rows"


@query(f"""
    select {RUN_CAPACITY} from (
        select u.courier, u.from_ts, u.to_ts, u.capacity, u.sum_monthly, u.sum_weekly, u.region,
               u.province, u.p890, u.p_ar, u.updated_at, u.is_default, u.run_id
        from used_delta u join runs using (run_id) where run_type = 'Automatizzata'
        union all
        select courier, from_ts, to_ts, capacity, sum_monthly, sum_weekly, region, province, p890,
               p_ar, updated_at, is_default, run_id
        from (select c.*, run_type from run_capacity c join runs using (run_id)
              where run_type = 'Automatizzata' or to_ts is not null) c
        where run_type = 'Automatizzata'
              or not exists (select 1 from used_delta u
                             where u.run_id = c.run_id and u.courier = c.courier
                               and u.province = c.province and u.from_ts = c.from_ts
                               and u.updated_at > c.updated_at)
        union all
        select u.courier, u.from_ts, u.to_ts, u.capacity, u.sum_monthly, u.sum_weekly, u.region,
               u.province, u.p890, u.p_ar, u.updated_at, u.is_default, u.run_id
        from used_delta u join runs using (run_id)
        where run_type = 'Manuale'
          and not exists (select 1 from run_capacity c
                          where u.run_id = c.run_id and u.courier = c.courier
                            and u.province = c.province and u.from_ts = c.from_ts
                            and c.to_ts is not null and not u.updated_at > c.updated_at))
""")
def record_used_capacity(fx):
    used = capacity.used_capacity(
        fx.cells(), fx.processed(), fx.runs(), fx.declared(), fx.geo(), UPDATED
    )
    return capacity.record_used_capacity(fx.run_capacity(), used, fx.runs())


# --- views ---------------------------------------------------------------------------------

SHARED_SQL["setting"] = """
    with sums as (
        select delivery_date, product, province, cast(sum(weekly) as bigint) as w,
               cast(sum(monthly) as bigint) as m,
               cast(delivery_date + interval 1 month as date) as upto
        from estimates group by 1, 2, 3
    )
    select courier, from_ts, to_ts, capacity, peak_capacity, production_capacity,
           cast(sum(w) as bigint) as sum_weekly, cast(sum(m) as bigint) as sum_monthly, g.region,
           d.province, g.province_name, p890, p_ar, month(delivery_date) as month_delivery
    from declared d
    join (select distinct province, region, province_name from geo) g using (province)
    join sums s on s.province = d.province
         and from_ts >= delivery_date + cast((8 - isodow(delivery_date)) % 7 as int)
         and from_ts <= upto + cast((8 - isodow(upto)) % 7 as int)
    where (product = '890' and p890) or (product = 'AR' and p_ar)
    group by all
"""


def setting(fx):
    return views.capacity_setting(fx.declared(), fx.estimates(), fx.geo())


@query("""
    select courier, province, month_delivery, cast(from_ts as varchar) as from_ts,
           cast(to_ts as varchar) as to_ts, capacity, peak_capacity, production_capacity, p890,
           p_ar, sum_weekly, sum_monthly, region, province_name
    from setting
""")
def capacity_setting(fx):
    return setting(fx)


@query("""
    select c.run_id, c.courier,
           cast(case when cast(c.from_ts as date) = cast(s.from_ts as date) then s.from_ts
                     else c.from_ts end as varchar) as from_ts,
           cast(case when cast(c.to_ts as date) = cast(s.to_ts as date) then s.to_ts
                     else c.to_ts end as varchar) as to_ts,
           case when cast(c.from_ts as date) = cast(s.from_ts as date) then s.capacity else 0 end
               as capacity,
           c.capacity as modified_capacity,
           case when cast(c.from_ts as date) = cast(s.from_ts as date) then c.sum_weekly else 0 end
               as sum_weekly,
           s.sum_monthly, c.region, c.province, s.province_name, s.production_capacity,
           s.peak_capacity, c.p890, c.p_ar, s.month_delivery
    from run_capacity c left join runs r using (run_id)
    left join setting s on c.courier = s.courier
         and cast(c.from_ts as date) = cast(s.from_ts as date) and c.province = s.province
         and c.p890 = s.p890 and c.p_ar = s.p_ar and c.sum_monthly = s.sum_monthly
         and month(cast(r.month || '-01' as date)) = s.month_delivery
""")
def modified_capacity_setting(fx):
    return views.modified_capacity_setting(fx.run_capacity(), fx.runs(), setting(fx))


@query("""
    select c.run_id, c.courier, c.province, cast(c.from_ts as varchar) as from_ts,
           c.capacity as modified_capacity, c.p890, c.p_ar
    from run_capacity c left join runs r using (run_id)
    left join setting s on c.courier = s.courier
         and cast(c.from_ts as date) = cast(s.from_ts as date) and c.province = s.province
         and c.p890 = s.p890 and c.p_ar = s.p_ar and c.sum_monthly = s.sum_monthly
         and month(cast(r.month || '-01' as date)) = s.month_delivery
    where case when cast(c.to_ts as date) = cast(s.to_ts as date) then s.to_ts else c.to_ts end
              is not null
          and c.p890 is not null and c.p_ar is not null
""")
def editable_capacity(fx):
    modified = views.modified_capacity_setting(fx.run_capacity(), fx.runs(), setting(fx))
    return capacity.editable_capacity(modified).select(
        "run_id", "courier", "province", "from_ts", "modified_capacity", "p890", "p_ar"
    )


SHARED_SQL["sheet_rows"] = """
    select *, case
        when month(m0) = month_delivery and day(day) <> 1 then strftime(m0, '%Y-%m')
        when month(before) = month_delivery and day = m0 + cast((8 - isodow(m0)) % 7 as int)
            then strftime(before, '%Y-%m') end as sheet
    from (select *, cast(from_ts as date) as day, cast(date_trunc('month', from_ts) as date) as m0,
                 cast(date_trunc('month', from_ts) - interval 1 month as date) as before
          from setting)
"""


@query("""
    select sheet as month, courier, region, province, province_name,
           case when p890 and p_ar then '890-AR' when p890 then '890' when p_ar then 'AR'
                else '' end as product,
           cast(from_ts as varchar) as from_ts, cast(to_ts as varchar) as to_ts,
           sum_monthly as monthly,
           cast(round_even(cast(sum_monthly as double) / count(*) over (
               partition by sheet, courier, region, province, p890, p_ar), 0) as bigint)
               as weekly,
           capacity, capacity as original_capacity, peak_capacity,
           coalesce(production_capacity, 0) as production_capacity
    from sheet_rows where sheet is not null
""")
def capacity_sheet(fx):
    return capacity.capacity_sheet(setting(fx))


@query("""
    select c.run_id, c.courier, c.region, c.province, s.province_name,
           case when c.p890 and c.p_ar then '890-AR' when c.p890 then '890' when c.p_ar then 'AR'
                else '' end as product,
           cast(coalesce(s.from_ts, c.from_ts) as varchar) as from_ts,
           cast(case when cast(c.to_ts as date) = cast(s.to_ts as date) then s.to_ts
                     else c.to_ts end as varchar) as to_ts,
           s.sum_monthly as monthly,
           case when s.courier is not null then c.sum_weekly else 0 end as weekly,
           c.capacity, case when s.courier is not null then s.capacity else 0 end
               as original_capacity,
           s.peak_capacity, coalesce(s.production_capacity, 0) as production_capacity
    from run_capacity c join runs r using (run_id)
    left join setting s on c.courier = s.courier
         and cast(c.from_ts as date) = cast(s.from_ts as date) and c.province = s.province
         and c.p890 = s.p890 and c.p_ar = s.p_ar and c.sum_monthly = s.sum_monthly
         and month(cast(r.month || '-01' as date)) = s.month_delivery
    where c.to_ts is not null and c.p890 is not null and c.p_ar is not null
          and not (day(c.from_ts) = 1 and strftime(c.from_ts, '%Y-%m') = r.month)
""")
def existing_sheet(fx):
    modified = views.modified_capacity_setting(fx.run_capacity(), fx.runs(), setting(fx))
    return capacity.existing_sheet(modified, fx.runs())


SHARED_SQL["peaks"] = """
    select r.run_id, r.province, r.region, r.courier,
           cast(max(case when count_request >= c.capacity then 1 else 0 end) as bigint) as peak
    from courier_results r left join run_capacity c
         on r.run_id = c.run_id and r.courier = c.courier and r.province = c.province
            and cast(r.week as timestamp) = c.from_ts
    group by 1, 2, 3, 4
"""


def peaks(fx):
    return views.peak_table(fx.courier_results(), fx.run_capacity())


@query("""
    select run_id, province, region, courier, peak,
           case peak when 0 then 'Assente' when 1 then 'Presente' end as peak_label
    from peaks
""")
def peak_table(fx):
    return peaks(fx).withColumn("peak_label", fn.label_peak("peak"))


@query("""
    select *, cast(case band when 'No picchi' then 0 when '<50% picchi' then 1 else 2 end
                   as bigint) as band_ordinal
    from (select *, cast(peaks as double) / provinces as peak_share,
                 case when cast(peaks as double) / provinces < 0.0001 then 'No picchi'
                      when cast(peaks as double) / provinces < 0.5 then '<50% picchi'
                      else '>=50% picchi' end as band
          from (select run_id, region, courier, cast(sum(peak) as bigint) as peaks,
                       count(distinct province) as provinces
                from peaks group by 1, 2, 3))
""")
def peak_map(fx):
    return views.peak_map(peaks(fx)).withColumn("band_ordinal", fn.band_ordinal("band"))


@query("""
    select r.run_id, r.province, r.region, r.courier, cast(r.week as varchar) as week,
           count_request, min(c.capacity) as capacity
    from courier_results r left join run_capacity c
         on r.run_id = c.run_id and r.courier = c.courier and r.province = c.province
            and cast(r.week as timestamp) = c.from_ts
    group by r.run_id, r.province, r.region, r.courier, r.week, count_request
""")
def volume_vs_capacity(fx):
    return views.volume_vs_capacity(fx.courier_results(), fx.run_capacity()).drop("label")


@query("""
    select run_id, sender, sum_request, avg_request, count_residual as sum_residual
    from (select run_id, sender, cast(sum(count_request) as bigint) as sum_request,
                 cast(sum(count_request) as double) / count(*) as avg_request
          from sender_results group by 1, 2)
    left join sender_residuals using (run_id, sender)
""")
def sender_summary(fx):
    return views.sender_summary(fx.sender_results(), fx.sender_residuals())


SHARED_SQL["numbered_results"] = """
    select *, row_number() over (partition by run_id, province, region, courier, label
                                 order by week) as week_no
    from courier_results
"""


@query("""
    select t.run_id, t.province, t.region, t.courier, t.label, sum_request, avg_request,
           sum_after_5, count_residual as sum_residual
    from (select run_id, province, region, courier, label,
                 cast(sum(count_request) as bigint) as sum_request,
                 cast(sum(count_request) as double) / count(*) as avg_request,
                 cast(sum(count_request) filter (where week_no > 5) as bigint) as sum_after_5
          from numbered_results group by 1, 2, 3, 4, 5) t
    left join courier_residuals using (run_id, province, region, courier)
""")
def courier_summary(fx):
    return views.courier_summary(fx.courier_results(), fx.courier_residuals())


@query("""
    select run_id, province, region, courier, cast(week as varchar) as week, label, count_request,
           week_no
    from numbered_results
""")
def week_ordinal(fx):
    return relational.week_ordinal(fx.courier_results(), schemas.SERIES_KEYS)


@query("""
    select sender, region, product, cast(delivery_date as varchar) as delivery_date, sum_monthly
    from (select sender, region, product, delivery_date, cast(sum(monthly) as bigint)
                 as sum_monthly
          from estimates left join prov_reg using (province) group by 1, 2, 3, 4)
    where sum_monthly > 0
""")
def sender_view(fx):
    return views.sender_view(fx.estimates(), fx.geo())


@query("""
    select row_number() over (order by sum_monthly desc, region, sender, product, delivery_date)
               as id, sender, region, product, cast(delivery_date as varchar) as delivery_date,
           sum_monthly
    from (select sender, region, product, delivery_date, cast(sum(monthly) as bigint)
                 as sum_monthly
          from estimates left join prov_reg using (province) group by 1, 2, 3, 4)
    where sum_monthly > 0
""")
def sender_view_ids(fx):
    """The view with consecutive ids in its display order."""
    view = views.sender_view(fx.estimates(), fx.geo())
    order = [F.desc("sum_monthly"), "region", "sender", "product", "delivery_date"]
    return relational.with_row_id(view, order)


@query("""
    select distinct courier, province, strftime(from_ts, '%Y-%m') as month, p890, p_ar
    from declared
""")
def active_capacity(fx):
    return views.active_capacity(fx.declared())


@query("""
    select c.courier, r.region, e.product, c.month, cast(sum(e.monthly) as bigint) as sum_monthly
    from (select distinct courier, province, p_ar, p890, strftime(from_ts, '%Y-%m') as month
          from declared) c
    left join prov_reg r on r.province = c.province
    left join estimates e on e.province = c.province
         and ((e.product = 'AR' and c.p_ar) or (e.product = '890' and c.p890))
         and strftime(e.delivery_date, '%Y-%m') = c.month
    group by 1, 2, 3, 4 having sum(e.monthly) > 0
""")
def courier_view(fx):
    return views.courier_view(fx.declared(), fx.estimates(), fx.geo())


@query("""
    select cast(delivery_date as varchar) as delivery_date, product, province,
           cast(sum(weekly) as bigint) as sum_weekly, cast(sum(monthly) as bigint) as sum_monthly
    from (select distinct on (sender, province, product, delivery_date) *
          from (select * from estimates union all select * from estimates_delta)
          order by sender, province, product, delivery_date, updated_at desc, monthly desc,
                   weekly desc)
    group by 1, 2, 3
""")
def estimate_totals(fx):
    return views.estimate_totals(fx.estimates().unionByName(fx.estimates_delta()))


# --- table maintenance ---------------------------------------------------------------------

ESTIMATES = """pk, cast(delivery_date as varchar) as delivery_date, weekly, monthly, original,
    sender, product, province, cast(updated_at as varchar) as updated_at"""
DECLARED = """capacity, province, tender_geokey, p890, p_ar, p_rs, tender_id, courier,
    cast(created_at as varchar) as created_at, peak_capacity,
    cast(from_ts as varchar) as from_ts, cast(to_ts as varchar) as to_ts, pk,
    production_capacity, cast(updated_at as varchar) as updated_at"""


def merge_sql(table, keys, columns, output):
    on = " and ".join(f"t.{k} = s.{k}" for k in keys)
    picked = ", ".join(
        f"case when t.{keys[0]} is null or s.updated_at > t.updated_at then s.{c} else t.{c} end"
        f" as {c}"
        for c in columns
    )
    merged = f"select {picked} from {table} t full outer join {table}_delta s on {on}"
    return f"select {output} from ({merged})"


ESTIMATE_COLUMNS = [
    "pk", "delivery_date", "weekly", "monthly", "original", "sender", "product", "province",
    "updated_at",
]
DECLARED_COLUMNS = [
    "capacity", "province", "tender_geokey", "p890", "p_ar", "p_rs", "tender_id", "courier",
    "created_at", "peak_capacity", "from_ts", "to_ts", "pk", "production_capacity", "updated_at",
]
RUN_COLUMNS = [
    "courier", "from_ts", "to_ts", "capacity", "sum_monthly", "sum_weekly", "region", "province",
    "p890", "p_ar", "updated_at", "is_default", "run_id",
]


@query(merge_sql("estimates", schemas.ESTIMATE_KEYS, ESTIMATE_COLUMNS, ESTIMATES))
def merge_estimates(fx):
    return merge.merge_estimates(fx.estimates(), fx.estimates_delta())


@query(merge_sql("declared", schemas.DECLARED_KEYS, DECLARED_COLUMNS, DECLARED))
def merge_declared(fx):
    return merge.merge_declared(fx.declared(), fx.declared_delta())


@query(merge_sql("run_capacity", schemas.RUN_CAPACITY_KEYS, RUN_COLUMNS, RUN_CAPACITY))
def merge_run_capacity(fx):
    return merge.merge_run_capacity(fx.run_capacity(), fx.run_capacity_delta())


def dedup_sql(source, keys, order, output):
    rank = f"row_number() over (partition by {', '.join(keys)} order by {order})"
    return f"select {output} from (select *, {rank} as rn from ({source})) where rn = 1"


@query(
    dedup_sql(
        "select * from declared union all select * from declared_delta",
        schemas.DECLARED_KEYS,
        "updated_at desc nulls last, created_at desc nulls last, capacity",
        DECLARED,
    )
)
def dedup_declared(fx):
    return merge.dedup_declared(fx.declared_twice())


@query(
    dedup_sql(
        "select * from estimates union all select * from estimates_delta",
        schemas.ESTIMATE_KEYS,
        "updated_at desc nulls last, weekly",
        ESTIMATES,
    )
)
def dedup_estimates(fx):
    return merge.dedup_estimates(fx.estimates().unionByName(fx.estimates_delta()))


@query("""
    select run_id, sender, cast(week as varchar) as week, max(n) as count_request from (
        select run_id, sender, week, count_request as n from sender_results union all
        select run_id, sender, week, count_request % 7 as n from sender_results)
    group by 1, 2, 3
""")
def dedup_sender_results(fx):
    again = fx.sender_results().withColumn("count_request", F.col("count_request") % 7)
    return merge.dedup_results(
        fx.sender_results().unionByName(again), schemas.SENDER_RESULT_KEYS
    )


@query("""
    select run_id, province, region, courier, cast(week as varchar) as week, label,
           max(n) as count_request from (
        select *, count_request as n from courier_results union all
        select *, count_request % 7 as n from courier_results)
    group by 1, 2, 3, 4, 5, 6
""")
def dedup_courier_results(fx):
    again = fx.courier_results().withColumn("count_request", F.col("count_request") % 7)
    return merge.dedup_results(
        fx.courier_results().unionByName(again), schemas.COURIER_RESULT_KEYS
    )


@query(f"select {RUN_CAPACITY} from run_capacity where to_ts is not null")
def drop_open_ended(fx):
    return merge.drop_open_ended(fx.run_capacity())


@query(f"""
    select {RUN_CAPACITY} from run_capacity
    where run_id not in (select run_id from runs where status = 'Bozza')
""")
def delete_run(fx):
    drafts = fx.runs().filter(F.col("status") == schemas.STATUS_DRAFT)
    return merge.delete_runs(fx.run_capacity(), drafts)


@query(f"""
    select run_id, status, trigger, cast(executed_at as varchar) as executed_at,
           case when status = 'In lavorazione'
                     and executed_at < timestamp '{LOAD_DAY}' - interval 2 day
                then 'Non completata'
                when status = 'Schedulata' and trigger = 'Schedule'
                     and executed_at <= timestamp '{LOAD_DAY}' then 'In lavorazione'
                else status end as shown_status
    from run_log
""")
def effective_status(fx):
    shown = merge.effective_status(fx.run_log(), LOAD_DAY)
    return shown.select("run_id", "status", "trigger", "executed_at", "shown_status")


# --- reports and comparisons ---------------------------------------------------------------


@query("""
    select run_id, sender, cast(week as varchar) as week, count_request
    from sender_results join (
        select run_id, sender, row_number() over (partition by run_id
                                                  order by n desc nulls last, sender) as rn
        from (select run_id, sender, sum(count_request) as n from sender_results group by 1, 2))
        using (run_id, sender)
    where rn <= 5
""")
def top_senders(fx):
    results_ = fx.sender_results()
    summary = views.sender_summary(results_, fx.sender_residuals())
    return ranking.top_series(results_, summary, "sum_request", 5)


@query("""
    select run_id, sender, count_residual as sum_residual from (
        select run_id, sender, count_residual,
               row_number() over (partition by run_id
                                  order by count_residual asc nulls last, sender) as rn
        from (select distinct run_id, sender from sender_results)
        left join sender_residuals using (run_id, sender))
    where rn <= 10
""")
def top_senders_by_residuals(fx):
    summary = views.sender_summary(fx.sender_results(), fx.sender_residuals())
    top = ranking.top_members(summary, "sum_residual", 10, desc=False)
    return top.select("run_id", "sender", "sum_residual")


@query("""
    select run_id, sender from (
        select run_id, sender, row_number() over (partition by run_id order by sender) as rn
        from (select distinct run_id, sender from sender_results))
    where rn <= 5
""")
def first_senders(fx):
    return ranking.first_members(fx.sender_results())


SHARED_SQL["run_pairs"] = """
    select a.run_id as run_a, b.run_id as run_b from runs a join runs b on b.run_id = a.run_id + 10
"""


@query("""
    select run_a, run_b, province, region, courier, label, strftime(week, '%m') as week,
           cast(sum(value_a) as bigint) as value_a, cast(sum(value_b) as bigint) as value_b,
           cast(coalesce(sum(value_b), 0) - coalesce(sum(value_a), 0) as bigint) as delta
    from (
        select run_a, run_b, province, region, courier, label, week, count_request as value_a,
               null as value_b
        from courier_results join run_pairs on run_id = run_a
        union all
        select run_a, run_b, province, region, courier, label, week, null, count_request
        from courier_results join run_pairs on run_id = run_b)
    group by 1, 2, 3, 4, 5, 6, 7
""")
def compare_runs(fx):
    """Each run with the one of the same quarter a year later, weeks by their month."""
    pairs = fx.runs().select(F.col("run_id").alias("run_a"))
    later = fx.runs().select(
        F.col("run_id").alias("run_b"), (F.col("run_id") - 10).alias("run_a")
    )
    monthly = fx.courier_results().withColumn("week", F.date_format("week", "MM"))
    members = ["province", "region", "courier", "label"]
    return compare.compare_pairs(monthly, pairs.join(later, "run_a"), members)


SHARED_SQL["chosen_runs"] = """
    select max(run_id) as run_b, max(run_id) - 10 as run_a from sender_results
"""


@query("""
    select run_a, run_b, sender, cast(week as varchar) as week,
           cast(sum(case when run_id = run_a then count_request end) as bigint) as value_a,
           cast(sum(case when run_id = run_b then count_request end) as bigint) as value_b,
           cast(coalesce(sum(case when run_id = run_b then count_request end), 0)
                - coalesce(sum(case when run_id = run_a then count_request end), 0) as bigint)
               as delta
    from sender_results join chosen_runs on run_id in (run_a, run_b) group by 1, 2, 3, 4
""")
def compare_two_runs(fx):
    """The newest run beside the one of a year before, week by week."""
    weekly = fx.sender_results()
    newest = weekly.agg(F.max("run_id")).first()[0]
    return compare.compare_runs(weekly, newest - 10, newest, ["sender"])


@query("""
    select run_id, sender, sum_request,
           row_number() over (partition by run_id order by sum_request desc nulls last, sender)
               as position
    from (select run_id, sender, cast(sum(count_request) as bigint) as sum_request
          from sender_results group by 1, 2)
""")
def ranked_senders(fx):
    summary = views.sender_summary(fx.sender_results(), fx.sender_residuals())
    ranked = ranking.rank_members(summary, "sum_request")
    return ranked.select("run_id", "sender", "sum_request", "position")


@query("""
    select run_id, sender, count_residual as sum_residual,
           row_number() over (partition by run_id order by count_residual asc nulls last, sender)
               as position
    from (select distinct run_id, sender from sender_results)
    left join sender_residuals using (run_id, sender)
""")
def ranked_by_residuals(fx):
    summary = views.sender_summary(fx.sender_results(), fx.sender_residuals())
    ranked = ranking.rank_members(summary, "sum_residual", desc=False)
    return ranked.select("run_id", "sender", "sum_residual", "position")


@query("""
    select run_id, sender, cast(week as varchar) as week, count_request
    from sender_results where sender in ('S1', 'S3', 'S5') and run_id % 10 = 1
""")
def series_for(fx):
    first = fx.runs().filter("run_id % 10 = 1")
    return relational.series_for(fx.sender_results(), sender=["S1", "S3", "S5"], run_id=first)


@query("""
    select run_id, courier, cast(week as varchar) as week,
           cast(sum(count_request) as bigint) as count_request
    from courier_results group by 1, 2, 3
""")
def courier_week_totals(fx):
    return compare.courier_week_totals(fx.courier_results())


@query("""
    select run_id, cast(min(week) as varchar) as first_week from courier_results group by 1
""")
def run_start(fx):
    return compare.run_start(fx.courier_results())


@query("""
    select run_id, label, max(week) > any_value(m1 + cast((8 - isodow(m1)) % 7 as int)) as overflows
    from courier_results join (
        select run_id, cast(date_trunc('month', min(week)) + interval 1 month as date) as m1
        from courier_results group by 1) using (run_id)
    group by 1, 2
""")
def overflow_series(fx):
    return compare.overflow_series(fx.courier_results())


@query("""
    select strftime(month, '%Y-%m') as month,
           ['Gennaio', 'Febbraio', 'Marzo', 'Aprile', 'Maggio', 'Giugno', 'Luglio', 'Agosto',
            'Settembre', 'Ottobre', 'Novembre', 'Dicembre'][month(month)] || ' ' || year(month)
               as label
    from month_list
""")
def available_months(fx):
    return compare.available_months(fx.estimates())


SHARED_SQL["done_runs"] = """
    select run_id, executed_at from run_log
    where run_type = 'Automatizzata' and status = 'Lavorata'
"""


@query("""
    select run_id, run_type, cast(executed_at as varchar) as executed_at,
           case when run_type = 'Automatizzata' and month(monday - 7) = month(monday) then
                    (select min(d.run_id) from done_runs d
                     where cast(d.executed_at as date) = monday - 7)
                when run_type = 'Manuale' and month(executed_at) = month(monday) then
                    (select arg_max(d.run_id, d.executed_at) from done_runs d
                     where date_trunc('month', d.executed_at) = date_trunc('month', monday)) end
               as compare_with
    from (select *, cast(date_trunc('week', executed_at) as date) as monday from run_log)
""")
def comparable_automated(fx):
    found = compare.comparable_automated(fx.run_log())
    return found.select("run_id", "run_type", "executed_at", "compare_with")


@query("""
    select c.run_id as compared, r.run_id, r.month, r.run_type
    from run_log r join run_log c on r.month = c.month and r.run_id <> c.run_id
    where r.status = 'Lavorata'
""")
def comparable_runs(fx):
    """The runs each run can be compared with."""
    return compare.comparable_runs(fx.run_log()).select("compared", "run_id", "month", "run_type")


@query("""
    select run_id, status, cast(executed_at as varchar) as executed_at from run_log
    where status is distinct from 'Bozza'
""")
def non_draft_runs(fx):
    return compare.non_draft_runs(fx.run_log()).select("run_id", "status", "executed_at")


@query("""
    select run_id, month from runs
    where run_id in (select run_id from run_capacity where is_default is null)
""")
def runs_with_postal(fx):
    cap = fx.run_capacity().filter(F.col("is_default").isNull())
    return compare.runs_with_postal(fx.runs(), cap).select("run_id", "month")


@query("select distinct region, province_name from geo")
def provinces_of_region(fx):
    return compare.provinces_of(fx.geo())


# --- files ---------------------------------------------------------------------------------


@query("""
    select run_id, courier as "unifiedDeliveryDriver", province as "geoKey", capacity,
           capacity as "peakCapacity",
           strftime(from_ts, '%Y-%m-%dT%H:%M:%S.000Z') as "activationDateFrom",
           strftime(to_ts, '%Y-%m-%dT%H:%M:%S.000Z') as "activationDateTo",
           case when p890 then '890,' else '' end || case when p_ar then 'AR,' else '' end || 'RS'
               as products
    from run_capacity where not (p890 is null and p_ar is null)
""")
def export_province_capacity(fx):
    return files.province_capacity_rows(fx.run_capacity())


@query("""
    select capacity, courier, postal_code, peak_capacity, cast(from_ts as varchar) as from_ts,
           cast(to_ts as varchar) as to_ts
    from assigned
""")
def csv_batches(fx):
    """The full postal-capacity file, written in batches and read back."""
    path = work_folder(fx.spark, "postal-capacity")
    files.write_csv_batches(files.postal_capacity_rows(assigned(fx)), path)
    return files.read_capacity_csv(fx.spark, path).drop("products")


@query("""
    select key, cast(week as varchar) as week, postal_code, allocated
    from allocated_rows where strftime(week, '%Y-%m') = '1999-05'
""")
def latest_snapshot(fx):
    """Two extracts of all months' allocations; the month's newest one is read back."""
    base = work_folder(fx.spark, "extracts")
    month = F.date_format("week", "yyyy-MM")
    rows = allocation(fx, by=month).select("key", "week", "postal_code", "allocated")
    both = rows.select(
        "*",
        F.explode(F.array(F.lit("1999-04-20"), F.lit("1999-04-27"))).alias("extract_date"),
        month.alias("month"),
    ).withColumn(
        "allocated",
        F.when(F.col("extract_date") == "1999-04-27", F.col("allocated")).otherwise(0),
    )
    files.write_snapshots(both, base, placed=True)
    found = files.read_latest_snapshot(fx.spark, base, "1999-05", "1999-05-03")
    return found.select("key", "week", "postal_code", "allocated")


def exported_weeks(fx):
    """Allocated rows of all weeks, written in batches with one folder per week label."""
    base = work_folder(fx.spark, "weeks")
    label = cal.next_monday("week")
    rows = allocation(fx, by=label).select(
        "key", "postal_code", "allocated", label.alias("week_label")
    )
    files.write_by_week(rows, base, compression="gzip", placed=True)
    return base


@query("""
    select week_no, cast(week as varchar) as week, rows_, true as batched
    from (select row_number() over (order by week) as week_no, week, rows_
          from (select cast(date_trunc('week', week) as date) + 7 as week, count(*) as rows_
                from allocated_rows group by 1))
""")
def week_manifest(fx):
    """The week folders found on storage, with the rows in their files."""
    base = exported_weeks(fx)
    found = manifest.week_manifest(fx.spark, base)
    lines = (
        fx.spark.read.option("recursiveFileLookup", True)
        .option("sep", ";")
        .option("header", True)
        .schema("key string, postal_code string, allocated bigint")
        .csv(base)
        .select(F.col("_metadata.file_path").alias("path"))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("rows_"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    sized = found.filter(F.col("path").isNotNull()).withColumn("file", name)
    counted = lines.withColumn("file", name).select("file", "rows_", F.col("path").alias("at"))
    label = F.to_date(F.regexp_extract("at", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1))
    return (
        sized.join(counted.withColumn("week", label), ["week", "file"])
        .groupBy("week_no", "week")
        .agg(F.sum("rows_").alias("rows_"), (F.max("rows_") <= schemas.MAX_CSV_ROWS).alias("batched"))
    )


@query("""
    select file_name, cast(max(e) as bigint) as expected, cast(max(l) as bigint) as loaded,
           case when max(l) = 0 then 'missing' when max(e) = 0 then 'unexpected' else 'loaded' end
               as status
    from (
        select 'week_' || cast(week as varchar) as file_name, 1 as e, 0 as l from ship_weeks
        where dayofyear(week) // 7 % 5 <> 0
        union all
        select 'week_' || cast(week as varchar), 0, 1 from ship_weeks
        where dayofyear(week) // 7 % 4 <> 0)
    group by 1
""")
def reconcile_manifest(fx):
    """Expected and loaded week files; the two sides lack different weeks."""
    weeks = fx.processed().select(
        F.concat(F.lit("week_"), F.col("week").cast("string")).alias("file_name"),
        week_of_year("week").alias("no"),
    )
    expected, loaded = weeks.filter(F.col("no") % 5 != 0), weeks.filter(F.col("no") % 4 != 0)
    return manifest.reconcile_manifest(expected, loaded)


@query("""
    select courier as "UNIFIED_DELIVERY_DRIVER", region as "REGIONE", product as "PRODUCT_TYPE",
           month as "DELIVERY_DATE", sum_monthly as "SUM_MONTHLY_ESTIMATE"
    from (select c.courier, r.region, e.product, c.month,
                 cast(sum(e.monthly) as bigint) as sum_monthly
          from (select distinct courier, province, p_ar, p890,
                       strftime(from_ts, '%Y-%m') as month from declared) c
          left join prov_reg r on r.province = c.province
          left join estimates e on e.province = c.province
               and ((e.product = 'AR' and c.p_ar) or (e.product = '890' and c.p890))
               and strftime(e.delivery_date, '%Y-%m') = c.month
          group by 1, 2, 3, 4 having sum(e.monthly) > 0)
    where month = '1996-05'
""")
def export_courier_view(fx):
    """A month's file of the courier view, read back."""
    path = work_folder(fx.spark, "courier-view")
    files.export_courier_view(
        views.courier_view(fx.declared(), fx.estimates(), fx.geo()), path, "1996-05"
    )
    schema = (
        "DELIVERY_DATE string, UNIFIED_DELIVERY_DRIVER string, REGIONE string, "
        "PRODUCT_TYPE string, SUM_MONTHLY_ESTIMATE bigint"
    )
    return fx.spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


@query("""
    select week_label, count(*) as pieces, count(distinct request_id) as ids,
           count(distinct postal_code) as codes
    from (select cast(cast(date_trunc('week', week) as date) + 7 as varchar) as week_label,
                 postal_code, key || week || attempt || postal_code || n as request_id
          from (select *, unnest(generate_series(1, allocated)) as n from allocated_rows))
    group by 1
""")
def export_pieces(fx):
    """All pieces written in batches by week and read back from the folders found."""
    base = work_folder(fx.spark, "pieces")
    allocated = allocation(fx, by=cal.next_monday("week"))
    pieces.export_allocation(allocated, base, compression="gzip", placed=True)
    header = ", ".join(f"{name} string" for name in schemas.CSV_PIECE_HEADER.values())
    read = (
        fx.spark.read.schema(f"{header}, week_label string")
        .option("sep", ";")
        .option("header", True)
        .csv(base)
    )
    # Two aggregates: one with both distinct counts would double the rows before its shuffle.
    codes = read.groupBy("week_label", "cap").agg(F.count(F.lit(1)).alias("n"))
    codes = codes.groupBy("week_label").agg(F.sum("n").alias("pieces"), F.count("cap").alias("codes"))
    ids = read.groupBy("week_label").agg(F.count_distinct("requestId").alias("ids"))
    return codes.join(ids, "week_label").select("week_label", "pieces", "ids", "codes")


@query("""
    select run_id, sender, cast(week as varchar) as week, count_request from sender_results
    union all
    select run_id + 1000, sender, cast(week as varchar), count_request from sender_results
""")
def append_table(fx):
    """A table that two loads append to, read back."""
    base = work_folder(fx.spark, "tables")
    for shift in (0, 1000):
        rows = fx.sender_results().withColumn("run_id", F.col("run_id") + shift)
        tables.append_table(rows, base, "results")
    return tables.read_table(fx.spark, base, "results")


@query("""
    select run_id, sender, cast(week as varchar) as week, count_request from sender_results
    where run_id = (select min(run_id) from runs)
""")
def read_run(fx):
    """The stored results of one run; the condition reaches the scan."""
    base = work_folder(fx.spark, "tables")
    tables.append_table(fx.sender_results(), base, "results")
    oldest = fx.runs().agg(F.min("run_id")).first()[0]
    return tables.read_table(fx.spark, base, "results", F.col("run_id") == oldest)


@query("select postal_code, region, province_name, province, pop from geo")
def reload_dim(fx):
    """A dimension loaded from CSV files with a header, read back."""
    base = work_folder(fx.spark, "dimension")
    wanted = ["postal_code", "region", "province_name", "province", "pop"]
    fx.geo().select(*wanted).write.option("header", True).csv(f"{base}/csv")
    schema = "postal_code string, region string, province_name string, province string, pop bigint"
    tables.reload_dim(fx.spark, f"{base}/csv", base, "geo", schema)
    return tables.read_table(fx.spark, base, "geo")


@query(merge_sql("estimates", schemas.ESTIMATE_KEYS, ESTIMATE_COLUMNS, ESTIMATES))
def guarded_merge(fx):
    """The weekly load: an upsert that an empty delta would fail, then an empty staging table."""
    delta = fx.estimates_delta()
    merged = merge.guarded_merge(fx.estimates(), delta, schemas.ESTIMATE_KEYS, "empty delta")
    return merged.unionByName(merge.truncate_staging(delta))


# --- stored tables -------------------------------------------------------------------------


def by_month(df, date):
    return df.withColumn("month", cal.month_key(date))


def stored_table(fx, name, df, by):
    """Stores a table by ``by``; returns its path and schema."""
    path = work_folder(fx.spark, name)
    stored.store(df, path, by)
    return path, df.schema


@query(merge_sql("estimates", schemas.ESTIMATE_KEYS, ESTIMATE_COLUMNS, ESTIMATES))
def merge_staged_estimates(fx):
    """The weekly load on stored tables: staging into months, with the staging table after it."""
    path, schema = stored_table(fx, "estimates", by_month(fx.estimates(), "delivery_date"), "month")
    staging = work_folder(fx.spark, "staging")
    by_month(fx.estimates_delta(), "delivery_date").write.parquet(staging)
    stored.merge_staged(
        fx.spark, staging, path, schema, schemas.ESTIMATE_KEYS, "month", "empty staging table"
    )
    rows = stored.read_stored(fx.spark, path, schema)
    return rows.unionByName(fx.spark.read.parquet(staging)).drop("month")


@query(merge_sql("declared", schemas.DECLARED_KEYS, DECLARED_COLUMNS, DECLARED))
def merge_stored_declared(fx):
    path, schema = stored_table(fx, "declared", by_month(fx.declared(), "from_ts"), "month")
    delta = by_month(fx.declared_delta(), "from_ts")
    stored.upsert_stored(delta, path, schema, schemas.DECLARED_KEYS, "month")
    return stored.read_stored(fx.spark, path, schema).drop("month")


@query(merge_sql("run_capacity", schemas.RUN_CAPACITY_KEYS, RUN_COLUMNS, RUN_CAPACITY))
def merge_stored_run_capacity(fx):
    path, schema = stored_table(fx, "run-capacity", fx.run_capacity(), "run_id")
    stored.upsert_stored(
        fx.run_capacity_delta(), path, schema, schemas.RUN_CAPACITY_KEYS, "run_id"
    )
    return stored.read_stored(fx.spark, path, schema)


@query(f"""
    select {RUN_CAPACITY} from run_capacity where to_ts is not null
    and run_id not in (select run_id from runs where status = 'Bozza')
""")
def delete_stored_runs(fx):
    """Stored capacities without the drafts' partitions and without open-ended rows."""
    path, schema = stored_table(fx, "run-capacity", fx.run_capacity(), "run_id")
    stored.delete_stored(path, fx.runs().filter(F.col("status") == schemas.STATUS_DRAFT))
    stored.drop_rows_stored(fx.spark, path, schema, F.col("to_ts").isNull(), "run_id")
    return stored.read_stored(fx.spark, path, schema)


SHARED_SQL["province_file"] = """
    select run_id, is_default, courier as "unifiedDeliveryDriver", province as "geoKey", capacity,
           capacity as "peakCapacity",
           strftime(from_ts, '%Y-%m-%dT%H:%M:%S.000Z') as "activationDateFrom",
           strftime(to_ts, '%Y-%m-%dT%H:%M:%S.000Z') as "activationDateTo",
           case when p890 then '890,' else '' end || case when p_ar then 'AR,' else '' end || 'RS'
               as products
    from run_capacity where not (p890 is null and p_ar is null)
"""


@query("""
    select * exclude (is_default), 'all' as file from province_file
    union all
    select * exclude (is_default), 'modified' as file from province_file where not is_default
""")
def province_capacity_files(fx):
    """The files of all runs, complete and with modified capacities only, read back."""
    found = []
    for name in ("all", "modified"):
        path = work_folder(fx.spark, f"province-{name}")
        files.export_province_capacity(fx.run_capacity(), path, modified_only=name == "modified")
        rows = files.read_province_capacity(fx.spark, path)
        found.append(rows.withColumn("file", F.lit(name)))
    return found[0].unionByName(found[1])


@query("""
    select cast(week as varchar) as week, listed, missing, missing = 0 as complete
    from (select week, count(*) as listed,
                 case when week = min(week) over () then 1 else 0 end as missing
          from (select cast(date_trunc('week', week) as date) + 7 as week from allocated_rows)
          group by 1)
""")
def reconcile_loaded_files(fx):
    """A load that lost one file of the first week, checked against the files that are there."""
    base = exported_weeks(fx)
    listed = manifest.listed_rows(fx.spark, base)
    lost = listed.agg(F.min_by("file", F.struct("week", "file")).alias("file"))
    read = (
        fx.spark.read.option("recursiveFileLookup", True)
        .option("sep", ";")
        .option("header", True)
        .schema("key string, postal_code string, allocated bigint")
        .csv(base)
    )
    loaded = manifest.loaded_rows(read).join(lost, "file", "left_anti")
    found = manifest.reconcile_files(listed, loaded)
    bad = F.count_if(F.col("status") != "loaded")
    # A week's files differ in number from run to run; its rows and lost files do not.
    return found.groupBy("week").agg(
        F.sum("listed").alias("listed"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        (bad == 0).alias("complete"),
    )


@query("""
    select run_id, region, courier, peak, cast(count(*) as bigint) as series,
           cast(count(distinct province) as bigint) as provinces
    from (select c.run_id, c.province, c.region, c.courier,
                 max(case when count_request >= k.capacity then 1 else 0 end) as peak
          from courier_results c
          left join (select run_id, courier, province, from_ts, min(capacity) as capacity
                     from run_capacity group by 1, 2, 3, 4) k
               on k.run_id = c.run_id and k.courier = c.courier and k.province = c.province
               and k.from_ts = cast(c.week as timestamp)
          where c.run_id = 19961
          group by 1, 2, 3, 4)
    group by 1, 2, 3, 4
""")
def view_by_name(fx):
    """SQL on a registered view; the run id reaches the scans."""
    named.register_views({name: getattr(fx, name)() for name in named.TABLES})
    return fx.spark.sql("""
        select run_id, region, courier, peak, count(*) as series,
               count(distinct province) as provinces
        from peak_table where run_id = 19961 group by run_id, region, courier, peak
    """)


@query("""
    select 'item' as kind, sender, province, product, cast(monthly as double) as monthly,
           cast(null as varchar) as reason
    from estimates where month(delivery_date) % 4 > 2
    union all
    select 'rejected', sender, province, product, null,
           case month(delivery_date) % 4 when 0 then 'malformed' when 1 then 'malformed'
                else 'no items' end
    from estimates where month(delivery_date) % 4 <= 2
""")
def damaged_pages(fx):
    """Pages with cut bodies, values of a wrong type and without items: good items and rejected
    pages side by side."""
    case = F.month("delivery_date") % 4
    item = F.struct("product", F.col("monthly").cast("double").alias("monthly"))
    whole = F.to_json(F.struct(F.array(item).alias("items")))
    wrong = F.to_json(F.struct(F.array(F.struct(F.array("product").alias("monthly"))).alias("items")))
    body = (
        F.when(case == 0, F.substring(whole, 1, 20))
        .when(case == 1, wrong)
        .when(case == 2, F.lit("{}"))
        .otherwise(whole)
    )
    landed = fx.estimates().select(
        "sender", "province", F.col("product").alias("asked"), body.alias("body")
    )
    schema, keep = "product string, monthly double", ["sender", "province", "asked"]
    items, rejected = pages.split_pages(landed, schema, keep=keep)
    good = items.select(
        F.lit("item").alias("kind"), "sender", "province", "product", "monthly",
        F.lit(None).cast("string").alias("reason"),
    )
    bad = rejected.select(
        F.lit("rejected").alias("kind"), "sender", "province", F.col("asked").alias("product"),
        F.lit(None).cast("double").alias("monthly"), "reason",
    )
    return good.unionByName(bad)


@query("""
    select sender, province, product, workflow_step, cast(week as varchar) as week,
           count(*) as pieces, count(distinct request_id) as ids
    from (
        select key || '~' || cast(week as varchar) || '~' || attempt || '~' || postal_code || '~'
                   || n as request_id, sender, province, product,
               'EVALUATE_SENDER_LIMIT' as workflow_step, week
        from (select *, unnest(generate_series(1, allocated)) as n from allocated_rows)
        union all
        select request_id, sender, province, product, step, week from pieces
        where step = 'EVALUATE_SENDER_LIMIT')
    group by 1, 2, 3, 4, 5
""")
def pieces_with_residuals(fx):
    """The next export: new pieces and those the planner left over."""
    left = pieces.residual_pieces(fx.pieces())
    exported = pieces.explode_pieces(allocation(fx), left, placed=True)
    return exported.groupBy("sender", "province", "product", "workflow_step", "week").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("request_id").alias("ids")
    )


@query("""
    select cast(cast(date_trunc('week', week) as date) + 7 as varchar) as extract_date,
           strftime(week, '%Y-%m') as month, count(*) as rows_
    from allocated_rows group by 1, 2
""")
def path_parts(fx):
    """Day, month and file of dated extract paths, counted."""
    day = F.date_format(cal.next_monday("week"), "yyyy/MM/dd")
    month = F.date_format("week", "yyyy-MM")
    path = F.concat_ws("/", F.lit("base/in"), day, month, F.col("postal_code"))
    parts = fn.path_parts(path, 2)
    return (
        allocation(fx).select(parts["extract_date"].alias("extract_date"), parts["month"].alias("month"))
        .groupBy("extract_date", "month")
        .agg(F.count(F.lit(1)).alias("rows_"))
    )


@query("""
    select sender, province, product, monthly + 0.5::double as monthly
    from estimates where monthly % 2 = 0
""")
def decode_body(fx):
    """Single bodies decoded one by one; malformed ones give NULL and drop out."""
    even = F.col("monthly") % 2 == 0
    good = F.to_json(F.struct("sender", "province", "product", (F.col("monthly") + 0.5).alias("m")))
    bodies = fx.estimates().select(F.when(even, good).otherwise(F.lit("{broken")).alias("body"))
    schema = "sender string, province string, product string, m double"
    rows = bodies.select(fn.decode_body("body", schema).alias("r")).filter("r.sender is not null")
    return rows.select("r.sender", "r.province", "r.product", F.col("r.m").alias("monthly"))
