"""The derivations of ``fixtures`` in SQL, as named common table expressions."""

import re

FIXTURES = {
    "nations": """
        select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey
    """,
    "customer_nation": """
        select c_custkey, n_name as province from customer join nation on c_nationkey = n_nationkey
    """,
    "geo_codes": """
        select lpad(cast(c_custkey as varchar), 12, '0') as postal_code,
               c_nationkey as n_nationkey,
               cast(floor(abs(c_acctbal)) as bigint) + 1 as pop
        from customer
    """,
    "geo": """
        select postal_code, r_name as region, 'Province of ' || n_name as province_name,
               n_name as province, pop,
               cast((pop * 1000000000) // cast(sum(pop) over (partition by n_name) as bigint)
                    as bigint) as nano
        from geo_codes join nations using (n_nationkey)
    """,
    "prov_reg": "select distinct province, region from geo",
    "estimates": """
        select sender || '~' || product || '~' || province as pk, delivery_date,
               cast(monthly // 4 as bigint) as weekly, monthly, monthly as original,
               sender, product, province, cast(delivery_date as timestamp) as updated_at
        from (
            select 'S' || cast(o_custkey % 40 as varchar) as sender, province,
                   case when o_orderpriority in ('1-URGENT', '2-HIGH') then '890' else 'AR' end
                       as product,
                   cast(date_trunc('month', o_orderdate) as date) as delivery_date,
                   cast(sum(case
                       when o_custkey % 40 = 7 and o_orderpriority in ('1-URGENT', '2-HIGH')
                            and date_trunc('month', o_orderdate) = date '1995-03-01' then 150000
                       when o_custkey % 20 = 0 then 700 when o_custkey % 4 = 2 then 1
                       else 17 end) as bigint) as monthly
            from orders join customer_nation on o_custkey = c_custkey
            group by 1, 2, 3, 4
        )
    """,
    "estimates_delta": """
        select pk,
               case when product = 'AR' and month(delivery_date) % 2 = 0
                    then cast(delivery_date + interval 240 month as date)
                    else delivery_date end as delivery_date,
               weekly + 1 as weekly, monthly * 2 as monthly, original, sender, product, province,
               updated_at + case month(delivery_date) % 3 when 0 then interval 1 day
                   when 1 then interval 0 day else interval (-1) day end as updated_at
        from estimates
    """,
    "declared": """
        select capacity, province, 'T24~' || province as tender_geokey, p890, p_ar, true as p_rs,
               'T24' as tender_id, courier, week - interval 30 day as created_at,
               (capacity * 13) // 10 as peak_capacity, week as from_ts,
               week + interval 6 day as to_ts, courier || '~' || province as pk,
               (capacity * 11) // 10 as production_capacity,
               week - interval 1 day as updated_at
        from (
            select 'K' || cast(l_suppkey % 10 as varchar) as courier, n_name as province,
                   cast(date_trunc('week', l_shipdate) as timestamp) as week,
                   l_suppkey % 3 <> 0 as p890, l_suppkey % 2 = 0 as p_ar,
                   cast(sum(l_quantity) as bigint) as capacity
            from lineitem join supplier on l_suppkey = s_suppkey
                 join nation on s_nationkey = n_nationkey
            group by 1, 2, 3, 4, 5
        )
    """,
    "declared_delta": """
        select capacity + 5 as capacity, province, tender_geokey, p890, p_ar, p_rs, tender_id,
               courier, created_at, peak_capacity,
               case when p890 then from_ts else from_ts + interval 7280 day end as from_ts,
               to_ts, pk, production_capacity,
               updated_at + case (dayofyear(from_ts) // 7) % 3 when 0 then interval 1 day
                   when 1 then interval 0 day else interval (-1) day end as updated_at
        from declared
    """,
    "postal_capacity": """
        select 'K' || cast(c_custkey % 10 as varchar) as courier,
               lpad(cast(c_custkey as varchar), 12, '0') as postal_code,
               c_custkey % 50 + 1 as capacity, (c_custkey % 50 + 1) * 2 as peak_capacity,
               timestamp '2001-01-01 00:00:00' as from_ts, cast(null as timestamp) as to_ts
        from customer
    """,
    "monthly_by_product": """
        select province, delivery_date, product, cast(sum(monthly) as bigint) as m
        from estimates group by 1, 2, 3
    """,
    "run_capacity": """
        with weekly as (
            select courier, province, from_ts, cast(sum(capacity) as bigint) as capacity,
                   bool_or(p890) as p890, bool_or(p_ar) as p_ar,
                   dayofyear(from_ts) // 7 as wk, cast(substr(courier, 2) as int) as no,
                   cast(date_trunc('month', from_ts) as date) as mon
            from declared group by courier, province, from_ts
        ), sums as (
            select w.*, r.region,
                   case when p890 then coalesce(a.m, 0) else 0 end
                   + case when p_ar then coalesce(b.m, 0) else 0 end as sum_monthly
            from weekly w join prov_reg r using (province)
            left join monthly_by_product a
                on a.province = w.province and a.delivery_date = w.mon and a.product = '890'
            left join monthly_by_product b
                on b.province = w.province and b.delivery_date = w.mon and b.product = 'AR'
        )
        select courier, from_ts,
               case when wk % 13 <> 12 then from_ts + interval 6 day + interval 86399 second end
                   as to_ts,
               capacity, sum_monthly, sum_monthly // 4 as sum_weekly, region, province,
               case when not (no = 6 and wk % 4 = 1) then p890 end as p890,
               case when not (no = 6 and wk % 4 = 1) then p_ar end as p_ar,
               from_ts + interval 2 day as updated_at,
               case when no = 4 then false when no = 8 and wk % 5 = 0 then null
                    when no % 2 = 0 then wk % 3 <> 0 else true end as is_default,
               year(from_ts) * 10 + quarter(from_ts) as run_id
        from sums
    """,
    "run_capacity_delta": """
        select courier,
               case when (dayofyear(from_ts) // 7) % 2 = 1 then from_ts
                    else from_ts + interval 7280 day end as from_ts,
               to_ts, capacity + 7 as capacity, sum_monthly, sum_weekly, region, province, p890,
               p_ar,
               updated_at + case (dayofyear(from_ts) // 7) % 3 when 0 then interval 1 day
                   when 1 then interval 0 day else interval (-1) day end as updated_at,
               is_default, run_id
        from run_capacity
    """,
    "ship_weeks": "select distinct cast(date_trunc('week', l_shipdate) as date) as week from lineitem",
    "runs": """
        select run_id, 'run ' || run_id as name,
               case when run_id % 6 < 2 then 'Lavorata' when run_id % 6 = 2 then 'In lavorazione'
                    when run_id % 6 = 3 then 'Schedulata' when run_id % 6 = 4 then 'Bozza' end
                   as status,
               case when run_id % 2 = 0 then 'Now' else 'Schedule' end as trigger,
               first - interval 10 day as executed_at,
               (run_id // 10) || '-' || lpad(cast((run_id % 10) * 3 - 2 as varchar), 2, '0')
                   as month,
               case run_id % 4 when 0 then 'BAU' when 1 then 'Picco' when 2 then 'Combinata'
                    else 'Produzione' end as capacity_type,
               case when run_id % 3 = 0 then 'Manuale' else 'Automatizzata' end as run_type
        from (select year(week) * 10 + quarter(week) as run_id, min(week) as first
              from ship_weeks group by 1)
    """,
    "run_log": """
        select run_id,
               case when n % 6 < 2 then 'Lavorata' when n % 6 = 2 then 'In lavorazione'
                    when n % 6 = 3 then 'Schedulata' when n % 6 = 4 then 'Bozza' end as status,
               case when n % 2 = 0 then 'Now' else 'Schedule' end as trigger, executed_at,
               strftime(executed_at, '%Y-%m') as month,
               case when n % 3 = 0 then 'Manuale' else 'Automatizzata' end as run_type
        from (
            select run_id, run_id // 2 as n,
                   cast(week as timestamp) + case when run_id % 5 = 0 then interval 3 day
                       else interval 6 hour end as executed_at
            from (select week, date_diff('day', date '1990-01-01', week) // 7 as run_id
                  from ship_weeks)
        )
    """,
    "pieces": """
        select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as request_id,
               'S' || cast(o_custkey % 40 as varchar) as sender, province,
               lpad(cast(o_custkey as varchar), 12, '0') as postal_code,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then '890' else 'AR' end
                   as product,
               'K' || cast(l_suppkey % 10 as varchar) as courier,
               case when l_returnflag = 'R' then 'EVALUATE_SENDER_LIMIT'
                    else 'EVALUATE_PRINT_CAPACITY' end as step,
               cast(date_trunc('week', l_shipdate) as date) as week,
               year(date_trunc('week', l_shipdate)) * 10 + quarter(date_trunc('week', l_shipdate))
                   as run_id
        from lineitem join orders on l_orderkey = o_orderkey
             join customer_nation on o_custkey = c_custkey
    """,
    "sender_results": """
        select run_id, sender, week, count(distinct request_id) as count_request
        from pieces where step = 'EVALUATE_PRINT_CAPACITY' group by 1, 2, 3
    """,
    "courier_results": """
        select run_id, province, region, courier, week, province || ' - ' || courier as label,
               count(distinct request_id) as count_request
        from pieces join prov_reg using (province) where step = 'EVALUATE_PRINT_CAPACITY'
        group by 1, 2, 3, 4, 5
    """,
    "last_residuals": """
        select pieces.* from pieces
        join (select run_id, max(week) as week from pieces group by 1) using (run_id, week)
        where step = 'EVALUATE_SENDER_LIMIT'
    """,
    "sender_residuals": """
        select run_id, sender, count(distinct request_id) as count_residual
        from last_residuals group by 1, 2
    """,
    "courier_residuals": """
        select run_id, province, region, courier, province || ' - ' || courier as label,
               count(distinct request_id) as count_residual
        from last_residuals join prov_reg using (province) group by 1, 2, 3, 4
    """,
    "overrides": """
        select run_id, courier, region, province,
               case when no = 3 then from_ts + interval 7280 day else from_ts end as from_ts,
               case when no = 3 then from_ts + interval 7280 day else from_ts end
                   + interval 6 day + interval 86399 second as to_ts,
               sum_monthly, sum_weekly, p890, p_ar, capacity * 2 as capacity,
               capacity as real_capacity, capacity + 1 as base_capacity,
               capacity % 3 <> 0 as is_default
        from (select *, cast(substr(courier, 2) as int) as no from run_capacity)
        where p890 is not null and to_ts is not null
    """,
}


def with_fixtures(query, extra=None):
    """The query with the fixtures it needs in front, in dependency order."""
    known = {**FIXTURES, **(extra or {})}
    names = list(known)
    needed, todo = set(), [query]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(known[name])
    parts = ",\n".join(f"{n} as ({known[n].strip()})" for n in names if n in needed)
    return f"with {parts}\n{query.strip()}" if parts else query.strip()
