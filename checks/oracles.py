"""DuckDB SQL for every query that SQL can express.

`RELATIONS` are shared views (the raw tables of FIXTURES.md and what is derived from them); each query names
the ones it needs and they are put in front of it as common table expressions.
"""

from __future__ import annotations

from tradewind.params import NO_PURCHASE_SEGMENT
from tradewind.sources.adapter import ADAPTER_PARAMS as P


# Expressions with the same arithmetic as tradewind.functions.numeric and temporal.
def tot(x: str) -> str:
    return f"(coalesce(sum(round_even(({x}) * 1e6, 0)::decimal(28,0))::double, 0.0) / 1e6)"


def tot_if(test: str, x: str) -> str:
    return tot(f"case when {test} then {x} end")


def tot_over(x: str, window: str) -> str:
    return f"(coalesce((sum(round_even(({x}) * 1e6, 0)::decimal(28,0)) over ({window}))::double, 0.0) / 1e6)"


def mean(x: str) -> str:
    return f"({tot(x)} / nullif(count({x}), 0))"


def mean_if(test: str, x: str) -> str:
    return mean(f"case when {test} then {x} end")


def rnd(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


def ratio(a: str, b: str) -> str:
    return f"((({a})::double) / nullif(({b})::double, 0))"


def ratio0(a: str, b: str) -> str:
    return f"coalesce({ratio(a, b)}, 0.0)"


def pct(a: str, b: str, digits: int | None = 1) -> str:
    value = f"({ratio(a, b)} * 100)"
    return value if digits is None else rnd(value, digits)


def secs(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6)"


def days(later: str, earlier: str) -> str:
    return f"({secs(later, earlier)} / 86400.0::double)"


def flag(x: str) -> str:
    return f"coalesce(sum(({x})::int), 0)::bigint"


def isum(x: str) -> str:
    return f"coalesce(sum({x}), 0)::bigint"


RECOGNIZED = "('Complete', 'Shipped')"
VALID = "('Complete', 'Shipped', 'Processing', 'Returned')"
ITEM_ID = "(l_orderkey * 1000000 + (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 1299709) % 1000000)"
SALE_BAND = """case when sale_price >= 0 and sale_price < 25 then '<$25' when sale_price >= 25 and sale_price < 50 then '$25-50'
    when sale_price >= 50 and sale_price < 100 then '$50-100' when sale_price >= 100 and sale_price < 200 then '$100-200'
    when sale_price >= 200 then '$200+' end"""

# name: (relations it needs, SQL)
RELATIONS: dict[str, tuple[str, str]] = {
    "raw_orders": (
        "",
        """select o_orderkey as order_id, o_custkey as user_id, status,
            case when o_custkey % 89 = 0 then null when o_custkey % 2 = 0 then 'F' else 'M' end as gender,
            case when o_orderkey % 41 <> 0 then base end as created_at,
            case when status = 'Returned' and o_orderkey % 233 <> 0
                then delivered + to_hours((case when o_orderkey % 211 = 0 then 0 else 24 + (o_orderkey * 5) % 240 end)::int) end as returned_at,
            shipped as shipped_at, delivered as delivered_at, (1 + o_orderkey % 7)::int as num_of_item
        from (
            select *, case when status in ('Complete', 'Returned') and o_orderkey % 331 <> 0
                then shipped + to_hours((case when o_orderkey % 499 = 0 then 0 else 12 + (o_orderkey * 11) % 180 end)::int) end as delivered
            from (
                select *, case when status in ('Shipped', 'Complete', 'Returned')
                    then base + to_hours((case when o_orderkey % 997 = 0 then 0 else 6 + (o_orderkey * 7) % 60 end)::int) end as shipped
                from (
                    select *, o_orderdate + to_seconds(o_orderkey % 86400) as base,
                        case o_orderstatus when 'P' then 'Processing'
                            when 'F' then case when o_orderpriority = '5-LOW' then 'Returned' else 'Complete' end
                            else case when o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED') then 'Cancelled' else 'Shipped' end
                        end as status
                    from orders)))""",
    ),
    "raw_items": (
        "raw_orders",
        f"""select {ITEM_ID} as id, o.order_id, o.user_id, l_partkey as product_id, {ITEM_ID} as inventory_item_id, o.status,
            o.created_at, o.shipped_at, o.delivered_at, o.returned_at,
            (l_extendedprice - 900.0::double) * (1.0::double - l_discount) / 450.0::double as sale_price
        from lineitem join raw_orders o on l_orderkey = o.order_id""",
    ),
    "raw_products": (
        "",
        """select p_partkey as id, (p_retailprice - 900.0::double) * 0.3::double + 5.0::double as cost,
            split_part(p_name, ' ', 2) as category,
            case when p_partkey % 700 <> 699 then p_name end as name,
            case when p_partkey % 500 <> 499 then p_brand end as brand,
            (p_retailprice - 900.0::double) * 0.9::double + 20.0::double as retail_price,
            case when p_partkey % 2 = 0 then 'Women' else 'Men' end as department,
            'SKU' || p_partkey::varchar as sku, p_partkey % 25 as distribution_center_id
        from part""",
    ),
    "raw_inventory": (
        "raw_products",
        f"""select {ITEM_ID} as id, l_partkey as product_id,
            case when l_orderkey % 113 <> 0 then l_shipdate + to_days((-10 * l_quantity)::int) end as created_at,
            case when l_linestatus = 'F' and l_tax < 0.06::double then l_shipdate end as sold_at,
            case when p.id % 701 = 0 then 0.0::double else p.cost end as cost,
            p.category as product_category, p.name as product_name, p.brand as product_brand,
            p.retail_price as product_retail_price, p.department as product_department, p.sku as product_sku,
            s_nationkey::bigint as product_distribution_center_id
        from lineitem join raw_products p on l_partkey = p.id join supplier on l_suppkey = s_suppkey""",
    ),
    "raw_events": (
        "",
        """select event_id as id, case when (user_id * 31 + day(ts)) % 7 >= 3 then user_id end as user_id,
            (hour(ts) * 3600 + minute(ts) * 60 + second(ts) + case when event_id % 13 = 0 then 7200 else 0 end)::int as sequence_number,
            user_id::varchar || '-' || (ts::date)::varchar as session_id, ts as created_at,
            (['Chrome', 'Firefox', 'Safari'])[event_id % 3 + 1] as browser,
            (['Email', 'Adwords', 'Facebook', 'YouTube', 'Organic'])[user_id % 5 + 1] as traffic_source,
            case event_type when 'view' then 'product' when 'click' then 'cart' when 'error' then 'cancel'
                when 'signup' then case when event_id % 2 = 0 then 'home' else 'department' end else event_type end as event_type
        from events""",
    ),
    "raw_users": (
        "",
        """select c_custkey as id, c_name as first_name, c_mktsegment as last_name,
            'user' || c_custkey::varchar || '@example.com' as email,
            (case when c_custkey % 97 <> 0 then 5 + (c_custkey * 37) % 130 end)::int as age,
            case when c_custkey % 89 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
            r_name as state, (c_custkey % 900)::varchar || ' Main Street' as street_address,
            (10000 + c_custkey % 9000)::varchar as postal_code,
            case when c_custkey % 100 <> 0 then 'City' || (c_custkey % 50)::varchar end as city,
            n_name as country, (c_custkey % 180 - 90)::double as latitude, (c_custkey % 360 - 180)::double as longitude,
            c_mktsegment as traffic_source,
            case when c_custkey % 83 <> 0 then timestamp '1994-06-01' + to_days((c_custkey * 53 % 1500)::int) end as created_at
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    "raw_centers": (
        "",
        """select n_nationkey::bigint as id, n_name as name, n_nationkey * 3.5::double - 40.0::double as latitude,
            n_nationkey * 7.0::double - 80.0::double as longitude from nation""",
    ),
    "clean_users": (
        "raw_users",
        f"""select id, first_name, last_name, email,
            (case when age is null then coalesce((select floor(median(age)) from raw_users), {P.default_age})
                else greatest(least(age, {P.max_age}), {P.min_age}) end)::bigint as age,
            coalesce(gender, 'Unknown') as gender, state, street_address, postal_code, coalesce(city, 'Unknown') as city,
            country, latitude, longitude, traffic_source, created_at
        from (select *, row_number() over (partition by id order by created_at nulls last, first_name) as rn from raw_users)
        where rn = 1""",
    ),
    "clean_orders": (
        "raw_orders",
        f"select *, coalesce(year(created_at) = {P.partial_year}, false) as is_partial_year from raw_orders",
    ),
    "clean_items": (
        "raw_items raw_products",
        f"""select i.*, p.cost, p.category, i.sale_price - p.cost as gross_profit,
            coalesce(i.sale_price < {P.price_floor}, false) as exclude_from_revenue
        from raw_items i left join raw_products p on i.product_id = p.id""",
    ),
    "clean_inventory": (
        "raw_inventory",
        f"""select *, sunk_cost_risk * {P.carrying_rate}::double as holding_cost_annual,
            sunk_cost_risk * {P.carrying_rate}::double / 365 as holding_cost_daily,
            sunk_cost_risk * {P.carrying_rate}::double / 365 * holding_days as holding_cost_estimate
        from (select *, cost * (1 - is_sold) as sunk_cost_risk
            from (select *, (sold_at is not null)::int as is_sold,
                case when created_at is not null then
                    greatest(floor({days(f"timestamp '{P.inventory_cutoff}'", 'created_at')})::bigint, 0) end as holding_days
                from raw_inventory))""",
    ),
    "fact": (
        "clean_items clean_orders",
        f"""select i.id as order_item_id, i.order_id, i.user_id, i.product_id,
            (year(o.created_at) * 10000 + month(o.created_at) * 100 + day(o.created_at))::int as date_key,
            i.sale_price, i.cost, i.gross_profit, o.status,
            coalesce(o.status = 'Returned', false)::int as is_returned,
            (not i.exclude_from_revenue)::int as is_gmv,
            (o.status in {RECOGNIZED})::int as is_recognized_revenue,
            i.sale_price as GMV_All_Status,
            case when o.status in {RECOGNIZED} then i.sale_price else 0.0 end as Recognized_Revenue,
            case when o.status in {RECOGNIZED} then i.gross_profit else 0.0 end as Recognized_Gross_Profit,
            case when o.status = 'Cancelled' then i.sale_price else 0.0 end as Revenue_Lost_Cancelled,
            case when o.status = 'Returned' then i.sale_price else 0.0 end as Return_Value,
            case when o.status = 'Processing' then i.sale_price else 0.0 end as Processing_Backlog_Value,
            o.created_at
        from clean_items i join clean_orders o on i.order_id = o.order_id
        where not i.exclude_from_revenue and not o.is_partial_year and o.created_at is not null""",
    ),
    "yearly_fact": ("fact", "select *, (date_key // 10000)::int as year from fact"),
    "fact_products": (
        "yearly_fact raw_products",
        f"""select f.*, p.category, p.brand, p.department, {SALE_BAND.replace('sale_price', 'f.sale_price')} as price_band
        from yearly_fact f left join raw_products p on f.product_id = p.id""",
    ),
    "fact_stock": (
        "clean_inventory",
        """select id as inventory_id, product_id, product_name, product_brand, product_category,
            product_department as department, product_distribution_center_id as center_id, cost, is_sold, holding_days,
            sunk_cost_risk, holding_cost_estimate from clean_inventory""",
    ),
    "funnel_monthly": (
        "raw_events",
        """select strftime(created_at, '%Y-%m') as year_month, event_type, traffic_source,
            count(id) as event_count, count(distinct user_id) as unique_users
        from raw_events where created_at is not null and event_type is not null and traffic_source is not null
        group by all""",
    ),
    "rfm": (
        "clean_items clean_orders",
        f"""select user_id, Recency, Frequency, Monetary, R_score, F_score, M_score,
            case when R_score + F_score + M_score >= 13 then 'Champions' when R_score + F_score + M_score >= 10 then 'Loyal'
                when R_score + F_score + M_score >= 7 then 'At Risk' when R_score + F_score + M_score >= 4 then 'About to Lose'
                else 'Lost' end as rfm_segment, return_rate_pct
        from (
            select *, (6 - (5 * row_number() over (order by Recency, user_id) + n - 1) // n)::int as R_score,
                ((5 * row_number() over (order by Frequency, user_id) + n - 1) // n)::int as F_score,
                ((5 * row_number() over (order by Monetary, user_id) + n - 1) // n)::int as M_score
            from (
                select *, count(*) over () as n from (
                    select i.user_id,
                        floor({days(f"timestamp '{P.analysis_cutoff}'", f"max(case when o.status in {RECOGNIZED} then o.created_at end)")})::bigint as Recency,
                        count(distinct case when o.status in {RECOGNIZED} and o.created_at is not null then i.order_id end) as Frequency,
                        {tot_if(f"o.status in {RECOGNIZED} and o.created_at is not null", 'i.gross_profit')} as Monetary,
                        coalesce({pct("count_if(o.status = 'Returned')", 'count(i.id)', None)}, 0.0) as return_rate_pct,
                        max(case when o.status in {RECOGNIZED} then o.created_at end) as last_order
                    from clean_items i join clean_orders o on i.order_id = o.order_id
                    where not i.exclude_from_revenue and not o.is_partial_year
                    group by i.user_id)
                where last_order is not null))""",
    ),
    "dim_users": (
        "clean_users rfm",
        """select u.id as user_id, first_name, last_name, age, gender, state, street_address, postal_code, city, country,
            latitude, longitude, traffic_source, Recency, coalesce(Frequency, 0)::bigint as Frequency,
            coalesce(Monetary, 0.0) as Monetary, coalesce(return_rate_pct, 0.0) as return_rate_pct,
            coalesce(rfm_segment, 'No Purchase / No Valid Purchase') as rfm_segment
        from clean_users u left join rfm r on u.id = r.user_id""",
    ),
    "flagged": (
        "raw_items raw_products",
        f"""select i.*, p.cost as product_cost, p.category, p.name as product_name, p.brand, p.retail_price, p.department,
            p.distribution_center_id as dc_id, i.sale_price - p.cost as gross_profit,
            (i.sale_price - p.cost) / nullif(i.sale_price, 0) as margin,
            strftime(i.created_at, '%Y-%m') as month, year(i.created_at)::int as year,
            i.status in {RECOGNIZED} as is_recognized, i.status in {VALID} as is_valid_purchase,
            i.status = 'Cancelled' as is_cancelled, i.status = 'Returned' as is_returned,
            {days('i.shipped_at', 'i.created_at')} as ship_days,
            {days('i.delivered_at', 'i.shipped_at')} as delivery_days,
            {days('i.delivered_at', 'i.created_at')} as fulfillment_days
        from raw_items i left join raw_products p on i.product_id = p.id""",
    ),
    "customers": (
        "flagged raw_users",
        f"""select *, floor({days('(select max(created_at) from flagged)', 'last_order')})::bigint as recency_days,
            valid_orders > 0 as buyer, recognized_orders > 0 as recognized_buyer, valid_orders >= 2 as repeat_buyer,
            case when age >= 0 and age <= 24 then '<=24' when age > 24 and age <= 34 then '25-34' when age > 34 and age <= 44 then '35-44'
                when age > 44 and age <= 54 then '45-54' when age > 54 and age <= 64 then '55-64'
                when age > 64 and age <= 200 then '65+' end as age_group
        from (
            select u.id as user_id, u.* exclude (id), coalesce(valid_orders, 0) as valid_orders, coalesce(valid_items, 0) as valid_items,
                first_order, last_order, coalesce(recognized_orders, 0) as recognized_orders, coalesce(revenue, 0.0) as revenue,
                coalesce(profit, 0.0) as profit, last_recognized_order
            from raw_users u left join (
                select user_id, count(distinct order_id) as valid_orders, count(id) as valid_items,
                    min(created_at) as first_order, max(created_at) as last_order,
                    count(distinct case when is_recognized then order_id end) as recognized_orders,
                    {tot_if('is_recognized', 'sale_price')} as revenue, {tot_if('is_recognized', 'gross_profit')} as profit,
                    max(case when is_recognized then created_at end) as last_recognized_order
                from flagged where is_valid_purchase group by user_id) s on u.id = s.user_id)""",
    ),
    "sessions": (
        "raw_events",
        """select session_id, first(traffic_source order by sequence_number, id) filter (where traffic_source is not null) as traffic_source,
            min(created_at) as start, max(created_at) as "end", count(id) as event_count,
            max((event_type = 'home')::int) as home, max((event_type = 'department')::int) as department,
            max((event_type = 'product')::int) as product, max((event_type = 'cart')::int) as cart,
            max((event_type = 'purchase')::int) as purchase, max((event_type = 'cancel')::int) as cancel,
            (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 / 60 as duration_min, count(id) = 1 as bounce
        from raw_events where session_id is not null group by session_id""",
    ),
    "cutoff": (
        "raw_items raw_inventory",
        """select greatest((select max(created_at) from raw_items), (select max(created_at) from raw_inventory),
            (select max(sold_at) from raw_inventory)) as cutoff""",
    ),
    "aged": (
        "raw_inventory cutoff",
        f"""select *, age_seconds / 86400.0::double as age_days, case when is_sold then 0.0 else cost end as unsold_cost,
            coalesce(not is_sold and age_seconds / 86400.0::double > 180, false) as aged_180,
            coalesce(not is_sold and age_seconds / 86400.0::double > 365, false) as aged_365
        from (select * exclude (product_distribution_center_id), product_distribution_center_id as dc_id, sold_at is not null as is_sold,
            case when sold_at is not null then {secs('sold_at', 'created_at')}
                else {secs('(select cutoff from cutoff)', 'created_at')} end as age_seconds
            from raw_inventory)""",
    ),
    "by_center": (
        "aged raw_centers",
        f"""select s.*, c.name as dc_name, {ratio('sold_units', 'inventory_units')} as sell_through,
            {ratio('aged_180_units', 'unsold_units')} as aged_180_rate
        from (select dc_id, count(id) as inventory_units, {flag('is_sold')} as sold_units, {flag('not is_sold')} as unsold_units,
            {tot('unsold_cost')} as unsold_cost, {mean('age_seconds')} / 86400.0::double as avg_age_days,
            {flag('aged_180')} as aged_180_units, {flag('aged_365')} as aged_365_units
            from aged where dc_id is not null group by dc_id) s left join raw_centers c on s.dc_id = c.id""",
    ),
    "category_totals": (
        "fact_products",
        f"""select category, {tot('GMV_All_Status')} as gmv_all_status, {tot('Recognized_Revenue')} as revenue,
            {tot('Recognized_Gross_Profit')} as gross_profit, {isum('is_recognized_revenue')} as num_items,
            count(order_item_id) as total_items, {isum('is_returned')} as returns, {tot('Return_Value')} as return_value,
            {tot('Revenue_Lost_Cancelled')} as cancelled_value, {tot('Processing_Backlog_Value')} as processing_backlog_value
        from fact_products where category is not null group by category""",
    ),
    "category_performance": (
        "category_totals",
        f"""select *, case when revenue > m_rev and gross_margin_pct > m_margin then 'Star'
                when revenue > m_rev and gross_margin_pct <= m_margin then 'Cash Cow'
                when revenue <= m_rev and gross_margin_pct > m_margin then 'Problem Child' else 'Dog' end as quadrant
        from (select *, median(revenue) over () as m_rev, median(gross_margin_pct) over () as m_margin
            from (select *, cancelled_value + return_value as cancelled_returned_leakage,
                gmv_all_status - revenue as status_leakage_value, {pct('gmv_all_status - revenue', 'gmv_all_status')} as status_leakage_pct,
                {pct('gross_profit', 'revenue')} as gross_margin_pct, {pct('returns', 'total_items')} as return_rate_pct
                from category_totals))""",
    ),
    "monthly": (
        "fact_products",
        f"""select date_trunc('month', created_at)::date as ds, category, {tot('Recognized_Revenue')} as revenue
        from fact_products where category is not null group by 1, 2""",
    ),
    "regular": (
        "monthly",
        """select g.category, g.ds, coalesce(m.revenue, 0.0) as y
        from (select category, unnest(generate_series(min(ds), max(ds), interval 1 month))::date as ds from monthly group by category) g
        left join monthly m on g.category = m.category and g.ds = m.ds""",
    ),
    "aged_series": (
        "regular",
        """select *, row_number() over (partition by category order by ds desc) as age, count(*) over (partition by category) as n,
            lag(y, 12) over (partition by category order by ds) as before from regular""",
    ),
    "gmv_monthly": (
        "fact raw_products",
        f"""select date_trunc('month', f.date)::date as ds, p.category, {tot('f.sale_price')} as y
        from (select distinct created_at::date as date, product_id, sale_price from fact) f join raw_products p on f.product_id = p.id
        where p.category is not null group by 1, 2""",
    ),
    "month_totals": (
        "flagged",
        f"""select date_trunc('month', created_at)::date as month, {tot('sale_price')} as revenue, {tot('gross_profit')} as profit,
            max(created_at) as latest
        from flagged where is_recognized and created_at is not null group by 1""",
    ),
    "full_months": (
        "month_totals",
        """select g.month, coalesce(t.revenue, 0.0) as revenue, coalesce(t.profit, 0.0) as profit
        from (select unnest(generate_series(min(month), case when day(max(latest)) < day(last_day(max(latest)))
                then date_trunc('month', max(latest)) - interval 1 month else date_trunc('month', max(latest)) end,
                interval 1 month))::date as month from month_totals) g
        left join month_totals t on g.month = t.month""",
    ),
    "outlook": (
        "full_months",
        f"""select *, last + to_months(h::int) as ahead, base * (1 + used_yoy_growth) as forecast_revenue,
            base * (1 + used_yoy_growth) * last12_margin as forecast_profit
        from (select s.*, h, coalesce(f.revenue, s.mean12) as base, greatest(least(raw_yoy_growth, 0.5), -0.2) as used_yoy_growth
            from (select max(month) as last, {tot_if('age <= 12', 'revenue')} as last12_revenue,
                    case when count_if(age > 12 and age <= 24) = 12 then {tot_if('age > 12 and age <= 24', 'revenue')} end as prev12_revenue,
                    case when count_if(age > 12 and age <= 24) = 12 and {tot_if('age > 12 and age <= 24', 'revenue')} > 0
                        then {ratio(tot_if('age <= 12', 'revenue'), tot_if('age > 12 and age <= 24', 'revenue'))} - 1 else 0.0 end as raw_yoy_growth,
                    {mean_if('age <= 12', 'revenue')} as mean12,
                    {ratio0(tot_if('age <= 12', 'profit'), tot_if('age <= 12', 'revenue'))} as last12_margin
                from (select *, row_number() over (order by month desc) as age from full_months)) s
            cross join generate_series(1, 12) g(h)
            left join full_months f on f.month = (s.last + to_months((h - 12)::int))::date)""",
    ),
    "enriched": (
        "dim_users fact_products",
        f"""select u.user_id, coalesce(Recency, 9999)::bigint as Recency, Frequency, Monetary, return_rate_pct, rfm_segment,
            coalesce({ratio('Monetary', 'Frequency')}, 0.0) as aov, Monetary as profit_per_customer,
            coalesce(category_diversity, 0)::bigint as category_diversity
        from dim_users u left join (select user_id, count(distinct category) as category_diversity from fact_products
            where is_recognized_revenue = 1 group by user_id) d on u.user_id = d.user_id""",
    ),
    "rule_clusters": (
        "enriched",
        """select *, (dense_rank() over (order by cluster_label) - 1)::int as cluster
        from (select e.*, case when Frequency = 0 then 'No Valid Purchase'
                when Frequency >= 3 and Monetary >= q90 then 'High-Value Loyal'
                when Frequency >= 2 and Recency <= 180 then 'Selective Buyers'
                when Monetary >= q75 and Recency > 365 then 'At-Risk High Value'
                when Recency > 730 then 'Low-Value Browsers'
                when Frequency = 1 then 'Occasional Spenders' else 'Recent But Inactive' end as cluster_label
            from enriched e cross join (select quantile_cont(Monetary, 0.9) as q90, quantile_cont(Monetary, 0.75) as q75 from enriched) q)""",
    ),
    "funnel_summary": (
        "raw_events",
        """select event_type, count(id) as event_count, count(distinct session_id) as sessions,
            count(distinct user_id) as global_unique_users from raw_events group by event_type""",
    ),
    "stages": (
        "",
        "select * from (values (1, 'product'), (2, 'cart'), (3, 'purchase'), (4, 'cancel')) s(pos, stage)",
    ),
    "steps": (
        "",
        """select * from (values (1, 'home'), (2, 'department'), (3, 'product'), (4, 'cart'), (5, 'purchase'), (6, 'cancel')) s(pos, stage)""",
    ),
    "baskets": (
        "fact_products",
        f"""select order_id, category, first(user_id order by order_item_id) as uid from fact_products
        where is_recognized_revenue = 1 and category is not null group by order_id, category""",
    ),
    "basket_orders": (
        "fact_products",
        f"""select order_id, first(user_id order by order_item_id) as user_id, {tot('Recognized_Revenue')} as revenue from fact_products
        where is_recognized_revenue = 1 and category is not null group by order_id""",
    ),
}


def _with(needs: str, select: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in RELATIONS[name][0].split():
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    if not ordered:
        return select
    return "with " + ",\n".join(f"{n} as ({RELATIONS[n][1]})" for n in ordered) + "\n" + select


def _metrics(source: str, rows: list[tuple[str, str, str]]) -> str:
    """One-row query to (metric, value, unit)."""
    return "\nunion all ".join(
        f"select '{name.replace(chr(39), chr(39) * 2)}' as metric, ({value})::double as value, '{unit}' as unit from ({source})"
        for name, value, unit in rows
    )


def _checks(section: str, source: str, names: list[str]) -> str:
    return "\nunion all ".join(
        f"select '{section}' as section, '{n}' as \"check\", ({n})::double as value from ({source})" for n in names
    )


DATE_CHECKS = _checks(
    "date_validation",
    """select count_if(shipped_at <= created_at) as shipped_before_created, count_if(delivered_at <= shipped_at) as delivered_before_shipped,
        count_if(returned_at <= delivered_at) as returned_before_delivered, count_if(num_of_item < 0) as negative_num_of_item from raw_orders""",
    ["shipped_before_created", "delivered_before_shipped", "returned_before_delivered", "negative_num_of_item"],
)
STATUS_CHECKS = _checks(
    "order_status_validation",
    """select count_if(lower(status) = 'cancelled' and shipped_at is not null) as cancelled_with_shipped_at,
        count_if(lower(status) = 'cancelled' and delivered_at is not null) as cancelled_with_delivered_at,
        count_if(lower(status) = 'cancelled' and returned_at is not null) as cancelled_with_returned_at,
        count_if(lower(status) = 'returned' and delivered_at is null) as returned_without_delivered_at,
        count_if(lower(status) = 'returned' and returned_at is null) as returned_without_returned_at,
        count_if(num_of_item < 0) as negative_num_of_item from raw_orders""",
    [
        "cancelled_with_shipped_at", "cancelled_with_delivered_at", "cancelled_with_returned_at",
        "returned_without_delivered_at", "returned_without_returned_at", "negative_num_of_item",
    ],
)
SOURCE_CHECKS = """select traffic_source, bool_or(e) as in_events, bool_or(not e) as in_users, bool_or(e) and not bool_or(not e) as is_mismatch
    from (select traffic_source, true as e from raw_events union all select traffic_source, false from raw_users)
    where traffic_source is not null group by traffic_source"""
SESSION_CHECKS = _checks(
    "events_validation",
    """select count(*) as events_checked, count(distinct session_id) as sessions_checked, count_if(created_at < prev) as events_with_time_regressions,
        count(distinct case when created_at < prev then session_id end) as sessions_with_time_regressions
    from (select *, lag(created_at) over (partition by session_id order by sequence_number, created_at, id) as prev
        from raw_events where session_id is not null)""",
    ["events_checked", "sessions_checked", "events_with_time_regressions", "sessions_with_time_regressions"],
)
USER_CHECKS = _checks(
    "users_validation",
    f"""select coalesce(sum(case when n > 1 then n end), 0) as duplicate_user_ids, sum(null_age) as null_age, sum(null_gender) as null_gender,
        sum(null_city) as null_city, sum(invalid_age) as invalid_age
    from (select id, count(*) as n, count_if(age is null) as null_age, count_if(gender is null) as null_gender,
        count_if(city is null) as null_city, count_if(age < {P.min_age} or age > {P.max_age}) as invalid_age from raw_users group by id)""",
    ["duplicate_user_ids", "null_age", "null_gender", "null_city", "invalid_age"],
)
PRODUCT_CHECKS = _checks(
    "products_validation",
    """select count_if(category is null) as null_category, count_if(cost is null) as null_cost, count_if(retail_price is null) as null_retail_price,
        count_if(cost > retail_price) as cost_greater_than_retail_price from raw_products""",
    ["null_category", "null_cost", "null_retail_price", "cost_greater_than_retail_price"],
)
CENTER_CHECKS = _checks(
    "dcs_validation",
    """select count_if(name is null) as null_name, count_if(latitude is null) as null_latitude,
        count_if(longitude is null) as null_longitude from raw_centers""",
    ["null_name", "null_latitude", "null_longitude"],
)
ITEM_CHECKS = _checks(
    "order_item_quality",
    """select count_if(sale_price < 1) as sale_price_lt_1, count_if(sale_price = 0) as sale_price_eq_0,
        count_if(cost is null) as missing_product_cost from clean_items""",
    ["sale_price_lt_1", "sale_price_eq_0", "missing_product_cost"],
)
KEY_RULES = [
    ("orders.user_id_to_users.id", "raw_orders", "user_id", "raw_users", "id"),
    ("order_items.order_id_to_orders.order_id", "raw_items", "order_id", "raw_orders", "order_id"),
    ("order_items.user_id_to_users.id", "raw_items", "user_id", "raw_users", "id"),
    ("order_items.product_id_to_products.id", "raw_items", "product_id", "raw_products", "id"),
    ("products.distribution_center_id_to_dcs.id", "raw_products", "distribution_center_id", "raw_centers", "id"),
    ("inventory.product_id_to_products.id", "raw_inventory", "product_id", "raw_products", "id"),
    (
        "inventory.product_distribution_center_id_to_dcs.id", "raw_inventory", "product_distribution_center_id",
        "raw_centers", "id",
    ),
    ("events.user_id_to_users.id_non_null_only", "raw_events", "user_id", "raw_users", "id"),
]
KEY_CHECKS = "\nunion all ".join(
    f"""select rule, checked_rows, orphan_rows, {rnd(ratio0('orphan_rows', 'checked_rows') + ' * 100', 4)} as orphan_pct
    from (select '{rule}' as rule, count({key}) as checked_rows,
        count_if({key} is not null and {key} not in (select {pk} from {parent} where {pk} is not null)) as orphan_rows from {child})"""
    for rule, child, key, parent, pk in KEY_RULES
)
SCOPE = _checks(
    "scope_reconciliation",
    f"""select (select count(*) from raw_items) as raw_order_item_rows,
        (select count_if(sale_price < 1) from raw_items) as sub_1_price_rows_excluded,
        (select count(*) from clean_items where not exclude_from_revenue) as rows_after_price_filter,
        (select count(*) from raw_items i join clean_orders o on i.order_id = o.order_id where not o.is_partial_year and o.created_at is not null)
            as eligible_rows_after_partial_year_and_missing_date_exclusion,
        (select count(*) from fact) as fact_transaction_rows,
        {rnd(f"(select {tot('sale_price')} from raw_items)", 2)} as raw_gmv,
        {rnd(f"(select {tot('GMV_All_Status')} from fact)", 2)} as processed_fact_gmv,
        {rnd(f"(select {tot('sale_price')} from raw_items) - (select {tot('GMV_All_Status')} from fact)", 2)} as gmv_removed_from_model_scope""",
    [
        "raw_order_item_rows", "sub_1_price_rows_excluded", "rows_after_price_filter",
        "eligible_rows_after_partial_year_and_missing_date_exclusion", "fact_transaction_rows", "raw_gmv",
        "processed_fact_gmv", "gmv_removed_from_model_scope",
    ],
)

# The tables as the profile sees them: relation, primary key, columns.
PROFILED = {
    "orders": ("raw_orders", "order_id", "order_id user_id status gender created_at returned_at shipped_at delivered_at num_of_item"),
    "order_items": (
        "raw_items", "id",
        "id order_id user_id product_id inventory_item_id status created_at shipped_at delivered_at returned_at sale_price",
    ),
    "inventory": (
        "raw_inventory", "id",
        "id product_id created_at sold_at cost product_category product_name product_brand product_retail_price "
        "product_department product_sku product_distribution_center_id",
    ),
    "events": ("raw_events", "id", "id user_id sequence_number session_id created_at browser traffic_source event_type"),
    "users": (
        "raw_users", "id",
        "id first_name last_name email age gender state street_address postal_code city country latitude longitude traffic_source created_at",
    ),
    "products": ("raw_products", "id", "id cost category name brand retail_price department sku distribution_center_id"),
    "dcs": ("raw_centers", "id", "id name latitude longitude"),
}
RAW = "raw_orders raw_items raw_inventory raw_events raw_users raw_products raw_centers"


def _profile_tables() -> str:
    parts = []
    for name, (relation, key, columns) in PROFILED.items():
        cells = " + ".join(f"count_if({c} is null)" for c in columns.split())
        parts.append(
            f"""select '{name}' as "table", count(*) as rows, {len(columns.split())}::int as cols,
            count(*) - count(distinct {key}) - (count_if({key} is null) > 0)::int as duplicate_pk, ({cells})::bigint as null_cells from {relation}"""
        )
    return "\nunion all ".join(parts)


def _profile_columns() -> str:
    parts = []
    for name, (relation, _, columns) in PROFILED.items():
        for c in columns.split():
            share = rnd(ratio0(f"count_if({c} is null)", "count(*)") + " * 100", 4)
            parts.append(
                f"""select '{name}' as "table", '{c}' as "column", count_if({c} is null) as null_count, {share} as null_pct from {relation}"""
            )
    return "\nunion all ".join(parts)


SAMPLES = {
    "orders_shipped_before_created": ("raw_orders", "order_id", "shipped_at <= created_at"),
    "orders_delivered_before_shipped": ("raw_orders", "order_id", "delivered_at <= shipped_at"),
    "orders_returned_before_delivered": ("raw_orders", "order_id", "returned_at <= delivered_at"),
    "returned_orders_missing_timestamps": (
        "raw_orders", "order_id", "lower(status) = 'returned' and (delivered_at is null or returned_at is null)",
    ),
    "order_items_sale_price_lt_1": ("clean_items", "id", "sale_price < 1"),
    "events_null_user_id_sample": ("raw_events", "id", "user_id is null"),
    "inventory_missing_created_at_sample": ("raw_inventory", "id", "created_at is null"),
    "products_missing_name_or_brand_sample": ("raw_products", "id", "name is null or brand is null"),
}
ISSUE_SAMPLES = "\nunion all ".join(
    f"select '{name}' as sample, key from (select {key} as key from {relation} where {test} order by 1 limit {P.sample_rows})"
    for name, (relation, key, test) in SAMPLES.items()
)


def _stage_rows(summary: str, users: str) -> str:
    def conversion(x: str) -> str:
        return f"case when pos = 1 then 100.0 else {ratio(x, f'p_{x}')} * 100 end"

    return f"""select stage, coalesce(event_count, 0) as event_count, sessions, {users},
        case when pos = 1 then 100.0 else {ratio('coalesce(event_count, 0)', 'p_event_count')} * 100 end as event_conversion_from_prev_pct,
        {conversion('sessions')} as session_conversion_from_prev_pct, {conversion(users)} as user_conversion_from_prev_pct
    from (select s.pos, s.stage, e.event_count, e.sessions, e.{users}, lag(e.event_count) over w as p_event_count,
            lag(e.sessions) over w as p_sessions, lag(e.{users}) over w as p_{users}
        from stages s left join {summary} e on s.stage = e.event_type window w as (order by s.pos))"""


def _journey(grouped: str, sources: str, users: str) -> str:
    def stage_sessions(stage: str) -> str:
        return f"max(case when event_type = '{stage}' then sessions end) over (partition by traffic_source)"

    return f"""select *, {pct('event_count', 'source_event_count')} as event_share_within_source_pct,
        {pct('sessions', 'source_sessions')} as session_reach_within_source_pct,
        {pct(users, f'source_{users}')} as user_reach_within_source_pct,
        {pct(stage_sessions('cart'), stage_sessions('product'))} as product_to_cart_session_cvr_pct,
        {pct(stage_sessions('purchase'), stage_sessions('product'))} as product_to_purchase_session_cvr_pct,
        {pct(stage_sessions('purchase'), stage_sessions('cart'))} as cart_to_purchase_session_cvr_pct
    from (select t.traffic_source, s.stage as event_type, case when g.event_type is null then 0 else g.event_count end as event_count,
            case when g.event_type is null then 0 else g.sessions end as sessions, case when g.event_type is null then 0 else g.{users} end as {users},
            t.source_event_count, t.source_sessions, t.source_{users}, s.pos::int as stage_order
        from ({sources}) t cross join steps s
        left join ({grouped}) g on g.traffic_source = t.traffic_source and g.event_type = s.stage)"""


MONTHLY_STAGES = """(select event_type, sum(event_count)::bigint as event_count, null::bigint as sessions,
    sum(unique_users)::bigint as user_months from funnel_monthly group by event_type)"""
MONTHLY_GROUPS = """select traffic_source, event_type, sum(event_count)::bigint as event_count, null::bigint as sessions,
    sum(unique_users)::bigint as user_months from funnel_monthly group by 1, 2"""

GROUP_TOTALS = f"""{tot('GMV_All_Status')} as gmv_all_status, {tot('Recognized_Revenue')} as revenue,
    {tot('Recognized_Gross_Profit')} as gross_profit, {isum('is_recognized_revenue')} as recognized_items, count(order_item_id) as total_items,
    {isum('is_returned')} as returned_items, {tot('Return_Value')} as return_value, {tot('Revenue_Lost_Cancelled')} as cancelled_value,
    {tot('Processing_Backlog_Value')} as processing_backlog_value"""

COHORT_YEARS = """select user_id, year, min(year) over (partition by user_id) as cohort_year
    from (select distinct user_id, year from yearly_fact where is_recognized_revenue = 1 and user_id is not null)"""


def _purchase_cohorts(signup: str) -> str:
    return f"""select *, {pct('users', 'base_users', 2)} as retention_pct
    from (select *, max(case when purchase_year = signup_year then users end) over (partition by signup_year) as base_users
        from (select s.signup_year::int as signup_year, f.purchase_year::int as purchase_year, count(distinct f.user_id) as users
            from (select distinct user_id, year(created_at) as purchase_year from fact) f join ({signup}) s on f.user_id = s.user_id
            where s.signup_year is not null group by all))"""


def _stock_sums(extra: str = "") -> str:
    return f"""count(id) as inventory_units, {flag('is_sold')} as sold_units, {flag('not is_sold')} as unsold_units, {tot('unsold_cost')} as unsold_cost,
        {mean('age_seconds')} / 86400.0::double as avg_age_days, {flag('aged_180')} as aged_180_units{extra}"""


CAC = f"{P.acquisition_cost}::double"
RETURN_COST = f"{P.return_handling_cost}::double"

ROOT_RULES = [
    ("return_rate_pct >= 12 and price_band in ('$100-200', '$200+')", "High-price fit/expectation mismatch", "Add premium PDP proof, fit notes, review snippets"),
    ("return_rate_pct >= 12", "Size/fit/content confidence risk", "Improve size guide, product images, material details"),
    ("cancel_rate_pct >= 17", "Checkout/payment/inventory cancellation friction", "Audit stock sync, payment failure, checkout messaging"),
    ("processing_rate_pct >= 22", "Backlog or status-update SLA risk", "Create processing aging SLA and exception queue"),
    ("fulfillment_bucket in ('5-7 days', '8+ days') and return_rate_pct >= 10", "Fulfillment-delay experience risk", "Surface ETA earlier and monitor late-delivery cohorts"),
]


def _rules(column: int, default: str) -> str:
    return "case " + " ".join(f"when {r[0]} then '{r[column]}'" for r in ROOT_RULES) + f" else '{default}' end"


ROOT_DAYS = days("o.delivered_at", "o.created_at")

PROCESSED_COUNTS = {
    "fact_transactions": "(select count(*) from fact)",
    "agg_funnel_monthly": "(select count(*) from funnel_monthly)",
    "fact_inventory": "(select count(*) from fact_stock)",
    "dim_users": "(select count(*) from dim_users)",
    "dim_products": "(select count(*) from raw_products)",
    "dim_dcs": "(select count(*) from raw_centers)",
    "dim_date": "(select date_diff('day', min(created_at)::date, max(created_at)::date) + 1 from raw_orders)",
}
# The series that are forecast: the three largest categories with at least two years.
FORECAST = f"""(select category, count(*) as n, min(ds) as first_ds, max(ds) as last_ds from regular
    where category in (select category from monthly group by 1 order by {tot('revenue')} desc, category limit 3)
    group by 1 having count(*) >= 24)"""
MODEL = "trend_season_ridge"


def _values(rows: dict[str, object]) -> str:
    return "\nunion all ".join(f"select '{name}' as property, ({value})::bigint as value" for name, value in rows.items())


_SQL: dict[str, tuple[str, str]] = {
    "parse_times": (
        "raw_orders",
        """select order_id, case when order_id % 5 = 0 then null when order_id % 5 = 2 then created_at - interval 2 hour
            else created_at end as created_at from raw_orders""",
    ),
    "clean_users": ("clean_users", "select * from clean_users"),
    "clean_orders": ("clean_orders", "select * from clean_orders"),
    "clean_order_items": ("clean_items", "select * from clean_items"),
    "clean_inventory": ("clean_inventory", "select * from clean_inventory"),
    "fact_transactions": ("fact", "select * from fact"),
    "fact_inventory": ("fact_stock", "select * from fact_stock"),
    "dim_users": ("dim_users", "select * from dim_users"),
    "dim_products": ("raw_products", "select id as product_id, category, brand, retail_price, cost, department from raw_products"),
    "dim_dcs": ("raw_centers", "select id as dc_id, name, latitude, longitude from raw_centers"),
    "dim_date": (
        "raw_orders",
        """select (year(date) * 10000 + month(date) * 100 + day(date))::int as date_key, date, year(date)::int as year, month(date)::int as month,
            quarter(date)::int as quarter, (isodow(date) - 1)::int as day_of_week, week(date)::int as week_of_year, strftime(date, '%Y-%m') as year_month
        from (select unnest(generate_series(min(created_at)::date, max(created_at)::date, interval 1 day))::date as date from raw_orders)""",
    ),
    "ensure_revenue_columns": (
        "yearly_fact",
        """select order_item_id, date_key, sale_price, gross_profit, status, is_recognized_revenue, (sale_price >= 1)::int as is_gmv, GMV_All_Status,
            Recognized_Revenue, Recognized_Gross_Profit, Revenue_Lost_Cancelled, Return_Value, Processing_Backlog_Value, year from yearly_fact""",
    ),
    "price_bands": ("fact", f"select {SALE_BAND} as price_band, count(*) as items from fact group by 1"),
    "safe_shares": (
        "raw_orders",
        f"""select status, {pct('count(returned_at)', 'count(shipped_at)')} as share_pct, {ratio0('count(returned_at)', 'count(shipped_at)')} as share
        from raw_orders group by status""",
    ),
    "enrich_transactions": (
        "flagged raw_users",
        """select f.*, u.age, u.gender, u.country, u.city, u.traffic_source as user_traffic_source
        from flagged f left join raw_users u on f.user_id = u.id""",
    ),
    "agg_funnel_monthly": ("funnel_monthly", "select * from funnel_monthly"),
    "profile_tables": (RAW, _profile_tables()),
    "profile_columns": (RAW, _profile_columns()),
    "order_date_checks": ("raw_orders", DATE_CHECKS),
    "order_status_checks": ("raw_orders", STATUS_CHECKS),
    "event_source_checks": ("raw_events raw_users", SOURCE_CHECKS),
    "session_time_checks": ("raw_events", SESSION_CHECKS),
    "user_checks": ("raw_users", USER_CHECKS),
    "product_checks": ("raw_products", PRODUCT_CHECKS),
    "center_checks": ("raw_centers", CENTER_CHECKS),
    "item_checks": ("clean_items", ITEM_CHECKS),
    "foreign_key_checks": (RAW, KEY_CHECKS),
    "issue_samples": (RAW + " clean_items", ISSUE_SAMPLES),
    "bot_candidates": (
        "raw_events",
        f"""select user_id, created_at::date as day, count(*) as event_count from raw_events where user_id is not null
        group by 1, 2 having count(*) > {P.bot_threshold}""",
    ),
    "scope_reconciliation": ("raw_items clean_items clean_orders fact", SCOPE),
    "raw_quality_checks": (
        RAW,
        f"""select (select count_if(user_id is null or user_id not in (select id from raw_users)) from raw_items) as orphan_item_user_ids,
            (select count_if(product_id is null or product_id not in (select id from raw_products)) from raw_items) as orphan_item_product_ids,
            (select count_if(order_id is null or order_id not in (select order_id from raw_orders)) from raw_items) as orphan_item_order_ids,
            (select count_if(product_id is null or product_id not in (select id from raw_products)) from raw_inventory) as inventory_orphan_product_ids,
            (select {ratio0('count_if(user_id is null)', 'count(*)')} from raw_events) as events_user_id_null_pct,
            (select min(created_at) from raw_events) as event_time_min, (select max(created_at) from raw_events) as event_time_max,
            (select min(created_at) from raw_items) as order_time_min, (select max(created_at) from raw_items) as order_time_max,
            (select count_if(sale_price < 1) from raw_items) as sale_price_lt_1_items,
            (select count_if(cost > retail_price) from raw_products) as product_cost_gt_retail,
            (select count_if(o.num_of_item <> c.n) from raw_orders o join (select order_id, count(*) as n from raw_items group by 1) c
                on o.order_id = c.order_id) as order_item_count_mismatch""",
    ),
    "quality_report": (
        RAW + " clean_items clean_orders fact funnel_monthly fact_stock dim_users rfm",
        "\nunion all ".join(
            [
                DATE_CHECKS, STATUS_CHECKS, USER_CHECKS, PRODUCT_CHECKS, CENTER_CHECKS, SESSION_CHECKS, ITEM_CHECKS, SCOPE,
                f"""select 'events_validation' as section, 'traffic_source_mismatch_count' as "check", count_if(is_mismatch)::double as value from ({SOURCE_CHECKS})""",
            ]
            + [
                f"""select 'foreign_key_validation' as section, rule || '.{c}' as "check", ({c})::double as value from ({KEY_CHECKS})"""
                for c in ("checked_rows", "orphan_rows", "orphan_pct")
            ]
            + [
                f"""select 'table_profile' as section, "table" || '.{c}' as "check", ({c})::double as value from ({_profile_tables()})"""
                for c in ("rows", "cols", "duplicate_pk", "null_cells")
            ]
            + [
                f"select 'processed_row_counts' as section, '{name}' as \"check\", ({n})::double as value"
                for name, n in PROCESSED_COUNTS.items()
            ]
            + [
                f"""select 'result_row_counts' as section, 'bot_candidate_rows' as "check", count(*)::double as value from (
                select user_id, created_at::date from raw_events where user_id is not null group by 1, 2 having count(*) > {P.bot_threshold})""",
                """select 'result_row_counts' as section, 'rfm_users' as "check", count(*)::double as value from rfm""",
            ]
        ),
    ),
    "typed_orders": (
        "raw_orders",
        """select order_id, case when order_id % 11 > 1 then user_id end as user_id,
            case when order_id % 11 not in (2, 3) then status end as status, null::varchar as gender,
            case when order_id % 11 <> 4 then created_at end as created_at, returned_at, shipped_at, delivered_at,
            case when order_id % 11 <> 5 then num_of_item end as num_of_item from raw_orders""",
    ),
    "typed_events": (
        "raw_events",
        """select id, user_id, event_type, case id % 7 when 0 then null when 1 then 'null' else session_id end as session_id,
            case id % 7 when 2 then 'NA' when 3 then null else traffic_source end as traffic_source, created_at from raw_events""",
    ),
    "filled_users": (
        "raw_users rfm",
        f"""select u.id as user_id, coalesce(Frequency, 0) as Frequency, coalesce(Monetary, 0.0) as Monetary,
            coalesce(return_rate_pct, 0.0) as return_rate_pct, coalesce(rfm_segment, '{NO_PURCHASE_SEGMENT}') as rfm_segment
        from raw_users u left join rfm r on r.user_id = u.id""",
    ),
    "rfm": ("rfm", "select * from rfm"),
    "rfm_segmentation": (
        "dim_users",
        f"""select segment, count, {pct('count', 'sum(count) over ()', 1)} as percentage
        from (select rfm_segment as segment, count(*) as count from dim_users group by 1)""",
    ),
    "cohort_retention": (
        "yearly_fact",
        f"""select c.cohort_year, y.year, coalesce(n.users, 0) as users,
            {pct('coalesce(n.users, 0)', 'c.size', 2)} as retention_pct
        from (select cohort_year, count(distinct user_id) as size from ({COHORT_YEARS}) group by 1) c
        cross join (select distinct year from ({COHORT_YEARS})) y
        left join (select cohort_year, year, count(distinct user_id) as users from ({COHORT_YEARS}) group by 1, 2) n
            on n.cohort_year = c.cohort_year and n.year = y.year""",
    ),
    "cohort_matrix": (
        "yearly_fact",
        "select cohort_year, "
        + ", ".join(f"coalesce(max(retention_pct) filter (where year = {y}), 0.0) as \"{y}\"" for y in range(1992, 1999))
        + f""" from (select c.cohort_year, n.year, {pct('n.users', 'c.size', 2)} as retention_pct
        from (select cohort_year, count(distinct user_id) as size from ({COHORT_YEARS}) group by 1) c
        join (select cohort_year, year, count(distinct user_id) as users from ({COHORT_YEARS}) group by 1, 2) n on n.cohort_year = c.cohort_year)
        group by 1""",
    ),
    "ltv_cac": (
        "dim_users",
        _metrics(
            f"""select count(*) as users, count_if(Frequency > 0) as buyers, count_if(Frequency = 1) as one_time,
                coalesce({mean_if('Frequency = 1', 'Monetary')}, 0.0) as ltv_one_time, coalesce({mean_if('Frequency > 0', 'Monetary')}, 0.0) as ltv_all
            from dim_users""",
            [
                ("No Valid Purchase Users %", f"(1 - {ratio('buyers', 'users')}) * 100", "%"),
                ("One-time Buyers % (valid customers)", f"{ratio0('one_time', 'buyers')} * 100", "%"),
                ("Gross Profit LTV (1-time buyers)", "ltv_one_time", "$"),
                ("Gross Profit LTV (all valid customers)", "ltv_all", "$"),
                ("CAC Assumption", CAC, "$"),
                ("LTV:CAC Ratio", ratio("ltv_one_time", CAC), ":1"),
                ("Healthy Benchmark", "3.0", ":1"),
            ],
        ),
    ),
    "status_leakage": (
        "yearly_fact",
        f"""select *, {pct('value', tot_over('value', 'partition by year'), 2)} as share_of_gmv_pct, status in {RECOGNIZED} as is_recognized_revenue
        from (select year, status, count(order_item_id) as items, count(distinct order_id) as orders, {tot('sale_price')} as value,
            {tot('gross_profit')} as gross_profit from yearly_fact group by 1, 2)""",
    ),
    "annual_revenue": (
        "yearly_fact",
        f"""select * from (
            select *, {ratio('revenue', 'num_orders')} as aov, {pct('gross_profit', 'revenue')} as gross_margin_pct,
                {pct('returns', 'total_items')} as return_rate_pct, gmv_all_status - revenue as status_leakage_value,
                {pct('gmv_all_status - revenue', 'gmv_all_status')} as status_leakage_pct,
                ({ratio('revenue', 'lag(revenue) over (order by year)')} - 1) * 100 as yoy_growth_pct
            from (select year, {tot('GMV_All_Status')} as gmv_all_status, {tot('Recognized_Revenue')} as revenue,
                {tot('Recognized_Gross_Profit')} as gross_profit, {isum('is_recognized_revenue')} as num_items, count(order_item_id) as total_items,
                {isum('is_returned')} as returns, {tot('Return_Value')} as return_value, {tot('Revenue_Lost_Cancelled')} as cancelled_value,
                {tot('Processing_Backlog_Value')} as processing_backlog_value,
                count(distinct case when is_recognized_revenue = 1 then order_id end) as num_orders
                from yearly_fact group by year))
        where year <= {P.last_full_year}""",
    ),
    "category_performance": ("category_performance", "select * exclude (m_rev, m_margin) from category_performance"),
    "return_costs": (
        "fact",
        _metrics(
            f"select count(*) as items, {isum('is_returned')} as returned, {tot('Return_Value')} as total from fact",
            [
                ("Total GMV Items", "items", "items"),
                ("Total Returned Items", "returned", "items"),
                ("Return Rate % (all-status items)", f"{ratio('returned', 'items')} * 100", "%"),
                ("Return Value", "total", "$"),
                ("Cost per Return", RETURN_COST, "$"),
                ("Total Return Cost", f"returned * {RETURN_COST}", "$"),
                ("Annual Return Cost Estimate", f"returned * {RETURN_COST} / {P.return_years}", "$"),
            ],
        ),
    ),
    "funnel": ("funnel_summary stages", _stage_rows("funnel_summary", "global_unique_users")),
    "funnel_from_monthly": ("funnel_monthly stages", _stage_rows(MONTHLY_STAGES, "user_months")),
    "journey_by_source": (
        "raw_events steps",
        _journey(
            """select traffic_source, event_type, count(id) as event_count, count(distinct session_id) as sessions,
                count(distinct user_id) as unique_users from raw_events where traffic_source is not null group by 1, 2""",
            """select traffic_source, count(id) as source_event_count, count(distinct session_id) as source_sessions,
                count(distinct user_id) as source_unique_users from raw_events where traffic_source is not null group by 1""",
            "unique_users",
        ),
    ),
    "journey_from_monthly": (
        "funnel_monthly steps",
        _journey(
            MONTHLY_GROUPS,
            f"""select traffic_source, sum(event_count)::bigint as source_event_count, null::bigint as source_sessions,
                sum(user_months)::bigint as source_user_months from ({MONTHLY_GROUPS}) group by 1""",
            "user_months",
        ),
    ),
    "traffic_source_performance": (
        "raw_events",
        f"""select *, {rnd(ratio('purchase_events', 'global_unique_users'), 2)} as purchase_events_per_global_user
        from (select traffic_source, count(id) as purchase_events, count(distinct user_id) as global_unique_users,
            count(distinct session_id) as sessions from raw_events where event_type = 'purchase' and traffic_source is not null group by 1)""",
    ),
    "traffic_source_from_monthly": (
        "funnel_monthly",
        f"""select *, {rnd(ratio('purchase_events', 'user_months'), 2)} as purchase_events_per_user_month
        from (select traffic_source, sum(event_count)::bigint as purchase_events, sum(unique_users)::bigint as user_months,
            null::bigint as sessions from funnel_monthly where event_type = 'purchase' group by 1)""",
    ),
    "basket_affinity": (
        "baskets basket_orders",
        f"""select *, case when lift >= 1.5 and orders_with_pair >= 50 then 'Bundle/cross-sell priority'
                when confidence_a_to_b_pct >= 15 or confidence_b_to_a_pct >= 15 then 'Recommendation module candidate' else 'Monitor' end as bundle_action
        from (select p.*, {pct('orders_with_pair', 't.n', 3)} as support_pct, a.n as category_a_orders, b.n as category_b_orders,
                {pct('orders_with_pair', 'a.n')} as confidence_a_to_b_pct, {pct('orders_with_pair', 'b.n')} as confidence_b_to_a_pct,
                {rnd(ratio(ratio('orders_with_pair', 't.n'), f"{ratio('a.n', 't.n')} * {ratio('b.n', 't.n')}"), 2)} as lift
            from (select x.category as category_a, y.category as category_b, count(distinct x.order_id) as orders_with_pair,
                    count(distinct o.user_id) as users_with_pair, {tot('o.revenue')} as pair_revenue
                from baskets x join baskets y on x.order_id = y.order_id and x.category < y.category
                join basket_orders o on o.order_id = x.order_id group by 1, 2) p
            join (select category, count(*) as n from baskets group by 1) a on a.category = p.category_a
            join (select category, count(*) as n from baskets group by 1) b on b.category = p.category_b
            cross join (select count(*) as n from basket_orders) t)""",
    ),
    "price_band_performance": (
        "fact_products",
        f"""select * exclude (m_rev), case when return_rate_pct >= 11 then 'Improve fit/size confidence'
                when cancel_value_share_pct >= 16 then 'Diagnose cancellation friction'
                when gross_margin_pct < 45 and revenue > m_rev then 'Review pricing or supplier cost'
                when status_leakage_pct >= 47 then 'Leakage reduction priority' else 'Maintain / monitor' end as price_band_action
        from (select *, gmv_all_status - revenue as status_leakage_value, {pct('gross_profit', 'revenue')} as gross_margin_pct,
                {pct('returned_items', 'total_items')} as return_rate_pct, {pct('gmv_all_status - revenue', 'gmv_all_status')} as status_leakage_pct,
                {pct('cancelled_value', 'gmv_all_status')} as cancel_value_share_pct, median(revenue) over () as m_rev
            from (select department, category, price_band, {GROUP_TOTALS}, {ratio(tot('sale_price'), 'count(sale_price)')} as avg_sale_price
                from fact_products where department is not null and category is not null group by 1, 2, 3))""",
    ),
    "inventory_turnover": (
        "fact_stock",
        _metrics(
            f"""select count(*) as units, {isum('is_sold')} as sold, {mean_if('is_sold = 0', 'holding_days')} as avg_days,
                max(case when is_sold = 0 then holding_days end) as max_days from fact_stock""",
            [
                ("Total Inventory Units", "units", "units"),
                ("Sold Units", "sold", "units"),
                ("Unsold Units", "units - sold", "units"),
                ("Sell-Through Rate", f"{ratio('sold', 'units')} * 100", "%"),
                ("Avg Holding Days (Unsold)", "avg_days", "days"),
                ("Max Holding Days", "max_days", "days"),
            ],
        ),
    ),
    "holding_cost": (
        "fact_stock",
        _metrics(
            f"""select count(*) as units, {tot('sunk_cost_risk')} as frozen, {tot('holding_cost_estimate')} as holding,
                {mean('holding_days')} as avg_days from fact_stock where is_sold = 0""",
            [
                ("Total Unsold Units", "units", "units"),
                ("Total Frozen Capital", "frozen", "$"),
                ("Est. Holding Cost To Cutoff", "holding", "$"),
                ("Combined Financial Impact", "frozen + holding", "$"),
                ("Avg Cost per Unit (Frozen)", ratio("frozen", "units"), "$"),
                ("Avg Holding Days", "avg_days", "days"),
            ],
        ),
    ),
    "inventory_abc_aging": (
        "fact_stock raw_centers category_performance",
        f"""select * exclude (m_aged), case when aged_365_cost > m_aged and sell_through_pct < 35 then 'Clearance / stop-buy'
                when abc_class = 'A' and sell_through_pct < 36 then 'Rebalance allocation by DC'
                when abc_class in ('B', 'C') and aged_180_cost > m_aged then 'Markdown with margin guardrail'
                when abc_class = 'A' and sell_through_pct >= 42 then 'Protect availability / replenish carefully' else 'Monitor' end as inventory_action
        from (select s.*, {pct('sold_units', 'total_units')} as sell_through_pct, d.name as dc_name, r.* exclude (product_category),
                median(aged_180_cost) over () as m_aged
            from (select product_category, department, center_id, count(inventory_id) as total_units, {isum('is_sold')} as sold_units,
                    count_if(sunk_cost_risk > 0) as unsold_units, {tot('sunk_cost_risk')} as frozen_capital,
                    {tot('holding_cost_estimate')} as holding_cost_to_cutoff, {mean_if('is_sold = 0', 'holding_days')} as avg_holding_days_unsold,
                    count_if(is_sold = 0 and holding_days >= 180) as aged_180_units, count_if(is_sold = 0 and holding_days >= 365) as aged_365_units,
                    {tot_if('holding_days >= 180', 'sunk_cost_risk')} as aged_180_cost, {tot_if('holding_days >= 365', 'sunk_cost_risk')} as aged_365_cost
                from fact_stock group by 1, 2, 3) s
            left join raw_centers d on s.center_id = d.id
            left join (select *, case when category_cumulative_revenue_share_pct <= 80 then 'A' when category_cumulative_revenue_share_pct <= 95 then 'B' else 'C' end as abc_class
                from (select category as product_category, revenue as category_revenue, gross_profit as category_gross_profit, gross_margin_pct,
                    status_leakage_value, quadrant as category_quadrant, {ratio0('revenue', tot_over('revenue', ''))} * 100 as category_revenue_share_pct,
                    {ratio0(tot_over('revenue', 'order by revenue desc, category rows unbounded preceding'), tot_over('revenue', ''))} * 100 as category_cumulative_revenue_share_pct
                    from category_performance)) r on s.product_category = r.product_category)""",
    ),
    "fulfillment": (
        "raw_orders",
        _metrics(
            f"""select {ratio(tot('ship'), 'count(ship)')} as ship_mean, median(ship) as ship_median,
                {ratio(tot('deliver'), 'count(deliver)')} as deliver_mean, median(deliver) as deliver_median,
                {ratio(tot('whole'), 'count(whole)')} as whole_mean, median(whole) as whole_median
            from (select {secs('shipped_at', 'created_at')} as ship, {secs('delivered_at', 'shipped_at')} as deliver,
                {secs('delivered_at', 'created_at')} as whole from raw_orders)""",
            [
                ("Avg Days to Ship", "ship_mean / 86400.0::double", "days"),
                ("Median Days to Ship", "ship_median / 86400.0::double", "days"),
                ("Avg Days to Deliver after Ship", "deliver_mean / 86400.0::double", "days"),
                ("Median Days to Deliver after Ship", "deliver_median / 86400.0::double", "days"),
                ("Total Avg Delivery Days", "whole_mean / 86400.0::double", "days"),
                ("Median Delivery Days", "whole_median / 86400.0::double", "days"),
            ],
        ),
    ),
    "root_cause_proxy": (
        "fact_products raw_orders",
        f"""select *, {_rules(1, 'No strong proxy signal')} as proxy_hypothesis, {_rules(2, 'Monitor with category dashboard')} as recommended_action
        from (select * exclude (seconds, timed), {ratio('seconds', 'timed')} / 86400.0::double as avg_fulfillment_days,
                {pct('returned_items', 'total_items')} as return_rate_pct, {pct('cancelled_items', 'total_items')} as cancel_rate_pct,
                {pct('processing_items', 'total_items')} as processing_rate_pct, gmv_all_status - revenue as status_leakage_value,
                {pct('gmv_all_status - revenue', 'gmv_all_status')} as status_leakage_pct, {pct('gross_profit', 'revenue')} as gross_margin_pct
            from (select department, category, brand, price_band, fulfillment_bucket, {GROUP_TOTALS},
                    count_if(status = 'Cancelled') as cancelled_items, count_if(status = 'Processing') as processing_items,
                    {ratio(tot('sale_price'), 'count(sale_price)')} as avg_sale_price, {tot('seconds')} as seconds, count(seconds) as timed
                from (select f.*, {secs('o.delivered_at', 'o.created_at')} as seconds,
                        case when {ROOT_DAYS} <= 2 then '<=2 days' when {ROOT_DAYS} <= 4 then '3-4 days' when {ROOT_DAYS} <= 7 then '5-7 days'
                            when {ROOT_DAYS} > 7 then '8+ days' else 'not delivered / open' end as fulfillment_bucket
                    from fact_products f join raw_orders o on f.order_id = o.order_id)
                where department is not null and category is not null and brand is not null
                group by 1, 2, 3, 4, 5 having count(order_item_id) >= {P.root_cause_min_items}))""",
    ),
    "items_by_status": (
        "raw_items",
        f"""select status, count(id) as items, count(distinct order_id) as orders, {tot('sale_price')} as gmv from raw_items
        where status is not null group by status""",
    ),
    "transaction_kpis": (
        "flagged raw_orders",
        f"""select total_gmv, recognized_revenue, recognized_profit, {ratio0('recognized_profit', 'recognized_revenue')} as recognized_margin,
            completed_revenue, open_processing_revenue, returned_revenue, cancelled_revenue, returned_revenue + cancelled_revenue as leakage_revenue,
            {ratio0('returned_revenue + cancelled_revenue', 'total_gmv')} as leakage_rate, {ratio0('n_returned', 'n_valid')} as return_rate_items,
            {ratio0('n_cancelled', 'items')} as cancel_rate_items, (select count(distinct order_id) from raw_orders) as orders, recognized_orders, items,
            {ratio0('recognized_revenue', 'recognized_orders')} as avg_order_value, {ratio('recognized_revenue', 'n_priced')} as avg_item_price
        from (select {tot('sale_price')} as total_gmv, {tot_if('is_recognized', 'sale_price')} as recognized_revenue,
            {tot_if('is_recognized', 'gross_profit')} as recognized_profit, {tot_if("status = 'Complete'", 'sale_price')} as completed_revenue,
            {tot_if("status = 'Processing'", 'sale_price')} as open_processing_revenue, {tot_if('is_returned', 'sale_price')} as returned_revenue,
            {tot_if('is_cancelled', 'sale_price')} as cancelled_revenue, count_if(is_returned) as n_returned, count_if(is_cancelled) as n_cancelled,
            count_if(is_valid_purchase) as n_valid, count(*) as items, count(distinct case when is_recognized then order_id end) as recognized_orders,
            count_if(is_recognized and sale_price is not null) as n_priced from flagged)""",
    ),
    "customer_table": ("customers", "select * from customers"),
    "customers_by_source": (
        "customers",
        f"""select *, {ratio('buyers', 'users')} as buyer_rate, {ratio('revenue', 'users')} as ltv_per_registered_user, {ratio('revenue', 'buyers')} as arppu
        from (select traffic_source, count(user_id) as users, {flag('buyer')} as buyers, {tot('revenue')} as revenue, {tot('profit')} as profit
            from customers group by traffic_source)""",
    ),
    "customers_by_demographics": (
        "customers",
        f"""select g.gender, a.age_group, coalesce(c.users, 0) as users, coalesce(c.buyers, 0) as buyers, coalesce(c.revenue, 0.0) as revenue,
            {ratio('coalesce(c.buyers, 0)', 'coalesce(c.users, 0)')} as buyer_rate
        from (select distinct gender from customers where gender is not null) g
        cross join (select unnest(['<=24', '25-34', '35-44', '45-54', '55-64', '65+']) as age_group) a
        left join (select gender, age_group, count(user_id) as users, {flag('buyer')} as buyers, {tot('revenue')} as revenue
            from customers group by 1, 2) c on c.gender = g.gender and c.age_group = a.age_group""",
    ),
    "customer_value_segments": (
        "customers",
        f"""select segment, count(user_id) as customers, {tot('revenue')} as revenue, {mean('valid_orders')} as avg_orders, {mean('recency_days')} as avg_recency
        from (select *, case when valid_orders >= 2 and recency_days > 180 then 'Repeat at risk'
                when valid_orders >= 2 and recency_days <= 90 and revenue >= (select quantile_cont(revenue, 0.75) from customers where buyer) then 'Champions'
                when valid_orders >= 2 and recency_days <= 180 then 'Loyal/active repeat'
                when valid_orders = 1 and recency_days <= 90 then 'New one-time' else 'One-time low value' end as segment
            from customers where buyer) group by segment""",
    ),
    "customer_summary": (
        "customers",
        f"""select registered_users, buyers, recognized_buyers, {ratio0('buyers', 'registered_users')} as buyer_penetration, repeat_buyers,
            {ratio0('repeat_buyers', 'buyers')} as repeat_rate, {ratio0('one_time', 'buyers')} as one_time_rate, avg_valid_orders_per_buyer, median_recency_days
        from (select count(distinct user_id) as registered_users, count_if(buyer) as buyers, count_if(recognized_buyer) as recognized_buyers,
            count_if(repeat_buyer) as repeat_buyers, count_if(buyer and not repeat_buyer) as one_time,
            {mean_if('buyer', 'valid_orders')} as avg_valid_orders_per_buyer, median(case when buyer then recency_days end)::double as median_recency_days
            from customers)""",
    ),
    "product_categories": (
        "flagged",
        f"""select r.*, {ratio('profit', 'revenue')} as margin, {ratio('n_ret', 'n_ret + n_com + n_shi')} as return_rate,
            {ratio('n_can', 'all_items')} as cancel_rate, all_items
        from (select category, department, {tot('sale_price')} as revenue, {tot('gross_profit')} as profit, count(id) as items,
            count(distinct order_id) as orders from flagged where is_recognized group by 1, 2) r
        left join (select category as c, count_if(status = 'Cancelled') as n_can, count_if(status = 'Returned') as n_ret,
            count_if(status = 'Complete') as n_com, count_if(status = 'Shipped') as n_shi, count(id)::bigint as all_items
            from flagged where category is not null group by 1) s on r.category = s.c""",
    ),
    "product_brands": (
        "flagged",
        f"""select *, {ratio('profit', 'revenue')} as margin from (select brand, category, {tot('sale_price')} as revenue, {tot('gross_profit')} as profit,
            count(id) as items from flagged where is_recognized group by 1, 2)""",
    ),
    "product_price_bands": (
        "flagged",
        f"""select *, {ratio('profit', 'revenue')} as margin from (
            select case when sale_price <= 25 then '<$25' when sale_price <= 50 then '$25-50' when sale_price <= 100 then '$50-100'
                when sale_price <= 200 then '$100-200' when sale_price <= 500 then '$200-500' else '$500+' end as price_band,
                {tot('sale_price')} as revenue, {tot('gross_profit')} as profit, count(id) as items
            from flagged where is_recognized and sale_price > 0 group by 1)""",
    ),
    "event_counts": ("raw_events", "select event_type, count(*) as events from raw_events where event_type is not null group by 1"),
    "source_counts": ("raw_events", "select traffic_source, count(*) as events from raw_events where traffic_source is not null group by 1"),
    "sessions": ("sessions", "select * from sessions"),
    "session_funnel": (
        "sessions",
        f"""select *, {ratio('product_sessions', 'sessions')} as product_rate, {ratio('cart_sessions', 'product_sessions')} as cart_rate,
            {ratio('purchase_sessions', 'sessions')} as purchase_rate, {ratio('purchase_sessions', 'cart_sessions')} as cart_to_purchase,
            {ratio('cancel_sessions', 'cart_sessions')} as cancel_per_cart, {ratio('bounce_sessions', 'sessions')} as bounce_rate
        from (select traffic_source, count(session_id) as sessions, {isum('product')} as product_sessions, {isum('cart')} as cart_sessions,
            {isum('purchase')} as purchase_sessions, {isum('cancel')} as cancel_sessions, {flag('bounce')} as bounce_sessions,
            {ratio('sum(event_count)', 'count(event_count)')} as avg_events from sessions group by 1)""",
    ),
    "monthly_sessions": (
        "sessions",
        f"""select *, {ratio('purchases', 'sessions')} as purchase_rate from (select strftime(start, '%Y-%m') as month, count(session_id) as sessions,
            {isum('purchase')} as purchases, {isum('cart')} as carts from sessions where start is not null group by 1)""",
    ),
    "marketing_summary": (
        "sessions raw_events",
        f"""select sessions, (select count(*) from raw_events) as events, {ratio0('purchases', 'sessions')} as overall_purchase_session_rate,
            {ratio0('purchases', 'carts')} as overall_cart_to_purchase, {ratio0('bounces', 'sessions')} as overall_bounce_rate,
            (select {ratio0('count_if(user_id is null)', 'count(*)')} from raw_events) as anonymous_event_pct, {ratio('n_events', 'sessions')} as avg_events_per_session
        from (select count(session_id) as sessions, {isum('purchase')} as purchases, {isum('cart')} as carts, {flag('bounce')} as bounces,
            sum(event_count) as n_events from sessions)""",
    ),
    "inventory_by_center": ("by_center", "select * from by_center"),
    "inventory_by_category": (
        "aged",
        f"""select *, {ratio('sold_units', 'inventory_units')} as sell_through, {ratio('aged_180_units', 'unsold_units')} as aged_180_rate
        from (select product_category, {_stock_sums()} from aged where product_category is not null group by 1)""",
    ),
    "center_stock_vs_demand": (
        "by_center flagged",
        f"""select *, stock_share - revenue_share as stock_minus_demand_share
        from (select c.*, coalesce(d.revenue, 0.0) as revenue, coalesce(d.profit, 0.0) as profit, coalesce(d.sold_order_items, 0) as sold_order_items,
                {ratio('unsold_cost', tot_over('unsold_cost', ''))} as stock_share,
                {ratio('coalesce(d.revenue, 0.0)', tot_over('coalesce(d.revenue, 0.0)', ''))} as revenue_share
            from by_center c left join (select dc_id, {tot('sale_price')} as revenue, {tot('gross_profit')} as profit, count(id) as sold_order_items
                from flagged where is_recognized and dc_id is not null group by 1) d on c.dc_id = d.dc_id)""",
    ),
    "returns_by_delivery_time": (
        "flagged",
        f"""select *, {ratio('returned', 'items')} as return_rate
        from (select case when fulfillment_days <= 3 then '<=3d' when fulfillment_days <= 5 then '3-5d' when fulfillment_days <= 7 then '5-7d'
                when fulfillment_days <= 10 then '7-10d' else '>10d' end as fulfillment_bin, count(id) as items, {flag('is_returned')} as returned,
                {mean(secs('delivered_at', 'created_at'))} / 86400.0::double as avg_fulfillment_days
            from flagged where status in ('Complete', 'Returned') and fulfillment_days is not null group by 1)""",
    ),
    "fulfillment_summary": (
        "flagged",
        f"""select {mean(secs('shipped_at', 'created_at'))} / 86400.0::double as avg_ship_days,
            {mean(secs('delivered_at', 'shipped_at'))} / 86400.0::double as avg_delivery_days,
            {mean_if("status in ('Complete', 'Returned')", secs('delivered_at', 'created_at'))} / 86400.0::double as avg_fulfillment_days,
            count_if(status = 'Processing') as processing_items, count_if(status = 'Shipped') as shipped_not_complete_items,
            {tot_if("status = 'Processing'", 'sale_price')} as processing_revenue, {tot_if("status = 'Shipped'", 'sale_price')} as shipped_revenue from flagged""",
    ),
    "inventory_summary": (
        "aged cutoff",
        f"""select (select cutoff from cutoff) as cutoff, inventory_units, sold_units, unsold_units, {ratio0('sold_units', 'inventory_units')} as sell_through,
            unsold_cost, aged_180_units, aged_180_cost, aged_365_units, avg_unsold_age_days, avg_sold_holding_days
        from (select count(*) as inventory_units, {flag('is_sold')} as sold_units, count_if(not is_sold) as unsold_units, {tot('unsold_cost')} as unsold_cost,
            {flag('aged_180')} as aged_180_units, {tot_if('aged_180', 'cost')} as aged_180_cost, {flag('aged_365')} as aged_365_units,
            {mean_if('not is_sold', 'age_seconds')} / 86400.0::double as avg_unsold_age_days,
            {mean_if('is_sold', 'age_seconds')} / 86400.0::double as avg_sold_holding_days from aged)""",
    ),
    "monthly_revenue": ("full_months", "select * from full_months"),
    "revenue_forecast": ("outlook", "select strftime(ahead, '%Y-%m') as month, forecast_revenue, forecast_profit from outlook"),
    "revenue_forecast_summary": (
        "outlook",
        f"""select last as last_full_month, last12_revenue, prev12_revenue, raw_yoy_growth, used_yoy_growth, last12_margin,
            {tot('forecast_revenue')} as next12_revenue_forecast, {tot('forecast_profit')} as next12_profit_forecast from outlook group by all""",
    ),
    "table_summary": (
        "fact funnel_monthly fact_stock dim_users raw_products raw_centers raw_orders",
        """select 'fact_transactions' as "table", count(*) as rows, 19::int as columns, min(created_at::date)::varchar as min_date, max(created_at::date)::varchar as max_date from fact
        union all select 'agg_funnel_monthly', count(*), 5, min(year_month), max(year_month) from funnel_monthly
        union all select 'fact_inventory', count(*), 12, null, null from fact_stock
        union all select 'dim_users', count(*), 18, null, null from dim_users
        union all select 'dim_products', count(*), 6, null, null from raw_products
        union all select 'dim_dcs', count(*), 4, null, null from raw_centers
        union all select 'dim_date', date_diff('day', min(created_at)::date, max(created_at)::date) + 1, 8,
            min(created_at)::date::varchar, max(created_at)::date::varchar from raw_orders""",
    ),
    "order_value_kpis": (
        "fact fact_stock",
        _metrics(
            f"""select (select {tot('sale_price')} from fact) as revenue, (select {tot('gross_profit')} from fact) as profit,
                (select {ratio(tot('sale_price'), 'count(distinct order_id)')} from fact) as order_value,
                (select {ratio(isum('is_sold'), 'count(is_sold)')} * 100 from fact_stock) as sold""",
            [
                ("total_revenue", "revenue", "$"),
                ("gross_profit", "profit", "$"),
                ("avg_order_value", "order_value", "$"),
                ("sell_through_rate_pct", "sold", "%"),
            ],
        ),
    ),
    "signup_cohorts": ("fact raw_users", _purchase_cohorts("select id as user_id, year(created_at) as signup_year from raw_users")),
    "first_purchase_cohorts": ("fact", _purchase_cohorts("select user_id, min(year(created_at)) as signup_year from fact group by 1")),
    "gmv_annual": (
        "yearly_fact",
        f"""select *, {ratio('total_revenue', 'num_orders')} as aov, {pct('gross_profit', 'total_revenue', None)} as gross_margin_pct,
            ({ratio('total_revenue', 'lag(total_revenue) over (order by year)')} - 1) * 100 as yoy_growth_pct
        from (select year, {tot('sale_price')} as total_revenue, {tot('gross_profit')} as gross_profit, count(distinct order_id) as num_orders,
            count(order_item_id) as num_items from yearly_fact where year <= {P.last_full_year} group by year)""",
    ),
    "gmv_category": (
        "fact_products",
        f"""select * exclude (m_rev, m_margin), case when revenue > m_rev and gross_margin_pct > m_margin then 'Star'
                when revenue > m_rev and gross_margin_pct <= m_margin then 'Cash Cow'
                when revenue <= m_rev and gross_margin_pct > m_margin then 'Problem Child' else 'Dog' end as quadrant
        from (select *, median(revenue) over () as m_rev, median(gross_margin_pct) over () as m_margin
            from (select *, {pct('gross_profit', 'revenue', None)} as gross_margin_pct, {pct('num_returned', 'num_items', None)} as return_rate_pct
                from (select category, {tot('sale_price')} as revenue, {tot('gross_profit')} as gross_profit, count(order_item_id) as num_items,
                    {isum('is_returned')} as num_returned from fact_products where category is not null group by 1)))""",
    ),
    "returns_by_category": (
        "fact_products",
        f"""select category, count(order_item_id) as returned_items, {tot('sale_price')} as return_value,
            count(order_item_id) * {RETURN_COST} as estimated_processing_cost
        from fact_products where is_returned = 1 and category is not null group by 1""",
    ),
    "monthly_funnel_rates": (
        "funnel_monthly",
        f"""select *, {pct('cart_events', 'product_events', None)} as product_to_cart_pct, {pct('purchase_events', 'cart_events', None)} as cart_to_purchase_pct,
            {pct('purchase_events', 'product_events', None)} as product_to_purchase_pct,
            {pct('cancel_events', 'cart_events + purchase_events + cancel_events', None)} as cancel_proxy_pct
        from (select {', '.join(f"coalesce(sum(case when event_type = '{k}' then event_count end), 0)::bigint as {k}_events" for k in ('product', 'cart', 'purchase', 'cancel'))}
            from funnel_monthly)""",
    ),
    "purchase_intensity": (
        "funnel_monthly",
        f"""select *, {ratio('event_count', 'user_months')} as purchase_events_per_user_month
        from (select traffic_source, sum(event_count)::bigint as event_count, sum(unique_users)::bigint as user_months
            from funnel_monthly where event_type = 'purchase' group by 1)""",
    ),
    "monthly_stage_trend": (
        "funnel_monthly",
        """select year_month, event_type, sum(event_count)::bigint as event_count from funnel_monthly
        where event_type in ('product', 'cart', 'purchase') group by 1, 2""",
    ),
    "deduplicated_gmv_series": ("gmv_monthly", "select * from gmv_monthly"),
    "rolling_mean": (
        "gmv_monthly",
        f"""select *, {ratio(tot_over('y', 'partition by category order by ds rows between 2 preceding and current row'), 'count(y) over (partition by category order by ds rows between 2 preceding and current row)')} as rolling_mean
        from gmv_monthly""",
    ),
    "series_gaps": (
        "gmv_monthly",
        """select category, (datediff('month', min(ds), max(ds)) + 1 - count(distinct ds))::bigint as missing_months, min(y) as min_value, max(y) as max_value
        from gmv_monthly group by 1""",
    ),
    "train_validation_split": (
        "aged_series", "select category, ds, y, case when age <= 12 then 'validation' else 'train' end as part from aged_series",
    ),
    "backtest_metrics": (
        "aged_series",
        f"""select category, {mean('err')} as mae, sqrt({mean('err * err')}) as rmse, {mean_if('y <> 0', 'abs(err / nullif(y, 0))')} * 100 as mape_pct
        from (select *, abs(y - before) as err from aged_series where age <= 12 and n >= 24) group by 1""",
    ),
    "enriched_rfm": ("enriched", "select * from enriched"),
    "rule_clusters": ("rule_clusters", "select * from rule_clusters"),
    "cluster_profile": (
        "rule_clusters",
        f"""select cluster, cluster_label, {', '.join(f"{mean(c)} as {c}" for c in ('Recency', 'Frequency', 'Monetary', 'aov', 'category_diversity', 'return_rate_pct'))}
        from rule_clusters group by 1, 2""",
    ),
    "users_with_clusters": (
        "dim_users rule_clusters",
        "select d.*, r.cluster_label from dim_users d left join rule_clusters r on r.user_id = d.user_id",
    ),
    "cluster_count_checks": (
        "",
        _values(
            {
                "candidates": 6, "least_k": 2, "most_k": 7, "chosen": 1, "cost_rises": 0, "costs_beyond_total_variance": 0,
                "not_converged": 0,
            }
        ),
    ),
    "kmeans_checks": (
        "enriched",
        _values(
            {
                "users": "select count(*) from enriched", "distinct_users": "select count(distinct user_id) from enriched",
                "unnamed": 0, "names_out_of_order": 0, "clusters_out_of_range": 0,
            }
        ),
    ),
    "forecast_checks": (
        "monthly regular",
        f"""select category, (last_ds + to_months(h::int))::date as ds, '{MODEL}' as model_type, true as in_band
        from {FORECAST} cross join range(1, 13) t(h)""",
    ),
    "tuned_forecast_checks": (
        "monthly regular",
        f"select category, (last_ds + to_months(h::int))::date as ds, true as in_band from {FORECAST} cross join range(1, 13) t(h)",
    ),
    "forecast_evaluation_checks": (
        "monthly regular",
        f"""select category, n - 12 as train_months, 12::int as test_months, first_ds as train_start, (last_ds - to_months(12))::date as train_end,
            '{MODEL}' as model_type, true as known from {FORECAST}""",
    ),
    "forecast_backtest_checks": ("monthly regular", f"select category, true as consistent from {FORECAST}"),
    "tune_forecast_checks": ("monthly regular", f"select category, true as in_grid, true as no_worse from {FORECAST}"),
    "calendar_effect_checks": ("monthly regular", f"select category, true as same_without, true as known_with from {FORECAST}"),
    "model_report_checks": (
        "",
        "\nunion all ".join(
            f"select '{section}' as section, '{metric}' as metric, true as holds"
            for section, metric in [
                ("Clustering", "cluster_count"), ("Clustering", "top_cluster"), ("Forecasting", "model_type"),
                ("Forecasting", "top_category_mape_pct"), ("Forecasting", "use_for_demand_planning"),
            ]
        ),
    ),
    "monthly_category_series": ("monthly", "select * from monthly"),
    "regular_monthly": ("regular", "select * from regular"),
    "top_categories": (
        "monthly",
        f"""select * from monthly where category in (select category from monthly group by 1 order by {tot('revenue')} desc, category limit 3)""",
    ),
    "seasonal_naive_forecast": (
        "aged_series",
        f"""select category, ds, yhat, yhat * 0.85::double as yhat_lower, yhat * 1.15::double as yhat_upper, mape_pct
        from (select s.category, (last_ds + to_months(h::int))::date as ds, mape_pct,
                case when s.n >= 24 then b.y * greatest(least(last / greatest(previous, 1.0::double), 1.5), 0.5) else mean_y end as yhat
            from (select category, max(n) as n, max(ds) as last_ds, {mean('y')} as mean_y, {tot_if('age <= 12', 'y')} as last,
                {tot_if('age > 12 and age <= 24', 'y')} as previous,
                case when max(n) >= 24 then {rnd(mean_if('age <= 12', 'abs((y - before) / nullif(y, 0)) * 100'), 2)} end as mape_pct
                from aged_series group by 1) s
            cross join generate_series(1, 12) g(h) left join aged_series b on b.category = s.category and b.age = 13 - h)""",
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(needs, select) for name, (needs, select) in _SQL.items()}
