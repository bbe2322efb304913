"""Small hand-made frames for what the test tables do not contain."""

import datetime as dt
import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import by, rows
from tradewind.operators import basket, clean, customers, funnel, operations, revenue, series, star
from tradewind.params import Params


def ts(day, hour=0, month=1, year=2023):
    return dt.datetime(year, month, day, hour)


FACT = (
    "order_item_id long, order_id long, user_id long, product_id long, sale_price double, gross_profit double, status string, "
    "created_at timestamp_ntz"
)


def fact(spark, data):
    """(order, user, product, price, profit, status, time) rows as a fact table."""
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], FACT)
    df = df.withColumn("date_key", F.date_format("created_at", "yyyyMMdd").cast("int")).withColumn(
        "is_returned", (F.col("status") == "Returned").cast("int")
    )
    return star.ensure_revenue_columns(df)


def products(spark, data):
    return spark.createDataFrame(data, "product_id long, category string, brand string, department string")


def test_fact_keeps_priced_items_of_dated_orders(spark):
    orders = spark.createDataFrame(
        [(1, "Complete", ts(5)), (2, "Complete", None), (3, "Shipped", ts(5, year=2024)), (4, "Returned", ts(6))],
        "order_id long, status string, created_at timestamp_ntz",
    )
    items = spark.createDataFrame(
        [(1, 1, 7, 1, "Cancelled", 10.0), (2, 1, 7, 1, "Complete", 0.5), (3, 2, 7, 1, "Complete", 10.0),
         (4, 3, 7, 1, "Complete", 10.0), (5, 4, 8, 2, "Complete", 20.0), (6, 99, 8, 2, "Complete", 20.0)],
        "id long, order_id long, user_id long, product_id long, status string, sale_price double",
    )
    catalog = spark.createDataFrame([(1, 4.0, "a")], "id long, cost double, category string")
    cleaned = clean.revenue_items(clean.clean_order_items(items, catalog))
    got = by(
        star.build_fact_transactions(cleaned, clean.orders_for_analysis(orders)),
        "order_item_id", "status", "date_key", "gross_profit", "Recognized_Revenue", "Return_Value", "is_returned",
    )
    # The order's status counts, and a product without cost has no profit.
    assert got == {1: ("Complete", 20230105, 6.0, 10.0, 0.0, 0), 5: ("Returned", 20230106, None, 0.0, 20.0, 1)}


def test_dated_copy_of_a_user_is_kept_before_an_undated_one(spark):
    users = spark.createDataFrame(
        [(1, None, 30, "F", "x"), (1, ts(2, year=2020), 40, "M", "y"), (1, ts(3, year=2021), 50, "M", "z"), (2, None, 20, None, None)],
        "id long, created_at timestamp_ntz, age int, gender string, city string",
    )
    assert rows(clean.clean_users(users), "id", "age", "city") == [(1, 40, "y"), (2, 20, "Unknown")]


def test_rfm_scores_and_return_rate(spark):
    orders = spark.createDataFrame(
        [(i, "Complete", ts(1 + i)) for i in range(10)] + [(90, "Returned", ts(3)), (91, "Complete", None)],
        "order_id long, status string, created_at timestamp_ntz",
    )
    items = spark.createDataFrame(
        [(i, i, i, 10.0 * i) for i in range(10)] + [(90, 90, 0, 1.0), (91, 91, 1, 1.0), (92, 91, 77, 1.0)],
        "id long, order_id long, user_id long, gross_profit double",
    )
    params = Params(analysis_cutoff="2023-01-11")
    got = by(customers.create_rfm(orders, items, params), "user_id", "Recency", "Frequency", "R_score", "F_score", "M_score", "return_rate_pct")
    assert set(got) == set(range(10))  # user 77 has no dated purchase
    assert got[0] == (10, 1, 1, 1, 1, 50.0)
    assert got[9] == (1, 1, 5, 5, 5, 0.0)
    assert got[1][1] == 1 and got[1][5] == 0.0


def test_rfm_segments_follow_the_total_score(tables):
    for score, segment in {
        (r["R_score"] + r["F_score"] + r["M_score"], r["rfm_segment"]) for r in tables.rfm.collect()
    }:
        expected = (
            "Champions" if score >= 13 else "Loyal" if score >= 10 else "At Risk" if score >= 7
            else "About to Lose" if score >= 4 else "Lost"
        )
        assert segment == expected


def test_cohorts_have_every_year_and_a_full_diagonal(spark):
    data = [
        (1, 1, 1, 10.0, 1.0, "Complete", ts(1, year=2020)),
        (2, 1, 1, 10.0, 1.0, "Complete", ts(1, year=2022)),
        (3, 2, 1, 10.0, 1.0, "Shipped", ts(1, year=2020)),
        (4, 3, 1, 10.0, 1.0, "Complete", ts(1, year=2021)),
        (5, 4, 1, 10.0, 1.0, "Cancelled", ts(1, year=2020)),
        (6, None, 1, 10.0, 1.0, "Complete", ts(1, year=2020)),
    ]
    retention = customers.cohort_retention(fact(spark, data))
    assert by(retention, ("cohort_year", "year"), "users", "retention_pct") == {
        (2020, 2020): (2, 100.0), (2020, 2021): (0, 0.0), (2020, 2022): (1, 50.0),
        (2021, 2020): (0, 0.0), (2021, 2021): (1, 100.0), (2021, 2022): (0, 0.0),
    }
    wide = customers.cohort_matrix(retention, [2020, 2021, 2022, 2023])
    assert rows(wide) == [(2020, 100.0, 0.0, 50.0, 0.0), (2021, 0.0, 100.0, 0.0, 0.0)]


def test_ltv_without_buyers_is_zero(spark):
    users = spark.createDataFrame([(1, 0, 0.0)], "user_id long, Frequency long, Monetary double")
    got = by(customers.ltv_cac(users), "metric", "value")
    assert got["No Valid Purchase Users %"] == 100.0 and got["LTV:CAC Ratio"] == 0.0
    assert got["One-time Buyers % (valid customers)"] == 0.0


def test_leakage_and_growth_with_a_year_without_recognized_revenue(spark):
    data = [
        (1, 1, 1, 10.0, 4.0, "Complete", ts(1, year=2020)),
        (1, 1, 2, 30.0, 6.0, "Complete", ts(1, year=2020)),
        (2, 1, 1, 40.0, 4.0, "Processing", ts(1, year=2021)),
        (3, 1, 1, 80.0, 4.0, "Shipped", ts(1, year=2022)),
        (4, 1, 1, 20.0, 4.0, "Returned", ts(1, year=2022)),
        (5, 1, 1, 20.0, 4.0, "Complete", ts(1, year=2024)),
    ]
    got = by(revenue.annual_revenue(fact(spark, data)), "year", "revenue", "num_orders", "aov", "gross_margin_pct", "status_leakage_pct", "yoy_growth_pct")
    assert got == {
        2020: (40.0, 1, 40.0, 25.0, 0.0, None),
        2021: (0.0, 0, None, None, 100.0, -100.0),
        2022: (80.0, 1, 80.0, 5.0, 20.0, None),
    }
    shares = by(revenue.status_leakage(fact(spark, data)), ("year", "status"), "share_of_gmv_pct", "is_recognized_revenue")
    assert shares[(2022, "Returned")] == (20.0, False) and shares[(2022, "Shipped")] == (80.0, True)


def test_gmv_splits_into_statuses_every_year(tables):
    for r in revenue.annual_revenue(tables.fact, Params(partial_year=2001)).collect():
        parts = r["revenue"] + r["cancelled_value"] + r["return_value"] + r["processing_backlog_value"]
        assert abs(parts - r["gmv_all_status"]) < 1e-6
        assert r["num_items"] <= r["total_items"]


def test_fact_rows_and_value_reconcile(tables):
    from tradewind.operators import quality

    checks = by(quality.scope_reconciliation(tables.raw.orders, tables.raw.order_items, tables.fact, Params(partial_year=2001)), "check", "value")
    annual = revenue.annual_revenue(tables.fact, Params(partial_year=2001)).agg(F.sum("total_items"), F.sum("gmv_all_status"), F.sum("returns")).first()
    assert annual[0] == checks["fact_transaction_rows"]
    assert abs(annual[1] - checks["processed_fact_gmv"]) < 0.01
    assert abs(checks["raw_gmv"] - checks["processed_fact_gmv"] - checks["gmv_removed_from_model_scope"]) < 0.02
    returned = by(revenue.return_costs(tables.fact), "metric", "value")["Total Returned Items"]
    assert annual[2] == returned


def test_segments_cover_all_users(tables):
    got = by(customers.rfm_segmentation(tables.dim_users), "segment", "count")
    assert sum(got.values()) == tables.raw.users.count()
    assert got["No Purchase / No Valid Purchase"] == tables.raw.users.count() - tables.rfm.count()


def test_quadrants_compare_with_the_median(spark):
    catalog = products(spark, [(1, "a", "x", "W"), (2, "b", "x", "W"), (3, "c", "x", "W"), (4, None, "x", "W")])
    data = [(i, 1, p, price, profit, "Complete", ts(1)) for i, (p, price, profit) in enumerate([(1, 300.0, 30.0), (2, 200.0, 100.0), (3, 100.0, 30.0), (4, 999.0, 1.0)])]
    got = by(revenue.category_performance(fact(spark, data), catalog), "category", "quadrant", "gross_margin_pct")
    assert got == {"a": ("Cash Cow", 10.0), "b": ("Problem Child", 50.0), "c": ("Dog", 30.0)}


EVENTS = "id long, user_id long, session_id string, sequence_number int, event_type string, traffic_source string, created_at timestamp_ntz"


def test_funnel_with_missing_stages(spark):
    events = spark.createDataFrame(
        [(1, 1, "s1", 1, "product", "Email", ts(1)), (2, None, "s1", 2, "product", "Email", ts(1)), (3, 1, "s2", 1, "purchase", None, ts(1))],
        EVENTS,
    )
    got = by(funnel.funnel(events), "stage", "event_count", "sessions", "global_unique_users", "event_conversion_from_prev_pct", "session_conversion_from_prev_pct")
    assert got == {
        "product": (2, 1, 1, 100.0, 100.0),
        "cart": (0, None, None, 0.0, None),
        "purchase": (1, 1, 1, None, None),
        "cancel": (0, None, None, 0.0, None),
    }
    journey = by(funnel.journey_by_source(events), ("traffic_source", "event_type"), "event_count", "sessions", "source_event_count", "event_share_within_source_pct", "product_to_purchase_session_cvr_pct")
    assert len(journey) == 6  # a missing source is left out, stages are complete
    assert journey[("Email", "product")] == (2, 1, 2, 100.0, 0.0)
    assert journey[("Email", "cancel")] == (0, 0, 2, 0.0, 0.0)


def test_funnels_without_events(spark):
    assert [r["event_count"] for r in funnel.funnel(spark.createDataFrame([], EVENTS)).collect()] == [0, 0, 0, 0]
    assert funnel.journey_by_source(spark.createDataFrame([], EVENTS)).count() == 0


def test_session_source_is_the_first_known(spark):
    events = spark.createDataFrame(
        [(3, 1, "s", 1, "home", None, ts(1, 2)), (2, 1, "s", 2, "cart", "Email", ts(1, 1)), (1, 1, "s", 3, "cart", "Organic", ts(1, 4)), (4, None, "t", 1, "purchase", None, ts(2))],
        EVENTS,
    )
    got = by(funnel.sessions(events), "session_id", "traffic_source", "event_count", "home", "cart", "purchase", "duration_min", "bounce")
    assert got == {"s": ("Email", 3, 1, 1, 0, 180.0, False), "t": (None, 1, 0, 0, 1, 0.0, True)}
    assert by(funnel.session_funnel(funnel.sessions(events)), "traffic_source", "purchase_rate", "cart_to_purchase") == {
        "Email": (0.0, 0.0), None: (1.0, None),
    }


def affinity_by_hand(data, category):
    baskets, revenue_of, user_of = defaultdict(set), defaultdict(float), {}
    for order, user, product, price, _, status, _ in data:
        if status in ("Complete", "Shipped") and category.get(product):
            baskets[order].add(category[product])
            revenue_of[order] += price
            user_of.setdefault(order, user)
    pairs = defaultdict(list)
    for order, basket_ in baskets.items():
        for pair in itertools.combinations(sorted(basket_), 2):
            pairs[pair].append(order)
    total, single = len(baskets), defaultdict(int)
    for basket_ in baskets.values():
        for c in basket_:
            single[c] += 1
    return {
        (a, b): (
            len(o), len({user_of[x] for x in o}), round(sum(revenue_of[x] for x in o), 6),
            round(len(o) / total * 100, 3), round((len(o) / total) / (single[a] / total * single[b] / total), 2),
        )
        for (a, b), o in pairs.items()
    }


def test_basket_pairs_match_brute_force_with_one_order_of_a_third_of_all_rows(spark):
    category = {p: "abcdefg"[p % 7] for p in range(40)} | {40: None}
    data = []
    for i in range(300):
        order = 0 if i % 3 == 0 else 1 + (i * 7) % 60
        data.append((order, order % 13, (i * 11) % 41, float(i % 9 + 1), 1.0, "Complete" if (order + i) % 5 else "Cancelled", ts(1)))
    catalog = products(spark, [(p, c, "x", "W") for p, c in category.items()])
    got = by(
        basket.basket_affinity(fact(spark, data), catalog), ("category_a", "category_b"),
        "orders_with_pair", "users_with_pair", "pair_revenue", "support_pct", "lift",
    )
    assert got == affinity_by_hand(data, category)


def test_no_pairs_gives_no_rows(spark):
    catalog = products(spark, [(1, "a", "x", "W")])
    data = [(1, 1, 1, 5.0, 1.0, "Complete", ts(1))]
    assert basket.basket_affinity(fact(spark, data), catalog).count() == 0


def test_demographic_grid_has_empty_age_groups(spark):
    people = spark.createDataFrame(
        [(1, "F", "<=24", True, 5.0), (2, "F", "<=24", False, 0.0), (3, "M", None, True, 7.0), (4, None, "<=24", True, 1.0)],
        "user_id long, gender string, age_group string, buyer boolean, revenue double",
    )
    got = by(customers.customers_by_demographics(people), ("gender", "age_group"), "users", "buyers", "revenue", "buyer_rate")
    assert len(got) == 12
    assert got[("F", "<=24")] == (2, 1, 5.0, 0.5) and got[("M", "65+")] == (0, 0, 0.0, None)


def test_value_segments(spark):
    people = spark.createDataFrame(
        [(1, True, 10, 3, 100.0), (2, True, 10, 2, 1.0), (3, True, 200, 2, 100.0), (4, True, 90, 1, 1.0), (5, True, 91, 1, 1.0), (6, False, None, 0, 0.0)],
        "user_id long, buyer boolean, recency_days long, valid_orders long, revenue double",
    )
    assert by(customers.customer_value_segments(people), "segment", "customers") == {
        "Champions": 1, "Loyal/active repeat": 1, "Repeat at risk": 1, "New one-time": 1, "One-time low value": 1,
    }


def test_abc_classes_break_ties_by_name(spark):
    perf = spark.createDataFrame(
        [("b", 40.0), ("a", 40.0), ("c", 15.0), ("d", 5.0)], "category string, revenue double"
    ).withColumns({c: F.lit(0.0) for c in ("gross_profit", "gross_margin_pct", "status_leakage_value")}).withColumn("quadrant", F.lit("Dog"))
    got = by(operations.abc_classes(perf), "product_category", "category_cumulative_revenue_share_pct", "abc_class")
    assert got == {"a": (40.0, "A"), "b": (80.0, "A"), "c": (95.0, "B"), "d": (100.0, "C")}


def test_root_cause_keeps_open_orders_and_drops_small_groups(spark):
    catalog = products(spark, [(1, "a", "x", "W"), (2, "a", None, "W")])
    data = [(i, i, 1, 150.0, 1.0, "Returned" if i % 2 else "Complete", ts(1)) for i in range(6)]
    data += [(50, 1, 1, 10.0, 1.0, "Complete", ts(1)), (51, 1, 2, 150.0, 1.0, "Complete", ts(1))]
    orders = spark.createDataFrame(
        [(i, ts(1), ts(4)) for i in range(3)] + [(i, ts(1), None) for i in range(3, 6)] + [(50, ts(1), ts(2)), (51, ts(1), ts(2))],
        "order_id long, created_at timestamp_ntz, delivered_at timestamp_ntz",
    )
    got = by(operations.root_cause_proxy(fact(spark, data), catalog, orders, Params(root_cause_min_items=3)), "fulfillment_bucket", "total_items", "return_rate_pct", "avg_fulfillment_days", "proxy_hypothesis")
    assert got == {
        "3-4 days": (3, 33.3, 3.0, "High-price fit/expectation mismatch"),
        "not delivered / open": (3, 66.7, None, "High-price fit/expectation mismatch"),
    }
    unknown = operations.root_cause_proxy(fact(spark, data), catalog, None, Params(root_cause_min_items=3))
    assert by(unknown, "fulfillment_bucket", "total_items") == {"unknown": 6}


def test_zero_cost_units_are_not_counted_as_unsold(spark):
    stock = spark.createDataFrame(
        [(1, "a", "W", 1, 0, 200, 0.0, 0.0), (2, "a", "W", 1, 0, 400, 9.0, 1.0), (3, "a", "W", 1, 1, 10, 0.0, 0.0)],
        "inventory_id long, product_category string, department string, center_id long, is_sold int, holding_days long, "
        "sunk_cost_risk double, holding_cost_estimate double",
    )
    centers = spark.createDataFrame([(1, "C")], "dc_id long, name string")
    perf = revenue.category_performance(fact(spark, [(1, 1, 1, 5.0, 1.0, "Complete", ts(1))]), products(spark, [(1, "a", "x", "W")]))
    r = operations.inventory_abc_aging(stock, centers, perf).first()
    assert (r["total_units"], r["sold_units"], r["unsold_units"], r["aged_180_units"], r["aged_365_units"]) == (3, 1, 1, 2, 1)
    assert r["avg_holding_days_unsold"] == 300.0 and r["sell_through_pct"] == 33.3


def months(n, start=2020):
    return [dt.date(start + m // 12, m % 12 + 1, 1) for m in range(n)]


def test_missing_months_become_zero(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 5.0), ("a", dt.date(2020, 4, 1), 2.0), ("b", dt.date(2020, 2, 1), 1.0)], "category string, ds date, revenue double")
    assert rows(series.regular_monthly(df)) == [
        ("a", dt.date(2020, 1, 1), 5.0), ("a", dt.date(2020, 2, 1), 0.0), ("a", dt.date(2020, 3, 1), 0.0),
        ("a", dt.date(2020, 4, 1), 2.0), ("b", dt.date(2020, 2, 1), 1.0),
    ]
    gaps = by(series.series_gaps(df.withColumnRenamed("revenue", "y")), "category", "missing_months", "min_value", "max_value")
    assert gaps == {"a": (2, 2.0, 5.0), "b": (0, 1.0, 1.0)}


@pytest.mark.parametrize("n", [3, 23, 24, 40])
def test_seasonal_naive(spark, n):
    y = [float((i * 7) % 11) for i in range(n)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(months(n), y)], "category string, ds date, y double")
    got = [tuple(r) for r in series.seasonal_naive_forecast(df).orderBy("ds").collect()]
    assert [r[1] for r in got] == months(n + 12)[n:]
    if n < 24:
        assert all(abs(r[2] - sum(y) / n) < 1e-6 and r[5] is None for r in got)
        return
    growth = max(min(sum(y[-12:]) / max(sum(y[-24:-12]), 1), 1.5), 0.5)
    errors = [abs((a - p) / a) * 100 for a, p in zip(y[-12:], y[-24:-12]) if a]
    for r, base in zip(got, y[-12:]):
        assert abs(r[2] - base * growth) < 1e-9 and abs(r[3] - r[2] * 0.85) < 1e-9 and abs(r[4] - r[2] * 1.15) < 1e-9
        assert abs(r[5] - sum(errors) / len(errors)) < 0.006


ITEMS = "sale_price double, gross_profit double, created_at timestamp_ntz, is_recognized boolean"


def test_outlook_skips_the_open_month_and_clips_growth(spark):
    data = [(100.0, 50.0, dt.datetime(2021, m, 15), True) for m in range(1, 13)]
    data += [(200.0, 50.0, dt.datetime(2022, m, 15), True) for m in range(1, 13) if m != 5]
    data += [(999.0, 1.0, dt.datetime(2023, 1, 10), True), (999.0, 1.0, dt.datetime(2023, 2, 10), False)]
    monthly = series.monthly_revenue(spark.createDataFrame(data, ITEMS))
    assert monthly.count() == 24 and monthly.where("month = date'2022-05-01'").first()["revenue"] == 0.0
    s = series.revenue_forecast_summary(monthly).first()
    assert (s["last_full_month"], s["last12_revenue"], s["prev12_revenue"], s["used_yoy_growth"]) == (dt.date(2022, 12, 1), 2200.0, 1200.0, 0.5)
    ahead = by(series.revenue_forecast(monthly), "month", "forecast_revenue", "forecast_profit")
    assert ahead["2023-01"] == (300.0, 75.0) and ahead["2023-05"] == (0.0, 0.0) and len(ahead) == 12


def test_last_day_of_a_month_closes_it(spark):
    data = [(10.0, 5.0, dt.datetime(2022, 1, 31), True)]
    monthly = series.monthly_revenue(spark.createDataFrame(data, ITEMS))
    assert rows(monthly) == [(dt.date(2022, 1, 1), 10.0, 5.0)]
    s = series.revenue_forecast_summary(monthly).first()
    assert s["prev12_revenue"] is None and s["raw_yoy_growth"] == 0.0
    short = spark.createDataFrame([(10.0, 5.0, dt.datetime(2022, 1, 3), True)], ITEMS)
    assert series.monthly_revenue(short).count() == 0


def test_split_holds_out_the_last_year(spark):
    df = spark.createDataFrame([("a", d, 1.0) for d in months(30)], "category string, ds date, y double")
    got = series.train_validation_split(df)
    assert got.where("part = 'validation'").count() == 12
    assert got.where("part = 'train'").agg(F.max("ds")).first()[0] == dt.date(2021, 6, 1)


def test_duplicate_sales_count_once_in_the_value_series(spark):
    catalog = products(spark, [(1, "a", "x", "W")])
    data = [(1, 1, 1, 5.0, 1.0, "Complete", ts(1, 1)), (2, 2, 1, 5.0, 1.0, "Complete", ts(1, 9)), (3, 2, 1, 6.0, 1.0, "Cancelled", ts(2))]
    assert rows(series.deduplicated_gmv_series(fact(spark, data), catalog)) == [(dt.date(2023, 1, 1), "a", 11.0)]
