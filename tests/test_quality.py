import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import by, rows
from tradewind.operators import clean, quality
from tradewind.params import Params


def ts(day, hour=0):
    return dt.datetime(2023, 1, day, hour)


def test_equal_dates_break_the_date_rule(spark):
    orders = spark.createDataFrame(
        [
            (1, ts(2), ts(2), ts(3), None, 1),
            (2, ts(2), ts(3), ts(1), ts(5), -1),
            (3, None, ts(3), ts(4), ts(4), 2),
        ],
        "order_id long, created_at timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz, returned_at timestamp_ntz, num_of_item int",
    )
    assert by(quality.order_date_checks(orders), "check", "value") == {
        "shipped_before_created": 1,
        "delivered_before_shipped": 1,
        "returned_before_delivered": 1,
        "negative_num_of_item": 1,
    }


def test_status_rules_ignore_case(spark):
    orders = spark.createDataFrame(
        [("CANCELLED", ts(1), None, None, 1), ("returned", None, None, ts(2), 1), ("Complete", ts(1), ts(2), None, 1)],
        "status string, shipped_at timestamp_ntz, delivered_at timestamp_ntz, returned_at timestamp_ntz, num_of_item int",
    )
    got = by(quality.order_status_checks(orders), "check", "value")
    assert got["cancelled_with_shipped_at"] == 1 and got["returned_without_delivered_at"] == 1
    assert got["returned_without_returned_at"] == 0


def regressions(events):
    """Brute force over lists of (session, sequence, time, id)."""
    back, sessions = 0, set()
    for session in {e[0] for e in events}:
        ordered = sorted((e[1], e[2], e[3]) for e in events if e[0] == session)
        for a, b in zip(ordered, ordered[1:]):
            if b[1] < a[1]:
                back += 1
                sessions.add(session)
    return back, len(sessions)


def test_session_regressions_with_one_session_of_a_third_of_all_events(spark):
    rng = random.Random(5)
    base = dt.datetime(2023, 1, 1)
    events = []
    for i in range(6000):
        session = "hot" if i % 3 == 0 else f"s{rng.randrange(900)}"
        events.append((session, rng.randrange(2000), base + dt.timedelta(seconds=rng.randrange(100_000)), i))
    df = spark.createDataFrame(events, "session_id string, sequence_number int, created_at timestamp_ntz, id long")
    with_null = df.union(df.limit(3).withColumn("session_id", F.lit(None).cast("string")))
    got = by(quality.session_time_checks(with_null), "check", "value")
    back, sessions = regressions(events)
    assert got == {
        "events_checked": 6000,
        "sessions_checked": len({e[0] for e in events}),
        "events_with_time_regressions": back,
        "sessions_with_time_regressions": sessions,
    }


def test_session_regressions_with_equal_sequence_numbers(spark):
    events = [("a", 1, ts(1), 1), ("a", 1, ts(1), 2), ("a", 1, ts(2), 3), ("a", 2, ts(1), 4)]
    df = spark.createDataFrame(events, "session_id string, sequence_number int, created_at timestamp_ntz, id long")
    assert by(quality.session_time_checks(df), "check", "value")["events_with_time_regressions"] == 1


def test_session_checks_on_nothing(spark):
    df = spark.createDataFrame([], "session_id string, sequence_number int, created_at timestamp_ntz, id long")
    assert set(by(quality.session_time_checks(df), "check", "value").values()) == {0}


def test_user_checks_count_all_copies(spark):
    users = spark.createDataFrame(
        [(1, 20, "F", "X"), (1, 21, "F", None), (2, None, None, "X"), (3, 5, "M", "X"), (4, 130, "M", "X")],
        "id long, age int, gender string, city string",
    )
    assert by(quality.user_checks(users), "check", "value") == {
        "duplicate_user_ids": 2, "null_age": 1, "null_gender": 1, "null_city": 1, "invalid_age": 2,
    }


def test_keys_are_counted_once_per_rule(spark):
    child = spark.createDataFrame([(1, 7), (1, None), (9, 7), (9, 7), (None, 8)], "k long, other long")
    rules = [("k", "child", "k", "parent", "id"), ("other", "child", "other", "parent", "id")]
    counts = {("k", 1): 2, ("k", 9): 2, ("other", 7): 3, ("other", 8): 1}
    assert by(quality.tagged_keys({"child": child}, rules), ["rule", "key"], "n") == counts
    counts |= {("k", None): 1, ("other", None): 1}
    assert by(quality.tagged_keys({"child": child}, rules, count_nulls=True), ["rule", "key"], "n") == counts


def reads(df):
    """How many files or tables the plan reads."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_each_child_is_read_once(spark, tables):
    """Besides the adapter, which makes items and inventory of one file, orders of another and users of a third."""
    each = {name: reads(df) for name, df in tables.raw.items()}
    assert reads(quality.profile_tables(tables.raw)) <= sum(each.values())
    parents, children = ("users", "orders", "products", "dcs"), ("orders", "order_items", "products", "inventory", "events")
    assert reads(quality.foreign_key_checks(tables.raw)) <= sum(each[t] for t in parents + children)
    # The report in one row also reads products for their prices and events for their times.
    once = ("order_items", "inventory", "users", "products", "orders", "events", "products")
    assert reads(quality.raw_quality_checks(tables.raw)) <= sum(each[t] for t in once)


def test_costly_products(spark):
    products = spark.createDataFrame([("a", 5.0, 4.0), (None, 5.0, 5.0), ("b", None, 1.0)], "category string, cost double, retail_price double")
    assert by(quality.product_checks(products), "check", "value") == {
        "null_category": 1, "null_cost": 1, "null_retail_price": 0, "cost_greater_than_retail_price": 1,
    }


def test_bots_need_a_known_user_and_more_than_the_threshold(spark):
    events = [(1, ts(1, h)) for h in range(3)] + [(2, ts(1, h)) for h in range(2)] + [(None, ts(1, h)) for h in range(9)]
    df = spark.createDataFrame(events, "user_id long, created_at timestamp_ntz")
    assert rows(quality.bot_candidates(df, Params(bot_threshold=2))) == [(1, dt.date(2023, 1, 1), 3)]


def test_profile_counts_repeated_keys_and_nulls(spark, tables):
    from dataclasses import dataclass

    @dataclass
    class One:
        frame: object

        def items(self):
            return [("users", self.frame)]

    users = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (None, "c"), (2, None)], "id long, city string")
    assert rows(quality.profile_tables(One(users))) == [("users", 5, 2, 2, 4)]
    assert by(quality.profile_columns(One(users)), "column", "null_count", "null_pct") == {"id": (2, 40.0), "city": (2, 40.0)}


def test_missing_item_number_is_a_mismatch(spark, tables):
    raw = tables.raw

    class Changed:
        orders = raw.orders.withColumn("num_of_item", F.lit(None).cast("int"))
        order_items, products, users, inventory, events = raw.order_items, raw.products, raw.users, raw.inventory, raw.events

    expected = raw.orders.join(raw.order_items.select("order_id").distinct(), "order_id").count()
    assert quality.raw_quality_checks(Changed()).first()["order_item_count_mismatch"] == expected


def test_users_keep_one_row_and_get_the_median_age(spark):
    columns = "id long, age int, gender string, city string, created_at timestamp_ntz"
    users = spark.createDataFrame(
        [(1, 10, "F", "X", ts(2)), (1, 90, None, "Y", ts(1)), (2, None, None, None, ts(1)), (3, 200, "M", "X", None), (4, 41, "M", "X", ts(1))],
        columns,
    )
    got = by(clean.clean_users(users), "id", "age", "gender", "city")
    # The median of 10, 41, 90, 200 is 65.5, cut to 65.
    assert got == {1: (90, "Unknown", "Y"), 2: (65, "Unknown", "Unknown"), 3: (120, "M", "X"), 4: (41, "M", "X")}
    nobody = spark.createDataFrame([(1, None, None, None, None)], columns)
    assert by(clean.clean_users(nobody), "id", "age") == {1: 28}


def test_inventory_days_end_at_the_cutoff_even_for_sold_units(spark):
    stock = spark.createDataFrame(
        [(1, ts(1), ts(2), 100.0), (2, ts(1), None, 73.0), (3, ts(20), None, 10.0), (4, None, None, 10.0)],
        "id long, created_at timestamp_ntz, sold_at timestamp_ntz, cost double",
    )
    got = by(
        clean.clean_inventory(stock, Params(inventory_cutoff="2023-01-11")),
        "id", "is_sold", "holding_days", "sunk_cost_risk", "holding_cost_estimate",
    )
    assert got[1] == (1, 10, 0.0, 0.0)
    assert got[2][:3] == (0, 10, 73.0) and abs(got[2][3] - 0.5) < 1e-12
    assert got[3][1] == 0 and got[4][1] is None


def test_the_report_builds_the_fact_table_once(tables, monkeypatch):
    """The fact table stands in no section's plan: its rows and value are counted before, in one pass."""
    fact = tables.fact
    passes, once = [], quality.fact_totals
    monkeypatch.setattr(quality, "fact_totals", lambda fact: passes.append(fact) or once(fact))
    report = quality.quality_report(tables.raw, fact, processed={"fact_transactions": fact})
    assert passes == [fact] and "GMV_All_Status" not in report._jdf.queryExecution().analyzed().toString()
    held = report.where(F.col("section") == "processed_row_counts")
    assert by(held, "check", "value") == {"fact_transactions": float(fact.count())}
