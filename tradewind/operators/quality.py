"""Data-quality checks. Counts come as (section, check, value) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.durable import durable
from tradewind.functions.numeric import flag_total, ratio0, round_even, total
from tradewind.functions.ranking import SLICE_ROWS, split_long_groups
from tradewind.functions.reshape import to_checks, with_row
from tradewind.operators.clean import clean_order_items, orders_for_analysis
from tradewind.params import Params
from tradewind.sources.schemas import PRIMARY_KEYS, RawTables


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _null_counts(name: str, df: DataFrame) -> DataFrame:
    """Rows and nulls per column in one pass, as one row."""
    nulls = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns]
    return df.agg(
        F.lit(name).alias("table"),
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("cols"),
        F.array(*nulls).alias("nulls"),
    )


def per_key_counts(
    name: str, df: DataFrame, sections: Mapping[str, Mapping[str, Column]], repeats_in: str | None = None
) -> DataFrame:
    """One row: the table's `profile` (rows, cols, duplicate_pk, null_cells) and `cells`, (section, check, value) of its rules.

    One pass per table: rows, null cells and rows that meet each rule are counted per primary key, a missing key being one
    key, and then added up. A row beyond the first of its key is a repeated one; `repeats_in` names a section that lists
    all copies of repeated keys. Only counts are shuffled, merged per task before.
    """
    rules = [(section, check, rule) for section, named in sections.items() for check, rule in named.items()]
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    per_key = df.groupBy(PRIMARY_KEYS[name]).agg(
        F.count("*").alias("n"),
        F.sum(nulls).alias("nulls"),
        *[F.count_if(rule).alias(f"_{i}") for i, (_, _, rule) in enumerate(rules)],
    )

    def added(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    values = [(section, check, added(F.col(f"_{i}"))) for i, (section, check, _) in enumerate(rules)]
    if repeats_in:
        values.insert(0, (repeats_in, f"duplicate_{name[:-1]}_ids", added(F.when(F.col("n") > 1, F.col("n")))))
    cells = [F.struct(F.lit(s).alias("section"), F.lit(c).alias("check"), v.cast("double").alias("value")) for s, c, v in values]
    profile = F.struct(
        added(F.col("n")).alias("rows"),
        F.lit(len(df.columns)).alias("cols"),
        added(F.col("n") - 1).alias("duplicate_pk"),
        added(F.col("nulls")).alias("null_cells"),
    )
    return per_key.agg(F.lit(name).alias("table"), profile.alias("profile"), F.array(*cells).alias("cells"))


def _cells(row: DataFrame) -> DataFrame:
    return row.select(F.inline("cells"))


def profile_tables(raw: RawTables) -> DataFrame:
    """Rows, columns, repeated keys and null cells per table."""
    return union([per_key_counts(name, df, {}).select("table", "profile.*") for name, df in raw.items()])


def profile_columns(raw: RawTables) -> DataFrame:
    """Null count and percentage of every column."""
    return (
        union([_null_counts(n, df) for n, df in raw.items()])
        .select("table", "rows", F.inline("nulls"))
        .select(
            "table",
            "column",
            F.col("nulls").alias("null_count"),
            round_even(ratio0("nulls", "rows") * 100, 4).alias("null_pct"),
        )
    )


def counted(df: DataFrame, rules: Mapping[str, Column], section: str) -> DataFrame:
    """How many rows meet each of the named conditions."""
    return to_checks(df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()]), section)


def not_after(later: str, earlier: str) -> Column:
    """Both dates known and the one that should be later is not; equal dates break the rule."""
    return F.col(later) <= F.col(earlier)


def order_date_rules() -> dict[str, Column]:
    return {
        "shipped_before_created": not_after("shipped_at", "created_at"),
        "delivered_before_shipped": not_after("delivered_at", "shipped_at"),
        "returned_before_delivered": not_after("returned_at", "delivered_at"),
        "negative_num_of_item": F.col("num_of_item") < 0,
    }


def order_status_rules() -> dict[str, Column]:
    """Dates that do not fit the status, whatever its case."""
    status = F.lower("status")
    cancelled, returned = status == "cancelled", status == "returned"
    return {
        "cancelled_with_shipped_at": cancelled & F.col("shipped_at").isNotNull(),
        "cancelled_with_delivered_at": cancelled & F.col("delivered_at").isNotNull(),
        "cancelled_with_returned_at": cancelled & F.col("returned_at").isNotNull(),
        "returned_without_delivered_at": returned & F.col("delivered_at").isNull(),
        "returned_without_returned_at": returned & F.col("returned_at").isNull(),
        "negative_num_of_item": F.col("num_of_item") < 0,
    }


def user_rules(params: Params) -> dict[str, Column]:
    """Missing values, and ages outside the accepted range."""
    age = F.col("age")
    return {
        "null_age": age.isNull(),
        "null_gender": F.col("gender").isNull(),
        "null_city": F.col("city").isNull(),
        "invalid_age": (age < params.min_age) | (age > params.max_age),
    }


def product_rules() -> dict[str, Column]:
    return {
        "null_category": F.col("category").isNull(),
        "null_cost": F.col("cost").isNull(),
        "null_retail_price": F.col("retail_price").isNull(),
        "cost_greater_than_retail_price": F.col("cost") > F.col("retail_price"),
    }


def center_rules() -> dict[str, Column]:
    return {f"null_{c}": F.col(c).isNull() for c in ("name", "latitude", "longitude")}


def order_date_checks(orders: DataFrame) -> DataFrame:
    return counted(orders, order_date_rules(), "date_validation")


def order_status_checks(orders: DataFrame) -> DataFrame:
    return counted(orders, order_status_rules(), "order_status_validation")


def event_source_checks(events: DataFrame, users: DataFrame) -> DataFrame:
    """Every traffic source with where it occurs; `is_mismatch` marks sources of events no user has."""
    source = F.col("traffic_source")
    seen = union(
        [
            events.where(source.isNotNull()).select(source, F.lit(1).alias("e"), F.lit(0).alias("u")),
            users.where(source.isNotNull()).select(source, F.lit(0).alias("e"), F.lit(1).alias("u")),
        ]
    )
    return (
        seen.groupBy("traffic_source")
        .agg((F.max("e") == 1).alias("in_events"), (F.max("u") == 1).alias("in_users"))
        .withColumn("is_mismatch", F.col("in_events") & ~F.col("in_users"))
    )


def session_time_checks(events: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Events whose time lies before that of the preceding event of their session.

    Sessions of more than `slice_rows` events are cut into slices in event order. Within a slice the preceding event is
    a lag; between slices the last time of one is compared with the first of the next.
    """
    order = F.struct("sequence_number", "created_at", "id")
    keyed = events.where(F.col("session_id").isNotNull()).select(
        "session_id", "created_at", "id", order.alias("order")
    )
    sliced = split_long_groups(keyed, "session_id", "order", "id", slice_rows)
    in_slice = Window.partitionBy("session_id", "_slice").orderBy("order")
    slices = (
        sliced.withColumn("_back", F.col("created_at") < F.lag("created_at").over(in_slice))
        .groupBy("session_id", "_slice")
        .agg(
            F.count("*").alias("events"),
            F.count_if("_back").alias("back"),
            F.min("order").alias("first"),
            F.max("order").alias("last"),
        )
    )
    # One row per slice; an ordinary session has one.
    by_slice = Window.partitionBy("session_id").orderBy("_slice")
    between = F.col("first.created_at") < F.lag("last.created_at").over(by_slice)
    per_session = (
        slices.withColumn("back", F.col("back") + F.coalesce(between.cast("long"), F.lit(0)))
        .groupBy("session_id")
        .agg(F.sum("events").alias("events"), F.sum("back").alias("back"))
    )
    row = per_session.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events_checked"),
        F.count("*").alias("sessions_checked"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("events_with_time_regressions"),
        F.count_if(F.col("back") > 0).alias("sessions_with_time_regressions"),
    )
    return to_checks(row, "events_validation")


def user_checks(users: DataFrame, params: Params = Params()) -> DataFrame:
    """All copies of repeated ids, missing values, and ages outside the accepted range."""
    return _cells(per_key_counts("users", users, {"users_validation": user_rules(params)}, "users_validation"))


def product_checks(products: DataFrame) -> DataFrame:
    return counted(products, product_rules(), "products_validation")


def center_checks(dcs: DataFrame) -> DataFrame:
    return counted(dcs, center_rules(), "dcs_validation")


def item_checks(clean_items: DataFrame) -> DataFrame:
    price = F.col("sale_price")
    row = clean_items.agg(
        F.count_if(price < 1).alias("sale_price_lt_1"),
        F.count_if(price == 0).alias("sale_price_eq_0"),
        F.count_if(F.col("cost").isNull()).alias("missing_product_cost"),
    )
    return to_checks(row, "order_item_quality")


def tagged_keys(
    children: Mapping[str, DataFrame], rules: Sequence[tuple], count_nulls: bool = False, row_of: str = "", **extra: Column
) -> DataFrame:
    """(rule, parent, key, n, ...): how often each key occurs under each rule (rule, child, column, parent, parent's column).

    A child is read once, whatever the number of its rules: a row becomes one entry per rule, and entries are counted per
    key before anything is looked up. A missing key is left out, or with `count_nulls` is a key of its own. `extra` has
    aggregates over `row`, the time and price of the entries of the child `row_of`.
    """
    entries = []
    for child, df in children.items():
        own = [r for r in rules if r[1] == child]
        cells = [F.struct(F.lit(rule).alias("rule"), F.lit(parent).alias("parent"), F.col(c).alias("key")) for rule, _, c, parent, _ in own]
        # The columns that are added up on the way, and their types.
        row = F.struct(
            *[
                (F.col(c) if child == row_of else F.lit(None).cast(t)).alias(c)
                for c, t in (("created_at", "timestamp_ntz"), ("sale_price", "double"))
            ]
        )
        entries.append(df.select(F.inline(F.array(*cells)), *([row.alias("row")] if extra else [])))
    listed = union(entries)
    if not count_nulls:
        listed = listed.where(F.col("key").isNotNull())
    return listed.groupBy("rule", "parent", "key").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in extra.items()])


def foreign_key_checks(raw: RawTables) -> DataFrame:
    """Rows with a known key and rows whose key the parent lacks, per rule: one read of each child, one join for all rules."""
    # Rule names.
    rules = [
        ("orders.user_id_to_users.id", "orders", "user_id", "users", "id"),
        ("order_items.order_id_to_orders.order_id", "order_items", "order_id", "orders", "order_id"),
        ("order_items.user_id_to_users.id", "order_items", "user_id", "users", "id"),
        ("order_items.product_id_to_products.id", "order_items", "product_id", "products", "id"),
        ("products.distribution_center_id_to_dcs.id", "products", "distribution_center_id", "dcs", "id"),
        ("inventory.product_id_to_products.id", "inventory", "product_id", "products", "id"),
        (
            "inventory.product_distribution_center_id_to_dcs.id",
            "inventory",
            "product_distribution_center_id",
            "dcs",
            "id",
        ),
        ("events.user_id_to_users.id_non_null_only", "events", "user_id", "users", "id"),
    ]
    tables = dict(raw.items())
    keys = tagged_keys({c: tables[c] for c in ("orders", "order_items", "products", "inventory", "events")}, rules)
    parents = {(parent, column) for *_, parent, column in rules}
    known = union([tables[t].select(F.lit(t).alias("parent"), F.col(c).alias("key")) for t, c in sorted(parents)])
    known = known.where(F.col("key").isNotNull()).distinct().withColumn("_known", F.lit(True))
    counted = (
        keys.join(known, ["parent", "key"], "left")
        .groupBy("rule")
        .agg(
            F.sum("n").alias("checked_rows"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
        )
    )
    # A rule without any key has a row too.
    listed = F.inline(F.array(*[F.struct(F.lit(r[0]).alias("rule")) for r in rules]))
    every = raw.orders.sparkSession.range(1).select(listed)
    return (
        every.join(counted, "rule", "left")
        .na.fill(0, ["checked_rows", "orphan_rows"])
        .withColumn("orphan_pct", round_even(ratio0("orphan_rows", "checked_rows") * 100, 4))
    )


def issue_samples(raw: RawTables, clean_items: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    """The first rows, by key, that break each of eight rules."""
    orders = raw.orders
    returned = F.lower("status") == "returned"
    samples = {
        "orders_shipped_before_created": orders.where(F.col("shipped_at") <= F.col("created_at")),
        "orders_delivered_before_shipped": orders.where(F.col("delivered_at") <= F.col("shipped_at")),
        "orders_returned_before_delivered": orders.where(F.col("returned_at") <= F.col("delivered_at")),
        "returned_orders_missing_timestamps": orders.where(
            returned & (F.col("delivered_at").isNull() | F.col("returned_at").isNull())
        ),
        "order_items_sale_price_lt_1": clean_items.where(F.col("sale_price") < 1),
        "events_null_user_id_sample": raw.events.where(F.col("user_id").isNull()),
        "inventory_missing_created_at_sample": raw.inventory.where(F.col("created_at").isNull()),
        "products_missing_name_or_brand_sample": raw.products.where(
            F.col("name").isNull() | F.col("brand").isNull()
        ),
    }
    return {
        name: df.orderBy("order_id" if "order_id" in df.columns and "id" not in df.columns else "id").limit(
            params.sample_rows
        )
        for name, df in samples.items()
    }


def bot_candidates(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Known users with more events in one day than the threshold."""
    return (
        events.where(F.col("user_id").isNotNull())
        .groupBy("user_id", F.col("created_at").cast("date").alias("day"))
        .agg(F.count("*").alias("event_count"))
        .where(F.col("event_count") > params.bot_threshold)
    )


def fact_totals(fact: DataFrame) -> DataFrame:
    """Rows and value of the fact table as one row."""
    return fact.agg(F.count("*").alias("rows"), total("GMV_All_Status").alias("gmv"))


def scope_reconciliation(
    orders: DataFrame, order_items: DataFrame, fact: DataFrame, params: Params = Params(), kept: DataFrame | None = None
) -> DataFrame:
    """How rows and value shrink from the raw items to the fact table.

    Items are counted per order before the orders are looked up. `kept` has the `fact_totals` where they are known already.
    """
    low = F.col("sale_price") < params.price_floor
    dated = (
        orders_for_analysis(orders, params)
        .where(F.col("created_at").isNotNull())
        .groupBy("order_id")
        .agg(F.count("*").alias("copies"))
    )
    per_order = order_items.groupBy("order_id").agg(
        F.count("*").alias("n"), F.count_if(low).alias("low"), total("sale_price").alias("value")
    )
    items = per_order.join(dated, "order_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.col("n") * F.col("copies")), F.lit(0)).alias("eligible"),
        total("value").alias("gmv"),
    )
    row = with_row(items, fact_totals(fact) if kept is None else kept, "kept").select(
        F.col("rows").alias("raw_order_item_rows"),
        F.col("low").alias("sub_1_price_rows_excluded"),
        (F.col("rows") - F.col("low")).alias("rows_after_price_filter"),
        F.col("eligible").alias("eligible_rows_after_partial_year_and_missing_date_exclusion"),
        F.col("kept.rows").alias("fact_transaction_rows"),
        round_even("gmv", 2).alias("raw_gmv"),
        round_even(F.col("kept.gmv"), 2).alias("processed_fact_gmv"),
        round_even(F.col("gmv") - F.col("kept.gmv"), 2).alias("gmv_removed_from_model_scope"),
    )
    return to_checks(row, "scope_reconciliation")


def raw_quality_checks(raw: RawTables) -> DataFrame:
    """Orphans, missing users, time spans and item-count differences in one row. A null key counts as orphan.

    Items are read once: the same counts per key give their orphans, their number per order, their time span and low prices.
    """
    rules = [
        ("item_users", "order_items", "user_id", "users", "id"),
        ("item_products", "order_items", "product_id", "products", "id"),
        ("item_orders", "order_items", "order_id", "orders", "order_id"),
        ("inventory_products", "inventory", "product_id", "products", "id"),
    ]
    keys = tagged_keys(
        {"order_items": raw.order_items, "inventory": raw.inventory},
        rules,
        count_nulls=True,
        row_of="order_items",
        first=F.min("row.created_at"),
        last=F.max("row.created_at"),
        low=F.count_if(F.col("row.sale_price") < 1),
    )
    number = F.lit(None).cast("int").alias("number")
    parents = [
        raw.users.select(F.lit("users").alias("parent"), F.col("id").alias("key"), number),
        raw.products.select(F.lit("products").alias("parent"), F.col("id").alias("key"), number),
        raw.orders.select(F.lit("orders").alias("parent"), F.col("order_id").alias("key"), F.col("num_of_item").alias("number")),
    ]
    # Copies of an order stay apart, as each has a number of items of its own; a missing number differs from any count.
    known = union(parents).where(F.col("key").isNotNull()).groupBy("parent", "key", "number").agg(F.count("*").alias("copies"))
    of_items = F.col("rule") == "item_orders"
    differs = F.coalesce(F.col("number") != F.col("n"), F.lit(True))
    met = keys.join(known, ["parent", "key"], "left")

    def lost(rule: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("rule") == rule) & F.col("copies").isNull(), F.col("n"))), F.lit(0))

    items = met.agg(
        lost("item_users").alias("orphan_item_user_ids"),
        lost("item_products").alias("orphan_item_product_ids"),
        lost("item_orders").alias("orphan_item_order_ids"),
        lost("inventory_products").alias("inventory_orphan_product_ids"),
        F.min(F.when(of_items, F.col("first"))).alias("order_time_min"),
        F.max(F.when(of_items, F.col("last"))).alias("order_time_max"),
        F.coalesce(F.sum(F.when(F.col("rule") == "item_products", F.col("low"))), F.lit(0)).alias("sale_price_lt_1_items"),
        F.coalesce(F.sum(F.when(of_items & differs, F.col("copies"))), F.lit(0)).alias("order_item_count_mismatch"),
    )
    events = raw.events.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("user_id").isNull()).alias("anonymous"),
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
    )
    costly = raw.products.agg(F.count_if(F.col("cost") > F.col("retail_price")))
    return with_row(items, events, "events").select(
        "orphan_item_user_ids",
        "orphan_item_product_ids",
        "orphan_item_order_ids",
        "inventory_orphan_product_ids",
        ratio0("events.anonymous", "events.n").alias("events_user_id_null_pct"),
        F.col("events.first").alias("event_time_min"),
        F.col("events.last").alias("event_time_max"),
        "order_time_min",
        "order_time_max",
        "sale_price_lt_1_items",
        costly.scalar().alias("product_cost_gt_retail"),
        "order_item_count_mismatch",
    )


def quality_report(
    raw: RawTables,
    fact: DataFrame,
    params: Params = Params(),
    processed: Mapping[str, DataFrame] | None = None,
    rfm: DataFrame | None = None,
) -> DataFrame:
    """All counts as (section, check, value).

    The profile of a table and the rules on its single rows come from one pass. `processed` has the tables of the star schema,
    whose rows are counted; `rfm` has the scored users. `fact` is the fact table that the scope is reconciled with; where it
    is one of `processed`, it is built once for its rows and its value.
    """
    kept = durable(fact_totals(fact))
    keys = foreign_key_checks(raw)
    key_cells = F.array(
        *[
            F.struct(
                F.lit("foreign_key_validation").alias("section"),
                F.concat("rule", F.lit(f".{c}")).alias("check"),
                F.col(c).cast("double").alias("value"),
            )
            for c in ("checked_rows", "orphan_rows", "orphan_pct")
        ]
    )
    mismatch = event_source_checks(raw.events, raw.users).agg(
        flag_total("is_mismatch").alias("traffic_source_mismatch_count")
    )
    items = clean_order_items(raw.order_items, raw.products, params)
    rules = {
        "orders": {"date_validation": order_date_rules(), "order_status_validation": order_status_rules()},
        "users": {"users_validation": user_rules(params)},
        "products": {"products_validation": product_rules()},
        "dcs": {"dcs_validation": center_rules()},
    }
    repeats = {"users": "users_validation"}
    sections = []
    for name, df in raw.items():
        row = per_key_counts(name, df, rules.get(name, {}), repeats.get(name))
        profile = F.array(
            *[
                F.struct(
                    F.lit("table_profile").alias("section"),
                    F.lit(f"{name}.{c}").alias("check"),
                    F.col(f"profile.{c}").cast("double").alias("value"),
                )
                for c in ("rows", "cols", "duplicate_pk", "null_cells")
            ]
        )
        sections.append(row.select(F.inline(F.concat(profile, "cells") if name in rules else profile)))
    totals = bot_candidates(raw.events, params).agg(F.count("*").alias("bot_candidate_rows"))
    sections += [
        to_checks(mismatch, "events_validation"),
        session_time_checks(raw.events),
        keys.select(F.inline(key_cells)),
        item_checks(items),
        scope_reconciliation(raw.orders, raw.order_items, fact, params, kept),
        to_checks(totals, "result_row_counts"),
    ]
    if rfm is not None:
        sections.append(to_checks(rfm.agg(F.count("*").alias("rfm_users")), "result_row_counts"))
    for name, df in (processed or {}).items():
        row = kept.select(F.col("rows").alias(name)) if df is fact else df.agg(F.count("*").alias(name))
        sections.append(to_checks(row, "processed_row_counts"))
    return union(sections)
