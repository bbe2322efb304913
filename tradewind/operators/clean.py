"""Cleaning and derived columns of the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.functions.temporal import elapsed_days, moment, whole_days, year_month
from tradewind.params import Params


def recognized(status: Column, params: Params) -> Column:
    return F.coalesce(status.isin(*params.recognized_statuses), F.lit(False))


def clean_users(users: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per id; ages clipped and filled with the median age, missing gender and city named Unknown.

    Of several rows with one id the earliest is kept, a dated one before an undated one (then the smallest by the
    other columns). It is a minimum, so copies of an id are reduced before the shuffle. Ages are few distinct whole numbers, which
    bounds what the median has to hold.
    """
    others = [c for c in users.columns if c not in ("id", "created_at")]
    median_age = F.floor(users.agg(F.median("age").alias("age")).scalar()).cast("int")
    fallback = F.coalesce(median_age, F.lit(params.default_age))
    # greatest and least skip nulls, so a missing age is handled apart.
    clipped = F.greatest(F.least("age", F.lit(params.max_age)), F.lit(params.min_age))
    age = F.when(F.col("age").isNull(), fallback).otherwise(clipped)
    return (
        users.groupBy("id")
        .agg(F.min(F.struct(F.col("created_at").isNull().alias("_undated"), "created_at", *others)).alias("row"))
        .select("id", "row.*")
        .withColumns(
            {
                "age": age.cast("bigint"),
                "gender": F.coalesce("gender", F.lit("Unknown")),
                "city": F.coalesce("city", F.lit("Unknown")),
            }
        )
        .select(*users.columns)
    )


def clean_orders(orders: DataFrame, params: Params = Params()) -> DataFrame:
    """Adds `is_partial_year`; false for a missing creation date."""
    flag = F.coalesce(F.year("created_at") == params.partial_year, F.lit(False))
    return orders.withColumn("is_partial_year", flag)


def orders_for_analysis(orders: DataFrame, params: Params = Params()) -> DataFrame:
    """Orders outside the partial year; those without a date stay."""
    return clean_orders(orders, params).where(~F.col("is_partial_year"))


def clean_order_items(order_items: DataFrame, products: DataFrame, params: Params = Params()) -> DataFrame:
    """Items with product cost and category, gross profit and the low-price flag."""
    product = products.select(F.col("id").alias("product_id"), "cost", "category")
    return order_items.join(product, "product_id", "left").select(
        *order_items.columns,
        "cost",
        "category",
        (F.col("sale_price") - F.col("cost")).alias("gross_profit"),
        F.coalesce(F.col("sale_price") < params.price_floor, F.lit(False)).alias("exclude_from_revenue"),
    )


def revenue_items(clean_items: DataFrame) -> DataFrame:
    return clean_items.where(~F.col("exclude_from_revenue"))


def clean_inventory(inventory: DataFrame, params: Params = Params()) -> DataFrame:
    """Adds sold flag, days held up to the cutoff (also for sold units) and the cost of holding."""
    days = F.greatest(whole_days(moment(params.inventory_cutoff), "created_at"), F.lit(0))
    return (
        inventory.withColumn("is_sold", F.col("sold_at").isNotNull().cast("int"))
        .withColumn("holding_days", F.when(F.col("created_at").isNotNull(), days))
        .withColumn("sunk_cost_risk", F.col("cost") * (1 - F.col("is_sold")))
        .withColumn("holding_cost_annual", F.col("sunk_cost_risk") * params.carrying_rate)
        .withColumn("holding_cost_daily", F.col("holding_cost_annual") / 365)
        .withColumn("holding_cost_estimate", F.col("holding_cost_daily") * F.col("holding_days"))
    )


def flag_items(order_items: DataFrame, params: Params = Params()) -> DataFrame:
    """Item-level month, status flags and fulfillment times; the item's own status counts here."""
    status = F.col("status")
    return order_items.withColumns(
        {
            "month": year_month("created_at"),
            "year": F.year("created_at"),
            "is_recognized": recognized(status, params),
            "is_valid_purchase": F.coalesce(status.isin(*params.valid_purchase_statuses), F.lit(False)),
            "is_cancelled": F.coalesce(status == "Cancelled", F.lit(False)),
            "is_returned": F.coalesce(status == "Returned", F.lit(False)),
            "ship_days": elapsed_days("shipped_at", "created_at"),
            "delivery_days": elapsed_days("delivered_at", "shipped_at"),
            "fulfillment_days": elapsed_days("delivered_at", "created_at"),
        }
    )


def product_columns(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("product_id"),
        F.col("cost").alias("product_cost"),
        "category",
        F.col("name").alias("product_name"),
        "brand",
        "retail_price",
        "department",
        F.col("distribution_center_id").alias("dc_id"),
    )


def add_margin(items: DataFrame) -> DataFrame:
    profit = F.col("sale_price") - F.col("product_cost")
    return items.withColumns({"gross_profit": profit, "margin": F.try_divide(profit, F.col("sale_price"))})


def with_products(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Item rows with product columns, profit and margin."""
    return add_margin(order_items.join(product_columns(products), "product_id", "left"))


def enrich_transactions(
    order_items: DataFrame, products: DataFrame, users: DataFrame, params: Params = Params()
) -> DataFrame:
    """Every item with its product, its user and the flags. Analyses that need no user column skip that join.

    An item may be shuffled for each of the two joins, so it goes to the users first, whose columns are the narrower
    ones, and what can be told from a row alone is added after both.
    """
    user = users.select(
        F.col("id").alias("user_id"),
        "age",
        "gender",
        "country",
        "city",
        F.col("traffic_source").alias("user_traffic_source"),
    )
    product = product_columns(products)
    joined = order_items.join(user, "user_id", "left").join(product, "product_id", "left")
    enriched = flag_items(add_margin(joined), params)
    # The key of the last join stands first; user columns come last.
    first = ["user_id", "product_id"]
    last = [c for c in user.columns if c != "user_id"]
    between = [c for c in enriched.columns if c not in first and c not in last]
    return enriched.select(*first, *between, *last)
