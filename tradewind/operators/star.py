"""The star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradewind.functions.temporal import date_key, year_month
from tradewind.operators.clean import recognized
from tradewind.params import NO_PURCHASE_SEGMENT, Params


def build_fact_transactions(
    items: DataFrame, analysis_orders: DataFrame, params: Params = Params()
) -> DataFrame:
    """Price-filtered items of dated orders, with the order's status and date and its money split by status."""
    order = analysis_orders.where(F.col("created_at").isNotNull()).select(
        "order_id", F.col("created_at").alias("order_created_at"), F.col("status").alias("order_status")
    )
    status, price = F.col("order_status"), F.col("sale_price")
    is_recognized = recognized(status, params)

    def only(condition, value):
        return F.when(condition, value).otherwise(F.lit(0.0))

    return items.join(order, "order_id").select(
        F.col("id").alias("order_item_id"),
        "order_id",
        "user_id",
        "product_id",
        date_key("order_created_at").alias("date_key"),
        "sale_price",
        "cost",
        "gross_profit",
        status.alias("status"),
        F.coalesce(status == "Returned", F.lit(False)).cast("int").alias("is_returned"),
        (~F.col("exclude_from_revenue")).cast("int").alias("is_gmv"),
        is_recognized.cast("int").alias("is_recognized_revenue"),
        price.alias("GMV_All_Status"),
        only(is_recognized, price).alias("Recognized_Revenue"),
        only(is_recognized, F.col("gross_profit")).alias("Recognized_Gross_Profit"),
        only(status == "Cancelled", price).alias("Revenue_Lost_Cancelled"),
        only(status == "Returned", price).alias("Return_Value"),
        only(status == "Processing", price).alias("Processing_Backlog_Value"),
        F.col("order_created_at").alias("created_at"),
    )


def ensure_revenue_columns(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Adds whichever derived columns a written fact lacks, and its year."""
    status, price = F.col("status"), F.col("sale_price")
    if "is_recognized_revenue" not in fact.columns:
        fact = fact.withColumn("is_recognized_revenue", recognized(status, params).cast("int"))
    counted = F.col("is_recognized_revenue") == 1
    derived = {
        "is_gmv": (price >= params.price_floor).cast("int"),
        "GMV_All_Status": price,
        "Recognized_Revenue": F.when(counted, price).otherwise(0.0),
        "Recognized_Gross_Profit": F.when(counted, F.col("gross_profit")).otherwise(0.0),
        "Revenue_Lost_Cancelled": F.when(status == "Cancelled", price).otherwise(0.0),
        "Return_Value": F.when(status == "Returned", price).otherwise(0.0),
        "Processing_Backlog_Value": F.when(status == "Processing", price).otherwise(0.0),
    }
    # A written fact is partitioned by its year, which stays as it is so that year filters skip files.
    derived["year"] = F.floor(F.col("date_key").cast("int") / 10000).cast("int")
    return fact.withColumns({name: value for name, value in derived.items() if name not in fact.columns})


def build_fact_inventory(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        F.col("id").alias("inventory_id"),
        "product_id",
        "product_name",
        "product_brand",
        "product_category",
        F.col("product_department").alias("department"),
        F.col("product_distribution_center_id").alias("center_id"),
        "cost",
        "is_sold",
        "holding_days",
        "sunk_cost_risk",
        "holding_cost_estimate",
    )


def build_agg_funnel_monthly(events: DataFrame) -> DataFrame:
    """Events and distinct known users per month, event type and source."""
    keys = ["year_month", "event_type", "traffic_source"]
    return (
        events.select(year_month("created_at").alias("year_month"), "event_type", "traffic_source", "id", "user_id")
        .dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count("id").alias("event_count"), F.countDistinct("user_id").alias("unique_users"))
    )


def build_dim_users(users: DataFrame, rfm: DataFrame) -> DataFrame:
    scores = rfm.select("user_id", "Recency", "Frequency", "Monetary", "return_rate_pct", "rfm_segment")
    return users.withColumnRenamed("id", "user_id").join(scores, "user_id", "left").select(
        "user_id",
        "first_name",
        "last_name",
        "age",
        "gender",
        "state",
        "street_address",
        "postal_code",
        "city",
        "country",
        "latitude",
        "longitude",
        "traffic_source",
        "Recency",
        F.coalesce("Frequency", F.lit(0)).cast("bigint").alias("Frequency"),
        F.coalesce("Monetary", F.lit(0.0)).alias("Monetary"),
        F.coalesce("return_rate_pct", F.lit(0.0)).alias("return_rate_pct"),
        F.coalesce("rfm_segment", F.lit(NO_PURCHASE_SEGMENT)).alias("rfm_segment"),
    )


def build_dim_products(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("product_id"), "category", "brand", "retail_price", "cost", "department"
    )


def build_dim_dcs(dcs: DataFrame) -> DataFrame:
    return dcs.select(F.col("id").alias("dc_id"), "name", "latitude", "longitude")


def build_dim_date(bounds: DataFrame) -> DataFrame:
    """Calendar between the dates of the one-row frame `bounds` (start, end)."""
    days = F.sequence(F.col("start").cast("date"), F.col("end").cast("date"), F.expr("interval 1 day"))
    return bounds.select(F.explode(days).alias("date")).select(
        date_key("date").alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.quarter("date").alias("quarter"),
        F.weekday("date").alias("day_of_week"),
        F.weekofyear("date").alias("week_of_year"),
        year_month("date").alias("year_month"),
    )


def spine_bounds(any_frame: DataFrame, params: Params = Params()) -> DataFrame:
    """The configured calendar limits as a one-row frame."""
    return any_frame.sparkSession.range(1).select(
        F.lit(params.spine_start).alias("start"), F.lit(params.spine_end).alias("end")
    )
