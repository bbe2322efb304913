"""Customer analyses: RFM, cohorts, lifetime value, demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.bands import AGE_BANDS, band, first_match
from tradewind.functions.durable import durable
from tradewind.functions.numeric import (
    flag_total, mean, mean_if, percent, ratio, ratio0, total, total_if,
)
from tradewind.functions.ranking import percentile_of, quintiles
from tradewind.functions.reshape import all_groups, to_metrics
from tradewind.functions.temporal import moment, whole_days
from tradewind.operators.clean import recognized
from tradewind.params import Params

# Least total score of each RFM segment.
RFM_SEGMENTS = ((13, "Champions"), (10, "Loyal"), (7, "At Risk"), (4, "About to Lose"))
RFM_LOWEST = "Lost"


def create_rfm(analysis_orders: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """Recency, frequency and monetary value per buying user, their quintile scores and the segment.

    Purchases and the return rate come from one aggregation over the items of each user.
    """
    order = analysis_orders.select(
        "order_id", F.col("created_at").alias("order_created_at"), F.col("status").alias("order_status")
    )
    bought = F.col("order_created_at").isNotNull() & recognized(F.col("order_status"), params)
    per_user = (
        items.join(order, "order_id")
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.max(F.when(bought, F.col("order_created_at"))).alias("last_order"),
            F.countDistinct(F.when(bought, F.col("order_id"))).alias("Frequency"),
            total_if(bought, "gross_profit").alias("Monetary"),
            F.count("id").alias("_items"),
            F.count_if(F.col("order_status") == "Returned").alias("_returned"),
        )
        .where(F.col("last_order").isNotNull())
        .select(
            "user_id",
            whole_days(moment(params.analysis_cutoff), "last_order").alias("Recency"),
            "Frequency",
            "Monetary",
            F.coalesce(percent("_returned", "_items", None), F.lit(0.0)).alias("return_rate_pct"),
        )
    )
    scored = quintiles(durable(per_user), "user_id", ["Recency", "Frequency", "Monetary"]).select(
        "*",
        (6 - F.col("Recency_quintile")).alias("R_score"),
        F.col("Frequency_quintile").alias("F_score"),
        F.col("Monetary_quintile").alias("M_score"),
    )
    score = F.col("R_score") + F.col("F_score") + F.col("M_score")
    segment = first_match([(score >= least, name) for least, name in RFM_SEGMENTS], RFM_LOWEST)
    return scored.select(
        "user_id", "Recency", "Frequency", "Monetary", "R_score", "F_score", "M_score",
        segment.alias("rfm_segment"), "return_rate_pct",
    )


def rfm_segmentation(dim_users: DataFrame) -> DataFrame:
    counts = dim_users.groupBy(F.col("rfm_segment").alias("segment")).agg(F.count("*").alias("count"))
    everyone = F.sum("count").over(all_groups())
    return counts.select("segment", "count", percent("count", everyone, 1).alias("percentage"))


def _cohort_grid(first_and_years: DataFrame) -> DataFrame:
    """(cohort_year, years of one user) to users per cohort and year, every year present for every cohort."""
    cells = (
        first_and_years.select("cohort_year", F.explode("years").alias("year"))
        .groupBy("cohort_year", "year")
        .agg(F.count("*").alias("users"))
    )
    # One row per cohort year from here on.
    cohorts = (
        cells.groupBy("cohort_year")
        .agg(F.map_from_entries(F.collect_list(F.struct("year", "users"))).alias("by_year"))
        .withColumn("_years", F.array_distinct(F.flatten(F.collect_set(F.map_keys("by_year")).over(all_groups()))))
    )
    return cohorts.select("cohort_year", "by_year", F.explode("_years").alias("year")).select(
        "cohort_year",
        "year",
        F.coalesce(F.try_element_at("by_year", F.col("year")), F.lit(0)).alias("users"),
        F.try_element_at("by_year", F.col("cohort_year")).alias("cohort_users"),
    )


def cohort_retention(fact: DataFrame) -> DataFrame:
    """Share of each first-purchase-year cohort that buys in each year, long form."""
    years = (
        fact.where((F.col("is_recognized_revenue") == 1) & F.col("user_id").isNotNull() & F.col("year").isNotNull())
        .groupBy("user_id")
        .agg(F.collect_set("year").alias("years"))
        .select(F.array_min("years").alias("cohort_year"), "years")
    )
    return _cohort_grid(years).select(
        "cohort_year", "year", "users", percent("users", "cohort_users", 2).alias("retention_pct")
    )


def cohort_matrix(retention: DataFrame, years: Sequence[int]) -> DataFrame:
    """Long retention to one column per year."""
    return (
        retention.groupBy("cohort_year")
        .pivot("year", list(years))
        .agg(F.first("retention_pct"))
        .na.fill(0.0, [str(y) for y in years])
    )


def signup_cohorts(fact: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Users of all statuses per signup year and purchase year.

    With `users` (id, created_at) the cohort is the signup year, otherwise the first purchase year.
    """
    years = (
        fact.where(F.col("user_id").isNotNull() & F.col("created_at").isNotNull())
        .groupBy("user_id")
        .agg(F.collect_set(F.year("created_at")).alias("years"))
    )
    if users is None:
        cohorts = years.withColumn("signup_year", F.array_min("years"))
    else:
        signup = users.select(F.col("id").alias("user_id"), F.year("created_at").alias("signup_year"))
        cohorts = years.join(signup.where(F.col("signup_year").isNotNull()), "user_id")
    counts = (
        cohorts.select("signup_year", F.explode("years").alias("purchase_year"))
        .groupBy("signup_year", "purchase_year")
        .agg(F.count("*").alias("users"))
    )
    same_year = F.when(F.col("purchase_year") == F.col("signup_year"), F.col("users"))
    base = F.max(same_year).over(Window.partitionBy("signup_year"))
    return counts.withColumn("base_users", base).withColumn("retention_pct", percent("users", "base_users", 2))


def ltv_cac(dim_users: DataFrame, params: Params = Params()) -> DataFrame:
    """Lifetime gross profit of one-time and of all buyers against the acquisition cost."""
    buyer, once = F.col("Frequency") > 0, F.col("Frequency") == 1
    row = dim_users.agg(
        F.count("*").alias("users"),
        F.count_if(buyer).alias("buyers"),
        F.count_if(once).alias("one_time"),
        F.coalesce(mean_if(once, "Monetary"), F.lit(0.0)).alias("ltv_one_time"),
        F.coalesce(mean_if(buyer, "Monetary"), F.lit(0.0)).alias("ltv_all"),
    )
    return to_metrics(
        row,
        [
            ("No Valid Purchase Users %", (1 - ratio("buyers", "users")) * 100, "%"),
            ("One-time Buyers % (valid customers)", ratio0("one_time", "buyers") * 100, "%"),
            ("Gross Profit LTV (1-time buyers)", F.col("ltv_one_time"), "$"),
            ("Gross Profit LTV (all valid customers)", F.col("ltv_all"), "$"),
            ("CAC Assumption", F.lit(params.acquisition_cost), "$"),
            ("LTV:CAC Ratio", ratio("ltv_one_time", F.lit(params.acquisition_cost)), ":1"),
            ("Healthy Benchmark", F.lit(3.0), ":1"),
        ],
    )


def customer_table(items: DataFrame, users: DataFrame) -> DataFrame:
    """All users with their purchases. `items` are flagged items with gross profit.

    Items are reduced to one row per user and order first, so neither distinct count needs its own copy of the rows.
    """
    valid, counted = F.col("is_valid_purchase"), F.col("is_recognized")
    per_order = (
        items.where(F.col("user_id").isNotNull() & valid)
        .groupBy("user_id", "order_id")
        .agg(
            F.count("id").alias("items"),
            F.min("created_at").alias("first"),
            F.max("created_at").alias("last"),
            F.max(F.when(counted & F.col("order_id").isNotNull(), 1)).alias("recognized"),
            total_if(counted, "sale_price").alias("revenue"),
            total_if(counted, "gross_profit").alias("profit"),
            F.max(F.when(counted, F.col("created_at"))).alias("last_recognized"),
        )
    )
    per_user = per_order.groupBy("user_id").agg(
        F.count("order_id").alias("valid_orders"),
        F.sum("items").alias("valid_items"),
        F.min("first").alias("first_order"),
        F.max("last").alias("last_order"),
        F.count("recognized").alias("recognized_orders"),
        total("revenue").alias("revenue"),
        total("profit").alias("profit"),
        F.max("last_recognized").alias("last_recognized_order"),
    )
    latest = items.agg(F.max("created_at").alias("t")).scalar()
    zero = {c: 0 for c in ("valid_orders", "valid_items", "recognized_orders")} | {"revenue": 0.0, "profit": 0.0}
    return (
        users.withColumnRenamed("id", "user_id")
        .join(per_user, "user_id", "left")
        .fillna(zero)
        .withColumn("recency_days", whole_days(latest, "last_order"))
        .withColumn("buyer", F.col("valid_orders") > 0)
        .withColumn("recognized_buyer", F.col("recognized_orders") > 0)
        .withColumn("repeat_buyer", F.col("valid_orders") >= 2)
        .withColumn("age_group", band("age", AGE_BANDS, include_lowest=True))
    )


def customers_by_source(customers: DataFrame) -> DataFrame:
    """By signup source; a missing source is a group of its own."""
    return (
        customers.groupBy("traffic_source")
        .agg(
            F.count("user_id").alias("users"),
            flag_total("buyer").alias("buyers"),
            total("revenue").alias("revenue"),
            total("profit").alias("profit"),
        )
        .withColumn("buyer_rate", ratio("buyers", "users"))
        .withColumn("ltv_per_registered_user", ratio("revenue", "users"))
        .withColumn("arppu", ratio("revenue", "buyers"))
    )


def customers_by_demographics(customers: DataFrame) -> DataFrame:
    """By gender and age group; age groups nobody is in appear with zeros."""
    cells = (
        customers.where(F.col("gender").isNotNull())
        .groupBy("gender", "age_group")
        .agg(
            F.count("user_id").alias("users"),
            flag_total("buyer").alias("buyers"),
            total("revenue").alias("revenue"),
        )
    )
    labels = F.array(*[F.lit(x) for x in AGE_BANDS[1]])
    # A few rows per gender from here on.
    measured = F.struct("users", "buyers", "revenue")
    grid = cells.groupBy("gender").agg(
        F.map_from_entries(
            F.array_compact(F.collect_list(F.when(F.col("age_group").isNotNull(), F.struct("age_group", measured.alias("m")))))
        ).alias("by_age")
    )
    cell = F.try_element_at("by_age", F.col("age_group"))
    return (
        grid.select("gender", "by_age", F.explode(labels).alias("age_group"))
        .select(
            "gender",
            "age_group",
            F.coalesce(cell["users"], F.lit(0)).alias("users"),
            F.coalesce(cell["buyers"], F.lit(0)).alias("buyers"),
            F.coalesce(cell["revenue"], F.lit(0.0)).alias("revenue"),
        )
        .withColumn("buyer_rate", ratio("buyers", "users"))
    )


def _value_segment(high_value: Column) -> Column:
    recency, orders, revenue = F.col("recency_days"), F.col("valid_orders"), F.col("revenue")
    repeat = orders >= 2
    # Segment rules and names.
    return first_match(
        [
            (repeat & (recency > 180), "Repeat at risk"),
            (repeat & (recency <= 90) & (revenue >= high_value), "Champions"),
            (repeat & (recency <= 180), "Loyal/active repeat"),
            ((orders == 1) & (recency <= 90), "New one-time"),
        ],
        "One-time low value",
    )


def customer_value_segments(customers: DataFrame) -> DataFrame:
    """Buyers by recency, orders and revenue, where high revenue is the top quarter of buyers."""
    buyers = durable(
        customers.where("buyer").select("user_id", "recency_days", "valid_orders", "revenue")
    )
    high_value = percentile_of(buyers, "revenue", {"q75": 0.75}).scalar()
    return (
        buyers.withColumn("segment", _value_segment(high_value))
        .groupBy("segment")
        .agg(
            F.count("user_id").alias("customers"),
            total("revenue").alias("revenue"),
            mean("valid_orders").alias("avg_orders"),
            mean("recency_days").alias("avg_recency"),
        )
    )


def customer_summary(customers: DataFrame) -> DataFrame:
    """Penetration and repeat rates in one row. Recency in days has few distinct values, so the median is bounded."""
    buyer = F.col("buyer")
    row = customers.agg(
        F.countDistinct("user_id").alias("registered_users"),
        F.count_if(buyer).alias("buyers"),
        F.count_if(F.col("recognized_buyer")).alias("recognized_buyers"),
        F.count_if(F.col("repeat_buyer")).alias("repeat_buyers"),
        F.count_if(buyer & ~F.col("repeat_buyer")).alias("one_time"),
        mean_if(buyer, "valid_orders").alias("avg_valid_orders_per_buyer"),
        F.median(F.when(buyer, F.col("recency_days"))).alias("median_recency_days"),
    )
    return row.select(
        "registered_users",
        "buyers",
        "recognized_buyers",
        ratio0("buyers", "registered_users").alias("buyer_penetration"),
        "repeat_buyers",
        ratio0("repeat_buyers", "buyers").alias("repeat_rate"),
        ratio0("one_time", "buyers").alias("one_time_rate"),
        "avg_valid_orders_per_buyer",
        "median_recency_days",
    )
