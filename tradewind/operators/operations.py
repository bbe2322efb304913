"""Inventory, distribution centers and fulfillment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.bands import (
    DELIVERY_BINS, FULFILLMENT_BUCKETS, NOT_DELIVERED, band, first_match, sale_price_band,
)
from tradewind.functions.durable import durable
from tradewind.functions.numeric import (
    flag_total, mean, mean_if, percent, ratio, ratio0, total, total_if, total_over,
)
from tradewind.functions.ranking import percentiles
from tradewind.functions.reshape import all_groups, to_metrics
from tradewind.functions.temporal import DAY_SECONDS, elapsed_days, elapsed_seconds
from tradewind.operators.revenue import merge_totals, money_totals, totals_by_product
from tradewind.params import Params

def inventory_turnover(fact_inventory: DataFrame) -> DataFrame:
    unsold = F.col("is_sold") == 0
    row = fact_inventory.agg(
        F.count("*").alias("units"),
        flag_total("is_sold").alias("sold"),
        mean_if(unsold, "holding_days").alias("avg_days"),
        F.max(F.when(unsold, F.col("holding_days"))).alias("max_days"),
    )
    return to_metrics(
        row,
        [
            ("Total Inventory Units", F.col("units"), "units"),
            ("Sold Units", F.col("sold"), "units"),
            ("Unsold Units", F.col("units") - F.col("sold"), "units"),
            ("Sell-Through Rate", ratio("sold", "units") * 100, "%"),
            ("Avg Holding Days (Unsold)", F.col("avg_days"), "days"),
            ("Max Holding Days", F.col("max_days"), "days"),
        ],
    )


def holding_cost(fact_inventory: DataFrame) -> DataFrame:
    row = fact_inventory.where(F.col("is_sold") == 0).agg(
        F.count("*").alias("units"),
        total("sunk_cost_risk").alias("frozen"),
        total("holding_cost_estimate").alias("holding"),
        mean("holding_days").alias("avg_days"),
    )
    return to_metrics(
        row,
        [
            ("Total Unsold Units", F.col("units"), "units"),
            ("Total Frozen Capital", F.col("frozen"), "$"),
            ("Est. Holding Cost To Cutoff", F.col("holding"), "$"),
            ("Combined Financial Impact", F.col("frozen") + F.col("holding"), "$"),
            ("Avg Cost per Unit (Frozen)", ratio("frozen", "units"), "$"),
            ("Avg Holding Days", F.col("avg_days"), "days"),
        ],
    )


def abc_classes(category_performance: DataFrame) -> DataFrame:
    """Categories by cumulative revenue share: A up to 80 %, B up to 95 %, then C. Ties go by name."""
    order = Window.orderBy(F.col("category_revenue").desc(), "product_category")  # one row per category
    ranked = category_performance.select(
        F.col("category").alias("product_category"),
        F.col("revenue").alias("category_revenue"),
        F.col("gross_profit").alias("category_gross_profit"),
        "gross_margin_pct",
        "status_leakage_value",
        F.col("quadrant").alias("category_quadrant"),
    )
    whole = total_over("category_revenue", all_groups())
    upto = total_over("category_revenue", order.rowsBetween(Window.unboundedPreceding, 0))
    cumulative = F.col("category_cumulative_revenue_share_pct")
    return (
        ranked.withColumn("category_revenue_share_pct", ratio0("category_revenue", whole) * 100)
        .withColumn("category_cumulative_revenue_share_pct", ratio0(upto, whole) * 100)
        .withColumn("abc_class", first_match([(cumulative <= 80, "A"), (cumulative <= 95, "B")], "C"))
    )


def inventory_abc_aging(
    fact_inventory: DataFrame, dim_dcs: DataFrame, category_performance: DataFrame
) -> DataFrame:
    """Stock age and frozen capital per category, department and center, with an action by ordered rules."""
    days, unsold = F.col("holding_days"), F.col("is_sold") == 0
    stock = (
        fact_inventory.dropna(subset=["product_category", "department", "center_id"])
        .groupBy("product_category", "department", "center_id")
        .agg(
            F.count("inventory_id").alias("total_units"),
            flag_total("is_sold").alias("sold_units"),
            F.count_if(F.col("sunk_cost_risk") > 0).alias("unsold_units"),
            total("sunk_cost_risk").alias("frozen_capital"),
            total("holding_cost_estimate").alias("holding_cost_to_cutoff"),
            mean_if(unsold, "holding_days").alias("avg_holding_days_unsold"),
            F.count_if(unsold & (days >= 180)).alias("aged_180_units"),
            F.count_if(unsold & (days >= 365)).alias("aged_365_units"),
            total_if(days >= 180, "sunk_cost_risk").alias("aged_180_cost"),
            total_if(days >= 365, "sunk_cost_risk").alias("aged_365_cost"),
        )
        .withColumn("sell_through_pct", percent("sold_units", "total_units"))
    )
    centers = dim_dcs.select(F.col("dc_id").alias("center_id"), F.col("name").alias("dc_name"))
    joined = stock.join(centers, "center_id", "left").join(
        abc_classes(category_performance), "product_category", "left"
    )
    median_aged = F.median("aged_180_cost").over(all_groups())
    through, abc = F.col("sell_through_pct"), F.col("abc_class")
    # Thresholds and actions.
    action = first_match(
        [
            ((F.col("aged_365_cost") > median_aged) & (through < 35), "Clearance / stop-buy"),
            ((abc == "A") & (through < 36), "Rebalance allocation by DC"),
            (abc.isin("B", "C") & (F.col("aged_180_cost") > median_aged), "Markdown with margin guardrail"),
            ((abc == "A") & (through >= 42), "Protect availability / replenish carefully"),
        ],
        "Monitor",
    )
    return joined.withColumn("inventory_action", action)


# Result names of the fulfillment times.
FULFILLMENT_METRICS = {
    "ship": ("Avg Days to Ship", "Median Days to Ship"),
    "deliver": ("Avg Days to Deliver after Ship", "Median Days to Deliver after Ship"),
    "total": ("Total Avg Delivery Days", "Median Delivery Days"),
}


def fulfillment(orders: DataFrame) -> DataFrame:
    """Mean and exact median of the time to ship, to deliver after shipping, and in all.

    Times are counted per distinct number of seconds first; means and medians are taken from the counts.
    """
    times = {
        "ship": elapsed_seconds("shipped_at", "created_at"),
        "deliver": elapsed_seconds("delivered_at", "shipped_at"),
        "total": elapsed_seconds("delivered_at", "created_at"),
    }
    cells = [F.struct(F.lit(k).alias("series"), v.alias("value")) for k, v in times.items()]
    counts = durable(
        orders.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("series", "value")
        .agg(F.count("*").alias("weight"))
    )
    means = counts.groupBy("series").agg(
        ratio(total(F.col("value") * F.col("weight")), F.sum("weight")).alias("mean")
    )
    medians = percentiles(counts, {"median": 0.5})
    by_series = means.join(F.broadcast(medians), "series")  # three rows each
    row = by_series.agg(F.map_from_entries(F.collect_list(F.struct("series", F.struct("mean", "median")))).alias("at"))
    metrics = []
    for series, names in FULFILLMENT_METRICS.items():
        cell = F.try_element_at("at", F.lit(series))
        metrics += [
            (names[0], cell["mean"] / DAY_SECONDS, "days"),
            (names[1], cell["median"] / DAY_SECONDS, "days"),
        ]
    return to_metrics(row, metrics)


def no_fulfillment(fact: DataFrame) -> DataFrame:
    """The row that stands for the fulfillment times where the raw orders are not at hand."""
    # Metric and note.
    row = F.struct(F.lit("Fulfillment Data").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("Raw orders unavailable").alias("unit"))
    return fact.sparkSession.range(1).select(F.inline(F.array(row)))


def root_cause_proxy(
    fact: DataFrame, dim_products: DataFrame, orders: DataFrame | None, params: Params = Params()
) -> DataFrame:
    """Return and cancel rates per department, category, brand, price band and fulfillment time, with a hypothesis.

    Groups below `root_cause_min_items` items are left out. Rows are totalled per product, band and bucket
    before they meet the product table.
    """
    banded = fact.withColumn("price_band", sale_price_band("sale_price"))
    if orders is None:
        timed = banded.withColumn("fulfillment_bucket", F.lit("unknown")).withColumn(
            "_seconds", F.lit(None).cast("double")
        )
    else:
        days = elapsed_days("delivered_at", "created_at")
        bucket = F.coalesce(band(days, FULFILLMENT_BUCKETS), F.lit(NOT_DELIVERED))
        times = orders.select(
            "order_id", elapsed_seconds("delivered_at", "created_at").alias("_seconds"),
            bucket.alias("fulfillment_bucket"),
        )
        timed = banded.join(times, "order_id", "left").where(F.col("fulfillment_bucket").isNotNull())
    sums = money_totals()
    keys = ["price_band", "fulfillment_bucket"]
    by_product = totals_by_product(
        timed,
        keys,
        cancelled_items=F.count_if(F.col("status") == "Cancelled"),
        processing_items=F.count_if(F.col("status") == "Processing"),
        priced=F.count("sale_price"),
        timed=F.count("_seconds"),
        seconds=total("_seconds"),
    )
    product = dim_products.select("product_id", "category", "brand", "department").distinct()
    counts = {"recognized_items", "total_items", "returned_items", "cancelled_items", "processing_items", "priced", "timed"}
    grouped = (
        by_product.join(product, "product_id", "left")
        .dropna(subset=["department", "category", "brand"])
        .groupBy("department", "category", "brand", *keys)
        .agg(
            *merge_totals(
                [*sums, "cancelled_items", "processing_items", "priced", "timed", "seconds"], counts
            )
        )
        .where(F.col("total_items") >= params.root_cause_min_items)
    )
    rated = (
        grouped.withColumn("avg_sale_price", ratio("gmv_all_status", "priced"))
        .withColumn("avg_fulfillment_days", ratio("seconds", "timed") / DAY_SECONDS)
        .withColumn("return_rate_pct", percent("returned_items", "total_items"))
        .withColumn("cancel_rate_pct", percent("cancelled_items", "total_items"))
        .withColumn("processing_rate_pct", percent("processing_items", "total_items"))
        .withColumn("status_leakage_value", F.col("gmv_all_status") - F.col("revenue"))
        .withColumn("status_leakage_pct", percent("status_leakage_value", "gmv_all_status"))
        .withColumn("gross_margin_pct", percent("gross_profit", "revenue"))
        .drop("priced", "timed", "seconds")
    )
    returned = F.col("return_rate_pct")
    # Thresholds, hypotheses and actions.
    rules = [
        (
            (returned >= 12) & F.col("price_band").isin("$100-200", "$200+"),
            "High-price fit/expectation mismatch",
            "Add premium PDP proof, fit notes, review snippets",
        ),
        (
            returned >= 12,
            "Size/fit/content confidence risk",
            "Improve size guide, product images, material details",
        ),
        (
            F.col("cancel_rate_pct") >= 17,
            "Checkout/payment/inventory cancellation friction",
            "Audit stock sync, payment failure, checkout messaging",
        ),
        (
            F.col("processing_rate_pct") >= 22,
            "Backlog or status-update SLA risk",
            "Create processing aging SLA and exception queue",
        ),
        (
            F.col("fulfillment_bucket").isin("5-7 days", "8+ days") & (returned >= 10),
            "Fulfillment-delay experience risk",
            "Surface ETA earlier and monitor late-delivery cohorts",
        ),
    ]
    return rated.withColumn(
        "proxy_hypothesis", first_match([(test, name) for test, name, _ in rules], "No strong proxy signal")
    ).withColumn(
        "recommended_action",
        first_match([(test, action) for test, _, action in rules], "Monitor with category dashboard"),
    )


def stock_cutoff(order_items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Latest of the last order, the last arrival and the last sale, as a one-row frame."""
    ordered = order_items.agg(F.max("created_at").alias("t"))
    stocked = inventory.agg(F.greatest(F.max("created_at"), F.max("sold_at")).alias("t"))
    return ordered.unionByName(stocked).agg(F.max("t").alias("cutoff"))


def age_inventory(inventory: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Sold units by time held, unsold ones by time to the cutoff, in fractional days."""
    sold = F.col("sold_at").isNotNull()
    seconds = F.when(sold, elapsed_seconds("sold_at", "created_at")).otherwise(elapsed_seconds(cutoff.scalar(), "created_at"))
    return (
        inventory.withColumn("is_sold", sold)
        .withColumn("age_seconds", seconds)
        .withColumn("age_days", F.col("age_seconds") / DAY_SECONDS)
        .withColumn("unsold_cost", F.when(sold, 0.0).otherwise(F.col("cost")))
        .withColumn("aged_180", F.coalesce(~sold & (F.col("age_days") > 180), F.lit(False)))
        .withColumn("aged_365", F.coalesce(~sold & (F.col("age_days") > 365), F.lit(False)))
        .withColumnRenamed("product_distribution_center_id", "dc_id")
    )


def _mean_age(condition: Column | None = None) -> Column:
    seconds = F.col("age_seconds") if condition is None else F.when(condition, F.col("age_seconds"))
    return mean(seconds) / DAY_SECONDS


def _stock_sums() -> list[Column]:
    return [
        F.count("id").alias("inventory_units"),
        flag_total("is_sold").alias("sold_units"),
        F.count_if(~F.col("is_sold")).alias("unsold_units"),
        total("unsold_cost").alias("unsold_cost"),
        _mean_age().alias("avg_age_days"),
        flag_total("aged_180").alias("aged_180_units"),
    ]


def inventory_by_center(aged: DataFrame, dcs: DataFrame) -> DataFrame:
    names = dcs.select(F.col("id").alias("dc_id"), F.col("name").alias("dc_name"))
    return (
        aged.where(F.col("dc_id").isNotNull())
        .groupBy("dc_id")
        .agg(*_stock_sums(), flag_total("aged_365").alias("aged_365_units"))
        .join(names, "dc_id", "left")
        .withColumn("sell_through", ratio("sold_units", "inventory_units"))
        .withColumn("aged_180_rate", ratio("aged_180_units", "unsold_units"))
    )


def inventory_by_category(aged: DataFrame) -> DataFrame:
    return (
        aged.where(F.col("product_category").isNotNull())
        .groupBy("product_category")
        .agg(*_stock_sums())
        .withColumn("sell_through", ratio("sold_units", "inventory_units"))
        .withColumn("aged_180_rate", ratio("aged_180_units", "unsold_units"))
    )


def center_stock_vs_demand(by_center: DataFrame, items: DataFrame) -> DataFrame:
    """Each center's share of unsold cost against its share of recognized revenue."""
    demand = (
        items.where(F.col("is_recognized") & F.col("dc_id").isNotNull())
        .groupBy("dc_id")
        .agg(
            total("sale_price").alias("revenue"),
            total("gross_profit").alias("profit"),
            F.count("id").alias("sold_order_items"),
        )
    )
    return (
        by_center.join(demand, "dc_id", "left")
        .fillna({"revenue": 0.0, "profit": 0.0, "sold_order_items": 0})
        .withColumn("stock_share", ratio("unsold_cost", total_over("unsold_cost", all_groups())))
        .withColumn("revenue_share", ratio("revenue", total_over("revenue", all_groups())))
        .withColumn("stock_minus_demand_share", F.col("stock_share") - F.col("revenue_share"))
    )


def _delivered(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("Complete", "Returned")).withColumn(
        "_seconds", elapsed_seconds("delivered_at", "created_at")
    )


def returns_by_delivery_time(items: DataFrame) -> DataFrame:
    return (
        _delivered(items)
        .withColumn("fulfillment_bin", band("fulfillment_days", DELIVERY_BINS))
        .where(F.col("fulfillment_bin").isNotNull())
        .groupBy("fulfillment_bin")
        .agg(
            F.count("id").alias("items"),
            flag_total("is_returned").alias("returned"),
            (mean("_seconds") / DAY_SECONDS).alias("avg_fulfillment_days"),
        )
        .withColumn("return_rate", ratio("returned", "items"))
    )


def fulfillment_summary(items: DataFrame) -> DataFrame:
    """Mean times and the items still open, in one row of flagged items."""
    processing, shipped = F.col("status") == "Processing", F.col("status") == "Shipped"
    finished = F.col("status").isin("Complete", "Returned")

    def mean_days(later: str, earlier: str, condition: Column | None = None) -> Column:
        seconds = elapsed_seconds(later, earlier)
        return mean(seconds if condition is None else F.when(condition, seconds)) / DAY_SECONDS

    return items.agg(
        mean_days("shipped_at", "created_at").alias("avg_ship_days"),
        mean_days("delivered_at", "shipped_at").alias("avg_delivery_days"),
        mean_days("delivered_at", "created_at", finished).alias("avg_fulfillment_days"),
        F.count_if(processing).alias("processing_items"),
        F.count_if(shipped).alias("shipped_not_complete_items"),
        total_if(processing, "sale_price").alias("processing_revenue"),
        total_if(shipped, "sale_price").alias("shipped_revenue"),
    )


def inventory_summary(aged: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Eleven figures in one row."""
    sold = F.col("is_sold")
    row = aged.agg(
        F.count("*").alias("inventory_units"),
        flag_total("is_sold").alias("sold_units"),
        F.count_if(~sold).alias("unsold_units"),
        total("unsold_cost").alias("unsold_cost"),
        flag_total("aged_180").alias("aged_180_units"),
        total_if(F.col("aged_180"), "cost").alias("aged_180_cost"),
        flag_total("aged_365").alias("aged_365_units"),
        _mean_age(~sold).alias("avg_unsold_age_days"),
        _mean_age(sold).alias("avg_sold_holding_days"),
    )
    return row.select(
        cutoff.scalar().alias("cutoff"),
        "inventory_units",
        "sold_units",
        "unsold_units",
        ratio0("sold_units", "inventory_units").alias("sell_through"),
        "unsold_cost",
        "aged_180_units",
        "aged_180_cost",
        "aged_365_units",
        "avg_unsold_age_days",
        "avg_sold_holding_days",
    )
