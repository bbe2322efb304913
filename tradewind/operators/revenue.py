"""Revenue, status leakage, categories, price bands and returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.bands import RECOGNIZED_PRICE_BANDS, band, first_match, sale_price_band
from tradewind.functions.numeric import (
    flag_total, percent, ratio, ratio0, total, total_if, total_over,
)
from tradewind.functions.reshape import all_groups, to_metrics
from tradewind.operators.clean import recognized
from tradewind.params import Params

def money_totals() -> dict[str, Column]:
    """Sums over fact rows. Adding the sums of parts with `merge_totals` gives the same numbers."""
    return {
        "gmv_all_status": total("GMV_All_Status"),
        "revenue": total("Recognized_Revenue"),
        "gross_profit": total("Recognized_Gross_Profit"),
        "recognized_items": flag_total("is_recognized_revenue"),
        "total_items": F.count("order_item_id"),
        "returned_items": flag_total("is_returned"),
        "return_value": total("Return_Value"),
        "cancelled_value": total("Revenue_Lost_Cancelled"),
        "processing_backlog_value": total("Processing_Backlog_Value"),
    }


COUNTS = {"recognized_items", "total_items", "returned_items"}


def merge_totals(names: Sequence[str], counts: set[str] = COUNTS) -> list[Column]:
    return [(F.sum(n) if n in counts else total(n)).alias(n) for n in names]


def aliased(aggregates: Mapping[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in aggregates.items()]


def totals_by_product(fact: DataFrame, extra_keys: Sequence[str] = (), **extra: Column) -> DataFrame:
    """Fact totals per product. Joined to the products afterwards, so a hot product is one row by then."""
    return fact.groupBy("product_id", *extra_keys).agg(*aliased({**money_totals(), **extra}))


def status_leakage(fact: DataFrame, params: Params = Params()) -> DataFrame:
    by_status = (
        fact.dropna(subset=["year", "status"])
        .groupBy("year", "status")
        .agg(
            F.count("order_item_id").alias("items"),
            F.countDistinct("order_id").alias("orders"),
            total("sale_price").alias("value"),
            total("gross_profit").alias("gross_profit"),
        )
    )
    year_value = total_over("value", Window.partitionBy("year"))
    return by_status.withColumn("share_of_gmv_pct", percent("value", year_value, 2)).withColumn(
        "is_recognized_revenue", recognized(F.col("status"), params)
    )


def annual_revenue(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Yearly totals, rates and growth; growth is taken before later years are cut off."""
    counted = F.col("is_recognized_revenue") == 1
    annual = (
        fact.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(*aliased(money_totals()), F.countDistinct(F.when(counted, F.col("order_id"))).alias("num_orders"))
    )
    previous = F.lag("revenue").over(Window.orderBy("year"))  # one row per year
    return (
        annual.select(
            "year",
            "gmv_all_status",
            "revenue",
            "gross_profit",
            F.col("recognized_items").alias("num_items"),
            "total_items",
            F.col("returned_items").alias("returns"),
            "return_value",
            "cancelled_value",
            "processing_backlog_value",
            "num_orders",
            ratio("revenue", "num_orders").alias("aov"),
            percent("gross_profit", "revenue").alias("gross_margin_pct"),
            percent("returned_items", "total_items").alias("return_rate_pct"),
            (F.col("gmv_all_status") - F.col("revenue")).alias("status_leakage_value"),
            percent(F.col("gmv_all_status") - F.col("revenue"), "gmv_all_status").alias("status_leakage_pct"),
            ((ratio("revenue", previous) - 1) * 100).alias("yoy_growth_pct"),
        )
        .where(F.col("year") <= params.last_full_year)
    )


def _quadrant(revenue: str, margin: str) -> Column:
    high_revenue = F.col(revenue) > F.median(revenue).over(all_groups())
    median_margin = F.median(margin).over(all_groups())
    high_margin = F.col(margin) > median_margin
    # Quadrant names.
    return first_match(
        [
            (high_revenue & high_margin, "Star"),
            (high_revenue & (F.col(margin) <= median_margin), "Cash Cow"),
            ((F.col(revenue) <= F.median(revenue).over(all_groups())) & high_margin, "Problem Child"),
        ],
        "Dog",
    )


def category_performance(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Totals per category and its quadrant against the median category."""
    category = dim_products.select("product_id", "category").distinct()
    by_category = (
        totals_by_product(fact)
        .join(category, "product_id", "left")
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(*merge_totals(list(money_totals())))
    )
    leakage = F.col("gmv_all_status") - F.col("revenue")
    return by_category.select(
        "category",
        "gmv_all_status",
        "revenue",
        "gross_profit",
        F.col("recognized_items").alias("num_items"),
        "total_items",
        F.col("returned_items").alias("returns"),
        "return_value",
        "cancelled_value",
        "processing_backlog_value",
        (F.col("cancelled_value") + F.col("return_value")).alias("cancelled_returned_leakage"),
        leakage.alias("status_leakage_value"),
        percent(leakage, "gmv_all_status").alias("status_leakage_pct"),
        percent("gross_profit", "revenue").alias("gross_margin_pct"),
        percent("returned_items", "total_items").alias("return_rate_pct"),
    ).withColumn("quadrant", _quadrant("revenue", "gross_margin_pct"))


def return_costs(fact: DataFrame, params: Params = Params()) -> DataFrame:
    row = fact.agg(
        F.count("*").alias("items"),
        flag_total("is_returned").alias("returned"),
        total("Return_Value").alias("value"),
    )
    cost = F.col("returned") * params.return_handling_cost
    return to_metrics(
        row,
        [
            ("Total GMV Items", F.col("items"), "items"),
            ("Total Returned Items", F.col("returned"), "items"),
            ("Return Rate % (all-status items)", ratio("returned", "items") * 100, "%"),
            ("Return Value", F.col("value"), "$"),
            ("Cost per Return", F.lit(params.return_handling_cost), "$"),
            ("Total Return Cost", cost, "$"),
            ("Annual Return Cost Estimate", cost / params.return_years, "$"),
        ],
    )


def returns_by_category(fact: DataFrame, dim_products: DataFrame, params: Params = Params()) -> DataFrame:
    category = dim_products.select("product_id", "category")
    returned = fact.where(F.col("is_returned") == 1).groupBy("product_id").agg(
        F.count("order_item_id").alias("items"), total("sale_price").alias("value")
    )
    return (
        returned.join(category, "product_id", "left")
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("items").alias("returned_items"), total("value").alias("return_value"))
        .withColumn("estimated_processing_cost", F.col("returned_items") * params.return_handling_cost)
    )


def price_band_performance(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Department, category and price band with an action by ordered rules."""
    product = dim_products.select("product_id", "category", "department").distinct()
    banded = fact.withColumn("price_band", sale_price_band("sale_price"))
    sums = money_totals()
    by_product = totals_by_product(banded, ["price_band"], priced=F.count("sale_price"))
    bands = (
        by_product.join(product, "product_id", "left")
        .dropna(subset=["department", "category"])
        .groupBy("department", "category", "price_band")
        .agg(*merge_totals(list(sums)), F.sum("priced").alias("priced"))
        .withColumn("avg_sale_price", F.try_divide("gmv_all_status", "priced"))
        .withColumn("status_leakage_value", F.col("gmv_all_status") - F.col("revenue"))
        .withColumn("gross_margin_pct", percent("gross_profit", "revenue"))
        .withColumn("return_rate_pct", percent("returned_items", "total_items"))
        .withColumn("status_leakage_pct", percent("status_leakage_value", "gmv_all_status"))
        .withColumn("cancel_value_share_pct", percent("cancelled_value", "gmv_all_status"))
        .drop("priced")
    )
    above_median = F.col("revenue") > F.median("revenue").over(all_groups())
    # Thresholds and actions.
    action = first_match(
        [
            (F.col("return_rate_pct") >= 11, "Improve fit/size confidence"),
            (F.col("cancel_value_share_pct") >= 16, "Diagnose cancellation friction"),
            ((F.col("gross_margin_pct") < 45) & above_median, "Review pricing or supplier cost"),
            (F.col("status_leakage_pct") >= 47, "Leakage reduction priority"),
        ],
        "Maintain / monitor",
    )
    return bands.withColumn("price_band_action", action)


def gmv_annual(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Yearly figures on all statuses; growth within the years kept."""
    annual = (
        fact.where(F.col("year") <= params.last_full_year)
        .groupBy("year")
        .agg(
            total("sale_price").alias("total_revenue"),
            total("gross_profit").alias("gross_profit"),
            F.countDistinct("order_id").alias("num_orders"),
            F.count("order_item_id").alias("num_items"),
        )
    )
    previous = F.lag("total_revenue").over(Window.orderBy("year"))  # one row per year
    return annual.select(
        "*",
        ratio("total_revenue", "num_orders").alias("aov"),
        percent("gross_profit", "total_revenue", None).alias("gross_margin_pct"),
        ((ratio("total_revenue", previous) - 1) * 100).alias("yoy_growth_pct"),
    )


def gmv_category(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Categories on all statuses with unrounded rates and the quadrant."""
    by_product = fact.groupBy("product_id").agg(
        total("sale_price").alias("revenue"),
        total("gross_profit").alias("gross_profit"),
        F.count("order_item_id").alias("num_items"),
        flag_total("is_returned").alias("num_returned"),
    )
    return (
        by_product.join(dim_products.select("product_id", "category"), "product_id", "left")
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(*merge_totals(["revenue", "gross_profit", "num_items", "num_returned"], {"num_items", "num_returned"}))
        .withColumn("gross_margin_pct", percent("gross_profit", "revenue", None))
        .withColumn("return_rate_pct", percent("num_returned", "num_items", None))
        .withColumn("quadrant", _quadrant("revenue", "gross_margin_pct"))
    )


def order_value_kpis(fact: DataFrame, fact_inventory: DataFrame) -> DataFrame:
    """Revenue, profit, mean of the order sums, and sell-through."""
    per_order = fact.groupBy("order_id").agg(
        total("sale_price").alias("value"), total("gross_profit").alias("profit")
    )
    sales = per_order.agg(
        total("value").alias("revenue"),
        total("profit").alias("profit"),
        ratio(total_if(F.col("order_id").isNotNull(), "value"), F.count("order_id")).alias("order_value"),
    )
    sold = fact_inventory.agg((ratio(flag_total("is_sold"), F.count("is_sold")) * 100).alias("v")).scalar()
    return to_metrics(
        sales,
        [
            ("total_revenue", F.col("revenue"), "$"),
            ("gross_profit", F.col("profit"), "$"),
            ("avg_order_value", F.col("order_value"), "$"),
            ("sell_through_rate_pct", sold, "%"),
        ],
    )


def items_by_status(items: DataFrame) -> DataFrame:
    return (
        items.where(F.col("status").isNotNull())
        .groupBy("status")
        .agg(
            F.count("id").alias("items"),
            F.countDistinct("order_id").alias("orders"),
            total("sale_price").alias("gmv"),
        )
    )


def transaction_kpis(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Seventeen figures over flagged items with gross profit, in one row."""
    counted, price = F.col("is_recognized"), "sale_price"
    row = items.agg(
        total(price).alias("total_gmv"),
        total_if(counted, price).alias("recognized_revenue"),
        total_if(counted, "gross_profit").alias("recognized_profit"),
        total_if(F.col("status") == "Complete", price).alias("completed_revenue"),
        total_if(F.col("status") == "Processing", price).alias("open_processing_revenue"),
        total_if(F.col("is_returned"), price).alias("returned_revenue"),
        total_if(F.col("is_cancelled"), price).alias("cancelled_revenue"),
        F.count(F.when(F.col("is_returned"), F.col("id"))).alias("_returned"),
        F.count(F.when(F.col("is_cancelled"), F.col("id"))).alias("_cancelled"),
        F.count(F.when(F.col("is_valid_purchase"), F.col("id"))).alias("_valid"),
        F.count("id").alias("_ids"),
        F.count("*").alias("items"),
        F.countDistinct(F.when(counted, F.col("order_id"))).alias("recognized_orders"),
        F.count(F.when(counted, F.col(price))).alias("_priced"),
    )
    leakage = F.col("returned_revenue") + F.col("cancelled_revenue")
    return row.select(
        "total_gmv",
        "recognized_revenue",
        "recognized_profit",
        ratio0("recognized_profit", "recognized_revenue").alias("recognized_margin"),
        "completed_revenue",
        "open_processing_revenue",
        "returned_revenue",
        "cancelled_revenue",
        leakage.alias("leakage_revenue"),
        ratio0(leakage, "total_gmv").alias("leakage_rate"),
        ratio0("_returned", "_valid").alias("return_rate_items"),
        ratio0("_cancelled", "_ids").alias("cancel_rate_items"),
        orders.agg(F.countDistinct("order_id").alias("n")).scalar().alias("orders"),
        "recognized_orders",
        "items",
        ratio0("recognized_revenue", "recognized_orders").alias("avg_order_value"),
        ratio("recognized_revenue", "_priced").alias("avg_item_price"),
    )


def product_categories(items: DataFrame) -> DataFrame:
    """Recognized sales by category and department with the category's return and cancel rates.

    One aggregation: status counts are kept per group and added up over the category afterwards.
    """
    counted = F.col("is_recognized")
    # The statuses counted as all items.
    statuses = ("Cancelled", "Returned", "Complete", "Shipped", "Processing")
    by_group = items.groupBy("category", "department").agg(
        total_if(counted, "sale_price").alias("revenue"),
        total_if(counted, "gross_profit").alias("profit"),
        F.count(F.when(counted, F.col("id"))).alias("items"),
        F.countDistinct(F.when(counted, F.col("order_id"))).alias("orders"),
        F.count_if(counted).alias("_recognized"),
        *[F.count(F.when(F.col("status") == s, F.col("id"))).alias(f"_{s}") for s in statuses],
    )
    whole = Window.partitionBy("category")
    named = F.col("category").isNotNull()
    n = {s: F.when(named, F.sum(f"_{s}").over(whole)) for s in statuses}
    all_items = sum((n[s] for s in statuses[1:]), n[statuses[0]])
    return (
        by_group.withColumn("margin", ratio("profit", "revenue"))
        .withColumn("return_rate", ratio(n["Returned"], n["Returned"] + n["Complete"] + n["Shipped"]))
        .withColumn("cancel_rate", ratio(n["Cancelled"], all_items))
        .withColumn("all_items", all_items)
        .where(F.col("_recognized") > 0)
        .drop("_recognized", *[f"_{s}" for s in statuses])
    )


def product_brands(items: DataFrame) -> DataFrame:
    """Recognized sales by brand and category; missing names are groups."""
    return (
        items.where("is_recognized")
        .groupBy("brand", "category")
        .agg(
            total("sale_price").alias("revenue"),
            total("gross_profit").alias("profit"),
            F.count("id").alias("items"),
        )
        .withColumn("margin", ratio("profit", "revenue"))
    )


def product_price_bands(items: DataFrame) -> DataFrame:
    """Recognized sales by right-closed price band; prices of zero or less are in none."""
    return (
        items.where("is_recognized")
        .withColumn("price_band", band("sale_price", RECOGNIZED_PRICE_BANDS))
        .where(F.col("price_band").isNotNull())
        .groupBy("price_band")
        .agg(
            total("sale_price").alias("revenue"),
            total("gross_profit").alias("profit"),
            F.count("id").alias("items"),
        )
        .withColumn("margin", ratio("profit", "revenue"))
    )
