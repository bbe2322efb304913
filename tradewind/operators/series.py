"""Monthly series: preparation, seasonal-naive baseline, revenue outlook, backtest metrics.

A series has one row per category and month, so whatever is grouped or ordered by category here is a few
hundred rows long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import mean, mean_if, ratio, ratio0, round_even, total, total_if, total_over
from tradewind.functions.temporal import month_start

HORIZON = 12


def monthly_category_series(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Recognized revenue per month and category. Products are totalled before they are looked up."""
    category = dim_products.select("product_id", "category").where(F.col("category").isNotNull())
    per_product = fact.groupBy(month_start("created_at").alias("ds"), "product_id").agg(
        total("Recognized_Revenue").alias("revenue")
    )
    return (
        per_product.join(category, "product_id").groupBy("ds", "category").agg(total("revenue").alias("revenue"))
    )


def deduplicated_gmv_series(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Monthly value of all statuses per category, counting equal (date, product, price) rows once."""
    category = dim_products.select("product_id", "category").where(F.col("category").isNotNull())
    per_product = (
        fact.select(F.col("created_at").cast("date").alias("date"), "product_id", "sale_price")
        .distinct()
        .groupBy(month_start("date").alias("ds"), "product_id")
        .agg(total("sale_price").alias("y"))
    )
    return per_product.join(category, "product_id").groupBy("ds", "category").agg(total("y").alias("y"))


def top_categories(series: DataFrame, n: int, value: str = "revenue") -> DataFrame:
    """The rows of the `n` categories with the largest totals."""
    by_size = Window.orderBy(F.col("_total").desc(), "category")  # one row per category and month
    return (
        series.withColumn("_total", total_over(value, Window.partitionBy("category")))
        .withColumn("_rank", F.dense_rank().over(by_size))
        .where(F.col("_rank") <= n)
        .drop("_total", "_rank")
    )


def regular_monthly(series: DataFrame, value: str = "revenue") -> DataFrame:
    """Every month between a category's first and last, missing ones with zero."""
    months = F.sequence("first", "last", F.expr("interval 1 month"))
    return (
        series.groupBy("category")
        .agg(
            F.min("ds").alias("first"),
            F.max("ds").alias("last"),
            F.map_from_entries(F.collect_list(F.struct("ds", value))).alias("at"),
        )
        .select("category", "at", F.explode(months).alias("ds"))
        .select("category", "ds", F.coalesce(F.try_element_at("at", F.col("ds")), F.lit(0.0)).alias("y"))
    )


def rolling_mean(series: DataFrame, value: str = "y", months: int = 3) -> DataFrame:
    """Mean of up to the last `months` rows of each series."""
    window = Window.partitionBy("category").orderBy("ds").rowsBetween(1 - months, 0)
    return series.withColumn("rolling_mean", ratio(total_over(value, window), F.count(value).over(window)))


def series_gaps(series: DataFrame, value: str = "y") -> DataFrame:
    """Missing months, smallest and largest value per series."""
    return series.groupBy("category").agg(
        (F.months_between(F.max("ds"), F.min("ds")).cast("bigint") + 1 - F.countDistinct("ds")).alias("missing_months"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def _from_end(series: DataFrame) -> DataFrame:
    """Adds `_age` (1 = last month of the series) and `_months`."""
    whole = Window.partitionBy("category")
    return series.withColumn("_age", F.row_number().over(whole.orderBy(F.col("ds").desc()))).withColumn(
        "_months", F.count("*").over(whole)
    )


def train_validation_split(regular: DataFrame, holdout: int = HORIZON) -> DataFrame:
    part = F.when(F.col("_age") <= holdout, "validation").otherwise("train")
    return _from_end(regular).withColumn("part", part).drop("_age", "_months")


def seasonal_naive_backtest(regular: DataFrame) -> DataFrame:
    """The last twelve months against the twelve before, for series of at least 24 months."""
    year_before = F.lag("y", HORIZON).over(Window.partitionBy("category").orderBy("ds"))
    return (
        _from_end(regular)
        .withColumn("predicted", year_before)
        .where((F.col("_age") <= HORIZON) & (F.col("_months") >= 2 * HORIZON))
        .select("category", "ds", F.col("y").alias("actual"), "predicted")
    )


def backtest_metrics(backtest: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE per category; months with an actual of zero are left out of MAPE."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    return backtest.groupBy("category").agg(
        mean(error).alias("mae"),
        F.sqrt(mean(error * error)).alias("rmse"),
        (mean_if(F.col("actual") != 0, F.abs(F.try_divide(error, F.col("actual")))) * 100).alias("mape_pct"),
    )


def _growth(last: Column, previous: Column) -> Column:
    return F.greatest(F.least(last / F.greatest(previous, F.lit(1.0)), F.lit(1.5)), F.lit(0.5))


def seasonal_naive_forecast(regular: DataFrame) -> DataFrame:
    """Next twelve months as the last twelve times their growth over the year before; short series by their mean."""
    age, long_enough = F.col("_age"), F.col("n") >= 2 * HORIZON
    year_before = F.lag("y", HORIZON).over(Window.partitionBy("category").orderBy("ds"))
    error = F.when(age <= HORIZON, F.abs(F.try_divide(F.col("y") - F.col("_before"), F.col("y"))) * 100)
    per_series = (
        _from_end(regular)
        .withColumn("_before", year_before)
        .groupBy("category")
        .agg(
            F.max("_months").alias("n"),
            F.max("ds").alias("last_ds"),
            mean("y").alias("mean_y"),
            total_if(age <= HORIZON, "y").alias("last"),
            total_if((age > HORIZON) & (age <= 2 * HORIZON), "y").alias("previous"),
            mean(error).alias("mape"),
            F.map_from_entries(
                F.array_compact(F.collect_list(F.when(age <= HORIZON, F.struct((HORIZON + 1 - age).alias("h"), "y"))))
            ).alias("at"),
        )
    )
    seasonal = F.try_element_at("at", F.col("h")) * _growth(F.col("last"), F.col("previous"))
    yhat = F.when(long_enough, seasonal).otherwise(F.col("mean_y"))
    return (
        per_series.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
        .select(
            "category",
            F.add_months("last_ds", F.col("h")).alias("ds"),
            yhat.alias("yhat"),
            (yhat * 0.85).alias("yhat_lower"),
            (yhat * 1.15).alias("yhat_upper"),
            F.when(long_enough, round_even("mape", 2)).alias("mape_pct"),
        )
    )


def monthly_revenue(items: DataFrame) -> DataFrame:
    """Recognized revenue and profit per month up to the last full month; months without sales are zero."""
    monthly = (
        items.where(F.col("is_recognized") & F.col("created_at").isNotNull())
        .groupBy(month_start("created_at").alias("month"))
        .agg(
            total("sale_price").alias("revenue"),
            total("gross_profit").alias("profit"),
            F.max("created_at").alias("latest"),
        )
    )
    latest = F.max("latest")
    current = month_start(latest)
    full = F.when(F.dayofmonth(latest) < F.dayofmonth(F.last_day(latest)), F.add_months(current, -1)).otherwise(current)
    row = monthly.agg(
        F.min("month").alias("first"),
        full.alias("last"),
        F.map_from_entries(F.collect_list(F.struct("month", F.struct("revenue", "profit")))).alias("at"),
    ).where(F.col("first") <= F.col("last"))
    cell = F.try_element_at("at", F.col("month"))
    return row.select(
        "at", F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month")
    ).select(
        "month",
        F.coalesce(cell["revenue"], F.lit(0.0)).alias("revenue"),
        F.coalesce(cell["profit"], F.lit(0.0)).alias("profit"),
    )


def _outlook(monthly: DataFrame) -> DataFrame:
    """The twelve coming months, each with the figures they rest on. `monthly` has one row per month."""
    aged = monthly.withColumn("_age", F.row_number().over(Window.orderBy(F.col("month").desc())))
    age = F.col("_age")
    recent, before = age <= HORIZON, (age > HORIZON) & (age <= 2 * HORIZON)
    stats = aged.agg(
        F.max("month").alias("last_full_month"),
        total_if(recent, "revenue").alias("last12_revenue"),
        F.when(F.count_if(before) == HORIZON, total_if(before, "revenue")).alias("prev12_revenue"),
        mean_if(recent, "revenue").alias("_mean"),
        total_if(recent, "profit").alias("_profit"),
        F.map_from_entries(
            F.array_compact(F.collect_list(F.when(recent, F.struct("month", "revenue"))))
        ).alias("_at"),
    )
    raw_growth = F.when(F.col("prev12_revenue") > 0, ratio("last12_revenue", "prev12_revenue") - 1).otherwise(0.0)
    base = F.coalesce(F.try_element_at("_at", F.add_months("month", -12)), F.col("_mean"))
    return (
        stats.withColumn("raw_yoy_growth", raw_growth)
        .withColumn("used_yoy_growth", F.greatest(F.least("raw_yoy_growth", F.lit(0.5)), F.lit(-0.2)))
        .withColumn("last12_margin", ratio0("_profit", "last12_revenue"))
        .withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
        .withColumn("month", F.add_months("last_full_month", F.col("_h")))
        .withColumn("forecast_revenue", base * (1 + F.col("used_yoy_growth")))
        .withColumn("forecast_profit", F.col("forecast_revenue") * F.col("last12_margin"))
    )


def revenue_forecast(monthly: DataFrame) -> DataFrame:
    """Same month of last year times one plus the clipped growth; profit at last year's margin."""
    return _outlook(monthly).select(
        F.date_format("month", "yyyy-MM").alias("month"), "forecast_revenue", "forecast_profit"
    )


def revenue_forecast_summary(monthly: DataFrame) -> DataFrame:
    figures = [
        "last_full_month", "last12_revenue", "prev12_revenue", "raw_yoy_growth", "used_yoy_growth", "last12_margin",
    ]
    return _outlook(monthly).groupBy(*figures).agg(
        total("forecast_revenue").alias("next12_revenue_forecast"),
        total("forecast_profit").alias("next12_profit_forecast"),
    )
