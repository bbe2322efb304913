"""Categories bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradewind.functions.bands import first_match
from tradewind.functions.durable import durable
from tradewind.functions.numeric import percent, ratio, round_even, total


def basket_affinity(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Support, confidence and lift of category pairs in recognized orders.

    An order is reduced to the set of its categories, and equal sets of one user are counted together. Only
    such a set is spread into pairs, one at a time, so the number of items in an order or of orders with the same basket
    does not matter. The set is at most as long as the list of categories.
    """
    category = dim_products.select("product_id", "category").distinct().where(F.col("category").isNotNull())
    per_order = (
        fact.where((F.col("is_recognized_revenue") == 1) & F.col("order_id").isNotNull())
        .select("order_id", "order_item_id", "user_id", "product_id", "Recognized_Revenue")
        .join(category, "product_id")
        .groupBy("order_id")
        .agg(
            F.sort_array(F.collect_set("category")).alias("basket"),
            F.min_by("user_id", "order_item_id").alias("user_id"),
            total("Recognized_Revenue").alias("revenue"),
        )
    )
    baskets = per_order.groupBy("user_id", "basket").agg(
        F.count("*").alias("orders"), total("revenue").alias("revenue")
    )

    # One row per category and its place, then one per category from there on: (a, b) for a before b, and (a, a) for a
    # category alone. Place 0 has no category and stands for all orders. No row holds the pairs of a basket.
    nothing = F.lit(None).cast("string")
    first = F.posexplode(F.concat(F.array(nothing), F.col("basket"))).alias("place", "category_a")
    others = F.when(F.col("place") > 0, F.slice("basket", F.col("place"), F.size("basket"))).otherwise(F.array(nothing))
    counted = durable(
        baskets.select("user_id", "orders", "revenue", "basket", first)
        .select("user_id", "orders", "revenue", "category_a", F.explode(others).alias("category_b"))
        .groupBy("category_a", "category_b")
        .agg(
            F.sum("orders").alias("orders_with_pair"),
            F.countDistinct("user_id").alias("users_with_pair"),
            total("revenue").alias("pair_revenue"),
        )
    )

    # At most one row per category pair from here on.
    alone = counted.where(F.col("category_a") == F.col("category_b"))
    whole = counted.where(F.col("category_a").isNull()).agg(F.max("orders_with_pair")).scalar()
    pairs = (
        counted.where(F.col("category_a") < F.col("category_b"))
        .join(alone.select("category_a", F.col("orders_with_pair").alias("category_a_orders")), "category_a")
        .join(alone.select("category_b", F.col("orders_with_pair").alias("category_b_orders")), "category_b")
        .withColumn("_total", whole)
    )
    actual = ratio("orders_with_pair", "_total")
    expected = ratio("category_a_orders", "_total") * ratio("category_b_orders", "_total")
    likely = (F.col("confidence_a_to_b_pct") >= 15) | (F.col("confidence_b_to_a_pct") >= 15)
    # Thresholds and actions.
    action = first_match(
        [
            ((F.col("lift") >= 1.5) & (F.col("orders_with_pair") >= 50), "Bundle/cross-sell priority"),
            (likely, "Recommendation module candidate"),
        ],
        "Monitor",
    )
    return (
        pairs.withColumn("support_pct", percent("orders_with_pair", "_total", 3))
        .withColumn("confidence_a_to_b_pct", percent("orders_with_pair", "category_a_orders"))
        .withColumn("confidence_b_to_a_pct", percent("orders_with_pair", "category_b_orders"))
        .withColumn("lift", round_even(F.try_divide(actual, expected), 2))
        .withColumn("bundle_action", action)
        .drop("_total")
    )
