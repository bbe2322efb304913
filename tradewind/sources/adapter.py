"""The generic sales tables of TESTDATA.md seen as the raw e-commerce tables.

Every value is a fixed expression of the row (FIXTURES.md), so the same mapping can be written in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tradewind.params import Params
from tradewind.sources.schemas import RAW_FILES

# Parameters that suit the dates and sizes of these tables.
ADAPTER_PARAMS = Params(
    analysis_cutoff="2000-12-31",
    inventory_cutoff="2001-10-01",
    partial_year=2001,
    spine_start="1995-01-01",
    spine_end="2001-12-31",
    bot_threshold=5,
    root_cause_min_items=5,
)

_HOURS = "timestampadd(HOUR, cast({hours} as int), {start})"


def _orders(orders: DataFrame) -> DataFrame:
    shipped = _HOURS.format(hours="case when o_orderkey % 997 = 0 then 0 else 6 + (o_orderkey * 7) % 60 end", start="base")
    delivered = _HOURS.format(hours="case when o_orderkey % 499 = 0 then 0 else 12 + (o_orderkey * 11) % 180 end", start="shipped")
    returned = _HOURS.format(hours="case when o_orderkey % 211 = 0 then 0 else 24 + (o_orderkey * 5) % 240 end", start="delivered")
    status = """
        case o_orderstatus
            when 'P' then 'Processing'
            when 'F' then case when o_orderpriority = '5-LOW' then 'Returned' else 'Complete' end
            else case when o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED') then 'Cancelled' else 'Shipped' end
        end as status"""
    return (
        orders.selectExpr("*", status, "timestampadd(SECOND, cast(o_orderkey % 86400 as int), o_orderdate) as base")
        .selectExpr("*", f"case when status in ('Shipped', 'Complete', 'Returned') then {shipped} end as shipped")
        .selectExpr(
            "*",
            f"case when status in ('Complete', 'Returned') and o_orderkey % 331 <> 0 then {delivered} end as delivered",
        )
        .selectExpr(
            "o_orderkey as order_id",
            "o_custkey as user_id",
            "status",
            "case when o_custkey % 89 = 0 then null when o_custkey % 2 = 0 then 'F' else 'M' end as gender",
            "case when o_orderkey % 41 <> 0 then base end as created_at",
            f"case when status = 'Returned' and o_orderkey % 233 <> 0 then {returned} end as returned_at",
            "shipped as shipped_at",
            "delivered as delivered_at",
            "cast(1 + o_orderkey % 7 as int) as num_of_item",
        )
    )


_ITEM_ID = (
    "l_orderkey * 1000000 + (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 1299709) % 1000000"
)


def _order_items(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # Both ids of an item follow from its keys, so only the keys are shuffled.
    items = lineitem.selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "(l_extendedprice - 900.0D) * (1.0D - l_discount) / 450.0D as sale_price",
    )
    return items.join(orders, items.l_orderkey == orders.order_id).selectExpr(
        f"{_ITEM_ID} as id",
        "order_id",
        "user_id",
        "l_partkey as product_id",
        f"{_ITEM_ID} as inventory_item_id",
        "status", "created_at", "shipped_at", "delivered_at", "returned_at",
        "sale_price",
    )


def _products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey as id",
        "(p_retailprice - 900.0D) * 0.3D + 5.0D as cost",
        "split_part(p_name, ' ', 2) as category",
        "case when p_partkey % 700 <> 699 then p_name end as name",
        "case when p_partkey % 500 <> 499 then p_brand end as brand",
        "(p_retailprice - 900.0D) * 0.9D + 20.0D as retail_price",
        "case when p_partkey % 2 = 0 then 'Women' else 'Men' end as department",
        "concat('SKU', cast(p_partkey as string)) as sku",
        "p_partkey % 25 as distribution_center_id",
    )


def _inventory(lineitem: DataFrame, products: DataFrame, supplier: DataFrame) -> DataFrame:
    product = products.selectExpr(
        "id as product_id",
        "case when id % 701 = 0 then 0.0D else cost end as cost",
        "category as product_category",
        "name as product_name",
        "brand as product_brand",
        "retail_price as product_retail_price",
        "department as product_department",
        "sku as product_sku",
    )
    center = supplier.selectExpr("s_suppkey as l_suppkey", "cast(s_nationkey as bigint) as product_distribution_center_id")
    stock = lineitem.selectExpr(
        f"{_ITEM_ID} as id",
        "l_partkey as product_id",
        "l_suppkey",
        "case when l_orderkey % 113 <> 0 then timestampadd(DAY, cast(-10 * l_quantity as int), l_shipdate) end as created_at",
        "case when l_linestatus = 'F' and l_tax < 0.06D then l_shipdate end as sold_at",
    )
    return stock.join(product, "product_id").join(center, "l_suppkey").drop("l_suppkey")


def _events(events: DataFrame) -> DataFrame:
    second = "hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as int)"
    return events.selectExpr(
        "event_id as id",
        "case when (user_id * 31 + day(ts)) % 7 >= 3 then user_id end as user_id",
        f"cast({second} + case when event_id % 13 = 0 then 7200 else 0 end as int) as sequence_number",
        "concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) as session_id",
        "ts as created_at",
        "element_at(array('Chrome', 'Firefox', 'Safari'), cast(event_id % 3 + 1 as int)) as browser",
        "element_at(array('Email', 'Adwords', 'Facebook', 'YouTube', 'Organic'), cast(user_id % 5 + 1 as int)) as traffic_source",
        """case event_type
            when 'view' then 'product' when 'click' then 'cart' when 'error' then 'cancel'
            when 'signup' then case when event_id % 2 = 0 then 'home' else 'department' end
            else event_type end as event_type""",
    )


def _users(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return customer.join(place, customer.c_nationkey == place.n_nationkey).selectExpr(
        "c_custkey as id",
        "c_name as first_name",
        "c_mktsegment as last_name",
        "concat('user', cast(c_custkey as string), '@example.com') as email",
        "cast(case when c_custkey % 97 <> 0 then 5 + (c_custkey * 37) % 130 end as int) as age",
        "case when c_custkey % 89 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end as gender",
        "r_name as state",
        "concat(cast(c_custkey % 900 as string), ' Main Street') as street_address",
        "cast(10000 + c_custkey % 9000 as string) as postal_code",
        "case when c_custkey % 100 <> 0 then concat('City', cast(c_custkey % 50 as string)) end as city",
        "n_name as country",
        "cast(c_custkey % 180 - 90 as double) as latitude",
        "cast(c_custkey % 360 - 180 as double) as longitude",
        "c_mktsegment as traffic_source",
        "case when c_custkey % 83 <> 0 then timestampadd(DAY, cast(c_custkey * 53 % 1500 as int), timestamp_ntz'1994-06-01') end as created_at",
    )


def _centers(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "cast(n_nationkey as bigint) as id",
        "n_name as name",
        "n_nationkey * 3.5D - 40.0D as latitude",
        "n_nationkey * 7.0D - 80.0D as longitude",
    )


class AdaptedTables:
    """The seven raw tables, each defined when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return _orders(self._table("orders"))

    @cached_property
    def order_items(self) -> DataFrame:
        return _order_items(self._table("lineitem"), self.orders)

    @cached_property
    def inventory(self) -> DataFrame:
        return _inventory(self._table("lineitem"), self.products, self._table("supplier"))

    @cached_property
    def events(self) -> DataFrame:
        return _events(self._table("events"))

    @cached_property
    def users(self) -> DataFrame:
        return _users(self._table("customer"), self._table("nation"), self._table("region"))

    @cached_property
    def products(self) -> DataFrame:
        return _products(self._table("part"))

    @cached_property
    def dcs(self) -> DataFrame:
        return _centers(self._table("nation"))

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in RAW_FILES]


def adapt(spark: SparkSession, folder: str) -> AdaptedTables:
    return AdaptedTables(spark, folder)
