"""Raw and star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

# Columns and types of the raw tables.
RAW_SCHEMAS: dict[str, dict[str, str]] = {
    "orders": {
        "order_id": "bigint", "user_id": "bigint", "status": "string", "gender": "string",
        "created_at": "timestamp_ntz", "returned_at": "timestamp_ntz", "shipped_at": "timestamp_ntz",
        "delivered_at": "timestamp_ntz", "num_of_item": "int",
    },
    "order_items": {
        "id": "bigint", "order_id": "bigint", "user_id": "bigint", "product_id": "bigint",
        "inventory_item_id": "bigint", "status": "string", "created_at": "timestamp_ntz",
        "shipped_at": "timestamp_ntz", "delivered_at": "timestamp_ntz", "returned_at": "timestamp_ntz",
        "sale_price": "double",
    },
    "inventory": {
        "id": "bigint", "product_id": "bigint", "created_at": "timestamp_ntz", "sold_at": "timestamp_ntz",
        "cost": "double", "product_category": "string", "product_name": "string", "product_brand": "string",
        "product_retail_price": "double", "product_department": "string", "product_sku": "string",
        "product_distribution_center_id": "bigint",
    },
    "events": {
        "id": "bigint", "user_id": "bigint", "sequence_number": "int", "session_id": "string",
        "created_at": "timestamp_ntz", "ip_address": "string", "city": "string", "state": "string",
        "postal_code": "string", "browser": "string", "traffic_source": "string", "uri": "string",
        "event_type": "string",
    },
    "users": {
        "id": "bigint", "first_name": "string", "last_name": "string", "email": "string", "age": "int",
        "gender": "string", "state": "string", "street_address": "string", "postal_code": "string",
        "city": "string", "country": "string", "latitude": "double", "longitude": "double",
        "traffic_source": "string", "created_at": "timestamp_ntz",
    },
    "products": {
        "id": "bigint", "cost": "double", "category": "string", "name": "string", "brand": "string",
        "retail_price": "double", "department": "string", "sku": "string", "distribution_center_id": "bigint",
    },
    "dcs": {"id": "bigint", "name": "string", "latitude": "double", "longitude": "double"},
}

# File names and primary keys of the raw tables.
RAW_FILES = {
    "orders": "orders", "order_items": "order_items", "inventory": "inventory_items", "events": "events",
    "users": "users", "products": "products", "dcs": "distribution_centers",
}
PRIMARY_KEYS = {name: "order_id" if name == "orders" else "id" for name in RAW_FILES}

# Event columns read by the session analyses and by the funnel analyses.
SESSION_EVENT_COLUMNS = (
    "id", "user_id", "sequence_number", "session_id", "created_at", "browser", "traffic_source", "event_type",
)
FUNNEL_EVENT_COLUMNS = ("id", "user_id", "session_id", "event_type", "traffic_source", "created_at")


@dataclass(frozen=True)
class RawTables:
    orders: DataFrame
    order_items: DataFrame
    inventory: DataFrame
    events: DataFrame
    users: DataFrame
    products: DataFrame
    dcs: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


@dataclass(frozen=True)
class StarSchema:
    fact_transactions: DataFrame
    agg_funnel_monthly: DataFrame
    fact_inventory: DataFrame
    dim_users: DataFrame
    dim_products: DataFrame
    dim_dcs: DataFrame
    dim_date: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]
