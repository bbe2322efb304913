"""A third of all rows on one order, product, user and session: same rows as SQL, also when every join is a shuffle."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from checks.compare import TABLES, connect, difference
from conftest import SF

CHANGED = {
    "lineitem": """* replace (case when l_linenumber % 3 = 0 then 7 else l_orderkey end as l_orderkey,
        case when l_linenumber % 3 = 0 then 5 else l_partkey end as l_partkey)""",
    "orders": "* replace (case when o_orderkey % 3 = 0 then 3 else o_custkey end as o_custkey)",
    "events": """* replace (case when event_id % 3 = 0 then 8 else user_id end as user_id,
        case when event_id % 3 = 0 then timestamp '2024-01-05' + to_seconds(event_id * 7 % 86000) else ts end as ts)""",
}
SHUFFLE_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = str(tmp_path_factory.mktemp("skewed"))
    for table in TABLES:
        duckdb.execute(
            f"copy (select {CHANGED.get(table, '*')} from read_parquet('{SF}/{table}.parquet')) "
            f"to '{target}/{table}.parquet' (format parquet)"
        )
    return target


@pytest.fixture(scope="module")
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SHUFFLE_JOINS}
    for k, v in SHUFFLE_JOINS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name",
    ["rfm", "fact_transactions", "customer_table", "customer_value_segments", "sessions", "session_time_checks",
     "journey_by_source", "basket_affinity", "annual_revenue", "category_performance", "root_cause_proxy",
     "foreign_key_checks", "scope_reconciliation", "product_categories", "fulfillment"],
)
def test_hot_keys(shuffled, folder, name):
    connection = connect(folder)
    try:
        query, sql = entry_module.queries()[name], entry_module.oracle_sql()[name]
        assert difference(query(shuffled, folder), connection, sql) is None
    finally:
        connection.close()
