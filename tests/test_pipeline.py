"""Sources, sinks, whole runs and the shape of plans."""

import datetime as dt
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from conftest import by, rows
from tradewind.operators import clean
from tradewind.plans import pipeline
from tradewind.sources import readers, sinks
from tradewind.sources.adapter import ADAPTER_PARAMS
from tradewind.sources.schemas import RAW_SCHEMAS, SESSION_EVENT_COLUMNS


def write(path, text):
    path.write_text(text)
    return path


def test_csv_is_matched_by_name_and_bad_values_become_null(spark, tmp_path):
    write(
        tmp_path / "orders.csv",
        "status,order_id,user_id,created_at,extra,num_of_item\n"
        '"Complete",1,7,2022-03-21 05:50:00+00:00,"a,b",2\n'
        "Shipped,x,,never,,\n",
    )
    with pytest.raises(ValueError, match="gender, returned_at"):
        readers.read_raw(spark, str(tmp_path), "orders")
    df = readers.read_raw(spark, str(tmp_path), "orders", absent="null")
    assert dict(df.dtypes) == RAW_SCHEMAS["orders"]
    assert rows(df, "order_id", "user_id", "status", "created_at", "num_of_item") == [
        (1, 7, "Complete", dt.datetime(2022, 3, 21, 5, 50), 2),
        (None, None, "Shipped", None, None),
    ]


def test_missing_texts_are_null_but_only_empty_ones_in_events(spark, tmp_path):
    write(tmp_path / "users.csv", 'id,age,city,latitude\n1,NA,null,nan\n2,30,"",1.5\n')
    assert rows(readers.read_raw(spark, str(tmp_path), "users", columns=["id", "age", "city", "latitude"])) == [
        (1, None, None, None), (2, 30, None, 1.5),
    ]
    write(tmp_path / "events.csv", "id,city,user_id\n1,null,\n2,,5\n")
    assert rows(readers.read_raw(spark, str(tmp_path), "events", columns=["id", "city", "user_id"])) == [
        (1, "null", None), (2, None, 5),
    ]


def test_missing_optional_tables_are_none(spark, tmp_path):
    assert readers.load_funnel_events(spark, str(tmp_path)) is None
    assert readers.load_raw_orders(spark, None) is None
    write(tmp_path / "events.csv", "id,user_id,session_id,event_type,traffic_source,created_at,uri\n1,,s,cart,Email,2020-01-01,/x\n")
    events = readers.load_funnel_events(spark, str(tmp_path))
    assert rows(events) == [(1, None, "s", "cart", "Email", dt.datetime(2020, 1, 1))]


def test_raw_tables_survive_csv(spark, tables, tmp_path):
    for name, df in tables.raw.items():
        sinks.write_result(df, str(tmp_path / f"{readers.RAW_FILES[name]}.csv"), "csv")
    raw = readers.load_raw(spark, str(tmp_path), event_columns=SESSION_EVENT_COLUMNS)
    for name, df in tables.raw.items():
        read = getattr(raw, name).select(*df.columns)
        assert read.exceptAll(df).count() == 0 and df.exceptAll(read).count() == 0, name


@pytest.fixture(scope="module")
def run_folder(tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    counts = pipeline.run_etl(tables.raw, folder, ADAPTER_PARAMS)
    return folder, counts


def test_etl_writes_all_tables(spark, tables, run_folder):
    folder, counts = run_folder
    star = readers.load_star(spark, f"{folder}/processed")
    assert counts == {name: df.count() for name, df in star.items()}
    assert counts["fact_transactions"] == tables.fact.count() and counts["dim_users"] == 150
    csv = spark.read.option("header", True).csv(f"{folder}/processed/dim_products.csv")
    assert csv.count() == counts["dim_products"]
    report = spark.read.json(f"{folder}/interim/quality_summary.json")
    assert by(report, ("section", "check"), "value")[("scope_reconciliation", "fact_transaction_rows")] == counts["fact_transactions"]
    found = by(report, ("section", "check"), "value")
    assert {c: n for (s, c), n in found.items() if s == "processed_row_counts"} == counts
    assert found["result_row_counts", "rfm_users"] == tables.rfm.count() and found["table_profile", "users.rows"] == 150
    samples = spark.read.option("header", True).csv(f"{folder}/interim/quality_samples/orders_shipped_before_created.csv")
    assert 0 < samples.count() <= 50


def test_year_filters_skip_files_of_the_written_fact(spark, run_folder):
    from tradewind.operators.star import ensure_revenue_columns

    fact = ensure_revenue_columns(readers.load_star(spark, f"{run_folder[0]}/processed").fact_transactions)
    plan = fact.where("year <= 1996").select("order_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan)


def test_analyses_run_from_the_written_star_schema(spark, tables, run_folder):
    star = readers.load_star(spark, f"{run_folder[0]}/processed")
    results = pipeline.star_analyses(star, tables.raw.events, tables.raw.orders, ADAPTER_PARAMS)
    assert len(results) == 17
    annual = results["annual_revenue_analysis"]
    assert rows(annual) == rows(QUERIES["annual_revenue"](tables).select(*annual.columns))
    fallback = pipeline.star_analyses(star, None, None, ADAPTER_PARAMS)
    assert rows(fallback["fulfillment_performance"]) == [("Fulfillment Data", None, "Raw orders unavailable")]
    assert fallback["funnel_analysis"].columns[3] == "user_months"
    assert {r["fulfillment_bucket"] for r in fallback["return_cancel_root_cause_proxy"].collect()} == {"unknown"}


def test_raw_analyses_agree_with_the_single_queries(tables):
    results = pipeline.raw_analyses(tables.raw, ADAPTER_PARAMS)
    for name in ("transaction_kpis", "customers_by_source", "session_funnel", "center_stock_vs_demand", "revenue_forecast"):
        expected = QUERIES[name](tables)
        assert rows(results[name].select(*expected.columns)) == rows(expected), name


def test_models_are_written(spark, run_folder):
    folder = run_folder[0]
    star = readers.load_star(spark, f"{folder}/processed")
    results = pipeline.model_results(star, ADAPTER_PARAMS, k=4)
    sinks.save_results(results, f"{folder}/models", "parquet")
    users = spark.read.parquet(f"{folder}/models/dim_users_with_clusters.parquet")
    assert users.count() == 150 and users.where("cluster_label is null").count() == 0
    assert spark.read.parquet(f"{folder}/models/demand_forecast_12m.parquet").count() == 36


RETRIED = """
import sys
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tradewind.session import build_session
from tradewind.sources.sinks import write_result

spark = build_session("retried", "local[2,3]", spark__ui__enabled="false", spark__sql__shuffle__partitions="3")

def failing(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")

rows = spark.range(0, 1000, 1, 4).mapInArrow(failing, "id long")
print("rows", write_result(rows, sys.argv[1] + "/plain"), write_result(rows.hint("rebalance"), sys.argv[1] + "/even"))
print("read", spark.read.parquet(sys.argv[1] + "/plain").count(), spark.read.parquet(sys.argv[1] + "/even").count())
"""


def test_rows_of_a_failed_attempt_are_not_counted(tmp_path):
    """Every task fails once after it has passed on all its rows."""
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True, env=env, timeout=180)
    assert "rows 1000 1000\nread 1000 1000" in done.stdout, done.stderr[-2000:]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Scans of these files are proportional to the facts.
FACT_FILES = ("lineitem", "orders", "events")


@pytest.mark.parametrize("name", ["rfm", "customer_table", "sessions", "session_time_checks", "basket_affinity", "annual_revenue"])
def test_plans_have_no_cartesian_product(tables, name):
    plan = plan_of(QUERIES[name](tables))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"cluster_count", "cluster_count_checks", "kmeans_clusters", "kmeans_checks", "kmeans_profile", "model_report", "model_report_checks"}))
def test_single_partition_windows_sit_on_aggregates(tables, name):
    """A window over all rows is only found above an aggregation, never directly on table rows."""
    lines = plan_of(QUERIES[name](tables)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = re.search(r"\w", line).start()
        below = []
        for later in lines[i + 1 :]:
            if re.search(r"\w", later) and re.search(r"\w", later).start() <= depth:
                break
            below.append(later)
        assert any("Aggregate" in b or "TakeOrdered" in b or "Limit" in b or "ExistingRDD" in b for b in below), line


def test_scans_read_only_the_needed_columns(tables):
    plan = plan_of(QUERIES["event_counts"](tables))
    assert re.search(r"ReadSchema: struct<event_id:bigint,event_type:string>", plan)
    plan = plan_of(QUERIES["bot_candidates"](tables))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_a_hot_product_is_split_by_the_skew_join(spark):
    """Row-level joins leave a hot key to adaptive execution; it splits the partition of a product with most items."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        from tradewind.operators.clean import clean_order_items

        items = spark.range(0, 60_000, 1, 6).select(
            "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("product_id"),
            (F.col("id") % 90 + 0.5).alias("sale_price"), F.sha2(F.col("id").cast("string"), 256).alias("status"),
        )
        catalog = spark.range(500).select("id", F.lit(2.0).alias("cost"), F.lit("c").alias("category"))
        joined = clean_order_items(items, catalog)
        rows_out = joined.select(F.length("status").alias("n"), "gross_profit")
        rows_out.collect()
        assert "skew=true" in plan_of(rows_out)
        assert joined.count() == 60_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_items_are_joined_before_anything_is_added_to_them(spark):
    """What an item carries through the shuffles of its two joins: its own columns, then also those of its user."""
    items = spark.createDataFrame(
        [(1, 10, 5, 7, "Complete", 3.0), (2, 10, None, 7, None, 0.0), (3, 11, 5, None, "Returned", None)],
        "id long, order_id long, user_id long, product_id long, status string, sale_price double",
    ).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("created_at", "shipped_at", "delivered_at")})
    products = spark.createDataFrame(
        [(7, 1.0, "a", "n", "b", 4.0, "d", 2)],
        "id long, cost double, category string, name string, brand string, retail_price double, department string, distribution_center_id long",
    )
    users = spark.createDataFrame([(5, 30, "F", "x", "y", "z")], "id long, age long, gender string, country string, city string, traffic_source string")
    df = clean.enrich_transactions(items, products, users)
    above, *joins = df._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
    assert len(joins) == 2 and "product_id" in joins[0].split("\n")[0] and "user_id" in joins[1].split("\n")[0]
    assert all(f"AS {c}#" in above and f"AS {c}#" not in "".join(joins) for c in ("margin", "month", "is_returned", "ship_days"))
    assert df.columns[:3] == ["user_id", "product_id", "id"] and df.columns[-5:] == ["age", "gender", "country", "city", "user_traffic_source"]
    found = {r.id: (r.user_id, r.product_name, r.gross_profit, r.margin, r.user_traffic_source, r.is_recognized) for r in df.collect()}
    assert found == {
        1: (5, "n", 2.0, 2.0 / 3.0, "z", True), 2: (None, "n", -1.0, None, None, False), 3: (5, None, None, None, "z", False),
    }
