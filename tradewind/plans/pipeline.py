"""From raw tables to the written star schema, the quality report, the analyses and the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradewind.functions.durable import durable
from tradewind.operators import basket, clean, clusters, customers, forecast, funnel, operations, quality, revenue, series, star
from tradewind.params import Params
from tradewind.sources.readers import load_star
from tradewind.sources.schemas import RawTables, StarSchema
from tradewind.sources.sinks import save_results, save_star, write_result


def build_fact(raw: RawTables, params: Params = Params()) -> DataFrame:
    items = clean.revenue_items(clean.clean_order_items(raw.order_items, raw.products, params))
    fact = star.build_fact_transactions(items, clean.orders_for_analysis(raw.orders, params), params)
    return fact


def build_rfm(raw: RawTables, params: Params = Params()) -> DataFrame:
    items = clean.revenue_items(clean.clean_order_items(raw.order_items, raw.products, params))
    return customers.create_rfm(clean.orders_for_analysis(raw.orders, params), items, params)


def build_star(raw: RawTables, params: Params = Params()) -> StarSchema:
    return StarSchema(
        fact_transactions=build_fact(raw, params),
        agg_funnel_monthly=star.build_agg_funnel_monthly(raw.events),
        fact_inventory=star.build_fact_inventory(clean.clean_inventory(raw.inventory, params)),
        dim_users=star.build_dim_users(clean.clean_users(raw.users, params), build_rfm(raw, params)),
        dim_products=star.build_dim_products(raw.products),
        dim_dcs=star.build_dim_dcs(raw.dcs),
        dim_date=star.build_dim_date(star.spine_bounds(raw.dcs, params)),
    )


def run_etl(raw: RawTables, folder: str, params: Params = Params(), formats=("parquet", "csv")) -> dict[str, int]:
    """Writes the star schema under `processed` and the quality results under `interim`; returns row counts."""
    processed, interim = f"{folder}/processed", f"{folder}/interim"
    counts = save_star(build_star(raw, params), processed, formats)
    written = load_star(raw.orders.sparkSession, processed)
    items = clean.clean_order_items(raw.order_items, raw.products, params)
    scored = written.dim_users.where(F.col("Frequency") > 0)
    report = durable(quality.quality_report(raw, written.fact_transactions, params, dict(written.items()), scored))
    write_result(report, f"{interim}/quality_summary.json", "json")
    save_results(
        {
            "validation_summary": report,
            "table_profile": quality.profile_tables(raw),
            "column_profile": quality.profile_columns(raw),
            "event_sources": quality.event_source_checks(raw.events, raw.users),
            "bot_candidates": quality.bot_candidates(raw.events, params),
        },
        interim,
    )
    save_results(quality.issue_samples(raw, items, params), f"{interim}/quality_samples")
    return counts


def star_analyses(
    tables: StarSchema, events: DataFrame | None, orders: DataFrame | None, params: Params = Params()
) -> dict[str, DataFrame]:
    """The analyses on a star schema. Without raw events the funnels come from the monthly table."""
    fact = star.ensure_revenue_columns(tables.fact_transactions, params)
    products, users, stock = tables.dim_products, tables.dim_users, tables.fact_inventory
    categories = revenue.category_performance(fact, products)
    monthly = tables.agg_funnel_monthly
    results = {
        "rfm_segment_analysis": customers.rfm_segmentation(users),
        "cohort_retention_analysis": customers.cohort_retention(fact),
        "ltv_cac_analysis": customers.ltv_cac(users, params),
        "status_leakage_analysis": revenue.status_leakage(fact, params),
        "annual_revenue_analysis": revenue.annual_revenue(fact, params),
        "category_performance_analysis": categories,
        "return_cost_analysis": revenue.return_costs(fact, params),
        "funnel_analysis": funnel.funnel(events) if events is not None else funnel.funnel_from_monthly(monthly),
        "journey_funnel_by_source": (
            funnel.journey_by_source(events) if events is not None else funnel.journey_from_monthly(monthly)
        ),
        "traffic_source_performance": (
            funnel.traffic_source_performance(events) if events is not None else funnel.traffic_source_from_monthly(monthly)
        ),
        "basket_affinity_analysis": basket.basket_affinity(fact, products),
        "price_band_performance": revenue.price_band_performance(fact, products),
        "inventory_turnover_analysis": operations.inventory_turnover(stock),
        "holding_cost_analysis": operations.holding_cost(stock),
        "inventory_abc_aging_by_category_dc": operations.inventory_abc_aging(stock, tables.dim_dcs, categories),
        "return_cancel_root_cause_proxy": operations.root_cause_proxy(fact, products, orders, params),
    }
    results["fulfillment_performance"] = operations.fulfillment(orders) if orders is not None else operations.no_fulfillment(fact)
    return results


def raw_analyses(raw: RawTables, params: Params = Params()) -> dict[str, DataFrame]:
    """The independent analyses on raw tables. Item rows, customers and sessions are each computed once."""
    items = durable(clean.enrich_transactions(raw.order_items, raw.products, raw.users, params))
    buyers = durable(customers.customer_table(items, raw.users))
    visits = durable(funnel.sessions(raw.events))
    cutoff = operations.stock_cutoff(items, raw.inventory)
    aged = operations.age_inventory(raw.inventory, cutoff)
    by_center = operations.inventory_by_center(aged, raw.dcs)
    monthly = series.monthly_revenue(items)
    return {
        "quality_checks": quality.raw_quality_checks(raw),
        "items_by_status": revenue.items_by_status(items),
        "transaction_kpis": revenue.transaction_kpis(items, raw.orders),
        "customers_by_source": customers.customers_by_source(buyers),
        "customers_by_demographics": customers.customers_by_demographics(buyers),
        "customer_value_segments": customers.customer_value_segments(buyers),
        "customer_summary": customers.customer_summary(buyers),
        "product_categories": revenue.product_categories(items),
        "product_brands": revenue.product_brands(items),
        "product_price_bands": revenue.product_price_bands(items),
        "event_counts": funnel.value_counts(raw.events, "event_type"),
        "source_counts": funnel.value_counts(raw.events, "traffic_source"),
        "session_funnel": funnel.session_funnel(visits),
        "monthly_sessions": funnel.monthly_sessions(visits),
        "marketing_summary": funnel.marketing_summary(visits, raw.events),
        "inventory_by_center": by_center,
        "inventory_by_category": operations.inventory_by_category(aged),
        "center_stock_vs_demand": operations.center_stock_vs_demand(by_center, items),
        "returns_by_delivery_time": operations.returns_by_delivery_time(items),
        "fulfillment_summary": operations.fulfillment_summary(items),
        "inventory_summary": operations.inventory_summary(aged, cutoff),
        "monthly_revenue": monthly,
        "revenue_forecast": series.revenue_forecast(monthly),
        "revenue_forecast_summary": series.revenue_forecast_summary(monthly),
    }


def model_results(tables: StarSchema, params: Params = Params(), k: int | None = None, top_n: int = 3) -> dict[str, DataFrame]:
    """Clusters, forecasts and their summary."""
    fact = star.ensure_revenue_columns(tables.fact_transactions, params)
    enriched = clusters.enriched_rfm(fact, tables.dim_users, tables.dim_products)
    clustered = durable(clusters.kmeans_clusters(enriched, k))
    monthly = durable(series.monthly_category_series(fact, tables.dim_products))
    evaluation = durable(forecast.forecast_evaluation(monthly, top_n))
    return {
        "clustering_analysis": clustered,
        "dim_users_with_clusters": clusters.users_with_clusters(tables.dim_users, clustered),
        "cluster_profile_summary": clusters.cluster_profile(clustered),
        "demand_forecast_12m": forecast.forecast_top_categories(monthly, top_n),
        "demand_forecast_evaluation": evaluation,
        "demand_forecast_backtest_summary": forecast.forecast_backtest(monthly, top_n),
        "demand_forecast_12m_tuned": forecast.tuned_forecast(monthly, top_n),
        "demand_forecast_tuning": forecast.tune_forecast(monthly, top_n),
        "demand_forecast_regressor_metrics": forecast.calendar_effect(monthly, top_n),
        "demand_forecast_seasonal_naive": series.seasonal_naive_forecast(series.regular_monthly(monthly)),
        "model_summary": forecast.model_report(clustered, evaluation),
    }


def run_star_analyses(
    spark: SparkSession, folder: str, events: DataFrame | None, orders: DataFrame | None,
    params: Params = Params(), fmt: str = "csv",
) -> None:
    """Reads the written star schema and writes every analysis next to it."""
    tables = load_star(spark, f"{folder}/processed")
    save_results(star_analyses(tables, events, orders, params), f"{folder}/processed", fmt)


def run_models(spark: SparkSession, folder: str, params: Params = Params(), fmt: str = "csv") -> None:
    tables = load_star(spark, f"{folder}/processed")
    save_results(model_results(tables, params), f"{folder}/processed", fmt)
