"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradewind.functions.durable import durable
from tradewind.functions.numeric import percent, ratio0
from tradewind.functions.temporal import parse_utc
from tradewind.operators import basket, clean, clusters, customers, forecast, funnel, operations, quality, revenue, series, star
from tradewind.plans import pipeline
from tradewind.session import tune
from tradewind.sources.adapter import ADAPTER_PARAMS as P, adapt
from tradewind.sources.readers import fill_users, typed
from tradewind.sources.schemas import FUNNEL_EVENT_COLUMNS

#: Years of the test orders, as columns of the cohort matrix.
COHORT_YEARS = range(1992, 1999)


class Tables:
    """The raw and derived tables of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def raw(self):
        return adapt(self.spark, self.folder)

    @cached_property
    def clean_items(self):
        return clean.clean_order_items(self.raw.order_items, self.raw.products, P)

    @cached_property
    def fact(self):
        return star.ensure_revenue_columns(pipeline.build_fact(self.raw, P), P)

    @cached_property
    def rfm(self):
        return pipeline.build_rfm(self.raw, P)

    @cached_property
    def dim_users(self):
        return star.build_dim_users(clean.clean_users(self.raw.users, P), self.rfm)

    @cached_property
    def dim_products(self):
        return star.build_dim_products(self.raw.products)

    @cached_property
    def dim_dcs(self):
        return star.build_dim_dcs(self.raw.dcs)

    @cached_property
    def fact_inventory(self):
        return star.build_fact_inventory(clean.clean_inventory(self.raw.inventory, P))

    @cached_property
    def funnel_monthly(self):
        return star.build_agg_funnel_monthly(self.raw.events)

    @cached_property
    def flagged(self):
        return clean.flag_items(self.raw.order_items, P)

    @cached_property
    def items(self):
        return clean.flag_items(clean.with_products(self.raw.order_items, self.raw.products), P)

    @cached_property
    def customers(self):
        return customers.customer_table(self.items, self.raw.users)

    @cached_property
    def sessions(self):
        return funnel.sessions(self.raw.events)

    @cached_property
    def cutoff(self):
        return operations.stock_cutoff(self.raw.order_items, self.raw.inventory)

    @cached_property
    def aged(self):
        return operations.age_inventory(self.raw.inventory, self.cutoff)

    @cached_property
    def by_center(self):
        return operations.inventory_by_center(self.aged, self.raw.dcs)

    @cached_property
    def monthly(self):
        return series.monthly_category_series(self.fact, self.dim_products)

    @cached_property
    def regular(self):
        return series.regular_monthly(self.monthly)

    @cached_property
    def enriched(self):
        return clusters.enriched_rfm(self.fact, self.dim_users, self.dim_products)


def _parsed_times(t: Tables) -> DataFrame:
    """Order dates written as text in several forms, some of them unreadable."""
    text = F.expr(
        """case when order_id % 5 = 0 then 'not a date'
                when order_id % 5 = 1 then concat(cast(created_at as string), ' UTC')
                when order_id % 5 = 2 then concat(cast(created_at as string), '+02:00')
                else cast(created_at as string) end"""
    )
    return t.raw.orders.select("order_id", parse_utc(text).alias("created_at"))


def _shares(t: Tables) -> DataFrame:
    counts = t.raw.orders.groupBy("status").agg(
        F.count("returned_at").alias("returned"), F.count("shipped_at").alias("shipped")
    )
    return counts.select(
        "status", percent("returned", "shipped").alias("share_pct"), ratio0("returned", "shipped").alias("share")
    )


def _dim_date(t: Tables) -> DataFrame:
    return star.build_dim_date(
        t.raw.orders.agg(F.min("created_at").alias("start"), F.max("created_at").alias("end"))
    )


def _issue_samples(t: Tables) -> DataFrame:
    """The eight samples as (sample, key)."""
    samples = quality.issue_samples(t.raw, t.clean_items, P)
    return quality.union(
        [
            df.select(F.lit(name).alias("sample"), F.col("id" if "id" in df.columns else "order_id").alias("key"))
            for name, df in samples.items()
        ]
    )


def _table_summary(t: Tables) -> DataFrame:
    """Rows and dates of the star schema."""

    def row(name: str, df: DataFrame, first, last) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table"),
            F.count("*").alias("rows"),
            F.lit(len(df.columns)).alias("columns"),
            first.cast("string").alias("min_date"),
            last.cast("string").alias("max_date"),
        )

    none = F.lit(None)
    fact = pipeline.build_fact(t.raw, P)
    day = F.col("created_at").cast("date")
    return quality.union(
        [
            row("fact_transactions", fact, F.min(day), F.max(day)),
            row("agg_funnel_monthly", t.funnel_monthly, F.min("year_month"), F.max("year_month")),
            row("fact_inventory", t.fact_inventory, none, none),
            row("dim_users", t.dim_users, none, none),
            row("dim_products", t.dim_products, none, none),
            row("dim_dcs", t.dim_dcs, none, none),
            row("dim_date", _dim_date(t), F.min("date"), F.max("date")),
        ]
    )


def _quality_report(t: Tables) -> DataFrame:
    processed = {
        "fact_transactions": t.fact, "agg_funnel_monthly": t.funnel_monthly, "fact_inventory": t.fact_inventory,
        "dim_users": t.dim_users, "dim_products": t.dim_products, "dim_dcs": t.dim_dcs, "dim_date": _dim_date(t),
    }
    return quality.quality_report(t.raw, t.fact, P, processed, t.rfm)


def _typed_orders(t: Tables) -> DataFrame:
    """Orders written as text with the forms of a missing or unreadable value, and typed again."""
    number = F.expr("order_id % 11")
    texts = t.raw.orders.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.when(number == 0, "x").when(number == 1, "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(number == 2, "null").when(number == 3, "N/A").otherwise(F.col("status")).alias("status"),
        F.lit("nan").alias("gender"),
        F.when(number == 4, "never").otherwise(F.concat(F.col("created_at").cast("string"), F.lit("+00:00"))).alias("created_at"),
        F.coalesce(F.col("returned_at").cast("string"), F.lit("")).alias("returned_at"),
        F.coalesce(F.concat(F.col("shipped_at").cast("string"), F.lit(" UTC")), F.lit("NaN")).alias("shipped_at"),
        F.col("delivered_at"),
        F.when(number == 5, "two").otherwise(F.col("num_of_item").cast("string")).alias("num_of_item"),
    )
    return typed(texts, "orders")


def _typed_events(t: Tables) -> DataFrame:
    """Events written as text, where only the empty text is missing, narrowed to the columns of the funnels."""
    number = F.expr("id % 7")
    texts = t.raw.events.select(
        *[F.col(c).cast("string").alias(c) for c in ("id", "user_id", "event_type")],
        F.when(number == 0, "").when(number == 1, "null").otherwise(F.col("session_id")).alias("session_id"),
        F.when(number == 2, "NA").when(number == 3, "").otherwise(F.col("traffic_source")).alias("traffic_source"),
        "created_at",
    )
    return typed(texts, "events", FUNNEL_EVENT_COLUMNS)


def _filled_users(t: Tables) -> DataFrame:
    """Users joined to their scores, some without any, as the analyses read them."""
    users = t.raw.users.select(F.col("id").alias("user_id"))
    scores = t.rfm.select("user_id", "Frequency", "Monetary", "return_rate_pct", "rfm_segment")
    return fill_users(users.join(scores, "user_id", "left"))


def _kmeans(t: Tables) -> DataFrame:
    return clusters.kmeans_clusters(t.enriched)


def _cluster_costs(enriched: DataFrame) -> DataFrame:
    return clusters.choose_cluster_count(durable(clusters.standardize(enriched)))[1]


def _cluster_count(t: Tables) -> DataFrame:
    return _cluster_costs(durable(t.enriched))


def _properties(row: DataFrame) -> DataFrame:
    """One row of counts as (property, value)."""
    cells = [F.struct(F.lit(c).alias("property"), F.col(c).cast("bigint").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*cells)))


def _cluster_count_checks(t: Tables) -> DataFrame:
    """What must hold for the costs of all candidate counts, whatever the starts."""
    enriched = durable(t.enriched)
    costs = durable(_cluster_costs(enriched)).withColumn("_before", F.lag("inertia").over(Window.orderBy("k")))
    everyone = enriched.agg(F.count("*")).scalar() * len(clusters.CLUSTER_FEATURES)
    return _properties(
        costs.agg(
            F.count("*").alias("candidates"),
            F.min("k").alias("least_k"),
            F.max("k").alias("most_k"),
            F.count_if("chosen").alias("chosen"),
            F.count_if(F.col("inertia") > F.col("_before")).alias("cost_rises"),
            F.count_if((F.col("inertia") < 0) | (F.col("inertia") > everyone)).alias("costs_beyond_total_variance"),
            F.count_if(~F.col("converged")).alias("not_converged"),
        )
    )


def _kmeans_checks(t: Tables) -> DataFrame:
    """Every user once, every cluster named, names in order of value."""
    clustered = durable(_kmeans(t))
    profile = clusters.cluster_profile(clustered)
    rank = F.row_number().over(Window.orderBy(F.col("Monetary").desc(), "Recency"))
    expected = F.element_at(F.array(*map(F.lit, clusters.CLUSTER_NAMES)), rank)
    misnamed = profile.withColumn("_name", expected).agg(F.count_if(F.col("cluster_label") != F.col("_name"))).scalar()
    return _properties(
        clustered.agg(
            F.count("*").alias("users"),
            F.countDistinct("user_id").alias("distinct_users"),
            F.count_if(F.col("cluster_label").isNull()).alias("unnamed"),
            misnamed.alias("names_out_of_order"),
            F.count_if((F.col("cluster") < 0) | (F.col("cluster") > 6)).alias("clusters_out_of_range"),
        )
    )


def _forecast_checks(t: Tables) -> DataFrame:
    """Months and model of the forecast, and whether it lies in its band."""
    made = forecast.forecast_top_categories(t.monthly)
    in_band = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper")) & (F.col("mape_pct") >= 0)
    return made.select("category", "ds", "model_type", in_band.alias("in_band"))


def _tuned_checks(t: Tables) -> DataFrame:
    band = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return forecast.tuned_forecast(t.monthly).select("category", "ds", band.alias("in_band"))


def _evaluation_checks(t: Tables) -> DataFrame:
    return forecast.forecast_evaluation(t.monthly).withColumn("known", F.col("mape_pct") >= 0).drop("mape_pct")


def _backtest_checks(t: Tables) -> DataFrame:
    """A mean absolute error is never above the root of the mean square, and both pages agree on the percentage."""
    spans = forecast.forecast_evaluation(t.monthly).select("category", F.col("mape_pct").alias("_mape"))
    errors = forecast.forecast_backtest(t.monthly).join(spans, "category")
    agree = F.col("mape_pct") == F.col("_mape")
    return errors.select("category", ((F.col("mae") <= F.col("rmse")) & (F.col("mae") >= 0) & agree).alias("consistent"))


def _tuning_checks(t: Tables) -> DataFrame:
    """The best of the grid is in the grid and no worse than the default, which is one of the grid."""
    best, default = forecast.tune_forecast(t.monthly), forecast.forecast_evaluation(t.monthly)
    in_grid = (
        F.col("trend_scale").isin(*forecast.TREND_SCALES)
        & F.col("season_scale").isin(*forecast.SEASON_SCALES)
        & F.col("event_scale").isin(*forecast.EVENT_SCALES)
        & F.col("mode").isin(*forecast.MODES)
    )
    joined = best.join(default.select("category", "mape_pct"), "category")
    return joined.select("category", in_grid.alias("in_grid"), (F.col("best_mape_pct") <= F.col("mape_pct")).alias("no_worse"))


def _calendar_checks(t: Tables) -> DataFrame:
    """Without the calendar the error is that of the best parameter set."""
    joined = forecast.calendar_effect(t.monthly).join(forecast.tune_forecast(t.monthly), "category")
    same = F.col("mape_pct_plain") == F.col("best_mape_pct")
    return joined.select("category", same.alias("same_without"), (F.col("mape_pct_calendar") >= 0).alias("known_with"))


def _model_report(t: Tables) -> DataFrame:
    return forecast.model_report(durable(_kmeans(t)), durable(forecast.forecast_evaluation(t.monthly)))


def _model_report_checks(t: Tables) -> DataFrame:
    """Each metric of the report and whether its value is one that can be."""
    value, number = F.col("value"), F.col("value").try_cast("double")
    holds = (
        F.when(F.col("metric") == "cluster_count", number.between(2, 7))
        .when(F.col("metric") == "top_cluster", value.isin(*clusters.CLUSTER_NAMES))
        .when(F.col("metric") == "model_type", value.isin(forecast.MODEL_TYPE, forecast.FALLBACK_TYPE))
        .when(F.col("metric") == "top_category_mape_pct", number >= 0)
        .otherwise(value == "Baseline only")
    )
    return _model_report(t).select("section", "metric", holds.alias("holds"))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # Cleaning, features, star schema.
    "parse_times": _parsed_times,
    "clean_users": lambda t: clean.clean_users(t.raw.users, P),
    "clean_orders": lambda t: clean.clean_orders(t.raw.orders, P),
    "clean_order_items": lambda t: t.clean_items,
    "clean_inventory": lambda t: clean.clean_inventory(t.raw.inventory, P),
    "fact_transactions": lambda t: pipeline.build_fact(t.raw, P),
    "fact_inventory": lambda t: t.fact_inventory,
    "dim_users": lambda t: t.dim_users,
    "dim_products": lambda t: t.dim_products,
    "dim_dcs": lambda t: t.dim_dcs,
    "dim_date": _dim_date,
    "ensure_revenue_columns": lambda t: star.ensure_revenue_columns(
        pipeline.build_fact(t.raw, P).select("order_item_id", "date_key", "sale_price", "gross_profit", "status"), P
    ),
    "price_bands": lambda t: t.fact.groupBy(revenue.sale_price_band("sale_price").alias("price_band")).agg(
        F.count("*").alias("items")
    ),
    "safe_shares": _shares,
    "enrich_transactions": lambda t: clean.enrich_transactions(
        t.raw.order_items, t.raw.products, t.raw.users, P
    ),
    "agg_funnel_monthly": lambda t: t.funnel_monthly,
    # Data quality.
    "profile_tables": lambda t: quality.profile_tables(t.raw),
    "profile_columns": lambda t: quality.profile_columns(t.raw),
    "order_date_checks": lambda t: quality.order_date_checks(t.raw.orders),
    "order_status_checks": lambda t: quality.order_status_checks(t.raw.orders),
    "event_source_checks": lambda t: quality.event_source_checks(t.raw.events, t.raw.users),
    "session_time_checks": lambda t: quality.session_time_checks(t.raw.events),
    "user_checks": lambda t: quality.user_checks(t.raw.users, P),
    "product_checks": lambda t: quality.product_checks(t.raw.products),
    "center_checks": lambda t: quality.center_checks(t.raw.dcs),
    "item_checks": lambda t: quality.item_checks(t.clean_items),
    "foreign_key_checks": lambda t: quality.foreign_key_checks(t.raw),
    "issue_samples": _issue_samples,
    "bot_candidates": lambda t: quality.bot_candidates(t.raw.events, P),
    "scope_reconciliation": lambda t: quality.scope_reconciliation(t.raw.orders, t.raw.order_items, t.fact, P),
    "raw_quality_checks": lambda t: quality.raw_quality_checks(t.raw),
    "quality_report": _quality_report,
    "typed_orders": _typed_orders,
    "typed_events": _typed_events,
    "filled_users": _filled_users,
    # Star-schema analyses.
    "rfm": lambda t: t.rfm,
    "rfm_segmentation": lambda t: customers.rfm_segmentation(t.dim_users),
    "cohort_retention": lambda t: customers.cohort_retention(t.fact),
    "cohort_matrix": lambda t: customers.cohort_matrix(customers.cohort_retention(t.fact), COHORT_YEARS),
    "ltv_cac": lambda t: customers.ltv_cac(t.dim_users, P),
    "status_leakage": lambda t: revenue.status_leakage(t.fact, P),
    "annual_revenue": lambda t: revenue.annual_revenue(t.fact, P),
    "category_performance": lambda t: revenue.category_performance(t.fact, t.dim_products),
    "return_costs": lambda t: revenue.return_costs(t.fact, P),
    "funnel": lambda t: funnel.funnel(t.raw.events),
    "funnel_from_monthly": lambda t: funnel.funnel_from_monthly(t.funnel_monthly),
    "journey_by_source": lambda t: funnel.journey_by_source(t.raw.events),
    "journey_from_monthly": lambda t: funnel.journey_from_monthly(t.funnel_monthly),
    "traffic_source_performance": lambda t: funnel.traffic_source_performance(t.raw.events),
    "traffic_source_from_monthly": lambda t: funnel.traffic_source_from_monthly(t.funnel_monthly),
    "basket_affinity": lambda t: basket.basket_affinity(t.fact, t.dim_products),
    "price_band_performance": lambda t: revenue.price_band_performance(t.fact, t.dim_products),
    "inventory_turnover": lambda t: operations.inventory_turnover(t.fact_inventory),
    "holding_cost": lambda t: operations.holding_cost(t.fact_inventory),
    "inventory_abc_aging": lambda t: operations.inventory_abc_aging(
        t.fact_inventory, t.dim_dcs, revenue.category_performance(t.fact, t.dim_products)
    ),
    "fulfillment": lambda t: operations.fulfillment(t.raw.orders),
    "root_cause_proxy": lambda t: operations.root_cause_proxy(t.fact, t.dim_products, t.raw.orders, P),
    # Raw-table analyses.
    "items_by_status": lambda t: revenue.items_by_status(t.raw.order_items),
    "transaction_kpis": lambda t: revenue.transaction_kpis(t.items, t.raw.orders),
    "customer_table": lambda t: t.customers,
    "customers_by_source": lambda t: customers.customers_by_source(t.customers),
    "customers_by_demographics": lambda t: customers.customers_by_demographics(t.customers),
    "customer_value_segments": lambda t: customers.customer_value_segments(t.customers),
    "customer_summary": lambda t: customers.customer_summary(t.customers),
    "product_categories": lambda t: revenue.product_categories(t.items),
    "product_brands": lambda t: revenue.product_brands(t.items),
    "product_price_bands": lambda t: revenue.product_price_bands(t.items),
    "event_counts": lambda t: funnel.value_counts(t.raw.events, "event_type"),
    "source_counts": lambda t: funnel.value_counts(t.raw.events, "traffic_source"),
    "sessions": lambda t: t.sessions,
    "session_funnel": lambda t: funnel.session_funnel(t.sessions),
    "monthly_sessions": lambda t: funnel.monthly_sessions(t.sessions),
    "marketing_summary": lambda t: funnel.marketing_summary(t.sessions, t.raw.events),
    "inventory_by_center": lambda t: t.by_center,
    "inventory_by_category": lambda t: operations.inventory_by_category(t.aged),
    "center_stock_vs_demand": lambda t: operations.center_stock_vs_demand(t.by_center, t.items),
    "returns_by_delivery_time": lambda t: operations.returns_by_delivery_time(t.flagged),
    "fulfillment_summary": lambda t: operations.fulfillment_summary(t.flagged),
    "inventory_summary": lambda t: operations.inventory_summary(t.aged, t.cutoff),
    "monthly_revenue": lambda t: series.monthly_revenue(t.items),
    "revenue_forecast": lambda t: series.revenue_forecast(series.monthly_revenue(t.items)),
    "revenue_forecast_summary": lambda t: series.revenue_forecast_summary(series.monthly_revenue(t.items)),
    # Variants.
    "table_summary": _table_summary,
    "order_value_kpis": lambda t: revenue.order_value_kpis(t.fact, t.fact_inventory),
    "signup_cohorts": lambda t: customers.signup_cohorts(t.fact, t.raw.users),
    "first_purchase_cohorts": lambda t: customers.signup_cohorts(t.fact),
    "gmv_annual": lambda t: revenue.gmv_annual(t.fact, P),
    "gmv_category": lambda t: revenue.gmv_category(t.fact, t.dim_products),
    "returns_by_category": lambda t: revenue.returns_by_category(t.fact, t.dim_products, P),
    "monthly_funnel_rates": lambda t: funnel.monthly_funnel_rates(t.funnel_monthly),
    "purchase_intensity": lambda t: funnel.purchase_intensity(t.funnel_monthly),
    "monthly_stage_trend": lambda t: funnel.monthly_stage_trend(t.funnel_monthly),
    "deduplicated_gmv_series": lambda t: series.deduplicated_gmv_series(t.fact, t.dim_products),
    "rolling_mean": lambda t: series.rolling_mean(series.deduplicated_gmv_series(t.fact, t.dim_products)),
    "series_gaps": lambda t: series.series_gaps(series.deduplicated_gmv_series(t.fact, t.dim_products)),
    "train_validation_split": lambda t: series.train_validation_split(t.regular),
    "backtest_metrics": lambda t: series.backtest_metrics(series.seasonal_naive_backtest(t.regular)),
    "tune_forecast": lambda t: forecast.tune_forecast(t.monthly),
    "calendar_effect": lambda t: forecast.calendar_effect(t.monthly),
    # Models.
    "enriched_rfm": lambda t: t.enriched,
    "rule_clusters": lambda t: clusters.rule_clusters(t.enriched),
    "cluster_profile": lambda t: clusters.cluster_profile(clusters.rule_clusters(t.enriched)),
    "users_with_clusters": lambda t: clusters.users_with_clusters(t.dim_users, clusters.rule_clusters(t.enriched)),
    "cluster_count": _cluster_count,
    "cluster_count_checks": _cluster_count_checks,
    "kmeans_checks": _kmeans_checks,
    "kmeans_clusters": _kmeans,
    "kmeans_profile": lambda t: clusters.cluster_profile(_kmeans(t)),
    "monthly_category_series": lambda t: t.monthly,
    "regular_monthly": lambda t: t.regular,
    "top_categories": lambda t: series.top_categories(t.monthly, 3),
    "seasonal_naive_forecast": lambda t: series.seasonal_naive_forecast(t.regular),
    "forecast_top_categories": lambda t: forecast.forecast_top_categories(t.monthly),
    "forecast_backtest": lambda t: forecast.forecast_backtest(t.monthly),
    "tuned_forecast": lambda t: forecast.tuned_forecast(t.monthly),
    "forecast_evaluation": lambda t: forecast.forecast_evaluation(t.monthly),
    "model_report": _model_report,
    "forecast_checks": _forecast_checks,
    "forecast_evaluation_checks": _evaluation_checks,
    "forecast_backtest_checks": _backtest_checks,
    "tune_forecast_checks": _tuning_checks,
    "tuned_forecast_checks": _tuned_checks,
    "calendar_effect_checks": _calendar_checks,
    "model_report_checks": _model_report_checks,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query(Tables(tune(spark), folder))

    return {name: bind(query) for name, query in QUERIES.items()}
