"""Event funnels, journeys by source and web sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.functions.numeric import flag_total, percent, ratio, ratio0, round_even
from tradewind.functions.reshape import with_row
from tradewind.functions.temporal import elapsed_seconds, year_month

# Stages in funnel order.
FUNNEL_STAGES = ("product", "cart", "purchase", "cancel")
JOURNEY_STAGES = ("home", "department", "product", "cart", "purchase", "cancel")


def _by_key(key: str, *measures: str) -> Column:
    """Aggregate of at most a handful of rows: key to its measures."""
    return F.map_from_entries(F.collect_list(F.struct(key, F.struct(*measures).alias("m"))))


def _stage_rows(summary: DataFrame, users: str) -> DataFrame:
    """Stage rows with conversion from the stage before. `summary` has one row per event type."""
    at = (
        summary.where(F.col("event_type").isin(*FUNNEL_STAGES))
        .agg(_by_key("event_type", "event_count", "sessions", users).alias("at"))
    )

    def stage(i: int) -> Column:
        cell = F.try_element_at("at", F.lit(FUNNEL_STAGES[i]))
        before = F.try_element_at("at", F.lit(FUNNEL_STAGES[i - 1])) if i else None
        events = F.coalesce(cell["event_count"], F.lit(0))

        def conversion(value: Column, measure: str) -> Column:
            if before is None:
                return F.lit(100.0)
            return ratio(value, before[measure]) * 100

        return F.struct(
            F.lit(FUNNEL_STAGES[i]).alias("stage"),
            events.alias("event_count"),
            cell["sessions"].alias("sessions"),
            cell[users].alias(users),
            conversion(events, "event_count").alias("event_conversion_from_prev_pct"),
            conversion(cell["sessions"], "sessions").alias("session_conversion_from_prev_pct"),
            conversion(cell[users], users).alias("user_conversion_from_prev_pct"),
        )

    return at.select(F.inline(F.array(*[stage(i) for i in range(len(FUNNEL_STAGES))])))


def funnel(events: DataFrame) -> DataFrame:
    """Product, cart, purchase, cancel: events, distinct sessions and users, conversion from stage to stage."""
    summary = (
        events.where(F.col("event_type").isin(*FUNNEL_STAGES))
        .groupBy("event_type")
        .agg(
            F.count("id").alias("event_count"),
            F.countDistinct("session_id").alias("sessions"),
            F.countDistinct("user_id").alias("global_unique_users"),
        )
    )
    return _stage_rows(summary, "global_unique_users")


def funnel_from_monthly(agg_funnel_monthly: DataFrame) -> DataFrame:
    """The funnel without raw events. Monthly users can only be added up, hence `user_months`; no sessions."""
    summary = agg_funnel_monthly.groupBy("event_type").agg(
        F.sum("event_count").alias("event_count"),
        F.lit(None).cast("bigint").alias("sessions"),
        F.sum("unique_users").alias("user_months"),
    )
    return _stage_rows(summary, "user_months")


def _journey(sources: DataFrame, users: str) -> DataFrame:
    """Complete source by stage grid from one row per source: its totals and the map `at` of its stages."""
    stages = F.array(*[F.lit(s) for s in JOURNEY_STAGES])
    cell = F.try_element_at("at", F.col("event_type"))

    def sessions_of(stage: str) -> Column:
        found = F.try_element_at("at", F.lit(stage))
        return F.when(found.isNull(), 0).otherwise(found["sessions"])

    def measure(name: str) -> Column:
        return F.when(cell.isNotNull(), cell[name]).otherwise(F.lit(0)).alias(name)

    return (
        sources.select("*", F.posexplode(stages).alias("_pos", "event_type"))
        .select(
            "traffic_source",
            "event_type",
            measure("event_count"),
            measure("sessions"),
            measure(users),
            "source_event_count",
            "source_sessions",
            f"source_{users}",
            (F.col("_pos") + 1).alias("stage_order"),
            percent(sessions_of("cart"), sessions_of("product")).alias("product_to_cart_session_cvr_pct"),
            percent(sessions_of("purchase"), sessions_of("product")).alias("product_to_purchase_session_cvr_pct"),
            percent(sessions_of("purchase"), sessions_of("cart")).alias("cart_to_purchase_session_cvr_pct"),
        )
        .withColumn("event_share_within_source_pct", percent("event_count", "source_event_count"))
        .withColumn("session_reach_within_source_pct", percent("sessions", "source_sessions"))
        .withColumn("user_reach_within_source_pct", percent(users, f"source_{users}"))
    )


def _stages_by(events: DataFrame, owner: str, name: str) -> DataFrame:
    """One row per source with, for each stage and for all its events, how many and of how many distinct owners.

    Events are reduced to one row per source and owner first; a missing owner is none.
    """
    whole = len(JOURNEY_STAGES)
    of_stage = [F.col("event_type") == s for s in JOURNEY_STAGES] + [F.lit(True)]
    seen = [F.count_if(of).alias(f"_seen{i}") for i, of in enumerate(of_stage)]
    counted = [F.count(F.when(of, F.col("id"))).alias(f"_events{i}") for i, of in enumerate(of_stage)]
    per_owner = events.groupBy("traffic_source", owner).agg(*seen, *counted)
    known = F.col(owner).isNotNull()
    cells = [
        F.struct(
            F.sum(f"_events{i}").alias("event_count"),
            F.count_if(known & (F.col(f"_seen{i}") > 0)).alias(name),
            F.sum(f"_seen{i}").alias("seen"),
        )
        for i in range(whole + 1)
    ]
    return per_owner.groupBy("traffic_source").agg(*[c.alias(f"_{name}{i}") for i, c in enumerate(cells)])


def journey_by_source(events: DataFrame) -> DataFrame:
    """Six stages per source, absent ones as zero, with shares of the source and session conversion.

    Events are reduced to sessions of a source and to users of a source, each with a count per stage, and these to sources;
    so a distinct count is a count of rows, and no event is multiplied.
    """
    known = events.where(F.col("traffic_source").isNotNull())
    whole = len(JOURNEY_STAGES)
    # One row per source from here on.
    both = _stages_by(known, "session_id", "sessions").join(_stages_by(known, "user_id", "unique_users"), "traffic_source")
    entries = [
        F.when(
            F.col(f"_sessions{i}.seen") > 0,
            F.struct(
                F.lit(stage).alias("event_type"),
                F.struct(f"_sessions{i}.event_count", f"_sessions{i}.sessions", f"_unique_users{i}.unique_users").alias("m"),
            ),
        )
        for i, stage in enumerate(JOURNEY_STAGES)
    ]
    sources = both.select(
        "traffic_source",
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("at"),
        F.col(f"_sessions{whole}.event_count").alias("source_event_count"),
        F.col(f"_sessions{whole}.sessions").alias("source_sessions"),
        F.col(f"_unique_users{whole}.unique_users").alias("source_unique_users"),
    )
    return _journey(sources, "unique_users")


def journey_from_monthly(agg_funnel_monthly: DataFrame) -> DataFrame:
    """The journey without raw events: no sessions, and monthly users added up."""
    grouped = agg_funnel_monthly.groupBy("traffic_source", "event_type").agg(
        F.sum("event_count").alias("event_count"),
        F.lit(None).cast("bigint").alias("sessions"),
        F.sum("unique_users").alias("user_months"),
    )
    sources = grouped.groupBy("traffic_source").agg(
        F.sum("event_count").alias("source_event_count"),
        F.max("sessions").alias("source_sessions"),
        F.sum("user_months").alias("source_user_months"),
        _by_key("event_type", "event_count", "sessions", "user_months").alias("at"),
    )
    return _journey(sources, "user_months")


def traffic_source_performance(events: DataFrame) -> DataFrame:
    return (
        events.where((F.col("event_type") == "purchase") & F.col("traffic_source").isNotNull())
        .groupBy("traffic_source")
        .agg(
            F.count("id").alias("purchase_events"),
            F.countDistinct("user_id").alias("global_unique_users"),
            F.countDistinct("session_id").alias("sessions"),
        )
        .withColumn(
            "purchase_events_per_global_user", round_even(ratio("purchase_events", "global_unique_users"), 2)
        )
    )


def traffic_source_from_monthly(agg_funnel_monthly: DataFrame) -> DataFrame:
    """Traffic sources without raw events: no sessions, and monthly users added up."""
    return (
        agg_funnel_monthly.where(F.col("event_type") == "purchase")
        .groupBy("traffic_source")
        .agg(
            F.sum("event_count").alias("purchase_events"),
            F.sum("unique_users").alias("user_months"),
            F.lit(None).cast("bigint").alias("sessions"),
        )
        .withColumn("purchase_events_per_user_month", round_even(ratio("purchase_events", "user_months"), 2))
    )


def purchase_intensity(agg_funnel_monthly: DataFrame) -> DataFrame:
    """Purchase events per monthly user by source, from the monthly table."""
    return (
        agg_funnel_monthly.where(F.col("event_type") == "purchase")
        .groupBy("traffic_source")
        .agg(F.sum("event_count").alias("event_count"), F.sum("unique_users").alias("user_months"))
        .withColumn("purchase_events_per_user_month", ratio("event_count", "user_months"))
    )


def monthly_funnel_rates(agg_funnel_monthly: DataFrame) -> DataFrame:
    """Overall rates from the monthly table in one row."""

    def events(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("event_count"))), F.lit(0))

    row = agg_funnel_monthly.agg(*[events(k).alias(f"{k}_events") for k in FUNNEL_STAGES])
    attempts = F.col("cart_events") + F.col("purchase_events") + F.col("cancel_events")
    return row.select(
        "*",
        percent("cart_events", "product_events", None).alias("product_to_cart_pct"),
        percent("purchase_events", "cart_events", None).alias("cart_to_purchase_pct"),
        percent("purchase_events", "product_events", None).alias("product_to_purchase_pct"),
        percent("cancel_events", attempts, None).alias("cancel_proxy_pct"),
    )


def monthly_stage_trend(agg_funnel_monthly: DataFrame) -> DataFrame:
    return (
        agg_funnel_monthly.where(F.col("event_type").isin("product", "cart", "purchase"))
        .groupBy("year_month", "event_type")
        .agg(F.sum("event_count").alias("event_count"))
    )


def value_counts(events: DataFrame, column: str) -> DataFrame:
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("events"))


def sessions(events: DataFrame) -> DataFrame:
    """One row per session: first source, start, end, stage flags, minutes and bounce.

    Every part is a minimum, maximum or count, so even one huge session is reduced before the shuffle.
    """
    source = F.col("traffic_source")
    first_source = F.min_by(source, F.when(source.isNotNull(), F.struct("sequence_number", "id")))

    def seen(stage: str) -> Column:
        hit = (F.col("event_type") == stage) & F.col("id").isNotNull()
        return F.coalesce(F.max(F.when(hit, 1)), F.lit(0)).alias(stage)

    return (
        events.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            first_source.alias("traffic_source"),
            F.min("created_at").alias("start"),
            F.max("created_at").alias("end"),
            F.count("id").alias("event_count"),
            *[seen(s) for s in JOURNEY_STAGES],
        )
        .withColumn("duration_min", elapsed_seconds("end", "start") / 60)
        .withColumn("bounce", F.col("event_count") == 1)
    )


def session_funnel(sessions: DataFrame) -> DataFrame:
    """Session counts and rates per source; a missing source is a group."""
    return (
        sessions.groupBy("traffic_source")
        .agg(
            F.count("session_id").alias("sessions"),
            *[flag_total(s).alias(f"{s}_sessions") for s in FUNNEL_STAGES],
            flag_total("bounce").alias("bounce_sessions"),
            ratio(F.sum("event_count"), F.count("event_count")).alias("avg_events"),
        )
        .withColumn("product_rate", ratio("product_sessions", "sessions"))
        .withColumn("cart_rate", ratio("cart_sessions", "product_sessions"))
        .withColumn("purchase_rate", ratio("purchase_sessions", "sessions"))
        .withColumn("cart_to_purchase", ratio("purchase_sessions", "cart_sessions"))
        .withColumn("cancel_per_cart", ratio("cancel_sessions", "cart_sessions"))
        .withColumn("bounce_rate", ratio("bounce_sessions", "sessions"))
    )


def monthly_sessions(sessions: DataFrame) -> DataFrame:
    return (
        sessions.withColumn("month", year_month("start"))
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(
            F.count("session_id").alias("sessions"),
            flag_total("purchase").alias("purchases"),
            flag_total("cart").alias("carts"),
        )
        .withColumn("purchase_rate", ratio("purchases", "sessions"))
    )


def marketing_summary(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Seven figures in one row."""
    row = sessions.agg(
        F.count("session_id").alias("sessions"),
        flag_total("purchase").alias("_purchases"),
        flag_total("cart").alias("_carts"),
        flag_total("bounce").alias("_bounces"),
        F.sum("event_count").alias("_events"),
    )
    every = events.agg(F.count("*").alias("n"), F.count_if(F.col("user_id").isNull()).alias("anonymous"))
    return with_row(row, every, "every").select(
        "sessions",
        F.col("every.n").alias("events"),
        ratio0("_purchases", "sessions").alias("overall_purchase_session_rate"),
        ratio0("_purchases", "_carts").alias("overall_cart_to_purchase"),
        ratio0("_bounces", "sessions").alias("overall_bounce_rate"),
        ratio0("every.anonymous", "every.n").alias("anonymous_event_pct"),
        ratio("_events", "sessions").alias("avg_events_per_session"),
    )
