import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by, rows
from tradewind.functions.durable import durable
from tradewind.operators import clusters, forecast


@pytest.fixture(scope="module")
def enriched(tables):
    return durable(tables.enriched)


@pytest.fixture(scope="module")
def monthly(tables):
    return durable(tables.monthly)


def test_elbow_takes_the_smallest_second_difference():
    # Second differences 10, 25, 2, 1 and 45, -20, 23, 1.
    assert clusters.elbow([100, 60, 30, 25, 22, 20]) == 6
    assert clusters.elbow([100, 50, 45, 20, 18, 17]) == 4
    assert clusters.elbow([10, 5]) == 6


def test_labels_follow_value_then_recency(spark):
    profile = spark.createDataFrame([(0, 5.0, 10.0), (1, 50.0, 9.0), (2, 5.0, 3.0)], "cluster int, Monetary double, Recency double")
    assert by(clusters.label_clusters(profile), "cluster", "cluster_label") == {
        1: "High-Value Loyal", 2: "Selective Buyers", 0: "At-Risk High Value",
    }


def test_features_are_standardized(enriched):
    values = clusters.standardize(enriched)
    for i in range(len(clusters.CLUSTER_FEATURES)):
        mean, deviation = values.agg(F.avg(F.col("scaled")[i]), F.stddev_pop(F.col("scaled")[i])).first()
        assert abs(mean) < 1e-9 and abs(deviation - 1) < 1e-9


def test_constant_features_are_only_centred(enriched):
    same = enriched.withColumn("aov", F.lit(3.0))
    values = clusters.standardize(same).select(F.col("scaled")[2]).distinct().collect()
    assert [r[0] for r in values] == [0.0]


def lloyd(x, centers, tolerance=1e-4, rounds=100):
    """Plain k-means from given centers."""
    for done in range(1, rounds + 1):
        own = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        moved, centers = ((new - centers) ** 2).sum(), new
        if moved <= tolerance:
            break
    return centers, ((x[:, None] - centers) ** 2).sum(2).min(1).sum(), done


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, (150, 3)) for m in ((0, 0, 0), (9, 0, 0), (0, 9, 4), (-7, -7, 2))])
    return x, durable(spark.createDataFrame([(r.tolist(),) for r in x], "scaled array<double>").repartition(5))


def test_all_starts_agree_with_plain_rounds(blobs):
    x, vectors = blobs
    picked = vectors.orderBy(F.xxhash64("scaled"), "scaled").limit(4096).collect()
    sample = np.array([r["scaled"] for r in picked])
    fits = clusters.fit_kmeans(vectors, [2, 4, 5], restarts=3)
    for fit in fits:
        runs = [lloyd(x, clusters.starting_centers(sample, fit.k, 42 + start)) for start in range(3)]
        centers, cost, rounds = runs[fit.start]
        assert fit.converged and fit.rounds == rounds and np.allclose(fit.centers, centers, atol=1e-5)
        assert math.isclose(fit.cost, cost, rel_tol=1e-5) and cost <= min(r[1] for r in runs) * (1 + 1e-5)
    assert fits[0].cost > fits[1].cost > fits[2].cost


def test_sums_do_not_depend_on_the_partitions(blobs):
    _, vectors = blobs
    a, b = (clusters.fit_kmeans(vectors.repartition(n, "scaled"), [4], restarts=2)[0] for n in (1, 7))
    assert (a.centers == b.centers).all() and a.cost == b.cost


def test_rounds_that_end_too_early_are_told(blobs):
    (fit,) = clusters.fit_kmeans(blobs[1], [5], restarts=1, max_iter=1)
    assert fit.rounds == 1 and not fit.converged


def test_one_pass_a_round(blobs, monkeypatch):
    passes = []
    once = clusters._sum_up
    monkeypatch.setattr(clusters, "_sum_up", lambda vectors, runs: passes.append(len(runs)) or once(vectors, runs))
    fits = clusters.fit_kmeans(blobs[1], [2, 3, 4], restarts=4)
    assert passes[0] == passes[-1] == 12 and len(passes) >= max(f.rounds for f in fits) + 1
    assert all(a >= b for a, b in zip(passes[:-1], passes[1:-1]))


def test_a_pass_holds_a_bounded_block_and_its_sums_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(5000, 3)), [[9e4, -9e4, 0.0]] * 3, np.zeros((700, 3))])
    vectors = spark.createDataFrame([(r.tolist(),) for r in x], "scaled array<double>").repartition(3).union(spark.createDataFrame([(None,)], "scaled array<double>"))
    blocks = clusters.packed(vectors)
    sizes = [r[0] for r in blocks.select(F.length("block") / 24).collect()]
    assert sum(sizes) == len(x) and max(sizes) <= clusters.BLOCK_ROWS
    runs = [x[:2], x[[4, 5, 6]], x[[7, 7]]]  # the second center of the last run is never the first of the nearest
    found = clusters._sum_up(blocks, runs)
    for nr, centers in enumerate(runs):
        away = clusters._distances(x, centers)
        own = away.argmin(axis=1)
        for c in range(len(centers)):
            parts = [int(p) for p in np.rint(away[own == c, c] * clusters.UNIT)]
            n, sums, squares = found[nr, c]
            assert n == (own == c).sum() and squares == float(sum(parts)) / clusters.UNIT
            assert sums.tolist() == [float(sum(int(v) for v in np.rint(f * clusters.UNIT))) / clusters.UNIT for f in x[own == c].T]


def test_kmeans_labels_every_user_in_order_of_value(enriched):
    clustered = durable(clusters.kmeans_clusters(enriched, k=5, restarts=2))
    assert clustered.count() == enriched.count() and clustered.where("cluster_label is null").count() == 0
    profile = clusters.cluster_profile(clustered).orderBy(F.col("Monetary").desc(), "Recency").collect()
    assert [r["cluster_label"] for r in profile] == list(clusters.CLUSTER_NAMES[:5])
    # Users without a purchase are far from all others.
    assert clustered.where("Frequency = 0").select("cluster").distinct().count() == 1


def test_cluster_count_lists_all_candidates(enriched):
    chosen, costs = clusters.choose_cluster_count(durable(clusters.standardize(enriched)), restarts=1)
    table = by(costs, "k", "inertia", "chosen")
    assert costs.columns == ["k", "inertia", "rounds", "converged", "chosen"]
    assert sorted(table) == [2, 3, 4, 5, 6, 7] and [k for k, (_, c) in table.items() if c] == [chosen]


def test_users_get_their_cluster(tables, enriched):
    named = clusters.users_with_clusters(tables.dim_users, clusters.rule_clusters(enriched))
    assert named.count() == tables.dim_users.count() and named.where("cluster_label is null").count() == 0


def seasonal(spark, months=60):
    data = [
        ("shoes", dt.date(2018 + m // 12, m % 12 + 1, 1), 1000.0 + 10 * m + 200 * math.sin(2 * math.pi * m / 12))
        for m in range(months)
    ]
    short = [("hats", dt.date(2022, m, 1), 50_000.0) for m in range(1, 13)]
    return spark.createDataFrame(data + short, "category string, ds date, revenue double")


def test_forecast_follows_trend_and_season(spark):
    got = forecast.forecast_top_categories(seasonal(spark)).orderBy("ds").collect()
    assert [r["ds"] for r in got] == [dt.date(2023, m, 1) for m in range(1, 13)]  # the short series is left out
    for i, r in enumerate(got):
        expected = 1000 + 10 * (60 + i) + 200 * math.sin(2 * math.pi * i / 12)
        assert abs(r["yhat"] - expected) / expected < 0.05
        assert r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] and r["mape_pct"] < 5


def test_evaluation_describes_the_holdout(spark):
    r = forecast.forecast_evaluation(seasonal(spark)).first()
    assert (r["category"], r["train_months"], r["test_months"]) == ("shoes", 48, 12)
    assert (r["train_start"], r["train_end"]) == (dt.date(2018, 1, 1), dt.date(2021, 12, 1))


def test_tuning_beats_or_equals_the_default(spark):
    series = seasonal(spark)
    tuned = forecast.tune_forecast(series).first()
    assert tuned["best_mape_pct"] <= forecast.forecast_evaluation(series).first()["mape_pct"]
    assert tuned["mode"] in forecast.MODES and len(forecast.parameter_grid()) == 24
    effect = forecast.calendar_effect(series).first()
    assert effect["mape_pct_plain"] == tuned["best_mape_pct"] and effect["mape_pct_calendar"] >= 0


def test_tuned_forecast_uses_the_calendar(spark):
    series = seasonal(spark)
    got = forecast.tuned_forecast(series).orderBy("ds").collect()
    assert [r["ds"] for r in got] == [dt.date(2023, m, 1) for m in range(1, 13)]
    for i, r in enumerate(got):
        expected = 1000 + 10 * (60 + i) + 200 * math.sin(2 * math.pi * i / 12)
        assert abs(r["yhat"] - expected) / expected < 0.1
    errors = forecast.forecast_backtest(series).first()
    assert errors["mape_pct"] == forecast.forecast_evaluation(series).first()["mape_pct"]
    assert 0 <= errors["mae"] <= errors["rmse"]


def test_report_names_the_largest_cluster(spark):
    clustered = spark.createDataFrame([("a",), ("b",), ("b",)], "cluster_label string")
    evaluation = spark.createDataFrame([("m", 10.0), ("m", 20.5)], "model_type string, mape_pct double")
    assert by(forecast.model_report(clustered, evaluation), "metric", "value") == {
        "cluster_count": "2", "top_cluster": "b", "model_type": "m", "top_category_mape_pct": "15.25",
        "use_for_demand_planning": "Baseline only",
    }


def test_a_series_that_cannot_be_fitted_falls_back_alone(spark):
    """A month whose loss equals the largest value has no logarithm, so the multiplicative fit of that series fails."""
    from tradewind.operators.series import regular_monthly, seasonal_naive_forecast

    months = [(2018 + m // 12, m % 12 + 1) for m in range(60)]
    good = [("shoes", dt.date(y, m, 1), 1000.0 + 100 * m) for y, m in months]
    bad = [("hats", dt.date(y, m, 1), -90_000.0 if i == 30 else 5000.0 + i) for i, (y, m) in enumerate(months)]
    params = forecast.FitParams(mode="multiplicative")
    schema = "category string, ds date, revenue double"
    alone = forecast.forecast_top_categories(spark.createDataFrame(good, schema), params=params)
    frame = spark.createDataFrame(good + bad, schema)
    both = forecast.forecast_top_categories(frame, params=params)
    assert {r.category: r.model_type for r in both.collect()} == {"shoes": "trend_season_ridge", "hats": "seasonal_naive_fallback"}
    assert rows(both.where("category = 'shoes'")) == rows(alone)
    naive = seasonal_naive_forecast(regular_monthly(frame)).where("category = 'hats'")
    assert rows(both.where("category = 'hats'").drop("model_type")) == rows(naive)
    evaluation = by(forecast.forecast_evaluation(frame, params=params), "category", "model_type", "mape_pct")
    assert evaluation["hats"] == ("seasonal_naive_fallback", naive.first()["mape_pct"]) and evaluation["shoes"][0] == "trend_season_ridge"


def test_parameter_sets_that_fail_are_never_the_best(spark):
    months = [dt.date(2018 + m // 12, m % 12 + 1, 1) for m in range(60)]
    frame = spark.createDataFrame([("hats", d, -90_000.0 if i == 30 else 5000.0 + i) for i, d in enumerate(months)], "category string, ds date, revenue double")
    assert forecast.tune_forecast(frame).first()["mode"] == "additive"
