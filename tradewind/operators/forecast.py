"""Demand forecast of the largest categories.

Every series is fitted on its own by a small ridge regression on trend, season and calendar columns, so all
series and parameter sets run side by side. The seasonal-naive forecast in `series` is the baseline.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.durable import durable
from tradewind.functions.numeric import mean, round_even
from tradewind.operators.series import (
    HORIZON, backtest_metrics, regular_monthly, seasonal_naive_backtest, seasonal_naive_forecast, top_categories,
)

MODEL_TYPE = "trend_season_ridge"
FALLBACK_TYPE = "seasonal_naive_fallback"

# Searched parameters, sale months and the fourth quarter.
TREND_SCALES = (0.01, 0.05, 0.1)
SEASON_SCALES = (5.0, 10.0)
EVENT_SCALES = (5.0, 10.0)
MODES = ("additive", "multiplicative")
SALE_MONTHS = (6, 8, 12)
Q4_MONTHS = (10, 11, 12)

# The fitting functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BAND = 1.2816  # eighty percent of a normal distribution
SEASON_ORDER = 4


@dataclass(frozen=True)
class FitParams:
    """Prior widths: a smaller one holds its coefficients closer to zero."""

    trend_scale: float = 0.05
    season_scale: float = 10.0
    event_scale: float = 10.0
    mode: str = "additive"
    calendar: bool = False


def parameter_grid(calendar: bool = False) -> list[FitParams]:
    return [
        FitParams(t, s, e, m, calendar)
        for t, s, e, m in itertools.product(TREND_SCALES, SEASON_SCALES, EVENT_SCALES, MODES)
    ]


def _columns(ds: pd.Series, first: pd.Timestamp, months: int, p: FitParams) -> tuple[np.ndarray, np.ndarray]:
    """Design matrix and the prior width of each column."""
    at = pd.to_datetime(ds)
    step = ((at.dt.year - first.year) * 12 + at.dt.month - first.month).to_numpy(float)
    t = step / max(months - 1, 1)
    blocks = [(np.ones_like(t), 100.0), (t, 5.0)]
    blocks += [(np.maximum(t - knot, 0.0), p.trend_scale) for knot in np.linspace(0, 0.8, 10)[1:]]
    angle = 2 * np.pi * step / 12
    for order in range(1, SEASON_ORDER + 1):
        blocks += [(np.sin(order * angle), p.season_scale), (np.cos(order * angle), p.season_scale)]
    if p.calendar:
        month = at.dt.month
        blocks += [((month == m).to_numpy(float), p.event_scale) for m in SALE_MONTHS]
        blocks.append((month.isin(Q4_MONTHS).to_numpy(float), p.event_scale))
    return np.column_stack([b for b, _ in blocks]), np.array([w for _, w in blocks])


def _fit_predict(train: pd.DataFrame, ds: pd.Series, p: FitParams) -> tuple[np.ndarray, float]:
    """Predictions for `ds` and the residual deviation, both on the scale of y."""
    y = train["y"].to_numpy(float)
    top = max(float(np.max(np.abs(y))), 1.0)
    # A multiplicative season adds up in logarithms.
    target = np.log1p(y / top) if p.mode == "multiplicative" else y / top
    first, months = pd.Timestamp(train["ds"].iloc[0]), len(train)
    x, width = _columns(train["ds"], first, months, p)
    noise = 0.1
    coefficients = np.linalg.solve(x.T @ x + np.diag((noise / width) ** 2), x.T @ target)

    def back(values: np.ndarray) -> np.ndarray:
        return top * (np.expm1(values) if p.mode == "multiplicative" else values)

    fitted = back(x @ coefficients)
    return back(_columns(ds, first, months, p)[0] @ coefficients), float(np.std(y - fitted))


def _fit(requests: DataFrame, grid: list[FitParams]) -> DataFrame:
    """One fit per (category, fold, params) group of `requests`, which holds the series (ds, y) of each.

    Fold `test` holds out the last twelve months and predicts them, fold `future` predicts the next twelve. A fit that
    cannot be made, or gives no finite number, has no predictions; the other groups are not touched by it.
    """

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        category, fold, i = key
        group = group.sort_values("ds").reset_index(drop=True)
        if fold == "test":
            train, ask = group.iloc[:-HORIZON], group.iloc[-HORIZON:]
            ds, actual = ask["ds"].reset_index(drop=True), ask["y"].to_numpy(float)
        else:
            train = group
            last = pd.Timestamp(group["ds"].iloc[-1])
            ds = pd.Series([(last + pd.DateOffset(months=h)).date() for h in range(1, HORIZON + 1)])
            actual = np.full(HORIZON, np.nan)
        try:
            with np.errstate(all="ignore"):
                yhat, spread = _fit_predict(train, ds, grid[i])
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            yhat, spread = np.full(HORIZON, np.nan), np.nan
        if not (np.isfinite(yhat).all() and np.isfinite(spread)):
            yhat = np.full(HORIZON, np.nan)
        return pd.DataFrame(
            {
                "category": category,
                "fold": fold,
                "params": i,
                "ds": ds,
                "actual": actual,
                "yhat": yhat,
                "yhat_lower": yhat - BAND * spread,
                "yhat_upper": yhat + BAND * spread,
            }
        )

    schema = (
        "category string, fold string, params int, ds date, actual double, yhat double, "
        "yhat_lower double, yhat_upper double"
    )
    return (
        requests.select("category", "ds", "y", "fold", "params")
        .groupBy("category", "fold", "params")
        .applyInPandas(fit, schema)
    )


def _fit_all(regular: DataFrame, grid: list[FitParams], *folds: str) -> DataFrame:
    """Every series with every parameter set in every fold."""
    return _fit(
        regular.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn(
            "params", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))
        ),
        grid,
    )


def eligible_series(monthly: DataFrame, top_n: int = 3, least_months: int = 24) -> DataFrame:
    """Gap-free series of the largest categories that are long enough to hold out a year.

    Kept, because fits, errors and spans are all taken from these few rows.
    """
    regular = regular_monthly(top_categories(monthly, top_n))
    months = F.count("*").over(Window.partitionBy("category"))
    return durable(regular.withColumn("_n", months).where(F.col("_n") >= least_months).drop("_n"))


def _fits(series: DataFrame, params: FitParams) -> tuple[DataFrame, DataFrame]:
    """Both folds of every series, and (category, fallback): true where a fold has no predictions."""
    fitted = durable(_fit_all(series, [params], "test", "future"))
    return fitted, fitted.groupBy("category").agg((F.count("yhat") < F.count("*")).alias("fallback"))


def _or_naive(future: DataFrame, series: DataFrame, fates: DataFrame) -> DataFrame:
    """Forecast rows with `model_type`; a series with `fallback` has the rows of the seasonal-naive forecast instead."""
    columns = ["category", "ds", "yhat", "yhat_lower", "yhat_upper", "mape_pct"]
    fates = F.broadcast(fates)  # a row per category of the top
    fitted = future.join(fates, "category").where(~F.col("fallback")).select(*columns, F.lit(MODEL_TYPE).alias("model_type"))
    naive = seasonal_naive_forecast(series).join(fates, "category").where("fallback")
    return fitted.unionByName(naive.select(*columns, F.lit(FALLBACK_TYPE).alias("model_type")))


def forecast_top_categories(monthly: DataFrame, top_n: int = 3, params: FitParams = FitParams()) -> DataFrame:
    """Twelve months ahead with bands and the backtest error.

    A series whose fit fails gets the seasonal-naive forecast with its error; `model_type` tells which of the two it is.
    """
    series = eligible_series(monthly, top_n)
    fitted, fates = _fits(series, params)
    tests = fitted.where(F.col("fold") == "test").select("category", "ds", "actual", F.col("yhat").alias("predicted"))
    errors = backtest_metrics(tests).select("category", round_even("mape_pct", 2).alias("mape_pct"))
    future = fitted.where(F.col("fold") == "future").join(F.broadcast(errors), "category", "left")
    return _or_naive(future, series, fates)


def _errors(series: DataFrame, params: FitParams) -> DataFrame:
    """Backtest errors and the model type per category, of the seasonal-naive forecast where the fit fails."""
    fitted, fates = _fits(series, params)
    tests = fitted.where(F.col("fold") == "test").select("category", "ds", "actual", F.col("yhat").alias("predicted"))
    both = tests.withColumn("naive", F.lit(False)).unionByName(seasonal_naive_backtest(series).withColumn("naive", F.lit(True)))
    used = both.join(F.broadcast(fates), "category").where(F.col("naive") == F.col("fallback"))
    kind = F.when(F.col("fallback"), FALLBACK_TYPE).otherwise(MODEL_TYPE)
    return backtest_metrics(used).join(F.broadcast(fates.select("category", kind.alias("model_type"))), "category")


def forecast_backtest(monthly: DataFrame, top_n: int = 3, params: FitParams = FitParams()) -> DataFrame:
    """MAE, RMSE and MAPE of the held-out year per category."""
    errors = _errors(eligible_series(monthly, top_n), params)
    return errors.select("category", *[round_even(c, 2).alias(c) for c in ("mae", "rmse", "mape_pct")])


def forecast_evaluation(monthly: DataFrame, top_n: int = 3, params: FitParams = FitParams()) -> DataFrame:
    """Backtest span and error per category."""
    series = eligible_series(monthly, top_n)
    errors = _errors(series, params).select("category", round_even("mape_pct", 2).alias("mape_pct"), "model_type")
    spans = series.groupBy("category").agg(
        F.count("*").alias("_n"), F.min("ds").alias("train_start"), F.max("ds").alias("_last")
    )
    return spans.join(F.broadcast(errors), "category", "left").select(
        "category",
        (F.col("_n") - HORIZON).alias("train_months"),
        F.lit(HORIZON).alias("test_months"),
        "mape_pct",
        "train_start",
        F.add_months("_last", -HORIZON).alias("train_end"),
        "model_type",
    )


def _grid_errors(series: DataFrame, grid: list[FitParams]) -> DataFrame:
    """Backtest error per category and parameter set; null where the fit failed."""
    tests = _fit_all(series, grid, "test")
    ape = F.when(F.col("actual") != 0, F.abs(F.try_divide(F.col("actual") - F.col("yhat"), F.col("actual"))))
    error = F.when(F.count("yhat") == F.count("*"), mean(ape) * 100)
    return tests.groupBy("category", "params").agg(error.alias("mape"))


def _best(condition: Column) -> Column:
    """The parameter set with the smallest error among those that could be fitted."""
    return F.min(F.when(F.col("mape").isNotNull() & condition, F.struct("mape", "params")))


def tune_forecast(monthly: DataFrame, top_n: int = 3) -> DataFrame:
    """The parameter set with the smallest backtest error per category; null where none could be fitted."""
    grid = parameter_grid()
    cells = [
        F.struct(*[F.lit(v).alias(k) for k, v in asdict(p).items() if k != "calendar"]) for p in grid
    ]
    best = _grid_errors(eligible_series(monthly, top_n), grid).groupBy("category").agg(_best(F.lit(True)).alias("best"))
    return best.select(
        "category",
        round_even("best.mape", 2).alias("best_mape_pct"),
        F.get(F.array(*cells), F.col("best.params")).alias("p"),
    ).select("category", "best_mape_pct", "p.*")


def tuned_forecast(monthly: DataFrame, top_n: int = 3) -> DataFrame:
    """Twelve months ahead with each category's best parameters and the calendar columns, seasonal-naive where no fit can be made."""
    series = eligible_series(monthly, top_n)
    best = _grid_errors(series, parameter_grid()).groupBy("category").agg(F.coalesce(_best(F.lit(True))["params"], F.lit(0)).alias("params"))
    requests = series.join(F.broadcast(best), "category")  # top_n rows
    fitted = durable(_fit(requests.withColumn("fold", F.lit("future")), parameter_grid(calendar=True)))
    fates = fitted.groupBy("category").agg((F.count("yhat") < F.count("*")).alias("fallback"))
    future = fitted.withColumn("mape_pct", F.lit(None).cast("double"))
    return _or_naive(future, series, fates).select("category", "ds", "yhat", "yhat_lower", "yhat_upper")


def calendar_effect(monthly: DataFrame, top_n: int = 3) -> DataFrame:
    """Backtest error of the best parameter set per category, and of the same set with the calendar columns added."""
    plain, events = parameter_grid(), parameter_grid(calendar=True)
    best = _best(F.col("params") < len(plain))
    # One entry per parameter set.
    return (
        _grid_errors(eligible_series(monthly, top_n), plain + events)
        .groupBy("category")
        .agg(best.alias("best"), F.map_from_entries(F.collect_list(F.struct("params", "mape"))).alias("at"))
        .select(
            "category",
            round_even("best.mape", 2).alias("mape_pct_plain"),
            round_even(F.try_element_at("at", F.col("best.params") + len(plain)), 2).alias("mape_pct_calendar"),
        )
    )


def model_report(clustered: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(section, metric, value): cluster count, largest cluster, model and mean error."""
    sizes = clustered.groupBy("cluster_label").agg(F.count("*").alias("n"))
    clusters = sizes.agg(
        F.count("*").cast("string").alias("cluster_count"),
        F.max_by("cluster_label", F.struct("n", "cluster_label")).alias("top_cluster"),
    )
    forecast = evaluation.agg(
        F.coalesce(F.min("model_type"), F.lit("unknown")).alias("model_type"),
        round_even(mean("mape_pct"), 2).cast("string").alias("top_category_mape_pct"),
        F.lit("Baseline only").alias("use_for_demand_planning"),
    )

    def rows(section: str, row: DataFrame) -> DataFrame:
        cells = [
            F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.col(c).alias("value"))
            for c in row.columns
        ]
        return row.select(F.inline(F.array(*cells)))

    return rows("Clustering", clusters).unionByName(rows("Forecasting", forecast))
