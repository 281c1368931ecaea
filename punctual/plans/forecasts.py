"""Forecast methods over many series at once.

Every method takes the framed series (``series_key, ds, y, part``) and returns
``series_key, method, ds, y, yhat`` for the test days. The baselines are plain
aggregates and joins. The fitted methods run one small least-squares problem per
series: ``groupBy(series_key).applyInPandas`` hands a task one daily series, at
most a few thousand rows, and the number of series sets the parallelism.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.plans.series import (
    WEEKLY_PERIOD,
    WEEKLY_TERMS,
    YEARLY_PERIOD,
    YEARLY_TERMS,
    holiday_calendar,
    holiday_offsets,
    near_holiday,
    tail,
)

# fixed values: method names
NAIVE = "Naive Baseline"
SEASONAL = "7-Day Seasonal Naive"
WEEKDAY = "Recent Weekday Average"
MEAN_28 = "Recent 28-Day Mean"
AR_FIXED = "AR(1)(1)7"
AR_AUTO = "Auto AR"
AR_HOLIDAY = "Auto AR + holiday"
CALENDAR = "Calendar regression + holidays"

RESULT = "series_key string, method string, ds date, y double, yhat double"
MAX_ORDER = 3
# fixed value: days of history that a fit needs
MIN_TRAIN_DAYS = 90
WEEK = 7
# fixed values: published defaults of the additive calendar model
CHANGEPOINTS, CHANGEPOINT_RANGE, CHANGEPOINT_SCALE = 25, 0.8, 0.05
SEASON_SCALE, HOLIDAY_SCALE, BASE_SCALE = 10.0, 10.0, 5.0


def train(framed: DataFrame) -> DataFrame:
    return framed.where("part = 'train'")


def test_days(framed: DataFrame) -> DataFrame:
    return framed.where("part = 'test'").select("series_key", "ds", "y")


def _forecast(days: DataFrame, method: str, yhat: Column | str = "yhat") -> DataFrame:
    yhat = F.col(yhat) if isinstance(yhat, str) else yhat
    return days.select("series_key", F.lit(method).alias("method"), "ds", "y", yhat.alias("yhat"))


def naive_last(framed: DataFrame) -> DataFrame:
    last = train(framed).groupBy("series_key").agg(F.max_by("y", "ds").alias("yhat"))
    return _forecast(test_days(framed).join(last, "series_key"), NAIVE)


def seasonal_naive(framed: DataFrame, season: int = WEEK) -> DataFrame:
    """The last ``season`` values repeated in order."""
    recent = tail(train(framed), season)
    size = F.max("back").over(Window.partitionBy("series_key"))
    recent = recent.select("series_key", "back", size.alias("size"), F.col("y").alias("yhat"))
    recent = recent.withColumn("slot", F.col("size") - F.col("back"))
    order = Window.partitionBy("series_key").orderBy("ds")
    days = test_days(framed).withColumn("step", F.row_number().over(order) - 1)
    sizes = recent.groupBy("series_key").agg(F.max("size").alias("cycle"))
    days = days.join(sizes, "series_key").withColumn("slot", F.col("step") % F.col("cycle"))
    return _forecast(days.join(recent.select("series_key", "slot", "yhat"), ["series_key", "slot"]), SEASONAL)


def weekday_average(framed: DataFrame, rows: int = 365) -> DataFrame:
    means = (
        tail(train(framed), rows)
        .groupBy("series_key", F.weekday("ds").alias("weekday"))
        .agg(F.avg("y").alias("yhat"))
    )
    days = test_days(framed).withColumn("weekday", F.weekday("ds"))
    return _forecast(days.join(means, ["series_key", "weekday"], "left"), WEEKDAY)


def recent_mean(framed: DataFrame, rows: int = 28) -> DataFrame:
    means = tail(train(framed), rows).groupBy("series_key").agg(F.avg("y").alias("yhat"))
    return _forecast(test_days(framed).join(means, "series_key"), MEAN_28)


def baselines(framed: DataFrame) -> DataFrame:
    methods = (naive_last, seasonal_naive, weekday_average, recent_mean)
    return reduce(DataFrame.unionByName, [m(framed) for m in methods])


def lag_set(p: int, seasonal: int) -> list[int]:
    """Lags of the product of a plain and a weekly autoregressive polynomial."""
    return sorted({i + WEEK * j for i in range(p + 1) for j in range(seasonal + 1)} - {0})


def _design(y: np.ndarray, lags: list[int], start: int, extra: np.ndarray | None) -> np.ndarray:
    columns = [np.ones(len(y) - start)] + [y[start - k: len(y) - k] for k in lags]
    if extra is not None:
        columns.append(extra[start:])
    return np.column_stack(columns)


def _known_rows(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Days whose value and lags are all known; gaps only take out the days that touch them."""
    return np.isfinite(target) & np.isfinite(x).all(axis=1)


def _result(future: pd.DataFrame, method: str, yhat) -> pd.DataFrame:
    """Forecasts of the test days that have a value; without a fit they are null."""
    out = pd.DataFrame(
        {"series_key": future["series_key"], "method": method, "ds": future["ds"], "y": future["y"], "yhat": yhat}
    )
    return out[out["y"].notna()]


def _path_values(y: np.ndarray) -> list[float]:
    """History for the recursion: an unknown day takes the value a week before it, else the mean."""
    mean, path = float(np.nanmean(y)), []
    for i, value in enumerate(y):
        path.append(float(value) if np.isfinite(value) else path[i - WEEK] if i >= WEEK else mean)
    return path


def _autoregression(pdf: pd.DataFrame, lags: list[int], method: str, exogenous: bool, least: int) -> pd.DataFrame:
    pdf = pdf.sort_values("ds")
    past, future = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
    y = past["y"].to_numpy(float)
    start = max(lags, default=0)
    if np.isfinite(y).sum() < max(least, 1) or len(y) <= start:
        return _result(future, method, np.nan)
    x, target = _design(y, lags, start, past["holiday_window"].to_numpy(float) if exogenous else None), y[start:]
    rows = _known_rows(x, target)
    if rows.sum() <= x.shape[1]:
        return _result(future, method, np.nan)
    beta = np.linalg.lstsq(x[rows], target[rows], rcond=None)[0]
    path = _path_values(y)
    for flag in future["holiday_window"].to_numpy(float):
        row = [1.0] + [path[-k] for k in lags] + ([flag] if exogenous else [])
        path.append(float(np.dot(beta, row)))
    return _result(future, method, path[len(y):])


def ar_fixed(framed: DataFrame, least: int = MIN_TRAIN_DAYS) -> DataFrame:
    """Autoregression on lags 1, 7 and 8 with a constant, forecast step by step."""
    return framed.groupBy("series_key").applyInPandas(
        lambda pdf: _autoregression(pdf, lag_set(1, 1), AR_FIXED, False, least), RESULT
    )


def _criteria(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """AIC of all orders of one series, each scored on the same days; no row has a value without enough days."""
    y = pdf.sort_values("ds")["y"].to_numpy(float)
    orders = [(p, q) for p in range(MAX_ORDER + 1) for q in range(MAX_ORDER + 1)]
    everything = lag_set(MAX_ORDER, MAX_ORDER)
    start, aic = max(everything), []
    if np.isfinite(y).sum() >= max(least, 1) and len(y) > start:
        whole, target = _design(y, everything, start, None), y[start:]
        rows = _known_rows(whole, target)
        whole, target = whole[rows], target[rows]
        if len(target) > whole.shape[1]:
            # one set of normal equations holds those of every order
            gram, cross, total = whole.T @ whole, whole.T @ target, float(target @ target)
            for p, q in orders:
                own = [0] + [1 + everything.index(k) for k in lag_set(p, q)]
                beta = np.linalg.lstsq(gram[np.ix_(own, own)], cross[own], rcond=None)[0]
                squares = max(total - float(beta @ cross[own]), 0.0)
                aic.append(len(target) * np.log(max(squares / len(target), 1e-12)) + 2 * (len(own) + 1))
    return pd.DataFrame(
        {
            "series_key": pdf["series_key"].iloc[0], "p": [p for p, _ in orders], "seasonal": [q for _, q in orders],
            "aic": aic or [np.nan] * len(orders),
        }
    )


def order_scores(framed: DataFrame, least: int = MIN_TRAIN_DAYS) -> DataFrame:
    """AIC of every order per series."""
    return train(framed).groupBy("series_key").applyInPandas(
        lambda pdf: _criteria(pdf, least), "series_key string, p int, seasonal int, aic double"
    )


def best_order(scores: DataFrame) -> DataFrame:
    chosen = F.min_by(F.struct("p", "seasonal", "aic"), F.struct("aic", "p", "seasonal"))
    return scores.groupBy("series_key").agg(chosen.alias("o")).select("series_key", "o.p", "o.seasonal", "o.aic")


def ar_auto(framed: DataFrame, orders: DataFrame, holiday: bool = False, least: int = MIN_TRAIN_DAYS) -> DataFrame:
    method = AR_HOLIDAY if holiday else AR_AUTO

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lags = lag_set(int(pdf["p"].iloc[0]), int(pdf["seasonal"].iloc[0]))
        return _autoregression(pdf, lags, method, holiday, least)

    # a series without training days has no order; it stays, without a forecast
    joined = framed.join(orders.select("series_key", "p", "seasonal"), "series_key", "left").na.fill(0, ["p", "seasonal"])
    return joined.groupBy("series_key").applyInPandas(run, RESULT)


def _calendar_matrix(ds: pd.Series, origin: pd.Timestamp, span: float, tags: pd.Series, known: dict) -> np.ndarray:
    t = (ds - origin).dt.days.to_numpy(float) / span
    day = (ds - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
    knots = np.linspace(0, CHANGEPOINT_RANGE, CHANGEPOINTS + 1)[1:]
    blocks = [np.ones_like(t), t] + [np.maximum(t - k, 0) for k in knots]
    for terms, period in ((YEARLY_TERMS, YEARLY_PERIOD), (WEEKLY_TERMS, WEEKLY_PERIOD)):
        for k in range(1, terms + 1):
            blocks += [np.sin(2 * np.pi * k * day / period), np.cos(2 * np.pi * k * day / period)]
    flags = np.zeros((len(t), len(known)))
    for row, names in enumerate(tags):
        for name in names:
            if name in known:
                flags[row, known[name]] = 1.0
    return np.column_stack(blocks + [flags])


def _calendar_fit(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    pdf = pdf.sort_values("ds")
    pdf["ds"] = pd.to_datetime(pdf["ds"])
    past, future = pdf[(pdf["part"] == "train") & pdf["y"].notna()], pdf[pdf["part"] == "test"]
    if len(past) < max(least, 1):
        return _result(future.assign(ds=future["ds"].dt.date), CALENDAR, np.nan)
    y = past["y"].to_numpy(float)
    scale = max(np.abs(y).max(), 1e-9)
    origin = past["ds"].iloc[0]
    span = max(float((past["ds"].iloc[-1] - origin).days), 1.0)
    known = {name: i for i, name in enumerate(sorted({n for names in past["tags"] for n in names}))}
    x = _calendar_matrix(past["ds"], origin, span, past["tags"], known)
    seasonal = 2 * (YEARLY_TERMS + WEEKLY_TERMS)
    widths = np.concatenate(
        [
            np.full(2, BASE_SCALE), np.full(CHANGEPOINTS, CHANGEPOINT_SCALE),
            np.full(seasonal, SEASON_SCALE), np.full(len(known), HOLIDAY_SCALE),
        ]
    )
    target, noise = y / scale, 0.01
    gram, cross = x.T @ x, x.T @ target
    for _ in range(5):
        beta = np.linalg.solve(gram + np.diag(noise / widths**2), cross)
        noise = max(float(np.mean((target - x @ beta) ** 2)), 1e-8)
    ahead = _calendar_matrix(future["ds"], origin, span, future["tags"], known)
    return _result(future.assign(ds=future["ds"].dt.date), CALENDAR, (ahead @ beta) * scale)


def calendar_regression(framed: DataFrame, reach: int, least: int = MIN_TRAIN_DAYS) -> DataFrame:
    """Ridge on piecewise-linear trend, yearly and weekly terms and one effect per holiday and offset."""
    tags = (
        holiday_offsets(holiday_calendar(framed), reach)
        .groupBy("ds")
        .agg(F.collect_set(F.concat_ws("|", "holiday", F.col("day_offset").cast("string"))).alias("tags"))
    )
    empty = F.array().cast("array<string>")
    tagged = framed.join(tags, "ds", "left").withColumn("tags", F.coalesce("tags", empty))
    return tagged.select("series_key", "ds", "y", "part", "tags").groupBy("series_key").applyInPandas(
        lambda pdf: _calendar_fit(pdf, least), RESULT
    )


def with_holiday_flag(framed: DataFrame, reach: int) -> DataFrame:
    return near_holiday(framed, holiday_calendar(framed), reach)


METHODS = (NAIVE, SEASONAL, WEEKDAY, MEAN_28, AR_FIXED, AR_AUTO, AR_HOLIDAY, CALENDAR)
OK, NO_TRAIN, SHORT, NO_TEST, NO_FIT = "ok", "no training days", "too few training days", "no test days", "no forecast"


def with_status(scores: DataFrame, framed: DataFrame, least: int = MIN_TRAIN_DAYS, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """One row per series and method, with its scores or with the reason why it has none."""
    known = framed.groupBy("series_key").agg(
        F.count_if((F.col("part") == "train") & F.col("y").isNotNull()).alias("n_train"),
        F.count_if((F.col("part") == "test") & F.col("y").isNotNull()).alias("n_test"),
    )
    pairs = known.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    # the baselines need one training day, the fits need ``least``
    fitted = F.col("method").isin(AR_FIXED, AR_AUTO, AR_HOLIDAY, CALENDAR)
    status = (
        F.when(F.col("n_train") == 0, NO_TRAIN).when(fitted & (F.col("n_train") < least), SHORT)
        .when(F.col("n_test") == 0, NO_TEST).when(F.col("mae").isNull(), NO_FIT).otherwise(OK)
    )
    return pairs.join(scores, ["series_key", "method"], "left").withColumn("status", status)


def every_method(framed: DataFrame, reach: int, only: DataFrame | None = None) -> DataFrame:
    """Forecasts of all methods; ``only`` (series_key, method) restricts the fits to chosen pairs.

    ``framed`` holds every day of a series; days without a value only count for the fits' grids.
    """
    framed = with_holiday_flag(framed, reach)

    def part(*methods: str) -> DataFrame:
        if only is None:
            return framed
        return framed.join(only.where(F.col("method").isin(*methods)), "series_key", "left_semi")

    searched = part(AR_AUTO, AR_HOLIDAY)
    orders = best_order(order_scores(searched))
    together = reduce(
        DataFrame.unionByName,
        [
            baselines(part(NAIVE, SEASONAL, WEEKDAY, MEAN_28).where("y IS NOT NULL")),
            ar_fixed(part(AR_FIXED)),
            ar_auto(part(AR_AUTO), orders),
            ar_auto(part(AR_HOLIDAY), orders, holiday=True),
            calendar_regression(part(CALENDAR), reach),
        ],
    )
    return together if only is None else together.join(only, ["series_key", "method"], "left_semi")


def _ranking(column: str) -> Column:
    # equal errors may differ in their last bits with the order rows were summed in
    return F.round(column, 9)


def select_best(metrics: DataFrame) -> DataFrame:
    """Lowest MAE per series; RMSE, then the name, decide ties."""
    order = Window.partitionBy("series_key").orderBy(_ranking("mae"), _ranking("rmse"), "method")
    return metrics.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def select_best_rmse(metrics: DataFrame, *keys: str) -> DataFrame:
    picked = F.min_by(F.struct("method", "rmse"), F.struct(_ranking("rmse"), F.col("method"))).alias("best")
    return metrics.groupBy(*keys).agg(picked).select(*keys, "best.method", "best.rmse")


def best_overall(metrics: DataFrame) -> DataFrame:
    """The first row in (MAE, RMSE, name) order."""
    return metrics.orderBy(_ranking("mae"), _ranking("rmse"), "method").limit(1)


def actual_and_forecast(framed: DataFrame, forecast: DataFrame, recent: int = 90) -> DataFrame:
    """Rows behind the forecast chart: recent training days, actual and forecast values."""
    history = tail(train(framed), recent).select("series_key", "ds", F.lit("train").alias("part"), "y")
    actual = forecast.select("series_key", "ds", F.lit("actual").alias("part"), "y").distinct()
    ahead = forecast.select("series_key", "ds", F.concat_ws(": ", F.lit("forecast"), "method").alias("part"), F.col("yhat").alias("y"))
    return history.unionByName(actual).unionByName(ahead)
