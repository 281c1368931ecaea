"""Gaps, holidays, baselines and tests of residuals on small hand-checked series."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as SF

from punctual.plans import accuracy as A
from punctual.plans import forecasts as P
from punctual.plans import series as T

DAY = dt.date(2000, 1, 1)


def series(spark, values, key="S", start=DAY):
    rows = [(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


def column(df, name="y"):
    return [r[name] for r in df.orderBy("ds").collect()]


def test_interpolation_limit(spark):
    values = [None, 1, None, None, None, None, None, 7, 8, None]
    got = column(T.interpolate(series(spark, values)))
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, None, 7.0, 8.0, 8.0]


def test_every_day(spark):
    gappy = series(spark, [1, 2, 3, 4]).where("y <> 2")
    assert column(T.every_day(gappy)) == [1.0, None, 3.0, 4.0]


def test_holidays(spark):
    found = {(str(r.ds), r.holiday) for r in T.holiday_calendar(series(spark, [0] * 3000, start=dt.date(2018, 1, 1))).collect()}
    for expected in (
        ("2019-01-21", "Martin Luther King Jr. Day"), ("2019-05-27", "Memorial Day"), ("2019-11-28", "Thanksgiving Day"),
        ("2021-06-18", "Juneteenth National Independence Day (observed)"), ("2021-12-31", "New Year's Day (observed)"),
        ("2022-12-26", "Christmas Day (observed)"),
    ):
        assert expected in found
    assert not any(day.startswith("2019-06-19") for day, _ in found)


def test_baselines(spark):
    framed = T.holdout(series(spark, list(range(1, 31)) + [5] * 10), "2000-01-31", "2000-02-09")
    assert column(P.naive_last(framed), "yhat") == [30.0] * 10
    assert column(P.seasonal_naive(framed), "yhat") == [24.0, 25.0, 26.0, 27.0, 28.0, 29.0, 30.0, 24.0, 25.0, 26.0]
    assert column(P.recent_mean(framed), "yhat") == pytest.approx([16.5] * 10)


def test_autoregression_recovers_a_cycle(spark):
    week = [3, 9, 4, 8, 2, 7, 5]
    framed = T.holdout(series(spark, week * 30), "2000-07-01", "2000-07-28")
    flagged = P.with_holiday_flag(framed, 2)
    for forecast in (P.ar_fixed(flagged), P.calendar_regression(framed, 2)):
        scores = A.metrics(forecast).first()
        assert scores.mae < 0.6


def ragged(spark):
    """A long series with a long gap, short ones of 0, 6, 20 and 89 training days, and one that ends before the test days."""
    rng = np.random.default_rng(4)
    rows = [("gap", DAY + dt.timedelta(days=i), None if 100 <= i < 130 else float(20 + (i % 7) + rng.normal())) for i in range(430)]
    for days in (0, 6, 20, 89):
        first = DAY + dt.timedelta(days=400 - days)
        rows += [(f"d{days}", first + dt.timedelta(days=i), float(20 + (i % 7))) for i in range(days + 30)]
    rows += [("early", DAY + dt.timedelta(days=i), float(i % 7)) for i in range(200)]
    daily = spark.createDataFrame(rows, "series_key string, ds date, y double")
    first = DAY + dt.timedelta(days=400)
    return T.holdout(daily, str(first), str(first + dt.timedelta(days=29)))


def test_no_series_is_lost(spark):
    framed = ragged(spark).cache()
    forecasts = P.every_method(framed, 2).cache()
    got = {(r.series_key, r.method): r for r in P.with_status(A.diagnosed(forecasts), framed).collect()}
    assert len(got) == 6 * 8
    fitted = (P.AR_FIXED, P.AR_AUTO, P.AR_HOLIDAY, P.CALENDAR)
    for method in P.METHODS:
        assert got["gap", method].status == P.OK and got["gap", method].mae < 8
        assert got["d0", method].status == P.NO_TRAIN and got["early", method].status == P.NO_TEST
        for days in (6, 20, 89):
            assert got[f"d{days}", method].status == (P.SHORT if method in fitted else P.OK)
    # fits without enough days have rows without a forecast
    rows = forecasts.where("series_key = 'd20' AND method = 'AR(1)(1)7'").collect()
    assert len(rows) == 30 and all(r.yhat is None for r in rows)


def test_fit_around_a_gap(spark):
    """Coefficients are those of least squares on the days whose lags are known."""
    framed = ragged(spark).where("series_key = 'gap'")
    y = np.array([np.nan if r.y is None else r.y for r in framed.orderBy("ds").collect()])[:400]
    rows = [t for t in range(8, 400) if np.isfinite(y[[t, t - 1, t - 7, t - 8]]).all()]
    x = np.array([[1, y[t - 1], y[t - 7], y[t - 8]] for t in rows])
    beta = np.linalg.lstsq(x, y[rows], rcond=None)[0]
    path = list(y)
    for _ in range(30):
        path.append(float(beta @ [1, path[-1], path[-7], path[-8]]))
    got = [r.yhat for r in P.ar_fixed(P.with_holiday_flag(framed, 2)).orderBy("ds").collect()]
    assert got == pytest.approx(path[400:])


def test_short_series_in_order_search_and_unit_root(spark):
    framed = ragged(spark)
    orders = {r.series_key: r for r in P.best_order(P.order_scores(framed)).collect()}
    assert set(orders) == {"gap", "d6", "d20", "d89", "early"} and orders["d6"].aic is None
    roots = {r.series_key: r for r in A.unit_root(framed.where("part = 'train'")).collect()}
    assert roots["d6"].verdict == "Too short" and roots["d6"].adf_stat is None and roots["gap"].adf_stat is not None


def test_order_search_prefers_weekly_terms(spark):
    rng = np.random.default_rng(1)
    y = [20.0] * 7
    for _ in range(400):
        y.append(20 + 0.8 * (y[-7] - 20) + rng.normal())
    framed = T.holdout(series(spark, y), "2001-01-31", "2001-02-05")
    assert P.best_order(P.order_scores(framed)).first().seasonal >= 1


def plain_tail(x, df):
    """Numerical integral of the density above x."""
    at = x + (np.arange(400_000) + 0.5) * 2e-3
    return float(np.exp((df / 2 - 1) * np.log(at) - at / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)).sum() * 2e-3)


def test_chi_square_tail(spark):
    cases = [(3.841458820694124, 1), (14.067140449340169, 7), (23.684791304840576, 14), (0.0, 7), (0.0, 2)]
    cases += [(float(x), df) for x in (0.5, 3.0, 7.9, 8.1, 20.0, 60.0, 300.0) for df in (1, 2, 7, 14, 21, 28)]
    got = [r.p for r in spark.createDataFrame(cases, "x double, df int").coalesce(1).select(A.tail_probability("x", "df").alias("p")).collect()]
    assert got[:3] == pytest.approx([0.05] * 3) and got[3:5] == [1.0, 1.0]
    for (x, df), p in list(zip(cases, got))[5:]:
        # the density of one degree has a pole at 0: a rough integral there
        assert p == pytest.approx(plain_tail(x, df), rel=2e-3 if df == 1 else 1e-5, abs=1e-12)


def test_erfc(spark):
    xs = [0.0, 1e-6, 0.1, 0.5, 1.0, 1.5, 1.99, 2.0, 2.5, 4.0, 8.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(A.erfc(SF.col("x")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-9, abs=1e-14)


def test_partial_autocorrelation_of_short_lists(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name, n in (("a", 1), ("b", 2), ("c", 12)):
        y = rng.normal(size=200).cumsum()[:200] * 0.3 + rng.normal(size=200)
        d = y - y.mean()
        r = [float((d[k:] * d[: len(d) - k]).sum() / (d * d).sum()) for k in range(n)]
        rows += [(name, "m", 200, k, x) for k, x in enumerate(r)]
        # the last coefficient of each Yule-Walker system
        want[name] = [1.0] + [float(np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), np.array(r[1 : k + 1]))[-1]) for k in range(1, n)]
    acf = spark.createDataFrame(rows, "series_key string, method string, n int, lag int, acf double").repartition(3)
    got = {}
    for r in A.partial_autocorrelation(acf).orderBy("series_key", "lag").collect():
        got.setdefault(r.series_key, []).append(r.pacf)
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert A.partial_autocorrelation(acf.where("lag > 99")).collect() == []


def test_partial_autocorrelation_of_an_ar1(spark):
    rng = np.random.default_rng(2)
    y = [0.0]
    for _ in range(600):
        y.append(0.7 * y[-1] + rng.normal())
    acf = A.autocorrelation(series(spark, y), "y", 5, "series_key")
    r = [row.acf for row in acf.orderBy("lag").collect()]
    pacf = [row.pacf for row in A.partial_autocorrelation(acf, "series_key").orderBy("lag").collect()]
    assert pacf[1] == pytest.approx(r[1])
    assert pacf[2] == pytest.approx((r[2] - r[1] ** 2) / (1 - r[1] ** 2))
    system = np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)])
    assert pacf[5] == pytest.approx(np.linalg.solve(system, np.array(r[1:6]))[-1])


def test_unit_root(spark):
    rng = np.random.default_rng(3)
    noise = series(spark, rng.normal(size=300), "noise")
    walk = series(spark, np.cumsum(rng.normal(size=300)), "walk")
    got = {r.series_key: r for r in A.unit_root(noise.unionByName(walk)).collect()}
    assert got["noise"].verdict == "Stationary" and got["noise"].p_value < 1e-6
    assert got["walk"].p_value > got["noise"].p_value
    # the published value for the national series
    z = sum(c * (-5.0115) ** i for i, c in enumerate(A.TAU_SMALL))
    assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(0.000021, abs=1e-6)
