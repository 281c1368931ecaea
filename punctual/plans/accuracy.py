"""Forecast accuracy, residual diagnostics and stationarity, per series and method."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: test lags, band width and levels
PORTMANTEAU_LAGS = (7, 14, 21, 28)
BAND_Z = 1.959963984540054
STATIONARY_LEVEL = 0.05
# fixed values: published response surface of the unit-root statistic with a constant
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

KEYS = ("series_key", "method")
UNIT_ROOT_DAYS = 20


def metrics(forecast: DataFrame, *keys: str) -> DataFrame:
    """MAE, RMSE and MAPE; days with a zero actual have no percentage and are counted."""
    keys = keys or KEYS
    error = F.col("y") - F.col("yhat")
    return forecast.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, F.col("y")))) * 100).alias("mape"),
        F.count_if(F.col("y") == 0).alias("n_zero_actual"),
        F.count(F.lit(1)).alias("n_days"),
    )


def residuals(forecast: DataFrame) -> DataFrame:
    both = forecast.where("y IS NOT NULL AND yhat IS NOT NULL")
    return both.select("series_key", "method", "ds", (F.col("y") - F.col("yhat")).alias("residual"))


def diagnosed(forecast: DataFrame, *keys: str) -> DataFrame:
    """Errors, residual moments and both residual tests: the full metrics row of a period, series and method."""
    keys = keys or KEYS
    res = residuals(forecast)
    tests = ljung_box_pvalues(autocorrelation(res, "residual", max(PORTMANTEAU_LAGS), *keys), *keys)
    named = [F.max(F.when(F.col("lag") == lag, F.col("p_value"))).alias(f"ljung_box_pvalue_lag_{lag}") for lag in PORTMANTEAU_LAGS]
    shape = moments(res, *keys)
    shape = shape.select(*keys, *[F.col(c).alias(f"residual_{c}") for c in shape.columns if c not in keys])
    normal = jarque_bera(res, *keys).select(*keys, F.col("jb_pvalue").alias("jarque_bera_pvalue"))
    parts = (shape, normal, tests.groupBy(*keys).agg(*named))
    return reduce(lambda left, right: left.join(right, list(keys), "left"), parts, metrics(forecast.where("yhat IS NOT NULL"), *keys))


def moments(res: DataFrame, *keys: str) -> DataFrame:
    """Centre, spread and shape; skewness and kurtosis corrected for sample size."""
    keys = keys or KEYS
    table = res.groupBy(*keys).agg(
        F.count("residual").cast("double").alias("n"),
        F.avg("residual").alias("mean"),
        F.percentile("residual", F.lit(0.5)).alias("median"),
        F.stddev_samp("residual").alias("std"),
        F.var_samp("residual").alias("variance"),
        F.min("residual").alias("min"),
        F.max("residual").alias("max"),
        F.skewness("residual").alias("g1"),
        F.kurtosis("residual").alias("g2"),
    )
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return table.withColumns({"skew": skew, "kurtosis": kurt}).drop("g1", "g2", "n")


def jarque_bera(res: DataFrame, *keys: str) -> DataFrame:
    keys = keys or KEYS
    table = res.groupBy(*keys).agg(
        F.count("residual").alias("n"), F.skewness("residual").alias("s"), F.kurtosis("residual").alias("k")
    )
    stat = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return table.select(*keys, stat.alias("jb"), F.exp(-stat / 2).alias("jb_pvalue"))


def autocorrelation(values: DataFrame, column: str, lags: int, *keys: str) -> DataFrame:
    """Correlation with each lag up to ``lags``: one window sort and one aggregate per series."""
    keys = keys or KEYS
    everything = Window.partitionBy(*keys)
    order = everything.orderBy("ds")
    centred = values.where(F.col(column).isNotNull()).withColumn("d", F.col(column) - F.avg(column).over(everything))
    shifted = centred.withColumns({f"d{k}": F.lag("d", k).over(order) for k in range(1, lags + 1)})
    sums = shifted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("d") * F.col("d")).alias("c0"),
        F.array(
            F.sum(F.col("d") * F.col("d")), *[F.sum(F.col("d") * F.col(f"d{k}")) for k in range(1, lags + 1)]
        ).alias("c"),
    )
    long = sums.select(*keys, "n", "c0", F.posexplode("c").alias("lag", "ck"))
    return long.where("lag < n").select(*keys, "n", "lag", F.try_divide("ck", "c0").alias("acf"))


def confidence_band(acf: DataFrame, *keys: str) -> DataFrame:
    """Bartlett band around zero, from the squared correlations of smaller lags."""
    keys = keys or KEYS
    before = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.sum(F.col("acf") ** 2).over(before)
    # the lag-0 correlation is 1 and enters the sum once
    variance = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise((2 * squares - 1) / F.col("n"))
    return acf.withColumn("half_width", BAND_Z * F.sqrt(variance))


#: One step of the recursion for lag k: the newest coefficient, then all of them brought up to date.
DURBIN_LEVINSON = """aggregate(
  if(size(r) > 1, sequence(1, size(r) - 1), cast(array() AS array<int>)),
  named_struct('phi', cast(array() AS array<double>), 'partial', array(1D)),
  (s, k) -> transform(
    array(try_divide(
      r[k] - aggregate(zip_with(s.phi, reverse(slice(r, 2, k - 1)), (p, x) -> p * x), 0D, (t, x) -> t + x),
      1D - aggregate(zip_with(s.phi, slice(r, 2, k - 1), (p, x) -> p * x), 0D, (t, x) -> t + x))),
    last -> named_struct(
      'phi', concat(zip_with(s.phi, reverse(s.phi), (p, q) -> p - last * q), array(last)),
      'partial', concat(s.partial, array(last))))[0],
  s -> s.partial)"""


def partial_autocorrelation(acf: DataFrame, *keys: str) -> DataFrame:
    """Yule-Walker recursion on each series' short list of correlations, as one expression over its array."""
    keys = keys or KEYS
    lists = acf.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_pairs"))
    # at most as many entries as lags
    rows = lists.select(*keys, F.col("_pairs")["acf"].cast("array<double>").alias("r"), F.col("_pairs")["lag"].alias("_lags"))
    return rows.select(*keys, F.explode(F.arrays_zip(F.col("_lags").alias("lag"), F.expr(DURBIN_LEVINSON).alias("pacf"))).alias("_row")).select(
        *keys, F.col("_row")["lag"].cast("int").alias("lag"), F.col("_row")["pacf"].alias("pacf")
    )


def ljung_box(acf: DataFrame, *keys: str, lags=PORTMANTEAU_LAGS) -> DataFrame:
    """Portmanteau statistic at each lag smaller than the number of days."""
    keys = keys or KEYS
    running = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n")
    q = n * (n + 2) * F.sum(F.col("acf") ** 2 / (n - F.col("lag"))).over(running)
    return acf.where("lag > 0").select(*keys, "n", "lag", q.alias("q")).where(
        F.col("lag").isin(*lags) & (F.col("lag") < n)
    )


def erfc(x: Column) -> Column:
    """Complementary error function of a value that is not negative: a power series, a continued fraction beyond 2."""
    square = x * x
    # sum of 2^n x^(2n+1) / (2n+1)!!
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.struct(x.alias("total"), x.alias("term")),
        lambda s, n: F.struct((s["total"] + s["term"] * 2 * square / (2 * n + 1)).alias("total"), (s["term"] * 2 * square / (2 * n + 1)).alias("term")),
        lambda s: s["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda t, k: F.lit(1.0) + k / (2 * square) / t)
    root_pi = math.sqrt(math.pi)
    return F.when(x < 2, F.lit(1.0) - terms * F.exp(-square) * 2 / root_pi).otherwise(F.exp(-square) / (x * root_pi * fraction))


def tail_probability(x: str, df: str) -> Column:
    """Upper tail of chi-square for whole degrees of freedom: a finite sum, for odd ones on top of ``erfc``."""
    half, odd = F.col(x) / 2, F.col(df) % 2 == 1
    steps = (F.col(df) - F.col(df) % 2) / 2
    root = F.sqrt(half)
    first = F.struct(
        F.when(odd, erfc(root)).otherwise(F.lit(0.0)).alias("total"),
        (F.when(odd, root / math.gamma(1.5)).otherwise(F.lit(1.0)) * F.exp(-half)).alias("term"),
    )
    start = F.when(odd, F.lit(1.5)).otherwise(F.lit(1.0))
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps.cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        first,
        lambda s, i: F.struct((s["total"] + s["term"]).alias("total"), (s["term"] * half / (start + i)).alias("term")),
        lambda s: s["total"],
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), summed))


def ljung_box_pvalues(acf: DataFrame, *keys: str) -> DataFrame:
    return ljung_box(acf, *keys).withColumn("p_value", tail_probability("q", "lag"))


def ljung_box_min(acf: DataFrame, *keys: str) -> DataFrame:
    keys = keys or KEYS
    return ljung_box_pvalues(acf, *keys).groupBy(*keys).agg(F.min("p_value").alias("min_p_value"))


def residual_histogram(res: DataFrame, bins: int = 30, *keys: str) -> DataFrame:
    """Equal-width bins of each series' residuals."""
    keys = keys or KEYS
    ends = res.groupBy(*keys).agg(
        F.min("residual").alias("low"), F.max("residual").alias("high"), F.avg("residual").alias("mean_residual")
    )
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    low = F.when(F.col("high") > F.col("low"), F.col("low")).otherwise(F.col("low") - 0.5)
    index = F.least(F.floor((F.col("residual") - low) / width * bins), F.lit(bins - 1)).cast("int")
    counted = res.join(ends, list(keys)).groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("n_days"))
    spine = ends.select(*keys, "mean_residual", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counted, [*keys, "bin"], "left").na.fill(0, ["n_days"])


def _unit_root(pdf: pd.DataFrame) -> pd.DataFrame:
    y = pdf.sort_values("ds")["y"].dropna().to_numpy(float)
    if len(y) < UNIT_ROOT_DAYS or np.ptp(y) == 0:
        reason = "Too short" if len(y) < UNIT_ROOT_DAYS else "Constant"
        nothing = {name: pd.Series([None], dtype=kind) for name, kind in (("adf_stat", float), ("p_value", float), ("used_lag", "Int32"))}
        return pd.DataFrame({"series_key": [pdf["series_key"].iloc[0]], **nothing, "n_obs": [len(y)], "verdict": [reason]})
    n, change = len(y), np.diff(y)
    longest = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)

    def fit(lags: int, first: int):
        target = change[first:]
        columns = [y[first:-1]] + [change[first - k: len(change) - k] for k in range(1, lags + 1)]
        x = np.column_stack(columns + [np.ones(len(target))])
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        error = target - x @ beta
        return x, beta, float(error @ error), len(target)

    def criterion(lags: int) -> float:
        x, _, squares, m = fit(lags, longest)
        return m * (np.log(2 * np.pi * squares / m) + 1) + 2 * x.shape[1]

    chosen = min(range(longest + 1), key=lambda k: (criterion(k), k))
    x, beta, squares, m = fit(chosen, chosen)
    variance = squares / (m - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0]
    # a series that its own lags explain exactly has no spread left
    stat = float(beta[0] / np.sqrt(max(variance, 1e-300)))
    if stat > TAU_MAX:
        p = 1.0
    elif stat < TAU_MIN:
        p = 0.0
    else:
        powers = TAU_SMALL if stat <= TAU_STAR else TAU_LARGE
        z = sum(c * stat**i for i, c in enumerate(powers))
        p = 0.5 * math.erfc(-z / math.sqrt(2))
    verdict = "Stationary" if p < STATIONARY_LEVEL else "Non-stationary"
    return pd.DataFrame(
        {
            "series_key": [pdf["series_key"].iloc[0]], "adf_stat": [stat], "p_value": [p],
            "used_lag": [chosen], "n_obs": [m], "verdict": [verdict],
        }
    )


def unit_root(daily: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag by AIC; one daily series per group.

    A series that is too short or constant has a row without a statistic.
    """
    return daily.select("series_key", "ds", "y").groupBy("series_key").applyInPandas(
        _unit_root, "series_key string, adf_stat double, p_value double, used_lag int, n_obs int, verdict string"
    )
