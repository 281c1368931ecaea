"""Series preparation, forecasting, accuracy and residual queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import labels as L
from punctual.operators import lookups as J
from punctual.operators import quality as Q
from punctual.plans import accuracy as A
from punctual.plans import forecasts as P
from punctual.plans import series as T
from punctual.session import cut_lineage

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to fixed digits: sums over rows may differ in their last bits between runs."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def panel(t) -> DataFrame:
    """Daily series, written once: spines, holidays and gaps then read days, not flights."""
    return cut_lineage(T.daily_panel(t.operated(start=t.s.series_start)))


def filled(t) -> DataFrame:
    return T.interpolate(T.every_day(panel(t)), t.s.gap_limit)


def usable(t) -> DataFrame:
    """Short gaps filled, longer ones left out: the rule for series with holes."""
    return T.drop_unfilled(filled(t))


def framed(t) -> DataFrame:
    """Train and test days, written once because every method reads them again."""
    return T.holdout(cut_lineage(usable(t)), t.s.holdout_start, t.s.holdout_end)


def stored_series(t) -> DataFrame:
    """Every day of every series, short gaps filled, written once: many fits then read days instead of flights."""
    return cut_lineage(filled(t))


def stored_frame(t) -> DataFrame:
    return T.holdout(stored_series(t), t.s.holdout_start, t.s.holdout_end)


def weekday_residuals(t) -> DataFrame:
    return A.residuals(P.weekday_average(framed(t)))


def residual_acf(t) -> DataFrame:
    return A.autocorrelation(weekday_residuals(t), "residual", 28)


def flagged(t) -> DataFrame:
    return P.with_holiday_flag(stored_frame(t), t.s.holiday_reach)


def validated(t) -> DataFrame:
    """The full metrics row of every series and method on the validation period."""
    frame = stored_frame(t)
    forecasts = cut_lineage(P.every_method(frame, t.s.holiday_reach))
    scores = P.with_status(A.diagnosed(forecasts), frame, t.s.min_train_days)
    return scores.select(F.lit(period(t.s.holdout_start)).alias("period"), "*", L.method_family("method").alias("family"))


def refitted(t) -> DataFrame:
    """Choose on the validation period, then fit only the chosen method for the final period; a series without a choice keeps a row."""
    series = stored_series(t)
    validation = T.holdout(series, t.s.holdout_start, t.s.holdout_end)
    scores = cut_lineage(A.metrics(P.every_method(validation, t.s.holiday_reach).where("yhat IS NOT NULL")))
    chosen = P.select_best(scores).select("series_key", "method")
    final = T.holdout(series, t.s.final_start, t.s.final_end)
    got = A.diagnosed(cut_lineage(P.every_method(final, t.s.holiday_reach, chosen)))
    kept = P.with_status(got, final, t.s.min_train_days).join(chosen, ["series_key", "method"], "left_semi")
    missing = series.select("series_key").distinct().join(chosen, "series_key", "left_anti").withColumn("status", F.lit(P.NO_FIT))
    return kept.unionByName(missing, allowMissingColumns=True).select(F.lit(period(t.s.final_start)).alias("period"), "*")


def period(start: str) -> str:
    """Quarter of a period's first day."""
    year, month, _ = start.split("-")
    return f"Q{(int(month) + 2) // 3} {year}"


def auto_with_holidays(frame: DataFrame) -> DataFrame:
    return P.ar_auto(frame, P.best_order(P.order_scores(frame)), holiday=True)


PREPARATION = {
    "ts_daily_rate": lambda t: T.daily_rate(t.operated(start=t.s.series_start)),
    "ts_asfreq_daily": lambda t: T.every_day(panel(t)),
    "ts_missing_days": lambda t: T.missing_days(T.every_day(panel(t))),
    "ts_interpolate_time": lambda t: rounded(filled(t)),
    "ts_remaining_missing": lambda t: T.remaining_missing(filled(t), t.s.final_start, t.s.final_end),
    "ts_drop_unfilled": lambda t: rounded(usable(t)),
    "ts_series_summary": lambda t: rounded(
        T.summary(T.between(filled(t), t.s.series_start, t.s.series_train_end))
    ),
    "ts_holiday_calendar": lambda t: T.holiday_calendar(panel(t)),
    "ts_holiday_window": lambda t: T.with_holidays(T.every_day(panel(t)), t.s.holiday_reach).select(
        "series_key", "ds", "holiday_window"
    ),
    "ts_calendar_features": lambda t: rounded(
        T.calendar_features(T.every_day(T.daily_rate(t.operated(start=t.s.series_start)))).drop("y")
    ),
    "dq_min_history": lambda t: Q.min_history(usable(t), t.s),
    "join_spine_days": lambda t: T.every_day(panel(t)).groupBy("ds").agg(
        F.count(F.lit(1)).alias("n_series"), F.count("y").alias("n_known")
    ),
    "join_weekday_lookup": lambda t: rounded(P.weekday_average(framed(t))),
    "join_holiday_window": lambda t: T.with_holidays(T.every_day(panel(t)), t.s.holiday_reach)
    .groupBy("ds").agg(F.max("holiday_window").alias("holiday_window"), F.count(F.lit(1)).alias("n_series")),
    "join_align_series": lambda t: rounded(
        J.align(panel(t), P.weekday_average(framed(t)).select("series_key", "ds", "yhat"))
    ),
    "join_exog_lookup": lambda t: rounded(P.with_holiday_flag(framed(t), t.s.holiday_reach)),
    "set_concat_holiday_offsets": lambda t: T.holiday_offsets(T.holiday_calendar(panel(t)), t.s.holiday_reach)
    .select("ds").distinct(),
    "win_lag": lambda t: rounded(T.lags(usable(t), 1, 7, 8)),
    "win_tail_n": lambda t: rounded(
        T.tail(P.train(framed(t)), 365).groupBy("series_key").agg(
            *[F.avg(F.when(F.col("back") <= n, F.col("y"))).alias(f"mean_{n}") for n in (7, 28, 365)]
        )
    ),
    "win_fill_neighbors": lambda t: T.with_neighbours(T.every_day(panel(t))).where("y IS NULL").select(
        "series_key", "ds",
        F.col("before.ds").alias("previous_day"), F.round("before.y", DIGITS).alias("previous_rate"),
        F.col("after.ds").alias("next_day"), F.round("after.y", DIGITS).alias("next_rate"),
    ),
    "spl_forecast_holdout": lambda t: framed(t).groupBy("series_key", "part").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day")
    ),
    "spl_latest_n_days": lambda t: T.periods(usable(t), t.s),
}

FORECASTS = {
    "fc_naive_last": lambda t: rounded(P.naive_last(framed(t))),
    "fc_seasonal_naive7": lambda t: rounded(P.seasonal_naive(framed(t))),
    "fc_weekday_avg": lambda t: rounded(P.weekday_average(framed(t))),
    "fc_mean28": lambda t: rounded(P.recent_mean(framed(t))),
    "fc_ar_seasonal": lambda t: P.ar_fixed(flagged(t)),
    "fc_ar_order_search": lambda t: P.best_order(P.order_scores(stored_frame(t))),
    "fc_ar_holiday": lambda t: auto_with_holidays(flagged(t)),
    "fc_calendar_regression": lambda t: P.calendar_regression(stored_frame(t), t.s.holiday_reach),
    "fc_validate_all": validated,
    "fc_select_best": lambda t: P.select_best(A.metrics(P.baselines(framed(t)))).select("series_key", "method"),
    "fc_select_best_rmse": lambda t: rounded(
        P.select_best_rmse(A.metrics(P.baselines(framed(t))), "series_key")
    ),
    "fc_refit_test": refitted,
    "fc_actual_vs_forecast": lambda t: rounded(
        P.actual_and_forecast(framed(t), P.weekday_average(framed(t)))
    ),
    "f_model_family": lambda t: A.metrics(P.baselines(framed(t))).select(
        F.explode(
            F.array(
                F.col("method"),
                F.concat(F.lit("Auto SARIMA"), F.col("series_key")),
                F.concat(F.lit("SARIMAX + holiday "), F.col("series_key")),
                F.concat(F.lit("Prophet "), F.col("series_key")),
            )
        ).alias("name")
    ).groupBy(L.method_family("name").alias("family")).agg(F.count(F.lit(1)).alias("n_models")),
    "srt_multi_key": lambda t: rounded(
        P.best_overall(A.metrics(P.baselines(framed(t)), "method"))
    ).select("method", "mae", "rmse"),
}


def _metric(name: str, *extra: str):
    return lambda t: rounded(A.metrics(P.baselines(framed(t))).select("series_key", "method", name, *extra))


DIAGNOSTICS = {
    "acc_mae": _metric("mae"),
    "acc_rmse": _metric("rmse"),
    "acc_mape": _metric("mape", "n_zero_actual"),
    "res_series": lambda t: rounded(weekday_residuals(t)),
    "res_moments": lambda t: rounded(A.moments(weekday_residuals(t))),
    "res_jarque_bera": lambda t: rounded(A.jarque_bera(weekday_residuals(t))),
    "res_acf": lambda t: rounded(residual_acf(t)),
    "res_acf_series": lambda t: rounded(
        A.autocorrelation(T.between(usable(t), t.s.series_start, t.s.series_train_end), "y", 40, "series_key")
    ),
    "res_pacf": lambda t: rounded(A.partial_autocorrelation(residual_acf(t))),
    "res_pacf_series": lambda t: rounded(A.partial_autocorrelation(
        A.autocorrelation(T.between(usable(t), t.s.series_start, t.s.series_train_end), "y", 40, "series_key"),
        "series_key",
    )),
    "res_conf_band": lambda t: rounded(A.confidence_band(residual_acf(t)).drop("acf")),
    "res_ljung_box": lambda t: rounded(A.ljung_box(residual_acf(t)).drop("n")),
    "res_ljung_box_pvalue": lambda t: rounded(A.ljung_box_pvalues(residual_acf(t)).drop("n")),
    "res_ljung_box_min": lambda t: rounded(A.ljung_box_min(residual_acf(t))),
    "res_histogram": lambda t: rounded(A.residual_histogram(weekday_residuals(t))),
    "ts_adf": lambda t: A.unit_root(T.between(usable(t), t.s.series_start, t.s.series_train_end)),
}

QUERIES = {**PREPARATION, **FORECASTS, **DIAGNOSTICS}

