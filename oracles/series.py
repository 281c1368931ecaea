"""Expected results of the series, baseline forecast, accuracy and residual queries."""

from oracles.base import operated_sql

SERIES = """
counts AS (
  SELECT op_unique_carrier AS series_key, fl_date AS ds, sum(is_delayed) AS late, count(*) AS n
  FROM operated WHERE fl_date >= DATE '1997-01-01' GROUP BY ALL
  UNION ALL
  SELECT 'ALL', fl_date, sum(is_delayed), count(*) FROM operated WHERE fl_date >= DATE '1997-01-01' GROUP BY ALL
), panel AS (
  SELECT series_key, ds, CAST(late AS DOUBLE) / n * 100 AS y FROM counts
), spine AS (
  SELECT series_key, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM panel GROUP BY series_key
), daily AS (
  SELECT series_key, ds, y FROM spine LEFT JOIN panel USING (series_key, ds)
), known AS (
  SELECT *, CASE WHEN y IS NOT NULL THEN ds END AS kd FROM daily
), nb AS (
  SELECT series_key, ds, y,
    last_value(y IGNORE NULLS) OVER back AS py, last_value(kd IGNORE NULLS) OVER back AS pd,
    first_value(y IGNORE NULLS) OVER ahead AS ny, first_value(kd IGNORE NULLS) OVER ahead AS nd
  FROM known
  WINDOW back AS (PARTITION BY series_key ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY series_key ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), smooth AS (
  SELECT series_key, ds, CASE WHEN y IS NOT NULL THEN y WHEN ds - pd <= 3 THEN
      CASE WHEN nd IS NULL THEN py ELSE (ny - py) / (nd - pd) * (ds - pd) + py END END AS y
  FROM nb
), usable AS (
  SELECT * FROM smooth WHERE y IS NOT NULL
), train AS (
  SELECT * FROM usable WHERE ds < DATE '2000-07-01'
), test AS (
  SELECT * FROM usable WHERE ds BETWEEN DATE '2000-07-01' AND DATE '2000-09-30'
), tails AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) AS back FROM train
)"""

NAIVE = """SELECT test.series_key, 'Naive Baseline' AS method, ds, y, yhat FROM test
  JOIN (SELECT series_key, arg_max(y, ds) AS yhat FROM train GROUP BY 1) USING (series_key)"""
SEASONAL = """SELECT t.series_key, '7-Day Seasonal Naive' AS method, t.ds, t.y, r.y AS yhat
  FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS step FROM test) t
  JOIN (SELECT *, count(*) OVER (PARTITION BY series_key) AS m FROM tails WHERE back <= 7) r
    ON t.series_key = r.series_key AND t.step % r.m = r.m - r.back"""
WEEKDAY = """SELECT test.series_key, 'Recent Weekday Average' AS method, ds, y, yhat FROM test
  LEFT JOIN (SELECT series_key, isodow(ds) AS wd, avg(y) AS yhat FROM tails WHERE back <= 365 GROUP BY ALL) w
    ON test.series_key = w.series_key AND isodow(ds) = wd"""
MEAN28 = """SELECT test.series_key, 'Recent 28-Day Mean' AS method, ds, y, yhat FROM test
  JOIN (SELECT series_key, avg(y) AS yhat FROM tails WHERE back <= 28 GROUP BY 1) USING (series_key)"""

FORECASTS = f"""{SERIES}, naive AS ({NAIVE}), seasonal AS ({SEASONAL}), weekly AS ({WEEKDAY}), recent AS ({MEAN28}),
forecasts AS (SELECT * FROM naive UNION ALL SELECT * FROM seasonal UNION ALL SELECT * FROM weekly UNION ALL SELECT * FROM recent),
metrics AS (SELECT series_key, method, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat)*(y - yhat))) AS rmse,
  avg(abs(CASE WHEN y <> 0 THEN (y - yhat) / y END)) * 100 AS mape, count(*) FILTER (WHERE y = 0) AS n_zero_actual, count(*) AS n_days
  FROM forecasts GROUP BY 1, 2),
res AS (SELECT series_key, method, ds, y - yhat AS residual FROM weekly WHERE yhat IS NOT NULL)"""

ACF = f"""{FORECASTS},
centred AS (SELECT *, residual - avg(residual) OVER (PARTITION BY series_key) AS d,
  row_number() OVER (PARTITION BY series_key ORDER BY ds) AS i, count(*) OVER (PARTITION BY series_key) AS n FROM res),
acf AS (SELECT a.series_key, a.method, any_value(a.n) AS n, CAST(k AS INTEGER) AS lag,
  coalesce(sum(a.d * b.d), 0) / any_value(c0) AS acf
  FROM centred a JOIN (SELECT series_key, sum(d*d) AS c0 FROM centred GROUP BY 1) z USING (series_key)
  CROSS JOIN range(29) s(k) LEFT JOIN centred b ON a.series_key = b.series_key AND b.i = a.i - k
  WHERE k < a.n GROUP BY a.series_key, a.method, k)"""

RULES = (
    ("New Year''s Day", 1, 1), ("Martin Luther King Jr. Day", 1, (3, 1)), ("Washington''s Birthday", 2, (3, 1)),
    ("Memorial Day", 5, ("last", 1)), ("Independence Day", 7, 4), ("Labor Day", 9, (1, 1)),
    ("Columbus Day", 10, (2, 1)), ("Veterans Day", 11, 11), ("Thanksgiving Day", 11, (4, 4)), ("Christmas Day", 12, 25),
)


def rule_date(month: int, rule) -> str:
    first = f"make_date(yr, {month}, 1)"
    if isinstance(rule, int):
        return f"make_date(yr, {month}, {rule})"
    n, weekday = rule
    if n == "last":
        return f"last_day({first}) - CAST((isodow(last_day({first})) - {weekday} + 7) % 7 AS INTEGER)"
    return f"{first} + CAST(({weekday} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"


HOLIDAYS = (
    f"{SERIES}, yrs AS (SELECT CAST(unnest(range(1997, 2003)) AS INTEGER) AS yr), actual AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS holiday, {rule_date(month, rule)} AS ds, {str(isinstance(rule, int)).lower()} AS fixed FROM yrs"
        for name, month, rule in RULES
    )
    + """), holidays AS (SELECT ds, holiday FROM (
      SELECT ds, holiday FROM actual
      UNION ALL SELECT ds - 1, holiday || ' (observed)' FROM actual WHERE fixed AND isodow(ds) = 6
      UNION ALL SELECT ds + 1, holiday || ' (observed)' FROM actual WHERE fixed AND isodow(ds) = 7)
      WHERE year(ds) BETWEEN 1997 AND 2001),
    near AS (SELECT DISTINCT CAST(ds + o AS DATE) AS ds FROM holidays, (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS o))"""
)

R6 = "round({0}, 6) AS {0}"
D = "CAST(ds AS VARCHAR) AS ds"
FC = f"series_key, method, {D}, round(y, 6) AS y, round(yhat, 6) AS yhat"


def q(body: str, ctes: str = SERIES) -> str:
    return operated_sql(body, ctes)


TERMS = ", ".join(
    f"round({f}((ds - DATE '1970-01-01') * (2*pi()*{k}/{period})), 6) AS {name}_{f}_{k}"
    for name, terms, period in (("year", 10, 365.25), ("week", 3, 7.0))
    for k in range(1, terms + 1)
    for f in ("sin", "cos")
)

PREPARATION = {
    "ts_daily_rate": q(f"SELECT series_key, {D}, y FROM panel WHERE series_key = 'ALL'"),
    "ts_asfreq_daily": q(f"SELECT series_key, {D}, y FROM daily"),
    "ts_missing_days": q("SELECT series_key, count(*) AS n_days, count(*) - count(y) AS n_missing FROM daily GROUP BY 1"),
    "ts_interpolate_time": q(f"SELECT series_key, {D}, round(y, 6) AS y FROM smooth"),
    "ts_remaining_missing": q(
        "SELECT series_key, count(*) - count(y) AS n_missing,"
        " count(*) FILTER (WHERE y IS NULL AND ds BETWEEN DATE '2001-01-01' AND DATE '2001-03-31') AS n_missing_test,"
        " count(*) = count(y) AS ok FROM smooth GROUP BY 1"
    ),
    "ts_drop_unfilled": q(f"SELECT series_key, {D}, round(y, 6) AS y FROM usable"),
    "ts_series_summary": q(
        "SELECT series_key, CAST(min(ds) AS VARCHAR) AS first_day, CAST(max(ds) AS VARCHAR) AS last_day, count(*) AS n_days,"
        " round(avg(y), 6) AS mean_rate, count(*) - count(y) AS n_missing FROM smooth WHERE ds <= DATE '2000-12-31' GROUP BY 1"
    ),
    "ts_holiday_calendar": q(f"SELECT {D}, holiday FROM holidays", HOLIDAYS),
    "ts_holiday_window": q(
        "SELECT series_key, CAST(daily.ds AS VARCHAR) AS ds, CASE WHEN near.ds IS NULL THEN 0 ELSE 1 END AS holiday_window"
        " FROM daily LEFT JOIN near ON daily.ds = near.ds",
        HOLIDAYS,
    ),
    "ts_calendar_features": q(
        f"SELECT series_key, {D}, CAST(isodow(ds) - 1 AS INTEGER) AS weekday,"
        f" CAST(ds - (SELECT min(ds) FROM daily WHERE series_key = 'ALL') AS INTEGER) AS trend, {TERMS} FROM daily WHERE series_key = 'ALL'"
    ),
    "dq_min_history": q("SELECT series_key, count(y) AS n_days, count(y) >= 180 AS ok FROM usable GROUP BY 1"),
    "join_spine_days": q(f"SELECT {D}, count(*) AS n_series, count(y) AS n_known FROM daily GROUP BY daily.ds"),
    "join_weekday_lookup": q(f"SELECT {FC} FROM weekly", FORECASTS),
    "join_holiday_window": q(
        "SELECT CAST(daily.ds AS VARCHAR) AS ds, max(CASE WHEN near.ds IS NULL THEN 0 ELSE 1 END) AS holiday_window, count(*) AS n_series"
        " FROM daily LEFT JOIN near ON daily.ds = near.ds GROUP BY daily.ds",
        HOLIDAYS,
    ),
    "join_align_series": q(
        "SELECT p.series_key, CAST(p.ds AS VARCHAR) AS ds, round(p.y, 6) AS y, round(yhat, 6) AS yhat, round(p.y - yhat, 6) AS residual"
        " FROM panel p JOIN weekly w ON p.series_key = w.series_key AND p.ds = w.ds WHERE yhat IS NOT NULL",
        FORECASTS,
    ),
    "join_exog_lookup": q(
        "SELECT series_key, CAST(u.ds AS VARCHAR) AS ds, round(y, 6) AS y, part, CASE WHEN near.ds IS NULL THEN 0 ELSE 1 END AS holiday_window"
        " FROM (SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test) u LEFT JOIN near ON u.ds = near.ds",
        HOLIDAYS,
    ),
    "set_concat_holiday_offsets": q(f"SELECT {D} FROM near", HOLIDAYS),
    "win_lag": q(
        f"SELECT series_key, {D}, round(y, 6) AS y, "
        + ", ".join(f"round(lag(y, {k}) OVER (PARTITION BY series_key ORDER BY usable.ds), 6) AS lag_{k}" for k in (1, 7, 8))
        + " FROM usable"
    ),
    "win_tail_n": q(
        "SELECT series_key, " + ", ".join(f"round(avg(y) FILTER (WHERE back <= {n}), 6) AS mean_{n}" for n in (7, 28, 365))
        + " FROM tails WHERE back <= 365 GROUP BY 1"
    ),
    "win_fill_neighbors": q(
        f"SELECT series_key, {D}, CAST(pd AS VARCHAR) AS previous_day, round(py, 6) AS previous_rate,"
        " CAST(nd AS VARCHAR) AS next_day, round(ny, 6) AS next_rate FROM nb WHERE y IS NULL"
    ),
    "spl_forecast_holdout": q(
        "SELECT series_key, part, count(*) AS n_days, CAST(min(ds) AS VARCHAR) AS first_day, CAST(max(ds) AS VARCHAR) AS last_day"
        " FROM (SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' FROM test) GROUP BY 1, 2"
    ),
    "spl_latest_n_days": q(
        """SELECT series_key, CASE WHEN strftime(hi - 89, '%m-%d') = '01-01' AND strftime(hi, '%m-%d') = '03-31' THEN 'Q1 ' || year(hi)
          ELSE 'Latest 90 Days' END AS period, CAST(hi - 89 AS VARCHAR) AS split_date, CAST(hi AS VARCHAR) AS end_date FROM e
        UNION ALL SELECT series_key, 'Q3 ' || (year(hi) - 1), (year(hi) - 1) || '-07-01', (year(hi) - 1) || '-09-30' FROM e
          WHERE lo < make_date(year(hi) - 1, 7, 1) AND hi >= make_date(year(hi) - 1, 9, 30)""",
        f"{SERIES}, e AS (SELECT series_key, min(ds) AS lo, max(ds) AS hi FROM usable GROUP BY 1)",
    ),
}

FORECAST = {
    "fc_naive_last": q(f"SELECT {FC} FROM naive", FORECASTS),
    "fc_seasonal_naive7": q(f"SELECT {FC} FROM seasonal", FORECASTS),
    "fc_weekday_avg": q(f"SELECT {FC} FROM weekly", FORECASTS),
    "fc_mean28": q(f"SELECT {FC} FROM recent", FORECASTS),
    "fc_select_best": q(
        "SELECT series_key, method FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(mae, 9), round(rmse, 9), method) AS k FROM metrics) WHERE k = 1",
        FORECASTS,
    ),
    "fc_select_best_rmse": q(
        "SELECT series_key, method, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY round(rmse, 9), method) AS k FROM metrics) WHERE k = 1",
        FORECASTS,
    ),
    "fc_actual_vs_forecast": q(
        f"""SELECT series_key, {D}, part, round(y, 6) AS y FROM (
          SELECT series_key, ds, 'train' AS part, y FROM tails WHERE back <= 90
          UNION ALL SELECT series_key, ds, 'actual', y FROM weekly
          UNION ALL SELECT series_key, ds, 'forecast: Recent Weekday Average', yhat FROM weekly)""",
        FORECASTS,
    ),
    "f_model_family": q(
        """SELECT family, count(*) AS n_models FROM (
          SELECT method AS family FROM metrics UNION ALL SELECT 'Auto SARIMA' FROM metrics
          UNION ALL SELECT 'SARIMAX + Holiday' FROM metrics UNION ALL SELECT 'Prophet + Holidays' FROM metrics) GROUP BY 1""",
        FORECASTS,
    ),
    "srt_multi_key": q(
        "SELECT method, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat)*(y - yhat))), 6) AS rmse FROM forecasts"
        " GROUP BY method ORDER BY round(avg(abs(y - yhat)), 9), round(sqrt(avg((y - yhat)*(y - yhat))), 9), method LIMIT 1",
        FORECASTS,
    ),
}

SERIES_ACF = (
    SERIES
    + """, v AS (SELECT *, y - avg(y) OVER (PARTITION BY series_key) AS d, row_number() OVER (PARTITION BY series_key ORDER BY ds) AS i,
      count(*) OVER (PARTITION BY series_key) AS n FROM usable WHERE ds <= DATE '2000-12-31'),
    acf AS (SELECT a.series_key, any_value(a.n) AS n, CAST(k AS INTEGER) AS lag, sum(a.d * b.d) / any_value(c0) AS acf
      FROM v a JOIN (SELECT series_key, sum(d*d) AS c0 FROM v GROUP BY 1) z USING (series_key)
      CROSS JOIN range(41) s(k) JOIN v b ON a.series_key = b.series_key AND b.i = a.i - k GROUP BY a.series_key, k)"""
)

PORTMANTEAU = """SELECT series_key, method, lag, n * (n + 2) * s AS q FROM (
  SELECT *, sum(acf*acf/(n - lag)) OVER (PARTITION BY series_key, method ORDER BY lag) AS s FROM acf WHERE lag > 0)
  WHERE lag IN (7, 14, 21, 28)"""

# upper tail of chi-square: one less the series of the incomplete gamma function
CHI_TAIL = """greatest(0, 1 - CASE WHEN q <= 0 THEN 0 ELSE
  list_sum(list_transform(range(900), lambda i: exp((lag / 2.0 + i) * ln(q / 2.0) - q / 2.0 - lgamma(lag / 2.0 + i + 1)))) END)"""


def partial(keys: str, before: str) -> str:
    """Durbin-Levinson as a recursive query over each series' list of correlations."""
    return q(
        f"""SELECT {keys}, CAST(0 AS INTEGER) AS lag, CAST(1 AS DOUBLE) AS pacf FROM lists
        UNION ALL SELECT {keys}, CAST(k AS INTEGER), round(last, 6) FROM steps""",
        before + f""", lists AS (SELECT {keys}, list(acf ORDER BY lag) AS r FROM acf GROUP BY {keys}),
        steps AS (
          SELECT {keys}, r, 1 AS k, r[2] AS last, [r[2]] AS phi FROM lists WHERE len(r) > 1
          UNION ALL
          SELECT {keys}, r, k + 1, next, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - next * phi[k + 1 - i]), next) FROM (
            SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i])))
              / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i + 1]))) AS next FROM steps WHERE k + 1 < len(r)))""",
    )


DIAGNOSTICS = {
    "acc_mae": q("SELECT series_key, method, round(mae, 6) AS mae FROM metrics", FORECASTS),
    "acc_rmse": q("SELECT series_key, method, round(rmse, 6) AS rmse FROM metrics", FORECASTS),
    "acc_mape": q("SELECT series_key, method, round(mape, 6) AS mape, n_zero_actual FROM metrics", FORECASTS),
    "res_series": q(f"SELECT series_key, method, {D}, round(residual, 6) AS residual FROM res", FORECASTS),
    "res_moments": q(
        """SELECT series_key, method, round(avg(residual), 6) AS mean, round(quantile_cont(residual, 0.5), 6) AS median,
        round(stddev_samp(residual), 6) AS std, round(var_samp(residual), 6) AS variance, round(min(residual), 6) AS min,
        round(max(residual), 6) AS max, round(skewness(residual), 6) AS skew, round(kurtosis(residual), 6) AS kurtosis
        FROM res GROUP BY 1, 2""",
        FORECASTS,
    ),
    "res_jarque_bera": q(
        """SELECT series_key, method, round(jb, 6) AS jb, round(exp(-jb/2), 6) AS jb_pvalue FROM (
          SELECT series_key, method, n/6.0 * (power(sk*(n-2)/sqrt(n*(n-1.0)), 2) + power(ku, 2)/4) AS jb FROM (
            SELECT series_key, method, count(*) AS n, skewness(residual) AS sk, kurtosis_pop(residual) AS ku FROM res GROUP BY 1, 2))""",
        FORECASTS,
    ),
    "res_acf": q("SELECT series_key, method, n, lag, round(acf, 6) AS acf FROM acf", ACF),
    "res_acf_series": q(
        "SELECT series_key, n, lag, round(acf, 6) AS acf FROM acf",
        SERIES_ACF,
    ),
    "res_conf_band": q(
        """SELECT series_key, method, n, lag, round(1.959963984540054 * sqrt(CASE WHEN lag = 0 THEN 0 ELSE
          (2 * sum(acf*acf) OVER (PARTITION BY series_key, method ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) / n END), 6)
          AS half_width FROM acf""",
        ACF,
    ),
    "res_ljung_box": q(
        """SELECT series_key, method, lag, round(n * (n + 2) * s, 6) AS q FROM (
          SELECT *, sum(acf*acf/(n - lag)) OVER (PARTITION BY series_key, method ORDER BY lag) AS s FROM acf WHERE lag > 0)
          WHERE lag IN (7, 14, 21, 28)""",
        ACF,
    ),
    "res_ljung_box_pvalue": q(f"SELECT series_key, method, lag, round(q, 6) AS q, round({CHI_TAIL}, 6) AS p_value FROM ({PORTMANTEAU})", ACF),
    "res_ljung_box_min": q(f"SELECT series_key, method, round(min({CHI_TAIL}), 6) AS min_p_value FROM ({PORTMANTEAU}) GROUP BY series_key, method", ACF),
    "res_pacf": partial("series_key, method", ACF),
    "res_pacf_series": partial("series_key", SERIES_ACF),
    "res_histogram": q(
        """SELECT e.series_key, e.method, CAST(k AS INTEGER) AS bin, round(any_value(m), 6) AS mean_residual,
          count(r.residual) AS n_days
        FROM (SELECT series_key, method, min(residual) AS lo, max(residual) AS hi, avg(residual) AS m FROM res GROUP BY 1, 2) e
        CROSS JOIN range(30) s(k)
        LEFT JOIN res r ON r.series_key = e.series_key AND least(CAST(floor((residual - lo) / (hi - lo) * 30) AS BIGINT), 29) = k
        GROUP BY e.series_key, e.method, k""",
        FORECASTS,
    ),
}

SQL = {**PREPARATION, **FORECAST, **DIAGNOSTICS}
