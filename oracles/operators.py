"""Expected results of the source, quality, feature, filter, join, aggregate and ordering queries."""

from oracles import reports as R
from oracles.base import CARRIER, CAUSE, DISTANCE, category, mean2, operated_sql, rate, scheduled_sql

CAUSES = ("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")
SCHEDULED_COLUMNS = (
    "year", "quarter", "month", "day_of_month", "day_of_week", "fl_date", "op_unique_carrier", "tail_num",
    "origin", "origin_city_name", "origin_state_abr", "dest", "dest_city_name", "dest_state_abr", "crs_dep_time",
    "dep_delay", "dep_delay_new", "dep_del15", "arr_delay", "arr_delay_new", "arr_del15", "cancelled",
    "cancellation_code", "diverted", "air_time", "distance",
) + CAUSES
FEATURE_COLUMNS = (
    "is_delayed", "delay_category", "day_of_year", "week_of_year", "dep_hour", "is_peak_hour", "is_weekend",
    "route", "main_delay_cause", "airline_name",
)


def tally(keys: str, source: str = "operated", where: str = "") -> str:
    return f"SELECT {keys}, count(*) AS n_flights FROM {source} {where} GROUP BY ALL"


def op(keys: str, where: str = "", source: str = "operated") -> str:
    return operated_sql(tally(keys, source, where))


def sc(keys: str, where: str = "") -> str:
    return scheduled_sql(tally(keys, "scheduled", where))


def missing(columns, source: str, top: int) -> str:
    return (
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM {source}" for c in columns
        )
        + f" ORDER BY n_missing DESC, column_name LIMIT {top}"
    )


COPIES = "copies AS (SELECT * FROM scheduled UNION ALL SELECT * FROM scheduled WHERE tail_num IS NULL), one AS (SELECT DISTINCT * FROM copies)"
TEXT = """lenient AS (SELECT * REPLACE (
    CASE WHEN day_of_month = 29 THEN NULL ELSE fl_date END AS fl_date,
    CASE WHEN crs_dep_time % 100 = 17 THEN NULL ELSE dep_delay END AS dep_delay) FROM scheduled)"""
CSV_TOTALS = operated_sql(
    "SELECT op_unique_carrier, count(*) AS n_flights, sum(dep_delay) AS sum_dep_delay, CAST(sum(is_delayed) AS BIGINT) AS n_delayed,"
    " CAST(min(fl_date) AS VARCHAR) AS first_date FROM operated GROUP BY 1"
)
CLEAN = f"""SELECT (SELECT count(*) FROM copies) AS input_rows,
  (SELECT count(*) FROM copies) - (SELECT count(*) FROM one) AS duplicate_rows,
  count(*) FILTER (WHERE cancelled = 1 OR diverted = 1) AS removed_rows,
  count(*) FILTER (WHERE cancelled = 0 AND diverted = 0) AS final_rows,
  CAST(count(*) FILTER (WHERE cancelled = 0 AND diverted = 0 AND dep_delay >= 15) AS DOUBLE)
    / count(*) FILTER (WHERE cancelled = 0 AND diverted = 0) * 100 AS delay_rate_pct FROM one"""
FENCE = "f AS (SELECT quantile_cont(dep_delay, 0.25) AS q1, quantile_cont(dep_delay, 0.75) AS q3 FROM operated), g AS (SELECT q1 - 1.5*(q3-q1) AS lo, q3 + 1.5*(q3-q1) AS hi FROM f)"
SPLIT = """CASE WHEN fl_date <= DATE '1999-12-31' THEN 'train' WHEN fl_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'valid'
  WHEN fl_date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31' THEN 'test' END AS split"""

SOURCES = {
    "scan_csv_monthly": sc("year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS file_month"),
    "scan_file_manifest": scheduled_sql(
        """SELECT coalesce(strftime(m, '%Y-%m'), f) AS file_month, CASE WHEN f IS NULL THEN 0 WHEN f LIKE '1996%' THEN 2 ELSE 1 END::BIGINT AS n_places,
          CASE WHEN m IS NULL THEN 'unexpected' WHEN f IS NULL THEN 'missing' WHEN f LIKE '1996%' THEN 'doubled' WHEN f = '1999-06' THEN 'empty' ELSE 'present' END AS status
        FROM generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) s(m) FULL JOIN (
          SELECT DISTINCT year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS f FROM scheduled WHERE year <> 1997 UNION SELECT '1999-06'
        ) ON f = strftime(m, '%Y-%m')"""
    ),
    "scan_csv_full": CSV_TOTALS,
    "scan_columns": op("year, month, is_delayed"),
    "scan_dates": operated_sql(
        "SELECT CAST(min(fl_date) AS VARCHAR) AS first_date, CAST(max(fl_date) AS VARCHAR) AS last_date, count(fl_date) AS n_dates FROM operated"
    ),
    "scan_limit": scheduled_sql(
        """SELECT CAST(fl_date AS VARCHAR) AS fl_date, op_unique_carrier, crs_dep_time, tail_num, air_time, arr_delay FROM scheduled
        ORDER BY fl_date, op_unique_carrier, crs_dep_time, tail_num NULLS FIRST, air_time, arr_delay NULLS FIRST LIMIT 1000"""
    ),
    "scan_table": op("airline_name, is_delayed"),
    "sink_csv_atomic": CSV_TOTALS,
    "sink_table_replace": op("year, delay_category"),
    "sink_verify_count": operated_sql("SELECT count(*) AS source_rows, count(*) AS loaded_rows, true AS ok FROM operated"),
    "sink_text_summary": operated_sql(
        f"""SELECT 'cleaning' AS section, metric, value FROM (
          SELECT unnest(['input_rows','duplicate_rows','removed_rows','final_rows']) AS metric,
                 unnest([CAST(input_rows AS VARCHAR), CAST(duplicate_rows AS VARCHAR), CAST(removed_rows AS VARCHAR), CAST(final_rows AS VARCHAR)]) AS value
          FROM ({CLEAN}))
        UNION ALL SELECT 'extremes', unnest(['n_checked', 'n_mismatched']),
          unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (WHERE is_delayed <> 1) AS VARCHAR)]) FROM operated WHERE dep_delay > 300
        UNION ALL SELECT 'schedule', unnest(['scheduled_flights','cancelled_flights','diverted_flights','cancellation_rate_pct','diversion_rate_pct']),
          unnest([CAST(scheduled_flights AS VARCHAR), CAST(cancelled_flights AS VARCHAR), CAST(diverted_flights AS VARCHAR),
                  CAST(cancellation_rate_pct AS VARCHAR), CAST(diversion_rate_pct AS VARCHAR)])
          FROM (SELECT {R.DISRUPT} FROM scheduled)""",
        COPIES,
    ),
}

REQUIRED = ("fl_date", "cancelled", "diverted", "dep_delay", "arr_delay", "crs_dep_time", "day_of_week", "origin", "dest")


def known(columns, source: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_values{extra} FROM {source}" for c in columns)


NAMED = f"sched AS (SELECT *, {CARRIER} AS airline_name FROM scheduled)"

QUALITY = {
    "dq_required_columns": scheduled_sql(
        known(REQUIRED, "scheduled", ", true AS present") + " UNION ALL SELECT 'tail_num', 0, false"
    ),
    "dq_snake_case": scheduled_sql(known(SCHEDULED_COLUMNS + ("airline_name",), "sched"), NAMED),
    "dq_keep_columns": op("year, op_unique_carrier, origin, cancellation_code"),
    "dq_date_column_probe": scheduled_sql(
        "SELECT 'fl_date' AS date_column, CAST(min(fl_date) AS VARCHAR) AS first_value, CAST(max(fl_date) AS VARCHAR) AS last_value FROM scheduled"
    ),
    "dq_row_conservation": scheduled_sql(
        "SELECT count(DISTINCT year*100 + month) AS n_sources, count(*) AS source_rows, count(*) AS merged_rows, true AS ok FROM scheduled"
    ),
    "dq_missing_counts": scheduled_sql(missing(SCHEDULED_COLUMNS, "sched", 10), f"sched AS (SELECT *, {CARRIER} AS airline_name FROM scheduled)"),
    "dq_missing_counts_after": operated_sql(missing(SCHEDULED_COLUMNS + FEATURE_COLUMNS, "operated", 100)),
    "dq_duplicate_count": scheduled_sql(
        "SELECT (SELECT count(*) FROM copies) - count(*) AS duplicate_rows, count(*) AS distinct_rows FROM one", COPIES
    ),
    "dq_iqr_outliers": operated_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, q1, q3, q1 - 1.5*(q3-q1) AS lower_fence, q3 + 1.5*(q3-q1) AS upper_fence,
            (SELECT count(*) FROM operated WHERE {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1)) AS n_outliers
            FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM operated)"""
            for c in ("arr_delay", "dep_delay", "distance")
        )
    ),
    "dq_extreme_delay_share": operated_sql(
        "SELECT "
        + ", ".join(
            f"count(*) FILTER (WHERE {c} > 300) AS n_extreme_{c}, CAST(count(*) FILTER (WHERE {c} > 300) AS DOUBLE) / count({c}) * 100 AS pct_extreme_{c}"
            for c in ("arr_delay", "dep_delay")
        )
        + " FROM operated"
    ),
    "dq_label_mismatch": operated_sql(
        "SELECT count(*) AS n_checked, count(*) FILTER (WHERE is_delayed <> 1) AS n_mismatched FROM operated WHERE dep_delay > 300"
    ),
    "dq_missing_arrival": scheduled_sql(
        "SELECT count(*) AS n_checked, count(*) FILTER (WHERE arr_delay IS NULL) AS n_missing_arrival FROM scheduled WHERE dep_delay > 300"
    ),
    "dq_clean_summary": scheduled_sql(CLEAN, COPIES),
    "dq_dataset_extent": operated_sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS scope, count(*) AS n_rows, CAST(min(fl_date) AS VARCHAR) AS first_date, CAST(max(fl_date) AS VARCHAR) AS last_date,"
            f" CAST(sum(is_delayed) AS DOUBLE) / count(*) * 100 AS delay_rate_pct FROM {source}"
            for name, source in (("all", "operated"), ("complete_years", "complete"))
        )
    ),
    "dq_nonempty_splits": operated_sql(
        "SELECT v AS split, count(split) AS n_rows, count(split) > 0 AS ok FROM (VALUES ('train'), ('valid'), ('test')) s(v)"
        f" LEFT JOIN (SELECT {SPLIT} FROM operated) ON v = split GROUP BY 1"
    ),
    "dq_export_identities": operated_sql(
        " UNION ALL ".join(
            f"SELECT '{k}' AS report, count(*) AS total_flights, CAST(sum(is_delayed) AS BIGINT) AS total_delayed, true AS ok FROM complete"
            for k in ("month", "quarter", "day_of_week", "dep_hour", "is_peak_hour", "is_weekend", "year", "distance_group")
        )
    ),
}

HOUR = "CASE WHEN crs_dep_time IS NOT NULL THEN least(crs_dep_time // 100, 23) END"
CAUSE_LABEL = """CASE main_delay_cause WHEN 'carrier_delay' THEN 'Carrier' WHEN 'late_aircraft_delay' THEN 'Late Aircraft'
  WHEN 'nas_delay' THEN 'National Airspace System' WHEN 'weather_delay' THEN 'Weather' WHEN 'security_delay' THEN 'Security'
  WHEN 'no_reported_cause' THEN 'No Reported Cause' ELSE main_delay_cause END AS cause_label"""

FEATURES = {
    "cast_numeric_lenient": scheduled_sql(tally("dep_delay", "lenient"), TEXT),
    "cast_date_lenient": scheduled_sql(tally("CAST(fl_date AS VARCHAR) AS fl_date", "lenient"), TEXT),
    "fill_flags": sc("cancelled, diverted, coalesce(dep_del15, 0) AS dep_del15, coalesce(arr_del15, 0) AS arr_del15"),
    "fill_minutes": sc("coalesce(dep_delay, 0.0) AS dep_delay, coalesce(arr_delay, 0.0) AS arr_delay, coalesce(carrier_delay, 0.0) AS carrier_delay"),
    "fill_labels": sc("coalesce(cancellation_code, 'not_cancelled') AS cancellation_code, coalesce(tail_num, 'unknown') AS tail_num"),
    "f_is_delayed": sc("CAST(dep_delay >= 15 AS INTEGER) AS is_delayed, CAST(arr_delay >= 15 AS INTEGER) AS is_late_arrival"),
    "f_delay_category": sc(f"{category('dep_delay')} AS delay_category"),
    "f_day_of_year": op("day_of_year"),
    "f_week_of_year": op("year, week_of_year"),
    "f_dep_hour": sc(f"crs_dep_time, {HOUR} AS dep_hour"),
    "f_is_peak_hour": op("dep_hour, is_peak_hour"),
    "f_is_weekend": op("day_of_week, is_weekend"),
    "f_route": op("route"),
    "f_main_delay_cause": op("main_delay_cause, delay_category"),
    "f_airline_name": op("op_unique_carrier, airline_name"),
    "f_distance_group": op(
        DISTANCE.replace("distance", "(CASE WHEN day_of_month <> 31 THEN distance END)") + " AS distance_group"
    ),
    "f_null_coalesce_causes": scheduled_sql("SELECT " + ", ".join(f"sum(coalesce({c}, 0.0)) AS sum_{c}" for c in CAUSES) + " FROM scheduled"),
    "f_safe_pct": operated_sql(
        f"SELECT dep_hour, {rate('sum(is_delayed)', 'count(*)')} AS late_pct, CAST(NULL AS DOUBLE) AS undefined_pct FROM operated GROUP BY 1"
    ),
    "f_time_recovered": op("arr_delay - dep_delay AS time_recovered"),
    "f_clip": sc(
        "CASE WHEN dep_delay IS NOT NULL THEN least(greatest(dep_delay, -10.0), 500.0) END AS dep_clipped,"
        " least(greatest(distance, 100.0), 2000.0) AS distance_clipped"
    ),
    "f_month_name": op(f"{R.MONTHS} AS month_name"),
    "f_quarter_label": op("'Q' || quarter AS quarter_label"),
    "f_day_name": op(f"{R.DAYS} AS day_name"),
    "f_peak_label": op("CASE is_peak_hour WHEN 1 THEN 'Peak' ELSE 'Off-Peak' END AS peak_label"),
    "f_weekend_label": op("CASE is_weekend WHEN 1 THEN 'Weekend' ELSE 'Weekday' END AS weekend_label"),
    "f_airport_label": op("origin || ' — ' || origin_city_name AS airport_label, origin || ' (' || origin_city_name || ')' AS airport_city"),
    "f_route_label": op("origin_city_name || ' → ' || dest_city_name AS route_label"),
    "f_cause_label": op(CAUSE_LABEL),
    "f_year_month": op("CAST(CAST(date_trunc('month', fl_date) AS DATE) AS VARCHAR) AS year_month"),
    "f_feature_title": operated_sql(
        """SELECT 'categorical__op_unique_carrier_' || op_unique_carrier AS raw_name,
          'Op Unique Carrier ' || upper(left(op_unique_carrier, 1)) || lower(substr(op_unique_carrier, 2)) AS feature, count(*) AS n_flights
          FROM operated GROUP BY ALL
        UNION ALL SELECT 'categorical__main_delay_cause_' || main_delay_cause, CASE main_delay_cause
          WHEN 'no_delay' THEN 'Main Delay Cause No Delay' WHEN 'no_reported_cause' THEN 'Main Delay Cause No Reported Cause'
          WHEN 'carrier_delay' THEN 'Main Delay Cause Carrier Delay' WHEN 'weather_delay' THEN 'Main Delay Cause Weather Delay'
          WHEN 'nas_delay' THEN 'Main Delay Cause Nas Delay' WHEN 'security_delay' THEN 'Main Delay Cause Security Delay'
          WHEN 'late_aircraft_delay' THEN 'Main Delay Cause Late Aircraft Delay' END, count(*) FROM operated GROUP BY ALL
        UNION ALL SELECT 'numeric__dep_hour', 'Dep Hour', count(*) FROM operated"""
    ),
}

FILTERS = {
    "flt_operated": sc("year, cancelled, diverted", "WHERE cancelled = 0 AND diverted = 0"),
    "flt_complete_years": op("year", "WHERE year < 2001"),
    "flt_delayed": op("airline_name", "WHERE is_delayed = 1"),
    "flt_drop_null_date": scheduled_sql(
        tally("CAST(year(fl_date) AS INTEGER) AS year", "lenient", "WHERE fl_date IS NOT NULL"), TEXT
    ),
    "flt_drop_null_target": sc("CAST(dep_delay >= 15 AS INTEGER) AS late", "WHERE dep_delay IS NOT NULL"),
    "flt_date_range": op("CAST(fl_date AS VARCHAR) AS fl_date", "WHERE fl_date BETWEEN DATE '2000-07-01' AND DATE '2000-09-30'"),
    "flt_agg_filter": operated_sql(
        f"SELECT airline_name, {mean2('dep_delay', 'is_delayed = 1')} AS avg_dep_delay_when_delayed,"
        " round(quantile_cont(dep_delay, 0.5) FILTER (WHERE is_delayed = 1), 2) AS median_dep_delay_when_delayed FROM complete GROUP BY 1"
    ),
    "flt_extreme": op("op_unique_carrier, dep_delay", "WHERE dep_delay > 300"),
    "flt_optional_fence": operated_sql(
        "SELECT 'drop' AS how, dep_delay, count(*) AS n_flights FROM operated, g WHERE dep_delay BETWEEN lo AND hi GROUP BY ALL"
        " UNION ALL SELECT 'cap', least(greatest(dep_delay, lo), hi), count(*) FROM operated, g GROUP BY ALL",
        FENCE,
    ),
}

JOINS = {
    "join_carrier_dim": op("op_unique_carrier, airline_name"),
    "join_lateral_argmax": scheduled_sql(
        f"SELECT {CAUSE} AS main_delay_cause, count(*) AS n_flights FROM late GROUP BY 1",
        "late AS (SELECT * REPLACE ("
        + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in CAUSES)
        + ") FROM scheduled WHERE dep_delay >= 15)",
    ),
    "join_spine_hours": R.SQL["e_hour_volume"],
    "join_spine_labels": operated_sql(
        "SELECT CASE v WHEN 1 THEN '15+ Minutes Late' ELSE 'Under 15 Minutes Late' END AS label, coalesce(n, 0) AS n_flights"
        " FROM range(2) s(v) LEFT JOIN (SELECT is_delayed AS v, count(*) AS n FROM complete GROUP BY 1) USING (v)"
    ),
}

AGGREGATES = {
    "agg_count": R.SQL["q00_total_rows"],
    "agg_sum_flag": operated_sql("SELECT airline_name, CAST(sum(is_delayed) AS BIGINT) AS delayed_flights FROM complete GROUP BY 1"),
    "agg_mean_rate": operated_sql(f"SELECT airline_name, {R.MEAN} AS mean_rate_pct FROM complete GROUP BY 1"),
    "agg_avg": operated_sql(f"SELECT year, {mean2('dep_delay')} AS avg_dep_delay, {mean2('air_time')} AS avg_air_time FROM complete GROUP BY 1"),
    "agg_percentile_cont": operated_sql(
        "SELECT airline_name, round(quantile_cont(dep_delay, 0.5), 2) AS median_minutes, round(quantile_cont(dep_delay, 0.9), 2) AS p90_minutes"
        " FROM complete GROUP BY 1"
    ),
    "agg_count_distinct": operated_sql(
        "SELECT count(DISTINCT airline_name) AS n_airlines, count(DISTINCT origin) AS n_origins, count(DISTINCT route) AS n_routes FROM complete"
    ),
    "agg_cond_sum": scheduled_sql(
        "SELECT op_unique_carrier, CAST(sum(CASE WHEN cancelled = 0 AND diverted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_operated FROM scheduled GROUP BY 1"
    ),
    "agg_minmax": operated_sql(
        "SELECT CAST(min(fl_date) AS VARCHAR) AS first_date, CAST(max(fl_date) AS VARCHAR) AS last_date,"
        " max(dep_delay) AS max_dep_delay, max(arr_delay) AS max_arr_delay FROM operated"
    ),
    "agg_describe": operated_sql(R.DESCRIBE.replace("FROM operated", "FROM complete")),
    "agg_value_counts": op("is_delayed", source="complete"),
    "agg_size": operated_sql("SELECT dep_hour, count(*) AS n_flights FROM complete GROUP BY 1"),
    "agg_pivot_year": operated_sql(R.pivot("airline_name", R.RATE_IN)),
    "agg_histogram_fixed": operated_sql(R.delay_hist("arr_delay").replace("FROM complete", "FROM operated")),
    "agg_histogram_equal": operated_sql(
        """SELECT CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n_flights FROM range(50) s(bin) LEFT JOIN (
          SELECT least(CAST(floor((air_time - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, count(*) AS n
          FROM operated, (SELECT min(air_time) AS lo, max(air_time) AS hi FROM operated) GROUP BY 1) USING (bin)"""
    ),
    "agg_pct_of_total": operated_sql(
        f"SELECT delay_category, n AS n_flights, {rate('n', '(sum(n) OVER ())')} AS pct_of_total"
        " FROM (SELECT delay_category, count(*) AS n FROM complete GROUP BY 1)"
    ),
    "agg_argmax_group": operated_sql(
        "SELECT (SELECT airline_name FROM r ORDER BY delay_rate_pct DESC, airline_name DESC LIMIT 1) AS most_delayed,"
        " (SELECT airline_name FROM r ORDER BY delay_rate_pct, airline_name LIMIT 1) AS least_delayed",
        f"r AS ({R.AIRLINE})",
    ),
    "agg_mean_multi": operated_sql(f"SELECT quarter, {R.CAUSE_AVG} FROM complete GROUP BY 1"),
    "agg_class_counts": operated_sql(
        "SELECT is_delayed, n AS n_rows, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS class_weight"
        " FROM (SELECT is_delayed, count(*) AS n FROM complete GROUP BY 1)"
    ),
}

ORDERING = {
    "srt_by_date": op("CAST(fl_date AS VARCHAR) AS fl_date"),
    "srt_report": operated_sql(R.AIRLINE_YEAR),
    "topk_global": R.SQL["e_top10_dep_delay"],
    "topk_per_group": operated_sql(
        "SELECT airline_name, main_delay_cause, n_flights FROM (SELECT *, row_number() OVER (PARTITION BY airline_name ORDER BY n_flights DESC, main_delay_cause) AS k"
        " FROM (SELECT airline_name, main_delay_cause, count(*) AS n_flights FROM complete WHERE is_delayed = 1 GROUP BY ALL)) WHERE k = 1"
    ),
    "win_total_share": R.SQL["q16_delay_causes"],
    "win_rank": operated_sql(
        "SELECT *, CAST(row_number() OVER (ORDER BY delay_rate_pct DESC, airline_name) AS INTEGER) AS rate_rank FROM r", f"r AS ({R.AIRLINE})"
    ),
    "set_concat_files": scheduled_sql(
        """SELECT year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS file_month, op_unique_carrier, count(*) AS n_flights, count(fl_date) AS n_dates,
          CASE WHEN month = 2 THEN count(tail_num) ELSE 0 END AS n_tails, CASE WHEN month = 3 THEN count(*) ELSE 0 END AS n_origins, sum(dep_delay) AS sum_dep_delay
        FROM scheduled WHERE year = 1996 AND month IN (2, 3) GROUP BY year, month, op_unique_carrier"""
    ),
    "set_distinct_rows": scheduled_sql(tally("year, tail_num IS NULL AS no_tail", "one"), COPIES),
    "spl_time": op(f"{SPLIT}, is_delayed"),
    "r_hour_rate_clipped": R.arr(R.hist("dep_hour")),
}

# fixed values: the columns of an operated flight, in order
FLIGHT_COLUMNS = (
    "year quarter month day_of_month day_of_week fl_date op_unique_carrier tail_num crs_dep_time dep_delay "
    "dep_delay_new dep_del15 arr_delay arr_delay_new arr_del15 cancelled cancellation_code diverted "
    "air_time carrier_delay weather_delay nas_delay security_delay late_aircraft_delay is_delayed "
    "delay_category day_of_year week_of_year dep_hour is_weekend main_delay_cause is_peak_hour "
    "airline_name"
).split()


def row_text(columns, *before: str) -> str:
    return "concat_ws('|', " + ", ".join([*before, *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns]]) + ")"


def drawn(*before: str) -> str:
    """Whether a flight is among the ten hundredths that its hash selects."""
    return f"CAST('0x' || substr(md5({row_text(FLIGHT_COLUMNS, *before)}), 1, 15) AS BIGINT) % 100 < 10"


def sampled(*before: str) -> str:
    return operated_sql(
        "SELECT year, count(*) AS n_flights, nullif(count(*) FILTER (WHERE drawn), 0) AS n_sampled"
        f" FROM (SELECT year, {drawn(*before)} AS drawn FROM operated) GROUP BY 1"
    )


PICKED = ("fl_date", "op_unique_carrier", "crs_dep_time", "tail_num", "air_time", "is_delayed")

SAMPLES = {
    "smp_fraction": sampled("'42'"),
    "smp_stratified_chunks": sampled("'42'", "CAST(year AS VARCHAR)"),
    "spl_sample_rows": operated_sql(
        f"""SELECT is_delayed, count(*) AS n_flights FROM (
          SELECT is_delayed FROM operated WHERE fl_date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31'
          ORDER BY md5({row_text(PICKED, "'42'")}), {", ".join(PICKED)} LIMIT 1000) GROUP BY 1"""
    ),
}

SQL = {**SAMPLES, **SOURCES, **QUALITY, **FEATURES, **FILTERS, **JOINS, **AGGREGATES, **ORDERING}
