"""Expected results of the report, history, exploration and dashboard queries."""

from oracles.base import category, mean2, operated_sql, rate, scheduled_sql, CARRIER

N = "CAST(count(*) AS BIGINT)"
LATE = "CAST(sum(is_delayed) AS BIGINT)"
RATES = f"{N} AS total_operated_flights, {LATE} AS delayed_flights, {rate('sum(is_delayed)', 'count(*)')} AS delay_rate_pct"


def by(keys: str, having: str = "", extra: str = "", source: str = "complete") -> str:
    return f"SELECT {keys}, {RATES}{extra} FROM {source} GROUP BY {keys} {having}"


def sev(key: str, m: str, suffix: str) -> str:
    return (
        f"{mean2(m + '_delay')} AS avg_{m}_delay{suffix}, "
        f"round(quantile_cont({m}_delay, 0.5), 2) AS median_{m}_delay{suffix}, "
        f"round(quantile_cont({m}_delay, 0.9), 2) AS p90_{m}_delay{suffix}"
    )


def airline_sev(m: str) -> str:
    return (
        f"SELECT airline_name, {N} AS delayed_flights, {sev('airline_name', m, '_when_delayed')} "
        "FROM complete WHERE is_delayed = 1 GROUP BY airline_name HAVING count(*) > 569"
    )


SCHED = f"sched AS (SELECT *, {CARRIER} AS airline_name FROM scheduled)"
DISRUPT = (
    f"{N} AS scheduled_flights, CAST(sum(cancelled) AS BIGINT) AS cancelled_flights, "
    "CAST(sum(diverted) AS BIGINT) AS diverted_flights, "
    f"{rate('sum(cancelled)', 'count(*)')} AS cancellation_rate_pct, "
    f"{rate('sum(diverted)', 'count(*)')} AS diversion_rate_pct"
)
AIRLINE = by("airline_name", "HAVING count(*) > 2580")
AIRPORT = by("origin, origin_city_name", "HAVING count(*) >= 2000", f", {mean2('dep_delay')} AS avg_dep_delay")
ROUTE = by("origin_city_name, dest_city_name, route", "HAVING count(*) >= 111")
AIRLINE_YEAR = by("year, airline_name", "HAVING count(*) >= 428")
CAUSE_SHARE = f"""SELECT main_delay_cause, delayed_flights, {rate('delayed_flights', '(sum(delayed_flights) OVER ())')} AS pct_of_delayed_flights
FROM (SELECT main_delay_cause, {N} AS delayed_flights FROM complete WHERE is_delayed = 1 GROUP BY 1)"""
DIST_SEV = (
    f"SELECT distance_group, {N} AS delayed_flights, {sev('', 'dep', '')}, {sev('', 'arr', '')} "
    "FROM complete WHERE is_delayed = 1 GROUP BY distance_group"
)
KPI = f"""SELECT {N} AS total_operated_flights, {LATE} AS total_delayed_flights,
  {rate('sum(is_delayed)', 'count(*)')} AS overall_delay_rate_pct,
  count(DISTINCT airline_name) AS total_airlines, count(DISTINCT origin) AS total_origin_airports,
  count(DISTINCT route) AS total_routes,
  {mean2('dep_delay', 'is_delayed = 1')} AS avg_dep_delay_when_delayed,
  round(quantile_cont(dep_delay, 0.5) FILTER (WHERE is_delayed = 1), 2) AS median_dep_delay_when_delayed
FROM complete"""

REPORTS = {
    "q00_total_rows": operated_sql(f"SELECT {N} AS total_rows FROM operated"),
    "q01_airline_delay_rate": operated_sql(AIRLINE),
    "q02_airline_delay_volume": operated_sql(AIRLINE),
    "q03_airline_dep_severity": operated_sql(airline_sev("dep")),
    "q04_airline_arr_severity": operated_sql(airline_sev("arr")),
    "q05_airline_cancel_divert": scheduled_sql(f"SELECT airline_name, {DISRUPT} FROM sched GROUP BY 1", SCHED),
    "q06_airport_delay_rate": operated_sql(AIRPORT),
    "q08_route_delay_rate": operated_sql(ROUTE),
    "q10_month": operated_sql(by("month")),
    "q11_quarter": operated_sql(by("quarter")),
    "q12_day_of_week": operated_sql(by("day_of_week")),
    "q13_dep_hour": operated_sql(by("dep_hour")),
    "q14_peak": operated_sql(by("is_peak_hour")),
    "q15_weekend": operated_sql(by("is_weekend")),
    "q16_delay_causes": operated_sql(CAUSE_SHARE),
    "q17_distance_severity": operated_sql(DIST_SEV),
    "q18_distance_rate": operated_sql(by("distance_group")),
    "q19_year": operated_sql(by("year")),
    "q21_airline_year": operated_sql(AIRLINE_YEAR),
    "q23_volume_by_year": scheduled_sql(
        f"SELECT year, {N} AS scheduled_flights, CAST(sum(CASE WHEN cancelled = 0 AND diverted = 0 THEN 1 ELSE 0 END) AS BIGINT)"
        " AS operated_non_diverted_flights, CAST(sum(cancelled) AS BIGINT) AS cancelled_flights,"
        " CAST(sum(diverted) AS BIGINT) AS diverted_flights FROM scheduled WHERE year < 2001 GROUP BY year"
    ),
    "q24_kpi_overview": operated_sql(KPI),
    "q25_cancel_divert_kpi": scheduled_sql(f"SELECT {DISRUPT} FROM scheduled"),
}


def hist(keys: str, pct: str = "delay_rate", late: str | None = "delayed_flights_count", extra: str = "",
         having: str = "", source: str = "operated") -> str:
    late_col = f", {LATE} AS {late}" if late else ""
    return (
        f"SELECT {keys}, {N} AS total_flights{late_col}, {rate('sum(is_delayed)', 'count(*)')} AS {pct}{extra}"
        f" FROM {source} GROUP BY ALL {having}"
    )


def arr(body: str, *ctes: str) -> str:
    return operated_sql(body, *ctes, label="arr")


WHEN_LATE = (
    f"{mean2('arr_delay', 'is_delayed = 1')} AS avg_arr_delay_when_delayed, "
    f"{mean2('dep_delay', 'is_delayed = 1')} AS avg_dep_delay_when_delayed, {N} AS total_flights"
)
CAUSE_AVG = ", ".join(
    f"{mean2(c)} AS avg_{c}"
    for c in ("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")
)
AIRLINE_EXACT = "a AS (SELECT airline_name, sum(is_delayed)/count(*) AS r FROM operated GROUP BY 1 HAVING count(*) > 2580)"
AIRPORT_EXACT = "p AS (SELECT origin, origin_city_name, sum(is_delayed)/count(*) AS r FROM operated GROUP BY 1, 2 HAVING count(*) >= 2200)"

HISTORY = {
    "r_airline_year_severity": arr(f"SELECT year, airline_name, {WHEN_LATE} FROM complete GROUP BY 1, 2 HAVING count(*) >= 428"),
    "r_airline_time_recovered": arr(
        f"SELECT airline_name, {N} AS total_flights, {mean2('dep_delay')} AS avg_dep_delay, {mean2('arr_delay')} AS avg_arr_delay,"
        f" {mean2('(arr_delay - dep_delay)')} AS time_recovered FROM operated GROUP BY 1 HAVING count(*) > 2580"
    ),
    "r_airline_cause_minutes": arr(f"SELECT airline_name, {CAUSE_AVG} FROM operated GROUP BY 1 HAVING count(*) > 2580"),
    "r_airline_rate_arr": arr(hist("airline_name", "delay_rate_pct", "delayed_flights", having="HAVING count(*) > 2580")),
    "r_airline_year_rate": arr(hist("year, airline_name", "delay_rate_pct", None, having="HAVING count(*) >= 428", source="complete")),
    "r_airport_rate": arr(
        hist("origin, origin_city_name, origin_state_abr, origin || ' (' || origin_city_name || ')' AS airport",
             extra=f", {mean2('dep_delay')} AS avg_dep_delay", having="HAVING count(*) >= 2200")
    ),
    "r_year_severity": arr(f"SELECT year, {WHEN_LATE} FROM operated GROUP BY 1"),
    "r_distance_avg_arr": arr(hist("distance_group", "delay_rate_pct", None, f", {mean2('arr_delay')} AS avg_arr_delay")),
    "r_delay_category_share": arr(
        f"""SELECT CASE delay_category WHEN 'early_on_time' THEN 'Early/On Time' WHEN 'minor_1_15' THEN 'Minor (1-15)'
        WHEN 'moderate_16_60' THEN 'Moderate (16-60)' WHEN 'severe_61_120' THEN 'Severe (61-120)' ELSE 'Extreme (120+)' END AS delay_category,
        n AS total_flights, {rate('n', '(sum(n) OVER ())')} AS pct_of_total
        FROM (SELECT delay_category, {N} AS n FROM operated GROUP BY 1)"""
    ),
    "r_cause_minutes_year": arr(f"SELECT year, {CAUSE_AVG} FROM operated GROUP BY 1"),
    "r_hour_rate": arr(hist("crs_dep_time // 100 AS dep_hour")),
    "r_kpi_card": arr(
        f"""SELECT {N} AS total_flights, {LATE} AS total_delayed, {rate('sum(is_delayed)', 'count(*)')} AS overall_delay_rate,
        {mean2('arr_delay')} AS avg_arr_delay, {mean2('dep_delay')} AS avg_dep_delay,
        {mean2('(arr_delay - dep_delay)')} AS avg_time_recovered,
        {mean2('arr_delay', 'is_delayed = 1')} AS avg_arr_delay_when_delayed,
        {mean2('dep_delay', 'is_delayed = 1')} AS avg_dep_delay_when_delayed,
        max(arr_delay) AS max_arr_delay, max(dep_delay) AS max_dep_delay,
        count(DISTINCT origin) AS total_airports, count(DISTINCT airline_name) AS total_airlines, count(DISTINCT route) AS total_routes,
        (SELECT airline_name FROM a ORDER BY r DESC, airline_name DESC LIMIT 1) AS most_delayed_airline,
        (SELECT airline_name FROM a ORDER BY r, airline_name LIMIT 1) AS least_delayed_airline,
        (SELECT origin_city_name FROM p ORDER BY r DESC, origin_city_name DESC LIMIT 1) AS most_delayed_airport,
        (SELECT origin_city_name FROM p ORDER BY r, origin_city_name LIMIT 1) AS least_delayed_airport
        FROM operated""",
        AIRLINE_EXACT, AIRPORT_EXACT,
    ),
    "r_month_rate": arr(hist("month")),
    "r_quarter_rate": arr(hist("quarter")),
    "r_weekday_rate": arr(
        hist("day_of_week, day_of_week || ' - ' || (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[day_of_week] AS day_name")
    ),
    "r_year_month_series": arr(
        hist("year, month, CAST(make_date(year, month, 1) AS VARCHAR) AS year_month", late="delayed_flights")
    ),
    "r_year_quarter": arr(hist("year, quarter", "delay_rate_pct", None)),
    "r_cause_share_arr": arr(
        f"""SELECT main_delay_cause, n AS total_flights, {rate('n', '(sum(n) OVER ())')} AS pct_of_total
        FROM (SELECT upper(main_delay_cause) AS main_delay_cause, {N} AS n FROM operated
              WHERE is_delayed = 1 AND main_delay_cause <> 'no_reported_cause' GROUP BY 1)"""
    ),
    "r_route_rate": arr(hist("origin_city_name || ' → ' || dest_city_name AS route_name, route", having="HAVING count(*) >= 111")),
    "r_route_topk": arr(
        hist("origin_city_name, dest_city_name, route", having="HAVING count(*) >= 111") + " ORDER BY delay_rate DESC, route LIMIT 10"
    ),
    "r_year_rate": arr(hist("year", "delay_rate_pct", "delayed_flights")),
}

MEAN = "CAST(sum(is_delayed) AS DOUBLE) / count(*) * 100"
YEARS = range(1995, 2001)


def pivot(key: str, measure: str) -> str:
    cols = ", ".join(measure.format(w=f"FILTER (WHERE year = {y})") + f" AS y{y}" for y in YEARS)
    return f"SELECT {key}, {cols} FROM complete GROUP BY {key}"


RATE_IN = "CAST(sum(is_delayed) {w} AS DOUBLE) / count(*) {w} * 100"


def delay_hist(m: str) -> str:
    return f"""SELECT CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n_flights, CAST(-60 + bin*5 AS INTEGER) AS bin_start
    FROM range(112) s(bin) LEFT JOIN (
      SELECT least(CAST(floor((least(greatest({m}, -60), 500) + 60) / 5) AS BIGINT), 111) AS bin, {N} AS n FROM complete GROUP BY 1) USING (bin)"""


DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n_values, round(avg({c}), 6) AS mean, min({c}) AS min,
    quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.9) AS p90,
    quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99, max({c}) AS max, round(stddev_samp({c}), 6) AS std FROM operated"""
    for c in ("arr_delay", "dep_delay", "distance")
)

EXPLORE = {
    "e_delay_share": operated_sql(
        """SELECT CASE v WHEN 1 THEN '15+ Minutes Late' ELSE 'Under 15 Minutes Late' END AS label, coalesce(n, 0) AS n_flights,
        CAST(coalesce(n, 0) AS DOUBLE) / sum(n) OVER () * 100 AS share_pct
        FROM range(2) s(v) LEFT JOIN (SELECT is_delayed AS v, count(*) AS n FROM complete GROUP BY 1) USING (v)"""
    ),
    "e_year_rate": operated_sql(f"SELECT year, {MEAN} AS mean_rate_pct FROM complete GROUP BY 1"),
    "e_month_rate": operated_sql(f"SELECT month, {MEAN} AS mean_rate_pct FROM complete GROUP BY 1"),
    "e_hour_rate": operated_sql(f"SELECT dep_hour, {MEAN} AS mean_rate_pct FROM complete GROUP BY 1"),
    "e_month_year_pivot": operated_sql(pivot("month", RATE_IN)),
    "e_hour_year_pivot": operated_sql(pivot("dep_hour", RATE_IN)),
    "e_month_year_volume_pivot": operated_sql(pivot("month", "count(*) {w}")),
    "e_year_volume": operated_sql("SELECT year, count(*) AS n_flights FROM complete GROUP BY 1"),
    "e_hour_volume": operated_sql(
        "SELECT CAST(h AS INTEGER) AS dep_hour, coalesce(n, 0) AS n_flights FROM range(24) s(h)"
        " LEFT JOIN (SELECT dep_hour AS h, count(*) AS n FROM complete GROUP BY 1) USING (h)"
    ),
    "e_delay_hist_arr": operated_sql(delay_hist("arr_delay")),
    "e_delay_hist_dep": operated_sql(delay_hist("dep_delay")),
    "e_distance_hist": operated_sql(
        f"""SELECT CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n_flights FROM range(50) s(bin) LEFT JOIN (
          SELECT least(CAST(floor((v - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, {N} AS n
          FROM miles, (SELECT min(v) AS lo, max(v) AS hi FROM miles) GROUP BY 1) USING (bin)""",
        "miles AS (SELECT least(greatest(distance, 0.0), 4000.0) AS v FROM complete)",
    ),
    "e_outlier_describe": operated_sql(DESCRIBE),
    "e_top10_dep_delay": operated_sql(
        """SELECT CAST(fl_date AS VARCHAR) AS fl_date, op_unique_carrier, dep_delay, arr_delay, distance, is_delayed,
        arr_delay - dep_delay AS arrival_minus_departure FROM operated WHERE dep_delay > 300
        ORDER BY dep_delay DESC, fl_date, op_unique_carrier, arr_delay, distance LIMIT 10"""
    ),
}


def labelled(key: str, label: str) -> str:
    return operated_sql(
        f"SELECT '{key}' AS dimension, CAST({key} AS VARCHAR) AS member, {label} AS label,"
        f" total_operated_flights, delayed_flights, delay_rate_pct FROM r",
        f"r AS ({by(key)})",
    )


def sev_long(table: str, key: str, names: list[str]) -> str:
    return operated_sql(
        " UNION ALL ".join(f"SELECT {key}, delayed_flights, '{n}' AS measure, {n} AS minutes FROM s" for n in names),
        f"s AS ({table})",
    )


def top_airport(measure: str, order: str = "DESC") -> str:
    value = "round(avg(delay_rate_pct), 6)" if measure == "delay_rate_pct" else f"CAST(sum({measure}) AS DOUBLE)"
    return operated_sql(
        f"SELECT origin || ' — ' || origin_city_name AS airport_label, {value} AS measure FROM r GROUP BY 1"
        f" ORDER BY measure {order}, airport_label LIMIT 10",
        f"r AS ({AIRPORT})",
    )


MONTHS = "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month]"
DAYS = "(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[day_of_week]"
DEP_NAMES = [f"{m}_dep_delay_when_delayed" for m in ("avg", "median", "p90")]
ARR_NAMES = [f"{m}_arr_delay_when_delayed" for m in ("avg", "median", "p90")]
DIST_NAMES = [f"{m}_{s}_delay" for s in ("dep", "arr") for m in ("avg", "median", "p90")]

DASHBOARDS = {
    "d_kpi_cards": operated_sql(
        " UNION ALL ".join(
            f"SELECT '{text}' AS kpi, CAST({c} AS DOUBLE) AS value FROM k"
            for c, text in (
                ("total_operated_flights", "Operated Flights"), ("total_delayed_flights", "15+ Minutes Late"),
                ("overall_delay_rate_pct", "Departure Delay Rate"), ("total_airlines", "Airlines"),
                ("total_origin_airports", "Origin Airports"), ("total_routes", "Routes"),
            )
        ),
        f"k AS ({KPI})",
    ),
    "d_classification_share": operated_sql(
        f"""SELECT class_name, n_flights, {rate('n_flights', '(sum(n_flights) OVER ())')} AS pct_of_total FROM (
          SELECT CASE is_delayed WHEN 1 THEN '15+ Minutes Late' ELSE 'Under 15 Minutes Late' END AS class_name, {N} AS n_flights
          FROM complete GROUP BY 1)"""
    ),
    "d_rate_and_volume_year": labelled("year", "CAST(year AS VARCHAR)"),
    "d_rate_and_volume_month": labelled("month", MONTHS),
    "d_rate_and_volume_quarter": labelled("quarter", "'Q' || quarter"),
    "d_rate_and_volume_weekday": labelled("day_of_week", DAYS),
    "d_rate_and_volume_hour": labelled("dep_hour", "CAST(dep_hour AS VARCHAR)"),
    "d_rate_and_volume_peak": labelled("is_peak_hour", "CASE is_peak_hour WHEN 1 THEN 'Peak' ELSE 'Off-Peak' END"),
    "d_rate_and_volume_weekend": labelled("is_weekend", "CASE is_weekend WHEN 1 THEN 'Weekend' ELSE 'Weekday' END"),
    "d_rate_and_volume_distance": labelled("distance_group", "distance_group"),
    "d_airline_rate": operated_sql(AIRLINE),
    "d_airline_volume": operated_sql(AIRLINE),
    "d_airline_year": operated_sql(
        "SELECT *, CASE WHEN year = 1995 THEN '1995' ELSE '1996–2000' END AS coverage FROM r", f"r AS ({AIRLINE_YEAR})"
    ),
    "d_airline_severity_long": sev_long(airline_sev("dep"), "airline_name", DEP_NAMES),
    "d_airline_severity_long_arr": sev_long(airline_sev("arr"), "airline_name", ARR_NAMES),
    "d_airport_top_rate": top_airport("delay_rate_pct"),
    "d_airport_top_volume": top_airport("delayed_flights"),
    "d_route_rate": operated_sql(ROUTE),
    "d_route_volume": operated_sql(ROUTE),
    "d_cause_bar": operated_sql(
        """SELECT *, CASE main_delay_cause WHEN 'carrier_delay' THEN 'Carrier' WHEN 'late_aircraft_delay' THEN 'Late Aircraft'
        WHEN 'nas_delay' THEN 'National Airspace System' WHEN 'weather_delay' THEN 'Weather' WHEN 'security_delay' THEN 'Security'
        WHEN 'no_reported_cause' THEN 'No Reported Cause' ELSE main_delay_cause END AS cause_label FROM r""",
        f"r AS ({CAUSE_SHARE})",
    ),
    "d_distance_severity_long": sev_long(DIST_SEV, "distance_group", DIST_NAMES),
    "d_action_filter": operated_sql(
        "SELECT * FROM y WHERE airline_name IN (SELECT airline_name FROM r ORDER BY delay_rate_pct DESC, airline_name LIMIT 3)",
        f"r AS ({AIRLINE})", f"y AS ({AIRLINE_YEAR})",
    ),
    "d_reaggregate": operated_sql(
        "SELECT airline_name, CAST(sum(total_operated_flights) AS BIGINT) AS sum_flights, CAST(sum(delayed_flights) AS BIGINT) AS sum_delayed,"
        " round(avg(delay_rate_pct), 6) AS avg_rate_pct, count(*) AS report_rows FROM y GROUP BY 1",
        f"y AS ({AIRLINE_YEAR})",
    ),
    "join_pair_rank": operated_sql(
        """SELECT airline_name, delay_rate_pct, CAST(row_number() OVER (ORDER BY delay_rate_pct DESC, airline_name) AS INTEGER) AS rate_rank,
        delayed_flights, CAST(row_number() OVER (ORDER BY delayed_flights DESC, airline_name) AS INTEGER) AS volume_rank FROM r""",
        f"r AS ({AIRLINE})",
    ),
    "topk_tableau_airport_rate": top_airport("delay_rate_pct"),
    "topk_tableau_airport_volume": top_airport("delayed_flights"),
    "topk_bottom": top_airport("delay_rate_pct", "ASC"),
    "topk_bottom_routes": operated_sql(ROUTE + " ORDER BY delay_rate_pct, route LIMIT 10"),
    "f_under15": operated_sql(f"SELECT {N} - {LATE} AS under_15_minutes_late FROM complete"),
    "f_coverage_label": operated_sql(
        "SELECT CASE WHEN year = 1995 THEN '1995' ELSE '1996–2000' END AS coverage,"
        " CAST(sum(total_operated_flights) AS BIGINT) AS n_flights FROM y GROUP BY 1",
        f"y AS ({AIRLINE_YEAR})",
    ),
    "flt_having_min_volume": operated_sql(
        by("airline_name, origin_state_abr || '_' || dest_state_abr AS state_pair").replace(
            "GROUP BY airline_name, origin_state_abr || '_' || dest_state_abr AS state_pair", "GROUP BY ALL HAVING count(*) >= 111"
        )
    ),
}

SQL = {**REPORTS, **HISTORY, **EXPLORE, **DASHBOARDS}
