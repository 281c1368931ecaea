"""The flight table as ANSI SQL common table expressions over the base tables."""

from punctual.functions.features import DISTANCE_GROUPS
from punctual.sources.carriers import CARRIER_NAMES

SCHEDULED = """
line AS (
  SELECT *, CAST(l_shipdate AS DATE) AS fl_date,
         l_orderkey*31 + l_partkey*17 + l_linenumber*7919 + l_suppkey*101 AS h,
         (l_orderkey*13 + l_partkey*7 + l_linenumber*977) % 1441 AS t
  FROM lineitem
), dated AS (
  SELECT *, CAST((t - t % 60) / 60 AS INTEGER) AS hh,
         CAST(month(fl_date) AS INTEGER) AS mo, CAST(isodow(fl_date) AS INTEGER) AS dow
  FROM line
), shifted AS (
  SELECT *, h % 1000 + 6*hh + CASE WHEN mo IN (6,7) THEN 60 ELSE 0 END
            + CASE WHEN dow IN (4,5,7) THEN 20 ELSE 0 END AS u
  FROM dated
), departed AS (
  SELECT *, CAST(CASE WHEN h % 1000 >= 995 THEN NULL WHEN u < 650 THEN -(h % 20)
       WHEN u < 860 THEN h % 15 WHEN u < 1020 THEN 15 + h % 46
       WHEN u < 1070 THEN 61 + h % 60 ELSE 121 + (h % 25)*40 END AS DOUBLE) AS dd
  FROM shifted
), arrived AS (
  SELECT *, CASE WHEN h % 991 = 0 THEN NULL
            ELSE dd - 10 + (l_partkey*3 + l_orderkey) % 21 END AS ad
  FROM departed
), scheduled AS (
  SELECT CAST(year(fl_date) AS INTEGER) AS year, CAST(quarter(fl_date) AS INTEGER) AS quarter,
    mo AS month, CAST(day(fl_date) AS INTEGER) AS day_of_month, dow AS day_of_week, fl_date,
    (['AA','AS','B6','DL','F9','G4','HA','NK','OH','OO','QX','UA','WN','YV','YX','MQ','9E','PT','EV','ZZ'])[CAST(l_suppkey % 20 AS INTEGER) + 1] AS op_unique_carrier,
    CASE WHEN h % 97 = 0 THEN NULL ELSE 'N' || CAST(l_partkey AS VARCHAR) END AS tail_num,
    'A' || lpad(CAST(o.n_nationkey AS VARCHAR), 2, '0') AS origin, o.n_name AS origin_city_name,
    'S' || CAST(o.n_regionkey AS VARCHAR) AS origin_state_abr,
    'A' || lpad(CAST(d.n_nationkey AS VARCHAR), 2, '0') AS dest, d.n_name AS dest_city_name,
    'S' || CAST(d.n_regionkey AS VARCHAR) AS dest_state_abr,
    hh*100 + CAST(t % 60 AS INTEGER) AS crs_dep_time,
    dd AS dep_delay, CASE WHEN dd > 0 THEN dd ELSE 0 END AS dep_delay_new,
    CASE WHEN dd IS NULL THEN NULL WHEN dd >= 15 THEN 1 ELSE 0 END AS dep_del15,
    ad AS arr_delay, CASE WHEN ad > 0 THEN ad ELSE 0 END AS arr_delay_new,
    CASE WHEN ad IS NULL THEN NULL WHEN ad >= 15 THEN 1 ELSE 0 END AS arr_del15,
    CASE WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN 1 ELSE 0 END AS cancelled,
    CASE WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN 'B' END AS cancellation_code,
    CASE WHEN (l_partkey + l_linenumber) % 211 = 0 THEN 1 ELSE 0 END AS diverted,
    30 + l_quantity*8 AS air_time,
    CAST(67 + (l_partkey*37 + o.n_nationkey*41 + d.n_nationkey*43) % 2500 AS DOUBLE) AS distance,
    CASE WHEN ad >= 15 AND h % 7 <> 6 THEN CASE h % 7 WHEN 0 THEN ad WHEN 5 THEN 7.0 ELSE 0.0 END END AS carrier_delay,
    CASE WHEN ad >= 15 AND h % 7 <> 6 THEN CASE h % 7 WHEN 1 THEN ad ELSE 0.0 END END AS weather_delay,
    CASE WHEN ad >= 15 AND h % 7 <> 6 THEN CASE h % 7 WHEN 2 THEN ad ELSE 0.0 END END AS nas_delay,
    CASE WHEN ad >= 15 AND h % 7 <> 6 THEN CASE h % 7 WHEN 3 THEN ad ELSE 0.0 END END AS security_delay,
    CASE WHEN ad >= 15 AND h % 7 <> 6 THEN CASE h % 7 WHEN 4 THEN ad WHEN 5 THEN 7.0 ELSE 0.0 END END AS late_aircraft_delay
  FROM arrived
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation d ON c_nationkey = d.n_nationkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation o ON s_nationkey = o.n_nationkey
)"""

CARRIER = "CASE op_unique_carrier {} ELSE op_unique_carrier END".format(
    " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in CARRIER_NAMES.items())
)

CAUSE = """CASE WHEN greatest(carrier_delay, weather_delay, nas_delay, security_delay, late_aircraft_delay) <= 0 THEN 'no_reported_cause'
    WHEN carrier_delay >= greatest(weather_delay, nas_delay, security_delay, late_aircraft_delay) THEN 'carrier_delay'
    WHEN weather_delay >= greatest(nas_delay, security_delay, late_aircraft_delay) THEN 'weather_delay'
    WHEN nas_delay >= greatest(security_delay, late_aircraft_delay) THEN 'nas_delay'
    WHEN security_delay >= late_aircraft_delay THEN 'security_delay'
    ELSE 'late_aircraft_delay' END"""

DISTANCE = "CASE {} ELSE '{}' END".format(
    " ".join(f"WHEN distance < {upper} THEN '{name}'" for name, upper in DISTANCE_GROUPS[:-1]), DISTANCE_GROUPS[-1][0]
)


def category(minutes: str) -> str:
    return (
        f"CASE WHEN {minutes} <= 0 THEN 'early_on_time' WHEN {minutes} <= 15 THEN 'minor_1_15'"
        f" WHEN {minutes} <= 60 THEN 'moderate_16_60' WHEN {minutes} <= 120 THEN 'severe_61_120'"
        f" WHEN {minutes} > 120 THEN 'extreme_120_plus' END"
    )


def operated(label: str = "dep") -> str:
    minutes = f"{label}_delay"
    return f"""
filled AS (
  SELECT * REPLACE (
      coalesce(dep_del15, 0) AS dep_del15, coalesce(arr_del15, 0) AS arr_del15,
      coalesce(carrier_delay, 0.0) AS carrier_delay, coalesce(weather_delay, 0.0) AS weather_delay,
      coalesce(nas_delay, 0.0) AS nas_delay, coalesce(security_delay, 0.0) AS security_delay,
      coalesce(late_aircraft_delay, 0.0) AS late_aircraft_delay,
      coalesce(dep_delay, 0.0) AS dep_delay, coalesce(arr_delay, 0.0) AS arr_delay,
      coalesce(air_time, 0.0) AS air_time,
      coalesce(cancellation_code, 'not_cancelled') AS cancellation_code,
      coalesce(tail_num, 'unknown') AS tail_num)
  FROM scheduled WHERE cancelled = 0 AND diverted = 0 AND fl_date IS NOT NULL
), operated AS (
  SELECT *, CASE WHEN {minutes} >= 15 THEN 1 ELSE 0 END AS is_delayed,
    {category(minutes)} AS delay_category,
    CAST(dayofyear(fl_date) AS INTEGER) AS day_of_year, CAST(weekofyear(fl_date) AS INTEGER) AS week_of_year,
    least(crs_dep_time // 100, 23) AS dep_hour,
    CASE WHEN least(crs_dep_time // 100, 23) BETWEEN 5 AND 9 OR least(crs_dep_time // 100, 23) BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS is_peak_hour,
    CASE WHEN day_of_week >= 6 THEN 1 ELSE 0 END AS is_weekend,
    origin || '_' || dest AS route,
    CASE WHEN {minutes} < 15 THEN 'no_delay' ELSE {CAUSE} END AS main_delay_cause,
    {CARRIER} AS airline_name,
    {DISTANCE} AS distance_group
  FROM filled
)"""


COMPLETE = "complete AS (SELECT * FROM operated WHERE year < 2001)"


def scheduled_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((SCHEDULED,) + ctes) + "\n" + body


def operated_sql(body: str, *ctes: str, label: str = "dep") -> str:
    return "WITH RECURSIVE " + ",\n".join((SCHEDULED, operated(label), COMPLETE) + ctes) + "\n" + body


def rate(part: str, whole: str) -> str:
    """Two-digit percentage on whole numbers, half away from zero."""
    return f"(((20000*CAST({part} AS BIGINT) + {whole}) // nullif(2*CAST({whole} AS BIGINT), 0)) / 100.0)"


def mean2(expr: str, where: str = "") -> str:
    """Two-digit mean of whole minutes, half away from zero, on whole numbers."""
    f = f" FILTER (WHERE {where})" if where else ""
    s = f"CAST(sum({expr}){f} AS BIGINT)"
    n = f"CAST(count({expr}){f} AS BIGINT)"
    return f"(sign({s}) * ((200*abs({s}) + {n}) // nullif(2*{n}, 0)) / 100.0)"
