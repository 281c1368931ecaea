"""The ``flights`` table as seen by every plan.

On a deployment this is the cleaned Parquet table written by
:mod:`punctual.operators.sinks`. For the generated test tables the same columns
are derived from ``lineitem`` and its dimensions.

Origin and destination need the order, customer and supplier tables; carrier,
calendar, delay and cause columns do not. ``places=False`` therefore reads
``lineitem`` alone. The dimensions are keyed uniquely and joined LEFT, so the two
variants hold the same flights. No side is marked for broadcast: the optimizer
decides by measured size, and beyond its limit the adaptive skew join splits a
key that holds many flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators.cleaning import add_features, drop_undated, fill_missing, only_operated
from punctual.sources.carriers import with_airline

# fixed values: carrier codes of the generated table, by position
FIXTURE_CARRIERS = (
    "AA", "AS", "B6", "DL", "F9", "G4", "HA", "NK", "OH", "OO",
    "QX", "UA", "WN", "YV", "YX", "MQ", "9E", "PT", "EV", "ZZ",
)

PLACE_COLUMNS = (
    "concat('A', lpad(origin_nk, 2, '0')) AS origin",
    "origin_city_name",
    "origin_state_abr",
    "concat('A', lpad(dest_nk, 2, '0')) AS dest",
    "dest_city_name",
    "dest_state_abr",
)
DISTANCE_COLUMN = (
    "CAST(67 + (l_partkey * 37 + origin_nk * 41 + dest_nk * 43) % 2500 AS DOUBLE) AS distance",
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _dimension(spark: SparkSession, folder: str, side: str) -> DataFrame:
    nation = _table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nk"),
        F.col("n_name").alias(f"{side}_city_name"),
        F.concat(F.lit("S"), F.col("n_regionkey")).alias(f"{side}_state_abr"),
    )
    return nation.withColumnRenamed("nk", f"{side}_nk")


def _with_places(spark: SparkSession, folder: str, line: DataFrame) -> DataFrame:
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("dest_nk"))
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("origin_nk"))
    # an order's customer first: flights cross a shuffle once, by order, and orders by customer
    places = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "dest_nk")
    return (
        line.join(places, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(_dimension(spark, folder, "origin"), "origin_nk", "left")
        .join(_dimension(spark, folder, "dest"), "dest_nk", "left")
    )


def scheduled(
    spark: SparkSession,
    folder: str,
    before: str | None = None,
    start: str | None = None,
    end: str | None = None,
    places: bool = False,
) -> DataFrame:
    """One row per scheduled flight; ``places`` adds origin, destination and distance.

    ``before`` (exclusive) and ``start``/``end`` (inclusive) restrict the flight
    date on the stored column, so they reach the Parquet scan.
    """
    line = _table(spark, folder, "lineitem")
    if before:
        line = line.where(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
    if start:
        line = line.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        line = line.where(F.col("l_shipdate") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))

    # stored columns are joined, few and narrow; all others are derived after that
    stored = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    line = line.select(*stored, "l_shipdate")
    sides = ()
    if places:
        line = _with_places(spark, folder, line)
        sides = tuple(c for side in ("origin", "dest") for c in (f"{side}_nk", f"{side}_city_name", f"{side}_state_abr"))

    hour = "CAST(t DIV 60 AS INT)"
    keyed = (
        line.selectExpr(
            *stored, *sides,
            "CAST(l_shipdate AS DATE) AS fl_date",
            "l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7919 + l_suppkey * 101 AS h",
            "(l_orderkey * 13 + l_partkey * 7 + l_linenumber * 977) % 1441 AS t",
        )
        .selectExpr("*", "month(fl_date) AS month", "weekday(fl_date) + 1 AS day_of_week")
        .selectExpr(
            "*",
            f"h % 1000 + 6 * {hour} + IF(month IN (6, 7), 60, 0)"
            " + IF(day_of_week IN (4, 5, 7), 20, 0) AS u",
        )
        .selectExpr(
            "*",
            """CAST(CASE WHEN h % 1000 >= 995 THEN NULL
                    WHEN u < 650 THEN -(h % 20)
                    WHEN u < 860 THEN h % 15
                    WHEN u < 1020 THEN 15 + h % 46
                    WHEN u < 1070 THEN 61 + h % 60
                    ELSE 121 + (h % 25) * 40 END AS DOUBLE) AS dep_delay""",
        )
        .selectExpr(
            *stored, *sides,
            "fl_date", "month", "day_of_week", "h", "t",
            # one generated row per flight: a filter on a delay is then tested on its
            # value instead of repeating the whole formula inside the scan filter
            """inline(array(struct(
                dep_delay,
                IF(h % 991 = 0, NULL, dep_delay - 10 + (l_partkey * 3 + l_orderkey) % 21) AS arr_delay)))""",
        )
        .selectExpr("*", "IF(arr_delay >= 15, CAST(h % 7 AS INT), 6) AS cause")
    )

    def cause(position: int) -> str:
        tie = "WHEN cause = 5 THEN 7D" if position in (0, 4) else ""
        return f"CASE WHEN cause = {position} THEN arr_delay {tie} WHEN cause <> 6 THEN 0D END"

    codes = ", ".join(f"'{code}'" for code in FIXTURE_CARRIERS)
    columns = [
        "year(fl_date) AS year",
        "quarter(fl_date) AS quarter",
        "month",
        "day(fl_date) AS day_of_month",
        "day_of_week",
        "fl_date",
        f"element_at(array({codes}), CAST(l_suppkey % 20 AS INT) + 1) AS op_unique_carrier",
        "IF(h % 97 = 0, NULL, concat('N', l_partkey)) AS tail_num",
        *(PLACE_COLUMNS if places else ()),
        f"{hour} * 100 + CAST(t % 60 AS INT) AS crs_dep_time",
        "dep_delay",
        "greatest(dep_delay, 0D) AS dep_delay_new",
        "CAST(dep_delay >= 15 AS INT) AS dep_del15",
        "arr_delay",
        "greatest(arr_delay, 0D) AS arr_delay_new",
        "CAST(arr_delay >= 15 AS INT) AS arr_del15",
        "CAST((l_orderkey + l_linenumber) % 53 = 0 AS INT) AS cancelled",
        "IF((l_orderkey + l_linenumber) % 53 = 0, 'B', NULL) AS cancellation_code",
        "CAST((l_partkey + l_linenumber) % 211 = 0 AS INT) AS diverted",
        "30 + l_quantity * 8 AS air_time",
        *(DISTANCE_COLUMN if places else ()),
        f"{cause(0)} AS carrier_delay",
        f"{cause(1)} AS weather_delay",
        f"{cause(2)} AS nas_delay",
        f"{cause(3)} AS security_delay",
        f"{cause(4)} AS late_aircraft_delay",
    ]
    return keyed.selectExpr(*columns)


def operated(spark: SparkSession, folder: str, label: str = "dep", **scope) -> DataFrame:
    """Flights that ran as planned, filled and with the derived columns."""
    base = drop_undated(only_operated(scheduled(spark, folder, **scope)))
    return with_airline(add_features(fill_missing(base), label=label))
