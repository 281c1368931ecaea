"""The wider result tables: all years, lateness by arrival, alternative shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.functions import labels as L
from punctual.functions.ratios import rate_pct
from punctual.functions.weights import count_of, mean2_of
from punctual.plans.reports import with_share
from punctual.session import cut_lineage
from punctual.settings import Settings
from punctual.sources.schema import CAUSES

LATE = "is_delayed = 1"


def _rates(flights: DataFrame, *keys: str | Column, rate: str = "delay_rate",
           late: str = "delayed_flights_count", **extra: Column) -> DataFrame:
    table = flights.groupBy(*keys).agg(
        count_of(flights).alias("total_flights"),
        count_of(flights, LATE).alias(late),
        *[column.alias(name) for name, column in extra.items()],
    )
    return table.withColumn(rate, rate_pct(late, "total_flights"))


def airline_year_severity(flights: DataFrame, s: Settings) -> DataFrame:
    table = flights.groupBy("year", "airline_name").agg(
        mean2_of(flights, "arr_delay", LATE).alias("avg_arr_delay_when_delayed"),
        mean2_of(flights, "dep_delay", LATE).alias("avg_dep_delay_when_delayed"),
        count_of(flights).alias("total_flights"),
    )
    return table.where(F.col("total_flights") >= s.airline_year_min_flights).orderBy("airline_name", "year")


def airline_time_recovered(flights: DataFrame, s: Settings) -> DataFrame:
    table = flights.groupBy("airline_name").agg(
        count_of(flights).alias("total_flights"),
        mean2_of(flights, "dep_delay").alias("avg_dep_delay"),
        mean2_of(flights, "arr_delay").alias("avg_arr_delay"),
        mean2_of(flights, X.time_recovered()).alias("time_recovered"),
    )
    return table.where(F.col("total_flights") > s.airline_min_flights).orderBy(
        F.desc("avg_arr_delay"), "airline_name"
    )


def _cause_minutes(flights: DataFrame, key: str) -> DataFrame:
    return flights.groupBy(key).agg(
        count_of(flights).alias("total_flights"),
        *[mean2_of(flights, cause).alias(f"avg_{cause}") for cause in CAUSES],
    )


def airline_cause_minutes(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        _cause_minutes(flights, "airline_name")
        .where(F.col("total_flights") > s.airline_min_flights)
        .drop("total_flights")
        .orderBy(F.desc("avg_carrier_delay"), "airline_name")
    )


def year_cause_minutes(flights: DataFrame) -> DataFrame:
    return _cause_minutes(flights, "year").drop("total_flights").orderBy("year")


def airline_rate_arrival(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        _rates(flights, "airline_name", rate="delay_rate_pct", late="delayed_flights")
        .where(F.col("total_flights") > s.airline_min_flights)
        .orderBy(F.desc("delay_rate_pct"), "airline_name")
    )


def airline_year_rate(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        _rates(flights, "year", "airline_name", rate="delay_rate_pct")
        .where(F.col("total_flights") >= s.airline_year_min_flights)
        .select("year", "airline_name", "total_flights", "delay_rate_pct")
        .orderBy("airline_name", "year")
    )


def airport_rate(flights: DataFrame, s: Settings) -> DataFrame:
    table = _rates(
        flights, "origin", "origin_city_name", "origin_state_abr",
        avg_dep_delay=mean2_of(flights, "dep_delay"),
    )
    return (
        table.where(F.col("total_flights") >= s.wide_airport_min_flights)
        .withColumn("airport", L.airport_city())
        .orderBy(F.desc("delay_rate"), "origin")
    )


def year_severity(flights: DataFrame) -> DataFrame:
    return (
        flights.groupBy("year")
        .agg(
            mean2_of(flights, "arr_delay", LATE).alias("avg_arr_delay_when_delayed"),
            mean2_of(flights, "dep_delay", LATE).alias("avg_dep_delay_when_delayed"),
            count_of(flights).alias("total_flights"),
        )
        .orderBy("year")
    )


def distance_arrival(flights: DataFrame) -> DataFrame:
    return (
        _rates(
            flights, X.distance_group().alias("distance_group"), rate="delay_rate_pct",
            avg_arr_delay=mean2_of(flights, "arr_delay"),
        )
        .drop("delayed_flights_count")
        .orderBy("distance_group")
    )


def category_share(flights: DataFrame) -> DataFrame:
    table = flights.groupBy("delay_category").agg(count_of(flights).alias("total_flights"))
    return with_share(table, "total_flights", "pct_of_total").withColumn(
        "delay_category", L.category_label("delay_category")
    )


def hour_rate(flights: DataFrame) -> DataFrame:
    """By scheduled hour as written, so 2400 stays hour 24."""
    return _rates(flights, F.floor(F.col("crs_dep_time") / 100).cast("int").alias("dep_hour")).orderBy("dep_hour")


def calendar_rate(flights: DataFrame, key: str) -> DataFrame:
    return _rates(flights, key).orderBy(key)


def weekday_rate(flights: DataFrame) -> DataFrame:
    day = F.concat(F.col("day_of_week").cast("string"), F.lit(" - "), L.day_name("day_of_week"))
    return calendar_rate(flights, "day_of_week").withColumn("day_name", day)


def year_month_series(flights: DataFrame) -> DataFrame:
    return (
        _rates(flights, "year", "month", late="delayed_flights")
        .withColumn("year_month", F.make_date("year", "month", F.lit(1)))
        .orderBy("year", "month")
    )


def year_quarter(flights: DataFrame) -> DataFrame:
    return (
        _rates(flights, "year", "quarter", rate="delay_rate_pct")
        .drop("delayed_flights_count")
        .orderBy("year", "quarter")
    )


def cause_share_arrival(flights: DataFrame) -> DataFrame:
    """Shares among late flights that report a cause, with the raw column names."""
    late = flights.where(LATE)
    table = late.groupBy(F.upper(X.largest_cause()).alias("main_delay_cause")).agg(
        count_of(late).alias("total_flights"), F.max(X.largest_cause_minutes()).alias("top_minutes")
    )
    # flights without a reported cause form one group whose top is not positive
    table = table.where("top_minutes > 0").drop("top_minutes")
    return with_share(table, "total_flights", "pct_of_total").orderBy(F.desc("total_flights"), "main_delay_cause")


def route_rate(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        _rates(flights, "origin_city_name", "dest_city_name", "route")
        .where(F.col("total_flights") >= s.route_min_flights)
        .select(L.route_label().alias("route_name"), "route", "delay_rate", "total_flights", "delayed_flights_count")
        .orderBy(F.desc("delay_rate"), "route")
    )


def route_top(flights: DataFrame, s: Settings, rows: int = 10) -> DataFrame:
    return (
        _rates(flights, "origin_city_name", "dest_city_name", "route")
        .where(F.col("total_flights") >= s.route_min_flights)
        .orderBy(F.desc("delay_rate"), "route")
        .limit(rows)
    )


def year_rate(flights: DataFrame) -> DataFrame:
    return _rates(flights, "year", rate="delay_rate_pct", late="delayed_flights").orderBy("year")


def _extreme_names(table: DataFrame, name: str) -> Column:
    exact = F.col("delayed_flights_count") / F.col("total_flights")
    return table.select(
        F.struct(
            F.max_by(name, F.struct(exact, F.col(name))).alias("most"),
            F.min_by(name, F.struct(exact, F.col(name))).alias("least"),
        )
    ).scalar()


def kpi_card(flights: DataFrame, s: Settings) -> DataFrame:
    """Seventeen measures in one row, including the extreme airline and airport.

    The flights are read once, into one row per airline and route; the card and both
    rankings read those rows.
    """
    members = flights.groupBy("airline_name", "origin", "origin_city_name", "route").agg(
        count_of(flights).alias("flights"),
        count_of(flights, LATE).alias("delayed"),
        F.sum("arr_delay").alias("arr"),
        F.sum("dep_delay").alias("dep"),
        F.sum(F.when(F.expr(LATE), F.col("arr_delay"))).alias("arr_late"),
        F.sum(F.when(F.expr(LATE), F.col("dep_delay"))).alias("dep_late"),
        F.max("arr_delay").alias("max_arr"),
        F.max("dep_delay").alias("max_dep"),
    )
    members = cut_lineage(members)

    def ratio(top: str, bottom: str) -> Column:
        return F.round(F.try_divide(F.sum(top), F.sum(bottom)), 2)

    def totals(*keys: str) -> DataFrame:
        return members.groupBy(*keys).agg(
            F.sum("flights").alias("total_flights"), F.sum("delayed").alias("delayed_flights_count")
        )

    airline = _extreme_names(
        totals("airline_name").where(F.col("total_flights") > s.airline_min_flights), "airline_name"
    )
    airport = _extreme_names(
        totals("origin", "origin_city_name").where(F.col("total_flights") >= s.wide_airport_min_flights),
        "origin_city_name",
    )
    card = members.agg(
        F.sum("flights").alias("total_flights"),
        F.sum("delayed").alias("total_delayed"),
        ratio("arr", "flights").alias("avg_arr_delay"),
        ratio("dep", "flights").alias("avg_dep_delay"),
        F.round(F.try_divide(F.sum(F.col("arr") - F.col("dep")), F.sum("flights")), 2).alias("avg_time_recovered"),
        ratio("arr_late", "delayed").alias("avg_arr_delay_when_delayed"),
        ratio("dep_late", "delayed").alias("avg_dep_delay_when_delayed"),
        F.max("max_arr").alias("max_arr_delay"),
        F.max("max_dep").alias("max_dep_delay"),
        F.countDistinct("origin").alias("total_airports"),
        F.countDistinct("airline_name").alias("total_airlines"),
        F.countDistinct("route").alias("total_routes"),
    )
    return card.withColumns(
        {
            "overall_delay_rate": rate_pct("total_delayed", "total_flights"),
            "most_delayed_airline": airline.getField("most"),
            "least_delayed_airline": airline.getField("least"),
            "most_delayed_airport": airport.getField("most"),
            "least_delayed_airport": airport.getField("least"),
        }
    )
