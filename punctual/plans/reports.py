"""The numbered report catalogue: airlines, airports, routes, calendar, causes, KPIs.

Inputs are operated flights of complete years (or compact rows of them, see
:mod:`punctual.functions.weights`); the cancellation reports take scheduled
flights. Each rate report is one scan, one partial aggregate and one small
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.functions.ratios import rate_pct
from punctual.functions.weights import COUNT, count_of, mean2_of, percentile2_of
from punctual.settings import Settings

CALENDAR = ("month", "quarter", "day_of_week", "dep_hour", "is_peak_hour", "is_weekend", "year")


def set_id(keys: tuple[str, ...], *used: str) -> int:
    """``grouping_id()`` of a grouping set: a bit for each key that is not in it, the first key highest."""
    return sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in used)


def rate_by(flights: DataFrame, *keys: str | Column, **extra: Column) -> DataFrame:
    """Flights, delayed flights and delay rate per key."""
    table = flights.groupBy(*keys).agg(
        count_of(flights).alias("total_operated_flights"),
        count_of(flights, F.col("is_delayed") == 1).alias("delayed_flights"),
        *[column.alias(name) for name, column in extra.items()],
    )
    measures = [F.col(name) for name in extra]
    names = [c for c in table.columns if c not in extra]
    return table.select(
        *names, rate_pct("delayed_flights", "total_operated_flights").alias("delay_rate_pct"), *measures
    )


def total_rows(flights: DataFrame) -> DataFrame:
    return flights.agg(count_of(flights).alias("total_rows"))


def airline_rate(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        rate_by(flights, "airline_name")
        .where(F.col("total_operated_flights") > s.airline_min_flights)
        .orderBy(F.desc("delay_rate_pct"), "airline_name")
    )


def airline_volume(flights: DataFrame, s: Settings) -> DataFrame:
    return airline_rate(flights, s).orderBy(F.desc("delayed_flights"), "airline_name")


def severity_by(flights: DataFrame, key: str, measures: dict[str, str], suffix: str) -> DataFrame:
    """Mean, median and 90th percentile of delay minutes among delayed flights."""
    late = flights.where("is_delayed = 1")
    # every measure's minutes are counted by themselves, in one pass: pairs of minutes would hardly repeat
    columns = (key, *measures.values())
    rows = late.groupingSets([[key, minutes] for minutes in measures.values()], *columns).agg(
        count_of(late).alias(COUNT), F.grouping_id().alias("_set")
    )
    own = {minutes: F.col("_set") == set_id(columns, key, minutes) for minutes in measures.values()}
    parts = [count_of(rows, next(iter(own.values()))).alias("delayed_flights")]
    for short, minutes in measures.items():
        value = F.when(own[minutes], F.col(minutes))
        parts += [
            mean2_of(rows, value).alias(f"avg_{short}_delay{suffix}"),
            percentile2_of(rows, value, 0.5).alias(f"median_{short}_delay{suffix}"),
            percentile2_of(rows, value, 0.9).alias(f"p90_{short}_delay{suffix}"),
        ]
    return rows.groupBy(key).agg(*parts)


def airline_severity(flights: DataFrame, s: Settings, side: str) -> DataFrame:
    return (
        severity_by(flights, "airline_name", {side: f"{side}_delay"}, "_when_delayed")
        .where(F.col("delayed_flights") > s.airline_min_delayed)
        .orderBy(F.desc(f"median_{side}_delay_when_delayed"), "airline_name")
    )


def airline_departure_severity(flights: DataFrame, s: Settings) -> DataFrame:
    return airline_severity(flights, s, "dep")


def airline_arrival_severity(flights: DataFrame, s: Settings) -> DataFrame:
    return airline_severity(flights, s, "arr")


def _disruptions(scheduled: DataFrame) -> list[Column]:
    return [
        count_of(scheduled).alias("scheduled_flights"),
        F.sum("cancelled").cast("bigint").alias("cancelled_flights"),
        F.sum("diverted").cast("bigint").alias("diverted_flights"),
    ]


def _disruption_rates(table: DataFrame) -> DataFrame:
    return table.withColumns(
        {
            "cancellation_rate_pct": rate_pct("cancelled_flights", "scheduled_flights"),
            "diversion_rate_pct": rate_pct("diverted_flights", "scheduled_flights"),
        }
    )


def airline_disruptions(scheduled: DataFrame) -> DataFrame:
    table = scheduled.groupBy("airline_name").agg(*_disruptions(scheduled))
    return _disruption_rates(table).orderBy("airline_name")


def disruption_kpis(scheduled: DataFrame) -> DataFrame:
    return _disruption_rates(scheduled.agg(*_disruptions(scheduled)))


def airport_rate(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        rate_by(flights, "origin", "origin_city_name", avg_dep_delay=mean2_of(flights, "dep_delay"))
        .where(F.col("total_operated_flights") >= s.airport_min_flights)
        .orderBy(F.desc("delay_rate_pct"), "origin")
    )


def route_rate(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        rate_by(flights, "origin_city_name", "dest_city_name", "route")
        .where(F.col("total_operated_flights") >= s.route_min_flights)
        .orderBy(F.desc("delay_rate_pct"), "route")
    )


def calendar_rate(flights: DataFrame, key: str) -> DataFrame:
    return rate_by(flights, key).orderBy(key)


def cause_share(flights: DataFrame) -> DataFrame:
    """Primary cause among delayed flights; the total runs over at most six rows."""
    late = flights.where("is_delayed = 1")
    causes = late.groupBy("main_delay_cause").agg(count_of(late).alias("delayed_flights"))
    return with_share(causes, "delayed_flights", "pct_of_delayed_flights").orderBy(
        F.desc("delayed_flights"), "main_delay_cause"
    )


def with_share(small: DataFrame, count: str, name: str) -> DataFrame:
    """Percentage of the overall total, read as a scalar of the same small table."""
    total = small.select(F.sum(count)).scalar()
    return small.withColumn(name, rate_pct(F.col(count), total))


def distance_severity(flights: DataFrame) -> DataFrame:
    grouped = flights.withColumn("distance_group", X.distance_group())
    measures = {"dep": "dep_delay", "arr": "arr_delay"}
    return severity_by(grouped, "distance_group", measures, "").orderBy("distance_group")


def distance_rate(flights: DataFrame) -> DataFrame:
    return rate_by(flights, X.distance_group().alias("distance_group")).orderBy("distance_group")


def airline_year_rate(flights: DataFrame, s: Settings) -> DataFrame:
    return (
        rate_by(flights, "year", "airline_name")
        .where(F.col("total_operated_flights") >= s.airline_year_min_flights)
        .orderBy("airline_name", "year")
    )


def volume_by_year(scheduled: DataFrame) -> DataFrame:
    ran = (F.col("cancelled") == 0) & (F.col("diverted") == 0)
    return (
        scheduled.groupBy("year")
        .agg(
            count_of(scheduled).alias("scheduled_flights"),
            count_of(scheduled, ran).alias("operated_non_diverted_flights"),
            F.sum("cancelled").cast("bigint").alias("cancelled_flights"),
            F.sum("diverted").cast("bigint").alias("diverted_flights"),
        )
        .orderBy("year")
    )


#: What the overview counts by itself: members, and minutes of late flights.
OVERVIEW = ("airline_name", "origin", "route", "late_minutes")


def overview_counts(flights: DataFrame) -> DataFrame:
    """Flights and delayed flights per airline, per origin, per route and per late minute, one below the other."""
    minutes = F.when(F.col("is_delayed") == 1, F.col("dep_delay"))
    rows = flights.withColumn("late_minutes", minutes)
    return rows.groupingSets([[key] for key in OVERVIEW], *OVERVIEW).agg(
        count_of(rows).alias(COUNT), count_of(rows, F.col("is_delayed") == 1).alias("_late"), F.grouping_id().alias("_set")
    )


def kpi_overview(flights: DataFrame) -> DataFrame:
    """Global measures from a single pass over the flights.

    Each key is counted by itself (grouping sets, summed in the map stage), so what is
    shuffled are the airlines, origins, routes and minutes that there are, added up, and
    not their combinations; distinct counts, mean and median read those rows.
    """
    counts = overview_counts(flights)
    one = {key: F.col("_set") == set_id(OVERVIEW, key) for key in OVERVIEW}
    members = lambda key: F.count_if(one[key] & F.col(key).isNotNull())
    minutes = F.when(one["late_minutes"], F.col("late_minutes"))
    card = counts.agg(
        count_of(counts, one["airline_name"]).alias("total_operated_flights"),
        F.coalesce(F.sum(F.when(one["airline_name"], F.col("_late"))), F.lit(0)).alias("total_delayed_flights"),
        members("airline_name").alias("total_airlines"),
        members("origin").alias("total_origin_airports"),
        members("route").alias("total_routes"),
        mean2_of(counts, minutes).alias("avg_dep_delay_when_delayed"),
        percentile2_of(counts, minutes, 0.5).alias("median_dep_delay_when_delayed"),
    )
    return card.withColumn("overall_delay_rate_pct", rate_pct("total_delayed_flights", "total_operated_flights")).select(
        "total_operated_flights",
        "total_delayed_flights",
        "overall_delay_rate_pct",
        "total_airlines",
        "total_origin_airports",
        "total_routes",
        "avg_dep_delay_when_delayed",
        "median_dep_delay_when_delayed",
    )
