"""Tables behind the dashboard sheets, derived from the small report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import labels as L
from punctual.plans import reports as R
from punctual.plans.reports import with_share
from punctual.settings import Settings

# fixed values: KPI sheets and their captions
KPI_CAPTIONS = {
    "total_operated_flights": "Operated Flights",
    "total_delayed_flights": "15+ Minutes Late",
    "overall_delay_rate_pct": "Departure Delay Rate",
    "total_airlines": "Airlines",
    "total_origin_airports": "Origin Airports",
    "total_routes": "Routes",
}

DIMENSION_LABELS = {
    "month": L.month_name,
    "quarter": L.quarter_label,
    "day_of_week": L.day_name,
    "is_peak_hour": L.peak_label,
    "is_weekend": L.weekend_label,
}


def kpi_cards(overview: DataFrame) -> DataFrame:
    wide = overview.select(*[F.col(c).cast("double").alias(text) for c, text in KPI_CAPTIONS.items()])
    return wide.unpivot([], list(KPI_CAPTIONS.values()), "kpi", "value")


def under_15() -> Column:
    return F.col("total_operated_flights") - F.col("total_delayed_flights")


def classification_share(overview: DataFrame) -> DataFrame:
    wide = overview.select(
        F.col("total_delayed_flights").alias("15+ Minutes Late"), under_15().alias("Under 15 Minutes Late")
    )
    long = wide.unpivot([], wide.columns, "class_name", "n_flights")
    return with_share(long, "n_flights", "pct_of_total")


def rate_and_volume(flights: DataFrame, key: str) -> DataFrame:
    """Bars and line of one calendar or distance dimension, with its display label."""
    report = R.distance_rate(flights) if key == "distance_group" else R.calendar_rate(flights, key)
    label = DIMENSION_LABELS.get(key, lambda k: F.col(k).cast("string"))
    return report.select(
        F.lit(key).alias("dimension"),
        F.col(key).cast("string").alias("member"),
        label(key).alias("label"),
        "total_operated_flights", "delayed_flights", "delay_rate_pct",
    )


def airline_by_year(flights: DataFrame, s: Settings) -> DataFrame:
    return R.airline_year_rate(flights, s).withColumn(
        "coverage", L.coverage_label("year", s.coverage_year, s.coverage_label)
    )


def severity_long(table: DataFrame, key: str, measures: list[str]) -> DataFrame:
    return table.unpivot([key, "delayed_flights"], measures, "measure", "minutes")


def airline_severity_long(flights: DataFrame, s: Settings, side: str = "dep") -> DataFrame:
    names = [f"{m}_{side}_delay_when_delayed" for m in ("avg", "median", "p90")]
    return severity_long(R.airline_severity(flights, s, side), "airline_name", names)


def distance_severity_long(flights: DataFrame) -> DataFrame:
    names = [f"{m}_{side}_delay" for side in ("dep", "arr") for m in ("avg", "median", "p90")]
    return severity_long(R.distance_severity(flights), "distance_group", names)


def ranked_airports(airports: DataFrame, measure: str, rows: int = 10, highest: bool = True) -> DataFrame:
    order = F.desc("measure") if highest else F.asc("measure")
    return (
        airports.groupBy(L.airport_label().alias("airport_label"))
        .agg(measured(measure).alias("measure"))
        .orderBy(order, "airport_label")
        .limit(rows)
    )


def measured(measure: str) -> Column:
    """Workbook rule: rates are averaged, counts are summed."""
    return F.round(F.avg(measure), 6) if measure.endswith("_pct") else F.sum(measure).cast("double")


def ranked_routes(routes: DataFrame, measure: str, rows: int | None = None, highest: bool = True) -> DataFrame:
    ordered = routes.orderBy(F.desc(measure) if highest else F.asc(measure), "route")
    return ordered.limit(rows) if rows else ordered


def cause_bar(flights: DataFrame) -> DataFrame:
    return R.cause_share(flights).withColumn("cause_label", L.cause_label())


def filtered(sheet: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Dashboard action: keep the members chosen on another sheet."""
    return sheet.join(selection.select(key).distinct(), key, "left_semi")


def regrouped(report: DataFrame, *keys: str) -> DataFrame:
    """SUM and AVG of report rows; the average is of rows, not of flights."""
    return report.groupBy(*keys).agg(
        F.sum("total_operated_flights").alias("sum_flights"),
        F.sum("delayed_flights").alias("sum_delayed"),
        F.round(F.avg("delay_rate_pct"), 6).alias("avg_rate_pct"),
        F.count(F.lit(1)).alias("report_rows"),
    )


def rate_beside_volume(rates: DataFrame, key: str) -> DataFrame:
    """Rank of each member by rate and by delayed volume, side by side."""
    by_rate = ranked(rates.select(key, "delay_rate_pct"), "delay_rate_pct", key, "rate_rank")
    by_volume = ranked(rates.select(key, "delayed_flights"), "delayed_flights", key, "volume_rank")
    return by_rate.join(by_volume, key)


def ranked(small: DataFrame, measure: str, key: str, name: str) -> DataFrame:
    # a report has one row per member of one dimension
    return small.withColumn(name, F.row_number().over(Window.orderBy(F.desc(measure), key)))
