"""Writers: CSV and table replacement, checked loads, report exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.weights import compact
from punctual.plans import reports as R
from punctual.session import cut_lineage
from punctual.settings import Settings

CALENDAR_KEYS = (
    "year", "quarter", "month", "day_of_week", "dep_hour", "is_peak_hour", "is_weekend", "airline_name", "is_delayed",
)
AIRPORT_KEYS = ("origin", "origin_city_name", "is_delayed", "dep_delay")
ROUTE_KEYS = ("origin_city_name", "dest_city_name", "route", "is_delayed")
#: What the reports in ``EXPORTS`` read of a flight.
REPORT_COLUMNS = tuple(dict.fromkeys((*CALENDAR_KEYS, *AIRPORT_KEYS, *ROUTE_KEYS, "arr_delay", "main_delay_cause", "distance")))

# fixed values: exported report files
EXPORTS: dict[str, tuple[str, Callable]] = {
    "03_01_airline_delay_rate": ("calendar", R.airline_rate),
    "04_02_airline_delay_volume": ("calendar", R.airline_volume),
    "05_03_airline_departure_delay_severity_among_delayed_flights": ("departures", R.airline_departure_severity),
    "06_04_airline_arrival_delay_severity_among_delayed_flights": ("arrivals", R.airline_arrival_severity),
    "07_05_cancellation_and_diversion_rates_by_airline": ("scheduled", lambda d, s: R.airline_disruptions(d)),
    "08_06_delay_rate_by_origin_airport": ("airports", R.airport_rate),
    "09_08_delay_rate_by_route": ("routes", R.route_rate),
    "10_10_delay_rate_by_month": ("calendar", lambda d, s: R.calendar_rate(d, "month")),
    "11_11_delay_rate_by_quarter": ("calendar", lambda d, s: R.calendar_rate(d, "quarter")),
    "12_12_delay_rate_by_day_of_week": ("calendar", lambda d, s: R.calendar_rate(d, "day_of_week")),
    "13_13_delay_rate_by_scheduled_departure_hour": ("calendar", lambda d, s: R.calendar_rate(d, "dep_hour")),
    "14_14_peak_vs_off_peak_delay_rate": ("calendar", lambda d, s: R.calendar_rate(d, "is_peak_hour")),
    "15_15_weekday_vs_weekend_delay_rate": ("calendar", lambda d, s: R.calendar_rate(d, "is_weekend")),
    "16_16_most_common_delay_causes_among_delayed_operated_flights": ("causes", lambda d, s: R.cause_share(d)),
    "17_17_delay_severity_by_distance_group_among_delayed_operated_flights": ("flights", lambda d, s: R.distance_severity(d)),
    "18_18_delay_rate_by_distance_group": ("flights", lambda d, s: R.distance_rate(d)),
    "19_19_overall_delay_rate_by_year": ("calendar", lambda d, s: R.calendar_rate(d, "year")),
    "20_21_delay_rate_by_airline_and_year": ("calendar", R.airline_year_rate),
    "21_23_flight_volume_by_year": ("scheduled_complete", lambda d, s: R.volume_by_year(d)),
    "22_24_overview_kpi_card_for_operated_non_diverted_flights": ("flights", lambda d, s: R.kpi_overview(d)),
    "23_25_cancellation_and_diversion_kpi_card_for_scheduled_flights": ("scheduled", lambda d, s: R.disruption_kpis(d)),
}


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a finished folder in the place of another; the old one goes last and comes back if the swap fails."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    old = paths(f"{path}.old-{uuid.uuid4().hex}")
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(paths(path))
    if had and not files.rename(paths(path), old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(paths(fresh), paths(path)):
        if had:
            files.rename(old, paths(path))
        raise OSError(f"cannot move {fresh} to {path}")
    if had:
        files.delete(old, True)


def written_aside(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> str:
    """Write a sibling folder, then swap it in: readers see the old output until the new one is whole."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    try:
        write(df, fresh)
    except Exception:
        spark = df.sparkSession
        part = spark._jvm.org.apache.hadoop.fs.Path(fresh)
        part.getFileSystem(spark._jsc.hadoopConfiguration()).delete(part, True)
        raise
    swap_in(df.sparkSession, fresh, path)
    return path


def replace_csv(df: DataFrame, path: str) -> str:
    return written_aside(df, path, lambda rows, to: rows.write.option("header", True).csv(to))


def by_day(df: DataFrame) -> DataFrame:
    """Range-partitioned by day, sorted inside; the row hash lets a crowded day span partitions."""
    ranged = df.repartitionByRange("year", "fl_date", F.xxhash64(*df.columns))
    return ranged.sortWithinPartitions("year", "fl_date")


def replace_table(df: DataFrame, name: str, path: str, by_date: bool = True) -> DataFrame:
    """Replace a Parquet table, range-ordered by date and partitioned by year; a failed load leaves the old one."""
    if by_date and {"fl_date", "year"} <= set(df.columns):
        df = by_day(df)
    keys = ["year"] if "year" in df.columns else []
    written_aside(df, path, lambda rows, to: rows.write.partitionBy(*keys).parquet(to))
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
    if keys:
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_flights(df: DataFrame, path: str) -> DataFrame:
    """The cleaned table as Parquet, one folder per year, ordered by date inside."""
    written_aside(by_day(df), path, lambda rows, to: rows.write.partitionBy("year").parquet(to))
    return df.sparkSession.read.parquet(path)


def verified(source: DataFrame, loaded: DataFrame) -> DataFrame:
    count = source.select(F.count(F.lit(1))).scalar()
    return loaded.agg(F.count(F.lit(1)).alias("loaded_rows")).select(
        count.alias("source_rows"), "loaded_rows", (F.col("loaded_rows") == count).alias("ok")
    )


def export_reports(
    flights: DataFrame, scheduled: DataFrame, s: Settings, folder: str, exports=EXPORTS
) -> DataFrame:
    """Every report as one CSV, and a manifest of rows per report.

    Flights are joined once: the columns that reports read (all columns for reports that are
    not in ``EXPORTS``) are written and read again by each. Reports of a family read one compact table. Only keys that repeat are counted
    together (a measure's minutes beside one key, never two measures or distances);
    reports over several measures pass over their own few columns. A report is a
    handful of rows, so a single output file is no bottleneck.
    """
    spark = flights.sparkSession
    known = all(EXPORTS.get(name) == export for name, export in exports.items())
    flights = cut_lineage(flights.select(*REPORT_COLUMNS) if known else flights)
    late = flights.where("is_delayed = 1")
    inputs = {
        "calendar": cut_lineage(compact(flights, *CALENDAR_KEYS)),
        "airports": cut_lineage(compact(flights, *AIRPORT_KEYS)),
        "routes": cut_lineage(compact(flights, *ROUTE_KEYS)),
        "departures": compact(late, "airline_name", "is_delayed", "dep_delay"),
        "arrivals": compact(late, "airline_name", "is_delayed", "arr_delay"),
        "causes": compact(late, "main_delay_cause", "is_delayed"),
        "flights": flights,
        "scheduled": scheduled,
        "scheduled_complete": scheduled.where(F.col("year") < s.partial_year),
    }
    manifest = []
    for name, (source, report) in exports.items():
        path = replace_csv(report(inputs[source], s).coalesce(1), f"{folder}/{name}.csv")
        manifest.append((name, spark.read.csv(path, header=True).count(), path))
    return spark.createDataFrame(manifest, "report string, n_rows bigint, path string")


def long_form(df: DataFrame, section: str) -> DataFrame:
    """A one-row table as (section, metric, value) rows."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return text.unpivot([], text.columns, "metric", "value").withColumn("section", F.lit(section))
