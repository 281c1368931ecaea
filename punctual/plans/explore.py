"""Exploratory tables: shares, rates, pivots, volumes, histograms, extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.functions.weights import compact, count_of
from punctual.operators.lookups import on_spine
from punctual.session import cut_lineage
from punctual.settings import Settings

# fixed values: histogram ranges
DELAY_RANGE = (-60, 500, 5)
DISTANCE_RANGE = (0.0, 4000.0)
DISTANCE_BINS = 50
SUMMARY_SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def delay_share(flights: DataFrame) -> DataFrame:
    """Late and under-15 flights with their share, both rows always present."""
    counts = flights.groupBy("is_delayed").agg(count_of(flights).alias("n_flights"))
    both = on_spine(counts, "is_delayed", flights.sparkSession.range(2).selectExpr("CAST(id AS INT) AS is_delayed"))
    total = both.select(F.sum("n_flights")).scalar()
    return both.select(
        F.when(F.col("is_delayed") == 1, "15+ Minutes Late").otherwise("Under 15 Minutes Late").alias("label"),
        "n_flights",
        (F.try_divide(F.col("n_flights").cast("double"), total) * 100).alias("share_pct"),
    )


def mean_rate(flights: DataFrame, key: str) -> DataFrame:
    return flights.groupBy(key).agg((F.avg("is_delayed") * 100).alias("mean_rate_pct")).orderBy(key)


def volume(flights: DataFrame, key: str) -> DataFrame:
    return flights.groupBy(key).agg(count_of(flights).alias("n_flights")).orderBy(key)


def hour_volume(flights: DataFrame) -> DataFrame:
    hours = flights.sparkSession.range(24).selectExpr("CAST(id AS INT) AS dep_hour")
    return on_spine(volume(flights, "dep_hour"), "dep_hour", hours)


def by_year(flights: DataFrame, key: str, measure: Column, s: Settings) -> DataFrame:
    """Pivot with the years stated up front, so no extra job collects them."""
    years = s.complete_years
    wide = flights.groupBy(key).pivot("year", years).agg(measure)
    return wide.select(key, *[F.col(f"`{y}`").alias(f"y{y}") for y in years]).orderBy(key)


def rate_pivot(flights: DataFrame, key: str, s: Settings) -> DataFrame:
    return by_year(flights, key, F.avg("is_delayed") * 100, s)


def volume_pivot(flights: DataFrame, key: str, s: Settings) -> DataFrame:
    return by_year(flights, key, F.count(F.lit(1)), s)


def delay_histogram(flights: DataFrame, minutes: str) -> DataFrame:
    """Five-minute bins over the clipped range; the last bin holds its upper edge."""
    low, high, width = DELAY_RANGE
    bins = (high - low) // width
    value = X.clipped(minutes, float(low), float(high))
    index = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    counted = flights.where(F.col(minutes).isNotNull()).groupBy(index.alias("bin")).agg(
        count_of(flights).alias("n_flights")
    )
    spine = flights.sparkSession.range(bins).selectExpr("CAST(id AS INT) AS bin")
    return on_spine(counted, "bin", spine).withColumn("bin_start", F.lit(low) + F.col("bin") * width)


def equal_histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the data range, counted from distinct values."""
    # written once: the range and the counts both read the distinct values, not the flights
    rows = cut_lineage(compact(values.where(F.col(column).isNotNull()), column))
    ends = rows.select(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    flat = low == high
    low, high = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    index = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(index.alias("bin")).agg(F.sum("flights").alias("n_flights"))
    spine = values.sparkSession.range(bins).selectExpr("CAST(id AS INT) AS bin")
    return on_spine(counted, "bin", spine)


def distance_histogram(flights: DataFrame) -> DataFrame:
    miles = flights.select(X.clipped("distance", *DISTANCE_RANGE).alias("distance"))
    return equal_histogram(miles, "distance", DISTANCE_BINS)


def long_values(flights: DataFrame, columns=("arr_delay", "dep_delay", "distance")) -> DataFrame:
    """Distinct values of each column with their counts, in long form."""
    long = flights.select(*columns).unpivot([], list(columns), "column_name", "value")
    return compact(long.where("value IS NOT NULL"), "column_name", "value")


def describe(flights: DataFrame, columns=("arr_delay", "dep_delay", "distance")) -> DataFrame:
    rows = long_values(flights, columns)
    n, v = F.col("flights"), F.col("value")
    summary = rows.groupBy("column_name").agg(
        F.sum("flights").alias("n_values"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.min("value").alias("min"),
        *[F.percentile("value", F.lit(q), n).alias(name) for name, q in SUMMARY_SHARES.items()],
        F.max("value").alias("max"),
    )
    # second pass over the counted values keeps the squares small
    spread = (
        rows.join(summary.select("column_name", "mean", "n_values"), "column_name")
        .groupBy("column_name")
        .agg(F.sqrt(F.try_divide(F.sum(n * F.pow(v - F.col("mean"), 2)), F.max("n_values") - 1)).alias("std"))
    )
    return summary.join(spread, "column_name").withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )


def extreme_flights(flights: DataFrame, s: Settings) -> DataFrame:
    return flights.where(F.col("dep_delay") > s.extreme_minutes).select(
        "fl_date", "op_unique_carrier", "dep_delay", "arr_delay", "distance", "is_delayed"
    )


def top_departure_delays(flights: DataFrame, s: Settings, rows: int = 10) -> DataFrame:
    ranked = extreme_flights(flights, s).orderBy(
        F.desc("dep_delay"), "fl_date", "op_unique_carrier", "arr_delay", "distance"
    )
    return ranked.limit(rows).withColumn("arrival_minus_departure", X.time_recovered())
