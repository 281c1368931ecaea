"""Join-shaped operators: spines, dimensions, windows around dates, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.sources.schema import CAUSES



def on_spine(counts: DataFrame, key: str, spine: DataFrame) -> DataFrame:
    """Every spine key with its measures, 0 where it did not occur."""
    return spine.join(counts, key, "left").na.fill(0).orderBy(key)


def with_carrier_name(flights: DataFrame, carriers: DataFrame) -> DataFrame:
    """Name from the fixed 19-row carrier list; a present name wins, the code is the fallback."""
    joined = flights.join(F.broadcast(carriers), "op_unique_carrier", "left")
    given = F.nullif(F.col("airline_name"), F.lit("")) if "airline_name" in flights.columns else F.lit(None)
    named = joined.withColumn("airline_name", F.coalesce(given, "carrier_name", "op_unique_carrier"))
    return named.drop("carrier_name")


def top_cause_struct() -> Column:
    """Row-local arg-max as a sorted array of (minutes, order, name)."""
    entries = [
        F.struct((-F.coalesce(F.col(c), F.lit(0.0))).alias("m"), F.lit(i).alias("o"), F.lit(c).alias("name"))
        for i, c in enumerate(CAUSES)
    ]
    return F.element_at(F.array_sort(F.array(*entries)), 1)


def row_argmax(flights: DataFrame) -> DataFrame:
    top = top_cause_struct()
    return flights.withColumn(
        "main_delay_cause", F.when(-top["m"] > 0, top["name"]).otherwise("no_reported_cause")
    )


def day_spine(series: DataFrame, *keys: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per series and calendar day between its ends (or the given ones)."""
    start = F.lit(first).cast("date") if first else F.min("ds")
    end = F.lit(last).cast("date") if last else F.max("ds")
    bounds = series.groupBy(*keys).agg(start.alias("first_day"), end.alias("last_day"))
    return bounds.select(
        *keys, F.explode(F.sequence("first_day", "last_day", F.expr("INTERVAL 1 DAY"))).alias("ds")
    )


def near_holiday(days: DataFrame, holidays: DataFrame, reach: int) -> DataFrame:
    """0/1 flag for days within ``reach`` days of a holiday.

    The range condition becomes an equality: each holiday is widened to its
    window and the flagged dates are joined by value.
    """
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    flagged = (
        holidays.select("ds", offsets.alias("shift"))
        .select(F.expr("date_add(ds, shift)").alias("ds"))
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    return (
        days.join(flagged, "ds", "left")
        .withColumn("holiday_window", F.coalesce("hit", F.lit(0)))
        .drop("hit")
    )


def align(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Residuals on the days both sides have."""
    both = actual.join(forecast, ["series_key", "ds"])
    return both.where("y IS NOT NULL AND yhat IS NOT NULL").withColumn("residual", F.col("y") - F.col("yhat"))

