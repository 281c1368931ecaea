"""Checks of the flight table, each one aggregate over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.functions.weights import count_of
from punctual.operators.copies import copy_counts, distinct_rows
from punctual.operators.cleaning import date_column, missing_columns, snake_case
from punctual.plans import reports as R
from punctual.plans.explore import extreme_flights, long_values
from punctual.settings import Settings
from punctual.sources.schema import REQUIRED_COLUMNS


def value_counts_by_column(df: DataFrame) -> DataFrame:
    """Known values per column, one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "column_name", "n_values")


def required_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Every required column, whether the table has it and how many values it holds."""
    missing = missing_columns(df, required)
    present = df.select(*[c for c in required if c not in missing])
    table = value_counts_by_column(present).withColumn("present", F.lit(True))
    for column in missing:
        table = table.unionByName(
            df.sparkSession.range(1).select(
                F.lit(column).alias("column_name"), F.lit(0).cast("bigint").alias("n_values"), F.lit(False).alias("present")
            )
        )
    return table


def date_column_found(df: DataFrame) -> DataFrame:
    """The date column's name and the span of dates it holds."""
    column = date_column(df)
    return df.agg(
        F.lit(column).alias("date_column"),
        F.min(column).cast("string").alias("first_value"),
        F.max(column).cast("string").alias("last_value"),
    )


def row_conservation(parts: DataFrame, merged: DataFrame, source: str) -> DataFrame:
    """Rows per source beside the merged total; ``ok`` says they agree."""
    per_source = parts.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = merged.select(F.count(F.lit(1))).scalar()
    return per_source.agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("source_rows")
    ).select("n_sources", "source_rows", total.alias("merged_rows"), (F.col("source_rows") == total).alias("ok"))


def missing_counts(df: DataFrame, top: int | None = 10) -> DataFrame:
    """Nulls per column in one pass, largest first; all columns without ``top``."""
    counts = df.agg(*[F.sum(F.isnull(c).cast("bigint")).alias(c) for c in df.columns])
    long = counts.unpivot([], counts.columns, "column_name", "n_missing")
    ordered = long.orderBy(F.desc("n_missing"), "column_name")
    return ordered if top is None else ordered.limit(top)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, found by their hashes first."""
    return copy_counts(df)


def fences(rows: DataFrame, width: float) -> DataFrame:
    """Quartiles and outlier fences per column, from counted values."""
    quartiles = rows.groupBy("column_name").agg(
        F.percentile("value", F.lit(0.25), F.col("flights")).alias("q1"),
        F.percentile("value", F.lit(0.75), F.col("flights")).alias("q3"),
    )
    spread = F.col("q3") - F.col("q1")
    return quartiles.withColumns(
        {"lower_fence": F.col("q1") - width * spread, "upper_fence": F.col("q3") + width * spread}
    )


def iqr_outliers(flights: DataFrame, s: Settings) -> DataFrame:
    rows = long_values(flights)
    outside = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    return (
        rows.join(fences(rows, s.fence_width), "column_name")
        .groupBy("column_name", "q1", "q3", "lower_fence", "upper_fence")
        .agg(F.sum(F.when(outside, F.col("flights")).otherwise(0)).alias("n_outliers"))
    )


def fenced(flights: DataFrame, column: str, s: Settings, how: str = "drop") -> DataFrame:
    """Drop or cap values outside the fences (off by default in the cleaning chain)."""
    ends = fences(long_values(flights, (column,)), s.fence_width)
    low = ends.select("lower_fence").scalar()
    high = ends.select("upper_fence").scalar()
    if how == "drop":
        return flights.where(F.col(column).between(low, high))
    return flights.withColumn(
        column, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), low), high))
    )


def extreme_share(flights: DataFrame, s: Settings) -> DataFrame:
    def part(column: str) -> list[Column]:
        hit = F.when(F.col(column).isNotNull(), (F.col(column) > s.extreme_minutes).cast("int"))
        return [
            F.sum(hit).cast("bigint").alias(f"n_extreme_{column}"),
            (F.avg(hit) * 100).alias(f"pct_extreme_{column}"),
        ]

    return flights.agg(*part("arr_delay"), *part("dep_delay"))


def label_mismatch(flights: DataFrame, s: Settings) -> DataFrame:
    extreme = extreme_flights(flights, s)
    return extreme.agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("is_delayed") != 1).alias("n_mismatched")
    )


def missing_arrival(flights: DataFrame, s: Settings) -> DataFrame:
    extreme = flights.where(F.col("dep_delay") > s.extreme_minutes)
    return extreme.agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("arr_delay").isNull()).alias("n_missing_arrival")
    )


def clean_summary(raw: DataFrame, label: Column) -> DataFrame:
    """Input, duplicate, removed and final rows and the delay rate of one cleaning run."""
    total = raw.select(F.count(F.lit(1))).scalar()
    ran = (F.coalesce("cancelled", F.lit(0)) == 0) & (F.coalesce("diverted", F.lit(0)) == 0)
    counts = distinct_rows(raw).agg(
        total.alias("input_rows"),
        (total - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count_if(~ran).alias("removed_rows"),
        F.count_if(ran).alias("final_rows"),
        F.count_if(ran & label).alias("late_rows"),
    )
    return counts.select(
        "input_rows", "duplicate_rows", "removed_rows", "final_rows",
        (F.try_divide(F.col("late_rows").cast("double"), F.col("final_rows")) * 100).alias("delay_rate_pct"),
    )


def extent(flights: DataFrame, scope: str) -> DataFrame:
    return flights.agg(
        F.lit(scope).alias("scope"),
        count_of(flights).alias("n_rows"),
        F.min("fl_date").alias("first_date"),
        F.max("fl_date").alias("last_date"),
        (F.avg("is_delayed") * 100).alias("delay_rate_pct"),
    )


def dataset_extent(everything: DataFrame, s: Settings) -> DataFrame:
    complete = everything.where(F.col("year") != s.partial_year)
    return extent(everything, "all").unionByName(extent(complete, "complete_years"))


def split_sizes(split: DataFrame) -> DataFrame:
    """All three splits with their size; ``ok`` is false for an empty one."""
    spine = split.sparkSession.createDataFrame([("train",), ("valid",), ("test",)], "split string")
    sizes = split.where("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        spine.join(sizes, "split", "left").na.fill(0, ["n_rows"]).withColumn("ok", F.col("n_rows") > 0)
    )


def min_history(daily: DataFrame, s: Settings) -> DataFrame:
    return daily.groupBy("series_key").agg(F.count("y").alias("n_days")).withColumn(
        "ok", F.col("n_days") >= s.min_history_days
    )


def export_identities(flights: DataFrame) -> DataFrame:
    """Every calendar, distance and cause report must add up to the same totals."""
    # one pass counts the values of each key by themselves; their sums are the reports' totals
    keys = (*R.CALENDAR, "distance_group")
    rows = flights.withColumn("distance_group", X.distance_group())
    counts = rows.groupingSets([[k] for k in keys], *keys).agg(
        count_of(rows).alias("_n"), count_of(rows, F.col("is_delayed") == 1).alias("_late"), F.grouping_id().alias("_set")
    )
    report = F.create_map(*[F.lit(x) for k in keys for x in (R.set_id(keys, k), k)])[F.col("_set")]
    together = counts.groupBy(report.alias("report")).agg(F.sum("_n").alias("total_flights"), F.sum("_late").alias("total_delayed"))
    everything = Window.partitionBy()
    agree = (F.min("total_flights").over(everything) == F.max("total_flights").over(everything)) & (
        F.min("total_delayed").over(everything) == F.max("total_delayed").over(everything)
    )
    return together.withColumn("ok", agree)

