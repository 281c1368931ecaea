"""Monthly flight files: where they are expected, reading and writing them, months without flights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.settings import Settings
from punctual.sources.month_layouts import expected_months, list_files, read_layouts
from punctual.sources.schema import FLIGHT_COLUMNS


def expected_paths(folder: str, s: Settings) -> list[str]:
    """``<folder>/YYYY/YYYY-MM.csv`` for every expected month."""
    months = expected_months(s.expected_first_month, s.expected_last_month, s.skipped_years)
    return [f"{folder}/{month[:4]}/{month}.csv" for month in months]


def read_months(spark: SparkSession, paths: list[str] | str, columns=FLIGHT_COLUMNS, required=None) -> DataFrame:
    """All files, or all below a folder, read by the names in their headers, as text, with the file each row came from.

    Without ``required`` a file must have all ``columns``.
    """
    if isinstance(paths, str):
        paths = [path for path, size in list_files(spark, paths) if size]
    return read_layouts(spark, paths, columns, columns if required is None else required)


def write_months(flights: DataFrame, folder: str, upper: bool = True) -> None:
    """One folder of CSV parts per month, named ``YYYY-MM``.

    Rows are ranged by month first, so a task writes few months; the row hash lets a
    crowded month span tasks.
    """
    named = flights.toDF(*[c.upper() for c in flights.columns]) if upper else flights
    month = F.format_string("%04d-%02d", F.col("year"), F.col("month"))
    ranged = named.withColumn("file_month", month).repartitionByRange("file_month", F.xxhash64(*named.columns))
    ranged.write.mode("overwrite").partitionBy("file_month").option(
        "header", True
    ).csv(folder)


def file_month(column: str = "source_file"):
    """``YYYY-MM`` taken from a file's path."""
    return F.regexp_extract(F.col(column), r"(\d{4}-\d{2})[^/]*(/part-[^/]*)?$", 1)


def missing_months(flights: DataFrame, s: Settings) -> DataFrame:
    """Expected months without a single flight."""
    spine = flights.sparkSession.range(1).select(
        F.explode(
            F.sequence(
                F.lit(s.expected_first_month).cast("date"),
                F.lit(s.expected_last_month).cast("date"),
                F.expr("INTERVAL 1 MONTH"),
            )
        ).alias("m")
    )
    months = spine.select(F.year("m").alias("year"), F.month("m").alias("month")).where(
        ~F.col("year").isin(list(s.skipped_years)) if s.skipped_years else F.lit(True)
    )
    return months.join(flights.select("year", "month").distinct(), ["year", "month"], "left_anti")


def require_months(flights: DataFrame, s: Settings) -> DataFrame:
    missing = missing_months(flights, s).collect()  # at most one row per expected month
    if missing:
        raise FileNotFoundError(f"missing months: {[(r.year, r.month) for r in missing]}")
    return flights
