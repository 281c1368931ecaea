"""Registered queries by name: each is a function of the :class:`Tables` it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.catalog import model_queries, operator_queries, report_queries, series_queries
from punctual.catalog.tables import Tables

CATALOG: dict[str, Callable[[Tables], DataFrame]] = {
    **report_queries.QUERIES,
    **operator_queries.QUERIES,
    **series_queries.QUERIES,
    **model_queries.QUERIES,
}


def portable(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, the form results are compared in."""
    casts = {
        f.name: F.col(f.name).cast("string" if isinstance(f.dataType, T.DateType) else "double")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DateType, T.DecimalType))
    }
    return df.withColumns(casts) if casts else df


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, folder: portable(plan(Tables(spark, folder)))

    return {name: bind(plan) for name, plan in CATALOG.items()}
