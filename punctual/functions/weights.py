"""Aggregates that read plain rows and pre-counted rows alike.

``compact`` turns rows into one row per distinct key combination with a
``flights`` count. Every report below is written against :func:`weight`, so the
same code runs on the flight table or on a compact table of it. Percentiles are
always taken from compact rows: a group's buffer then holds its distinct minute
values, however many flights the group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "flights"


def weight(df: DataFrame) -> Column:
    return F.col(COUNT) if COUNT in df.columns else F.lit(1).cast("bigint")


def compact(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(weight(df)).alias(COUNT))


def _condition(where: Column | str) -> Column:
    return F.expr(where) if isinstance(where, str) else where


def count_of(df: DataFrame, where: Column | str | None = None) -> Column:
    w = weight(df)
    where = where if where is None else _condition(where)
    return F.sum(w) if where is None else F.coalesce(F.sum(F.when(where, w)), F.lit(0)).cast("bigint")


def mean_of(df: DataFrame, value: Column | str, where: Column | str | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    used = value.isNotNull() if where is None else value.isNotNull() & _condition(where)
    w = weight(df)
    return F.try_divide(F.sum(F.when(used, value * w)), F.sum(F.when(used, w)))


def mean2_of(df: DataFrame, value: Column | str, where: Column | str | None = None) -> Column:
    return F.round(mean_of(df, value, where), 2)


def percentile2_of(df: DataFrame, value: Column | str, share: float) -> Column:
    return F.round(F.percentile(value, F.lit(share), weight(df)), 2)
