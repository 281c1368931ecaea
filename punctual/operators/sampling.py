"""Samples and splits that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.settings import Settings


def row_text(df: DataFrame) -> Column:
    """All columns as text, a missing value as empty text: the same in every engine."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])


def row_hash(df: DataFrame, seed: int, *salt: Column) -> Column:
    """MD5 of a seed and the row's text, in hexadecimal: samples can be drawn again outside Spark."""
    parts = [F.lit(str(seed)), *[F.coalesce(s.cast("string"), F.lit("")) for s in salt], row_text(df)]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def hundredth(digest: Column) -> Column:
    """A number from 0 to 99 from the first 15 of 32 hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % 100


def fraction(df: DataFrame, percent: int, seed: int) -> DataFrame:
    """About ``percent`` of the rows, decided per row from its content in the scan stage."""
    return df.where(hundredth(row_hash(df, seed)) < percent)


def stratified(df: DataFrame, stratum: str, percent: int, seed: int) -> DataFrame:
    """The same share of every stratum, with its own hash seed per stratum."""
    return df.where(hundredth(row_hash(df, seed, F.col(stratum))) < percent)


def first_rows(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """The first rows in a stated total order."""
    return df.orderBy(*order).limit(rows)


def sample_rows(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """A fixed number of rows in hash order: a top-k, not a full sort."""
    return df.orderBy(row_hash(df, seed), *df.columns).limit(rows)


def time_split(df: DataFrame, s: Settings) -> DataFrame:
    """Train, validation and test by flight date; rows outside have no split."""
    date = F.col("fl_date")
    return df.withColumn(
        "split",
        F.when(date <= F.lit(s.train_end).cast("date"), "train")
        .when(date.between(F.lit(s.valid_start).cast("date"), F.lit(s.valid_end).cast("date")), "valid")
        .when(date.between(F.lit(s.test_start).cast("date"), F.lit(s.test_end).cast("date")), "test"),
    )
