"""From raw rows to the cleaned flight table, one lazy chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions import features as X
from punctual.operators.copies import distinct_rows
from punctual.sources.carriers import with_airline
from punctual.sources.schema import (
    DATE_ALIASES,
    FLIGHT_COLUMNS,
    REQUIRED_COLUMNS,
    TEXT_FILLS,
    ZERO_FLAGS,
    ZERO_MINUTES,
)

# fixed values: date texts seen in monthly files
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy h:mm:ss a", "M/d/yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")


def snake_case(df: DataFrame) -> DataFrame:
    """Trim and lower the column names; spaces and hyphens become underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def missing_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def date_column(df: DataFrame, aliases=DATE_ALIASES) -> str:
    found = [c for c in df.columns if c in aliases]
    if not found:
        raise KeyError(f"no date column among {list(aliases)}")
    return found[-1]


def keep_columns(df: DataFrame, columns=FLIGHT_COLUMNS) -> DataFrame:
    """Project the fixed columns in their fixed order; absent optional ones are skipped."""
    return df.select(*[c for c in columns if c in df.columns])


def as_number(value: Column | str, kind: T.DataType | str = "double") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    # whole-number columns may arrive as '5.0'; the text 'NaN' is a missing value
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number).cast(kind)


def as_date(value: Column | str, formats=DATE_FORMATS) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    text = F.trim(value.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def cast_columns(df: DataFrame, types=FLIGHT_COLUMNS) -> DataFrame:
    """Typed columns; texts that do not parse become null."""
    typed = {}
    for name, kind in types.items():
        if name not in df.columns:
            continue
        if isinstance(kind, T.DateType):
            typed[name] = as_date(name)
        elif not isinstance(kind, T.StringType):
            typed[name] = as_number(name, kind)
    return df.withColumns(typed)


def fill_flags(df: DataFrame, flags=ZERO_FLAGS) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in flags if c in df.columns})


def fill_minutes(df: DataFrame, columns=ZERO_MINUTES) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns if c in df.columns})


def fill_labels(df: DataFrame, fills=TEXT_FILLS) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(text)) for c, text in fills.items() if c in df.columns})


def fill_missing(df: DataFrame) -> DataFrame:
    return fill_labels(fill_minutes(fill_flags(df)))


def only_operated(df: DataFrame) -> DataFrame:
    return df.where((F.coalesce("cancelled", F.lit(0)) == 0) & (F.coalesce("diverted", F.lit(0)) == 0))


def drop_undated(df: DataFrame) -> DataFrame:
    return df.where(F.col("fl_date").isNotNull())


def add_features(df: DataFrame, label: str = "dep", threshold: int = 15) -> DataFrame:
    """The nine derived columns; ``label`` picks the delay that decides lateness."""
    minutes = f"{label}_delay"
    derived = {
        "is_delayed": X.is_delayed(minutes, threshold),
        "delay_category": X.delay_category(minutes),
        "day_of_year": F.dayofyear("fl_date"),
        "week_of_year": F.weekofyear("fl_date"),
        "dep_hour": X.dep_hour(),
        "is_weekend": X.is_weekend(),
        "main_delay_cause": X.main_delay_cause(minutes, threshold),
    }
    if "origin" in df.columns:
        derived["route"] = X.route()
    return df.withColumns(derived).withColumn("is_peak_hour", X.is_peak_hour())


def clean_scheduled(raw: DataFrame, label: str = "dep") -> DataFrame:
    """Raw text rows to all scheduled flights, cancelled and diverted ones included: cleaned, with airline and derived columns.

    Exact copies are removed on the raw text, before any cast.
    """
    texts = distinct_rows(keep_columns(require_columns(snake_case(raw))))
    typed = fill_missing(drop_undated(cast_columns(texts)))
    return with_airline(add_features(typed, label=label))


def clean(raw: DataFrame, label: str = "dep") -> DataFrame:
    """Raw text rows to the cleaned table of the flights that ran as planned."""
    return only_operated(clean_scheduled(raw, label))
