"""Column expressions that derive features from a flight row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.sources.schema import CAUSES

# fixed values: delay categories with their inclusive upper bound in minutes
DELAY_CATEGORIES = (
    ("early_on_time", 0),
    ("minor_1_15", 15),
    ("moderate_16_60", 60),
    ("severe_61_120", 120),
    ("extreme_120_plus", None),
)

# fixed values: distance groups with their exclusive upper bound in miles
DISTANCE_GROUPS = (
    ("1. Short (<500 mi)", 500),
    ("2. Medium (500-999 mi)", 1000),
    ("3. Long (1000-1999 mi)", 2000),
    ("4. Very Long (2000+ mi)", None),
)

# fixed values: peak departure hours, both ends included
PEAK_HOURS = ((5, 9), (16, 19))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_delayed(minutes: Column | str = "dep_delay", threshold: int = 15) -> Column:
    return (_col(minutes) >= threshold).cast("int")


def delay_category(minutes: Column | str = "dep_delay") -> Column:
    minutes = _col(minutes)
    # an unbounded last bin still leaves a missing delay without a category
    bins = F.when(minutes.isNull(), F.lit(None))
    for name, upper in DELAY_CATEGORIES:
        bins = bins.when(minutes <= upper, name) if upper is not None else bins.otherwise(name)
    return bins


def dep_hour(hhmm: Column | str = "crs_dep_time") -> Column:
    hhmm = _col(hhmm)
    hour = F.floor(hhmm / 100).cast("int")
    return F.when(hhmm.isNotNull(), F.least(F.greatest(hour, F.lit(0)), F.lit(23)))


def is_peak_hour(hour: Column | str = "dep_hour") -> Column:
    hour = _col(hour)
    (a, b), (c, d) = PEAK_HOURS
    return F.coalesce(hour.between(a, b) | hour.between(c, d), F.lit(False)).cast("int")


def is_weekend(weekday: Column | str = "day_of_week") -> Column:
    return F.coalesce(_col(weekday) >= 6, F.lit(False)).cast("int")


def route(origin: Column | str = "origin", dest: Column | str = "dest") -> Column:
    return F.concat(_col(origin), F.lit("_"), _col(dest))


def largest_cause(fallback: str = "no_reported_cause") -> Column:
    """Cause with the most minutes; an earlier cause wins a tie, none positive falls back."""
    minutes = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in CAUSES}
    top = F.greatest(*minutes.values())
    picked = F.when(top <= 0, fallback)
    for name, value in minutes.items():
        picked = picked.when(value == top, name)
    return picked


def largest_cause_minutes() -> Column:
    return F.greatest(*[F.coalesce(F.col(name), F.lit(0.0)) for name in CAUSES])


def main_delay_cause(minutes: Column | str = "dep_delay", threshold: int = 15) -> Column:
    return F.when(_col(minutes) < threshold, "no_delay").otherwise(largest_cause())


def distance_group(miles: Column | str = "distance") -> Column:
    miles = _col(miles)
    (short, a), (medium, b), (long, c), (rest, _) = DISTANCE_GROUPS
    return F.when(miles < a, short).when(miles < b, medium).when(miles < c, long).otherwise(rest)


def time_recovered(arrival: Column | str = "arr_delay", departure: Column | str = "dep_delay") -> Column:
    return _col(arrival) - _col(departure)


def clipped(value: Column | str, low: float, high: float) -> Column:
    value = _col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
