"""Readable labels for report keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: display labels
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
CAUSE_LABELS = {
    "carrier_delay": "Carrier",
    "late_aircraft_delay": "Late Aircraft",
    "nas_delay": "National Airspace System",
    "weather_delay": "Weather",
    "security_delay": "Security",
    "no_reported_cause": "No Reported Cause",
}
CATEGORY_LABELS = {
    "early_on_time": "Early/On Time",
    "minor_1_15": "Minor (1-15)",
    "moderate_16_60": "Moderate (16-60)",
    "severe_61_120": "Severe (61-120)",
    "extreme_120_plus": "Extreme (120+)",
}
METHOD_FAMILIES = {
    "Manual SARIMA": "Manual SARIMA",
    "Auto SARIMA": "Auto SARIMA",
    "SARIMAX + holiday": "SARIMAX + Holiday",
    "Prophet": "Prophet + Holidays",
}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _pick(names: tuple[str, ...], position: Column | str) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), _col(position).cast("int"))


def _lookup(labels: dict[str, str], value: Column | str) -> Column:
    value = _col(value)
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def month_name(month: Column | str = "month") -> Column:
    return _pick(MONTHS, month)


def quarter_label(quarter: Column | str = "quarter") -> Column:
    return F.concat(F.lit("Q"), _col(quarter).cast("string"))


def day_name(weekday: Column | str = "day_of_week") -> Column:
    return _pick(WEEKDAYS, weekday)


def peak_label(flag: Column | str = "is_peak_hour") -> Column:
    return F.when(_col(flag) == 1, "Peak").otherwise("Off-Peak")


def weekend_label(flag: Column | str = "is_weekend") -> Column:
    return F.when(_col(flag) == 1, "Weekend").otherwise("Weekday")


def airport_label(code: Column | str = "origin", city: Column | str = "origin_city_name") -> Column:
    return F.concat(_col(code), F.lit(" — "), _col(city))


def airport_city(code: Column | str = "origin", city: Column | str = "origin_city_name") -> Column:
    return F.concat(_col(code), F.lit(" ("), _col(city), F.lit(")"))


def route_label(start: Column | str = "origin_city_name", end: Column | str = "dest_city_name") -> Column:
    return F.concat_ws(" → ", _col(start), _col(end))


def cause_label(cause: Column | str = "main_delay_cause") -> Column:
    return _lookup(CAUSE_LABELS, cause)


def category_label(category: Column | str = "delay_category") -> Column:
    return _lookup(CATEGORY_LABELS, category)


def coverage_label(year: Column | str, first: int, rest: str) -> Column:
    return F.when(_col(year) == first, str(first)).otherwise(rest)


def year_month(date: Column | str = "fl_date") -> Column:
    return F.trunc(_col(date), "month")


def feature_title(name: Column | str) -> Column:
    name = _col(name)
    for prefix in ("numeric__", "categorical__"):
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def method_family(name: Column | str) -> Column:
    name = _col(name)
    family = F.when(name.isNull(), None)
    for prefix, label in METHOD_FAMILIES.items():
        family = family.when(name.startswith(prefix), label)
    return family.otherwise(name)
