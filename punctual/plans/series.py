"""Daily delay-rate series, keyed by ``series_key``: national, carrier or airport.

Flight rows are touched once, by :func:`daily_counts`. Everything after it works
on one row per series and day, so windows partitioned by series hold at most a
calendar's worth of rows.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.weights import count_of
from punctual.operators.lookups import day_spine, near_holiday
from punctual.settings import Settings

NATIONAL = "ALL"

# fixed values: seasonal orders and periods of the calendar features
YEARLY_TERMS, YEARLY_PERIOD = 10, 365.25
WEEKLY_TERMS, WEEKLY_PERIOD = 3, 7.0


def daily_counts(flights: DataFrame, by: str | None = None) -> DataFrame:
    key = F.col(by) if by else F.lit(NATIONAL)
    return flights.groupBy(key.alias("series_key"), F.col("fl_date").alias("ds")).agg(
        count_of(flights, "is_delayed = 1").alias("late"), count_of(flights).alias("n")
    )


def as_rate(counts: DataFrame) -> DataFrame:
    return counts.select("series_key", "ds", (F.col("late").cast("double") / F.col("n") * 100).alias("y"))


def daily_rate(flights: DataFrame, by: str | None = None) -> DataFrame:
    return as_rate(daily_counts(flights, by))


def daily_panel(flights: DataFrame, by: str = "op_unique_carrier") -> DataFrame:
    """The national series plus one per key, from a single pass over the flights."""
    each = daily_counts(flights, by)
    national = each.groupBy(F.lit(NATIONAL).alias("series_key"), "ds").agg(
        F.sum("late").alias("late"), F.sum("n").alias("n")
    )
    return as_rate(each.unionByName(national))


def every_day(series: DataFrame) -> DataFrame:
    """Missing calendar days inserted with a null rate."""
    return day_spine(series, "series_key").join(series, ["series_key", "ds"], "left")


def missing_days(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("y").isNull()).alias("n_missing")
    )


def with_neighbours(daily: DataFrame) -> DataFrame:
    """Nearest known value and day on either side of each day.

    Both sides are running frames, the second over the reversed order: a frame
    that reaches forward to the end would be evaluated anew for every day.
    """
    series = Window.partitionBy("series_key")
    back = series.orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    ahead = series.orderBy(F.desc("ds")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("y").isNotNull(), F.struct("ds", "y"))
    return daily.withColumns(
        {"before": F.last(known, ignorenulls=True).over(back), "after": F.last(known, ignorenulls=True).over(ahead)}
    )


def interpolate(daily: DataFrame, limit: int = 3) -> DataFrame:
    """Linear in time, at most ``limit`` days into a gap; a trailing gap repeats the last value."""
    into = F.datediff("ds", F.col("before.ds"))
    slope = (F.col("after.y") - F.col("before.y")) / F.datediff(F.col("after.ds"), F.col("before.ds"))
    value = F.when(F.col("after").isNull(), F.col("before.y")).otherwise(slope * into + F.col("before.y"))
    filled = F.when(F.col("y").isNotNull(), F.col("y")).when(into <= limit, value)
    return with_neighbours(daily).select("series_key", "ds", filled.alias("y"))


def remaining_missing(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Days still empty after filling, and empty days of the final test period."""
    final = F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return daily.groupBy("series_key").agg(
        F.count_if(F.col("y").isNull()).alias("n_missing"),
        F.count_if(F.col("y").isNull() & final).alias("n_missing_test"),
    ).withColumn("ok", F.col("n_missing") == 0)


def drop_unfilled(daily: DataFrame) -> DataFrame:
    return daily.where("y IS NOT NULL")


def summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series_key").agg(
        F.min("ds").alias("first_day"),
        F.max("ds").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg("y").alias("mean_rate"),
        F.count_if(F.col("y").isNull()).alias("n_missing"),
    )


# fixed values: US federal holidays as (name, month, rule, first year observed);
# a rule is a day of the month, (n, weekday) or ("last", weekday)
HOLIDAYS = (
    ("New Year's Day", 1, 1, 0),
    ("Martin Luther King Jr. Day", 1, (3, "MON"), 1986),
    ("Washington's Birthday", 2, (3, "MON"), 0),
    ("Memorial Day", 5, ("last", "MON"), 0),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 0),
    ("Labor Day", 9, (1, "MON"), 0),
    ("Columbus Day", 10, (2, "MON"), 0),
    ("Veterans Day", 11, 11, 0),
    ("Thanksgiving Day", 11, (4, "THU"), 0),
    ("Christmas Day", 12, 25, 0),
)


def _holiday_date(month: int, rule) -> str:
    if isinstance(rule, int):
        return f"make_date(year, {month}, {rule})"
    nth, weekday = rule
    if nth == "last":
        return f"next_day(date_sub(last_day(make_date(year, {month}, 1)), 7), '{weekday}')"
    return f"date_add(next_day(date_sub(make_date(year, {month}, 1), 1), '{weekday}'), {7 * (nth - 1)})"


def holiday_calendar(series: DataFrame) -> DataFrame:
    """Holidays of every year the series cover, with the weekday they are observed on."""
    span = series.agg(F.year(F.min("ds")).alias("first"), F.year(F.max("ds")).alias("last"))
    # one year more, for a New Year's Day observed on 31 December
    years = span.select(
        "first", "last", F.explode(F.sequence("first", F.col("last") + 1)).alias("year")
    )
    rules = F.array(
        *[
            F.when(
                F.col("year") >= since,
                F.struct(F.lit(name).alias("holiday"), F.expr(_holiday_date(month, rule)).alias("ds")),
            )
            for name, month, rule, since in HOLIDAYS
        ]
    )
    actual = years.select("first", "last", F.inline(F.filter(rules, lambda h: h.isNotNull())))
    shift = F.when(F.weekday("ds") == 5, -1).when(F.weekday("ds") == 6, 1)
    observed = (
        actual.where(F.col("holiday").isin([h[0] for h in HOLIDAYS if isinstance(h[2], int)]))
        .where(shift.isNotNull())
        .select(
            "first", "last",
            F.concat("holiday", F.lit(" (observed)")).alias("holiday"),
            F.date_add("ds", shift).alias("ds"),
        )
    )
    return (
        actual.unionByName(observed)
        .where(F.year("ds").between(F.col("first"), F.col("last")))
        .select("ds", "holiday")
    )


def holiday_offsets(holidays: DataFrame, reach: int) -> DataFrame:
    """Each holiday widened to its window, one row per date, holiday and offset."""
    return holidays.select(
        "ds", "holiday", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("day_offset")
    ).select(F.expr("date_add(ds, day_offset)").alias("ds"), "holiday", "day_offset")


def with_holidays(daily: DataFrame, reach: int) -> DataFrame:
    return near_holiday(daily, holiday_calendar(daily), reach)


def calendar_features(daily: DataFrame, yearly: int = YEARLY_TERMS, weekly: int = WEEKLY_TERMS) -> DataFrame:
    """Weekday (0 = Monday), trend index and seasonal sine and cosine terms."""
    first = F.min("ds").over(Window.partitionBy("series_key"))
    day = F.datediff("ds", F.lit("1970-01-01").cast("date"))
    columns = {"weekday": F.weekday("ds"), "trend": F.datediff("ds", first)}
    for name, terms, period in (("year", yearly, YEARLY_PERIOD), ("week", weekly, WEEKLY_PERIOD)):
        for k in range(1, terms + 1):
            columns[f"{name}_sin_{k}"] = F.sin(day * (2 * pi * k / period))
            columns[f"{name}_cos_{k}"] = F.cos(day * (2 * pi * k / period))
    return daily.withColumns(columns)


def lags(daily: DataFrame, *steps: int) -> DataFrame:
    order = Window.partitionBy("series_key").orderBy("ds")
    return daily.withColumns({f"lag_{k}": F.lag("y", k).over(order) for k in steps})


def tail(daily: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` days of each series, newest first as ``back`` = 1, 2, …"""
    order = Window.partitionBy("series_key").orderBy(F.desc("ds"))
    return daily.withColumn("back", F.row_number().over(order)).where(F.col("back") <= rows)


def periods(daily: DataFrame, s: Settings) -> DataFrame:
    """Latest-days test period per series, and the third quarter before it where covered."""
    ends = daily.groupBy("series_key").agg(F.min("ds").alias("first_day"), F.max("ds").alias("end_date"))
    latest = ends.withColumn("split_date", F.date_sub("end_date", s.latest_days - 1))
    first_quarter = (F.date_format("split_date", "MM-dd") == "01-01") & (F.date_format("end_date", "MM-dd") == "03-31")
    latest = latest.select(
        "series_key",
        F.when(first_quarter, F.concat(F.lit("Q1 "), F.year("end_date").cast("string")))
        .otherwise(f"Latest {s.latest_days} Days").alias("period"),
        "split_date", "end_date",
    )
    before = F.year("end_date") - 1
    summer = ends.select(
        "series_key",
        F.concat(F.lit("Q3 "), before.cast("string")).alias("period"),
        F.make_date(before, F.lit(7), F.lit(1)).alias("split_date"),
        F.make_date(before, F.lit(9), F.lit(30)).alias("last_date"),
        "first_day", "end_date",
    ).where("first_day < split_date AND end_date >= last_date")
    return latest.unionByName(
        summer.select("series_key", "period", "split_date", F.col("last_date").alias("end_date"))
    )


def holdout(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Rows marked ``train`` before ``start`` and ``test`` within the period."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    part = F.when(F.col("ds") < first, "train").when(F.col("ds").between(first, last), "test")
    return daily.withColumn("part", part).where("part IS NOT NULL")


def between(daily: DataFrame, start: str, end: str) -> DataFrame:
    return daily.where(F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
