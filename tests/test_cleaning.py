"""Hand-made edge rows through the cleaning chain."""

from __future__ import annotations

import pytest

from punctual.functions import features as X
from punctual.operators import cleaning as C
from punctual.sources.schema import FLIGHT_COLUMNS

BASE = {c.upper(): "0" for c in FLIGHT_COLUMNS} | {
    "FL_DATE": "2000-03-05", "YEAR": "2000", "MONTH": "3", "DAY_OF_WEEK": "7", "OP_UNIQUE_CARRIER": "AA",
    "TAIL_NUM": "N1", "ORIGIN": "AAA", "DEST": "BBB", "CRS_DEP_TIME": "930", "CANCELLATION_CODE": None,
}


def raw(spark, *changes):
    rows = [{**BASE, "DISTANCE": str(i), **change} for i, change in enumerate(changes)]
    schema = ", ".join(f"`{c}` string" for c in BASE)
    return spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], schema)


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("distance").select(*columns).collect()]


def test_delay_edges(spark):
    minutes = [None, "-1", "0", "15", "16", "60", "61", "120", "121", "301", "bad", "NaN"]
    out = C.clean(raw(spark, *[{"DEP_DELAY": m} for m in minutes]))
    assert values(out, "dep_delay", "is_delayed", "delay_category") == [
        (0.0, 0, "early_on_time"), (-1.0, 0, "early_on_time"), (0.0, 0, "early_on_time"),
        (15.0, 1, "minor_1_15"), (16.0, 1, "moderate_16_60"), (60.0, 1, "moderate_16_60"),
        (61.0, 1, "severe_61_120"), (120.0, 1, "severe_61_120"), (121.0, 1, "extreme_120_plus"),
        (301.0, 1, "extreme_120_plus"), (0.0, 0, "early_on_time"), (0.0, 0, "early_on_time"),
    ]


def test_hours_and_peaks(spark):
    times = ["0", "59", "459", "500", "959", "1000", "1559", "1600", "1959", "2000", "2359", "2400", None]
    out = C.clean(raw(spark, *[{"CRS_DEP_TIME": m} for m in times]))
    assert values(out, "dep_hour", "is_peak_hour") == [
        (0, 0), (0, 0), (4, 0), (5, 1), (9, 1), (10, 0), (15, 0), (16, 1), (19, 1), (20, 0), (23, 0), (23, 0), (None, 0),
    ]


def test_weekends_fills_and_unknown_codes(spark):
    out = C.clean(
        raw(spark, {"DAY_OF_WEEK": "5"}, {"DAY_OF_WEEK": "6", "TAIL_NUM": None}, {"DAY_OF_WEEK": "7.0", "ORIGIN": None})
    )
    assert values(out, "is_weekend", "tail_num", "cancellation_code", "route") == [
        (0, "N1", "not_cancelled", "AAA_BBB"), (1, "unknown", "not_cancelled", "AAA_BBB"), (1, "N1", "not_cancelled", None),
    ]


def test_dates(spark):
    texts = ["2000-03-05", "3/5/2000 12:00:00 AM", "20000305", "2000-03-05 00:00:00", "nonsense", None]
    out = C.clean(raw(spark, *[{"FL_DATE": d} for d in texts]))
    assert [str(d) for (d,) in values(out, "fl_date")] == ["2000-03-05"] * 4


def test_copies_and_removed_flights(spark):
    rows = raw(spark, {"DISTANCE": "1"}, {"DISTANCE": "1"}, {"CANCELLED": "1"}, {"DIVERTED": "1.0"})
    assert C.clean(rows).count() == 1
    # copies are compared as text, before any cast
    assert C.clean(raw(spark, {"DISTANCE": "1"}, {"DISTANCE": "1.0"})).count() == 2


def test_causes(spark):
    late = {"DEP_DELAY": "20"}
    out = C.clean(
        raw(
            spark,
            late | {"NAS_DELAY": "3", "SECURITY_DELAY": "9"},
            late | {"CARRIER_DELAY": "7", "LATE_AIRCRAFT_DELAY": "7"},
            late,
            late | {"CARRIER_DELAY": None, "WEATHER_DELAY": None, "NAS_DELAY": None, "LATE_AIRCRAFT_DELAY": "1"},
            {"DEP_DELAY": "14", "NAS_DELAY": "30"},
        )
    )
    assert [c for (c,) in values(out, "main_delay_cause")] == [
        "security_delay", "carrier_delay", "no_reported_cause", "late_aircraft_delay", "no_delay",
    ]


def test_distance_groups(spark):
    miles = [499.0, 500.0, 999.0, 1000.0, 1999.0, 2000.0, None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(miles)], "i int, distance double")
    got = [r[0][0] for r in df.orderBy("i").select(X.distance_group()).collect()]
    assert got == list("1223344")


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="tail_num"):
        C.clean(raw(spark, {}).drop("TAIL_NUM"))
