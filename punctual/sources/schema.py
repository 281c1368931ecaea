"""Column lists and types of the flight table."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: the raw columns kept, in order, with their types after cleaning
FLIGHT_COLUMNS = {
    "year": T.IntegerType(),
    "quarter": T.IntegerType(),
    "month": T.IntegerType(),
    "day_of_month": T.IntegerType(),
    "day_of_week": T.IntegerType(),
    "fl_date": T.DateType(),
    "op_unique_carrier": T.StringType(),
    "tail_num": T.StringType(),
    "origin": T.StringType(),
    "origin_city_name": T.StringType(),
    "origin_state_abr": T.StringType(),
    "dest": T.StringType(),
    "dest_city_name": T.StringType(),
    "dest_state_abr": T.StringType(),
    "crs_dep_time": T.IntegerType(),
    "dep_time": T.IntegerType(),
    "dep_delay": T.DoubleType(),
    "dep_delay_new": T.DoubleType(),
    "dep_del15": T.IntegerType(),
    "arr_delay": T.DoubleType(),
    "arr_delay_new": T.DoubleType(),
    "arr_del15": T.IntegerType(),
    "cancelled": T.IntegerType(),
    "cancellation_code": T.StringType(),
    "diverted": T.IntegerType(),
    "air_time": T.DoubleType(),
    "distance": T.DoubleType(),
    "carrier_delay": T.DoubleType(),
    "weather_delay": T.DoubleType(),
    "nas_delay": T.DoubleType(),
    "security_delay": T.DoubleType(),
    "late_aircraft_delay": T.DoubleType(),
}

# fixed values: columns the cleaning step cannot work without
REQUIRED_COLUMNS = (
    "fl_date", "cancelled", "diverted", "dep_delay", "arr_delay",
    "crs_dep_time", "day_of_week", "tail_num", "origin", "dest",
)

# fixed values: delay causes in tie-breaking order
CAUSES = (
    "carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay",
)

# fixed values: accepted names of the date column
DATE_ALIASES = ("FlightDate", "FL_DATE", "fl_date")

# fixed values: how missing values are filled
ZERO_FLAGS = ("cancelled", "diverted", "dep_del15", "arr_del15")
ZERO_MINUTES = CAUSES + ("dep_delay", "dep_delay_new", "arr_delay", "arr_delay_new", "air_time")
TEXT_FILLS = {"cancellation_code": "not_cancelled", "tail_num": "unknown"}


def landing_schema(columns=FLIGHT_COLUMNS) -> T.StructType:
    """All-text schema for reading monthly files before any cast."""
    return T.StructType([T.StructField(c.upper(), T.StringType()) for c in columns])
