"""Carrier names: a fixed list, so it is folded into expressions as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: carrier codes and display names
CARRIER_NAMES = {
    "AA": "American Airlines",
    "AS": "Alaska Airlines",
    "B6": "JetBlue Airways",
    "DL": "Delta Air Lines",
    "F9": "Frontier Airlines",
    "G4": "Allegiant Air",
    "HA": "Hawaiian Airlines",
    "NK": "Spirit Airlines",
    "OH": "PSA Airlines",
    "OO": "SkyWest Airlines",
    "QX": "Horizon Air",
    "UA": "United Airlines",
    "WN": "Southwest Airlines",
    "YV": "Mesa Airlines",
    "YX": "Republic Airways",
    "MQ": "Envoy Air",
    "9E": "Endeavor Air",
    "PT": "Piedmont Airlines",
    "EV": "ExpressJet Airlines",
}


def carrier_name(code: Column | str) -> Column:
    """Display name of a carrier code, the code itself when it is not listed."""
    code = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(part) for item in CARRIER_NAMES.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def with_airline(flights: DataFrame) -> DataFrame:
    return flights.withColumn("airline_name", carrier_name("op_unique_carrier"))


def carrier_table(spark: SparkSession) -> DataFrame:
    """The same list as a 19-row dimension."""
    return spark.createDataFrame(
        list(CARRIER_NAMES.items()), "op_unique_carrier string, carrier_name string"
    )
