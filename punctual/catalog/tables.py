"""The inputs a registered query asks for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from punctual.settings import FIXTURE, Settings
from punctual.sources import flights


@lru_cache(maxsize=64)
def _scheduled(spark: SparkSession, folder: str, scope: tuple) -> DataFrame:
    # only the plan is kept; every query still reads its own columns from the files
    return flights.with_airline(flights.scheduled(spark, folder, **dict(scope)))


@lru_cache(maxsize=64)
def _operated(spark: SparkSession, folder: str, label: str, scope: tuple) -> DataFrame:
    return flights.operated(spark, folder, label, **dict(scope))


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str
    s: Settings = FIXTURE

    def scheduled(self, places: bool = False, **scope) -> DataFrame:
        return _scheduled(self.spark, self.folder, tuple({**scope, "places": places}.items()))

    def scheduled_complete(self, places: bool = False) -> DataFrame:
        return self.scheduled(places, before=self.s.partial_year_start)

    def operated(self, places: bool = False, label: str = "dep", **scope) -> DataFrame:
        return _operated(self.spark, self.folder, label, tuple({**scope, "places": places}.items()))

    def complete(self, places: bool = False, label: str = "dep") -> DataFrame:
        return self.operated(places, label, before=self.s.partial_year_start)
