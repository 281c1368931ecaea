"""Every threshold, period and label rule used by the plans, in one place.

``PUBLISHED`` holds the values for the full national data set; ``FIXTURE``
holds the same parameters scaled to the generated test tables, whose calendar
runs 1995-2001 and whose volumes are smaller; model sizes are the published ones.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # fixed values: reporting scope and minimum volumes
    partial_year: int = 2026
    airline_min_flights: int = 1_000_000
    airline_min_delayed: int = 100_000
    airport_min_flights: int = 200_000
    route_min_flights: int = 50_000
    airline_year_min_flights: int = 50_000
    wide_airport_min_flights: int = 500_000
    coverage_year: int = 2019
    coverage_label: str = "2022–2025"
    expected_first_month: str = "2019-01-01"
    expected_last_month: str = "2026-03-01"
    skipped_years: tuple[int, ...] = (2020, 2021)

    # fixed values: label and outlier rules
    delay_minutes: int = 15
    extreme_minutes: int = 300
    fence_width: float = 1.5

    # fixed values: classification periods
    train_end: str = "2024-12-31"
    valid_start: str = "2025-01-01"
    valid_end: str = "2025-12-31"
    test_start: str = "2026-01-01"
    test_end: str = "2026-03-31"
    sample_percent: int = 10
    sample_seed: int = 42
    rare_category_rows: int = 100
    explained_rows: int = 1000

    # fixed values: forecasting periods
    series_start: str = "2022-01-01"
    series_train_end: str = "2025-12-31"
    holdout_start: str = "2025-07-01"
    holdout_end: str = "2025-09-30"
    final_start: str = "2026-01-01"
    final_end: str = "2026-03-31"
    holiday_reach: int = 2
    gap_limit: int = 3
    min_history_days: int = 180
    min_train_days: int = 90
    latest_days: int = 90

    # fixed values: model sizes
    logistic_iterations: int = 500
    forest_trees: int = 80
    forest_depth: int = 14
    forest_leaf_rows: int = 50
    boost_rounds: int = 120
    boost_depth: int = 4
    boost_step: float = 0.08
    boost_subsample: float = 0.8
    stump_rounds: int = 80
    stump_step: float = 0.5
    split_bins: int = 64
    tree_bins: int = 32

    @property
    def complete_years(self) -> list[int]:
        first = int(self.expected_first_month[:4])
        return [y for y in range(first, self.partial_year) if y not in self.skipped_years]

    @property
    def partial_year_start(self) -> str:
        return f"{self.partial_year}-01-01"


PUBLISHED = Settings()

FIXTURE = replace(
    PUBLISHED,
    partial_year=2001,
    airline_min_flights=2_580,
    airline_min_delayed=569,
    airport_min_flights=2_000,
    route_min_flights=111,
    airline_year_min_flights=428,
    wide_airport_min_flights=2_200,
    coverage_year=1995,
    coverage_label="1996–2000",
    expected_first_month="1995-01-01",
    expected_last_month="2001-12-01",
    skipped_years=(),
    train_end="1999-12-31",
    valid_start="2000-01-01",
    valid_end="2000-12-31",
    test_start="2001-01-01",
    test_end="2001-03-31",
    series_start="1997-01-01",
    series_train_end="2000-12-31",
    holdout_start="2000-07-01",
    holdout_end="2000-09-30",
    final_start="2001-01-01",
    final_end="2001-03-31",
)
