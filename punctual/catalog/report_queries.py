"""Report, history, exploration and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.plans import dashboards as D
from punctual.plans import explore as E
from punctual.plans import history as H
from punctual.plans import reports as R

REPORTS = {
    "q00_total_rows": lambda t: R.total_rows(t.operated()),
    "q01_airline_delay_rate": lambda t: R.airline_rate(t.complete(), t.s),
    "q02_airline_delay_volume": lambda t: R.airline_volume(t.complete(), t.s),
    "q03_airline_dep_severity": lambda t: R.airline_departure_severity(t.complete(), t.s),
    "q04_airline_arr_severity": lambda t: R.airline_arrival_severity(t.complete(), t.s),
    "q05_airline_cancel_divert": lambda t: R.airline_disruptions(t.scheduled()),
    "q06_airport_delay_rate": lambda t: R.airport_rate(t.complete(places=True), t.s),
    "q08_route_delay_rate": lambda t: R.route_rate(t.complete(places=True), t.s),
    "q10_month": lambda t: R.calendar_rate(t.complete(), "month"),
    "q11_quarter": lambda t: R.calendar_rate(t.complete(), "quarter"),
    "q12_day_of_week": lambda t: R.calendar_rate(t.complete(), "day_of_week"),
    "q13_dep_hour": lambda t: R.calendar_rate(t.complete(), "dep_hour"),
    "q14_peak": lambda t: R.calendar_rate(t.complete(), "is_peak_hour"),
    "q15_weekend": lambda t: R.calendar_rate(t.complete(), "is_weekend"),
    "q16_delay_causes": lambda t: R.cause_share(t.complete()),
    "q17_distance_severity": lambda t: R.distance_severity(t.complete(places=True)),
    "q18_distance_rate": lambda t: R.distance_rate(t.complete(places=True)),
    "q19_year": lambda t: R.calendar_rate(t.complete(), "year"),
    "q21_airline_year": lambda t: R.airline_year_rate(t.complete(), t.s),
    "q23_volume_by_year": lambda t: R.volume_by_year(t.scheduled_complete()),
    "q24_kpi_overview": lambda t: R.kpi_overview(t.complete(places=True)),
    "q25_cancel_divert_kpi": lambda t: R.disruption_kpis(t.scheduled()),
}

HISTORY = {
    "r_airline_year_severity": lambda t: H.airline_year_severity(t.complete(label="arr"), t.s),
    "r_airline_time_recovered": lambda t: H.airline_time_recovered(t.operated(label="arr"), t.s),
    "r_airline_cause_minutes": lambda t: H.airline_cause_minutes(t.operated(label="arr"), t.s),
    "r_airline_rate_arr": lambda t: H.airline_rate_arrival(t.operated(label="arr"), t.s),
    "r_airline_year_rate": lambda t: H.airline_year_rate(t.complete(label="arr"), t.s),
    "r_airport_rate": lambda t: H.airport_rate(t.operated(True, "arr"), t.s),
    "r_year_severity": lambda t: H.year_severity(t.operated(label="arr")),
    "r_distance_avg_arr": lambda t: H.distance_arrival(t.operated(True, "arr")),
    "r_delay_category_share": lambda t: H.category_share(t.operated(label="arr")),
    "r_cause_minutes_year": lambda t: H.year_cause_minutes(t.operated(label="arr")),
    "r_hour_rate": lambda t: H.hour_rate(t.operated(label="arr")),
    "r_kpi_card": lambda t: H.kpi_card(t.operated(True, "arr"), t.s),
    "r_month_rate": lambda t: H.calendar_rate(t.operated(label="arr"), "month"),
    "r_quarter_rate": lambda t: H.calendar_rate(t.operated(label="arr"), "quarter"),
    "r_weekday_rate": lambda t: H.weekday_rate(t.operated(label="arr")),
    "r_year_month_series": lambda t: H.year_month_series(t.operated(label="arr")),
    "r_year_quarter": lambda t: H.year_quarter(t.operated(label="arr")),
    "r_cause_share_arr": lambda t: H.cause_share_arrival(t.operated(label="arr")),
    "r_route_rate": lambda t: H.route_rate(t.operated(True, "arr"), t.s),
    "r_route_topk": lambda t: H.route_top(t.operated(True, "arr"), t.s),
    "r_year_rate": lambda t: H.year_rate(t.operated(label="arr")),
}

EXPLORE = {
    "e_delay_share": lambda t: E.delay_share(t.complete()),
    "e_year_rate": lambda t: E.mean_rate(t.complete(), "year"),
    "e_month_rate": lambda t: E.mean_rate(t.complete(), "month"),
    "e_hour_rate": lambda t: E.mean_rate(t.complete(), "dep_hour"),
    "e_month_year_pivot": lambda t: E.rate_pivot(t.complete(), "month", t.s),
    "e_hour_year_pivot": lambda t: E.rate_pivot(t.complete(), "dep_hour", t.s),
    "e_month_year_volume_pivot": lambda t: E.volume_pivot(t.complete(), "month", t.s),
    "e_year_volume": lambda t: E.volume(t.complete(), "year"),
    "e_hour_volume": lambda t: E.hour_volume(t.complete()),
    "e_delay_hist_arr": lambda t: E.delay_histogram(t.complete(), "arr_delay"),
    "e_delay_hist_dep": lambda t: E.delay_histogram(t.complete(), "dep_delay"),
    "e_distance_hist": lambda t: E.distance_histogram(t.complete(places=True)),
    "e_outlier_describe": lambda t: E.describe(t.operated(places=True)),
    "e_top10_dep_delay": lambda t: E.top_departure_delays(t.operated(places=True), t.s),
}


def _airports(t):
    return R.airport_rate(t.complete(places=True), t.s)


def _routes(t):
    return R.route_rate(t.complete(places=True), t.s)


def _rate_and_volume(key: str, places: bool = False):
    return lambda t: D.rate_and_volume(t.complete(places=places), key)


DASHBOARDS = {
    "d_kpi_cards": lambda t: D.kpi_cards(R.kpi_overview(t.complete(places=True))),
    "d_classification_share": lambda t: D.classification_share(R.kpi_overview(t.complete(places=True))),
    "d_rate_and_volume_year": _rate_and_volume("year"),
    "d_rate_and_volume_month": _rate_and_volume("month"),
    "d_rate_and_volume_quarter": _rate_and_volume("quarter"),
    "d_rate_and_volume_weekday": _rate_and_volume("day_of_week"),
    "d_rate_and_volume_hour": _rate_and_volume("dep_hour"),
    "d_rate_and_volume_peak": _rate_and_volume("is_peak_hour"),
    "d_rate_and_volume_weekend": _rate_and_volume("is_weekend"),
    "d_rate_and_volume_distance": _rate_and_volume("distance_group", places=True),
    "d_airline_rate": lambda t: R.airline_rate(t.complete(), t.s),
    "d_airline_volume": lambda t: R.airline_volume(t.complete(), t.s),
    "d_airline_year": lambda t: D.airline_by_year(t.complete(), t.s),
    "d_airline_severity_long": lambda t: D.airline_severity_long(t.complete(), t.s),
    "d_airline_severity_long_arr": lambda t: D.airline_severity_long(t.complete(), t.s, "arr"),
    "d_airport_top_rate": lambda t: D.ranked_airports(_airports(t), "delay_rate_pct"),
    "d_airport_top_volume": lambda t: D.ranked_airports(_airports(t), "delayed_flights"),
    "d_route_rate": lambda t: D.ranked_routes(_routes(t), "delay_rate_pct"),
    "d_route_volume": lambda t: D.ranked_routes(_routes(t), "delayed_flights"),
    "d_cause_bar": lambda t: D.cause_bar(t.complete()),
    "d_distance_severity_long": lambda t: D.distance_severity_long(t.complete(places=True)),
    "d_action_filter": lambda t: D.filtered(
        R.airline_year_rate(t.complete(), t.s),
        R.airline_rate(t.complete(), t.s).limit(3),
        "airline_name",
    ),
    "d_reaggregate": lambda t: D.regrouped(R.airline_year_rate(t.complete(), t.s), "airline_name"),
    "join_pair_rank": lambda t: D.rate_beside_volume(R.airline_rate(t.complete(), t.s), "airline_name"),
    "topk_tableau_airport_rate": lambda t: D.ranked_airports(_airports(t), "delay_rate_pct"),
    "topk_tableau_airport_volume": lambda t: D.ranked_airports(_airports(t), "delayed_flights"),
    "topk_bottom": lambda t: D.ranked_airports(_airports(t), "delay_rate_pct", highest=False),
    "topk_bottom_routes": lambda t: D.ranked_routes(_routes(t), "delay_rate_pct", 10, highest=False),
    "f_under15": lambda t: R.kpi_overview(t.complete(places=True)).select(
        D.under_15().alias("under_15_minutes_late")
    ),
    "f_coverage_label": lambda t: D.airline_by_year(t.complete(), t.s).groupBy("coverage").agg(
        F.sum("total_operated_flights").alias("n_flights")
    ),
    "flt_having_min_volume": lambda t: R.rate_by(
        t.complete(places=True).withColumn("state_pair", X.route("origin_state_abr", "dest_state_abr")),
        "airline_name", "state_pair",
    ).where(F.col("total_operated_flights") >= t.s.route_min_flights),
}

QUERIES = {**REPORTS, **HISTORY, **EXPLORE, **DASHBOARDS}
