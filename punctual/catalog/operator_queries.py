"""Source, quality, cleaning, feature, filter, join, aggregate and ordering queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.functions import labels as L
from punctual.functions.ratios import rate_pct
from punctual.functions.tally import tally
from punctual.functions.weights import compact, mean2_of, percentile2_of
from punctual.operators import cleaning as C
from punctual.operators import lookups as J
from punctual.operators import quality as Q
from punctual.operators import sampling as S
from punctual.operators import sinks as K
from punctual.operators.copies import distinct_rows
from punctual.plans import dashboards as D
from punctual.plans import explore as E
from punctual.plans import history as H
from punctual.plans import reports as R
from punctual.session import cut_lineage, run_folder
from punctual.sources import carriers, month_layouts, monthly_files
from punctual.sources.schema import CAUSES, FLIGHT_COLUMNS, TEXT_FILLS, ZERO_FLAGS


def with_copies(t) -> DataFrame:
    """Scheduled flights plus a second copy of those without a tail number.

    Copies are found in several passes, so the joined flights are written once.
    """
    flights = cut_lineage(t.scheduled(places=True).drop("airline_name"))
    return flights.unionByName(flights.where("tail_num IS NULL"))


def as_text(t) -> DataFrame:
    """Scheduled flights as raw text, with a second date format and unparsable values."""
    flights = t.scheduled()
    text = flights.select(*[F.col(c).cast("string").alias(c) for c in flights.columns if c in FLIGHT_COLUMNS])
    day = F.col("day_of_month")
    return text.withColumns(
        {
            "fl_date": F.when(day == 13, F.date_format(F.col("fl_date").cast("date"), "M/d/yyyy h:mm:ss a"))
            .when(day == 29, "not a date")
            .otherwise(F.col("fl_date")),
            "dep_delay": F.when(F.col("crs_dep_time") % 100 == 17, "bad").otherwise(F.col("dep_delay")),
        }
    )


def loud_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[f" {c.upper().replace('_', '-')} " for c in df.columns])


#: The test tables have no departure time.
MONTH_COLUMNS = [c for c in FLIGHT_COLUMNS if c != "dep_time"]


def month_folder(t) -> str:
    """Month files in three layouts: as written, reordered with a column more, and with another name of the date."""
    folder = run_folder(t.spark, "months")
    flights = t.scheduled(places=True).drop("airline_name")
    monthly_files.write_months(flights.where("year < 1997"), f"{folder}/plain")
    turned = flights.where("year BETWEEN 1997 AND 1998").withColumn("extra", F.lit("x"))
    monthly_files.write_months(turned.select(*reversed(turned.columns)), f"{folder}/turned")
    named = flights.where("year > 1998").withColumnRenamed("fl_date", "FlightDate")
    monthly_files.write_months(named, f"{folder}/named", upper=False)
    return folder


def month_files(t) -> DataFrame:
    return monthly_files.read_months(t.spark, month_folder(t), MONTH_COLUMNS)


def file_manifest(t) -> DataFrame:
    """Written files against the expected months: 1996 stands twice, 1997 is missing, 1999-06 is empty."""
    folder = run_folder(t.spark, "manifest")
    narrow = t.scheduled().select("year", "month", "fl_date", "op_unique_carrier")
    monthly_files.write_months(narrow.where("year <> 1997 AND NOT (year = 1999 AND month = 6)"), f"{folder}/all")
    monthly_files.write_months(narrow.where("year = 1996"), f"{folder}/again")
    t.spark.range(0).selectExpr("'' AS value").coalesce(1).write.text(f"{folder}/file_month=1999-06")
    months = month_layouts.expected_months(t.s.expected_first_month, t.s.expected_last_month, t.s.skipped_years)
    return month_layouts.manifest(t.spark, folder, months, suffix="").select("file_month", "n_places", "status")


def joined_months(t) -> DataFrame:
    """Two months in files with different columns, put together by name, with the month each row's file is of."""
    folder = run_folder(t.spark, "two")
    flights = t.scheduled(places=True)
    first = flights.where("year = 1996 AND month = 2").select("year", "month", "fl_date", "op_unique_carrier", "tail_num", "dep_delay")
    second = flights.where("year = 1996 AND month = 3").select("origin", "dep_delay", F.col("fl_date").alias("FlightDate"), "month", "year", "op_unique_carrier")
    monthly_files.write_months(first, f"{folder}/first")
    monthly_files.write_months(second, f"{folder}/second", upper=False)
    rows = monthly_files.read_months(t.spark, folder, MONTH_COLUMNS, ("fl_date", "op_unique_carrier", "dep_delay"))
    return rows.groupBy(monthly_files.file_month().alias("file_month"), "op_unique_carrier").agg(
        F.count(F.lit(1)).alias("n_flights"), F.count("fl_date").alias("n_dates"), F.count("tail_num").alias("n_tails"),
        F.count("origin").alias("n_origins"), F.sum(C.as_number("dep_delay")).alias("sum_dep_delay"),
    )


def csv_round_trip(t) -> DataFrame:
    columns = ["fl_date", "op_unique_carrier", "dep_delay", "arr_delay", "is_delayed"]
    path = K.replace_csv(t.operated().select(*columns), run_folder(t.spark, "clean"))
    return read_csv(t, path)


def replaced_csv(t) -> DataFrame:
    """What is read after an earlier output was replaced and a later replacement failed on its way."""
    columns = ["fl_date", "op_unique_carrier", "dep_delay", "arr_delay", "is_delayed"]
    path = run_folder(t.spark, "replaced")
    K.replace_csv(t.operated().select(*columns).limit(1), path)
    K.replace_csv(t.operated().select(*columns), path)
    failing = t.operated().select(*columns).where(F.raise_error(F.lit("stopped on purpose")).isNull())
    try:
        K.replace_csv(failing, path)
    except Exception as stopped:  # the write that is meant to fail
        if "stopped on purpose" not in str(stopped):
            raise
    return read_csv(t, path)


def read_csv(t, path: str) -> DataFrame:
    schema = "fl_date date, op_unique_carrier string, dep_delay double, arr_delay double, is_delayed int"
    return t.spark.read.csv(path, header=True, schema=schema)


def csv_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("op_unique_carrier").agg(
        F.count(F.lit(1)).alias("n_flights"),
        F.sum("dep_delay").alias("sum_dep_delay"),
        F.sum("is_delayed").alias("n_delayed"),
        F.min("fl_date").alias("first_date"),
    )


def stored_table(t) -> DataFrame:
    # a name of its own: queries that run at the same time do not disturb each other
    path = run_folder(t.spark, "flights_clean")
    return K.replace_table(t.operated(), path.rsplit("/", 1)[-1].replace("-", "_"), path)


SOURCES = {
    "scan_csv_monthly": lambda t: tally(month_files(t), monthly_files.file_month().alias("file_month")),
    "scan_file_manifest": file_manifest,
    "scan_csv_full": lambda t: csv_totals(csv_round_trip(t)),
    "scan_columns": lambda t: tally(t.operated().select("year", "month", "is_delayed"), "year", "month", "is_delayed"),
    "scan_dates": lambda t: t.operated().select("fl_date").agg(
        F.min("fl_date").alias("first_date"), F.max("fl_date").alias("last_date"), F.count("fl_date").alias("n_dates")
    ),
    "scan_limit": lambda t: S.first_rows(
        t.scheduled().select("fl_date", "op_unique_carrier", "crs_dep_time", "tail_num", "air_time", "arr_delay"),
        1000, "fl_date", "op_unique_carrier", "crs_dep_time", "tail_num", "air_time", "arr_delay",
    ),
    "scan_table": lambda t: tally(stored_table(t), "airline_name", "is_delayed"),
    "sink_csv_atomic": lambda t: csv_totals(replaced_csv(t)),
    "sink_table_replace": lambda t: tally(stored_table(t), "year", "delay_category"),
    "sink_verify_count": lambda t: K.verified(t.operated(), csv_round_trip(t)),
    "sink_report_exports": lambda t: K.export_reports(
        t.complete(places=True), t.scheduled(), t.s, run_folder(t.spark, "exports")
    ),
    "sink_text_summary": lambda t: reduce(
        DataFrame.unionByName,
        [
            K.long_form(Q.clean_summary(with_copies(t), F.col("dep_delay") >= 15).drop("delay_rate_pct"), "cleaning"),
            K.long_form(Q.label_mismatch(t.operated(places=True), t.s), "extremes"),
            K.long_form(R.disruption_kpis(t.scheduled()), "schedule"),
        ],
    ),
}

QUALITY = {
    "dq_required_columns": lambda t: Q.required_columns(t.scheduled(places=True).drop("tail_num")),
    "dq_keep_columns": lambda t: tally(
        C.keep_columns(t.operated(places=True)), "year", "op_unique_carrier", "origin", "cancellation_code"
    ),
    "dq_snake_case": lambda t: Q.value_counts_by_column(C.snake_case(loud_names(t.scheduled(places=True)))),
    "dq_date_column_probe": lambda t: Q.date_column_found(month_files(t)),
    "dq_row_conservation": lambda t: Q.row_conservation(
        month_files(t).withColumn("file_month", monthly_files.file_month()), t.scheduled(), "file_month"
    ),
    "dq_missing_counts": lambda t: Q.missing_counts(t.scheduled(places=True)),
    "dq_missing_counts_after": lambda t: Q.missing_counts(t.operated(places=True), None),
    "dq_duplicate_count": lambda t: Q.duplicate_count(with_copies(t)),
    "dq_iqr_outliers": lambda t: Q.iqr_outliers(t.operated(places=True), t.s),
    "dq_extreme_delay_share": lambda t: Q.extreme_share(t.operated(), t.s),
    "dq_label_mismatch": lambda t: Q.label_mismatch(t.operated(places=True), t.s),
    "dq_missing_arrival": lambda t: Q.missing_arrival(t.scheduled(), t.s),
    "dq_clean_summary": lambda t: Q.clean_summary(with_copies(t), F.col("dep_delay") >= 15),
    "dq_dataset_extent": lambda t: Q.dataset_extent(t.operated(), t.s),
    "dq_nonempty_splits": lambda t: Q.split_sizes(S.time_split(t.operated(), t.s)),
    "dq_export_identities": lambda t: Q.export_identities(t.complete(places=True)),
}

TYPED = {"dep_delay": FLIGHT_COLUMNS["dep_delay"], "fl_date": FLIGHT_COLUMNS["fl_date"]}

FEATURES = {
    "cast_numeric_lenient": lambda t: tally(C.cast_columns(as_text(t), TYPED), "dep_delay"),
    "cast_date_lenient": lambda t: tally(C.cast_columns(as_text(t), TYPED), "fl_date"),
    "fill_flags": lambda t: tally(C.fill_flags(t.scheduled()), *ZERO_FLAGS),
    "fill_minutes": lambda t: tally(C.fill_minutes(t.scheduled()), "dep_delay", "arr_delay", "carrier_delay"),
    "fill_labels": lambda t: tally(C.fill_labels(t.scheduled()), *TEXT_FILLS),
    "f_is_delayed": lambda t: tally(t.scheduled(), X.is_delayed().alias("is_delayed"), X.is_delayed("arr_delay").alias("is_late_arrival")),
    "f_delay_category": lambda t: tally(t.scheduled(), X.delay_category().alias("delay_category")),
    "f_day_of_year": lambda t: tally(t.operated(), "day_of_year"),
    "f_week_of_year": lambda t: tally(t.operated(), "year", "week_of_year"),
    "f_dep_hour": lambda t: tally(t.scheduled(), "crs_dep_time", X.dep_hour().alias("dep_hour")),
    "f_is_peak_hour": lambda t: tally(t.operated(), "dep_hour", "is_peak_hour"),
    "f_is_weekend": lambda t: tally(t.operated(), "day_of_week", "is_weekend"),
    "f_route": lambda t: tally(t.operated(places=True), "route"),
    "f_main_delay_cause": lambda t: tally(t.operated(), "main_delay_cause", "delay_category"),
    "f_airline_name": lambda t: tally(t.operated(), "op_unique_carrier", "airline_name"),
    "f_distance_group": lambda t: tally(
        t.operated(places=True),
        X.distance_group(F.when(F.col("day_of_month") != 31, F.col("distance"))).alias("distance_group"),
    ),
    "f_null_coalesce_causes": lambda t: t.scheduled().agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"sum_{c}") for c in CAUSES]
    ),
    "f_safe_pct": lambda t: t.operated().groupBy("dep_hour").agg(
        F.count_if(F.col("is_weekend") == 9).alias("none"), F.sum("is_delayed").alias("late"), F.count(F.lit(1)).alias("n")
    ).select("dep_hour", rate_pct("late", "n").alias("late_pct"), rate_pct("late", "none").alias("undefined_pct")),
    "f_time_recovered": lambda t: tally(t.operated(), X.time_recovered().alias("time_recovered")),
    "f_clip": lambda t: tally(
        t.scheduled(places=True),
        X.clipped("dep_delay", -10.0, 500.0).alias("dep_clipped"),
        X.clipped("distance", 100.0, 2000.0).alias("distance_clipped"),
    ),
    "f_month_name": lambda t: tally(t.operated(), L.month_name().alias("month_name")),
    "f_quarter_label": lambda t: tally(t.operated(), L.quarter_label().alias("quarter_label")),
    "f_day_name": lambda t: tally(t.operated(), L.day_name().alias("day_name")),
    "f_peak_label": lambda t: tally(t.operated(), L.peak_label().alias("peak_label")),
    "f_weekend_label": lambda t: tally(t.operated(), L.weekend_label().alias("weekend_label")),
    "f_airport_label": lambda t: tally(
        t.operated(places=True), L.airport_label().alias("airport_label"), L.airport_city().alias("airport_city")
    ),
    "f_route_label": lambda t: tally(t.operated(places=True), L.route_label().alias("route_label")),
    "f_cause_label": lambda t: tally(t.operated(), L.cause_label().alias("cause_label")),
    "f_year_month": lambda t: tally(t.operated(), L.year_month().alias("year_month")),
    "f_feature_title": lambda t: tally(
        t.operated().select(
            F.explode(
                F.array(
                    F.concat(F.lit("categorical__op_unique_carrier_"), "op_unique_carrier"),
                    F.concat(F.lit("categorical__main_delay_cause_"), "main_delay_cause"),
                    F.lit("numeric__dep_hour"),
                )
            ).alias("raw_name")
        ),
        "raw_name", L.feature_title("raw_name").alias("feature"),
    ),
}

FILTERS = {
    "flt_operated": lambda t: tally(C.only_operated(t.scheduled()), "year", "cancelled", "diverted"),
    "flt_complete_years": lambda t: tally(t.complete(), "year"),
    "flt_delayed": lambda t: tally(t.operated().where("is_delayed = 1"), "airline_name"),
    "flt_drop_null_date": lambda t: tally(C.drop_undated(C.cast_columns(as_text(t), TYPED)), F.year("fl_date").alias("year")),
    "flt_drop_null_target": lambda t: tally(
        t.scheduled().withColumn("late", X.is_delayed()).na.drop(subset=["late"]), "late"
    ),
    "flt_date_range": lambda t: tally(t.operated(start=t.s.holdout_start, end=t.s.holdout_end), "fl_date"),
    "flt_agg_filter": lambda t: flt_agg_filter(t.complete()),
    "flt_extreme": lambda t: tally(E.extreme_flights(t.operated(places=True), t.s), "op_unique_carrier", "dep_delay"),
    "flt_optional_fence": lambda t: tally(Q.fenced(t.operated(places=True), "dep_delay", t.s), F.lit("drop").alias("how"), "dep_delay")
    .unionByName(tally(Q.fenced(t.operated(places=True), "dep_delay", t.s, "cap"), F.lit("cap").alias("how"), "dep_delay")),
}


def flt_agg_filter(flights: DataFrame) -> DataFrame:
    rows = compact(flights, "airline_name", "is_delayed", "dep_delay")
    late = F.when(F.col("is_delayed") == 1, F.col("dep_delay"))
    return rows.withColumn("late_minutes", late).groupBy("airline_name").agg(
        mean2_of(rows, late).alias("avg_dep_delay_when_delayed"),
        F.round(F.percentile("late_minutes", F.lit(0.5), F.col("flights")), 2).alias("median_dep_delay_when_delayed"),
    )


JOINS = {
    "join_carrier_dim": lambda t: tally(
        J.with_carrier_name(t.operated().drop("airline_name"), carriers.carrier_table(t.spark)), "op_unique_carrier", "airline_name"
    ),
    "join_lateral_argmax": lambda t: tally(
        J.row_argmax(t.scheduled().where("dep_delay >= 15")), "main_delay_cause"
    ),
    "join_spine_hours": lambda t: E.hour_volume(t.complete()),
    "join_spine_labels": lambda t: E.delay_share(t.complete()).select("label", "n_flights"),
}


def _percentiles(flights: DataFrame, minutes: str) -> DataFrame:
    rows = compact(flights, "airline_name", minutes)
    return rows.groupBy("airline_name").agg(
        percentile2_of(rows, minutes, 0.5).alias("median_minutes"), percentile2_of(rows, minutes, 0.9).alias("p90_minutes")
    )


AGGREGATES = {
    "agg_count": lambda t: R.total_rows(t.operated()),
    "agg_sum_flag": lambda t: t.complete().groupBy("airline_name").agg(F.sum("is_delayed").alias("delayed_flights")),
    "agg_mean_rate": lambda t: E.mean_rate(t.complete(), "airline_name"),
    "agg_avg": lambda t: t.complete().groupBy("year").agg(
        F.round(F.avg("dep_delay"), 2).alias("avg_dep_delay"), F.round(F.avg("air_time"), 2).alias("avg_air_time")
    ),
    "agg_percentile_cont": lambda t: _percentiles(t.complete(), "dep_delay"),
    "agg_count_distinct": lambda t: compact(t.complete(places=True), "airline_name", "origin", "route").agg(
        F.countDistinct("airline_name").alias("n_airlines"),
        F.countDistinct("origin").alias("n_origins"),
        F.countDistinct("route").alias("n_routes"),
    ),
    "agg_cond_sum": lambda t: t.scheduled().groupBy("op_unique_carrier").agg(
        F.count_if((F.col("cancelled") == 0) & (F.col("diverted") == 0)).alias("n_operated")
    ),
    "agg_minmax": lambda t: t.operated().agg(
        F.min("fl_date").alias("first_date"), F.max("fl_date").alias("last_date"),
        F.max("dep_delay").alias("max_dep_delay"), F.max("arr_delay").alias("max_arr_delay"),
    ),
    "agg_describe": lambda t: E.describe(t.complete(places=True)),
    "agg_value_counts": lambda t: tally(t.complete(), "is_delayed"),
    "agg_size": lambda t: E.volume(t.complete(), "dep_hour"),
    "agg_pivot_year": lambda t: E.rate_pivot(t.complete(), "airline_name", t.s),
    "agg_histogram_fixed": lambda t: E.delay_histogram(t.operated(), "arr_delay"),
    "agg_histogram_equal": lambda t: E.equal_histogram(t.operated(), "air_time", 50),
    "agg_pct_of_total": lambda t: R.with_share(
        tally(t.complete(), "delay_category"), "n_flights", "pct_of_total"
    ),
    "agg_argmax_group": lambda t: R.airline_rate(t.complete(), t.s).agg(
        F.max_by("airline_name", F.struct("delay_rate_pct", "airline_name")).alias("most_delayed"),
        F.min_by("airline_name", F.struct("delay_rate_pct", "airline_name")).alias("least_delayed"),
    ),
    "agg_mean_multi": lambda t: t.complete().groupBy("quarter").agg(
        *[mean2_of(t.complete(), c).alias(f"avg_{c}") for c in CAUSES]
    ),
    "agg_class_counts": lambda t: class_weights(t.complete()),
}


def class_weights(flights: DataFrame) -> DataFrame:
    """Balanced weights: rows over classes times rows of the class."""
    counts = flights.groupBy("is_delayed").agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.select(F.struct(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("classes"))).scalar()
    return counts.withColumn(
        "class_weight", totals.getField("n") / (totals.getField("classes") * F.col("n_rows"))
    )


def airline_cause_rank(flights: DataFrame) -> DataFrame:
    """The most frequent cause per airline, by row number over the counted pairs."""
    counts = tally(flights.where("is_delayed = 1"), "airline_name", "main_delay_cause")
    best = Window.partitionBy("airline_name").orderBy(F.desc("n_flights"), "main_delay_cause")
    return counts.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


ORDERING = {
    "srt_by_date": lambda t: tally(t.operated(), "fl_date").orderBy("fl_date"),
    "srt_report": lambda t: R.airline_year_rate(t.complete(), t.s),
    "topk_global": lambda t: E.top_departure_delays(t.operated(places=True), t.s),
    "topk_per_group": lambda t: airline_cause_rank(t.complete()),
    "win_total_share": lambda t: R.cause_share(t.complete()),
    "win_rank": lambda t: D.ranked(R.airline_rate(t.complete(), t.s), "delay_rate_pct", "airline_name", "rate_rank"),
    "set_concat_files": joined_months,
    "set_distinct_rows": lambda t: tally(distinct_rows(with_copies(t)), "year", F.isnull("tail_num").alias("no_tail")),
    "smp_fraction": lambda t: sample_sizes(t.operated(), S.fraction(t.operated(), t.s.sample_percent, t.s.sample_seed)),
    "smp_stratified_chunks": lambda t: sample_sizes(
        t.operated(), S.stratified(t.operated(), "year", t.s.sample_percent, t.s.sample_seed)
    ),
    "spl_time": lambda t: tally(S.time_split(t.operated(), t.s), "split", "is_delayed"),
    "spl_sample_rows": lambda t: tally(
        S.sample_rows(
            t.operated(start=t.s.test_start, end=t.s.test_end).select(
                "fl_date", "op_unique_carrier", "crs_dep_time", "tail_num", "air_time", "is_delayed"
            ),
            t.s.explained_rows, t.s.sample_seed,
        ),
        "is_delayed",
    ),
    "r_hour_rate_clipped": lambda t: H.calendar_rate(t.operated(label="arr"), "dep_hour"),
}


def sample_sizes(everything: DataFrame, sample: DataFrame) -> DataFrame:
    return tally(everything, "year").join(
        tally(sample, "year").withColumnRenamed("n_flights", "n_sampled"), "year", "left"
    )


QUERIES = {**SOURCES, **QUALITY, **FEATURES, **FILTERS, **JOINS, **AGGREGATES, **ORDERING}
