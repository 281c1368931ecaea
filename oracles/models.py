"""Expected results of the feature preparation and evaluation queries."""

from oracles.base import operated_sql
from oracles.operators import SPLIT

NUMERIC = ("year", "month", "day_of_month", "day_of_week", "dep_hour", "is_peak_hour", "is_weekend", "distance")
CATEGORICAL = ("op_unique_carrier", "origin_state_abr", "dest_state_abr", "route")

HOLEY = f"""holey AS (SELECT * REPLACE (
    CASE WHEN day_of_month <> 31 THEN distance END AS distance,
    CASE WHEN day_of_month <> 30 THEN op_unique_carrier END AS op_unique_carrier), {SPLIT} FROM operated),
fit AS (SELECT * FROM holey WHERE split = 'train')"""

MEDIANS = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in NUMERIC) + " FROM fit)"
STATS = (
    MEDIANS
    + ", st AS (SELECT "
    + ", ".join(
        f"avg(coalesce(CAST({c} AS DOUBLE), med_{c})) AS mu_{c}, stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})) AS sd_{c}" for c in NUMERIC
    )
    + " FROM fit, med)"
)


def z(c: str) -> str:
    return f"(coalesce(CAST({c} AS DOUBLE), med_{c}) - mu_{c}) / sd_{c}"


COUNTS = (
    "cnt AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM fit GROUP BY {c}" for c in CATEGORICAL)
    + """), mode AS (SELECT column_name, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS k
      FROM cnt WHERE value IS NOT NULL) WHERE k = 1),
    words AS (SELECT column_name, coalesce(value, mode) AS value, sum(n) AS n FROM cnt JOIN mode USING (column_name) GROUP BY 1, 2)"""
)

# what the models learn from: all operated flights of a split, prepared by the training split alone
LEARNED = f"holey AS (SELECT *, {SPLIT} FROM operated), fit AS (SELECT * FROM holey WHERE split = 'train')"


def bucket(c: str) -> str:
    """Whether a category has a slot: its value occurs in the training split, alone or pooled with other rare ones."""
    return f"CASE WHEN coalesce({c}, (SELECT mode FROM mode WHERE column_name = '{c}')) IN (SELECT value FROM words WHERE column_name = '{c}') THEN 1 ELSE 0 END"


SLOTS = f"""slots AS (SELECT {len(NUMERIC)} + count(*) AS n_slots FROM (
  SELECT DISTINCT column_name, CASE WHEN n >= 100 THEN value ELSE '__infrequent__' END FROM words))"""

SCORES = """sc AS (SELECT airline_name AS model, (dep_hour*40 + crs_dep_time % 100) / CAST(1100 AS DOUBLE) AS score, is_delayed AS label,
  CASE WHEN (dep_hour*40 + crs_dep_time % 100) / CAST(1100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM complete),
cm AS (SELECT model, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) AS total
  FROM sc GROUP BY 1),
rates AS (SELECT model, CAST(tp + tn AS DOUBLE) / total AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(CAST(2*tp AS DOUBLE) / nullif(2*tp + fp + fn, 0), 0) AS f1 FROM cm),
grp AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY 1, 2),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM grp),
auc AS (SELECT model, CAST(sum(pos*(2*below + neg)) AS DOUBLE) / (CAST(2 AS DOUBLE) * sum(pos) * sum(neg)) AS roc_auc FROM cum GROUP BY 1)"""

SQL = {
    "ml_feature_select": operated_sql("SELECT year, dep_hour, origin_state_abr, is_delayed, count(*) AS n_flights FROM operated GROUP BY ALL"),
    "ml_impute_median": operated_sql(
        "SELECT split, count(*) - count(distance) AS n_filled, round(avg(coalesce(distance, med_distance)), 6) AS mean_distance"
        " FROM holey, med WHERE split IS NOT NULL GROUP BY 1",
        HOLEY, MEDIANS,
    ),
    "ml_standardize": operated_sql(
        "SELECT split, " + ", ".join(f"round(avg({z(c)}), 6) + 0.0 AS mean_{c}, round(stddev_pop({z(c)}), 6) AS std_{c}" for c in NUMERIC)
        + " FROM holey, med, st WHERE split IS NOT NULL GROUP BY 1",
        HOLEY, STATS,
    ),
    "ml_impute_mode": operated_sql("SELECT column_name, mode FROM mode", HOLEY, COUNTS),
    "ml_rare_bucket": operated_sql(
        " UNION ALL ".join(
            f"""SELECT split, '{c}' AS column_name, CASE WHEN n >= 100 THEN value WHEN n < 100 THEN '__infrequent__' END AS bucket, count(*) AS n_flights
            FROM holey LEFT JOIN (SELECT * FROM words WHERE column_name = '{c}') w
              ON w.value = coalesce({c}, (SELECT mode FROM mode WHERE column_name = '{c}'))
            WHERE split IS NOT NULL GROUP BY ALL"""
            for c in CATEGORICAL
        ),
        HOLEY, COUNTS,
    ),
    "ml_onehot_unknown_zero": operated_sql(
        "SELECT CAST(0 AS INTEGER) AS n_set, count(*) AS n_rows FROM holey WHERE split = 'test' HAVING count(*) > 0", LEARNED
    ),
    "ml_assemble_sparse": operated_sql(
        "SELECT split, count(*) AS n_rows, CAST(max(n_slots) AS INTEGER) AS n_slots, CAST(sum("
        + " + ".join([f"CASE WHEN coalesce(CAST({c} AS DOUBLE), med_{c}) <> mu_{c} THEN 1 ELSE 0 END" for c in NUMERIC] + [bucket(c) for c in CATEGORICAL])
        + ") AS DOUBLE) / count(*) AS mean_set FROM holey, med, st, slots WHERE split IS NOT NULL GROUP BY 1",
        LEARNED, STATS, COUNTS, SLOTS,
    ),
    "ml_class_weight": operated_sql(
        "SELECT label, n AS n_rows, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 9) AS class_weight"
        " FROM (SELECT is_delayed AS label, count(*) AS n FROM fit GROUP BY 1)",
        HOLEY,
    ),
    "ml_base_rate": operated_sql(
        "SELECT count(*) AS n_rows, CAST(sum(is_delayed) AS DOUBLE) / count(*) * 100 AS base_rate_pct FROM operated"
    ),
    "ev_confusion": operated_sql("SELECT * FROM cm", SCORES),
    "ev_accuracy": operated_sql("SELECT model, accuracy FROM rates", SCORES),
    "ev_precision": operated_sql("SELECT model, precision FROM rates", SCORES),
    "ev_recall": operated_sql("SELECT model, recall FROM rates", SCORES),
    "ev_f1": operated_sql("SELECT model, f1 FROM rates", SCORES),
    "ev_roc_auc": operated_sql("SELECT * FROM auc", SCORES),
    "ev_roc_auc_overall": operated_sql(
        """SELECT CAST(sum(pos*(2*below + neg)) AS DOUBLE) / (CAST(2 AS DOUBLE) * sum(pos) * sum(neg)) AS roc_auc FROM (
          SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM grp GROUP BY 1))""",
        SCORES,
    ),
    "ev_display_pct": operated_sql(
        """SELECT CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS "Rank", model AS "Model",
        round(roc_auc*100, 1) AS "Validation ROC-AUC %", round(accuracy*100, 1) AS "Validation Accuracy %",
        round(precision*100, 1) AS "Validation Precision %", round(recall*100, 1) AS "Validation Recall %", round(f1*100, 1) AS "Validation F1 %"
        FROM rates JOIN auc USING (model)""",
        SCORES,
    ),
}
