"""Model features, prepared from the training split only and applied to every split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.weights import compact
from punctual.session import cut_lineage

# fixed values: predictors known before departure
NUMERIC = (
    "year", "month", "day_of_month", "day_of_week", "dep_hour", "is_peak_hour", "is_weekend", "distance",
)
CATEGORICAL = ("op_unique_carrier", "origin_state_abr", "dest_state_abr", "route")
TARGET = "is_delayed"
RARE = "__infrequent__"
HOT = "__hot"


def select(flights: DataFrame, *more: str) -> DataFrame:
    """Date, target and the predictors; nothing recorded after scheduling."""
    return flights.select("fl_date", TARGET, *NUMERIC, *CATEGORICAL, *more)


def labelled(flights: DataFrame) -> DataFrame:
    return flights.na.drop(subset=[TARGET])


def base_rate(flights: DataFrame) -> DataFrame:
    return flights.agg(F.count(F.lit(1)).alias("n_rows"), (F.avg(TARGET) * 100).alias("base_rate_pct"))


def numeric_stats(train: DataFrame, columns=NUMERIC) -> DataFrame:
    """Median, then mean and population deviation after filling with it, per column.

    Works on counted values: calendar parts, hours and miles take few of them.
    """
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    counted = compact(long, "column_name", "value")
    n = F.col("flights")
    medians = counted.groupBy("column_name").agg(F.percentile("value", F.lit(0.5), n).alias("median"))
    whole = counted.join(medians, "column_name").withColumn("x", F.coalesce("value", "median"))
    means = whole.groupBy("column_name", "median").agg((F.sum(F.col("x") * n) / F.sum(n)).alias("mean"))
    spread = whole.join(means.select("column_name", "mean"), "column_name").groupBy("column_name").agg(
        F.sqrt(F.sum(n * F.pow(F.col("x") - F.col("mean"), 2)) / F.sum(n)).alias("std")
    )
    return means.join(spread, "column_name")


def standardized(df: DataFrame, stats: DataFrame, columns=NUMERIC) -> DataFrame:
    """Fill with the median, centre and scale. ``stats`` has one row per column."""
    rows = {r.column_name: r for r in stats.collect()}
    scaled = {}
    for c in columns:
        s = rows[c]
        value = F.coalesce(F.col(c).cast("double"), F.lit(s.median))
        # a constant column stays at zero
        scaled[c] = (value - F.lit(s.mean)) / F.lit(s.std or 1.0)
    return df.withColumns(scaled)


def category_counts(train: DataFrame, columns=CATEGORICAL) -> DataFrame:
    long = train.select(*columns).unpivot([], list(columns), "column_name", "value")
    return compact(long, "column_name", "value")


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, the smaller one on a tie."""
    best = Window.partitionBy("column_name").orderBy(F.desc("flights"), "value")
    return (
        counts.where("value IS NOT NULL")
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("column_name", F.col("value").alias("mode"))
    )


def vocabulary(counts: DataFrame, mode: DataFrame) -> DataFrame:
    """Training values with their counts, missing ones counted as the mode."""
    filled = counts.join(mode, "column_name").withColumn("value", F.coalesce("value", "mode"))
    return filled.groupBy("column_name", "value").agg(F.sum("flights").alias("flights"))


def pooled(rare_rows: int) -> Column:
    """The bucket of a vocabulary row."""
    return F.when(F.col("flights") >= rare_rows, F.col("value")).otherwise(RARE)


def bucketed(df: DataFrame, mode: DataFrame, words: DataFrame, rare_rows: int, columns=CATEGORICAL) -> DataFrame:
    """Fill categories with the mode, pool rare training values, leave unseen ones null."""
    fill = {r.column_name: r.mode for r in mode.collect()}
    for c in columns:
        known = words.where(F.col("column_name") == c).select(
            F.col("value").alias(c), pooled(rare_rows).alias("bucket")
        )
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(fill.get(c))))
        df = df.join(known, c, "left").withColumn(c, F.col("bucket")).drop("bucket")
    return df


@dataclass
class Preparation:
    """What the training split taught: statistics, vocabulary and the encoding stages."""

    stats: DataFrame
    mode: DataFrame
    words: DataFrame
    rare_rows: int
    encoder: PipelineModel | None = None

    def labels(self) -> list[list[str]]:
        """Buckets of each category, frequent ones first, as a string indexer orders them; from the vocabulary alone."""
        counted = self.words.where("value IS NOT NULL").groupBy("column_name", pooled(self.rare_rows).alias("bucket")).agg(
            F.sum("flights").alias("flights")
        )
        rows = sorted(counted.collect(), key=lambda r: (-r.flights, r.bucket.encode("utf-16-be")))
        return [[r.bucket for r in rows if r.column_name == c] for c in CATEGORICAL]

    def flat(self, df: DataFrame) -> DataFrame:
        return bucketed(standardized(df, self.stats), self.mode, self.words, self.rare_rows)

    def vectors(self, df: DataFrame) -> DataFrame:
        encoded = self.encoder.transform(self.flat(df))
        return encoded.select("fl_date", F.col(TARGET).cast("double").alias("label"), "features")


def fit(train: DataFrame, rare_rows: int) -> Preparation:
    # statistics, modes and vocabulary are small tables that every later use reads instead of the flights
    counts = cut_lineage(category_counts(train))
    mode = cut_lineage(modes(counts))
    ready = Preparation(cut_lineage(numeric_stats(train)), mode, cut_lineage(vocabulary(counts, mode)), rare_rows)
    indexed = [f"{c}__ix" for c in CATEGORICAL]
    hot = [f"{c}{HOT}" for c in CATEGORICAL]
    # an unseen category becomes the extra last index, which the encoder drops: all zeros
    indexers = [
        StringIndexerModel.from_labels(labels, c, to, "keep") for labels, c, to in zip(ready.labels(), CATEGORICAL, indexed, strict=True)
    ]
    # sizes come from the indexer's metadata, no row is read
    encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True).fit(PipelineModel(indexers).transform(ready.flat(train)))
    assembler = VectorAssembler(inputCols=list(NUMERIC) + hot, outputCol="features")
    ready.encoder = PipelineModel([*indexers, encoder, assembler])
    return ready


def feature_names(vectors: DataFrame) -> DataFrame:
    """Slot and readable name of every assembled feature, from the column's metadata."""
    groups = vectors.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted(((a["idx"], a["name"].replace(HOT, "")) for group in groups.values() for a in group))
    return vectors.sparkSession.createDataFrame(slots, "slot int, name string")


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a ``weight`` that gives both classes the same total."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.select(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))).scalar()
    weights = counts.select(label, (totals.getField("n") / (totals.getField("classes") * F.col("n"))).alias("weight"))
    return train.join(F.broadcast(weights), label)  # one row per class
