"""Monthly files cleaned as they arrive, with the batch cleaning chain.

Exact copies are removed across batches: each batch notes two hashes of its raw rows
beside their flight date, and rows that an earlier batch has noted are left out, so the
result does not depend on how files fall into batches. Each micro-batch overwrites its
own folders: a replayed batch after a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from punctual.operators.cleaning import clean, keep_columns, require_columns
from punctual.operators.copies import distinct_rows
from punctual.plans.series import daily_rate
from punctual.session import cut_lineage
from punctual.sources.month_layouts import read_layouts
from punctual.sources.schema import FLIGHT_COLUMNS, REQUIRED_COLUMNS


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 12) -> DataFrame:
    """A row per file as files arrive; their contents are not read here."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .options(recursiveFileLookup=True, pathGlobFilter="*.csv", maxFilesPerTrigger=files_per_batch)
        .load(folder)
        .select("path")
    )


def clean_arrivals(arrivals: DataFrame, table: str, progress: str, columns=FLIGHT_COLUMNS, required=REQUIRED_COLUMNS) -> StreamingQuery:
    """Process everything that has arrived, each file by its header, then stop; run again for the next month."""
    spark, seen = arrivals.sparkSession, f"{table}.seen"
    noted = "day string, h1 bigint, h2 bigint"
    # an empty first folder: later batches read what is noted without asking whether there is any
    spark.createDataFrame([], noted).write.mode("overwrite").parquet(f"{seen}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # as many as a batch may have
        if not paths:
            return
        rows = distinct_rows(keep_columns(require_columns(read_layouts(spark, paths, columns, required))))
        marked = rows.withColumns({
            "day": F.col("fl_date").cast("string"),
            "h1": F.xxhash64(*rows.columns), "h2": F.xxhash64(F.lit(1), *reversed(rows.columns)),
        })
        earlier = spark.read.schema(f"{noted}, batch bigint").parquet(seen).where(F.col("batch") < number)
        same = marked["day"].eqNullSafe(earlier["day"]) & (marked["h1"] == earlier["h1"]) & (marked["h2"] == earlier["h2"])
        new = cut_lineage(marked.join(earlier, same, "left_anti"))
        new.select("day", "h1", "h2").write.mode("overwrite").parquet(f"{seen}/batch={number}")
        clean(new.drop("day", "h1", "h2")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def current_daily_rate(spark: SparkSession, table: str, by: str | None = None) -> DataFrame:
    """Daily delay rate over all batches written so far."""
    return daily_rate(spark.read.parquet(table), by)
