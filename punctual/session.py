"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "punctual", shuffle: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch one only where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="punctual-"))
    return context.getCheckpointDir()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder per run below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, **options: str | int) -> DataFrame:
    """Write the rows once to shared storage, with the writer's ``options``, and go on from there.

    A written table computes the plan once (a checkpoint would compute it for the
    count and again for the write), survives lost executors and is read back with
    only the columns a later step needs.
    """
    path = run_folder(df.sparkSession, "cut")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
