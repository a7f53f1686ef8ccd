"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of one partition of a table that many passes read.
SPREAD_ROWS, SPREAD_LEAST = 250_000, 8


def build_session(app: str = "tabulon", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on: UTC, ANSI, AQE.

    On a cluster ``master`` stays unset, so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master is None:
        # a cluster: many small reduce tasks, merged where they turn out too small
        settings |= {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m"}
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``, or the checkpoint folder set in the context. A machine-local folder is used only
    in local mode, where driver and executors are one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        run = spark.sparkContext.applicationId
        stamp = spark.sql("SELECT uuid()").first()[0]
        return f"{shared.rstrip('/')}/{run}/{label}-{stamp}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"tabulon-{label}-")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Partitions and row order for a table that iterative jobs read: by hash of the
    key, as many as the number of rows asks for, sorted inside.

    Sampling inside such jobs follows partitions; these depend on the data alone,
    never on the number of cores, and so do the models.
    """
    parts = max(SPREAD_LEAST, -(-rows // SPREAD_ROWS))
    return df.repartition(parts, "`" + key + "`").sortWithinPartitions("`" + key + "`")


def use_checkpoints(spark: SparkSession) -> None:
    """Make sure that a shared checkpoint folder is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoint"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder as Parquet and read on from there, so that
    later passes do not repeat its shuffles. Types that Parquet has not go to the
    checkpoint folder as rows, which take several times the bytes."""
    spark = df.sparkSession
    if any(word in df.schema.simpleString() for word in ("void", "interval", "variant")):
        use_checkpoints(spark)
        return df.checkpoint()
    path = scratch_dir(spark, "checkpoint")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
