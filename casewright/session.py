"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "casewright", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, checkpoints removed once nothing refers to them; further settings as keyword arguments with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    settings |= {key.replace("_", "."): value for key, value in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that spark.checkpoint.dir names.

    Where none is named, a local master (one machine) gets a folder in its
    warehouse; a cluster gets an error, as no machine's own folder will do.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/casewright-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a reliable, shared copy: computed once, and safe when executors go."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
