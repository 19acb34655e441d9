"""Stream forms of three batch operators, and activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_counts(items: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Items by case and minute; a minute closes once the watermark passes it."""
    return items.withWatermark("ts", late).groupBy("case_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select("case_id", F.col("w.start").alias("minute"), "n")


def first_wins(items: DataFrame, late: str = "1 day") -> DataFrame:
    """The first item of each id of a case within the watermark's reach."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(["case_id", "artifact_id"])


def transfers_after_files(connections: DataFrame, files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Connections and the file events of the 24 hours before them; both sides' state is bounded by the watermarks."""
    c = connections.select("case_id", F.col("artifact_id").alias("conn_id"), F.col("ts").alias("conn_ts")).withWatermark("conn_ts", late).alias("c")
    f = files.select(F.col("case_id").alias("f_case"), F.col("artifact_id").alias("file_id"), F.col("ts").alias("file_ts")).withWatermark("file_ts", late).alias("f")
    bound = F.expr("f_case = case_id AND file_ts <= conn_ts AND file_ts >= conn_ts - INTERVAL 24 HOURS")
    return c.join(f, bound).select("case_id", "conn_id", "file_id", "conn_ts", "file_ts")


def sessions(items: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each machine: spans without a pause longer than the gap."""
    return items.withWatermark("ts", late).groupBy("case_id", "machine_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("case_id", "machine_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
