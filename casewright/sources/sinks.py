"""Writers of evidence tables and the custody log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str = "case_id", form: str = "parquet") -> None:
    """Replaces a table, partitioned by case or tool; earlier output goes with the overwrite."""
    df.write.mode("overwrite").partitionBy(partition).format(form).save(path)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and SHA-256 of every file below a folder, computed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def custody_entries(digests: DataFrame, wanted: DataFrame, tool: str, command: str, status: str = "success") -> DataFrame:
    """One entry for a tool run with the digests of the wanted paths; a path without a file says so."""
    rows = wanted.join(digests, "path", "left").select("path", F.coalesce("sha256", F.lit("file_not_found")).alias("sha256"))
    hashes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256"))))
    return rows.agg(hashes.alias("input_hashes")).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(tool).alias("tool"), F.lit(command).alias("command"), F.lit(status).alias("status"), "input_hashes")


def append_custody(entries: DataFrame, path: str) -> None:
    """Appends entries to the custody log."""
    entries.write.mode("append").json(path)
