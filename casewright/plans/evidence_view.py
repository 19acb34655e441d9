"""The evidence view: one evidence item for each row of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from pyspark.sql import functions as F

from casewright.functions.signals import collapse

#: In the SQL that Spark and other engines share; {ts} stands for the time as ISO text.
VIEW_SQL = """
WITH base AS (
    SELECT *, cast(round(value * 100) AS bigint) AS cents, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events),
named AS (
    SELECT *, 1000 + user_id AS pid, 1000 + user_id % 7 AS ppid,
        CASE k % 6 WHEN 0 THEN 'svchost.exe' WHEN 1 THEN 'powershell.exe' WHEN 2 THEN 'cmd.exe' WHEN 3 THEN 'explorer.exe' WHEN 4 THEN 'tasksche.exe' ELSE 'chrome.exe' END AS pname,
        CASE k % 5 WHEN 0 THEN 443 WHEN 1 THEN 4444 WHEN 2 THEN 8080 WHEN 3 THEN 53 ELSE 31337 END AS port
    FROM base)
SELECT 'case-1' AS case_id, concat('host-', user_id % 10) AS machine_id, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN concat('conn_', event_id) WHEN 'view' THEN concat('dns_', event_id)
        WHEN 'click' THEN concat('file_', user_id, '_', k) WHEN 'signup' THEN concat('proc_', pid, '_', replace(pname, '.', '_'))
        ELSE concat('malfind_', pid) END AS artifact_id,
    CASE event_type WHEN 'purchase' THEN 'tshark' WHEN 'view' THEN 'tshark' WHEN 'click' THEN 'tsk_fls' ELSE 'volatility3' END AS source_tool,
    CASE event_type WHEN 'purchase' THEN 'network_connection' WHEN 'view' THEN 'dns_query' WHEN 'click' THEN 'file_artifact'
        WHEN 'signup' THEN 'process' ELSE 'injected_code' END AS evidence_type,
    {ts} AS timestamp,
    CASE event_type
        WHEN 'purchase' THEN concat('TCP 10.0.0.', user_id % 50, ' -> 198.51.100.', k % 50, ':', port, ' (', cents * 100, ' bytes, ', k + 1, ' packets) (PID:', pid, ')')
        WHEN 'view' THEN concat('DNS query from 10.0.0.', user_id % 50, ' -> ', CASE WHEN k % 2 = 0 THEN 'www.' ELSE '' END, 'node', k % 20, '.example.net')
        WHEN 'click' THEN concat('Suspicious file: C:/Users/u', user_id, '/AppData/Temp/f', k, '.exe')
        WHEN 'signup' THEN concat(pname, ' (PID:', pid, ' PPID:', ppid, ')')
        ELSE concat('Injected memory regions detected in ', pname, ' (PID:', pid, ')') END AS value,
    CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
    cast((50 + k % 50) / 100.0 AS double) AS confidence,
    CASE WHEN event_type NOT IN ('purchase', 'view', 'click', 'signup') THEN concat('proc_', pid) END AS link
FROM named
"""
SPARK_TIME = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence items of the events table, with their links as an array and the normalised value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    rows = spark.sql(VIEW_SQL.replace("FROM events", "FROM {events}").replace("{ts}", SPARK_TIME), events=events)
    links = F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("linked_artifacts", links).drop("link").withColumn("normalized_value", collapse(F.col("value")))
