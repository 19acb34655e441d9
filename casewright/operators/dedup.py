"""De-duplication, reconciliation and ordering of evidence items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.signals import collapse
from casewright.operators.ordering import numbered_within
from casewright.schema import severity_rank

#: Fixed: how a process item names its own process id.
OWN_PID_PATTERN = r"(?i)(?:^|[^P])PID[:\s]+(\d+)"
ID_PID_PATTERN = r"^(?:proc|memprocfs)_(?:pid_)?(\d+)"


def first_wins(items: DataFrame) -> DataFrame:
    """The first row (by seq) of each artifact id in a case; rows without an id all stay."""
    w = Window.partitionBy("case_id", "artifact_id").orderBy("seq")
    has_id = F.col("artifact_id").isNotNull() & (F.col("artifact_id") != "")
    firsts = items.where(has_id).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return firsts.unionByName(items.where(~F.coalesce(has_id, F.lit(False))))


def merge_tools(*tables: DataFrame) -> DataFrame:
    """The rows of all tools in one table; a column that a tool does not have is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def strongest_wins(items: DataFrame) -> DataFrame:
    """Of rows with the same type, value (trimmed, any case) and links the strongest, at the first one's seq.

    An aggregate: a value that repeats in a third of the rows is reduced before the shuffle.
    """
    key = ["case_id", "evidence_type", F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("_value"), F.to_json("linked_artifacts").alias("_links")]
    strength = F.struct(severity_rank(F.col("severity")), F.coalesce("confidence", F.lit(float("-inf"))), -F.col("seq"))
    best = items.groupBy(*key).agg(F.max_by(F.struct(*items.columns), strength).alias("_row"), F.min("seq").alias("_first"))
    return best.select(*(F.col("_first").alias(c) if c == "seq" else F.col(f"_row.{c}") for c in items.columns))


def own_pid(value: Column, artifact_id: Column) -> Column:
    """The process id a process row is about (never the parent's); from the id if the text has none; else null."""
    in_text = F.regexp_extract(value, OWN_PID_PATTERN, 1)
    return F.coalesce(F.nullif(in_text, F.lit("")), F.nullif(F.regexp_extract(artifact_id, ID_PID_PATTERN, 1), F.lit("")))


def reconcile_tools(items: DataFrame, secondary_type: str = "memprocfs_process", primary_tool: str = "volatility3", primary_type: str = "process") -> DataFrame:
    """Drops the second tool's process rows whose process the first tool has; rows without a process id stay."""
    pid = own_pid(F.col("value"), F.col("artifact_id"))
    is_second = F.coalesce(F.col("evidence_type") == secondary_type, F.lit(False))
    known = items.where((F.col("source_tool") == primary_tool) & (F.col("evidence_type") == primary_type)).select("case_id", pid.alias("_pid")).where("_pid is not null").distinct()
    second = items.where(is_second).withColumn("_pid", pid).join(known, ["case_id", "_pid"], "left_anti").drop("_pid")
    return items.where(~is_second).unionByName(second)


def order_keys() -> list[Column]:
    """Severity, catalog match, confidence (0.5 if absent) descending, then tool and seq."""
    matched = F.coalesce(F.size("ioc_match") > 0, F.lit(False))
    return [severity_rank(F.col("severity")).desc(), matched.desc(), F.coalesce("confidence", F.lit(0.5)).desc(), F.col("source_tool").asc_nulls_first(), F.col("seq").asc()]


def placed(items: DataFrame, *groups: str) -> DataFrame:
    """Adds place, the row's number in evidence order within its group; no task sorts a whole group."""
    with_match = items if "ioc_match" in items.columns else items.withColumn("ioc_match", F.array().cast("array<string>"))
    return numbered_within(with_match, list(groups), *order_keys())


def in_order(items: DataFrame) -> DataFrame:
    """Items sorted within the cases by order_keys()."""
    with_match = items if "ioc_match" in items.columns else items.withColumn("ioc_match", F.array().cast("array<string>"))
    return with_match.orderBy("case_id", *order_keys())


def group_index(items: DataFrame) -> DataFrame:
    """Item counts by type, tool and machine in one pass: case_id, kind, key, n; a missing key is unknown."""
    pairs = [F.struct(F.lit(kind).alias("kind"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("key")) for kind, c in (("type", "evidence_type"), ("tool", "source_tool"), ("machine", "machine_id"))]
    return items.select("case_id", F.explode(F.array(*pairs)).alias("p")).groupBy("case_id", "p.kind", "p.key").agg(F.count("*").alias("n"))


def enrich(items: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """raw_value, normalized_value and machine_id (else the case's first affected system, else the case id)."""
    out = items if "machine_id" in items.columns else items.withColumn("machine_id", F.lit(None).cast("string"))
    default = F.col("case_id")
    if contexts is not None:
        first = contexts.select("case_id", F.try_element_at("affected_systems", F.lit(1)).alias("_system"))
        out = out.join(first, "case_id", "left")
        default = F.coalesce(F.nullif(F.col("_system"), F.lit("")), F.col("case_id"))
    out = out.withColumn("raw_value", F.coalesce("value", F.lit(""))).withColumn("normalized_value", collapse(F.col("value")))
    return out.withColumn("machine_id", F.coalesce(F.nullif(F.col("machine_id"), F.lit("")), default, F.lit("unknown"))).drop("_system")


def dedup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, rows removed, the tools and what is left, for each case."""
    counted = before.groupBy("case_id").agg(F.count("*").alias("raw_items"), F.array_sort(F.collect_set("source_tool")).alias("tools"))
    left = after.groupBy("case_id").agg(F.count("*").alias("total_items"))
    return counted.join(left, "case_id", "left").select("case_id", "raw_items", (F.col("raw_items") - F.coalesce("total_items", F.lit(0))).alias("duplicates_removed"), "tools", F.coalesce("total_items", F.lit(0)).alias("total_items"))
