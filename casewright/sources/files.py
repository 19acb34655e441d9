"""Readers of evidence files (S01, S05 to S18, S22); schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.schema import CASE_CONTEXT, CATALOG, ONTOLOGY, RAW_FILE, RAW_ITEM


def raw_outputs(spark: SparkSession, folder: str, on_duplicate_tool: str = "union") -> DataFrame:
    """The items of every *_output.json with file, tool and seq (file name, then position).

    Unreadable files and empty lists give no rows. on_duplicate_tool="replace"
    keeps only the last file of each tool.
    """
    read = spark.read.schema(RAW_FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*_output.json").json(folder)
    files = read.select(F.col("_metadata.file_name").alias("file"), "tool", "items").where(F.size("items") > 0)
    if on_duplicate_tool == "replace":
        w = Window.partitionBy("tool").orderBy(F.desc("file"))
        files = files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    rows = files.select("file", "tool", F.posexplode("items").alias("position", "i")).select("file", "tool", "position", "i.*")
    order = files.select("file").distinct().withColumn("file_no", F.rank().over(Window.orderBy("file")))  # one row for each file
    return rows.join(F.broadcast(order), "file").withColumn("seq", F.col("file_no") * F.lit(1 << 32) + F.col("position")).drop("file_no", "position")


def flexible_evidence(texts: DataFrame, text: str = "text") -> DataFrame:
    """Items from JSON documents that are a bare list or hold evidence_items or items."""
    as_list = F.from_json(text, f"array<{RAW_ITEM.simpleString()}>")
    inner = F.coalesce(F.get_json_object(text, "$.evidence_items"), F.get_json_object(text, "$.items"))
    inside = F.from_json(inner, f"array<{RAW_ITEM.simpleString()}>")
    is_list = F.ltrim(F.col(text)).startswith("[")
    return texts.select(F.posexplode(F.when(is_list, as_list).otherwise(inside)).alias("seq", "i")).select("seq", "i.*")


def packet_fields(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated src, dst, dport, length, epoch; short rows are dropped."""
    rows = spark.read.schema("src string, dst string, dport int, length bigint, epoch double").option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)
    return rows.where("src is not null and dst is not null and epoch is not null").withColumn("seq", F.monotonically_increasing_id())


def file_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Bar-separated body rows."""
    return spark.read.schema("md5 string, path string, inode string, mode string, uid string, gid string, size string, atime string, mtime string, ctime string, crtime string").option("sep", "|").csv(path)


def file_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A file timeline with a header; rows of fewer than six fields have no path and are dropped."""
    names = ["date", "size", "activity", "mode", "uid", "gid", "meta", "path"]
    return spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(path).where("path is not null")


def event_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A timeline with named columns; datetime, source, description, filename in any order."""
    read = spark.read.option("header", True).csv(path)
    return read.select(*(F.col(c) if c in read.columns else F.lit(None).cast("string").alias(c) for c in ("datetime", "source", "description", "filename")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with file and line_no (its order within the file)."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("line_no"))
    return read


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def case_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Case contexts, one JSON document each."""
    return spark.read.schema(CASE_CONTEXT).option("multiLine", True).json(path)


def catalog(spark: SparkSession, path: str) -> dict:
    """An indicator catalog as a dict (a few hundred entries); a missing or broken file disables the rules."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(CATALOG).option("multiLine", True).json(path).limit(1).collect()
    except AnalysisException:
        return {}
    return rows[0].asDict(recursive=True) if rows else {}


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """The analyser ontology, a list of tools or an object that holds one."""
    from pyspark.sql import types as T

    schema = T.StructType([*ONTOLOGY.fields, T.StructField("tools", T.ArrayType(ONTOLOGY))])
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    own = read.where("name is not null").drop("tools")
    return own.unionByName(read.where("tools is not null").select(F.explode("tools").alias("t")).select("t.*"))


def bulk_manifest(spark: SparkSession, path: str) -> DataFrame:
    """machine_name, raw_outputs_dir and case_context for each machine of a list, an object with machines, or a map.

    A row without a folder is an error when it is read.
    """
    machine = "struct<machine_name: string, machine_id: string, raw_outputs_dir: string, case_context: " + CASE_CONTEXT.simpleString() + ">"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    listed = F.coalesce(F.when(F.col("t").startswith("["), F.from_json("t", f"array<{machine}>")), F.from_json(F.get_json_object("t", "$.machines"), f"array<{machine}>"))
    rows = text.select("t", F.lit(None).cast("string").alias("key"), F.posexplode(listed).alias("no", "m"))
    named = text.where(listed.isNull()).select("t", F.explode(F.from_json("t", f"map<string, {machine}>")).alias("key", "m")).select("t", "key", F.lit(0).alias("no"), "m")
    every = rows.unionByName(named)
    name = F.coalesce("m.machine_name", "key", "m.machine_id", F.concat(F.lit("machine_"), (F.col("no") + 1).cast("string")))
    folder = F.when(F.col("m.raw_outputs_dir").isNull(), F.raise_error(F.lit("a machine has no raw_outputs_dir"))).otherwise(F.col("m.raw_outputs_dir"))
    return every.select(name.alias("machine_name"), folder.alias("raw_outputs_dir"), "m.case_context")


# What the names of evidence files say about them, the first that fits.
ROUTES = [
    ("memory_dump", r"\.(mem|vmem|dmp|raw|lime)$|memdump|memory"),
    ("pcap", r"\.(pcap|pcapng|cap)$"),
    ("disk_image", r"\.(dd|img|e01|iso|vmdk)$"),
    ("registry_hive", r"ntuser\.dat$|\.(hiv|hive)$|(^|/)(system|software|sam|security)$"),
    ("email", r"\.(eml|msg|pst|mbox)$"),
    ("browser", r"history|\.sqlite$|places"),
    ("log_files", r"\.(log|evtx|evt|plaso)$|syslog"),
]
ARTIFACT_NAMES = {"email": "email_archive", "browser": "browser_history"}


def route_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """The files of each evidence kind, by ending or name; files of no kind are left out."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(ROUTES):
        kind = F.when(F.lower(path).rlike(pattern), name).otherwise(kind)
    return paths.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.array_sort(F.collect_list(path)).alias("files"))


def provided_types(routed: DataFrame) -> DataFrame:
    """One row with the artifact types that the routed files provide, sorted."""
    name = F.col("kind")
    for key, value in ARTIFACT_NAMES.items():
        name = F.when(F.col("kind") == key, value).otherwise(name)
    return routed.agg(F.array_sort(F.collect_set(name)).alias("provided_types"))


def tool_sources(routed: DataFrame, tools: DataFrame) -> DataFrame:
    """For each tool (source_tool, evidence) the names of its files, comma-joined."""
    names = F.transform("files", lambda f: F.element_at(F.split(f, "/"), -1))
    return tools.join(routed.select(F.col("kind").alias("evidence"), F.array_join(names, ", ").alias("files")), "evidence")
