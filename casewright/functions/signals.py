"""Keys that link evidence items, extracted from text with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns, types and endings of the evidence model.
PID_PATTERN = r"(?i)\bpid[:\s#]*(\d+)\b"
PID_IN_ID_PATTERN = r"(?i)\b(?:proc|cmdline|net|malfind)_(\d+)\b"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
WINDOWS_PATH_PATTERN = r"""(?:[A-Za-z]:\\[^|<>"\r\n\t]+|\\\\[^|<>"\r\n\t]+)"""
UNIX_PATH_PATTERN = r"""/[^\s"'<>|]+"""
BYTES_PATTERN = r"(?i)(\d[\d,]*)\s+bytes"
DESTINATION_PATTERN = r"((?:\d{1,3}\.){3}\d{1,3})(?::(\d+))?\s*(?:\(|$)"
HOST_PATTERN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}\b"
DOMAIN_BEARING_TYPES = ["dns_query", "http_request", "suspicious_domain"]
FILE_LIKE_ENDINGS = [
    "exe", "dll", "sys", "bin", "dat", "tmp", "pf", "res", "pky", "bmp", "png", "jpg", "jpeg", "gif", "ico",
    "txt", "log", "ini", "json", "js", "doc", "docx", "xls", "pdf", "zip", "rar", "wnry", "wncry", "wcry",
]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is made once however often it is used: it is the one element of an array that a lambda reads."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _where_named(text: Column, word: str, found: Column) -> Column:
    """found where the text holds the word in any case, else an empty array; spares most texts a pattern that needs the word."""
    return F.when(F.contains(F.lower(text), F.lit(word)), found).otherwise(F.array().cast("array<string>"))


def _sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def parse_timestamp(text: Column) -> Column:
    """Epoch seconds, ISO 8601 (Z or offset; none means UTC) or one of the listed layouts; null for others."""
    t = F.trim(text)
    epoch = F.timestamp_micros((t.try_cast("decimal(20,6)") * 1_000_000).try_cast("long"))
    month_first = F.regexp_replace(t, r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})$", "$4 $1 $2 $3")
    forms = [F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("MM/dd/yyyy HH:mm:ss")), F.try_to_timestamp(month_first, F.lit("yyyy MMM d HH:mm:ss"))]
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), epoch).when(F.length(t) > 0, F.coalesce(*forms))


def timestamp_bucket(text: Column) -> Column:
    """The minute of a parsed time as ISO text, else the text with its white space collapsed."""
    minute = F.date_format(F.date_trunc("minute", parse_timestamp(text)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.coalesce(minute, collapse(text))


def collapse(text: Column) -> Column:
    """ASCII white space runs become one space; the ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def pids(text: Column, artifact_id: Column) -> Column:
    """Process ids in a text or an artifact id, sorted as text."""
    return _sorted_set(F.concat(_where_named(text, "pid", _all(text, PID_PATTERN, 1)), _where_named(artifact_id, "_", _all(artifact_id, PID_IN_ID_PATTERN, 1))))


def ips(text: Column) -> Column:
    """Dotted quads, sorted."""
    return _sorted_set(_all(text, IP_PATTERN))


def normalize_path(path: Column) -> Column:
    slashed = F.translate(F.regexp_replace(F.trim(path), r"[.,;)\]]+$", ""), "/", "\\")
    return F.regexp_replace(slashed, r"\\{2,}", r"\\")


def paths(text: Column) -> Column:
    """Windows paths, then Unix ones, normalised, the first of each that differs in more than case."""
    found = F.transform(F.concat(_all(text, WINDOWS_PATH_PATTERN), _all(text, UNIX_PATH_PATTERN)), normalize_path)
    first = lambda f: _once(F.struct(f.alias("f"), F.transform(f, F.lower).alias("low")), lambda s: F.filter(s["f"], lambda p, i: F.array_position(s["low"], F.lower(p)) == i + 1))
    return _once(found, lambda f: F.when(F.size(f) > 1, first(f)).otherwise(f))


def file_keys(found: Column) -> Column:
    """Each path and its last part, lower-cased and sorted."""
    names = lambda low: F.transform(low, lambda p: F.substring_index(p, "\\", -1))
    return _once(F.transform(found, F.lower), lambda low: _sorted_set(F.concat(low, F.filter(names(low), lambda n: n != ""))))


def hosts(text: Column) -> Column:
    """Host names, lower-cased, without www. and edge dots; names that end like files are left out."""
    cleaned = F.transform(_all(text, HOST_PATTERN), lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))
    good = lambda h: F.contains(h, F.lit(".")) & ~F.element_at(F.split(h, r"\."), -1).isin(FILE_LIKE_ENDINGS)
    return F.array_distinct(F.filter(cleaned, good))


def byte_count(text: Column) -> Column:
    """The first number before the word bytes, else 0."""
    digits = F.when(F.contains(F.lower(text), F.lit("bytes")), F.replace(F.regexp_extract(text, BYTES_PATTERN, 1), F.lit(","), F.lit("")))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def destination(text: Column) -> tuple[Column, Column]:
    """Address and port of the first address at an end or a bracket; else the last address, port 0."""
    address = F.regexp_extract(text, DESTINATION_PATTERN, 1)
    port = F.regexp_extract(text, DESTINATION_PATTERN, 2).try_cast("int")
    last = F.coalesce(F.try_element_at(ips(text), F.lit(-1)), F.lit(""))
    return F.coalesce(F.nullif(address, F.lit("")), last), F.coalesce(port, F.lit(0))


def with_signals(items: DataFrame) -> DataFrame:
    """G01 to G10 as columns; expects normalized_value. process_tree rows get no pids, ips and paths."""
    value = F.col("normalized_value")
    none = F.array().cast("array<string>")
    is_tree = F.col("evidence_type") == "process_tree"
    unless_tree = lambda c: F.when(is_tree, none).otherwise(c)
    address, port = destination(value)
    return (
        items.withColumn("ts", parse_timestamp(F.col("timestamp")))
        .withColumn("ts_bucket", timestamp_bucket(F.col("timestamp")))
        .withColumn("pids", unless_tree(pids(value, F.coalesce("artifact_id", F.lit("")))))
        .withColumn("ips", unless_tree(ips(value)))
        .withColumn("paths", unless_tree(paths(value)))
        .withColumn("file_keys", file_keys(F.col("paths")))
        .withColumn("domains", F.when(F.col("evidence_type").isin(DOMAIN_BEARING_TYPES), hosts(value)).otherwise(none))
        .withColumn("bytes_transferred", byte_count(value))
        .withColumn("destination_ip", address)
        .withColumn("destination_port", port)
    )
