"""Report tables: indicators, key findings, coverage, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import percent
from casewright.operators.dedup import order_keys
from casewright.schema import computed_once, severity_name, severity_rank

# Fixed values of the report's rules.
PROGRAM_ENDINGS = r"(?i)\.(exe|dll|bat|ps1|vbs|cmd|scr)$"
CONTEXTS = {"network_connection": "Network connection", "dns_query": "DNS query", "http_request": "HTTP request"}
TYPE_LABELS = {
    "process": "Process", "memprocfs_process": "Process", "process_relation": "Process Relationship", "process_tree": "Process Tree", "injected_code": "Code Injection",
    "malfind": "Code Injection", "network_connection": "Network Connection", "dns_query": "DNS Query", "http_request": "HTTP Request", "file_artifact": "File Artifact",
    "registry_key": "Registry Key", "suspicious_domain": "Suspicious Domain", "suspicious_crypto": "Crypto Wallet", "ioc": "IOC Match",
}
TOOL_EVIDENCE = {"volatility3": "memory_dump", "memprocfs": "memory_dump", "tshark": "pcap", "tsk_fls": "disk_image", "regripper": "registry_hive", "plaso": "log_files", "email": "email", "browser": "browser"}
EVIDENCE_KINDS = ["memory_dump", "pcap", "disk_image", "registry_hive", "log_files", "email", "browser"]
ARROW = r"(?:→|->)\s*"
ANCHORED, SAMPLE_ROWS, FINDING_ROWS = 0.45, 50, 30


def is_internal_ip(ip: Column) -> Column:
    """Malformed, out of range, or not routable outside."""
    o = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b = o[0], o[1]
    bad = (F.size(o) != 4) | F.exists(o, lambda x: x.isNull() | (x > 255) | (x < 0))
    private = a.isin(0, 10, 127, 255) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return F.coalesce(bad | private, F.lit(True))


def _indicator(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("indicator"))


def item_indicators(items: DataFrame) -> Column:
    """The atomic indicators of an item, in a fixed order, as an array of (type, indicator)."""
    value, kind = F.coalesce("value", F.lit("")), F.coalesce("evidence_type", F.lit(""))
    match = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    none = F.array().cast("array<struct<type:string,indicator:string>>")
    domain = F.rtrim(F.regexp_extract(value, rf"(?i){ARROW}([a-z0-9][a-z0-9.\-]*\.[a-z]{{2,}})", 1), F.lit("."))
    url = F.regexp_extract(value, rf"{ARROW}(\S+/\S*)", 1)
    bare = F.rtrim(F.regexp_extract(value, r"(?i)\b([a-z0-9][a-z0-9.\-]*\.[a-z]{2,})\b", 1), F.lit("."))
    wallet = F.coalesce(F.nullif(F.regexp_extract(value, r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 0), F.lit("")), F.substring(F.trim(value), 1, 80))
    one = lambda test, kind_of, what: F.when(test & (what != ""), F.array(F.struct(kind_of.alias("type"), what.alias("indicator")))).otherwise(none)
    ips = F.transform(F.filter(F.regexp_extract_all(value, F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0)), lambda x: ~is_internal_ip(x)), lambda x: _indicator("IP Address", x))
    hexes = F.filter(F.regexp_extract_all(value, F.lit(r"\b[0-9a-fA-F]{32,64}\b"), F.lit(0)), lambda h: F.length(h).isin(32, 64))
    hashes = F.transform(hexes, lambda h: F.struct(F.when(F.length(h) == 32, "MD5 Hash").otherwise("SHA-256 Hash").alias("type"), h.alias("indicator")))
    signal = ((severity_rank(F.lower("severity")) >= 4) | F.coalesce(F.size(match) > 0, F.lit(False))) & ~kind.isin("process_tree", "process_relation")
    programs = F.filter(F.split(F.trim(value), r"\s+"), lambda t: t.rlike(PROGRAM_ENDINGS))
    after = F.regexp_replace(value, r"(?is)^.*?detected:", "")
    name = F.trim(F.split_part(after, F.lit(" ("), F.lit(1)))
    alone = kind.isin("process", "memprocfs_process", "ioc") & (name != "") & ~F.contains(name, F.lit(" "))
    files = F.when(~F.coalesce(signal, F.lit(False)), none).when(F.size(programs) > 0, F.transform(programs, lambda t: _indicator("Suspicious File", F.substring(t, 1, 60)))).when(alone, F.array(_indicator("Suspicious File", F.substring(name, 1, 60)))).otherwise(none)
    return F.concat(
        one(kind == "dns_query", F.lit("Domain"), domain),
        one(kind == "http_request", F.lit("URL"), url),
        one(kind == "suspicious_domain", F.when(F.lower(bare).rlike(r"\.onion$"), "Onion Address").otherwise("Domain"), bare),
        one(kind == "suspicious_crypto", F.lit("Crypto Wallet"), wallet),
        ips,
        hashes,
        files,
        one(value.rlike(r"^(HKEY|HKLM|HKCU|HKCR|HKU|\\Registry)"), F.lit("Registry Key"), F.substring(value, 1, 60)),
    )


def effective_rank(items: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Adds effective_rank, the higher of an item's own severity and the scored one (case_id, artifact_id, severity)."""
    own = severity_rank(F.lower("severity"))
    if scored is None:
        return items.withColumn("effective_rank", own)
    best = scored.groupBy("case_id", "artifact_id").agg(F.max(severity_rank(F.lower("severity"))).alias("_r"))
    return items.join(best, ["case_id", "artifact_id"], "left").withColumn("effective_rank", F.greatest(own, F.coalesce("_r", F.lit(0)))).drop("_r")


def indicator_rollup(items: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Each indicator of a case once: strongest severity and confidence, first tool, contexts, matches, and whether it surfaces."""
    rows = effective_rank(items, scored)
    match = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    context = F.col("evidence_type")
    for kind, label in CONTEXTS.items():
        context = F.when(F.col("evidence_type") == kind, label).otherwise(context)
    rows = rows.select("case_id", "seq", "artifact_id", "source_tool", "effective_rank", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), context.alias("context"), match.alias("m"), F.explode(item_indicators(items)).alias("i"))
    per = rows.groupBy("case_id", "i.type", "i.indicator").agg(
        F.max("effective_rank").alias("severity_rank"), F.max("confidence").alias("confidence"), F.min_by("source_tool", "seq").alias("tool"),
        F.array_sort(F.collect_set("context")).alias("contexts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("m")))).alias("matches"),
        F.array_sort(F.collect_set("source_tool")).alias("tools"), F.countDistinct("artifact_id").alias("n_artifacts"), F.min("artifact_id").alias("first_artifact"),
    )
    return per.withColumn("severity", severity_name(F.col("severity_rank"))).withColumn("surfaced", (F.col("severity_rank") >= 3) | (F.size("matches") > 0))


def indicator_counts(rollup: DataFrame) -> DataFrame:
    """Counts by type and by severity in one pass of grouping sets: kind, key, n, n_surfaced, n_critical."""
    rows = rollup.groupingSets([["case_id", "type"], ["case_id", "severity"]], "case_id", "type", "severity").agg(F.grouping("type").alias("g"), F.count("*").alias("n"), F.count_if("surfaced").alias("n_surfaced"), F.count_if(F.col("severity_rank") == 5).alias("n_critical"))
    return rows.select("case_id", F.when(F.col("g") == 0, "type").otherwise("severity").alias("kind"), F.when(F.col("g") == 0, F.col("type")).otherwise(F.coalesce("severity", F.lit("none"))).alias("key"), "n", "n_surfaced", "n_critical")


def folded_sample(rollup: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Of each case's indicators that do not surface the `most` of highest confidence, with their tier."""
    w = Window.partitionBy("case_id").orderBy(F.desc("confidence"), "type", "indicator")
    return rollup.where(~F.col("surfaced")).withColumn("row", F.row_number().over(w)).where(F.col("row") <= most).withColumn("tier", F.when(F.col("confidence") >= ANCHORED, "anchored").otherwise("bare"))


def truncate(text: Column, limit: int = 100) -> Column:
    """At most `limit` characters, cut at a space, with an ellipsis."""
    head = F.substring(text, 1, limit)
    at_space = F.rtrim(F.regexp_replace(head, r"(?s) [^ ]*$", ""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.coalesce(F.nullif(at_space, F.lit("")), F.rtrim(head)), F.lit("…")))


def explanation_notes(rollup_members: DataFrame, notes: DataFrame, limit: int = 100) -> DataFrame:
    """For each indicator the note of its first contributing artifact that has one."""
    hit = rollup_members.join(notes.where("note is not null and note <> '-'"), ["case_id", "artifact_id"])
    return hit.groupBy("case_id", "type", "indicator").agg(truncate(F.min_by("note", "artifact_id"), limit).alias("note"))


def type_label(kind: Column) -> Column:
    """The reader's name for an evidence type, else the type in title case."""
    label = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    for k, name in TYPE_LABELS.items():
        label = F.when(kind == k, name).otherwise(label)
    return F.when(F.coalesce(kind, F.lit("")) == "", "-").otherwise(label)


def key_findings(items: DataFrame, notes: DataFrame | None = None, most: int = FINDING_ROWS) -> DataFrame:
    """Each case's `most` foremost findings with their indicators and matches, and how many there are in all.

    A finding is high, critical or matched, no tree, and has an indicator, a
    match or a note; equal type, value and severity count once. A case without
    findings shows its first ten items.
    """
    match = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    rows = computed_once(items.withColumn("_m", match), "_i", F.array_distinct(item_indicators(items))).withColumn("_r", severity_rank(F.lower("severity")))
    if notes is not None:
        rows = rows.join(notes.select("case_id", "artifact_id", "note").dropDuplicates(["case_id", "artifact_id"]), ["case_id", "artifact_id"], "left")
    else:
        rows = rows.withColumn("note", F.lit(None).cast("string"))
    noted = F.coalesce(F.col("note") != "-", F.lit(False))
    is_finding = (F.col("evidence_type") != "process_tree") & ((F.col("_r") >= 4) | (F.size("_m") > 0)) & ((F.size("_i") > 0) | (F.size("_m") > 0) | noted)
    once = Window.partitionBy("case_id", "evidence_type", "value", "severity").orderBy("seq")
    rows = rows.withColumn("_found", is_finding & (F.row_number().over(once) == 1))
    # Findings come first, then all others by seq, so one top-k window (limited before the shuffle) serves both kinds of case.
    foremost = [F.desc("_found"), F.when(F.col("_found"), F.col("_r")).desc_nulls_last(), F.when(F.col("_found"), F.size("_i") > 0).desc_nulls_last(), F.col("seq")]
    order = Window.partitionBy("case_id").orderBy(*foremost)
    top = rows.withColumn("row", F.row_number().over(order)).where(F.col("row") <= max(most, 10))
    counts = rows.groupBy("case_id").agg(F.count_if("_found").alias("n_findings"))
    out = top.join(counts, "case_id").where((F.col("_found") & (F.col("row") <= most)) | ((F.col("n_findings") == 0) & (F.col("row") <= 10)))
    cell = F.array_join(F.transform("_i", lambda i: F.concat_ws(": ", i["type"], i["indicator"])), "; ")
    return out.select("case_id", "row", "seq", "artifact_id", type_label(F.col("evidence_type")).alias("type"), "value", "severity", cell.alias("indicators"), F.array_join(F.array_sort("_m"), ", ").alias("matches"), "n_findings")


def verdicts(scored: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """For each case the anomalies, the overall severity, and how far they support a hypothesis.

    With contexts (case_id, case_type, classifier_confidence) also the texts of the hypothesis and of the analyst's verdict.
    """
    per = scored.groupBy("case_id").agg(F.count_if("is_anomaly").alias("n_anomalies"))
    n = F.col("n_anomalies")
    support = F.when(n >= 3, "Supported").when(n >= 1, "Partially Supported").otherwise("Not Evidenced")
    out = per.select("case_id", "n_anomalies", F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low").alias("overall_severity"), support.alias("hypothesis_verdict"))
    if contexts is None:
        return out
    kind, count = F.initcap(F.replace("case_type", F.lit("_"), F.lit(" "))), n.cast("string")
    # Fixed sentences of the report.
    told = F.when(n >= 3, "multiple anomalous artifacts corroborate this hypothesis").when(n >= 1, "anomalous artifact(s) detected; further manual review recommended").otherwise("no anomalous artifacts detected in the current evidence set")
    strong = F.concat(F.lit("This investigation reveals strong indicators of a confirmed "), kind, F.lit(" incident. "), count, F.lit(" high-confidence anomalies were detected across the evidence set. Immediate escalation to incident response is warranted."))
    some = F.concat(F.lit("Evidence is consistent with "), kind, F.lit(" activity. "), count, F.lit(" anomalous artifact(s) were identified with high confidence. Analyst review and targeted containment steps are recommended."))
    none = F.concat(F.lit("No anomalous artifacts were detected in the current evidence set. The incident report was classified as "), kind, F.lit(" with "), percent(F.col("classifier_confidence")), F.lit(" confidence. Manual review is recommended to confirm benign status or expand evidence scope."))
    rows = out.join(contexts.select("case_id", "case_type", "classifier_confidence"), "case_id")
    return rows.select(*out.columns, F.concat("hypothesis_verdict", F.lit(" — "), told).alias("hypothesis_text"), F.when(n >= 3, strong).when(n >= 1, some).otherwise(none).alias("analyst_verdict"))


def priority_items(items: DataFrame, most: int = 20) -> DataFrame:
    """Each case's first `most` high and critical items in evidence order, or its first items if it has none; row numbers them.

    One top-k window, which Spark limits before the shuffle, serves both kinds of case.
    """
    rows = items if "ioc_match" in items.columns else items.withColumn("ioc_match", F.array().cast("array<string>"))
    rows = rows.withColumn("_hot", F.coalesce(F.col("severity").isin("critical", "high"), F.lit(False)))
    order = Window.partitionBy("case_id").orderBy(F.desc("_hot"), *order_keys())
    counts = rows.groupBy("case_id").agg(F.count_if("_hot").alias("_n"))
    top = rows.withColumn("row", F.row_number().over(order)).where(F.col("row") <= most).join(counts, "case_id")
    return top.where(F.col("_hot") | (F.col("_n") == 0)).drop("_hot", "_n")


def coverage(items: DataFrame, status_types: tuple[str, ...] = ("memory_analysis_status",)) -> DataFrame:
    """For each case and kind of evidence whether it was analysed, only attempted, or not provided, with the tools."""
    spark = items.sparkSession
    kinds = spark.createDataFrame([(k, i) for i, k in enumerate(EVIDENCE_KINDS)], "evidence string, no int")
    tools = spark.createDataFrame(list(TOOL_EVIDENCE.items()), "source_tool string, evidence string")
    ran = items.groupBy("case_id", "source_tool").agg(F.bool_or(~F.col("evidence_type").isin(*status_types)).alias("real")).join(tools, "source_tool")
    per = ran.groupBy("case_id", "evidence").agg(F.array_sort(F.collect_set(F.when(F.col("real"), F.col("source_tool")))).alias("analysed"), F.array_sort(F.collect_set(F.when(~F.col("real"), F.col("source_tool")))).alias("attempted"))
    every = items.select("case_id").distinct().join(kinds, F.lit(True))
    out = every.join(per, ["case_id", "evidence"], "left")
    some, tried = F.coalesce(F.size("analysed") > 0, F.lit(False)), F.coalesce(F.size("attempted") > 0, F.lit(False))
    return out.select("case_id", "evidence", "no", F.when(some, "Analysed").when(tried, "Not analysed").otherwise("Not provided").alias("status"), F.coalesce(F.array_join("analysed", ", "), F.lit("")).alias("tools"), F.coalesce(F.array_join("attempted", ", "), F.lit("")).alias("attempted"))


def class_rows(contexts: DataFrame, facts: DataFrame) -> DataFrame:
    """The technique or advice rows of each case's class, or those of unknown; Spark broadcasts the facts if they are small."""
    known = facts.select("case_type").distinct().withColumn("_k", F.lit(True))
    keyed = contexts.join(known, "case_type", "left").withColumn("_key", F.when(F.col("_k"), F.col("case_type")).otherwise("unknown"))
    return keyed.select("case_id", F.col("_key").alias("case_type")).join(facts, "case_type")


def normalise_explanations(documents: DataFrame, text: str = "text") -> DataFrame:
    """Explanations kept as a JSON map or list become rows of artifact_id, is_anomaly, severity, reason."""
    shape = "struct<artifact_id: string, is_anomaly: boolean, severity: string, reason: string, explanation: string, summary: string>"
    as_map = F.from_json(F.get_json_object(text, "$.explanations"), f"map<string, {shape}>")
    as_list = F.from_json(F.get_json_object(text, "$.explanations"), f"array<{shape}>")
    is_list = F.ltrim(F.get_json_object(text, "$.explanations")).startswith("[")
    rows = documents.where(is_list).select(F.lit(None).cast("string").alias("k"), F.explode(as_list).alias("e")).unionByName(documents.where(~is_list).select(F.explode(as_map).alias("k", "e")))
    note = F.coalesce(*(F.nullif(F.col(f"e.{c}"), F.lit("")) for c in ("reason", "explanation", "summary")), F.lit("-"))
    return rows.select(F.coalesce("e.artifact_id", "k").alias("artifact_id"), F.coalesce("e.is_anomaly", F.lit(False)).alias("is_anomaly"), F.lower(F.coalesce("e.severity", F.lit("informational"))).alias("severity"), note.alias("reason"))


def dashboard(items: DataFrame) -> DataFrame:
    """For each case the counts that the front page shows."""
    return items.groupBy("case_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("evidence_type") == "ioc").alias("n_iocs"), F.count_if(F.col("evidence_type") == "process_tree").alias("n_trees"))
