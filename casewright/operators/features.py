"""Features, rule scores and contexts of evidence items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.schema import severity_name, severity_rank

# Lists, patterns, weights and limits of the scoring model.
SUSPICIOUS_PROCESSES = [
    "cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe",
    "wmic.exe", "psexec.exe", "nc.exe", "ncat.exe", "mimikatz.exe", "procdump.exe", "meterpreter", "beacon.exe", "malware.exe", "payload.exe",
    "shell.exe", "rat.exe",
]
SYSTEM_PROCESSES = ["svchost.exe", "lsass.exe", "csrss.exe", "smss.exe", "wininit.exe", "services.exe", "winlogon.exe", "explorer.exe", "taskhostw.exe", "spoolsv.exe", "dwm.exe", "system", "registry"]
SUSPICIOUS_PARENTS = ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe", "python.exe", "python3", "bash", "sh"]
C2_PORTS = [4444, 1337, 8888, 9999, 31337, 6666, 12345, 54321, 4000, 5555, 7777, 2222, 3333, 6667]
STANDARD_PORTS = [80, 443, 0, 8080, 8443, 53, 22, 21, 25]
SEVERITY_VALUES = {"critical": 1.0, "high": 0.75, "medium": 0.50, "low": 0.25}
C2_WORDS = r"(?i)\b(c2|command.and.control|beacon|reverse.shell|meterpreter|connect.back|bind.shell|netcat|nc\.exe|4444|1337|8888|payload|dropper|implant|rat\b|exeshell)"
TRANSFER_WORDS = r"(?i)\b(exfil|upload|exfiltrat|data.sent|POST|curl|wget|ftp|sftp|transfer|smuggl|tunnel|dns.query)"
TEMP_PATH = r"(?i)(AppData[\\/](?:Roaming|Local|Temp)|[\\/]Temp[\\/]|[\\/]tmp[\\/]|Downloads[\\/]|ProgramData[\\/])"
EXE_IN_TEMP = r"(?i)(Temp|AppData|Downloads|tmp)[\\/\w]*\.exe"
SPAWNED = r"(?i)([\w\-]+\.exe)\s+(?:spawned|launched|executed)\s+by\s+([\w\-]+\.exe)"
FEATURES = [
    "is_system_process", "is_suspicious_process", "suspicious_parent", "port_nonstandard", "port_is_known_c2", "has_network_activity", "evidence_is_file",
    "evidence_is_network", "evidence_is_email", "path_in_temp", "path_has_exe_in_temp", "keyword_c2_indicator", "keyword_exfil", "severity_score",
]
WEIGHTS = {"is_suspicious_process": -0.30, "suspicious_parent": -0.20, "port_is_known_c2": -0.35, "path_in_temp": -0.15, "path_has_exe_in_temp": -0.30, "keyword_c2_indicator": -0.35, "keyword_exfil": -0.20, "severity_score": -0.25}
ANOMALY_BELOW = -0.10
INDICATORS = [("port_is_known_c2", 10), ("path_has_exe_in_temp", 9), ("keyword_c2_indicator", 9), ("is_suspicious_process", 8), ("suspicious_parent", 8), ("keyword_exfil", 7), ("path_in_temp", 6), ("port_nonstandard", 5), ("evidence_is_network", 4), ("evidence_is_file", 4), ("evidence_is_email", 4), ("is_system_process", 3), ("has_network_activity", 2)]


def canonical_type(kind: Column) -> Column:
    """Network, email or file by parts of the name, else the lower-cased name."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    has = lambda *parts: k.rlike("|".join(parts))
    return F.when(has("network", "connection", "pcap"), "network").when(has("email", "phishing"), "email").when(has("file", "disk"), "file").otherwise(k)


def _or_empty(items: DataFrame, name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in items.columns else F.lit(default)


def record_value(items: DataFrame) -> Column:
    """The normalised value, else the value, else the raw one; empty counts as absent."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("normalized_value", "value", "raw_value") if c in items.columns), F.lit(""))


def features(items: DataFrame) -> DataFrame:
    """Adds the fourteen features as double columns; all are expressions, none a function in Python."""
    value, kind = record_value(items), canonical_type(F.col("evidence_type"))
    name, parent = F.lower(_or_empty(items, "process_name", "")), F.lower(_or_empty(items, "parent_process", ""))
    spawned, spawner = (F.lower(F.regexp_extract(value, SPAWNED, g)) for g in (1, 2))
    out = items.withColumn("_v", value).withColumn("_k", kind)
    first_exe = F.lower(F.regexp_extract("_v", r"(?i)[\w\-]+\.exe", 0))
    out = out.withColumn("_p", F.coalesce(F.nullif(name, F.lit("")), F.nullif(spawned, F.lit("")), first_exe))
    out = out.withColumn("_q", F.when((name == "") & (spawned != ""), spawner).otherwise(parent))
    own_port = F.coalesce(_or_empty(items, "port", 0).cast("int"), F.lit(0))
    in_text = F.regexp_extract("_v", r"\b\d{1,3}(?:\.\d{1,3}){3}:(\d{2,5})\b", 1).try_cast("int")
    out = out.withColumn("_port", F.when((own_port == 0) & (F.col("_k") == "network"), F.coalesce(in_text, F.lit(0))).otherwise(own_port))
    severity = F.lit(0.0)
    for s, v in SEVERITY_VALUES.items():
        severity = F.when(F.lower("severity") == s, v).otherwise(severity)
    network = _or_empty(items, "has_network", False).cast("boolean") | (F.col("_k") == "network")
    columns = [
        F.col("_p").isin(SYSTEM_PROCESSES), F.col("_p").isin(SUSPICIOUS_PROCESSES), F.col("_q").isin(SUSPICIOUS_PARENTS),
        (F.col("_port") > 0) & ~F.col("_port").isin(STANDARD_PORTS), F.col("_port").isin(C2_PORTS), network, F.col("_k") == "file", F.col("_k") == "network",
        F.col("_k") == "email", F.col("_v").rlike(TEMP_PATH), F.col("_v").rlike(EXE_IN_TEMP), F.col("_v").rlike(C2_WORDS), F.col("_v").rlike(TRANSFER_WORDS), severity,
    ]
    return out.withColumns({f: c.cast("double") for f, c in zip(FEATURES, columns, strict=True)}).drop("_v", "_k", "_p", "_q", "_port")


def model_scope(items: DataFrame) -> Column:
    """The model family of an item, by an ordered list of tests."""
    kind, tool, value = (F.lower(F.coalesce(c, F.lit(""))) for c in ("evidence_type", "source_tool", "value"))
    named = _or_empty(items, "process_name", "") != ""
    return (
        F.when(kind.rlike("network|connection|pcap") | (tool == "tshark") | _or_empty(items, "has_network", False).cast("boolean"), "network")
        .when(kind.rlike("process|malfind") | (tool == "volatility3") | named, "process")
        .when(kind.rlike("email|phishing") | (tool == "email"), "email")
        .when(kind.rlike("registry|hive") | (tool == "regripper"), "registry")
        .when(F.contains(kind, F.lit("browser")) | (tool == "browser"), "browser")
        .when(kind.rlike("log|event") | (tool == "plaso"), "log")
        .when(kind.rlike("file|disk") | (tool == "tsk_fls") | F.contains(value, F.lit(".exe")), "file")
        .otherwise("generic")
    )


def baseline_choice(families: DataFrame, baseline: DataFrame) -> DataFrame:
    """For each family whether its own baseline rows serve (own) or, as it has none, all of them (all)."""
    counts = baseline.groupBy("family").agg(F.count("*").alias("n_baseline"))
    return families.select("family").distinct().join(counts, "family", "left").select("family", F.coalesce("n_baseline", F.lit(0)).alias("n_baseline"), F.when(F.col("n_baseline") > 0, "own").otherwise("all").alias("baseline"))


def rule_score() -> Column:
    """The weighted sum of the penalised features."""
    total = F.lit(0.0)
    for feature, weight in WEIGHTS.items():
        total = total + F.col(feature) * weight
    return total


def final_score(scored: DataFrame, model_score: Column | None = None) -> DataFrame:
    """Adds rule_score, score, is_anomaly and confidence, rounded to four places; without a model its part is 0."""
    model = F.lit(0.0) if model_score is None else model_score
    out = scored.withColumn("_s", model + rule_score())
    out = out.withColumn("rule_score", F.round(rule_score(), 4)).withColumn("score", F.round("_s", 4)).withColumn("is_anomaly", F.round("_s", 9) < ANOMALY_BELOW)
    return out.withColumn("anomaly_confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - F.col("_s"))), 4)).drop("_s")


def baseline_difference(scored: DataFrame, baseline: DataFrame, keep: list[str], most: int = 5) -> DataFrame:
    """The `most` features of a row that differ most from the family's baseline mean, with direction and rank."""
    means = baseline.groupBy("family").agg(*(F.avg(f).alias(f"_m_{f}") for f in FEATURES))  # one row for each of the eight families
    apart = lambda f: F.round(F.abs(F.col(f) - F.col(f"_m_{f}")), 4)
    rows = F.array(*(F.struct((-apart(f)).alias("d"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).alias("x"), F.col(f"_m_{f}").alias("mean")) for i, f in enumerate(FEATURES)))
    foremost = F.slice(F.array_sort(F.filter(rows, lambda r: r["d"] < 0)), 1, most)
    ranked = scored.join(F.broadcast(means), "family").select(*keep, "family", F.posexplode(foremost).alias("_at", "_f"))
    return ranked.select(*keep, "family", (F.col("_at") + 1).alias("rank"), "_f.feature", "_f.x", F.round("_f.mean", 4).alias("mean"), (-F.col("_f.d")).alias("difference"), F.when(F.col("_f.x") > F.col("_f.mean"), "above").otherwise("below").alias("direction"))


def indicator_ranking() -> Column:
    """The active indicator features by weight, then position."""
    rows = F.array(*(F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), F.when(F.col(f) > 0, F.lit(f)).alias("f")) for i, (f, w) in enumerate(INDICATORS)))
    return F.transform(F.array_sort(F.filter(rows, lambda r: r["f"].isNotNull())), lambda r: r["f"])


def score_severity(score: Column, explicit: Column, is_anomaly: Column) -> Column:
    """The higher of the own severity and that of the score's band; informational if not anomalous."""
    band = F.when(score < -0.40, 5).when(score < -0.25, 4).when(score < -0.10, 3).otherwise(1)
    own = severity_rank(F.lower(explicit))
    only = F.when((score >= -0.10) & (score < 0.0), 2).otherwise(band)
    return F.when(~is_anomaly, "informational").otherwise(severity_name(F.when(own >= 2, F.greatest(own, band)).otherwise(only)))


def machine_context(items: DataFrame, most: int = 20) -> DataFrame:
    """For each machine the number of items and types and its first `most` ids; a bounded window precedes the list."""
    w = Window.partitionBy("case_id", "machine_id").orderBy("seq")
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("case_id", "machine_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "artifact_id"))), lambda s: s["artifact_id"]).alias("first_ids"))
    counts = items.groupBy("case_id", "machine_id").agg(F.count("*").alias("n_items"), F.countDistinct("evidence_type").alias("n_types"))
    return counts.join(first, ["case_id", "machine_id"], "left")


def correlation_context(annotated: DataFrame) -> DataFrame:
    """Adds related: all the row's findings, then its links that those do not name."""
    links = F.filter("linked_artifacts", lambda x: x.isNotNull() & (x != "") & ~F.array_contains(F.col("correlations"), x))
    return annotated.withColumn("related", F.concat("correlations", F.transform(links, lambda x: F.concat(F.lit("linked_artifact|"), x))))


def related_counts(counted: DataFrame, named: DataFrame) -> DataFrame:
    """M16 without lists: n_related, the length of correlation_context()'s related, and has_link, whether its last entry is a declared link (null if it is empty).

    counted: items with n_findings (correlate.with_findings()); named: the links
    that findings name (correlate.named_links()), few as a rule.
    """
    names = named.groupBy("case_id", "artifact_id").agg(F.collect_set("link").alias("_named"))
    rows = counted.join(names, ["case_id", "artifact_id"], "left")
    links = F.size(F.filter(F.coalesce("linked_artifacts", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "") & ~F.coalesce(F.array_contains("_named", x), F.lit(False))))
    rows = rows.withColumn("_links", links).withColumn("n_related", (F.col("n_findings") + F.col("_links")).cast("int"))
    return rows.withColumn("has_link", F.when(F.col("n_related") > 0, F.col("_links") > 0)).drop("_links", "_named")


def case_context(findings: DataFrame, most: int = 5) -> DataFrame:
    """For each case the number of findings and transfers, and its `most` strongest findings."""
    w = Window.partitionBy("case_id").orderBy(F.desc("confidence"), "correlation_type", "key")
    top = findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws("|", "correlation_type", "key").alias("s")))), lambda s: s["s"]).alias("strongest"))
    counts = findings.groupBy("case_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("correlation_type") == "exfiltration").alias("n_exfiltration"))
    return counts.join(top, "case_id").withColumn("has_exfiltration", F.col("n_exfiltration") > 0)


def score_summary(scored: DataFrame) -> DataFrame:
    """Rows and anomalies of each family, and of all in the row without a family."""
    return scored.rollup("family").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("n_anomalies"))
