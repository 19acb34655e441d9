"""Narrative classification, analyser selection and reconciliation with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import count_of
from casewright.session import checkpointed

# Classes with their words, artifact types with theirs, and the evidence that supports a class.
CLASS_WORDS = {
    "ransomware": ["ransom", "encrypt", "decrypt", "bitcoin", "locked", ".crypt", "payment"],
    "apt_intrusion": ["apt", "advanced persistent", "nation-state", "lateral movement", "spear phish", "c2", "command and control"],
    "data_exfiltration": ["exfil", "data theft", "stolen", "upload", "ftp", "transfer", "leak", "exfiltrat"],
    "insider_threat": ["insider", "employee", "disgruntled", "privileged user", "unauthorised access", "unauthorized access"],
    "malware_infection": ["malware", "trojan", "worm", "virus", "injected", "backdoor", "rootkit", "payload"],
    "phishing": ["phishing", "spear phish", "email", "credential harvest", "fake login", "link clicked"],
}
TYPE_WORDS = {
    "memory_dump": ["memory", ".dmp", "memory dump", "ram"],
    "disk_image": ["disk", ".img", ".dd", "drive", "disk image"],
    "pcap": ["pcap", "network capture", ".pcap", "wireshark", "traffic"],
    "registry_hive": ["registry", "ntuser", "ntuser.dat", "hive", "regedit"],
    "log_files": ["log", "event log", "syslog", "windows event", ".log", "evtx"],
    "email_archive": ["email", "pst", ".pst", "mailbox", "outlook"],
    "browser_history": ["browser", "chrome", "firefox", "history", "cookies"],
}
SUMMARIES = {
    "ransomware": "Ransomware incident where files were encrypted and a ransom demand was made.",
    "apt_intrusion": "Advanced persistent threat intrusion with signs of long-dwell lateral movement.",
    "data_exfiltration": "Suspected data exfiltration incident with unauthorised access to sensitive files.",
    "insider_threat": "Insider threat incident involving unauthorised data access by a privileged user.",
    "malware_infection": "Malware infection detected with signs of process injection and C2 communication.",
    "phishing": "Phishing-initiated compromise resulting in credential theft or payload execution.",
    "unknown": "Incident of unknown type requiring broad forensic investigation across all artifacts.",
}
EXPECTED_TYPES = {
    "ransomware": ["suspicious_crypto", "file_artifact", "extracted_file", "suspicious_domain", "registry_key", "registry_entry", "ioc"],
    "malware_infection": ["injected_code", "malfind", "process", "process_relation", "suspicious_domain", "ioc"],
    "apt_intrusion": ["injected_code", "malfind", "network_connection", "process_relation", "registry_key", "registry_entry", "suspicious_domain", "ioc"],
    "data_exfiltration": ["network_connection", "http_request", "dns_query", "suspicious_port", "ioc"],
    "phishing": ["phishing_email", "email_address", "suspicious_url", "suspicious_domain", "dns_query"],
    "insider_threat": ["file_artifact", "extracted_file", "registry_key", "registry_entry", "timeline_event", "commandline"],
}
DIVERGENCE, FLOOR, BETTER_BY = 0.5, 0.5, 0.25
STOP_HOSTS = ["HTTP", "HTTPS", "WIN32", "WIN64"]


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds, in any case."""
    return count_of(F.lower(text), words)


def class_score(texts: DataFrame, text: str = "text", words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds case_type and classifier_confidence; equal scores go to the earlier class, none to unknown."""
    words = CLASS_WORDS if words is None else words
    scores = F.array(*(F.struct(hits(F.col(text), w).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, w) in enumerate(words.items())))
    best = F.array_max(scores)
    out = texts.withColumn("_best", best)
    found = F.coalesce(F.col("_best.n") > 0, F.lit(False))
    out = out.withColumn("case_type", F.when(found, F.col("_best.c")).otherwise("unknown"))
    return out.withColumn("classifier_confidence", F.when(found, F.least((50 + 10 * F.col("_best.n")) / 100.0, F.lit(0.95))).otherwise(0.35)).drop("_best")


def artifact_types(texts: DataFrame, text: str = "text", words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds artifact_types, those with a word in the text, in order; memory_dump if there is none."""
    words = TYPE_WORDS if words is None else words
    named = F.array_compact(F.array(*(F.when(hits(F.col(text), w) > 0, t) for t, w in words.items())))
    return texts.withColumn("artifact_types", F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("memory_dump"))))


def affected_systems(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds affected_systems: addresses, then the first three host-shaped names, each once, five at most."""
    addresses = F.regexp_extract_all(F.col(text), F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))
    shaped = F.filter(F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Z][A-Z0-9\-]{3,}\b"), F.lit(0)), lambda h: (F.length(h) <= 15) & h.rlike("[0-9-]") & ~h.isin(STOP_HOSTS))
    return texts.withColumn("affected_systems", F.slice(F.array_distinct(F.concat(addresses, F.slice(shaped, 1, 3))), 1, 5))


def class_facts(contexts: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds a class's columns (hypotheses, summary) from a dimension keyed by case_type; unknown stands in."""
    names = [c for c in facts.columns if c != "case_type"]
    fallback = facts.where("case_type = 'unknown'").select(*(F.col(c).alias(f"_{c}") for c in names))
    out = contexts.join(facts, "case_type", "left").join(F.broadcast(fallback.limit(1)), F.lit(True), "left")
    return out.select(*contexts.columns, *(F.coalesce(c, f"_{c}").alias(c) for c in names))


def narrow_types(contexts: DataFrame, provided: str = "provided_types") -> DataFrame:
    """artifact_types become the provided ones in canonical order, the claim moves aside; unchanged if none is valid."""
    canonical = F.filter(F.array(*(F.lit(t) for t in TYPE_WORDS)), lambda t: F.array_contains(F.col(provided), t))
    some = F.coalesce(F.size(canonical) > 0, F.lit(False))
    return contexts.withColumn("artifact_types_claimed", F.when(some, F.col("artifact_types"))).withColumn("artifact_types", F.when(some, canonical).otherwise(F.col("artifact_types")))


def check_contexts(contexts: DataFrame) -> DataFrame:
    """The rows, if all keep the contract; reading a row that breaks it raises an error that names the rule."""
    rules = {
        "case_id is missing": F.coalesce(F.col("case_id"), F.lit("")) == "",
        "case_type is not known": ~F.coalesce(F.col("case_type").isin(*SUMMARIES), F.lit(False)),
        "artifact_types is empty or not known": F.coalesce(F.size("artifact_types") < 1, F.lit(True)) | (F.size(F.array_except("artifact_types", F.array(*(F.lit(t) for t in TYPE_WORDS)))) > 0),
        "classifier_confidence is out of range": ~F.coalesce(F.col("classifier_confidence").between(0, 1), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(bad, text) for text, bad in rules.items())))
    return contexts.withColumn("case_id", F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("case context: "), F.array_join(broken, "; ")))).otherwise(F.col("case_id")))


def select_analysers(contexts: DataFrame, ontology: DataFrame) -> DataFrame:
    """Analysers whose inputs meet the case's types, ranked by relevance, default order and name."""
    pairs = contexts.select("case_id", "case_type", F.explode("artifact_types").alias("t")).join(ontology.withColumn("t", F.explode("input_types")), "t").drop("t").dropDuplicates(["case_id", "name"])
    relevance = F.coalesce(F.try_element_at("case_relevance", F.col("case_type")), F.try_element_at("case_relevance", F.lit("unknown")), F.lit(0.5))
    w = Window.partitionBy("case_id").orderBy(F.desc("relevance"), "default_order", "name")
    return pairs.withColumn("relevance", relevance).withColumn("rank", F.row_number().over(w)).select("case_id", "name", "relevance", "default_order", "dependencies", "args_template", "rank")


def dependency_levels(selected: DataFrame, most: int = 50) -> DataFrame:
    """Adds level, the longest chain of selected analysers that must run before; a cycle is an error.

    selected has one row for each (case_id, name). Cases that select the same
    analysers share their levels, so the recursive query that follows the
    dependencies runs once for each different set of names, of which there are few.
    """
    spark = selected.sparkSession
    sets = selected.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_set("name"))).alias("chosen"))
    rows = selected.join(sets, "case_id")
    nodes = checkpointed(rows.groupBy("chosen", "name").agg(F.first("dependencies").alias("dependencies")))  # of the ontology, so the same in all cases
    edges = checkpointed(nodes.select("chosen", "name", F.explode("dependencies").alias("needs")).join(nodes.select("chosen", F.col("name").alias("needs")), ["chosen", "needs"]))  # each step of the recursion reads them
    chains = spark.sql(
        f"""WITH RECURSIVE chain(chosen, name, level) AS (
            SELECT chosen, name, 0 FROM {{nodes}}
            UNION ALL SELECT e.chosen, e.name, c.level + 1 FROM chain c JOIN {{edges}} e ON e.chosen = c.chosen AND e.needs = c.name WHERE c.level < {most})
        SELECT chosen, name, max(level) AS level FROM chain GROUP BY chosen, name""",
        nodes=nodes.select("chosen", "name"),
        edges=edges,
    )
    checked = F.when(F.col("level") >= most, F.raise_error(F.lit("the analysers depend on one another in a circle"))).otherwise(F.col("level"))
    return rows.join(chains.withColumn("level", checked), ["chosen", "name"]).select(*selected.columns, "level")


def plan_rows(levelled: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Name, order from 1 and arguments; an allow list filters before numbering."""
    rows = levelled if allowed is None else levelled.where(F.col("name").isin(allowed))
    w = Window.partitionBy("case_id").orderBy("level", "rank")
    return rows.select("case_id", "name", F.row_number().over(w).alias("order"), F.col("args_template").alias("args"))


def ontology_violations(ontology: DataFrame, known: DataFrame) -> DataFrame:
    """Name and violation for each broken rule of the ontology; known is the table of known names (name)."""
    names = known.select("name").distinct().withColumn("_known", F.lit(True))
    rows = ontology.join(names, "name", "left")
    stranger = F.col("name").isNotNull() & F.col("_known").isNull()
    rules = F.array_compact(F.array(F.when(F.coalesce("name", F.lit("")) == "", "name is missing"), F.when(stranger, "name is not known"), F.when(F.coalesce(F.size("input_types") < 1, F.lit(True)), "input_types is empty"), F.when(F.col("default_order").isNull(), "default_order is missing")))
    twice = ontology.groupBy("name").count().where("count > 1").select("name", F.lit("name is not unique").alias("violation"))
    return rows.select("name", F.explode(rules).alias("violation")).unionByName(twice)


def parse_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """A model's JSON answers as contexts: code fences are stripped, missing ids filled; bad JSON is an error."""
    body = F.trim(F.regexp_replace(F.col(text), r"(?m)^\s*```(?:json)?\s*$", ""))
    parsed = F.from_json(body, "case_id string, case_type string, artifact_types array<string>, hypotheses array<string>, affected_systems array<string>, classifier_confidence double, generated_at string, raw_incident_summary string", {"mode": "FAILFAST"})
    out = answers.select(parsed.alias("c")).select("c.*")
    return out.withColumn("case_id", F.coalesce(F.nullif("case_id", F.lit("")), F.uuid())).withColumn("generated_at", F.coalesce(F.nullif("generated_at", F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def present_types(items: DataFrame) -> DataFrame:
    """The evidence types that each case has."""
    return items.where("evidence_type <> ''").groupBy("case_id").agg(F.array_sort(F.collect_set("evidence_type")).alias("present"))


def support(expected: Column, present: Column) -> Column:
    """The share of the expected types that are present."""
    return F.size(F.array_intersect(expected, present)) / F.size(expected)


def reconcile(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """Support of each case's class by its evidence, lowered confidence if it is weak, and a better class.

    The suggestion is a fold over the classes in order, as each must beat the
    last suggestion by a quarter.
    """
    classes = F.map_from_arrays(F.array(*(F.lit(c) for c in EXPECTED_TYPES)), F.array(*(F.array(*(F.lit(t) for t in types)) for types in EXPECTED_TYPES.values())))
    out = contexts.join(present_types(items), "case_id", "left").withColumn("_classes", classes).withColumn("expected", F.try_element_at("_classes", F.col("case_type")))
    known = F.col("expected").isNotNull() & F.col("present").isNotNull()
    score = F.when(known, support(F.col("expected"), F.col("present")))
    out = out.withColumn("support_score", F.round(score, 4)).withColumn("supporting", F.when(known, F.array_sort(F.array_intersect("expected", "present")))).withColumn("absent", F.when(known, F.array_sort(F.array_except("expected", "present"))))
    weak = F.coalesce(score < DIVERGENCE, F.lit(False))
    factor = F.lit(FLOOR) + F.lit(1 - FLOOR) * score / DIVERGENCE
    out = out.withColumn("diverged", weak).withColumn("reconciled_confidence", F.when(weak, F.least(F.round(F.col("classifier_confidence") * factor, 2), F.col("classifier_confidence"))).otherwise(F.col("classifier_confidence")))
    start = F.struct(F.lit(None).cast("string").alias("c"), score.alias("s"))
    options = F.array(*(F.struct(F.lit(c).alias("c"), support(F.col("_classes")[c], F.col("present")).alias("s")) for c in EXPECTED_TYPES))
    better = F.aggregate(options, start, lambda acc, x: F.when((x["c"] != F.col("case_type")) & (x["s"] > acc["s"] + BETTER_BY), x).otherwise(acc))
    return out.withColumn("suggested_type", F.when(weak, better["c"])).drop("_classes", "expected")
