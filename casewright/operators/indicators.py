"""Matching of items against an indicator catalog, and rows derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.signals import HOST_PATTERN, IP_PATTERN
from casewright.functions.text import any_of
from casewright.schema import computed_once, make_items, severity_name, severity_rank

# The default catalog, in rule order.
CATALOG = {
    "indicators": [
        {"id": "wannacry_dropper", "match": ["tasksche.exe", "mssecsvc.exe", "mssecsvc2.0", "wannacry", "wanacry", "wcry"], "severity": "critical", "category": "known_malware"},
        {"id": "wannacry_decryptor", "match": ["@wanadecryptor@", "wanadecryptor", ".wncry", ".wncryt", ".wcry", "wana decrypt0r"], "severity": "critical", "category": "ransomware_marker"},
        {"id": "wannacry_payload", "match": [".wnry"], "severity": "high", "category": "ransomware_marker"},
        {"id": "wannacry_killswitch", "match": ["iuqerfsodp9ifjaposdfjhgosurijfaewrwergwea"], "severity": "high", "category": "c2"},
        {"id": "tor_hidden_service", "match": [".onion"], "severity": "high", "category": "c2"},
        {"id": "wannacry_ransom_wallet", "match": ["13am4vw2dhxygxeqepohkhsquy6ngaeb94", "12t9ydpgwuez9nymgw519p7aa8isjr6smw", "115p7ummngoj1pmvkphijcrdfjnxj6lrln"], "severity": "critical", "category": "ransomware_marker"},
        {"id": "ransomware_family", "match": ["ryuk", "lockbit", "revil", "sodinokibi", "conti", "blackcat", "alphv", "maze", "egregor", "darkside", "cl0p", "clop"], "severity": "critical", "category": "known_malware"},
        {"id": "ransom_note_markers", "match": ["ransom", "decrypt your files", "your files have been encrypted", "bitcoin", "btc wallet", "tor browser", ".locked", "readme.txt restore", "how to decrypt"], "severity": "high", "category": "ransomware_marker"},
        {"id": "credential_tooling", "match": ["mimikatz", "sekurlsa", "lsass dump", "lsass.dmp", "procdump", "comsvcs.dll minidump", "wce.exe", "pwdump", "gsecdump"], "severity": "high", "category": "attacker_tooling"},
        {"id": "offensive_tooling", "match": ["cobaltstrike", "cobalt strike", "beacon.dll", "psexec", "psexesvc", "meterpreter", "metasploit", "bloodhound", "sharphound", "rubeus", "powersploit", "nishang"], "severity": "high", "category": "attacker_tooling"},
        {"id": "lolbin_abuse", "match": ["certutil -urlcache", "certutil.exe -decode", "mshta.exe http", "regsvr32 /s /n /u", "rundll32 javascript", "bitsadmin /transfer", "wmic process call create"], "severity": "high", "category": "living_off_the_land"},
        {"id": "persistence_runkey", "match": ["currentversion\\run", "currentversion\\runonce", "userinit", "\\winlogon\\shell", "schtasks /create"], "severity": "high", "category": "persistence"},
        {"id": "code_injection", "match": ["page_execute_readwrite", "rwx", "injected_code", "process hollowing", "reflective"], "severity": "high", "category": "code_injection"},
    ],
    "bad_hosts": {"domains": ["rapid-craft567.com"], "ips": ["165.245.215.18"], "severity": "high"},
    "c2_ports": {"ports": [4444, 4445, 1337, 31337, 8888, 9999, 6667, 6668, 6669], "severity": "critical"},
    "exfil_keywords": {"keywords": ["exfil", "dns tunnel", "covert post", "data staged", "rclone", "megacmd", "outbound upload", "/api/metrics/run", "/api/join/"], "severity": "critical"},
}
PORT_PATTERN = r"(?i)(?:(?<=[\w.]):|\b(?:dst\s+)?d?port\b[\s:=]{0,3})(\d{2,5})\b"
SUMMARY_TYPES = ["process_tree"]
# Terms, severities, confidences and texts of the derived rows.
DERIVED_RULES = [
    *(("proc", p, p.lower(), "high", 0.90, f"Suspicious process detected: {p}") for p in ("powershell.exe", "cmd.exe", "rundll32.exe", "wscript.exe", "cscript.exe", "tasksche.exe", "@WanaDecryptor@")),
    *(("keyword", k, k, "critical", 0.95, f"Malware indicator detected: {k}") for k in ("mimikatz", "meterpreter", "wannacry", "cobaltstrike", "powershell -enc", "vssadmin delete shadows", "wmic")),
    *(("dll", d, d, "high", 0.85, f"Suspicious DLL path detected: {d}") for d in ("temp", "appdata")),
    *(("relation", f"{p}_{c}", f"{p} -> {c}".lower(), "critical", 0.96, f"Suspicious lineage detected: {p} -> {c}") for p, c in (("explorer.exe", "powershell.exe"), ("tasksche.exe", "@WanaDecryptor@"))),
]
TECHNIQUES = {"powershell": ("T1059", "PowerShell"), "injection": ("T1055", "Process Injection"), "ransomware": ("T1486", "Data Encrypted for Impact"), "smb": ("T1021", "Remote Services")}


def rule_list(catalog: dict) -> list[dict]:
    """The catalog's rules in the order of application, numbered: terms, then hosts, ports, and transfer words."""
    rules = [{"id": r["id"], "kind": "terms", "values": [t.lower() for t in r["match"]], "severity": r["severity"]} for r in catalog.get("indicators") or []]
    bad, ports, words = (catalog.get(k) or {} for k in ("bad_hosts", "c2_ports", "exfil_keywords"))
    rules.append({"id": "bad_host_reputation", "kind": "hosts", "values": [], "severity": bad.get("severity", "high")})
    if ports.get("ports"):
        rules.append({"id": "c2_port", "kind": "ports", "values": [int(p) for p in ports["ports"]], "severity": ports.get("severity", "high")})
    if words.get("keywords"):
        rules.append({"id": "data_exfiltration", "kind": "terms", "values": [k.lower() for k in words["keywords"]], "severity": words.get("severity", "high")})
    return rules


def ports_in(text: Column) -> Column:
    """Numbers that stand after an address colon or a port word."""
    return F.transform(F.regexp_extract_all(text, F.lit(PORT_PATTERN), F.lit(1)), lambda p: p.cast("int"))


def bad_host_rows(items: DataFrame, catalog: dict, contexts: DataFrame | None = None) -> DataFrame:
    """case_id, seq, bad: the bad address or domain that a row names; per-case hosts count for their case.

    Hosts are expanded to their dot suffixes, so that being under a domain is
    an equality. An address wins over a domain; then the smallest name.
    """
    spark = items.sparkSession
    bad = catalog.get("bad_hosts") or {}
    names = [(None, str(d).strip().lower().rstrip(".")) for d in bad.get("domains") or []] + [(None, str(i).strip()) for i in bad.get("ips") or []]
    listed = spark.createDataFrame([n for n in names if n[1]], "bad_case string, bad string")
    if contexts is not None:
        own = contexts.select(F.col("case_id").alias("bad_case"), F.explode("known_bad_hosts").alias("h")).select("bad_case", F.rtrim(F.lower(F.trim("h")), F.lit(".")).alias("bad")).where("bad <> ''")
        listed = listed.unionByName(own)
    listed = listed.distinct()
    rows = items.where(~F.col("evidence_type").isin(SUMMARY_TYPES)).select("case_id", "seq", F.explode(_host_tokens()).alias("bad"))
    hit = rows.join(listed, "bad").where("bad_case is null or bad_case = case_id")
    is_ip = F.col("bad").rlike(f"^{IP_PATTERN}$")
    return hit.groupBy("case_id", "seq").agg(F.min(F.struct((~is_ip).alias("o"), "bad")).alias("b")).select("case_id", "seq", F.col("b.bad").alias("bad"))


#: Hosts of cases are broadcast and searched as a list for each row up to this number in all and for one case; more are joined by shuffle.
BROADCAST_HOSTS, CASE_HOSTS = 100_000, 1_000


def bad_host_column(items: DataFrame, catalog: dict, contexts: DataFrame | None = None) -> DataFrame:
    """Adds _bad, what bad_host_rows finds for a row, without moving the items: the names are literals, a case's own ones are broadcast.

    Only rows that hold a listed name at all have their hosts extracted.
    """
    bad = catalog.get("bad_hosts") or {}
    fixed = sorted({n for n in [str(d).strip().lower().rstrip(".") for d in bad.get("domains") or []] + [str(i).strip() for i in bad.get("ips") or []] if n})
    listed, out = F.array(*map(F.lit, fixed)).cast("array<string>"), items
    if contexts is not None:
        n = F.greatest(F.coalesce(F.size("known_bad_hosts"), F.lit(0)), F.lit(1))
        all_hosts, of_one = contexts.groupBy("case_id").agg(F.sum(n).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if all_hosts > BROADCAST_HOSTS or of_one > CASE_HOSTS:
            return items.join(bad_host_rows(items, catalog, contexts).withColumnRenamed("bad", "_bad"), ["case_id", "seq"], "left")
        own = contexts.groupBy("case_id").agg(F.flatten(F.collect_list("known_bad_hosts")).alias("_own"))
        own = own.select("case_id", F.filter(F.transform("_own", lambda h: F.rtrim(F.lower(F.trim(h)), F.lit("."))), lambda h: h != "").alias("_own"))
        out, listed = items.join(F.broadcast(own), "case_id", "left"), F.array_distinct(F.concat(listed, F.coalesce("_own", F.array().cast("array<string>"))))
    out = out.withColumn("_listed", listed)
    named = F.exists("_listed", lambda n: F.contains(F.lower(F.coalesce("value", F.lit(""))), n)) & ~F.coalesce(F.col("evidence_type").isin(SUMMARY_TYPES), F.lit(False))
    hit = F.filter(_host_tokens(), lambda t: F.array_contains(F.col("_listed"), t))
    is_ip = lambda t: t.rlike(f"^{IP_PATTERN}$")
    first = F.array_min(F.transform(hit, lambda t: F.struct((~is_ip(t)).alias("o"), t.alias("bad"))))["bad"]
    return out.withColumn("_bad", F.when(named, first)).drop("_listed", "_own")


def _host_tokens() -> Column:
    """Addresses in the value, and its hosts with all their dot suffixes."""
    hosts = F.transform(F.regexp_extract_all("value", F.lit(HOST_PATTERN), F.lit(0)), lambda h: F.split(F.lower(h), r"\."))
    suffixes = F.flatten(F.transform(hosts, lambda h: F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_join(F.slice(h, i, F.size(h)), "."))))
    return F.array_distinct(F.concat(suffixes, F.regexp_extract_all("value", F.lit(IP_PATTERN), F.lit(0))))


def rescore(items: DataFrame, catalog: dict | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Adds ioc_match in rule order and raises severity to the highest floor of the matches, never lowers it.

    The catalog is small (a few hundred terms), so its terms are literals in
    one pass; so are its hosts, and those of the cases are broadcast while few.
    Adds boosted, whether the severity changed (I07).
    """
    catalog = CATALOG if catalog is None else catalog
    hay = F.lower(F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("evidence_type", F.lit(""))))
    found = bad_host_column(items, catalog, contexts).withColumn("_hay", hay)
    found = computed_once(found, "_ports", ports_in(F.col("_hay")))
    names, ranks, hits = [], [], []
    summary = F.coalesce(F.col("evidence_type").isin(SUMMARY_TYPES), F.lit(False))
    for rule in rule_list(catalog):
        if rule["kind"] == "terms":
            hit = any_of(F.col("_hay"), rule["values"])
        elif rule["kind"] == "ports":
            hit = F.arrays_overlap("_ports", F.array(*(F.lit(p) for p in rule["values"])))
        else:
            hit = F.col("_bad").isNotNull()
        hits.append(F.coalesce(hit, F.lit(False)) & ~summary)
        hit = F.get("_hits", F.lit(len(hits) - 1))  # names and ranks read each test's result, so that no test runs twice
        names.append(F.when(hit, F.concat(F.lit("bad_host:"), "_bad") if rule["kind"] == "hosts" else F.lit(rule["id"])))
        ranks.append(F.when(hit, severity_rank(F.lit(rule["severity"]))).otherwise(0))
    before = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    found = computed_once(found, "_hits", F.array(*hits))
    found = computed_once(found, "_hit", F.struct(F.array_compact(F.array(*names)).alias("names"), F.greatest(*ranks).alias("floor")))
    own, floor = severity_rank(F.col("severity")), F.col("_hit.floor")
    out = found.withColumn("ioc_match", F.array_distinct(F.concat(F.coalesce(before, F.array().cast("array<string>")), "_hit.names")))
    out = out.withColumn("boosted", floor > own).withColumn("severity", F.when(floor > own, severity_name(floor)).otherwise(F.col("severity")))
    return out.drop("_bad", "_hay", "_ports", "_hits", "_hit")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as _, trimmed of _; x if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("x"))


def derived_rows(items: DataFrame) -> DataFrame:
    """A new item for each term of the five families that a row holds; tree rows are skipped."""
    rules = [F.struct(F.lit(f).alias("family"), F.lit(n).alias("name"), F.lit(t).alias("term"), F.lit(s).alias("sev"), F.lit(c).alias("conf"), F.lit(text).alias("text")) for f, n, t, s, c, text in DERIVED_RULES]
    injection = F.struct(F.lit("injection").alias("family"), F.lit("").alias("name"), F.lit("").alias("term"), F.lit("critical").alias("sev"), F.lit(0.97).alias("conf"), F.lit("Process injection detected").alias("text"))
    low = F.lower(F.coalesce("value", F.lit("")))
    hits = F.filter(F.array(*rules), lambda r: F.contains(low, r["term"]))
    every = F.when(F.col("evidence_type") == "injected_code", F.concat(hits, F.array(injection))).otherwise(hits)
    rows = items.where(F.coalesce(F.col("evidence_type") != "process_tree", F.lit(True))).select("case_id", "artifact_id", F.explode(every).alias("r"))
    tail = F.when(F.col("r.family") == "injection", "").otherwise(F.concat(F.lit("_"), slug(F.col("r.name"))))
    return make_items(rows, F.concat(F.lit("ioc_"), F.col("r.family"), F.lit("_"), "artifact_id", tail), "ioc_engine", "ioc", F.col("r.text"), F.col("r.sev"), F.col("r.conf"), linked=F.array("artifact_id"), keep=("case_id",))


def techniques(items: DataFrame) -> DataFrame:
    """A row for each item and technique word it holds."""
    rules = F.array(*(F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("technique"), F.lit(n).alias("name")) for k, (t, n) in TECHNIQUES.items()))
    rows = items.select("case_id", "artifact_id", F.explode(F.filter(rules, lambda r: F.contains(F.lower(F.col("value")), r["keyword"]))).alias("r"))
    return rows.select("case_id", F.col("artifact_id").alias("source_id"), F.concat(F.lit("mitre_"), "r.technique").alias("artifact_id"), "r.technique", F.col("r.name").alias("technique_name"))


def run_totals(items: DataFrame) -> DataFrame:
    """Items, indicator rows and critical rows of each case."""
    return items.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(F.col("evidence_type") == "ioc").alias("iocs"), F.count_if(F.col("severity") == "critical").alias("critical"))
