"""Explanations of scored items: what drives a score, how it differs from the baseline, what it is linked to, what to review.

All that depends on the feature vector alone is made once for each distinct
vector; items add their names, values, links and counts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import percent
from casewright.operators import correlate, forest
from casewright.operators.features import ANOMALY_BELOW, FEATURES, baseline_difference, final_score, indicator_ranking, record_value

# Names of features in texts, and the sentences of the explanation model.
SHOWN = {"port_nonstandard": "port_is_nonstandard", "has_network_activity": "has_network"}
SENTENCES = {
    "port_is_known_c2": ("C2 port", "Network connection established on a known command-and-control port (commonly used by Metasploit, Netcat, or custom RAT frameworks)."),
    "path_has_exe_in_temp": ("EXE dropped in Temp", "An executable file was written to a user-writable Temp/AppData path, a hallmark of dropper-stage malware or exploit delivery."),
    "keyword_c2_indicator": ("C2 keyword in value", "The artifact description contains terms associated with reverse shells, C2 beaconing, or remote-access tooling."),
    "is_suspicious_process": ("Suspicious process", "The process binary is on the known LOLBin / malware watchlist (e.g., certutil, mshta, mimikatz, or a named malware sample)."),
    "suspicious_parent": ("Suspicious parent process", "The process was spawned by a shell or scripting host (cmd.exe, powershell.exe, wscript.exe), which is abnormal for legitimate system services."),
    "keyword_exfil": ("Data exfiltration indicator", "Keywords consistent with data exfiltration were detected (e.g., outbound upload, DNS tunnelling, or covert POST request)."),
    "path_in_temp": ("Temp/AppData path", "File or process path is rooted in a Temp or AppData subdirectory – commonly abused for staging malware away from Program Files."),
    "port_nonstandard": ("Non-standard port", "Network activity observed on a port outside the common web-traffic set, suggesting custom protocol or evasion of standard firewall rules."),
    "evidence_is_network": ("Network evidence type", "The artifact is a network connection record; combined with other indicators this increases lateral-movement or beaconing likelihood."),
    "evidence_is_file": ("File-system evidence", "A suspicious filesystem artifact was observed; treat as potential persistence mechanism or dropped payload."),
    "evidence_is_email": ("Email evidence", "Email artefact detected; may indicate phishing delivery or data exfiltration via mail channel."),
    "is_system_process": ("System process anomaly", "A core Windows system process exhibited behaviour deviating from the normal baseline (unexpected parent or network activity)."),
    "has_network_activity": ("Network activity", "Network connectivity was recorded; alone this is low-signal but elevates risk when combined with other indicators."),
}
MEANINGS = {
    "is_system_process": "A core Windows process showed unusual behavior.",
    "is_suspicious_process": "The process name matches a known LOLBin or suspicious tool.",
    "suspicious_parent": "The parent process is commonly abused for script or shell execution.",
    "port_nonstandard": "The connection used a non-standard network port.",
    "port_is_known_c2": "The connection used a port commonly associated with command-and-control.",
    "has_network_activity": "The artifact contains network activity.",
    "evidence_is_file": "The artifact is filesystem evidence.",
    "evidence_is_network": "The artifact is network evidence.",
    "evidence_is_email": "The artifact is email evidence.",
    "path_in_temp": "The path is in a user-writable staging directory.",
    "path_has_exe_in_temp": "An executable appeared in Temp/AppData/Downloads.",
    "keyword_c2_indicator": "The artifact contains C2, beacon, shell, or RAT indicators.",
    "keyword_exfil": "The artifact contains data exfiltration indicators.",
    "severity_score": "The original evidence severity increased the anomaly score.",
}
ACTIONS = {
    "is_system_process": "Inspect the process tree and loaded modules for the system process.",
    "is_suspicious_process": "Validate the process hash, command line, and execution location.",
    "suspicious_parent": "Review parent-child process lineage around the artifact timestamp.",
    "port_nonstandard": "Confirm whether the destination port is expected for this host.",
    "port_is_known_c2": "Check destination IP/domain reputation and related network sessions.",
    "has_network_activity": "Correlate this artifact with firewall, proxy, and packet-capture logs.",
    "evidence_is_file": "Review file hash, signer, creation time, and adjacent filesystem events.",
    "evidence_is_network": "Pivot on source, destination, protocol, and session timing.",
    "evidence_is_email": "Inspect sender, headers, links, attachments, and recipient activity.",
    "path_in_temp": "Check whether the path was used for staging or payload execution.",
    "path_has_exe_in_temp": "Quarantine or hash the executable and inspect persistence paths.",
    "keyword_c2_indicator": "Search for repeated beaconing, reverse shells, or remote-access tooling.",
    "keyword_exfil": "Review outbound transfer volume, destination, and sensitive data access.",
    "severity_score": "Correlate with the original evidence source that assigned severity.",
}
MANUAL_REVIEW = "Manually review the artifact and correlate it with nearby timeline events."
INCREASED, REDUCED = "increased anomaly likelihood", "reduced anomaly likelihood"
#: Factors, comparisons, links and actions that an explanation shows, and anomalies of a case.
LISTED, ANOMALIES = 5, 8


def printed(x: Column, digits: int, plus: bool = False) -> Column:
    """A number below 8 in magnitude as printf("%.*f") writes it: rounded by its exact binary value, ties to even."""
    size = F.abs(x)
    small = size < 1 / 256  # two scales, so that all bits of the number that matter are held
    unit = F.when(small, F.lit(Decimal(1 << 70)).cast("decimal(22,0)")).otherwise(F.lit(Decimal(1 << 60)).cast("decimal(22,0)"))
    scaled = (size * F.when(small, float(1 << 70)).otherwise(float(1 << 60))).cast("bigint").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(6,0)")
    left = F.pmod(scaled, unit)
    whole = ((scaled - left) / unit).cast("decimal(10,0)").cast("bigint")
    up = (2 * left > unit) | ((2 * left == unit) & (whole % 2 == 1))
    n = whole + up.cast("int")
    body = F.concat((n / 10**digits).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0")) if digits else n.cast("string")
    return F.concat(F.when(x < 0, "-").otherwise("+" if plus else ""), body)


def plain(x: Column) -> Column:
    """A number with a point and no exponent, as short as it can be."""
    small = F.rtrim(F.regexp_replace(x.cast("decimal(12,4)").cast("string"), "0+$", ""))
    return F.when((F.abs(x) < 0.001) & (x != 0), small).otherwise(x.cast("string"))


def _named(feature: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(p) for pair in names.items() for p in pair)), feature)


def shown(feature: Column) -> Column:
    return F.coalesce(_named(feature, SHOWN), feature)


def effective_baseline(families: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline rows of each family (family and features), or all of them for a family that has none."""
    rows = baseline.select("family", *FEATURES)
    bare = families.select("family").distinct().join(rows.select("family").distinct(), "family", "left_anti")
    every = rows.groupBy(*FEATURES).agg(F.count("*").alias("_n"))  # distinct vectors, so few rows meet the few families without a baseline
    copies = bare.join(every, F.lit(True)).select("family", *FEATURES, F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("col")
    return rows.unionByName(copies)


def explained_vectors(vectors: DataFrame, baseline: DataFrame, factors: DataFrame) -> DataFrame:
    """vectors (family and features) with factors and comparisons, the LISTED foremost of each as arrays of structs.

    factors: family, features, feature, phi. A factor below zero drives the
    score towards an anomaly. Both children are ranked and cut before they meet
    their vectors.
    """
    key = ["family", *FEATURES]
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("phi")), F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(FEATURES) for x in (f, i))), F.col("feature")))
    top = factors.select(*key, "feature", "phi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)
    value = F.element_at(F.create_map(*(x for f in FEATURES for x in (F.lit(f), F.col(f)))), F.col("feature"))
    factor = F.struct("rank", "feature", value.alias("value"), "phi", F.when(F.col("phi") < 0, INCREASED).otherwise(REDUCED).alias("direction"))
    nested = top.groupBy(*key).agg(F.array_sort(F.collect_list(factor)).alias("factors"))
    differences = baseline_difference(vectors, baseline, FEATURES, LISTED)
    compared = differences.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "x", "mean", "difference", F.concat("direction", F.lit(" baseline")).alias("direction")))).alias("comparisons"))
    same = lambda d, tag: d.select(*(F.col(c).alias(f"_{tag}_{c}") for c in key), d.columns[-1])
    out = vectors
    for tag, d in (("f", nested), ("c", compared)):
        on = [F.col(c) == F.col(f"_{tag}_{c}") for c in key]
        out = out.join(same(d, tag), on, "left").drop(*(f"_{tag}_{c}" for c in key))
        out = out.withColumn(d.columns[-1], F.coalesce(d.columns[-1], F.array().cast(d.schema[d.columns[-1]].dataType)))
    return out


def vector_texts(known: DataFrame) -> DataFrame:
    """Adds all texts that depend on the vector alone to scored vectors with factors and comparisons.

    said_*: parts of sentences; technical_explanation; recommended_review (at
    most LISTED different actions of the drivers, a general one for an anomaly
    without any); and the lists of factors, comparisons and actions as lines.
    """
    # Each list is made once, in its own step, and read by the texts after it.
    rows = known.withColumns({"drivers": F.filter("factors", lambda f: f["direction"] == INCREASED), "leads": indicator_ranking()})
    found = F.array_distinct(F.transform("drivers", lambda f: _named(f["feature"], ACTIONS)))
    above = F.filter("comparisons", lambda c: c["direction"] == "above baseline")
    rows = correlate.checkpointed(rows.withColumns({
        "recommended_review": F.slice(F.when(F.col("is_anomaly") & (F.size(found) == 0), F.array(F.lit(MANUAL_REVIEW))).otherwise(found), 1, LISTED),
        "_chosen": F.slice(F.when(F.size(above) > 0, above).otherwise(F.col("comparisons")), 1, 2),
        "said_score": printed(F.col("score"), 3, plus=True), "said_final": printed(F.col("score"), 4, plus=True), "said_percent": percent(F.col("anomaly_confidence")),
        "_model": printed(F.col("model_score"), 4, plus=True), "_rule": printed(F.col("rule_score"), 4, plus=True),
        "factors": F.transform("factors", lambda f: f.withField("shap", printed(f["phi"], 4, plus=True))), "drivers": F.transform("drivers", lambda f: f.withField("shap", printed(f["phi"], 4, plus=True))),
    }))
    sentence = lambda f: _named(f, {k: s for k, (_, s) in SENTENCES.items()})
    label = _named(F.col("leads")[0], {k: name for k, (name, _) in SENTENCES.items()})
    more = F.slice("leads", 2, 2)
    phrase = lambda f: F.concat(shown(f["feature"]), F.lit(" ("), _named(f["feature"], MEANINGS), F.lit("; SHAP "), f["shap"], F.lit(")"))
    piece = lambda c: F.concat(shown(c["feature"]), F.lit(" was "), c["direction"], F.lit(" (artifact "), plain(c["x"]), F.lit(", baseline "), plain(c["mean"]), F.lit(")"))
    lines = lambda column, line, nothing: F.when(F.size(column) == 0, nothing).otherwise(F.array_join(F.transform(column, line), "\n"))
    return correlate.checkpointed(rows.withColumns({
        "said_indicators": F.when(F.size("leads") > 0, F.concat(label, F.lit(": "), sentence(F.col("leads")[0]), F.when(F.size(more) > 0, F.concat(F.lit(" Additionally: "), F.array_join(F.transform(more, sentence), " "))).otherwise(""))),
        "said_meanings": F.when(F.size("drivers") > 0, F.array_join(F.transform(F.slice("drivers", 1, 3), lambda f: F.rtrim(_named(f["feature"], MEANINGS), F.lit("."))), ", ")),
        "said_drivers": F.when(F.size("drivers") == 0, "the combined feature pattern deviated from the trained baseline").otherwise(F.array_join(F.transform(F.slice("drivers", 1, 3), phrase), ", ")),
        "said_comparison": F.when(F.size("_chosen") > 0, F.concat(F.lit("Compared with the relevant normal baseline, "), F.array_join(F.transform("_chosen", piece), "; "), F.lit("."))),
        "said_scoring": F.concat(F.lit("The final anomaly score was "), "said_final", F.lit(f" against threshold {ANOMALY_BELOW:+.4f}, with confidence "), "said_percent", F.lit(".")),
        "said_review": F.when(F.size("recommended_review") > 0, F.concat(F.lit("Recommended review: "), F.array_join(F.slice("recommended_review", 1, 3), " "))),
        "technical_explanation": F.concat(F.lit("Model score "), "_model", F.lit(", rule score "), "_rule", F.lit(", final score "), "said_final", F.lit(f", threshold {ANOMALY_BELOW:+.4f}, confidence "), "said_percent", F.lit(".")),
        "factor_lines": lines("factors", lambda f: F.concat(F.lit("- "), shown(f["feature"]), F.lit(": "), f["direction"], F.lit(" (SHAP "), f["shap"], F.lit(") — "), _named(f["feature"], MEANINGS)), "_No SHAP factors recorded._"),
        "comparison_lines": lines("comparisons", lambda c: F.concat(F.lit("- "), shown(c["feature"]), F.lit(": artifact="), plain(c["x"]), F.lit(", baseline="), plain(c["mean"]), F.lit(", "), c["direction"]), "_No baseline comparison recorded._"),
        "review_lines": lines("recommended_review", lambda a: F.concat(F.lit("- "), a), "_No review actions recorded._"),
    }).drop("_chosen", "_model", "_rule"))


def reason(items: DataFrame) -> Column:
    """The reason in prose: the leading indicator, up to two more, and the observed value; expects the texts of the vector."""
    kind, value = F.lower("evidence_type"), F.substring(record_value(items), 1, 120)
    named = F.concat(F.lit("Artifact "), "artifact_id", F.lit(" ("), kind, F.lit(")"))
    calm = F.concat(named, F.lit(" matches expected baseline behaviour. No suspicious indicators were triggered. Anomaly score "), "said_score", F.lit(" is within the normal operating range."))
    odd = F.concat(named, F.lit(" was flagged as statistically anomalous (score "), "said_score", F.lit(') due to a combination of feature values that deviate from the trained baseline. Manual review is recommended: "'), value, F.lit('".'))
    bad = F.concat(F.lit("Potentially malicious activity detected in "), kind, F.lit(" artifact "), "artifact_id", F.lit(" (anomaly score "), "said_score", F.lit(", confidence "), "said_percent", F.lit("). Primary indicator — "), "said_indicators", F.lit(' Observed value: "'), value, F.lit('".'))
    return F.when(~F.col("is_anomaly"), calm).when(F.col("said_indicators").isNull(), odd).otherwise(bad)


def plain_english() -> Column:
    named = F.concat(F.lit("Artifact "), "artifact_id")
    driven = F.concat(named, F.lit(" was flagged because its strongest anomaly drivers were "), "said_meanings", F.lit("."))
    below = F.concat(named, F.lit(" was flagged because its final score fell below the anomaly threshold."))
    calm = F.concat(named, F.lit(" appears consistent with the trained baseline for this "), F.lower("evidence_type"), F.lit(" evidence."))
    return F.when(~F.col("is_anomaly"), calm).otherwise(F.coalesce(driven, below))


def explain_instance(items: DataFrame) -> Column:
    """The whole explanation as one paragraph; expects the texts of the vector, links (an array), n_correlated and n_exfiltration."""
    place = F.when(F.trim(F.coalesce("machine_id", F.lit(""))) != "", F.concat(F.lit(" on "), F.trim("machine_id"))).otherwise("")
    name = F.concat(F.lit("Artifact "), "artifact_id", place)
    opening = F.when(F.col("is_anomaly"), F.concat(name, F.lit(" was classified as anomalous because "), "said_drivers", F.lit("."))).otherwise(F.concat(name, F.lit(" was not classified as anomalous because its final score stayed within the expected baseline range.")))
    value, kind = F.substring(record_value(items), 1, 180), F.lower("evidence_type")
    observed = F.when(value != "", F.concat(F.lit("Observed evidence ("), kind, F.lit('): "'), value, F.lit('".'))).otherwise(F.concat(F.lit("Observed evidence type: "), kind, F.lit(".")))
    held = lambda e: F.when(F.size(e["matches"]) > 0, F.concat(F.lit(" with matching values "), F.array_join(e["matches"], ", "))).otherwise("")
    link = lambda e: F.concat(e["anchor"], F.lit(" via "), e["correlation_type"], held(e))
    linked = F.when(F.size("links") > 0, F.concat(F.lit("P4 correlation links this artifact to "), F.array_join(F.transform(F.slice("links", 1, 3), link), "; "), F.lit(".")))
    parts = F.array_compact(F.array(
        F.when(F.col("n_correlated") > 0, F.concat(F.lit("it appears in "), F.col("n_correlated").cast("string"), F.lit(" aggregator correlation finding(s)"))),
        F.when(F.col("n_exfiltration") > 0, F.concat(F.lit("it appears in "), F.col("n_exfiltration").cast("string"), F.lit(" exfiltration finding(s)"))),
    ))
    case = F.when(F.size(parts) > 0, F.concat(F.lit("At the case level, "), F.array_join(parts, " and "), F.lit(".")))
    return F.concat_ws(" ", opening, F.trim(observed), "said_comparison", linked, case, "said_scoring", "said_review")


def score_items(items: DataFrame, baseline: DataFrame, factors: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The whole chain over items with family and features: model, rule and final scores, factors, comparisons and texts.

    Each distinct vector is scored, attributed, compared and described once;
    items join the result by their vector and add reason and plain_english.
    Without factors, Shapley values of the final score are computed. A family
    without baseline rows uses all of them. vectors: the items' distinct ones, if
    they were written already (forest.held_vectors()).
    """
    vectors = forest.held_vectors(items) if vectors is None else vectors
    base = forest.held_baseline(effective_baseline(vectors, baseline))
    trees = forest.fit_forest(base)
    scored = correlate.checkpointed(final_score(forest.model_scores(vectors, base, trees), F.col("model_score")))
    found = forest.attribution(vectors, base, trees, most=LISTED) if factors is None else factors
    known = vector_texts(explained_vectors(scored, base, found))
    key = ["family", *FEATURES]
    slim = known.select(*(F.col(c).alias(f"_v_{c}") for c in key), *(c for c in known.columns if c not in key))
    rows = items.join(forest.sent(slim, vectors), [F.col(c) == F.col(f"_v_{c}") for c in key]).drop(*(f"_v_{c}" for c in key))
    return rows.withColumns({"reason": reason(rows), "plain_english": plain_english()})


def foremost_links(items: DataFrame, wanted: DataFrame, most: int = LISTED) -> DataFrame:
    """case_id, artifact_id, links, n_correlated, n_exfiltration for wanted items (case_id, artifact_id), which should be few.

    links: the `most` strongest findings that name an item (ties by kind and
    key), each with its anchor and the first three other members, then the links
    it declares itself. Findings are ranked before their members are looked up,
    and transfers are paired with wanted items alone.
    """
    item = ["case_id", "artifact_id"]
    wanted = wanted.select(*item).distinct()
    shared = correlate.shared_key_findings(items)
    keys = correlate.key_rows(items)
    named = keys.join(wanted, item, "left_semi").select(*item, "correlation_type", "key").distinct().join(shared.select("case_id", "correlation_type", "key", "anchor", "confidence"), ["case_id", "correlation_type", "key"])
    exfil = correlate.exfiltration_findings(items).select("case_id", F.col("anchor").alias("key"), "correlation_type", "anchor", "confidence")
    is_conn = F.coalesce((F.col("evidence_type") == "network_connection") & (F.col("bytes_transferred") >= correlate.TRANSFER_BYTES), F.lit(False))
    around = items.join(wanted.withColumn("_w", F.lit(True)), item, "left").where(F.col("_w") | is_conn).withColumn("file_keys", F.when(F.col("_w"), F.col("file_keys")).otherwise(F.array().cast("array<string>")))
    after = correlate.transfers_after_files(around).select("case_id", F.col("file_id").alias("artifact_id"), F.col("conn_id").alias("key"))
    own = exfil.join(wanted.withColumnRenamed("artifact_id", "key"), ["case_id", "key"], "left_semi").select("case_id", F.col("key").alias("artifact_id"), "key")
    moved = after.union(own).distinct().join(exfil, ["case_id", "key"])
    every = named.unionByName(moved.select(named.columns))
    counts = every.groupBy(*item).agg(F.count("*").alias("n_correlated"), F.count_if(F.col("correlation_type") == "exfiltration").alias("n_exfiltration"))
    place = F.row_number().over(Window.partitionBy(*item).orderBy(F.desc("confidence"), "correlation_type", "key"))
    top = every.withColumn("place", place).where(F.col("place") <= most)
    chosen = top.select("case_id", "correlation_type", "key", "anchor").distinct()
    first = lambda by: F.row_number().over(Window.partitionBy("case_id", "correlation_type", "key").orderBy(by))
    members = keys.select("case_id", "correlation_type", "key", "artifact_id", "seq").join(chosen, ["case_id", "correlation_type", "key"])
    conns = items.join(chosen.where("correlation_type = 'exfiltration'").select("case_id", F.col("key").alias("artifact_id"), F.lit(True).alias("_w")), item, "left").where(F.col("_w") | (F.size("file_keys") > 0))
    files = correlate.transfers_after_files(conns.withColumn("bytes_transferred", F.when(F.col("_w"), F.col("bytes_transferred")).otherwise(0)))
    files = files.select("case_id", F.lit("exfiltration").alias("correlation_type"), F.col("conn_id").alias("key"), F.col("file_id").alias("artifact_id"), F.col("file_seq").alias("seq"), F.col("conn_id").alias("anchor"))
    others = members.where("artifact_id <> anchor").select(files.columns).unionByName(files).withColumn("n", first("seq")).where("n <= 3")
    matches = others.groupBy("case_id", "correlation_type", "key").agg(F.array_sort(F.collect_list(F.struct("n", "artifact_id"))).alias("m"))
    entry = F.struct("place", "anchor", "correlation_type", F.coalesce(F.transform("m", lambda m: m["artifact_id"]), F.array().cast("array<string>")).alias("matches"))
    nested = top.join(matches, ["case_id", "correlation_type", "key"], "left").groupBy(*item).agg(F.array_sort(F.collect_list(entry)).alias("found"))
    out = wanted.join(items.select(*item, "linked_artifacts"), item).join(nested, item, "left").join(counts, item, "left")
    none = F.array().cast(nested.schema["found"].dataType)
    found = F.coalesce("found", none)
    declared = F.array_distinct(F.filter(F.coalesce("linked_artifacts", F.array().cast("array<string>")), lambda x: x.isNotNull() & ~F.exists(found, lambda f: f["anchor"] == x)))
    more = F.transform(declared, lambda x: F.struct(F.lit(0).alias("place"), x.alias("anchor"), F.lit("linked_artifact").alias("correlation_type"), F.array().cast("array<string>").alias("matches")))
    return out.select(*item, F.slice(F.concat(found, more), 1, most).alias("links"), F.coalesce("n_correlated", F.lit(0)).alias("n_correlated"), F.coalesce("n_exfiltration", F.lit(0)).alias("n_exfiltration"))


def anomaly_section(scored: DataFrame, items: DataFrame, groups: tuple[str, ...] = ("case_id",), most: int = ANOMALIES) -> DataFrame:
    """Each group's first `most` anomalies by seq with the explanation and the lists of factors, comparisons, links and actions.

    scored: score_items(); items: the items with signals that links come from.
    Anomalies are cut first (Spark limits the rows before the shuffle), so
    links are looked up for few items only. Lists without entries are texts that say so.
    """
    w = Window.partitionBy(*groups).orderBy("seq")
    top = scored.where("is_anomaly").withColumn("row", F.row_number().over(w)).where(F.col("row") <= most)
    top = correlate.checkpointed(top)
    rows = top.join(foremost_links(items, top), ["case_id", "artifact_id"])
    held = lambda e: F.when(F.size(e["matches"]) > 0, F.concat(F.lit(" using "), F.array_join(e["matches"], ", "))).otherwise("")
    line = lambda e: F.concat(F.lit("- "), e["anchor"], F.lit(" via "), e["correlation_type"], held(e))
    links = F.when(F.size("links") == 0, "_No P4 correlation context recorded._").otherwise(F.array_join(F.transform("links", line), "\n"))
    return rows.withColumns({"explain_instance": explain_instance(rows), "link_lines": links})
