"""Correlation of evidence items: shared keys, the transfer window and declared links.

Findings (one row each) and their members (one row for each member) are
separate tables, so that a hot key never becomes one huge array. Arrays are
nested only by nested_findings(), on request.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.signals import with_signals
from casewright.operators import dedup
from casewright.operators.intervals import DAY, HOUR, LEAST, SUM, UNION, counts_before, day_windows, micros
from casewright.schema import severity_rank
from casewright.session import checkpointed

#: Key columns with the names of the findings they make.
KINDS = {"pids": "same_pid", "ips": "same_ip", "file_keys": "same_file", "domains": "same_domain", "ts_bucket": "same_timestamp"}
# Fixed values of the correlation rules.
PROCESS_IDENTITY_TYPES = ["process", "commandline", "process_tree"]
TRANSFER_BYTES = 1_000_000
WINDOW_SECONDS = 24 * 60 * 60


def order_struct() -> Column:
    """A struct whose smallest value is the first row in evidence order."""
    matched = F.coalesce(F.size("ioc_match") > 0, F.lit(False))
    return F.struct((-severity_rank(F.col("severity"))).alias("r"), (~matched).alias("m"), (-F.coalesce("confidence", F.lit(0.5))).alias("c"), F.coalesce("source_tool", F.lit("")).alias("t"), F.col("seq").alias("s"))


def support_confidence(n_tools: Column, n_items: Column, base: int = 75) -> Column:
    """Base and 6 hundredths for each of up to 4 tools, 3 for each of up to 5 further items, at most 0.99."""
    hundredths = F.lit(base) + 6 * F.least(n_tools, F.lit(4)) + 3 * F.least(n_items - 1, F.lit(5))
    return F.least(hundredths, F.lit(99)) / 100.0


#: What the operators here read of an item with signals.
READ = ["case_id", "machine_id", "artifact_id", "seq", "source_tool", "evidence_type", "severity", "confidence", "linked_artifacts", "ioc_match", "ts", "ts_bucket", "pids", "ips", "paths", "file_keys", "domains", "bytes_transferred", "destination_ip", "destination_port"]


def held(items: DataFrame) -> DataFrame:
    """Items with signals, computed once and written without their texts, for work that reads them several times; of the paths the first stays."""
    first = F.slice("paths", 1, 1).alias("paths")
    return checkpointed(items.select(*(first if c == "paths" else c for c in READ if c in items.columns)))


def key_rows(items: DataFrame, *columns: str) -> DataFrame:
    """One row for each item and key of the given kinds (all by default), from one pass; expects with_signals()."""
    match = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    kinds = columns or tuple(KINDS)

    def keyed(c: str) -> Column:
        keys = F.array_distinct(F.col(c) if c != "ts_bucket" else F.array(c))
        return F.transform(keys, lambda k: F.struct(F.lit(KINDS[c]).alias("correlation_type"), k.alias("key")))

    machine = [c for c in ("machine_id",) if c in items.columns]
    rows = items.select("case_id", F.explode(F.concat(*map(keyed, kinds))).alias("_k"), *machine, "artifact_id", "source_tool", "evidence_type", "severity", "confidence", "seq", match.alias("ioc_match"))
    return rows.select("case_id", "_k.correlation_type", "_k.key", *rows.columns[2:]).where("key <> ''")


def shared_key_findings(items: DataFrame, *columns: str) -> DataFrame:
    """A row for each key that at least two items share and that passes the kind's rule.

    same_pid needs two tools or a type beyond those that restate a process;
    same_domain needs two tools or two types. Counts, the anchor (C06) and the
    tools are partial aggregates; no group is collected.
    """
    rows = key_rows(items, *columns).withColumn("_order", order_struct())
    informative = F.max((~F.col("evidence_type").isin(PROCESS_IDENTITY_TYPES)).cast("int"))
    tools = F.array_sort(F.collect_set(F.nullif(F.col("source_tool"), F.lit(""))))
    types = F.size(F.collect_set("evidence_type"))  # tools and types are few, so their sets are small
    groups = rows.groupBy("case_id", "correlation_type", "key").agg(F.count("*").alias("n_items"), tools.alias("source_tools"), types.alias("n_types"), informative.alias("informative"), F.min_by("artifact_id", "_order").alias("anchor"))
    several = F.size("source_tools") >= 2
    by_pid = (F.col("correlation_type") != "same_pid") | several | (F.col("informative") == 1)
    by_domain = (F.col("correlation_type") != "same_domain") | several | (F.col("n_types") >= 2)
    kept = groups.where((F.col("n_items") >= 2) & by_pid & by_domain)
    return kept.select("case_id", "correlation_type", "key", "anchor", "n_items", "source_tools", support_confidence(F.size("source_tools"), F.col("n_items")).alias("confidence"))


def finding_members(items: DataFrame, findings: DataFrame, *columns: str) -> DataFrame:
    """The members of shared-key findings: case_id, correlation_type, key, anchor, artifact_id, finding_confidence."""
    rows = key_rows(items, *columns).select("case_id", "correlation_type", "key", "artifact_id", "source_tool", "evidence_type", "seq")
    return rows.join(findings.select("case_id", "correlation_type", "key", "anchor", F.col("confidence").alias("finding_confidence")), ["case_id", "correlation_type", "key"])


def nested_findings(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Findings with their matches (members but the anchor) and artifacts as arrays, in seq order."""
    row = F.struct("seq", "artifact_id", "source_tool", "evidence_type")
    arrays = members.groupBy("case_id", "correlation_type", "key").agg(F.array_sort(F.collect_list(row)).alias("_m"))
    out = findings.join(arrays, ["case_id", "correlation_type", "key"], "left")
    matches = F.filter("_m", lambda m: m["artifact_id"] != F.col("anchor"))
    ids = F.array_distinct(F.concat(F.array("anchor"), F.transform("_m", lambda m: m["artifact_id"])))
    return out.withColumn("matches", matches).withColumn("artifacts", F.filter(ids, lambda i: i.isNotNull() & (i != ""))).drop("_m")


def transfers_after_files(items: DataFrame, same_machine: bool = False) -> DataFrame:
    """C09 pairs: large connections and the file events of the 24 hours before them (both ends count).

    An interval join as an equi-join: files are dealt to the bins of their day
    and the next, connections to their own day; then the exact bound applies.
    """
    day = lambda c: F.floor(F.unix_timestamp(c) / WINDOW_SECONDS)
    timed = items.where("ts is not null")
    conns = timed.where((F.col("evidence_type") == "network_connection") & (F.col("bytes_transferred") >= TRANSFER_BYTES))
    conns = conns.select("case_id", F.col("machine_id").alias("c_machine"), F.col("artifact_id").alias("conn_id"), F.col("seq").alias("conn_seq"), F.col("ts").alias("conn_ts"), F.col("source_tool").alias("conn_tool"), "bytes_transferred", "destination_ip", "destination_port", day("ts").alias("bin"))
    files = timed.where(F.size("file_keys") > 0)
    files = files.select("case_id", F.col("machine_id").alias("f_machine"), F.col("artifact_id").alias("file_id"), F.col("seq").alias("file_seq"), F.col("ts").alias("file_ts"), F.col("source_tool").alias("file_tool"), F.try_element_at("paths", F.lit(1)).alias("path"), F.explode(F.array(day("ts"), day("ts") + 1)).alias("bin"))
    if same_machine:  # a key of the join, so that no other pairs are made
        conns, files = (d.withColumn("_machine", F.col(m)) for d, m in ((conns, "c_machine"), (files, "f_machine")))
    on = ["case_id", "bin", *(["_machine"] if same_machine else [])]
    pairs = conns.join(files, on).where((F.col("file_ts") <= F.col("conn_ts")) & (F.col("file_ts") >= F.col("conn_ts") - F.expr("INTERVAL 24 HOURS")) & (F.col("conn_seq") != F.col("file_seq")))
    return pairs.drop("bin", "_machine")


def timed_points(items: DataFrame) -> DataFrame:
    """The slim rows that transfer windows need, computed once: file events and large connections with a time."""
    is_conn = (F.col("evidence_type") == "network_connection") & (F.col("bytes_transferred") >= TRANSFER_BYTES)
    rows = items.select("case_id", "machine_id", "artifact_id", "seq", "source_tool", "bytes_transferred", "destination_ip", "destination_port", micros("ts").alias("at"), F.try_element_at("paths", F.lit(1)).alias("path"), F.coalesce(F.size("file_keys") > 0, F.lit(False)).alias("is_file"), F.coalesce(is_conn, F.lit(False)).alias("is_conn"))
    return checkpointed(rows.where(F.col("at").isNotNull() & (F.col("is_file") | F.col("is_conn"))))


def exfiltration_findings(items: DataFrame, same_machine: bool = False) -> DataFrame:
    """One row for each large connection with file events in the 24 hours before it (both ends count).

    No pairs are made: windows are merged from a tree of time buckets. A
    connection that is a file event itself does not count as its own; where it
    would be the first one, the first of the others is taken.
    """
    return _exfiltration(timed_points(items), same_machine)


def _exfiltration(points: DataFrame, same_machine: bool = False) -> DataFrame:
    keys = ["case_id", "machine_id"] if same_machine else ["case_id"]
    is_file, is_conn = F.col("is_file"), F.col("is_conn")
    files = points.where(is_file).select(*keys, "at", F.lit(1).cast("long").alias("n_files"), F.struct("seq", "path").alias("first"), F.array("source_tool").alias("tools"))
    conns = points.where(is_conn).withColumn("begin", F.col("at") - DAY)
    windows = day_windows(files, conns, keys, {"n_files": SUM, "first": LEAST, "tools": UNION})
    per = conns.join(windows, [*keys, "begin"]).withColumn("n_files", F.col("n_files") - is_file.cast("int")).where("n_files > 0")
    # Of the files at the very time of a connection that is one itself, the first two tell which is the first other one.
    own = points.where(is_file & is_conn).select(*keys, "at").distinct()
    at_once = points.where(is_file).join(own, [*keys, "at"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "at").orderBy("seq"))).where("_n <= 2")
    other = points.where(is_file & is_conn).select(*keys, "at", F.col("seq").alias("conn")).join(at_once.select(*keys, "at", "seq", "path"), [*keys, "at"]).where("conn <> seq").groupBy(*keys, F.col("conn").alias("seq")).agg(F.min(F.struct("seq", "path")).alias("_other"))
    per = per.join(other, [*keys, "seq"], "left")
    first = F.when(is_file & (F.col("first.seq") == F.col("seq")), F.least("open_first", "_other")).otherwise(F.col("first"))
    tools = F.array_sort(F.array_distinct(F.concat(F.array("source_tool"), F.array_compact(F.coalesce("tools", F.array().cast("array<string>"))))))
    where = F.when(F.col("destination_port") > 0, F.concat_ws(":", "destination_ip", "destination_port")).otherwise(F.col("destination_ip"))
    return per.select("case_id", F.lit("exfiltration").alias("correlation_type"), F.col("artifact_id").alias("anchor"), "seq", "n_files", tools.alias("source_tools"), "bytes_transferred", where.alias("destination"), first["path"].alias("file"), support_confidence(F.size(tools), F.col("n_files") + 1, 82).alias("confidence"))


def _resolved_targets(items: DataFrame) -> DataFrame:
    """case_id, target, target_id, exact: for each wanted target the item of that id, else all whose id goes on with _ after it.

    Prefixes are equi-joined: every id is expanded to its beginnings before
    each _, so no comparison of all ids is needed.
    """
    ids = items.where("artifact_id <> ''").select("case_id", F.col("artifact_id").alias("target_id")).distinct()
    wanted = items.select("case_id", F.explode("linked_artifacts").alias("target")).where("target <> ''").distinct()
    exact = wanted.join(ids.withColumn("target", F.col("target_id")), ["case_id", "target"]).withColumn("exact", F.lit(True))
    parts = F.split("target_id", "_")
    starts = ids.where(F.contains("target_id", F.lit("_"))).select("case_id", "target_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))).alias("target"))
    by_prefix = wanted.join(exact.select("case_id", "target").distinct(), ["case_id", "target"], "left_anti").join(starts, ["case_id", "target"]).withColumn("exact", F.lit(False))
    return exact.unionByName(by_prefix)


def _declared(items: DataFrame) -> DataFrame:
    return items.select("case_id", F.col("artifact_id").alias("source_id"), "seq", F.explode("linked_artifacts").alias("target")).where("target <> ''")


def resolve_links(items: DataFrame) -> DataFrame:
    """source_id, seq, target, target_id: a row for each declared link and each item that its target means."""
    links = _declared(items).join(_resolved_targets(items).drop("exact"), ["case_id", "target"])
    return links.where("target_id <> source_id").select("case_id", "source_id", "seq", "target", "target_id")


#: A set of items as values that can be merged: its size, two sums of hashes that do not depend on order, the first item in evidence order, tools, and where its timed file events and other members lie.
_SET = {"n": SUM, "h1": SUM, "h2": SUM, "best": LEAST, "tools": UNION, "n_file": SUM, "low": LEAST, "least_high": LEAST, "other": LEAST}


def _member_facts(items: DataFrame) -> DataFrame:
    """case_id, artifact_id and the values of a set that holds this item alone; of rows that share an id the first in evidence order."""
    match = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    rows = items.where("artifact_id <> ''").select("case_id", "artifact_id", "source_tool", "severity", "confidence", "seq", match.alias("ioc_match"), micros("ts").alias("at"), (F.size("file_keys") > 0).alias("is_file"), ((F.col("evidence_type") == "network_connection") & (F.col("bytes_transferred") >= TRANSFER_BYTES)).alias("is_conn"))
    rows = rows.withColumn("_o", order_struct())
    is_file = F.coalesce(F.col("is_file") & F.col("at").isNotNull(), F.lit(False))
    hashed = lambda salt: F.xxhash64(F.lit(salt), F.col("artifact_id")).cast("decimal(38,0)")
    one = rows.select(
        "case_id", "artifact_id", F.lit(1).cast("long").alias("n"), hashed(1).alias("h1"), hashed(2).alias("h2"), F.struct("_o", "artifact_id").alias("best"), F.array_compact(F.array("source_tool")).alias("tools"),
        is_file.cast("long").alias("n_file"), F.when(is_file, F.col("at")).alias("low"), F.when(is_file, -F.col("at")).alias("least_high"),
        F.when(~is_file, F.struct(F.col("artifact_id"), F.when(F.col("is_conn"), F.col("at")).alias("at"))).alias("other"),
    )
    return one.groupBy("case_id", "artifact_id").agg(F.min_by(F.struct(*_SET), "best").alias("s")).select("case_id", "artifact_id", "s.*")


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(m.rows(F.col(c)).alias(c) for c, m in _SET.items()))


def _within_transfers(sets: DataFrame, transfers: DataFrame) -> DataFrame:
    """case_id, source_id of sets that lie within a transfer's window and the transfer itself.

    Bounds decide, not pairs: all members but the connection are file events, and
    the first and last of them lie in the 24 hours before it. Where all members
    are file events, some transfer must follow the last one before the first
    one's day is over.
    """
    sets = sets.withColumn("high", -F.col("least_high"))
    named = sets.where("n - n_file = 1 AND n_file > 0").where("high <= other.at AND low >= other.at - 86400000000").select("case_id", "source_id", F.col("other.artifact_id").alias("anchor"))
    by_name = named.join(transfers.select("case_id", "anchor").distinct(), ["case_id", "anchor"], "left_semi").select("case_id", "source_id")
    inside = sets.where("n = n_file AND high <= low + 86400000000")
    ends = inside.select("case_id", "source_id", F.col("high").alias("at"), (F.col("low") + DAY).alias("until"))
    counts = counts_before(transfers.select("case_id", "at"), ends.select("case_id", "at").union(ends.select("case_id", "until")), ["case_id"])
    upto = counts.select("case_id", F.col("at").alias("until"), "upto")
    by_time = ends.join(counts.select("case_id", "at", "below"), ["case_id", "at"]).join(upto, ["case_id", "until"]).where("upto > below").select("case_id", "source_id")
    return by_name.unionByName(by_time)


def link_sets(items: DataFrame, members: DataFrame | None = None, transfers: DataFrame | None = None) -> DataFrame:
    """C11: one row for each distinct set of linked items that no finding covers: source_id, seq, n_items, anchor, n_tools.

    No set is an array: sets are equal if their sizes and two order-free sums of
    64-bit hashes are. The items that one target means are merged once for all
    sources that declare it; only sources with several targets look at members
    one by one. members (case_id, finding, artifact_id) are those of findings
    with few members each, transfers (case_id, anchor, at) the transfer findings,
    whose windows are tested by their bounds.
    """
    facts = checkpointed(_member_facts(items))
    targets = checkpointed(_resolved_targets(items))
    links = _declared(items).where("source_id <> ''").join(targets.select("case_id", "target").distinct(), ["case_id", "target"], "left_semi").distinct()
    per = links.groupBy("case_id", "source_id", "seq").agg(F.count("*").alias("n_targets"), F.min("target").alias("target"))
    single = per.where("n_targets = 1").select("case_id", "source_id", "seq", "target")
    by_target = _merged(targets.withColumnRenamed("target_id", "artifact_id").join(facts, ["case_id", "artifact_id"]), "case_id", "target", "exact")
    prefixed = {c: F.col(f"_t_{c}") for c in _SET}
    found = single.join(by_target.select("case_id", "target", "exact", *(F.col(c).alias(f"_t_{c}") for c in _SET)), ["case_id", "target"])
    among = F.when(F.col("exact"), F.col("source_id") == F.col("target")).otherwise(F.col("source_id").startswith(F.concat("target", F.lit("_"))))
    found = found.withColumn("_in", among).where(~(F.col("_in") & (F.col("_t_n") == 1)))  # a link to oneself alone is none
    found = found.join(facts.withColumnRenamed("artifact_id", "source_id"), ["case_id", "source_id"])
    one = found.select("case_id", "source_id", "seq", "target", *(F.when(F.col("_in"), prefixed[c]).otherwise(m.columns(prefixed[c], F.col(c))).alias(c) for c, m in _SET.items()))
    several = per.where("n_targets > 1").select("case_id", "source_id", "seq")
    rows = links.join(several, ["case_id", "source_id", "seq"]).join(targets.drop("exact"), ["case_id", "target"]).where("target_id <> source_id")
    flat = checkpointed(rows.select("case_id", "source_id", "seq", F.explode(F.array("source_id", "target_id")).alias("artifact_id")).distinct())
    many = _merged(flat.join(facts, ["case_id", "artifact_id"]), "case_id", "source_id", "seq").withColumn("target", F.lit(None).cast("string"))
    first = F.min_by(F.struct("source_id", "seq", "target", *(c for c in _SET if c not in ("n", "h1", "h2"))), F.struct("seq", "source_id"))
    sets = checkpointed(one.unionByName(many).groupBy("case_id", "n", "h1", "h2").agg(first.alias("f")).select("case_id", "n", "h1", "h2", "f.*"))
    if members is not None:
        linked = targets.select("case_id", F.col("target_id").alias("artifact_id")).union(flat.select("case_id", "artifact_id")).union(sets.select("case_id", "source_id")).distinct()
        held = checkpointed(members.select("case_id", "finding", "artifact_id").join(linked, ["case_id", "artifact_id"], "left_semi").distinct())
        # A finding holds all of a target's items if it holds as many of them as there are; it must hold the source as well.
        size = by_target.select("case_id", "target", F.col("n").alias("_n"))
        whole = targets.select("case_id", "target", F.col("target_id").alias("artifact_id")).join(held, ["case_id", "artifact_id"]).groupBy("case_id", "target", "finding").count().join(size, ["case_id", "target"]).where("count = _n")
        of_source = sets.where("target is not null").select("case_id", "source_id", "target").join(held.withColumnRenamed("artifact_id", "source_id"), ["case_id", "source_id"])
        covered = of_source.join(whole.select("case_id", "target", "finding"), ["case_id", "target", "finding"], "left_semi").select("case_id", "source_id")
        rest = sets.where("target is null").select("case_id", "source_id", "seq", "n").join(flat, ["case_id", "source_id", "seq"]).join(held, ["case_id", "artifact_id"])
        covered = covered.unionByName(rest.groupBy("case_id", "source_id", "n", "finding").count().where("count = n").select("case_id", "source_id"))
        sets = sets.join(covered.distinct(), ["case_id", "source_id"], "left_anti")
    if transfers is not None:
        sets = checkpointed(sets)
        sets = sets.join(_within_transfers(sets, transfers).distinct(), ["case_id", "source_id"], "left_anti")
    return sets.select("case_id", F.lit("linked_artifact").alias("correlation_type"), "source_id", "seq", F.col("n").alias("n_items"), F.col("best.artifact_id").alias("anchor"), F.size("tools").alias("n_tools"))


def link_members(items: DataFrame, found: DataFrame) -> DataFrame:
    """The members of link findings, one row each: case_id, source_id, artifact_id."""
    rows = resolve_links(items).join(found.select("case_id", "source_id", "seq"), ["case_id", "source_id", "seq"])
    return rows.select("case_id", "source_id", F.explode(F.array("source_id", "target_id")).alias("artifact_id")).distinct()


def linked_findings(items: DataFrame, members: DataFrame | None = None, transfers: DataFrame | None = None) -> DataFrame:
    """C11 on request with the members as a sorted array: link_sets() and artifacts."""
    found = link_sets(items, members, transfers)
    arrays = link_members(items, found).groupBy("case_id", "source_id").agg(F.array_sort(F.collect_list("artifact_id")).alias("artifacts"))
    return found.join(arrays, ["case_id", "source_id"])


def link_confidence(found: DataFrame) -> DataFrame:
    """Adds the support confidence to declared-link findings."""
    return found.withColumn("confidence", support_confidence(F.col("n_tools"), F.col("n_items")))


def shared_members(items: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Members of shared-key findings: case_id, finding, correlation_type, anchor, artifact_id, finding_confidence."""
    rows = finding_members(items, shared_key_findings(items) if findings is None else findings)
    return rows.select("case_id", F.concat_ws("|", "correlation_type", "key").alias("finding"), "correlation_type", "anchor", "artifact_id", "finding_confidence")


def all_members(items: DataFrame) -> DataFrame:
    """Members of every shared-key and transfer finding: case_id, finding, correlation_type, anchor, artifact_id, finding_confidence.

    A whole list: a file event is a row for each transfer of the day after it.
    Counts, summaries and coverage do not need it; see item_findings(),
    machine_summary() and link_sets().
    """
    exfil = exfiltration_findings(items).select("case_id", F.col("anchor").alias("conn_id"), F.col("confidence").alias("finding_confidence"))
    pairs = transfers_after_files(items).select("case_id", "conn_id", F.explode(F.array("conn_id", "file_id")).alias("artifact_id")).distinct().join(exfil, ["case_id", "conn_id"])
    return shared_members(items).unionByName(pairs.select("case_id", F.concat(F.lit("exfiltration|"), "conn_id").alias("finding"), F.lit("exfiltration").alias("correlation_type"), F.col("conn_id").alias("anchor"), "artifact_id", "finding_confidence"))


def transfer_times(points: DataFrame) -> DataFrame:
    """The transfer findings with their times and machines: case_id, anchor, at, machine_id, confidence."""
    found = _exfiltration(points)
    return checkpointed(points.where("is_conn").select("case_id", "seq", "at", "machine_id").join(found.select("case_id", "seq", "anchor", "confidence"), ["case_id", "seq"]))


def item_findings(items: DataFrame) -> DataFrame:
    """For each item that a finding names: n_findings, the strongest one (ties to the first name) and its confidence.

    No pairs are made: the transfers of the day after a file event are merged
    from time buckets. Ids must be unique in a case, as first_wins() leaves them.
    """
    points = timed_points(items)
    best = lambda c, name: F.struct((-F.col(c)).alias("c"), name.alias("finding")).alias("best")
    shared = shared_members(items).groupBy("case_id", "artifact_id", "finding").agg(F.max("finding_confidence").alias("c"))
    shared = shared.select("case_id", "artifact_id", F.lit(1).cast("long").alias("n"), best("c", F.col("finding")))
    found = transfer_times(points).select("case_id", "anchor", "at", F.lit(1).cast("long").alias("n"), best("confidence", F.concat(F.lit("exfiltration|"), F.col("anchor"))))
    files = points.where("is_file").select("case_id", "artifact_id", F.col("at").alias("begin"))
    after = files.join(day_windows(found, files, ["case_id"], {"n": SUM, "best": LEAST}).select("case_id", "begin", "n", "best"), ["case_id", "begin"]).where("n > 0")
    own = found.join(points.where("is_file").select("case_id", F.col("artifact_id").alias("anchor")), ["case_id", "anchor"], "left_anti").select("case_id", F.col("anchor").alias("artifact_id"), "n", "best")
    every = shared.unionByName(after.select("case_id", "artifact_id", "n", "best")).unionByName(own)
    per = every.groupBy("case_id", "artifact_id").agg(F.sum("n").alias("n_findings"), F.min("best").alias("b"))
    return per.select("case_id", "artifact_id", "n_findings", F.col("b.finding").alias("strongest"), (-F.col("b.c")).alias("best_confidence"))


def with_findings(items: DataFrame) -> DataFrame:
    """C12 without lists: items with n_findings (0 for none), strongest and best_confidence."""
    return items.join(item_findings(items), ["case_id", "artifact_id"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def named_links(items: DataFrame) -> DataFrame:
    """case_id, artifact_id, link: an item's declared links that are the very name of a finding which names the item.

    Names of findings hold a bar, so only links with one are looked up: among the
    members of shared keys, and for a transfer by its connection and the two times.
    """
    links = checkpointed(items.select("case_id", "artifact_id", F.explode(F.filter("linked_artifacts", lambda x: F.contains(x, F.lit("|")))).alias("link")).distinct())
    if links.isEmpty():
        return links
    keyed = key_rows(items).select("case_id", "artifact_id", F.concat_ws("|", "correlation_type", "key").alias("link"), "correlation_type", "key").join(links, ["case_id", "artifact_id", "link"], "left_semi")
    shared = keyed.join(shared_key_findings(items).select("case_id", "correlation_type", "key"), ["case_id", "correlation_type", "key"], "left_semi").select(links.columns)
    points = timed_points(items)
    ends = transfer_times(points).select("case_id", F.concat(F.lit("exfiltration|"), "anchor").alias("link"), "anchor", "at")
    files = points.where("is_file").select("case_id", "artifact_id", F.col("at").alias("_at"))
    ended = links.join(ends, ["case_id", "link"]).join(files, ["case_id", "artifact_id"], "left")
    return shared.unionByName(ended.where((F.col("anchor") == F.col("artifact_id")) | F.col("_at").between(F.col("at") - DAY, F.col("at"))).select(links.columns)).distinct()


def annotate(items: DataFrame, members: DataFrame) -> DataFrame:
    """Items with n_findings, their strongest confidence, and all their findings by confidence as an array.

    The arrays are whole; where counts or the strongest finding will do, use with_findings().
    """
    one = members.groupBy("case_id", "artifact_id", "finding").agg(F.max("finding_confidence").alias("c"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "finding")))
    per = one.groupBy("case_id", "artifact_id").agg(F.count("*").alias("n_findings"), F.max("c").alias("best_confidence"), listed.alias("_f"))
    out = items.join(per, ["case_id", "artifact_id"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return out.withColumn("correlations", F.coalesce(F.transform("_f", lambda f: f["finding"]), F.array().cast("array<string>"))).drop("_f")


def all_findings(items: DataFrame) -> DataFrame:
    """The shared-key, transfer and link findings in one table, strongest first; links that a finding covers are left out."""
    points = timed_points(items)
    exfil = checkpointed(_exfiltration(points))
    times = points.where("is_conn").select("case_id", "seq", "at").join(exfil.select("case_id", "seq", "anchor"), ["case_id", "seq"])
    shared = checkpointed(shared_key_findings(items))
    links = link_confidence(link_sets(items, shared_members(items, shared), times))
    out = shared.select("case_id", "correlation_type", "key", "anchor", "n_items", "confidence")
    out = out.unionByName(exfil.select("case_id", "correlation_type", F.col("anchor").alias("key"), "anchor", (F.col("n_files") + 1).alias("n_items"), "confidence"))
    out = out.unionByName(links.select("case_id", "correlation_type", F.col("source_id").alias("key"), "anchor", "n_items", "confidence"))
    return out.orderBy(F.desc("confidence"), "correlation_type", "anchor")


def _transfers_by_machine(points: DataFrame) -> DataFrame:
    """case_id, machine_id, n: the transfer findings that name an item of a machine.

    The days after a machine's file events are joined to stretches, from one row
    for each of its hours; the transfers of the case inside them are counted by
    differences of running counts. A machine's own transfers that no file event
    of it precedes come on top.
    """
    found = transfer_times(points)
    hours = points.where("is_file").groupBy("case_id", "machine_id", (F.col("at") - F.pmod("at", F.lit(HOUR))).alias("hour")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy("case_id", "machine_id").orderBy("hour")  # a row for each hour with file events
    apart = hours.withColumn("_new", F.coalesce(F.col("first") > F.lag("last").over(w) + DAY, F.lit(True)).cast("int")).withColumn("stretch", F.sum("_new").over(w))
    stretches = checkpointed(apart.groupBy("case_id", "machine_id", "stretch").agg(F.min("first").alias("at"), (F.max("last") + DAY).alias("until")))
    counts = checkpointed(counts_before(found, stretches.select("case_id", "at").union(stretches.select("case_id", "until")), ["case_id"]))
    inside = stretches.join(counts.select("case_id", "at", "below"), ["case_id", "at"]).join(counts.select("case_id", F.col("at").alias("until"), "upto"), ["case_id", "until"])
    own = found.select("case_id", "machine_id", (F.col("at") - DAY).alias("begin"))
    files = points.where("is_file").select("case_id", "machine_id", "at", F.lit(1).cast("long").alias("n"))
    before = day_windows(files, own, ["case_id", "machine_id"], {"n": SUM}).where("n = 0").select("case_id", "machine_id", "begin")
    alone = own.join(before, ["case_id", "machine_id", "begin"], "left_semi").select("case_id", "machine_id", F.lit(1).cast("long").alias("n"))
    return inside.select("case_id", "machine_id", (F.col("upto") - F.col("below")).alias("n")).unionByName(alone).groupBy("case_id", "machine_id").agg(F.sum("n").alias("n"))


def machine_summary(items: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Items and findings for each machine of a case, and the case's totals in the row without a machine.

    With members, those of any findings; without, the shared-key and transfer findings of the items, counted without pairs.
    """
    counts = items.rollup("case_id", "machine_id").agg(F.count("*").alias("n_items")).where("case_id is not null")
    if members is not None:
        touched = members.select("case_id", "finding", "artifact_id").join(items.select("case_id", "artifact_id", "machine_id"), ["case_id", "artifact_id"])
        found = touched.rollup("case_id", "machine_id").agg(F.countDistinct("finding").alias("n_findings")).where("case_id is not null")
    else:
        points, key = timed_points(items), ["case_id", "correlation_type", "key"]
        shared = checkpointed(shared_key_findings(items).select(*key))
        touched = key_rows(items).select(*key, "machine_id").distinct().join(shared, key, "left_semi").groupBy("case_id", "machine_id").agg(F.count("*").alias("n"))
        whole = shared.select("case_id").unionByName(_exfiltration(points).select("case_id")).groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(None).cast("string").alias("machine_id"), "n")
        found = touched.unionByName(_transfers_by_machine(points)).groupBy("case_id", "machine_id").agg(F.sum("n").alias("n")).unionByName(whole).withColumnRenamed("n", "n_findings")
    joined = counts.alias("a").join(found.alias("b"), (F.col("a.case_id") == F.col("b.case_id")) & F.col("a.machine_id").eqNullSafe(F.col("b.machine_id")), "left")
    return joined.select("a.case_id", "a.machine_id", "n_items", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


@dataclass
class Aggregated:
    """C17: aggregate()'s items with their signals, and what follows from them; each table is made when asked for."""

    signals: DataFrame

    def items(self) -> DataFrame:
        """Items with place, their number in evidence order in the case, and their finding counts."""
        return dedup.placed(with_findings(self.signals), "case_id")

    def findings(self) -> DataFrame:
        return all_findings(self.signals)

    def index(self) -> DataFrame:
        return dedup.group_index(self.signals)

    def machines(self) -> DataFrame:
        return machine_summary(self.signals)


def aggregate(raw: DataFrame, contexts: DataFrame | None = None, rescore: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """C17: first-wins, cross-tool reconciliation, re-scoring, enrichment and signals over all cases, written once.

    Aggregated() gives the findings, order, index and machines of the result.
    """
    items = dedup.reconcile_tools(dedup.first_wins(raw))
    if rescore is not None:
        items = rescore(items)
    return checkpointed(with_signals(dedup.enrich(items, contexts)))
