from pyspark.sql import functions as F

from casewright.functions.signals import with_signals
from casewright.operators import correlate, dedup, indicators

SCHEMA = "case_id string, machine_id string, seq long, artifact_id string, source_tool string, evidence_type string, timestamp string, value string, severity string, confidence double, linked_artifacts array<string>"


def items(spark, *rows):
    full = [(r.get("case", "c"), r.get("machine", "m"), i, r.get("id", f"a{i}"), r.get("tool", "t"), r.get("type", "process"), r.get("time", ""), r.get("value", ""), r.get("sev", "low"), r.get("conf", 0.5), r.get("links", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def signals(spark, *rows):
    return with_signals(dedup.enrich(items(spark, *rows)))


def test_first_wins(spark):
    got = dedup.first_wins(items(spark, {"id": "1", "tool": "a"}, {"id": "2"}, {"id": "1", "tool": "b"}, {"id": ""}, {"id": None}, {"id": ""}))
    assert sorted(r.seq for r in got.collect()) == [0, 1, 3, 4, 5]


def test_strongest_wins(spark):
    got = dedup.strongest_wins(items(spark, {"value": "X "}, {"value": "x", "sev": "high"}, {"value": "x", "links": ["p"]}, {"value": "y", "conf": 0.9}))
    assert sorted((r.seq, r.severity) for r in got.collect()) == [(0, "high"), (2, "low"), (3, "low")]


def test_reconcile(spark):
    second = {"tool": "memprocfs", "type": "memprocfs_process"}
    first = {"tool": "volatility3", "value": "a.exe (PID:10 PPID:1)"}
    rows = [first, second | {"value": "a.exe (PID:10 PPID:1)"}, second | {"value": "b.exe (PID:11 PPID:10)"}, second | {"value": "no id"}]
    assert sorted(r.seq for r in dedup.reconcile_tools(items(spark, *rows)).collect()) == [0, 2, 3]
    assert dedup.reconcile_tools(items(spark, *rows[1:])).count() == 3


def test_order(spark):
    df = items(spark, {"id": "a", "sev": "low"}, {"id": "b", "sev": "critical"}, {"id": "c", "sev": "high"}, {"id": "d", "sev": "high", "conf": 0.9})
    df = df.withColumn("ioc_match", F.when(F.col("artifact_id") == "c", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    assert [r.artifact_id for r in dedup.in_order(df).collect()] == ["b", "c", "d", "a"]


def test_same_pid_needs_news(spark):
    df = signals(spark, {"value": "csrss.exe (PID:596)"}, {"type": "injected_code", "value": "regions (PID:596)"}, {"value": "System (PID:4)"}, {"type": "commandline", "value": "System pid 4"})
    assert [r.key for r in correlate.shared_key_findings(df, "pids").collect()] == ["596"]


def test_same_domain_needs_two_sources(spark):
    df = signals(
        spark,
        {"tool": "tshark", "type": "dns_query", "value": "query → killswitch.com"}, {"tool": "volatility3", "type": "suspicious_domain", "value": "www.killswitch.com"},
        {"tool": "volatility3", "type": "suspicious_domain", "value": "benign.com"}, {"tool": "volatility3", "type": "suspicious_domain", "value": "www.benign.com"},
        {"tool": "tshark", "type": "http_request", "value": "drop-host.xyz/tasksche.exe"}, {"tool": "tshark", "type": "dns_query", "value": "drop-host.xyz"},
    )
    assert {r.key for r in correlate.shared_key_findings(df, "domains").collect()} == {"killswitch.com", "drop-host.xyz"}


def test_transfer_window(spark):
    conn = {"tool": "tshark", "type": "network_connection", "time": "2024-01-02T00:00:00Z", "value": "TCP 10.0.0.5 -> 185.220.101.47:4444 (1,500,000 bytes)"}
    rows = [conn, {"type": "file_artifact", "time": "2024-01-01T00:00:00Z", "value": "C:\\Temp\\payload.exe"}, {"type": "file_artifact", "time": "2023-12-31T23:59:59Z", "value": "C:\\Temp\\early.exe"}, {"type": "file_artifact", "time": "1704153600", "value": "/tmp/same"}, {"type": "file_artifact", "time": "2024-01-02T00:00:01Z", "value": "/tmp/late"}]
    (r,) = correlate.exfiltration_findings(signals(spark, *rows)).collect()
    assert (r.destination, r.bytes_transferred, r.n_files) == ("185.220.101.47:4444", 1_500_000, 2) and r.file.endswith("payload.exe")


def test_links(spark):
    df = signals(spark, {"id": "rel", "links": ["proc_59", "proc_7", "none"]}, {"id": "proc_59_a_exe"}, {"id": "proc_596_b_exe"}, {"id": "proc_7"}, {"id": "proc_7_c_exe"})
    got = {(r.target, r.target_id) for r in correlate.resolve_links(df).collect()}
    assert got == {("proc_59", "proc_59_a_exe"), ("proc_7", "proc_7")}
    (found,) = correlate.linked_findings(df).collect()
    assert found.artifacts == ["proc_59_a_exe", "proc_7", "rel"]
    members = spark.createDataFrame([("c", "f", a) for a in ("proc_59_a_exe", "proc_7", "rel", "x")], "case_id string, finding string, artifact_id string")
    assert correlate.linked_findings(df, members).count() == 0
    assert correlate.linked_findings(df, members.where("artifact_id <> 'rel'")).count() == 1


def test_annotation_counts_once(spark):
    df = signals(spark, {"id": "t", "type": "process_tree", "value": "all (PID:5)"}, {"id": "p", "value": "x (PID:5)"}, {"id": "i", "type": "injected_code", "value": "y (PID:5)"})
    got = {r.artifact_id: r for r in correlate.annotate(df, correlate.all_members(df)).collect()}
    assert got["t"].n_findings == 0 and got["p"].n_findings == 1 and got["p"].correlations == ["same_pid|5"]
    nested = correlate.nested_findings(f := correlate.shared_key_findings(df, "pids"), correlate.finding_members(df, f, "pids")).collect()
    assert nested[0].artifacts == ["i", "p"] or nested[0].artifacts == ["p", "i"]


def test_machines(spark):
    df = signals(spark, {"machine": "m1", "id": "p", "value": "x (PID:5)"}, {"machine": "m2", "id": "i", "type": "injected_code", "value": "y (PID:5)"})
    got = {r.machine_id: (r.n_items, r.n_findings) for r in correlate.machine_summary(df, correlate.all_members(df)).collect()}
    assert got == {"m1": (1, 1), "m2": (1, 1), None: (2, 1)}


def rescored(spark, *rows, contexts=None):
    return {r.artifact_id: r for r in indicators.rescore(items(spark, *rows), contexts=contexts).collect()}


def test_catalog_terms_boost_only(spark):
    got = rescored(
        spark,
        {"id": "kill", "value": "iuqerfsodp9ifjaposdfjhgosurijfaewrwergwea.com"}, {"id": "onion", "value": "abc.onion"}, {"id": "wallet", "value": "13AM4VW2dhxYgXeQepoHkHSQuy6NgaEb94"},
        {"id": "wnry", "value": "b.wnry"}, {"id": "wncry", "value": "x.wncry"}, {"id": "high", "value": "b.wnry", "sev": "critical"}, {"id": "tree", "type": "process_tree", "value": "tasksche.exe"}, {"id": "none", "value": "calm"},
    )
    assert {k: r.severity for k, r in got.items()} == {"kill": "high", "onion": "high", "wallet": "critical", "wnry": "high", "wncry": "critical", "high": "critical", "tree": "low", "none": "low"}
    assert got["tree"].ioc_match == [] and not got["high"].boosted and got["wncry"].boosted and got["wnry"].ioc_match == ["wannacry_payload"]


def test_ports(spark):
    got = rescored(spark, {"id": "a", "value": "10.0.0.1:4444"}, {"id": "b", "value": "dst port 4444"}, {"id": "c", "value": "4444 bytes"}, {"id": "d", "value": "dport=31337"})
    assert {k: r.severity for k, r in got.items()} == {"a": "critical", "b": "critical", "c": "low", "d": "critical"}


def test_reputation_knows_hosts_and_cases(spark):
    contexts = spark.createDataFrame([("c", ["Own-Bad.net.", "9.9.9.9"]), ("other", ["else.net"])], "case_id string, known_bad_hosts array<string>")
    got = rescored(
        spark,
        {"id": "dom", "value": "GET rapid-craft567.com/x"}, {"id": "sub", "value": "a.b.rapid-craft567.com"}, {"id": "ip", "value": "to 165.245.215.18:443"}, {"id": "like", "value": "notrapid-craft567.com"},
        {"id": "longer", "value": "1165.245.215.180"}, {"id": "own", "value": "x.own-bad.net"}, {"id": "own_ip", "value": "9.9.9.9"}, {"id": "else", "value": "else.net"}, {"id": "else_case", "case": "other", "value": "else.net"},
        contexts=contexts,
    )
    hits = {k: r.ioc_match for k, r in got.items() if r.ioc_match}
    assert hits == {"dom": ["bad_host:rapid-craft567.com"], "sub": ["bad_host:rapid-craft567.com"], "ip": ["bad_host:165.245.215.18"], "own": ["bad_host:own-bad.net"], "own_ip": ["bad_host:9.9.9.9"], "else_case": ["bad_host:else.net"]}


def test_derived_rows_have_their_own_ids(spark):
    got = indicators.derived_rows(items(spark, {"id": "x", "value": "powershell.exe from cmd.exe in Temp"}, {"id": "t", "type": "process_tree", "value": "cmd.exe"}, {"id": "i", "type": "injected_code", "value": ""})).collect()
    ids = [r.artifact_id for r in got]
    assert sorted(ids) == ["ioc_dll_x_temp", "ioc_injection_i", "ioc_proc_x_cmd_exe", "ioc_proc_x_powershell_exe"]


def test_transfer_windows_equal_pairs(spark):
    """Counts, tools and first files of every window as from all pairs, with connections that are file events themselves."""
    import random

    rng = random.Random(6)
    start = 1_700_000_000
    rows = []
    for i in range(700):
        conn = rng.random() < 0.3
        keys = ["k"] if not conn or rng.random() < 0.4 else []
        rows.append((f"c{i % 2}", f"m{i % 3}", f"a{i}", i, start + rng.choice([rng.randint(0, 4 * 86400), 3600 * rng.randint(0, 96)]), rng.choice(["t1", "t2", None]), "network_connection" if conn else "file", rng.choice([5, 2_000_000]), keys, [f"p{i}"] if keys else [], "1.2.3.4", 80))
    df = spark.createDataFrame(rows, "case_id string, machine_id string, artifact_id string, seq long, t long, source_tool string, evidence_type string, bytes_transferred long, file_keys array<string>, paths array<string>, destination_ip string, destination_port int").withColumn("ts", F.timestamp_seconds("t"))
    for same in (False, True):
        want = {}
        for c in rows:
            if c[6] == "network_connection" and c[7] >= 1_000_000:
                files = [f for f in rows if f[8] and f[0] == c[0] and f[3] != c[3] and c[4] - 86400 <= f[4] <= c[4] and (not same or f[1] == c[1])]
                if files:
                    want[c[2]] = (len(files), sorted({x for x in [c[5], *(f[5] for f in files)] if x}), min(files, key=lambda f: f[3])[9][0])
        got = {r.anchor: (r.n_files, [t for t in r.source_tools if t], r.file) for r in correlate.exfiltration_findings(df, same).collect()}
        assert got == want and len(want) > 20


def random_items(spark, n=600, seed=5):
    """Items with shared keys, transfers, own file events of connections, and links of every kind."""
    import random

    rng = random.Random(seed)
    start, rows = 1_700_000_000, []
    for i in range(n):
        conn, file = rng.random() < 0.2, rng.random() < 0.4
        links = rng.choice([[], [], [f"a_{rng.randrange(40)}"], [f"a_{rng.randrange(n // 40)}_{rng.randrange(n)}"], [f"a_{i % (n // 40)}_{i}"], [f"a_{rng.randrange(40)}", f"b_{rng.randrange(5)}"], [f"a_{i % (n // 40)}"]])
        keys = [f"k{rng.randrange(300)}"] if file else []
        rows.append((f"c{i % 2}", f"m{rng.randrange(4)}", f"a_{i % (n // 40)}_{i}" if i % 9 else f"b_{i % 5}_{i}", i, start + rng.choice([rng.randint(0, 6 * 86400), 3600 * rng.randint(0, 150)]) + rng.choice([0.0, 0.25]), rng.choice(["t1", "t2"]), "network_connection" if conn else "file", rng.choice(["low", "high"]), rng.choice([0.5, 0.9]), links, [f"{rng.randrange(80)}"] if rng.random() < 0.5 else [], keys, [f"p{i}"] if keys else [], 2_000_000))
    schema = "case_id string, machine_id string, artifact_id string, seq long, t double, source_tool string, evidence_type string, severity string, confidence double, linked_artifacts array<string>, pids array<string>, file_keys array<string>, paths array<string>, bytes_transferred long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).withColumn("ts_bucket", F.lit("")).withColumn("destination_ip", F.lit("9.9.9.9")).withColumn("destination_port", F.lit(1))
    none = F.array().cast("array<string>")
    return df.withColumn("ips", none).withColumn("domains", none)


def test_counts_without_pairs_equal_whole_lists(spark):
    df = random_items(spark)
    members = correlate.all_members(df).cache()
    listed = {(r.case_id, r.artifact_id): r for r in correlate.annotate(df, members).where("n_findings > 0").collect()}
    counted = {(r.case_id, r.artifact_id): r for r in correlate.item_findings(df).collect()}
    assert listed.keys() == counted.keys() and max(r.n_findings for r in listed.values()) > 10
    for key, r in listed.items():
        assert (r.n_findings, r.best_confidence, r.correlations[0]) == (counted[key].n_findings, counted[key].best_confidence, counted[key].strongest)
    by_members = sorted(map(tuple, correlate.machine_summary(df, members).collect()), key=str)
    assert sorted(map(tuple, correlate.machine_summary(df).collect()), key=str) == by_members
    members.unpersist()


def test_link_sets_equal_plain_sets(spark):
    df = random_items(spark)
    rows = df.collect()
    ids = {(r.case_id, r.artifact_id) for r in rows}
    wanted = {}
    for r in sorted(rows, key=lambda r: r.seq):
        found = set()
        for t in r.linked_artifacts:
            found |= {t} if (r.case_id, t) in ids else {a for c, a in ids if c == r.case_id and a.startswith(t + "_")}
        if found - {r.artifact_id}:
            wanted.setdefault((r.case_id, frozenset(found | {r.artifact_id})), r.artifact_id)
    every = {(r.case_id, frozenset(r.artifacts)): r for r in correlate.linked_findings(df).collect()}
    assert {k: r.source_id for k, r in every.items()} == wanted and all(len(k[1]) == r.n_items == len(r.artifacts) for k, r in every.items())
    members = correlate.all_members(df).collect()
    within = {}
    for m in members:
        within.setdefault((m.case_id, m.finding), set()).add(m.artifact_id)
    open_sets = {k: s for k, s in wanted.items() if not any(c == k[0] and k[1] <= held for (c, _), held in within.items())}
    transfers = correlate.transfer_times(correlate.timed_points(df))
    got = {(r.case_id, r.source_id): r for r in correlate.link_sets(df, correlate.shared_members(df), transfers).collect()}
    assert {(c, s) for (c, _), s in open_sets.items()} == got.keys() and 0 < len(open_sets) < len(wanted)


def test_one_hour_holds_all_events(spark):
    """Everything in one hour, much of it in one second: the same windows as from pairs, with microseconds telling times apart."""
    rows = [("c", "m", f"a{i}", i, 1_700_000_000.0 + (i % 7) * 0.000001 + (i % 3) * 60, "t", "network_connection" if i % 5 == 0 else "file", 2_000_000, [] if i % 5 == 0 and i % 2 else ["k"], [f"p{i}"]) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id string, machine_id string, artifact_id string, seq long, t double, source_tool string, evidence_type string, bytes_transferred long, file_keys array<string>, paths array<string>").withColumn("ts", F.timestamp_micros((F.round(F.col("t") * 1_000_000)).cast("long"))).withColumn("destination_ip", F.lit("")).withColumn("destination_port", F.lit(0))
    pairs = correlate.transfers_after_files(df).groupBy("conn_id").agg(F.count("*").alias("n"), F.min_by("path", "file_seq").alias("p")).collect()
    assert {r.anchor: (r.n_files, r.file) for r in correlate.exfiltration_findings(df).collect()} == {r.conn_id: (r.n, r.p) for r in pairs}


def test_all_findings_of_one_item_are_listed(spark):
    df = spark.createDataFrame([("c", "a", 1)], "case_id string, artifact_id string, seq int")
    members = spark.range(150).select(F.lit("c").alias("case_id"), F.concat(F.lit("f"), "id").alias("finding"), F.lit("a").alias("artifact_id"), (F.col("id") / 200).alias("finding_confidence"))
    (r,) = correlate.annotate(df, members).collect()
    assert r.n_findings == 150 and len(r.correlations) == 150 and r.correlations[0] == "f149"


def test_aggregate_runs_the_whole_chain(spark):
    rows = [
        {"tool": "volatility3", "value": "a.exe (PID:10 PPID:1)"}, {"tool": "memprocfs", "type": "memprocfs_process", "value": "a.exe (PID:10 PPID:1)"}, {"id": "a0", "value": "again"},
        {"tool": "tshark", "type": "network_connection", "time": "2024-01-02T00:00:00Z", "value": "TCP 10.0.0.5 -> 9.9.9.9:4444 (1,500,000 bytes) (PID:10)"}, {"type": "file_artifact", "time": "2024-01-01T12:00:00Z", "value": "C:\\Temp\\x.exe", "machine": ""},
    ]
    contexts = spark.createDataFrame([("c", ["WS-1"])], "case_id string, affected_systems array<string>")
    done = correlate.Aggregated(correlate.aggregate(items(spark, *rows), contexts, indicators.rescore))
    found = {r.correlation_type for r in done.findings().collect()}
    assert found == {"same_pid", "exfiltration"}
    kept = done.items().orderBy("place").collect()
    assert [r.place for r in kept] == [1, 2, 3] and kept[0].artifact_id == "a3" and {r.machine_id for r in kept} == {"m", "WS-1"}
    assert {(r.kind, r.key): r.n for r in done.index().collect()}[("machine", "WS-1")] == 1
    assert {r.machine_id: r.n_findings for r in done.machines().collect()} == {"m": 2, "WS-1": 1, None: 2}


def test_many_hosts_of_cases_are_joined(spark, monkeypatch):
    """The hosts of cases give the same matches broadcast and joined."""
    contexts = spark.createDataFrame([("c", ["own-bad.net", "9.9.9.9", None]), ("other", ["else.net"]), ("none", None)], "case_id string, known_bad_hosts array<string>")
    rows = [{"id": "own", "value": "x.own-bad.net"}, {"id": "ip", "value": "9.9.9.9"}, {"id": "else", "value": "else.net"}, {"id": "else_case", "case": "other", "value": "a.else.net"}, {"id": "calm", "case": "none", "value": "own-bad.net"}]
    wanted = {k: r.ioc_match for k, r in rescored(spark, *rows, contexts=contexts).items()}
    assert wanted["own"] == ["bad_host:own-bad.net"] and wanted["else"] == wanted["calm"] == []
    for name in ("BROADCAST_HOSTS", "CASE_HOSTS"):
        monkeypatch.setattr(indicators, name, 1)
        assert {k: r.ioc_match for k, r in rescored(spark, *rows, contexts=contexts).items()} == wanted
        monkeypatch.undo()
