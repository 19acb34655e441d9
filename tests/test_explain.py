"""Explanations: texts from vectors, lists under the foremost anomalies, tree rows."""

import numpy as np
from pyspark.sql import functions as F

from casewright.functions.signals import with_signals
from casewright.operators import correlate, dedup, explain, features, forest, lineage
from tests.test_correlation import items


def test_numbers_are_printed_as_in_c(spark):
    rng = np.random.default_rng(1)
    numbers = [0.0, -0.3125, 0.0625, 0.1235, -0.1235, 0.0005, 0.0015, 0.0025, 0.0035, 0.9995, -0.00005, 1.0, -1.0125, 2.5, 0.99999, *map(float, np.round(rng.random(300) * 2 - 1, 4)), *map(float, rng.random(100))]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (3, 4):
        got = df.select("x", explain.printed(F.col("x"), digits, plus=True).alias("t")).collect()
        assert [(r.x, r.t) for r in got] == [(x, f"{x:+.{digits}f}") for x in numbers]
    shares = [abs(x) for x in numbers if abs(x) <= 1]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", explain.percent(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(x, f"{x:.0%}") for x in shares]
    means = [0.0, 1.0, 0.25, 0.3333, 0.0005, 0.001, 0.75]
    got = spark.createDataFrame([(x,) for x in means], "x double").select(explain.plain(F.col("x"))).collect()
    assert [r[0] for r in got] == list(map(str, means))


def scored(spark, *rows):
    df = dedup.enrich(items(spark, *rows))
    return features.features(df.withColumn("family", features.model_scope(df)))


def test_the_chain_explains_every_item(spark):
    calm = [{"tool": "tshark", "type": "network_connection", "value": f"TCP 10.0.0.5 -> 9.9.9.{i % 3}:443 (10 bytes)"} for i in range(30)]
    bad = [{"tool": "tshark", "type": "network_connection", "value": "10.0.0.5 -> 9.9.9.9:4444 upload", "sev": "critical", "id": "bad"}, {"tool": "email", "type": "email", "value": "calm", "id": "mail"}]
    rows = scored(spark, *calm, *bad)
    found = {r.artifact_id: r for r in explain.score_items(rows, rows.where("artifact_id not in ('bad', 'mail')")).collect()}
    assert len(found) == 32
    b = found["bad"]
    assert b.is_anomaly and b.reason.startswith("Potentially malicious activity detected in network_connection artifact bad (anomaly score -") and "Primary indicator — C2 port: " in b.reason and b.reason.endswith('Observed value: "10.0.0.5 -> 9.9.9.9:4444 upload".')
    assert b.factors and abs(b.factors[0].phi) >= abs(b.factors[-1].phi) and "Check destination IP/domain reputation and related network sessions." in b.recommended_review
    assert b.plain_english.startswith("Artifact bad was flagged because its strongest anomaly drivers were ")
    assert [c.feature for c in b.comparisons][:3] == ["port_nonstandard", "port_is_known_c2", "keyword_c2_indicator"]
    assert not found["a0"].is_anomaly and found["a0"].reason.startswith("Artifact a0 (network_connection) matches expected baseline behaviour.") and found["a0"].recommended_review == []
    assert "mail" in found  # its family has no baseline of its own and takes all rows


def test_families_without_a_baseline_take_all_rows(spark):
    schema = "family string, " + ", ".join(f"{f} double" for f in features.FEATURES)
    base = spark.createDataFrame([("a", *[1.0] * 14), ("a", *[1.0] * 14), ("b", *[0.0] * 14)], schema)
    asked = spark.createDataFrame([("a",), ("new",)], "family string")
    assert sorted(r.family for r in explain.effective_baseline(asked, base).collect()) == ["a", "a", "b", "new", "new", "new"]


def test_section_lists_are_cut_and_ordered(spark):
    conn = {"tool": "tshark", "type": "network_connection", "value": "TCP 10.0.0.5 -> 9.9.9.9:4444 (1,500,000 bytes) (PID:7)", "sev": "critical"}
    rows = [conn | {"id": f"c{i}", "time": f"2024-01-02T00:{i:02d}:00Z"} for i in range(12)] + [{"tool": "tsk_fls", "type": "file_artifact", "time": "2024-01-01T12:00:00Z", "value": f"/tmp/f{i}.exe", "id": f"f{i}", "links": ["c1", "other"]} for i in range(4)]
    signals = with_signals(dedup.enrich(items(spark, *rows)))
    found = features.features(signals.withColumn("family", features.model_scope(signals)))
    baseline = found.where("artifact_id = 'f3'")
    told = explain.score_items(found, baseline, forest.rule_attribution(forest.distinct_vectors(found), baseline.withColumn("family", F.lit("network"))))
    section = explain.anomaly_section(told, signals).orderBy("row").collect()
    assert [(r.row, r.artifact_id) for r in section] == [(i + 1, f"c{i}") for i in range(8)]
    first = section[0]
    assert len(first.links) == 4 and [e.correlation_type for e in first.links] == ["exfiltration", "same_ip", "same_ip", "same_pid"] and first.links[3].matches == ["c1", "c2", "c3"] and first.n_exfiltration == 1
    assert {e.correlation_type: e.matches for e in first.links}["exfiltration"] == ["f0", "f1", "f2"]
    assert first.link_lines.split("\n")[0] == "- c0 via exfiltration using f0, f1, f2" and first.factor_lines.count("\n") == 4
    files = explain.foremost_links(signals, signals.where("artifact_id = 'f0'").select("case_id", "artifact_id")).collect()[0]
    assert (files.n_correlated, files.n_exfiltration) == (13, 12) and [e.anchor for e in files.links] == ["c0", "c1", "c10", "c11", "c2"]


def test_tree_summaries(spark):
    rows = [("c", "1", "0", "root", 1), ("c", "3", "1", "late", 9), ("c", "2", "1", "early", 2), *(("c", str(10 + i), str(9 + i) if i else "2", f"n{i}", 20 + i) for i in range(6)), ("c", "x", "y", "circle", 90), ("c", "y", "x", "circle", 91), ("d", "1", None, "alone", 1)]
    got = {(r.case_id, r.artifact_id): r.value for r in lineage.tree_summaries(spark.createDataFrame(rows, "case_id string, pid string, ppid string, name string, first_seq long")).collect()}
    deep = "\n".join(f"{'  ' * (i + 2)}n{i} (PID:{10 + i})" for i in range(4))
    assert got == {("c", "process_tree_1"): f"root (PID:1)\n  early (PID:2)\n{deep}\n  late (PID:3)", ("d", "process_tree_1"): "alone (PID:1)"}
    assert lineage.tree_summaries(spark.createDataFrame(rows, "case_id string, pid string, ppid string, name string, first_seq long").limit(0)).count() == 0


def test_wallet_checksums(spark):
    import hashlib
    import random

    from casewright.operators import extraction as ex

    def plain(address):
        n = 0
        for c in address:
            n = n * 58 + ex.BASE58.index(c)
        if n >= 1 << 200:
            return False
        data = n.to_bytes(25, "big")
        return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]

    def encoded(data):
        n, out = int.from_bytes(data, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = ex.BASE58[r] + out
        return "1" * (len(data) - len(data.lstrip(b"\0"))) + out

    rng, addresses = random.Random(2), []
    for _ in range(60):
        body = bytes([rng.choice([0, 5])]) + rng.randbytes(20)
        good = encoded(body + hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4])
        addresses += [good, good[:-1] + rng.choice(ex.BASE58), "".join(rng.choice(ex.BASE58) for _ in range(rng.randint(26, 35)))]
    got = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", ex.wallet_checks(F.col("a")).alias("ok")).collect()
    assert [(r.a, r.ok) for r in got] == [(a, plain(a)) for a in addresses] and sum(r.ok for r in got) >= 60
    assert not spark.createDataFrame([("0OIl",)], "a string").select(ex.wallet_checks(F.col("a"))).first()[0]
