import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import classify, dedup, features, forest, lineage, report
from tests.test_correlation import items


def test_classes_ties_and_default(spark):
    texts = spark.createDataFrame([(1, "Ransom note, files encrypted"), (2, "quiet"), (3, "stolen malware"), (4, None)], "n int, text string")
    got = {r.n: (r.case_type, r.classifier_confidence) for r in classify.class_score(texts).collect()}
    assert got == {1: ("ransomware", 0.7), 2: ("unknown", 0.35), 3: ("data_exfiltration", 0.6), 4: ("unknown", 0.35)}


def test_headings_are_no_hosts(spark):
    texts = spark.createDataFrame([("INCIDENT REPORT SYN-2026-0615-RANSOM on WIN-VICTIM-22 and DC01 via HTTPS from 10.1.2.3",)], "text string")
    assert classify.affected_systems(texts).first().affected_systems == ["10.1.2.3", "WIN-VICTIM-22", "DC01"]


def test_narrowing_keeps_the_claim(spark):
    rows = spark.createDataFrame([(["pcap", "memory_dump"], ["pcap", "junk"]), (["pcap"], []), (["pcap"], None)], "artifact_types array<string>, provided_types array<string>")
    got = [(r.artifact_types, r.artifact_types_claimed) for r in classify.narrow_types(rows).collect()]
    assert got == [(["pcap"], ["pcap", "memory_dump"]), (["pcap"], None), (["pcap"], None)]


ONTOLOGY = "name string, input_types array<string>, dependencies array<string>, case_relevance map<string,double>, default_order int, args_template map<string,boolean>"


def test_analysers_are_ranked_and_ordered(spark):
    ontology = spark.createDataFrame([("net", ["pcap"], [], {"phishing": 0.9}, 2, {}), ("mem", ["memory_dump"], ["net"], {"unknown": 0.8}, 1, {}), ("log", ["log_files"], [], {}, 3, {})], ONTOLOGY)
    contexts = spark.createDataFrame([("a", "phishing", ["pcap"]), ("b", "phishing", ["pcap", "memory_dump"])], "case_id string, case_type string, artifact_types array<string>")
    chosen = classify.select_analysers(contexts, ontology)
    assert sorted((r.case_id, r["rank"], r.name, r.relevance) for r in chosen.collect()) == [("a", 1, "net", 0.9), ("b", 1, "net", 0.9), ("b", 2, "mem", 0.8)]
    plan = classify.plan_rows(classify.dependency_levels(chosen))
    assert sorted((r.case_id, r.order, r.name) for r in plan.collect()) == [("a", 1, "net"), ("b", 1, "net"), ("b", 2, "mem")]


def test_circles_are_errors(spark):
    chosen = spark.createDataFrame([("c", "x", ["y"], 1), ("c", "y", ["x"], 2)], "case_id string, name string, dependencies array<string>, rank int")
    with pytest.raises(Exception, match="circle"):
        classify.dependency_levels(chosen).collect()


def test_reconciliation(spark):
    kinds = ["suspicious_crypto", "file_artifact", "suspicious_domain", "registry_key"]
    rows = items(spark, *({"case": "r", "type": t} for t in kinds), *({"case": "n", "type": t} for t in ("network_connection", "http_request", "dns_query")))
    contexts = spark.createDataFrame([("r", "ransomware", 0.9), ("n", "insider_threat", 0.8), ("e", "ransomware", 0.7), ("u", "unknown", 0.5)], "case_id string, case_type string, classifier_confidence double")
    got = {r.case_id: r for r in classify.reconcile(contexts, rows).collect()}
    assert not got["r"].diverged and got["r"].reconciled_confidence == 0.9
    assert got["n"].diverged and got["n"].reconciled_confidence == 0.4 and got["n"].suggested_type == "data_exfiltration"
    assert got["e"].reconciled_confidence == 0.7 and not got["e"].diverged and got["u"].reconciled_confidence == 0.5


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    base = (rng.random((6, len(features.FEATURES))) < 0.4).astype(float)
    rows = [("fam", *map(float, base[rng.integers(0, 6)])) for _ in range(n)]
    return spark.createDataFrame(rows, "family string, " + ", ".join(f"{f} double" for f in features.FEATURES))


def test_forest_scores_odd_rows_lower(spark):
    rng = np.random.default_rng(3)
    normal = [("fam", *map(float, (rng.random(14) < 0.1))) for _ in range(200)]
    schema = "family string, " + ", ".join(f"{f} double" for f in features.FEATURES)
    baseline = spark.createDataFrame(normal, schema)
    odd = spark.createDataFrame([("fam", *[1.0] * 14), ("fam", *[0.0] * 14)], schema)
    got = {r.is_system_process: r.model_score for r in forest.model_scores(odd, baseline, forest.fit_forest(baseline, trees=60)).collect()}
    assert got[1.0] < got[0.0]


def test_shapley_values_add_up_and_vectors_collapse(spark):
    rows = vectors(spark, 300)
    baseline = vectors(spark, 90, 2).limit(80)
    distinct = forest.distinct_vectors(rows)
    assert distinct.count() <= 6 and distinct.agg(F.sum("n_rows")).first()[0] == 300
    assert forest.background(baseline).count() <= 64
    out = forest.attribution(distinct, baseline, forest.fit_forest(baseline, trees=20), most=14).collect()
    assert out and all(abs(r.total_phi - (r.score - r.base_score)) < 1e-9 for r in out)
    again = forest.attribution(distinct, baseline, forest.fit_forest(baseline, trees=20), most=14).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert forest.attribution(distinct.limit(0), baseline, forest.fit_forest(baseline, trees=2)).count() == 0


def test_features_from_text(spark):
    df = items(spark, {"type": "process", "value": "svchost.exe spawned by cmd.exe"}, {"type": "network_connection", "value": "10.0.0.1:4444 upload (PID:596)", "sev": "critical"}, {"type": "file_artifact", "value": "C:\\Temp\\x.exe"})
    a, b, c = (r.asDict() for r in features.features(df).orderBy("seq").collect())
    assert a["is_system_process"] == a["suspicious_parent"] == 1.0
    assert b["port_is_known_c2"] == b["port_nonstandard"] == b["keyword_exfil"] == b["severity_score"] == b["has_network_activity"] == 1.0
    assert c["path_has_exe_in_temp"] == c["path_in_temp"] == c["evidence_is_file"] == 1.0


def indicators_of(spark, **row):
    df = items(spark, row)
    return [tuple(i) for i in df.select(report.item_indicators(df).alias("i")).first().i]


def test_item_indicators(spark):
    assert indicators_of(spark, type="dns_query", value="host → evil.xyz") == [("Domain", "evil.xyz")]
    assert indicators_of(spark, type="suspicious_domain", value="abc.onion") == [("Onion Address", "abc.onion")]
    assert indicators_of(spark, type="suspicious_crypto", value="bc1qxyz") == [("Crypto Wallet", "bc1qxyz")]
    assert indicators_of(spark, type="network_connection", value="10.0.0.1 8.8.8.8 999.1.1.1 172.20.1.1 172.32.0.1") == [("IP Address", "8.8.8.8"), ("IP Address", "172.32.0.1")]
    assert indicators_of(spark, type="process", value="a.exe (PID:1)") == []
    assert indicators_of(spark, type="process", sev="high", value="@WanaDecryptor@ (PID:740)") == [("Suspicious File", "@WanaDecryptor@")]
    assert indicators_of(spark, type="process_tree", sev="critical", value="a.exe") == []
    assert indicators_of(spark, type="registry_key", value="HKLM\\Run") == [("Registry Key", "HKLM\\Run")]
    assert indicators_of(spark, type="x", value="d41d8cd98f00b204e9800998ecf8427e") == [("MD5 Hash", "d41d8cd98f00b204e9800998ecf8427e")]


def test_elevated_indicators_surface_and_the_rest_folds(spark):
    rows = [{"id": f"d{i}", "type": "suspicious_domain", "value": f"host{i:03}.com", "conf": 0.45 if i % 2 else 0.2} for i in range(120)]
    scored = spark.createDataFrame([("c", "d7", "critical")], "case_id string, artifact_id string, severity string")
    rollup = report.indicator_rollup(items(spark, *rows), scored)
    assert [r.indicator for r in rollup.where("surfaced").collect()] == ["host007.com"]
    sample = report.folded_sample(rollup).orderBy("row").collect()
    assert len(sample) == 50 and all(r.tier == "anchored" for r in sample)


def test_key_findings_drop_echoes(spark):
    df = items(spark, {"id": "echo", "type": "ioc", "sev": "critical", "value": "Process injection detected"}, {"id": "real", "sev": "high", "value": "evil.exe (PID:1)"}, {"id": "same", "sev": "high", "value": "evil.exe (PID:1)"}, {"id": "tree", "type": "process_tree", "sev": "critical", "value": "evil.exe"})
    got = report.key_findings(df).collect()
    assert [(r.artifact_id, r.indicators, r.n_findings) for r in got] == [("real", "Suspicious File: evil.exe", 1)]
    assert report.key_findings(items(spark, *({"value": "calm"} for _ in range(12)))).count() == 10


def test_word_cut(spark):
    df = spark.createDataFrame([("one two three",), ("abcdefghijklmnop",), ("short",)], "t string")
    assert [r[0] for r in df.select(report.truncate(F.col("t"), 9)).collect()] == ["one two…", "abcdefghi…", "short"]


def processes(spark):
    rows = [{"id": f"p{p}", "type": "process", "value": f"{n} (PID:{p} PPID:{q})", "sev": s} for p, q, n, s in [(1, 0, "init", "low"), (2, 1, "explorer.exe", "low"), (3, 2, "evil.exe", "critical"), (4, 1, "calm.exe", "low"), (7, 8, "a", "high"), (8, 7, "b", "low"), (9, 9, "self", "low")]]
    return items(spark, *rows)


def test_tree_keeps_flagged_and_ancestors(spark):
    nodes = lineage.flagged(lineage.process_nodes(processes(spark)))
    assert {r.pid for r in lineage.ancestor_closure(nodes).collect()} == {"1", "2", "3", "7", "8"}
    order = [(r.pid, r.depth) for r in lineage.tree_order(nodes, most=None).orderBy("row").collect()]
    assert order[:4] == [("1", 0), ("2", 1), ("3", 2), ("4", 1)] and {p for p, _ in order} == {"1", "2", "3", "4", "7", "8", "9"}


def test_lineage_rows_flag_the_child(spark):
    rel = items(spark, {"id": "relation_1_4", "type": "process_relation", "links": ["proc_1", "proc_4"]}, {"id": "relation_1_2", "type": "process_relation"})
    assert {r.pid for r in lineage.lineage_children(rel).collect()} == {"4", "2"}
    nodes = lineage.flagged(lineage.process_nodes(processes(spark)), lineage.lineage_children(rel))
    assert {r.pid for r in nodes.where("is_flagged").collect()} == {"2", "3", "4", "7"}


def test_coverage(spark):
    df = items(spark, {"tool": "volatility3"}, {"tool": "tshark", "type": "memory_analysis_status"}, {"tool": "memprocfs", "type": "memory_analysis_status"})
    got = {r.evidence: (r.status, r.tools, r.attempted) for r in report.coverage(df).collect()}
    assert got["memory_dump"] == ("Analysed", "volatility3", "memprocfs") and got["pcap"] == ("Not analysed", "", "tshark") and got["email"][0] == "Not provided"


def test_empty_tables_give_no_rows(spark):
    none = items(spark, {}).limit(0)
    assert report.indicator_rollup(none).count() == report.key_findings(none).count() == lineage.process_nodes(none).count() == dedup.group_index(none).count() == 0


def test_many_copies_of_one_vector_do_not_fill_the_samples(spark):
    schema = "family string, " + ", ".join(f"{f} double" for f in features.FEATURES)
    kinds = [[float(i == k) for i in range(14)] for k in range(4)]
    rows = [(f"hot {k}", *v) for k in range(4) for j, v in enumerate(kinds) for _ in range(3000 if j == k else 500)]
    baseline = spark.createDataFrame(rows, schema)
    drawn = {(r.family, tuple(r[1:])) for r in forest.background(baseline).collect()}
    assert drawn == {(f"hot {k}", tuple(v)) for k in range(4) for v in kinds}
    trees = forest.fit_forest(baseline, trees=5).collect()
    assert len(trees) == 20 and all(t.n == 256 and len(t.feature) > 1 for t in trees)
    scores = forest.model_scores(forest.distinct_vectors(baseline), baseline, forest.fit_forest(baseline, trees=20)).collect()
    assert all(len({r.model_score for r in scores if r.family == f"hot {k}"}) > 1 for k in range(4))
    phi = {(r.family, r.feature, r.is_suspicious_process): r.phi for r in forest.rule_attribution(forest.distinct_vectors(baseline), baseline).collect()}
    assert phi["hot 0", "is_suspicious_process", 1.0] == round(-0.30 * (1 - 500 / 4500), 6)


def test_model_scores_equal_a_plain_walk(spark):
    """Scores of the joins equal a walk down each tree, less the quantile of all baseline rows; a family without a forest has 0."""
    import math

    rng = np.random.default_rng(7)
    schema = "family string, " + ", ".join(f"{f} double" for f in features.FEATURES)
    rows = [("a" if i % 3 else "b", *map(float, np.round(rng.random(14) * 3) / 4)) for i in range(900)]
    baseline = spark.createDataFrame(rows + rows[:200], schema)
    asked = spark.createDataFrame(rows[:40] + [("none", *rows[0][1:])], schema)
    fitted = forest.fit_forest(baseline, trees=15, sample=64)
    trees = [r for r in fitted.collect()]
    assert {(t.family, t.tree) for t in trees} == {(f, i) for f in "ab" for i in range(15)} and all(t.n == 64 for t in trees)
    for t in trees:  # a node has both children or none, and is no deeper than six
        inner = {k for k, f in zip(t.node, t.feature, strict=True) if f >= 0}
        assert set(t.node) == {1} | {c for k in inner for c in (2 * k, 2 * k + 1)} and max(t.node) < 128

    def raw(row):
        paths = []
        for t in trees:
            if t.family == row[0]:
                at, nodes = 1, {k: (f, c, p) for k, f, c, p in zip(t.node, t.feature, t.cut, t.path, strict=True)}
                while nodes[at][0] >= 0:
                    at = 2 * at + (row[1 + nodes[at][0]] > nodes[at][1])
                paths.append(nodes[at][2])
        return -(2 ** (-(math.fsum(paths) / len(paths)) / forest.average_path(64)))

    offset = {f: np.quantile([raw(r) for r in rows + rows[:200] if r[0] == f], 0.01) for f in "ab"}
    for small in (2000, 0):
        forest.BROADCAST_TREES, kept = small, forest.BROADCAST_TREES
        got = {tuple(r[:15]): r.model_score for r in forest.model_scores(asked, baseline, fitted).collect()}
        forest.BROADCAST_TREES = kept
        for r in rows[:40]:
            assert abs(got[r] - (raw(r) - offset[r[0]])) < 1e-9
        assert got["none", *rows[0][1:]] == 0.0


def test_drawn_rows_are_distinct_and_as_many_as_asked(spark):
    schema = "family string, " + ", ".join(f"{f} double" for f in features.FEATURES)
    rows = [("f", float(i), *[0.0] * 13) for i in range(300)] + [("small", float(i % 3), *[1.0] * 13) for i in range(9)]
    drawn = forest._tree_samples(spark.createDataFrame(rows, schema), 4, 100, 1).collect()
    for tree in range(4):
        held = [r for r in drawn if r.family == "f" and r.tree == tree]
        assert len(held) == 100 and all(r.w == 1 for r in held)
        assert sorted((r.x[0], r.w, r.n) for r in drawn if r.family == "small" and r.tree == tree) == [(0.0, 3, 9), (1.0, 3, 9), (2.0, 3, 9)]


def test_chains_of_any_depth(spark):
    """A chain of 1,000 processes with a flagged leaf: all are its ancestors, each one level below the one before; a circle beside it ends."""
    rows = [("c", str(i), str(i - 1), i, i == 1000) for i in range(1, 1001)] + [("c", "a", "b", 2001, True), ("c", "b", "a", 2002, False), ("c", "d", "a", 2003, False)]
    nodes = spark.createDataFrame(rows, "case_id string, pid string, ppid string, first_seq long, is_flagged boolean")
    assert lineage.ancestor_closure(nodes).count() == 1002
    order = [(r.pid, r.depth) for r in lineage.tree_order(nodes, most=None).orderBy("row").collect()]
    assert order == [(str(i), i - 1) for i in range(1, 1001)] + [("a", 0), ("b", 0), ("d", 0)]
