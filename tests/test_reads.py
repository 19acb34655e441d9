"""Work that grows with the input is done once: reads of the tables, catalog tests, pairs, and searches of texts."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from casewright.operators import correlate, extraction, features, indicators
from tests.test_queries import SF


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["finding_member", "findings", "machine_summary", "annotate", "finding_lookup", "linked_artifacts", "linked_uncovered", "exfil_pairs_by_machine", "case_context", "correlation_context"])
def test_items_are_read_once(spark, name):
    assert "FileScan" not in plan(entry.queries()[name](spark, SF))  # only the copy that was written once


@pytest.mark.parametrize("name", ["forest_scores", "reasons", "scored_items"])
def test_scored_rows_meet_their_vectors_by_broadcast(spark, name):
    found = plan(entry.queries()[name](spark, SF))
    assert found.count("FileScan") <= 2 and "BroadcastHashJoin" in found  # the two branches of first-wins


def test_each_catalog_test_runs_once(spark):
    rows = spark.sql("SELECT 'c' AS case_id, 1L AS seq, id || '' AS value, 'process' AS evidence_type, 'low' AS severity FROM range(3)")
    assert plan(indicators.rescore(rows), "optimizedPlan").count("mssecsvc.exe") == 1


def test_many_hosts_in_one_long_text(spark):
    text = " ".join(f"h{i}.site.org/x filler words stand here" for i in range(12000)) + " Referer: tail.site.org. url=abc.last.net; more.last.net"
    started = time.time()
    found = dict(extraction.domains(spark.createDataFrame([(1, text)], "doc_id int, text string"), keep=("doc_id",)).select("value", "confidence").collect())
    assert len(found) == 12003 and found["h11999.site.org"] == found["abc.last.net"] == 0.45 and found["more.last.net"] == 0.2
    assert time.time() - started < 30


def test_related_counts_equal_the_lists(spark):
    links = {"a": ["same_pid|7", "x", ""], "b": ["same_pid|8", "exfiltration|t"], "f": ["exfiltration|t", "exfiltration|u"], "t": ["exfiltration|t"], "u": ["exfiltration|t"]}
    values = {"a": "x (PID: 7)", "b": "y (PID: 7)", "f": "C:\\t\\f.exe", "t": "TCP 1.1.1.1 -> 2.2.2.2:80 (2000000 bytes, 1)", "u": "TCP 1.1.1.3 -> 2.2.2.3:80 (2000000 bytes, 1)"}
    times = {"f": "2024-01-02T00:00:00Z", "t": "2024-01-02T05:00:00Z", "u": "2024-01-05T00:00:00Z"}
    kinds = {"a": "process", "b": "module", "f": "file_artifact", "t": "network_connection", "u": "network_connection"}
    rows = [("c", "m", i, n, f"tool{i % 2}", kinds[n], times.get(n, ""), values[n], "low", 0.5, links[n], values[n]) for i, n in enumerate(links)]
    items = correlate.with_signals(spark.createDataFrame(rows, "case_id string, machine_id string, seq long, artifact_id string, source_tool string, evidence_type string, timestamp string, value string, severity string, confidence double, linked_artifacts array<string>, normalized_value string"))
    lists = features.correlation_context(correlate.annotate(items, correlate.all_members(items))).select("artifact_id", F.size("related"), F.try_element_at("related", F.lit(-1)).startswith("linked_artifact|"))
    held = correlate.held(items)
    counts = features.related_counts(correlate.with_findings(held), correlate.named_links(held)).select("artifact_id", "n_related", "has_link")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, lists.collect()))
