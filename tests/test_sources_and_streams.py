import json

from pyspark.sql import functions as F

from casewright.operators import correlate
from casewright.sources import files, sinks
from casewright.streaming import streams


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def item(n, **more):
    return {"artifact_id": n, "source_tool": "t", "evidence_type": "x", "timestamp": "", "value": "v", "severity": "low", "confidence": 0.5, "linked_artifacts": []} | more


def test_raw_outputs(spark, tmp_path):
    write(tmp_path / "a_output.json", {"tool": "t1", "items": [item("1"), item("2")]})
    write(tmp_path / "b_output.json", {"tool": "t1", "items": [item("3")]})
    write(tmp_path / "c_output.json", {"tool": "t2", "items": []})
    write(tmp_path / "d_output.json", "not json")
    write(tmp_path / "e.json", {"tool": "t3", "items": [item("9")]})
    got = files.raw_outputs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.artifact_id for r in got] == ["1", "2", "3"]
    assert [r.artifact_id for r in files.raw_outputs(spark, str(tmp_path), "replace").collect()] == ["3"]


def test_flexible_evidence(spark):
    texts = spark.createDataFrame([(json.dumps(v),) for v in ({"evidence_items": [item("1")]}, {"items": [item("2")]}, [item("3"), item("4")])], "text string")
    assert sorted(r.artifact_id for r in files.flexible_evidence(texts).collect()) == ["1", "2", "3", "4"]


def test_tables_of_tools(spark, tmp_path):
    write(tmp_path / "p.tsv", "10.0.0.1\t8.8.8.8\t53\t90\t1700000000.5\nshort\n")
    assert files.packet_fields(spark, str(tmp_path / "p.tsv")).count() == 1
    write(tmp_path / "b.txt", "0|/a/b|1|r/r|0|0|1|0|0|0|0\n")
    assert files.file_bodies(spark, str(tmp_path / "b.txt")).first().path == "/a/b"
    write(tmp_path / "l2t.csv", "datetime,source,extra,description\n2024,REG,x,run key\n")
    row = files.event_timeline(spark, str(tmp_path / "l2t.csv")).first()
    assert (row.source, row.description, row.filename) == ("REG", "run key", None)
    write(tmp_path / "m.csv", "Date,Size,Type,Mode,UID,GID,Meta,File Name\nd,1,m.c.,r,0,0,5,/tmp/x\nshort,1\n")
    assert [r.path for r in files.file_timeline(spark, str(tmp_path / "m.csv")).collect()] == ["/tmp/x"]


def test_catalog(spark, tmp_path):
    write(tmp_path / "c.json", {"indicators": [{"id": "a", "match": ["x"], "severity": "high", "category": "k"}], "c2_ports": {"ports": [1], "severity": "low"}})
    assert files.catalog(spark, str(tmp_path / "c.json"))["indicators"][0]["match"] == ["x"]
    assert files.catalog(spark, str(tmp_path / "missing.json")) == {}


def test_manifests(spark, tmp_path):
    context = {"case_id": "c"}
    forms = [[{"machine_id": "m9", "raw_outputs_dir": "/x", "case_context": context}, {"raw_outputs_dir": "/y"}], {"machines": [{"machine_name": "n", "raw_outputs_dir": "/x"}]}, {"alpha": {"raw_outputs_dir": "/z"}}]
    names = []
    for i, form in enumerate(forms):
        write(tmp_path / f"{i}.json", form)
        names.append([r.machine_name for r in files.bulk_manifest(spark, str(tmp_path / f"{i}.json")).collect()])
    assert names == [["m9", "machine_2"], ["n"], ["alpha"]]


def test_routes(spark):
    paths = spark.createDataFrame([("/e/a.raw",), ("/e/b.PCAP",), ("/e/NTUSER.DAT",), ("/e/x.eml",), ("/e/readme",)], "path string")
    routed = files.route_files(paths)
    assert {r.kind: r.files for r in routed.collect()} == {"memory_dump": ["/e/a.raw"], "pcap": ["/e/b.PCAP"], "registry_hive": ["/e/NTUSER.DAT"], "email": ["/e/x.eml"]}
    assert files.provided_types(routed).first().provided_types == ["email_archive", "memory_dump", "pcap", "registry_hive"]
    tools = spark.createDataFrame([("tshark", "pcap")], "source_tool string, evidence string")
    assert [tuple(r) for r in files.tool_sources(routed, tools).select("source_tool", "files").collect()] == [("tshark", "b.PCAP")]


def test_digests_and_custody(spark, tmp_path):
    import hashlib

    write(tmp_path / "in/a.bin", "hello")
    digests = sinks.file_digests(spark, str(tmp_path / "in"))
    row = digests.first()
    assert row.sha256 == hashlib.sha256(b"hello").hexdigest()
    wanted = spark.createDataFrame([(row.path,), ("nowhere",)], "path string")
    sinks.append_custody(sinks.custody_entries(digests, wanted, "t", "cmd"), str(tmp_path / "log"))
    sinks.append_custody(sinks.custody_entries(digests, wanted, "t", "cmd"), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 2 and log.select(F.col("input_hashes.nowhere")).first()[0] == "file_not_found"
    sinks.write_table(spark.range(3).withColumn("case_id", F.lit("c")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def run_stream(spark, build, path, name):
    query = build(spark.readStream.schema("case_id string, machine_id string, artifact_id string, ts timestamp, evidence_type string").parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("c", f"m{i % 2}", f"a{i % 40}", 1_700_000_000 + 50 * i, "file" if i % 3 else "conn") for i in range(90)] + [("c", "m9", "late", 1_700_900_000, "x")]
    df = spark.createDataFrame(rows, "case_id string, machine_id string, artifact_id string, t long, evidence_type string").select("case_id", "machine_id", "artifact_id", F.timestamp_seconds("t").alias("ts"), "evidence_type")
    path = str(tmp_path / "s")
    df.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    minutes = {(r.minute, r.n) for r in run_stream(spark, streams.minute_counts, path, "minutes")}
    batch = {(r[0], r[1]) for r in df.where("machine_id <> 'm9'").groupBy(F.date_trunc("minute", "ts")).count().collect()}
    assert minutes == batch
    assert len(run_stream(spark, streams.first_wins, path, "firsts")) == 41
    assert {(r.machine_id, r.n) for r in run_stream(spark, streams.sessions, path, "sessions")} == {("m0", 45), ("m1", 45)}
    pairs = {(r.conn_ts, r.file_ts) for r in run_stream(spark, lambda s: streams.transfers_after_files(s.where("evidence_type = 'conn'"), s.where("evidence_type = 'file'")), path, "pairs")}
    c, f = df.where("evidence_type = 'conn'").select(F.col("ts").alias("c")), df.where("evidence_type = 'file'").select(F.col("ts").alias("f"))
    assert pairs == {(r.c, r.f) for r in c.join(f, F.expr("f <= c and f >= c - interval 24 hours")).collect()}


def test_end_to_end(spark):
    from tests.test_correlation import items

    raw = items(spark, {"id": "p", "tool": "volatility3", "value": "evil.exe (PID:9 PPID:1)"}, {"id": "p", "tool": "volatility3", "value": "evil.exe (PID:9 PPID:1)"}, {"id": "q", "tool": "memprocfs", "type": "memprocfs_process", "value": "evil.exe (PID:9 PPID:1)"}, {"id": "i", "type": "injected_code", "value": "regions (PID:9)"})
    out = correlate.aggregate(raw)
    assert sorted(r.artifact_id for r in out.collect()) == ["i", "p"]
    assert [r.key for r in correlate.shared_key_findings(out, "pids").collect()] == ["9"]


def test_whole_files_are_one_text_each(spark, tmp_path):
    write(tmp_path / "mail.eml", "Subject: a\n\nverify your password\n")
    write(tmp_path / "report.txt", "one\ntwo")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in files.whole_texts(spark, str(tmp_path)).collect()}
    assert got == {"mail.eml": "Subject: a\n\nverify your password\n", "report.txt": "one\ntwo"}
