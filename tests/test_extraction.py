import pytest
from pyspark.sql import functions as F

from casewright.operators import extraction as ex


def text_lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text.splitlines())], "file string, line_no int, value string")


def texts(spark, *values):
    return spark.createDataFrame([("s", v) for v in values], "source string, text string")


def test_folders_are_skipped_in_listings(spark):
    rows = [("0", "/Windows/Temp", "438", "d/drwxrwxrwx"), ("0", "/Windows/Temp/taskdl.exe", "453", "r/rrwxrwxrwx"), ("r/r * 5", "/x.bin", "9", "r/r"), ("0", "/home/a.txt", "7", "r/r")]
    got = {r.value: r.severity for r in ex.listed_files(spark.createDataFrame(rows, "md5 string, path string, inode string, mode string")).collect()}
    assert got == {"Suspicious file: /Windows/Temp/taskdl.exe": "medium", "DELETED file: /x.bin": "high"}


def test_command_lines(spark):
    text = "PID\tProcess\tArgs\n1940\ttasksche.exe\n1024\tsvchost.exe\tC:\\Windows\\svchost.exe -k netsvcs\n77\nUnsatisfied requirement x\n5\tpowershell.exe\tpowershell -enc AAAA"
    got = {r.artifact_id: r for r in ex.command_lines(text_lines(spark, text)).collect()}
    assert got["cmdline_1940"].value == "tasksche.exe"
    assert got["cmdline_1024"].value == "C:\\Windows\\svchost.exe -k netsvcs" and got["cmdline_1024"].severity == "low"
    assert got["cmdline_empty_77"].evidence_type == "commandline_missing"
    assert got["cmdline_5"].severity == "high"
    assert sum(r.evidence_type == "parser_warning" for r in got.values()) == 1 and len(got) == 5


HEAD = "Volatility 3 Framework 2.28.0\nPID\tProcess\tStart VPN\tEnd VPN\tTag\tProtection\tCommitCharge\tPrivateMemory\tFile output\tNotes\n"
CHROME = HEAD + "1234\tchrome.exe\t0x1000\t0x2000\tVadS\tPAGE_EXECUTE_READWRITE\t4\t1\tDisabled\tN/A\n00 00 00 00 ................\n"


def test_injected_regions(spark):
    text = HEAD + "4    System    0x10000    0x11000    VadS    PAGE_EXECUTE_READWRITE    1    1    -\n0x10000  4d 5a 90 00   MZ..............\n0x10010  b8 00 00 00 ........@.......\n"
    (row,) = ex.injected_regions(text_lines(spark, text)).collect()
    assert row.severity == "critical" and "RWX region and embedded PE/shellcode detected" in row.value and row.linked_artifacts == ["proc_4"]
    text = HEAD + "596\tcsrss.exe\t0x7f6f0000\t0x7f7effff\tVad \tPAGE_EXECUTE_READWRITE\t0\t0\tDisabled\tN/A\n08 00 00 00 00 fe 00 00 ............. ..\n620\twinlogon.exe\t0x21400000\t0x21403fff\tVadS\tPAGE_EXECUTE_READWRITE\t4\t1\tDisabled\tN/A\n00 00 00 00 28 00 28 00 ....(.(.........\n"
    got = {r.artifact_id: r.severity for r in ex.injected_regions(text_lines(spark, text)).collect()}
    assert got == {"malfind_596": "high", "malfind_620": "high"}
    assert ex.injected_regions(text_lines(spark, "08 00 00 00 ....\n00 02 00 00 ....")).count() == 0


def test_injected_regions_of_compiling_processes(spark):
    (row,) = ex.injected_regions(text_lines(spark, CHROME)).collect()
    assert row.severity == "medium" and "down-ranked" in row.value
    (row,) = ex.injected_regions(text_lines(spark, CHROME), spark.createDataFrame([("1234",)], "pid string")).collect()
    assert row.severity == "high" and "Corroborated by another IOC" in row.value


def test_corroborated_pids(spark):
    rows = [("cmdline_1234", "commandline", "powershell -enc ...", "high"), ("netstat_620_x", "network_connection", "TCP 10.0.0.5:49200 -> 9.9.9.9:443 (PID:620)", "high"), ("cmdline_999", "commandline", "explorer.exe", "low"), ("proc_4242_evil_exe", "process", "evil.exe (PID:4242 PPID:1)", "high")]
    got = ex.corroborated_pids(spark.createDataFrame(rows, "artifact_id string, evidence_type string, value string, severity string"))
    assert {r.pid for r in got.collect()} == {"1234", "620"}


FILES = r"""Volatility 3 Framework 2.28.0
Offset	Name
0x1000	\Device\HarddiskVolume2\Intel\ivecuqmanpnirkt615\config.dat
0x2000	\Device\HarddiskVolume2\ProgramData\ab12cd34ef56gh\loader.dat
0x3000	\Device\HarddiskVolume2\Windows\Temp\note.dat
0x4000	\Device\HarddiskVolume2\Intel\Logs\install.log
0x5000    \Device\HarddiskVolume2\Windows\System32\kernel32.dll
0x6000	\Device\HarddiskVolume2\Users\Public\My Tools\payload.exe
0x7000	\Documents and Settings\All Users\Default Pictures\chess.bmp.WNCRY
0x8000	\WINDOWS\Prefetch\@WANADECRYPTOR@.EXE-06F053F5.pf
0x9000	\windows\prefetch\@wanadecryptor@.exe-06f053f5.pf"""


def test_file_objects(spark):
    got = {r.value.rsplit("\\", 1)[-1].lower(): (r.severity, r.confidence) for r in ex.file_objects(text_lines(spark, FILES)).collect()}
    assert got == {
        "config.dat": ("high", 0.90), "loader.dat": ("high", 0.90), "note.dat": ("medium", 0.80), "install.log": ("medium", 0.80), "payload.exe": ("medium", 0.80),
        "chess.bmp.wncry": ("high", 0.95), "@wanadecryptor@.exe-06f053f5.pf": ("high", 0.95),
    }


def sweep(spark, *values):
    return {r.value: r for r in ex.sweep(texts(spark, *values)).collect()}


def test_benign_domains_are_dropped_and_lookalikes_are_not(spark):
    assert sweep(spark, "www.microsoft.com", "ocsp.digicert.com", "fonts.gstatic.com", "ubuntu.com", "settings-win.data.microsoft.com") == {}
    assert "microsoft.com.evil.ru" in sweep(spark, "microsoft.com.evil.ru")


def test_domain_tiers(spark):
    got = sweep(spark, "GET http://callback-host.xyz/gate.php", "Host: beacon.example.to", "www.tracked.io here", "endpoint api.svc.net:8443 ready", "loose prose mentions across.com somewhere", "seen bare dual-host.io first, later GET https://dual-host.io/x", "config c2 = lonely-bare-c2.ru ;")
    conf = {v: r.confidence for v, r in got.items() if r.evidence_type == "suspicious_domain"}
    assert conf == {"callback-host.xyz": 0.45, "beacon.example.to": 0.45, "www.tracked.io": 0.45, "api.svc.net": 0.45, "across.com": 0.20, "dual-host.io": 0.45, "lonely-bare-c2.ru": 0.20}


@pytest.mark.parametrize("noise", ["COMMAND.COM", "main.py", "lib.so", "f0hht.ht", "htaht.ht", "ntdll.dll", "ab.cd1", "x.com"])
def test_fragments_are_no_domains(spark, noise):
    assert sweep(spark, f"some {noise} text") == {}


def test_other_sweeps(spark):
    got = sweep(spark, "ransom abcdef1234567890abcd.onion site", "pay 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa or 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", r"HKEY_LOCAL_MACHINE\System\CurrentControlSet\Services|BatteryLife", "write to some.one@evil-mail.org, ..x@a.com, 12@34.com, a@b.py")
    assert got["abcdef1234567890abcd.onion"].severity == "high"
    assert got["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"].evidence_type == "suspicious_crypto" and "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb" not in got
    assert "HKEY_LOCAL_MACHINE\\System\\CurrentControlSet\\Services" in got
    assert [v for v, r in got.items() if r.evidence_type == "email_address"] == ["some.one@evil-mail.org"]


def test_dns_scores(spark):
    rows = spark.createDataFrame([("a8f3k2l9q0z7x1c5.evil.net",), ("a8f3k2l9q0z7x1c5.cloudfront.net",), ("www.example.org",), ("localhost",), ("",)], "domain string")
    got = {r.domain: (r.label, r.severity) for r in ex.dns_scores(rows).collect()}
    assert got["a8f3k2l9q0z7x1c5.evil.net"] == ("a8f3k2l9q0z7x1c5", "high")
    assert got["a8f3k2l9q0z7x1c5.cloudfront.net"][1] == "low" and got["www.example.org"] == ("example", "low") and got[""] == ("", "low")


def test_registry_and_timeline_rows(spark):
    lines = text_lines(spark, "# note\nLaunching plugin\nRun keys:\nSoftware\\Run -> evil\nloader.dll here\nplain text\n")
    assert {(r.value, r.severity) for r in ex.registry_lines(lines).collect()} == {("Software\\Run -> evil", "high"), ("loader.dll here", "medium")}
    rows = spark.createDataFrame([("t", "WEBHIST", "a download", "f"), ("t", "REG", "nothing", "f")], "datetime string, source string, description string, filename string")
    assert ex.timeline_events(rows).count() == 1


def test_connections_and_modules(spark):
    lines = text_lines(spark, "0x1 TCPv4 10.0.0.5 49200 9.9.9.9 4444 ESTABLISHED 620 x.exe 2024\n0x2 TCPv4 10.0.0.5 49200 9.9.9.9 443 ESTABLISHED 7 y.exe 2024\nshort row")
    assert sorted(r.severity for r in ex.connections(lines).collect()) == ["high", "low"]
    assert ex.module_lines(text_lines(spark, "1 C:\\Temp\\a.dll\n2 C:\\Windows\\b.dll")).count() == 1
    assert ex.rule_hits(text_lines(spark, "Volatility 3\nrule1 hit\n\n")).count() == 1
    assert ex.memory_fields(text_lines(spark, "PID\tName\n4\tSystem\n5 a b")).select(F.size("fields")).collect() == [(2,), (3,)]


def test_domain_endings_are_the_registered_ones(spark):
    good = ["x-ray.de", "host.uk", "site.eu", "name.su", "evil.io", "evil.tk", "evil.xyz", "evil.onion", "deep.host.py"]
    bad = ["lib.dd", "part.ab", "task.pf", "file.js", "mod.rs", "kernel.sys", "thing.aq", "some.tm", "data.zz"]
    texts = spark.createDataFrame([(f"see http://{h}/ now",) for h in good + bad], "text string")
    assert {r.value for r in ex.domains(texts).collect()} == set(good)
    mails = spark.createDataFrame([(f"write a.b@{h} now",) for h in good + bad], "text string")
    assert {r.value for r in ex.mail_addresses(mails).collect()} == {f"a.b@{h}" for h in good if not h.endswith(".py")}


def test_process_inventory(spark):
    rows = spark.createDataFrame([(4, 0, "System"), (88, 4, "smss.exe")], "pid int, ppid int, name string")
    got = {r.artifact_id: (r.source_tool, r.evidence_type, r.value, r.severity, r.confidence) for r in ex.process_inventory(rows).collect()}
    assert got["memprocfs_proc_88"] == ("memprocfs", "memprocfs_process", "smss.exe (PID 88, PPID 4)", "medium", 0.80) and len(got) == 2
