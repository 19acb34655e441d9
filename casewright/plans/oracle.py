"""SQL (DuckDB dialect) that gives the rows of the registered queries, written on its own from their definitions."""

from __future__ import annotations

from casewright.operators import classify, explain, extraction, features, indicators
from casewright.plans import queries as q
from casewright.plans.evidence_view import VIEW_SQL

EV = VIEW_SQL.replace("{ts}", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")
RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'informational' THEN 1 ELSE 0 END"
FIRST = "first_items AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY seq) = 1)"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def texts(values: list[str]) -> str:
    """A list literal."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def holds(text: str, words: list[str]) -> str:
    """A test for any of the words."""
    return f"(len(list_filter({texts(words)}, lambda w: contains({text}, w))) > 0)"


def hits(text: str, words: list[str]) -> str:
    return f"len(list_filter({texts(words)}, lambda w: contains({text}, w)))"


def with_ev(*ctes: str, select: str) -> str:
    return "WITH ev AS (" + EV + ")" + "".join(f", {c}" for c in ctes) + " " + select


SIGNALS = f"""signals AS (
    SELECT *, list_sort(list_distinct(list_concat(
            regexp_extract_all(value, '(?i)\\bpid[:\\s#]*(\\d+)\\b', 1), regexp_extract_all(artifact_id, '(?i)\\b(?:proc|cmdline|net|malfind)_(\\d+)\\b', 1)))) AS pids,
        list_sort(list_distinct(regexp_extract_all(value, '{IP}'))) AS ips,
        CASE WHEN evidence_type = 'file_artifact' THEN [replace(regexp_extract(value, '/\\S+'), '/', '\\')] ELSE [] END AS paths,
        CASE WHEN evidence_type = 'dns_query' THEN [regexp_replace(regexp_extract(value, '-> (.*)$', 1), '^www\\.', '')] ELSE [] END AS domains,
        coalesce(try_cast(regexp_extract(value, '(\\d+) bytes', 1) AS bigint), 0) AS bytes_transferred,
        CASE WHEN evidence_type = 'network_connection' THEN regexp_extract(value, '-> ([0-9.]+):', 1) WHEN evidence_type = 'dns_query' THEN regexp_extract(value, '{IP}') ELSE '' END AS destination_ip,
        CASE WHEN evidence_type = 'network_connection' THEN cast(regexp_extract(value, '-> [0-9.]+:(\\d+)', 1) AS integer) ELSE 0 END AS destination_port,
        strftime(date_trunc('minute', strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')), '%Y-%m-%dT%H:%M:%S+00:00') AS ts_bucket,
        strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS at
    FROM FROM_TABLE),
keyed_signals AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(paths, lambda p: lower(p)), list_transform(paths, lambda p: regexp_extract(lower(p), '[^\\\\]+$'))))) AS file_keys FROM signals)"""
ON_FIRST = SIGNALS.replace("FROM_TABLE", "first_items")
ORDER = f"-({RANK}), -confidence, source_tool, seq"
KEYS = f"""keys AS (
    SELECT 'same_pid' AS correlation_type, unnest(pids) AS key, * FROM keyed_signals
    UNION ALL SELECT 'same_ip', unnest(ips), * FROM keyed_signals
    UNION ALL SELECT 'same_file', unnest(file_keys), * FROM keyed_signals
    UNION ALL SELECT 'same_domain', unnest(domains), * FROM keyed_signals
    UNION ALL SELECT 'same_timestamp', ts_bucket, * FROM keyed_signals),
shared AS (
    SELECT correlation_type, key, count(*) AS n_items, string_agg(DISTINCT source_tool, ',' ORDER BY source_tool) AS source_tools, count(DISTINCT source_tool) AS n_tools,
        count(DISTINCT evidence_type) AS n_types, count(*) FILTER (evidence_type NOT IN ('process', 'commandline', 'process_tree')) AS informative,
        first(artifact_id ORDER BY {ORDER}) AS anchor
    FROM keys GROUP BY ALL HAVING count(*) >= 2),
kept AS (
    SELECT *, least(75 + 6 * least(n_tools, 4) + 3 * least(n_items - 1, 5), 99) / 100.0::DOUBLE AS confidence FROM shared
    WHERE (correlation_type <> 'same_pid' OR n_tools >= 2 OR informative > 0) AND (correlation_type <> 'same_domain' OR n_tools >= 2 OR n_types >= 2)),
pairs AS (
    SELECT c.artifact_id AS conn_id, c.seq AS conn_seq, f.artifact_id AS file_id, f.seq AS file_seq, c.source_tool AS conn_tool, f.source_tool AS file_tool, c.bytes_transferred,
        c.destination_ip || ':' || c.destination_port AS destination, f.paths[1] AS path, c.machine_id AS c_machine, f.machine_id AS f_machine
    FROM keyed_signals c JOIN keyed_signals f ON c.evidence_type = 'network_connection' AND c.bytes_transferred >= 1000000 AND len(f.file_keys) > 0
        AND f.at <= c.at AND f.at >= c.at - INTERVAL 24 HOUR AND f.seq <> c.seq),
exfil AS (
    SELECT conn_id AS anchor, count(*) AS n_files, any_value(conn_tool) AS t, list_sort(list_distinct(list_concat([any_value(conn_tool)], list(DISTINCT file_tool)))) AS tools,
        any_value(bytes_transferred) AS bytes_transferred, any_value(destination) AS destination, first(path ORDER BY file_seq) AS file
    FROM pairs GROUP BY conn_id),
exfil_scored AS (SELECT *, least(82 + 6 * least(len(tools), 4) + 3 * least(n_files, 5), 99) / 100.0::DOUBLE AS confidence FROM exfil),
members AS (
    SELECT k.artifact_id, s.correlation_type || '|' || s.key AS finding, s.confidence FROM keys k JOIN kept s ON k.correlation_type = s.correlation_type AND k.key = s.key
    UNION SELECT x.artifact_id, 'exfiltration|' || e.anchor, e.confidence FROM exfil_scored e JOIN (SELECT conn_id, conn_id AS artifact_id FROM pairs UNION SELECT conn_id, file_id FROM pairs) x ON x.conn_id = e.anchor)"""
SHARED = (FIRST, ON_FIRST, KEYS)

LINKS = """links AS (SELECT artifact_id AS source_id, seq, link AS target FROM first_items WHERE link IS NOT NULL),
resolved AS (
    SELECT l.source_id, l.seq, l.target, i.artifact_id AS target_id FROM links l JOIN first_items i
    ON i.artifact_id = l.target OR (starts_with(i.artifact_id, l.target || '_') AND l.target NOT IN (SELECT artifact_id FROM first_items))
    WHERE i.artifact_id <> l.source_id)"""


LINK_SETS = (
    "sets AS (SELECT source_id, list_sort(list_concat([source_id], list(DISTINCT target_id))) AS ids FROM resolved GROUP BY 1)",
    "once AS (SELECT s.* FROM sets s JOIN first_items i ON i.artifact_id = s.source_id QUALIFY row_number() OVER (PARTITION BY ids ORDER BY i.seq) = 1)",
    "flat AS (SELECT source_id, ids, unnest(ids) AS artifact_id FROM once)",
)
LINK_FINDINGS = f"""SELECT source_id, array_to_string(any_value(ids), ',') AS artifacts, len(any_value(ids))::INTEGER AS n_items, first(artifact_id ORDER BY {ORDER}) AS anchor,
        least(75 + 6 * least(count(DISTINCT source_tool), 4) + 3 * least(len(any_value(ids)) - 1, 5), 99) / 100.0::DOUBLE AS confidence FROM flat JOIN first_items USING (artifact_id) GROUP BY 1"""


def _uncovered(test: str) -> tuple[str, str, str]:
    """flat without the sets that lie within a finding whose members pass the test."""
    return (
        "every AS (SELECT source_id, ids, unnest(ids) AS artifact_id FROM once)",
        f"covered AS (SELECT DISTINCT source_id FROM (SELECT e.source_id, m.finding FROM every e JOIN members m ON m.artifact_id = e.artifact_id AND {test} GROUP BY e.source_id, m.finding, len(e.ids) HAVING count(DISTINCT e.artifact_id) = len(e.ids)))",
        "flat AS (SELECT * FROM every WHERE source_id NOT IN (SELECT source_id FROM covered))",
    )


# The catalog once more, spelled out here so that a wrong value on either side shows.
TERMS = [
    ("wannacry_dropper", "critical", "tasksche.exe,mssecsvc.exe,mssecsvc2.0,wannacry,wanacry,wcry"),
    ("wannacry_decryptor", "critical", "@wanadecryptor@,wanadecryptor,.wncry,.wncryt,.wcry,wana decrypt0r"),
    ("wannacry_payload", "high", ".wnry"),
    ("wannacry_killswitch", "high", "iuqerfsodp9ifjaposdfjhgosurijfaewrwergwea"),
    ("tor_hidden_service", "high", ".onion"),
    ("wannacry_ransom_wallet", "critical", "13am4vw2dhxygxeqepohkhsquy6ngaeb94,12t9ydpgwuez9nymgw519p7aa8isjr6smw,115p7ummngoj1pmvkphijcrdfjnxj6lrln"),
    ("ransomware_family", "critical", "ryuk,lockbit,revil,sodinokibi,conti,blackcat,alphv,maze,egregor,darkside,cl0p,clop"),
    ("ransom_note_markers", "high", "ransom,decrypt your files,your files have been encrypted,bitcoin,btc wallet,tor browser,.locked,readme.txt restore,how to decrypt"),
    ("credential_tooling", "high", "mimikatz,sekurlsa,lsass dump,lsass.dmp,procdump,comsvcs.dll minidump,wce.exe,pwdump,gsecdump"),
    ("offensive_tooling", "high", "cobaltstrike,cobalt strike,beacon.dll,psexec,psexesvc,meterpreter,metasploit,bloodhound,sharphound,rubeus,powersploit,nishang"),
    ("lolbin_abuse", "high", "certutil -urlcache,certutil.exe -decode,mshta.exe http,regsvr32 /s /n /u,rundll32 javascript,bitsadmin /transfer,wmic process call create"),
    ("persistence_runkey", "high", "currentversion\\run,currentversion\\runonce,userinit,\\winlogon\\shell,schtasks /create"),
    ("code_injection", "high", "page_execute_readwrite,rwx,injected_code,process hollowing,reflective"),
]


def _rules() -> list[tuple[str, str, str]]:
    hay = "lower(concat_ws(' ', value, evidence_type))"
    out = [(f"'{name}'", holds(hay, words.split(",")), severity) for name, severity, words in TERMS]
    bad = "regexp_extract(lower(value), '(165\\.245\\.215\\.18|rapid-craft567\\.com)($|[^a-z0-9.-])', 1)"
    out.append((f"'bad_host:' || {bad}", f"({bad} <> '')", "high"))
    out.append(("'c2_port'", f"(len(list_intersect(list_transform(regexp_extract_all({hay}, '(?:[\\w.]:|\\bport[\\s:=]{{0,3}})(\\d{{2,5}})\\b', 1), lambda p: cast(p AS integer)), [4444, 4445, 1337, 31337, 8888, 9999, 6667, 6668, 6669])) > 0)", "critical"))
    out.append(("'data_exfiltration'", holds(hay, "exfil,dns tunnel,covert post,data staged,rclone,megacmd,outbound upload,/api/metrics/run,/api/join/".split(",")), "critical"))
    return out


def rescored(source: str) -> str:
    """A CTE with severity and ioc_match after the catalog."""
    rules = _rules()
    rank = {"critical": 5, "high": 4, "medium": 3, "low": 2}
    names = "[" + ", ".join(f"CASE WHEN {test} THEN {name} END" for name, test, _ in rules) + "]"
    floor = "greatest(" + ", ".join(f"CASE WHEN {test} THEN {rank[s]} ELSE 0 END" for _, test, s in rules) + ")"
    return f"""matched AS (SELECT *, list_filter({names}, lambda m: m IS NOT NULL) AS ioc_match, {floor} AS floor_rank, {RANK} AS own_rank FROM {source}),
rescored AS (SELECT * REPLACE (CASE WHEN floor_rank > own_rank THEN (CASE floor_rank WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END) ELSE severity END AS severity), floor_rank > own_rank AS boosted FROM matched)"""


def _derived(source: str) -> str:
    slug = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'x')"
    rules = ", ".join(f"('{f}', '{n}', '{t}', '{s}', {c}::DOUBLE, '{x}')" for f, n, t, s, c, x in indicators.DERIVED_RULES)
    return f"""rules(family, name, term, sev, conf, txt) AS (VALUES {rules}),
derived AS (
    SELECT 'ioc_' || family || '_' || artifact_id || '_' || {slug.format('name')} AS artifact_id, txt AS value, sev AS severity, conf AS confidence, artifact_id AS linked FROM {source} i JOIN rules ON contains(lower(i.value), term)
    UNION ALL SELECT 'ioc_injection_' || artifact_id, 'Process injection detected', 'critical', 0.97::DOUBLE, artifact_id FROM {source} WHERE evidence_type = 'injected_code')"""


PACKETS = r"""packets AS (
    SELECT seq, regexp_extract(value, 'TCP (\S+) -> ', 1) AS src, regexp_extract(value, '-> ([0-9.]+):', 1) AS dst, cast(regexp_extract(value, '-> [0-9.]+:(\d+)', 1) AS integer) AS dport,
        cast(regexp_extract(value, '\((\d+) bytes', 1) AS bigint) AS length, cast(epoch(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')) AS bigint) AS epoch
    FROM ev WHERE evidence_type = 'network_connection')"""
WATCHED = ", ".join(map(str, extraction.WATCH_PORTS))


def _class_case(text: str, words: dict[str, list[str]]) -> tuple[str, str]:
    scores = {c: hits(f"lower({text})", w) for c, w in words.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    pick = "CASE WHEN " + best + " = 0 THEN 'unknown' " + " ".join(f"WHEN {s} = {best} THEN '{c}'" for c, s in scores.items()) + " END"
    return pick, f"CASE WHEN {best} = 0 THEN 0.35::DOUBLE ELSE least((50 + 10 * {best}) / 100.0::DOUBLE, 0.95) END"


def _inlist(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


FAMILY = """CASE WHEN regexp_matches(evidence_type, 'network|connection|pcap') OR source_tool = 'tshark' THEN 'network' WHEN regexp_matches(evidence_type, 'process|malfind') OR source_tool = 'volatility3' THEN 'process'
    WHEN source_tool = 'tsk_fls' THEN 'file' ELSE 'generic' END"""
FEATURE_SQL = f"""base_features AS (
    SELECT *, {FAMILY} AS family, lower(regexp_extract(value, '(?i)[\\w\\-]+\\.exe')) AS p,
        CASE WHEN evidence_type = 'network_connection' THEN coalesce(try_cast(regexp_extract(value, '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}:(\\d{{2,5}})\\b', 1) AS integer), 0) ELSE 0 END AS port FROM first_items),
feats AS (
    SELECT * EXCLUDE (p, port),
        (p IN {_inlist(features.SYSTEM_PROCESSES)})::INT::DOUBLE AS is_system_process, (p IN {_inlist(features.SUSPICIOUS_PROCESSES)})::INT::DOUBLE AS is_suspicious_process, 0.0::DOUBLE AS suspicious_parent,
        (port > 0 AND port NOT IN {_inlist(features.STANDARD_PORTS)})::INT::DOUBLE AS port_nonstandard, (port IN {_inlist(features.C2_PORTS)})::INT::DOUBLE AS port_is_known_c2,
        (evidence_type = 'network_connection')::INT::DOUBLE AS has_network_activity, (evidence_type = 'file_artifact')::INT::DOUBLE AS evidence_is_file,
        (evidence_type = 'network_connection')::INT::DOUBLE AS evidence_is_network, 0.0::DOUBLE AS evidence_is_email,
        regexp_matches(value, '{features.TEMP_PATH}')::INT::DOUBLE AS path_in_temp, regexp_matches(value, '{features.EXE_IN_TEMP}')::INT::DOUBLE AS path_has_exe_in_temp,
        regexp_matches(value, '{features.C2_WORDS}')::INT::DOUBLE AS keyword_c2_indicator, regexp_matches(value, '{features.TRANSFER_WORDS}')::INT::DOUBLE AS keyword_exfil,
        (CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0 END)::DOUBLE AS severity_score
    FROM base_features)"""
RULE = " + ".join(f"{f} * ({w})::DOUBLE" for f, w in features.WEIGHTS.items())
SCORED = f"scored AS (SELECT *, round({RULE}, 4) AS rule_score, round(round({RULE}, 9), 9) AS s FROM feats)"
F_LIST = ", ".join(features.FEATURES)


def _long(source: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, {i} AS feature_no, '{f}' AS feature, {f} AS x FROM {source}" for i, f in enumerate(features.FEATURES))


INDICATOR_ROWS = r"""ind AS (
    SELECT r.*, 'Domain' AS type, regexp_extract(value, '-> ([a-z0-9][a-z0-9.\-]*\.[a-z]{2,})', 1) AS indicator FROM SRC r WHERE evidence_type = 'dns_query'
    UNION ALL SELECT r.*, 'IP Address', x.ip FROM SRC r, unnest(regexp_extract_all(r.value, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS x(ip) WHERE NOT starts_with(x.ip, '10.')
    UNION ALL SELECT r.*, 'Suspicious File', left(x.w, 60) FROM SRC r, unnest(string_split(r.value, ' ')) AS x(w)
        WHERE (severity IN ('high', 'critical') OR len(ioc_match) > 0) AND regexp_matches(x.w, '\.(exe|dll|bat|ps1|vbs|cmd|scr)$'))"""


def _indicators(source: str) -> str:
    return INDICATOR_ROWS.replace("SRC", source)


ROLLUP = f"""ind_context AS (SELECT *, CASE evidence_type WHEN 'network_connection' THEN 'Network connection' WHEN 'dns_query' THEN 'DNS query' ELSE evidence_type END AS context, {RANK} AS r FROM ind),
rollup_rows AS (
    SELECT type, indicator, max(r) AS severity_rank, max(confidence) AS confidence, first(source_tool ORDER BY seq) AS tool, string_agg(DISTINCT context, ',' ORDER BY context) AS contexts,
        array_to_string(list_sort(list_distinct(flatten(list(ioc_match)))), ',') AS matches, count(DISTINCT artifact_id) AS n_artifacts
    FROM ind_context GROUP BY type, indicator),
rolled AS (SELECT *, CASE severity_rank WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' END AS severity, severity_rank >= 3 OR matches <> '' AS surfaced FROM rollup_rows)"""
NODES = f"""procs AS (
    SELECT seq, regexp_extract(value, '\\(PID:(\\d+)', 1) AS pid, regexp_extract(value, 'PPID:(\\d+)', 1) AS ppid, split_part(value, ' ', 1) AS name, {RANK} AS r, artifact_id FROM ev WHERE evidence_type = 'process'),
nodes AS (
    SELECT pid, first(ppid ORDER BY seq) AS ppid, first(name ORDER BY seq) AS name, max(r) AS rank, first(artifact_id ORDER BY seq) AS artifact_id, min(seq) AS first_seq FROM procs GROUP BY pid)"""
TREE = """placed AS (SELECT n.*, n.ppid <> n.pid AND n.ppid IN (SELECT pid FROM nodes) AS has_parent, row_number() OVER (PARTITION BY ppid ORDER BY first_seq, pid) AS ordinal FROM nodes n),
walk AS (
    SELECT pid, 0 AS depth, [row_number() OVER (ORDER BY pid)] AS path FROM placed WHERE NOT has_parent
    UNION ALL SELECT c.pid, w.depth + 1, list_append(w.path, c.ordinal) FROM walk w JOIN placed c ON c.ppid = w.pid AND c.has_parent WHERE w.depth < 64),
ordered AS (SELECT n.pid, coalesce(w.depth, 0) AS depth, row_number() OVER (ORDER BY w.path NULLS LAST, n.pid) AS row FROM nodes n LEFT JOIN walk w USING (pid))"""
CLOSURE = """flagged AS (SELECT *, first_seq % 5 = 0 AS is_flagged FROM nodes),
walk AS (
    SELECT pid, ppid, [pid] AS path FROM flagged WHERE is_flagged
    UNION ALL SELECT p.pid, p.ppid, list_append(w.path, p.pid) FROM walk w JOIN flagged p ON p.pid = w.ppid WHERE NOT list_contains(w.path, p.pid))"""
_pick, _conf = _class_case("text", q.CLASS_WORDS)
_types = "[" + ", ".join(f"CASE WHEN {holds('lower(text)', w)} THEN '{t}' END" for t, w in classify.TYPE_WORDS.items()) + "]"
_expected = " ".join(f"WHEN '{c}' THEN {texts(t)}" for c, t in classify.EXPECTED_TYPES.items())


def _suggest() -> str:
    """The fold over the classes as nested cases, one step for each class."""
    name, score = "CAST(NULL AS VARCHAR)", "score"
    steps = []
    for i, (c, types) in enumerate(classify.EXPECTED_TYPES.items()):
        support = f"(len(list_intersect({texts(types)}, present)) / {len(types)}::DOUBLE)"
        steps.append(f"step{i} AS (SELECT *, CASE WHEN case_type <> '{c}' AND {support} > {score} + 0.25 THEN '{c}' ELSE {name} END AS n{i}, CASE WHEN case_type <> '{c}' AND {support} > {score} + 0.25 THEN {support} ELSE {score} END AS s{i} FROM {'supported' if not i else f'step{i - 1}'})")
        name, score = f"n{i}", f"s{i}"
    return ",\n".join(steps)


_LAST = f"step{len(classify.EXPECTED_TYPES) - 1}"
RECONCILE = f"""cases AS (SELECT machine_id || '/' || seq % 40 AS case_id, cast(seq % 40 AS integer) AS n, list_sort(list(DISTINCT evidence_type)) AS present FROM ev GROUP BY ALL),
typed AS (SELECT *, {texts([*classify.EXPECTED_TYPES, 'unknown'])}[n % 7 + 1] AS case_type FROM cases),
expecting AS (SELECT *, CASE case_type {_expected} END AS expected FROM typed),
supported AS (SELECT *, len(list_intersect(expected, present)) / len(expected)::DOUBLE AS score FROM expecting),
{_suggest()}"""
PAGE_HOSTS = "hosts AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM pages)"
LABEL = """labelled AS (
    SELECT *, list_transform(string_split(lower(domain), '.')[1:-2], lambda x, i: {'n': -len(x), 'i': i, 'x': x}) AS parts FROM hosts),
longest AS (SELECT *, list_min(parts).x AS label FROM labelled),
letters AS (SELECT page_id, unnest(string_split(label, '')) AS c FROM longest),
shares AS (SELECT page_id, c, count(*) / sum(count(*)) OVER (PARTITION BY page_id) AS p FROM letters GROUP BY page_id, c),
entropies AS (SELECT page_id, round(-sum(p * log2(p)), 4) AS label_entropy FROM shares GROUP BY page_id)"""

CASE_SQL = """contexts AS (
    SELECT 'case-' || doc_id AS case_id, ['ransomware', 'phishing', 'network_intrusion', 'unknown', 'insider_threat', 'malware'][doc_id % 6 + 1] AS case_type,
        CASE WHEN doc_id % 2 = 0 THEN 'pcap,memory_dump' ELSE 'pcap,disk_image' END AS types FROM documents WHERE doc_id IS NOT NULL)"""
CHAINS = """chains AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 300 <> 0 THEN c_custkey - 1 END AS up, c_custkey % 450 = 299 AS is_flagged FROM customer),
known AS (SELECT c.*, c.up IS NOT NULL AND c.up IN (SELECT key FROM chains) AS has_parent FROM chains c)"""
TREES = EV.replace("CASE event_type WHEN 'purchase' THEN 'network_connection'", "CASE WHEN event_id % 4 = 0 THEN 'process_tree' ELSE CASE event_type WHEN 'purchase' THEN 'network_connection'").replace("WHEN 'signup' THEN 'process' ELSE 'injected_code' END AS evidence_type", "WHEN 'signup' THEN 'process' ELSE 'injected_code' END END AS evidence_type")
MIXED_KEYS = SIGNALS.replace("FROM_TABLE", "mixed").replace("WHEN evidence_type = 'dns_query' THEN [", "WHEN evidence_type IN ('dns_query', 'http_request') THEN [")
MATCHED_ORDER = ORDER.replace("-confidence", "-(len(ioc_match) > 0)::INTEGER, -confidence")

#: The whole chain: two tools, first-wins, the second tool's known processes left out, re-scored, a machine for all, then keys, pairs and members.
CHAIN = (
    """both_tools AS (SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN machine_id END AS machine_id) FROM ev
    UNION ALL SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN machine_id END AS machine_id, 'x.exe (PPID:1 PID:' || (split_part(artifact_id, '_', 2)::BIGINT + 1000) || ')' AS value, 'memprocfs' AS source_tool,
        'memprocfs_process' AS evidence_type, 'second_' || seq AS artifact_id, seq + 1000000000 AS seq) FROM ev WHERE evidence_type = 'file_artifact')""",
    "firsts AS (SELECT * FROM both_tools QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY seq) = 1)",
    r"""reconciled AS (SELECT * REPLACE (coalesce(machine_id, 'WS-1') AS machine_id) FROM firsts WHERE evidence_type <> 'memprocfs_process' OR regexp_extract(value, ' PID:(\d+)', 1) NOT IN
        (SELECT regexp_extract(value, '\(PID:(\d+)', 1) FROM firsts WHERE evidence_type = 'process'))""",
    rescored("reconciled"),
    "first_items AS (SELECT * FROM rescored)",
    ON_FIRST,
    KEYS.replace(ORDER, MATCHED_ORDER),
)
ALL_FINDINGS = "SELECT correlation_type, key, anchor, n_items, confidence FROM kept UNION ALL SELECT 'exfiltration', anchor, anchor, n_files + 1, confidence FROM exfil_scored UNION ALL SELECT 'linked_artifact', source_id, anchor, n_items, confidence FROM link_rows"

def _u(*parts: str) -> str:
    """A number below 1 from the first 52 bits of a SHA-256."""
    return "(('0x' || substr(sha256(concat_ws('|', 42, " + ", ".join(parts) + ")), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _c(n: str) -> str:
    """Mean path among n rows."""
    return f"(CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1)::DOUBLE / {n} END)::DOUBLE"


def _forest(baseline: str, levels: int = 8) -> tuple[str, ...]:
    """200 trees of at most 256 rows for each family, a pair of tables for each level, and model_scores (family, x, model_score) of all vectors."""
    x_of = "[" + F_LIST + "]"
    lists = lambda how: "[" + ", ".join(f"{how}(x[{i}])" for i in range(1, 15)) + "]"
    ctes = [
        f"base AS MATERIALIZED (SELECT family, {x_of} AS x, count(*) AS n_rows FROM feats WHERE {baseline} GROUP BY ALL)",
        "ranked_base AS MATERIALIZED (SELECT *, row_number() OVER w AS no, sum(n_rows) OVER w AS till, sum(n_rows) OVER (PARTITION BY family) AS total FROM base WINDOW w AS (PARTITION BY family ORDER BY x))",
        f"places AS (SELECT family, tree, floor((i + {_u("'draw'", 'family', 'tree', 'i')}) * total / 256)::BIGINT AS at FROM (SELECT DISTINCT family, total FROM ranked_base WHERE total > 256), range(0, 200) t(tree), range(0, 256) r(i))",
        """drawn AS (SELECT family, tree, no, n_rows AS w FROM ranked_base, range(0, 200) t(tree) WHERE total <= 256
            UNION ALL SELECT p.family, p.tree, b.no, count(*) FROM places p JOIN ranked_base b ON p.family = b.family AND p.at < b.till AND p.at >= b.till - b.n_rows GROUP BY ALL)""",
        "level0 AS MATERIALIZED (SELECT d.family, d.tree, 1::BIGINT AS node, d.w, b.x, least(b.total, 256) AS n_all FROM drawn d JOIN ranked_base b ON d.family = b.family AND d.no = b.no)",
        f"everyone AS (SELECT DISTINCT family, {x_of} AS x FROM feats)",
        "at0 AS (SELECT family, x, tree, 1::BIGINT AS node FROM everyone, range(0, 200) t(tree))",
    ]
    for d in range(levels + 1):
        ctes.append(f"""nodes{d} AS MATERIALIZED (
            SELECT family, tree, node, n, n_all, f, CASE WHEN f IS NOT NULL THEN CASE WHEN low[f] + {_u("'cut'", 'family', 'tree', 'node')} * (high[f] - low[f]) < high[f]
                THEN low[f] + {_u("'cut'", 'family', 'tree', 'node')} * (high[f] - low[f]) ELSE low[f] END END AS cut
            FROM (SELECT *, CASE WHEN {d} < greatest(1, ceil(log2(n_all))) THEN list_filter(range(1, 15), lambda i: high[i] > low[i]) ELSE [] END AS differ, differ[floor({_u("'feature'", 'family', 'tree', 'node')} * len(differ))::INT + 1] AS f
                  FROM (SELECT family, tree, node, sum(w) AS n, any_value(n_all) AS n_all, {lists('min')} AS low, {lists('max')} AS high FROM level{d} GROUP BY family, tree, node)))""")
        step = "JOIN nodes{0} k ON l.family = k.family AND l.tree = k.tree AND l.node = k.node".format(d)
        ctes.append(f"level{d + 1} AS MATERIALIZED (SELECT l.family, l.tree, 2 * l.node + (l.x[k.f] > k.cut)::INT AS node, l.w, l.x, l.n_all FROM level{d} l {step} WHERE k.f IS NOT NULL)")
        ctes.append(f"at{d + 1} AS MATERIALIZED (SELECT l.family, l.x, l.tree, 2 * l.node + (l.x[k.f] > k.cut)::INT AS node FROM at{d} l {step} WHERE k.f IS NOT NULL)")
        ctes.append(f"leaf{d} AS MATERIALIZED (SELECT l.family, l.x, {d} + {_c('k.n')} AS path, k.n_all FROM at{d} l {step} WHERE k.f IS NULL)")
    leaves = " UNION ALL ".join(f"SELECT * FROM leaf{d}" for d in range(levels + 1))
    ctes.append(f"raw AS MATERIALIZED (SELECT family, x, -pow(2, -avg(path) / greatest({_c('any_value(n_all)')}, 1e-9)) AS raw FROM ({leaves}) GROUP BY family, x)")
    ctes.append(f"least_normal AS (SELECT family, quantile_cont(raw, 0.01) AS offset_ FROM (SELECT family, {x_of} AS x FROM feats WHERE {baseline}) JOIN raw USING (family, x) GROUP BY family)")
    ctes.append("model_scores AS MATERIALIZED (SELECT e.family, e.x, coalesce(round(r.raw - o.offset_, 12) + 0.0::DOUBLE, 0.0::DOUBLE) AS model_score FROM everyone e LEFT JOIN raw r USING (family, x) LEFT JOIN least_normal o ON e.family = o.family)")
    return tuple(ctes)


FOREST = _forest("severity = 'low' AND seq % 7 = 0")

PLANTED = rf"""planted AS (
    SELECT doc_id, coalesce(text, '') || chr(10) || 'pay ' || {texts(q.PLANTED_WALLETS)}[doc_id % {len(q.PLANTED_WALLETS)} + 1] || ' GET http://callback-' || doc_id % 6 || '.xyz/gate.php Host: beacon' || doc_id % 3 || '.example.to api.svc' || doc_id % 4 ||
        '.net:8443 seen across' || doc_id % 2 || '.com microsoft.com.evil.ru www.microsoft.com COMMAND.COM main.py lib.so f0hht.ht x.com -bad.org HKLM\Software\Run' || doc_id % 4 || '|x \Registry\User\S' || doc_id % 2 || ' a.b' || doc_id % 5 ||
        '@evil-mail.org ..x@a.com 12@34.com a@b.py ABCDEFGHIJKLMNOP' || doc_id % 7 || '.onion hklm\software\run1' AS text FROM documents)"""
ENDINGS = _inlist([*extraction.GENERIC_TLDS, *extraction.COUNTRY_TLDS])
WALLET_ROWS = r"""wallet_found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b')) AS value FROM planted),
wallet_limbs AS (
    SELECT doc_id, value, list_reduce(list_transform(string_split(value, ''), lambda c: [strpos('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', c)::HUGEINT - 1, 0]),
        lambda a, d: [(a[1] * 58 + d[1]) % (1::HUGEINT << 100), a[2] * 58 + (a[1] * 58 + d[1]) // (1::HUGEINT << 100)]) AS v FROM wallet_found),
wallet_bytes AS (SELECT doc_id, value, list_reduce(list_transform([v[2] // (1::HUGEINT << 60), v[2] // (1::HUGEINT << 20) % (1::HUGEINT << 40), v[2] % (1::HUGEINT << 20) * (1::HUGEINT << 20) + v[1] // (1::HUGEINT << 80),
        v[1] // (1::HUGEINT << 40) % (1::HUGEINT << 40), v[1] % (1::HUGEINT << 40)], lambda x: lpad(lower(to_hex(x::BIGINT)), 10, '0')), lambda x, y: x || y) AS h FROM wallet_limbs WHERE v[2] < (1::HUGEINT << 100)),
wallet_rows AS (SELECT doc_id, value FROM wallet_bytes WHERE left(sha256(unhex(sha256(unhex(left(h, 42))))), 8) = right(h, 8))"""
REGISTRY_ROWS = r"""registry_rows AS (SELECT DISTINCT doc_id, unnest(list_concat(
        regexp_extract_all(text, '(?i)(?:HKLM|HKEY_LOCAL_MACHINE|HKCU|HKEY_CURRENT_USER|HKCR|HKEY_CLASSES_ROOT|HKU|HKEY_USERS)\\[^\s"''|]+'), regexp_extract_all(text, '(?i)\\Registry\\(?:Machine|User)\\[^\s"''|]+'))) AS value FROM planted)"""
SWEEP_ROWS = rf"""onion_rows AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{16,56}}\.onion')) AS value FROM planted),
mail_rows AS (SELECT * FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,24}}')) AS value FROM planted)
    WHERE regexp_matches(value, '^[^@]*[A-Za-z][^@]*@') AND NOT regexp_matches(value, '^\.|\.@|\.\.[^@]*@') AND regexp_matches(value, '@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]\.[A-Za-z]+$')
        AND lower(regexp_extract(value, '[A-Za-z]+$')) IN {ENDINGS} AND lower(regexp_extract(value, '[A-Za-z]+$')) NOT IN {_inlist(extraction.AMBIGUOUS_TLDS)}),
host_found AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '(?i)(?:^|[^@\\])\b((?:[a-z0-9-]{{1,63}}\.)+[a-z]{{2,24}}\b)', 1)) AS found FROM planted),
host_parts AS (SELECT *, lower(found) AS value, string_split(lower(found), '.') AS labels FROM host_found),
host_named AS (SELECT *, labels[-1] AS tld, labels[-2] AS sld, len(labels) AS n, list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')) AS ends FROM host_parts),
host_good AS (SELECT *, starts_with(value, 'www.') OR regexp_matches(text, '(?i)(//|(host:|referer:|referrer:|location:|origin:|url=|uri=).{{0,10}})' || regexp_escape(found) || '([^a-z0-9.-]|$)')
        OR regexp_matches(text, '(?i)(^|[^a-z0-9.-])' || regexp_escape(found) || '([/?]|:[0-9])') AS anchored FROM host_named
    WHERE tld IN {ENDINGS} AND length(sld) >= 2 AND len(list_filter(labels, lambda x: starts_with(x, '-') OR ends_with(x, '-'))) = 0 AND NOT (tld IN {_inlist(extraction.AMBIGUOUS_TLDS)} AND n < 3)
        AND NOT list_has_any(ends, {texts(extraction.BENIGN_DOMAINS)})),
host_rows AS (SELECT doc_id, value, max(CASE WHEN anchored THEN 0.45 ELSE 0.2 END)::DOUBLE AS confidence FROM host_good WHERE anchored OR n <> 2
    OR NOT (length(tld) = 2 AND length(sld) < 4 OR tld = 'com' AND sld IN {_inlist(extraction.DOS_COMMANDS)}
        OR length(tld) = 2 AND (NOT contains(sld, '-') AND regexp_matches(sld, '[0-9]') OR ends_with(sld, tld) AND length(sld) - length(replace(sld, tld, '')) >= 4)) GROUP BY ALL),
swept AS (SELECT 0 AS kind, doc_id, value, 'suspicious_domain' AS evidence_type, 'high' AS severity, 0.95::DOUBLE AS confidence FROM onion_rows UNION ALL SELECT 1, doc_id, value, 'suspicious_crypto', 'high', 0.93 FROM wallet_rows
    UNION ALL SELECT 2, doc_id, value, 'email_address', 'medium', 0.85 FROM mail_rows UNION ALL SELECT 3, doc_id, value, 'registry_key', 'medium', 0.88 FROM registry_rows UNION ALL SELECT 4, doc_id, value, 'suspicious_domain', 'low', confidence FROM host_rows)"""

def _pick(feature: str, values: dict[str, str]) -> str:
    quoted = ", ".join("'" + k + "': '" + v.replace("'", "''") + "'" for k, v in values.items())
    return f"(MAP {{{quoted}}})[{feature}]"


_MEANING = lambda f: _pick(f, explain.MEANINGS)
_SENTENCE, _LABEL = {k: s for k, (_, s) in explain.SENTENCES.items()}, {k: n for k, (n, _) in explain.SENTENCES.items()}
_SHOWN = lambda f: f"coalesce({_pick(f, explain.SHOWN)}, {f})"
_PERCENT = "printf('%.0f%%', anomaly_confidence * 100)"
_UNPIVOT = " UNION ALL ".join(f"SELECT family, x, {i} AS i, '{f}' AS feature, x[{i + 1}] AS value FROM everyone" for i, f in enumerate(features.FEATURES))
_X = "[" + F_LIST + "]"
_LEADS = ", ".join(f"CASE WHEN {f} > 0 THEN '{f}' END" for f, _ in sorted(features.INDICATORS, key=lambda x: -x[1]))
#: From feats and model_scores: factors of the rules, comparisons, scores and texts of every item (told).
EXPLAINED = (
    f"longer AS MATERIALIZED ({_UNPIVOT})",
    "means AS MATERIALIZED (SELECT l.family, l.feature, avg(l.value) AS mean FROM longer l JOIN (SELECT family, " + _X + " AS x FROM feats WHERE severity = 'low' AND seq % 7 = 0) b ON l.family = b.family AND l.x = b.x GROUP BY ALL)",
    "phis AS (SELECT l.*, round((MAP {" + ", ".join(f"'{f}': {w}::DOUBLE" for f, w in features.WEIGHTS.items()) + "})[l.feature] * (value - mean), 6) + 0.0::DOUBLE AS phi FROM longer l JOIN means m USING (family, feature) WHERE l.feature IN " + _inlist(list(features.WEIGHTS)) + ")",
    "top_factors AS (SELECT family, x, list({'feature': feature, 'phi': phi} ORDER BY n) AS factors FROM (SELECT *, row_number() OVER (PARTITION BY family, x ORDER BY abs(phi) DESC, i) AS n FROM phis) WHERE n <= 5 GROUP BY ALL)",
    """top_comparisons AS (SELECT family, x, list({'feature': feature, 'x': value, 'mean': round(mean, 4), 'side': CASE WHEN value > mean THEN 'above baseline' ELSE 'below baseline' END} ORDER BY n) AS comparisons
        FROM (SELECT l.*, mean, row_number() OVER (PARTITION BY family, x ORDER BY round(abs(value - mean), 4) DESC, i) AS n FROM longer l JOIN means USING (family, feature) WHERE round(abs(value - mean), 4) > 0) WHERE n <= 5 GROUP BY ALL)""",
    f"final AS (SELECT f.*, m.model_score, round({RULE}, 4) AS rule_score, round(m.model_score + ({RULE}), 4) AS score, round(m.model_score + ({RULE}), 9) < -0.1 AS is_anomaly, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 - (m.model_score + ({RULE})))), 4) AS anomaly_confidence, m.x FROM feats f JOIN model_scores m ON f.family = m.family AND {_X} = m.x)",
    f"""gathered AS (SELECT f.*, coalesce(t.factors, []) AS factors, coalesce(c.comparisons, []) AS comparisons, list_filter(coalesce(t.factors, []), lambda e: e.phi < 0) AS drivers, list_filter([{_LEADS}], lambda e: e IS NOT NULL) AS leads
        FROM final f LEFT JOIN top_factors t ON f.family = t.family AND f.x = t.x LEFT JOIN top_comparisons c ON f.family = c.family AND f.x = c.x)""",
    f"""told AS MATERIALIZED (SELECT *, CASE WHEN is_anomaly AND len(drivers) = 0 THEN ['{explain.MANUAL_REVIEW}'] ELSE list_transform(drivers, lambda e: {_pick('e.feature', explain.ACTIONS)})[1:5] END AS actions,
        CASE WHEN NOT is_anomaly THEN printf('Artifact %s (%s) matches expected baseline behaviour. No suspicious indicators were triggered. Anomaly score %+.3f is within the normal operating range.', artifact_id, evidence_type, score)
            WHEN len(leads) = 0 THEN printf('Artifact %s (%s) was flagged as statistically anomalous (score %+.3f) due to a combination of feature values that deviate from the trained baseline. Manual review is recommended: "%s".', artifact_id, evidence_type, score, left(value, 120))
            ELSE printf('Potentially malicious activity detected in %s artifact %s (anomaly score %+.3f, confidence %s). Primary indicator — %s: %s%s Observed value: "%s".', evidence_type, artifact_id, score, {_PERCENT}, {_pick('leads[1]', _LABEL)}, {_pick('leads[1]', _SENTENCE)},
                CASE WHEN len(leads) > 1 THEN ' Additionally: ' || array_to_string(list_transform(leads[2:3], lambda e: {_pick('e', _SENTENCE)}), ' ') ELSE '' END, left(value, 120)) END AS reason,
        CASE WHEN is_anomaly AND len(drivers) > 0 THEN 'Artifact ' || artifact_id || ' was flagged because its strongest anomaly drivers were ' || array_to_string(list_transform(drivers[1:3], lambda e: rtrim({_MEANING('e.feature')}, '.')), ', ') || '.'
            WHEN is_anomaly THEN 'Artifact ' || artifact_id || ' was flagged because its final score fell below the anomaly threshold.'
            ELSE 'Artifact ' || artifact_id || ' appears consistent with the trained baseline for this ' || evidence_type || ' evidence.' END AS plain_english,
        printf('Model score %+.4f, rule score %+.4f, final score %+.4f, threshold -0.1000, confidence %s.', model_score, rule_score, score, {_PERCENT}) AS technical_explanation FROM gathered)""",
)
#: From told, keys, kept, pairs and exfil_scored: the first eight anomalies of each machine with their links and lists.
SECTION = (
    "top8 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY seq)::INTEGER AS row FROM told WHERE is_anomaly QUALIFY row <= 8)",
    """entries AS MATERIALIZED (SELECT DISTINCT t.artifact_id, k.correlation_type, k.key, s.anchor, s.confidence FROM top8 t JOIN keys k ON t.artifact_id = k.artifact_id JOIN kept s ON s.correlation_type = k.correlation_type AND s.key = k.key
        UNION SELECT t.artifact_id, 'exfiltration', e.anchor, e.anchor, e.confidence FROM top8 t JOIN pairs p ON t.artifact_id IN (p.file_id, p.conn_id) JOIN exfil_scored e ON e.anchor = p.conn_id)""",
    """others AS (SELECT e.correlation_type, e.key, k.artifact_id, k.seq FROM (SELECT DISTINCT correlation_type, key, anchor FROM entries) e JOIN keys k ON k.correlation_type = e.correlation_type AND k.key = e.key AND k.artifact_id <> e.anchor
        UNION SELECT 'exfiltration', conn_id, file_id, file_seq FROM pairs)""",
    "firsts AS (SELECT correlation_type, key, list(artifact_id ORDER BY seq)[1:3] AS matches FROM others GROUP BY ALL)",
    """ranked AS (SELECT e.*, coalesce(f.matches, []) AS matches, row_number() OVER (PARTITION BY e.artifact_id ORDER BY confidence DESC, e.correlation_type, e.key) AS n FROM entries e LEFT JOIN firsts f ON e.correlation_type = f.correlation_type AND e.key = f.key)""",
    "per AS (SELECT artifact_id, list({'anchor': anchor, 'kind': correlation_type, 'matches': matches} ORDER BY n) FILTER (n <= 5) AS found, count(*) AS n_all, count(*) FILTER (correlation_type = 'exfiltration') AS n_exfil FROM ranked GROUP BY 1)",
    """linked AS (SELECT t.*, coalesce(n_all, 0) AS n_all, coalesce(n_exfil, 0) AS n_exfil,
        list_concat(coalesce(p.found, []), CASE WHEN t.link IS NOT NULL AND len(list_filter(coalesce(p.found, []), lambda e: e.anchor = t.link)) = 0 THEN [{'anchor': t.link, 'kind': 'linked_artifact', 'matches': []::VARCHAR[]}] ELSE [] END)[1:5] AS links,
        CASE WHEN len(list_filter(comparisons, lambda e: e.side = 'above baseline')) > 0 THEN list_filter(comparisons, lambda e: e.side = 'above baseline') ELSE comparisons END[1:2] AS told_comparisons
        FROM top8 t LEFT JOIN per p ON t.artifact_id = p.artifact_id)""",
    f"""section AS (SELECT machine_id, row, seq,
        'Artifact ' || artifact_id || ' on ' || machine_id || ' was classified as anomalous because ' || CASE WHEN len(drivers) = 0 THEN 'the combined feature pattern deviated from the trained baseline'
            ELSE array_to_string(list_transform(drivers[1:3], lambda e: {_SHOWN('e.feature')} || ' (' || {_MEANING('e.feature')} || '; SHAP ' || printf('%+.4f', e.phi) || ')'), ', ') END || '. Observed evidence (' || evidence_type || '): "' || left(value, 180) || '".' ||
        CASE WHEN len(told_comparisons) = 0 THEN '' ELSE ' Compared with the relevant normal baseline, ' || array_to_string(list_transform(told_comparisons, lambda e: {_SHOWN('e.feature')} || ' was ' || e.side || ' (artifact ' || e.x || ', baseline ' || e.mean || ')'), '; ') || '.' END ||
        CASE WHEN len(links) = 0 THEN '' ELSE ' P4 correlation links this artifact to ' || array_to_string(list_transform(links[1:3], lambda e: e.anchor || ' via ' || e.kind || CASE WHEN len(e.matches) > 0 THEN ' with matching values ' || array_to_string(e.matches, ', ') ELSE '' END), '; ') || '.' END ||
        CASE WHEN n_all = 0 THEN '' ELSE ' At the case level, it appears in ' || n_all || ' aggregator correlation finding(s)' || CASE WHEN n_exfil > 0 THEN ' and it appears in ' || n_exfil || ' exfiltration finding(s)' ELSE '' END || '.' END ||
        printf(' The final anomaly score was %+.4f against threshold -0.1000, with confidence %s.', score, {_PERCENT}) || ' Recommended review: ' || array_to_string(actions[1:3], ' ') AS explain_instance,
        CASE WHEN len(factors) = 0 THEN '_No SHAP factors recorded._' ELSE array_to_string(list_transform(factors, lambda e: '- ' || {_SHOWN('e.feature')} || ': ' || CASE WHEN e.phi < 0 THEN 'increased' ELSE 'reduced' END || ' anomaly likelihood (SHAP ' || printf('%+.4f', e.phi) || ') — ' || {_MEANING('e.feature')}), chr(10)) END AS factor_lines,
        CASE WHEN len(comparisons) = 0 THEN '_No baseline comparison recorded._' ELSE array_to_string(list_transform(comparisons, lambda e: '- ' || {_SHOWN('e.feature')} || ': artifact=' || e.x || ', baseline=' || e.mean || ', ' || e.side), chr(10)) END AS comparison_lines,
        CASE WHEN len(links) = 0 THEN '_No P4 correlation context recorded._' ELSE array_to_string(list_transform(links, lambda e: '- ' || e.anchor || ' via ' || e.kind || CASE WHEN len(e.matches) > 0 THEN ' using ' || array_to_string(e.matches, ', ') ELSE '' END), chr(10)) END AS link_lines,
        array_to_string(list_transform(actions, lambda e: '- ' || e), chr(10)) AS review_lines FROM linked)""",
)

_ENDS = "(" + "|".join(e.replace(".", r"\.") for e in extraction.FILE_EXTENSIONS) + ")$"
_NET = rf"""net_lines AS ({q.LINES_SQL['connections']}), net_fields AS (SELECT value AS v, regexp_split_to_array(trim(value), '\s+') AS f FROM net_lines),
net AS (SELECT 'net_' || left(sha256(v), 12) AS artifact_id, f[2] || ' ' || f[3] || ':' || f[4] || ' -> ' || f[5] || ':' || f[6] || ' (PID:' || f[8] || ')' AS value, CASE WHEN f[6] IN ('4444', '1337') THEN 'high' ELSE 'low' END AS severity FROM net_fields WHERE len(f) >= 8)"""

ORACLE = {
    "evidence_view": with_ev(select="SELECT seq, case_id, machine_id, artifact_id, source_tool, evidence_type, timestamp, value, severity, confidence, coalesce(link, '') AS links FROM ev"),
    "contract": with_ev(
        select="""SELECT array_to_string(list_filter([CASE WHEN seq % 17 = 0 THEN 'missing:value' END, CASE WHEN seq % 11 = 0 THEN 'enum:severity' END,
        CASE WHEN seq % 13 = 0 AND confidence > 0 THEN 'range:confidence' END], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM ev GROUP BY 1"""
    ),
    "merge_tools": with_ev(select="SELECT source_tool, count(*) AS n, min(seq) AS first_seq FROM ev GROUP BY 1"),
    "dedup_first": with_ev(FIRST, select="SELECT seq, artifact_id, source_tool, evidence_type FROM first_items"),
    "dedup_strongest": with_ev(
        f"ranked AS (SELECT *, min(seq) OVER w AS first_seq, row_number() OVER (PARTITION BY evidence_type, lower(trim(value)), link ORDER BY {RANK} DESC, confidence DESC, seq) AS n FROM ev WINDOW w AS (PARTITION BY evidence_type, lower(trim(value)), link))",
        select="SELECT first_seq AS seq, evidence_type, value, severity, confidence FROM ranked WHERE n = 1",
    ),
    "reconcile_tools": with_ev(
        r"known AS (SELECT DISTINCT regexp_extract(value, '\(PID:(\d+)', 1) AS pid FROM ev WHERE evidence_type = 'process')",
        select="""SELECT seq, source_tool, evidence_type, value FROM ev
        UNION ALL SELECT seq, 'memprocfs', 'memprocfs_process', concat('x.exe (PPID:1 PID:', split_part(artifact_id, '_', 2)::BIGINT + 1000, ')') FROM ev
        WHERE evidence_type = 'file_artifact' AND cast(split_part(artifact_id, '_', 2)::BIGINT + 1000 AS varchar) NOT IN (SELECT pid FROM known)""",
    ),
    "evidence_order": with_ev(FIRST, select=f"SELECT seq, machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY {RANK} DESC, seq % 9 = 0 DESC, confidence DESC, source_tool, seq)::INTEGER AS place FROM first_items"),
    "group_index": with_ev(
        select="SELECT 'type' AS kind, evidence_type AS key, count(*) AS n FROM ev GROUP BY 2 UNION ALL SELECT 'tool', source_tool, count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'machine', machine_id, count(*) FROM ev GROUP BY 2"
    ),
    "enrich": with_ev(select="SELECT seq, CASE WHEN seq % 3 <> 0 THEN machine_id ELSE 'WS-1' END AS machine_id, value || ' end' AS normalized_value FROM ev"),
    "dedup_stats": with_ev(
        select="SELECT any_value(case_id) AS case_id, count(*) AS raw_items, count(*) - count(DISTINCT artifact_id) AS duplicates_removed, string_agg(DISTINCT source_tool, ',' ORDER BY source_tool) AS tools, count(DISTINCT artifact_id) AS total_items FROM ev"
    ),
    "sig_time": """SELECT event_id AS seq, CASE WHEN event_id % 5 < 4 THEN cast(floor(epoch(ts)) AS bigint) END AS epoch,
        CASE WHEN event_id % 5 < 4 THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S+00:00') ELSE 'not a time' END AS bucket FROM events""",
    "signals": with_ev(
        SIGNALS.replace("FROM_TABLE", "ev"),
        select="SELECT seq, array_to_string(pids, ',') AS pids, array_to_string(ips, ',') AS ips, array_to_string(paths, ',') AS paths, array_to_string(file_keys, ',') AS file_keys, array_to_string(domains, ',') AS domains, bytes_transferred, destination_ip, destination_port FROM keyed_signals",
    ),
    "document_ips": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{IP}'))) AS ip FROM documents",
    "url_hosts": "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages UNION SELECT page_id, host FROM (SELECT page_id, unnest(regexp_extract_all(lower(regexp_extract(url, '://[^/?#]*(.*)$', 1)), '\\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,}\\b')) AS host FROM pages) WHERE NOT regexp_matches(host, '\\.(exe|dll|txt|log|json|js|pdf|zip|png|jpg)$')",
    "finding_member": with_ev(*SHARED, select="SELECT k.correlation_type, k.key, s.anchor, k.artifact_id, s.confidence AS finding_confidence FROM keys k JOIN kept s ON k.correlation_type = s.correlation_type AND k.key = s.key"),
    "annotate": with_ev(*SHARED, select="SELECT i.artifact_id, count(DISTINCT m.finding) AS n_findings, max(m.confidence) AS best_confidence FROM first_items i LEFT JOIN members m USING (artifact_id) GROUP BY 1"),
    "findings": with_ev(
        *SHARED,
        LINKS,
        *LINK_SETS[:2],
        *_uncovered("true"),
        f"link_rows AS ({LINK_FINDINGS})",
        select="SELECT correlation_type, key, anchor, n_items, confidence FROM kept UNION ALL SELECT 'exfiltration', anchor, anchor, n_files + 1, confidence FROM exfil_scored UNION ALL SELECT 'linked_artifact', source_id, anchor, n_items, confidence FROM link_rows",
    ),
    "machine_summary": with_ev(
        *SHARED,
        "per AS (SELECT machine_id, artifact_id FROM first_items)",
        select="""SELECT machine_id, count(DISTINCT p.artifact_id) AS n_items, count(DISTINCT m.finding) AS n_findings FROM per p LEFT JOIN members m USING (artifact_id) GROUP BY 1
        UNION ALL SELECT NULL, count(DISTINCT p.artifact_id), count(DISTINCT m.finding) FROM per p LEFT JOIN members m USING (artifact_id)""",
    ),
    "exfil_window": with_ev(*SHARED, select="SELECT anchor, n_files, array_to_string(tools, ',') AS source_tools, bytes_transferred, destination, file, confidence FROM exfil_scored"),
    "exfil_pairs_by_machine": with_ev(*SHARED, select="SELECT conn_id, file_id FROM pairs WHERE c_machine = f_machine"),
    "linked_targets": with_ev(FIRST, LINKS, select="SELECT source_id, target, target_id FROM resolved"),
    "linked_artifacts": with_ev(FIRST, LINKS, *LINK_SETS, select=LINK_FINDINGS),
    "linked_uncovered": with_ev(*SHARED, LINKS, *LINK_SETS[:2], *_uncovered("regexp_matches(m.finding, '[0-4]$')"), select=LINK_FINDINGS),
    "rescore": with_ev(rescored("ev"), select="SELECT seq, severity, array_to_string(ioc_match, ',') AS ioc_match, boosted FROM rescored"),
    "reputation": with_ev(
        select="""SELECT seq, CASE WHEN contains(value, '198.51.100.7:') THEN '198.51.100.7' ELSE 'node7.example.net' END AS bad FROM ev
        WHERE contains(value, '198.51.100.7:') OR regexp_matches(value, '-> (www\\.)?node7\\.example\\.net$')"""
    ),
    "c2_port": with_ev(select=r"SELECT seq, cast(unnest(list_distinct(regexp_extract_all(lower(value), '[\w.]:(\d{2,5})\b', 1))) AS integer) AS port FROM ev"),
    "derived_iocs": with_ev(FIRST, _derived("first_items"), select="SELECT artifact_id, value, severity, confidence, linked FROM derived"),
    "techniques": with_ev(
        select="SELECT t.technique, t.name AS technique_name, count(*) AS n FROM ev JOIN (VALUES ('powershell', 'T1059', 'PowerShell'), ('injection', 'T1055', 'Process Injection'), ('ransomware', 'T1486', 'Data Encrypted for Impact'), ('smb', 'T1021', 'Remote Services')) t(word, technique, name) ON contains(lower(ev.value), t.word) GROUP BY ALL"
    ),
    "run_totals": with_ev(
        rescored("ev"),
        _derived("rescored"),
        select="SELECT 'case-1' AS case_id, count(*) AS total, count(*) FILTER (kind = 'ioc') AS iocs, count(*) FILTER (severity = 'critical') AS critical FROM (SELECT evidence_type AS kind, severity FROM rescored UNION ALL SELECT 'ioc', severity FROM derived)",
    ),
    "conv_rollup": with_ev(PACKETS, select=f"SELECT src, dst, dport, sum(length)::BIGINT AS bytes, count(*) AS packets, min(epoch) AS first_epoch, CASE WHEN dport IN ({WATCHED}) THEN 'high' ELSE 'low' END AS severity FROM packets GROUP BY src, dst, dport"),
    "watch_port": with_ev(PACKETS, select=f"SELECT dport, first(src ORDER BY seq) AS src, first(dst ORDER BY seq) AS dst, first(epoch ORDER BY seq) AS epoch, count(*) AS packets FROM packets WHERE dport IN ({WATCHED}) GROUP BY dport"),
    "dns_score": f"WITH {PAGE_HOSTS}, {LABEL} SELECT page_id, domain, label, label_entropy, CASE WHEN len(label) >= 12 AND label_entropy >= 3.8 THEN 'high' ELSE 'low' END AS severity FROM longest JOIN entropies USING (page_id)",
    "http_rows": "SELECT 'http_' || left(md5(regexp_extract(url, '://[^/?#]*(.*)$', 1)), 8) AS artifact_id, 'HTTP request: ' || regexp_extract(url, '://([^/?#]*)', 1) || regexp_extract(url, '://[^/?#]*(.*)$', 1) AS value, 'medium' AS severity, 0.75::DOUBLE AS confidence FROM pages",
    "mail_hits": f"SELECT doc_id, unnest(list_filter({texts(q.MAIL_WORDS)}, lambda w: contains(lower(text), w))) AS word FROM documents",
    "url_hits": f"SELECT page_id, url FROM pages WHERE {holds('lower(url)', q.URL_WORDS)}",
    "domains": """SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS value, 0.45::DOUBLE AS confidence FROM pages
        UNION SELECT page_id, 'bad-x' || page_id % 5 || '.example.ru', 0.45 FROM pages UNION SELECT page_id, 'www.other' || page_id % 3 || '.org', 0.45 FROM pages
        UNION SELECT page_id, unnest(['deep.host.py', 'plain-site.de', 'plainsite.de']), 0.20 FROM pages""",
    "mails": r"""WITH found AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text || ' a.b@lib.dd c.d@host-' || doc_id % 5 || '.uk e@task.pf f@main.py', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}'))) AS value FROM documents)
        SELECT * FROM found WHERE regexp_matches(value, '^[^@]*[A-Za-z][^@]*@') AND NOT regexp_matches(value, '^\.|\.@|\.\..*@') AND regexp_matches(value, '@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]\.(com|net|org|uk)$')""",
    "onions": r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text || ' Visit ABCDEFGHIJKLMNOP' || doc_id % 7 || '.onion now'), '[a-z0-9]{16,56}\.onion'))) AS value FROM documents",
    "wallets": f"WITH {PLANTED}, {WALLET_ROWS} SELECT doc_id, value FROM wallet_rows",
    "registry_keys": f"WITH {PLANTED}, {REGISTRY_ROWS} SELECT doc_id, value FROM registry_rows",
    "sweep": f"WITH {PLANTED}, {WALLET_ROWS}, {REGISTRY_ROWS}, {SWEEP_ROWS} SELECT doc_id, value, evidence_type, severity, confidence FROM swept QUALIFY row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY kind, value) = 1",
    "process_edges": with_ev(
        r"p AS (SELECT DISTINCT regexp_extract(value, '\(PID:(\d+)', 1) AS pid, regexp_extract(value, 'PPID:(\d+)', 1) AS ppid, split_part(value, ' ', 1) AS name FROM ev WHERE evidence_type = 'process')",
        select=f"SELECT DISTINCT a.pid AS parent_pid, a.name AS parent_name, c.pid AS child_pid, c.name AS child_name FROM p c JOIN p a ON a.pid = c.ppid WHERE (a.name, c.name) IN ({', '.join(str(r) for r in extraction.RELATIONS)})",
    ),
    "classify_texts": f"SELECT doc_id, {_pick} AS case_type, {_conf} AS classifier_confidence FROM documents",
    "classify_conversations": f"SELECT {_pick} AS case_type, count(*) AS n, max({_conf}) AS best FROM conversations GROUP BY 1",
    "artifact_types": f"SELECT doc_id, coalesce(nullif(array_to_string(list_filter({_types}, lambda x: x IS NOT NULL), ','), ''), 'memory_dump') AS artifact_types FROM documents",
    "affected": r"""WITH t AS (SELECT doc_id, concat('HOST WIN-', doc_id % 9, ' DC01 HTTP ', text) AS text FROM documents),
        named AS (SELECT doc_id, regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b') AS ips, list_filter(regexp_extract_all(text, '\b[A-Z][A-Z0-9\-]{3,}\b'), lambda h: len(h) <= 15 AND regexp_matches(h, '[0-9-]') AND h NOT IN ('HTTP', 'HTTPS', 'WIN32', 'WIN64'))[1:3] AS hosts FROM t),
        flat AS (SELECT doc_id, unnest(list_concat(ips, hosts)) AS x, generate_subscripts(list_concat(ips, hosts), 1) AS i FROM named),
        distinct_rows AS (SELECT doc_id, x, min(i) AS i FROM flat GROUP BY doc_id, x),
        firsts AS (SELECT * FROM distinct_rows QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 5)
        SELECT doc_id, string_agg(x, ',' ORDER BY i) AS affected_systems FROM firsts GROUP BY 1""",
    "reconcile_cases": with_ev(
        RECONCILE,
        select=f"""SELECT case_id, case_type, round(score, 4) AS support_score, array_to_string(list_sort(list_intersect(expected, present)), ',') AS supporting, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(present, x))), ',') AS absent,
        coalesce(score < 0.5, false) AS diverged, CASE WHEN score < 0.5 THEN least(round(0.8::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * score / 0.5::DOUBLE), 2), 0.8::DOUBLE) ELSE 0.8::DOUBLE END AS reconciled_confidence,
        CASE WHEN score < 0.5 THEN n{len(classify.EXPECTED_TYPES) - 1} END AS suggested_type FROM {_LAST}""",
    ),
    "tree_rows": "WITH ev AS (" + TREES + "), " + rescored("ev") + """, keys AS (SELECT *, evidence_type = 'process_tree' AS t FROM rescored)
        SELECT k.seq, k.evidence_type, CASE WHEN t THEN (SELECT e.severity FROM ev e WHERE e.seq = k.seq) ELSE k.severity END AS severity, CASE WHEN t THEN '' ELSE array_to_string(k.ioc_match, ',') END AS ioc_match,
            CASE WHEN t THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(value, '(?i)\\bpid[:\\s#]*(\\d+)\\b', 1), regexp_extract_all(artifact_id, '(?i)\\b(?:proc|cmdline|net|malfind)_(\\d+)\\b', 1)))), ',') END AS pids,
            CASE WHEN t THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(value, '""" + IP + """'))), ',') END AS ips,
            CASE WHEN NOT t AND evidence_type = 'file_artifact' THEN replace(regexp_extract(value, '/\\S+'), '/', '\\') ELSE '' END AS paths FROM keys k""",
    "cross_source_domains": with_ev(
        """mixed AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'browser' ELSE source_tool END AS source_tool, CASE WHEN seq % 3 = 0 THEN 'http_' || seq ELSE artifact_id END AS artifact_id, CASE WHEN seq % 3 = 0 THEN 'http_request' ELSE evidence_type END AS evidence_type) FROM ev WHERE evidence_type = 'dns_query')""",
        MIXED_KEYS,
        "keys AS (SELECT unnest(domains) AS key, * FROM keyed_signals)",
        f"shared AS (SELECT key, count(*) AS n_items, string_agg(DISTINCT source_tool, ',' ORDER BY source_tool) AS source_tools, count(DISTINCT source_tool) AS n_tools, count(DISTINCT evidence_type) AS n_types, first(artifact_id ORDER BY {ORDER}) AS anchor FROM keys GROUP BY 1)",
        select="SELECT 'same_domain' AS correlation_type, key, anchor, n_items, source_tools, least(75 + 6 * least(n_tools, 4) + 3 * least(n_items - 1, 5), 99) / 100.0::DOUBLE AS confidence FROM shared WHERE n_items >= 2 AND (n_tools >= 2 OR n_types >= 2)",
    ),
    "aggregate": with_ev(*CHAIN, LINKS, *LINK_SETS[:2], *_uncovered("true"), f"link_rows AS ({LINK_FINDINGS.replace(ORDER, MATCHED_ORDER)})", select=ALL_FINDINGS),
    "aggregate_items": with_ev(
        *CHAIN,
        "named AS (SELECT artifact_id, count(DISTINCT finding) AS n FROM members GROUP BY 1)",
        select=f"""SELECT row_number() OVER (ORDER BY {RANK} DESC, len(ioc_match) > 0 DESC, confidence DESC, source_tool, seq) AS place, seq, artifact_id, machine_id, severity, array_to_string(ioc_match, ',') AS ioc_match,
        coalesce(n, 0) AS n_findings FROM first_items LEFT JOIN named USING (artifact_id)""",
    ),
    "aggregate_index": with_ev(
        *CHAIN[:5],
        select="SELECT 'type' AS kind, evidence_type AS key, count(*) AS n FROM first_items GROUP BY 2 UNION ALL SELECT 'tool', source_tool, count(*) FROM first_items GROUP BY 2 UNION ALL SELECT 'machine', machine_id, count(*) FROM first_items GROUP BY 2",
    ),
    "case_facts": f"WITH {CASE_SQL} SELECT case_id, case_type, CASE case_type " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in classify.SUMMARIES.items()) + f" ELSE '{classify.SUMMARIES['unknown']}' END AS summary FROM contexts",
    "case_advice": f"WITH {CASE_SQL}, keyed AS (SELECT case_id, CASE WHEN case_type IN ('ransomware', 'phishing') THEN case_type ELSE 'unknown' END AS case_type FROM contexts) SELECT case_id, case_type, step::BIGINT AS step, 'step ' || step || ' for ' || case_type AS advice FROM keyed, (VALUES (1), (2)) s(step)",
    "checked_contexts": f"WITH {CASE_SQL} SELECT case_id, case_type, types AS artifact_types FROM contexts WHERE case_type IN ('ransomware', 'phishing', 'unknown', 'insider_threat')",
    "ontology_rules": """WITH p AS (SELECT CASE WHEN p_partkey % 17 <> 0 THEN 'tool_' || (p_partkey - p_partkey % 2) END AS name, p_partkey AS k FROM part),
        broken AS (SELECT 'name is missing' AS violation FROM p WHERE name IS NULL UNION ALL SELECT 'name is not known' FROM p WHERE name IS NOT NULL AND ((k - k % 2) % 4 <> 0 OR k >= 100000)
            UNION ALL SELECT 'input_types is empty' FROM p WHERE k % 5 = 0 UNION ALL SELECT 'default_order is missing' FROM p WHERE k % 7 = 0
            UNION ALL SELECT 'name is not unique' FROM (SELECT name FROM p GROUP BY name HAVING count(*) > 1))
        SELECT violation, count(*) AS n FROM broken GROUP BY 1""",
    "model_answers": "SELECT CASE WHEN doc_id % 3 <> 0 THEN 'case-' || doc_id ELSE 'made' END AS case_id, 'phishing' AS case_type, 'pcap' || coalesce(',' || lang, '') AS types, sha256(left(text, 40)) AS summary, '2024' AS generated_at FROM documents WHERE doc_id IS NOT NULL",
    "correlation_context": with_ev(
        *SHARED,
        "per AS (SELECT i.artifact_id, i.link, count(DISTINCT m.finding) AS n FROM first_items i LEFT JOIN members m USING (artifact_id) GROUP BY 1, 2)",
        select="SELECT artifact_id, (n + (link IS NOT NULL)::INTEGER)::INTEGER AS n_related, CASE WHEN n > 0 OR link IS NOT NULL THEN link IS NOT NULL END AS has_link FROM per",
    ),
    "finding_lookup": with_ev(*SHARED, select="SELECT artifact_id, count(DISTINCT finding) AS n_findings, first(finding ORDER BY confidence DESC, finding) AS strongest FROM members GROUP BY 1"),
    "case_context": with_ev(
        FIRST,
        ON_FIRST,
        KEYS.split("pairs AS (")[0].rstrip().rstrip(",").replace("SELECT correlation_type, key, count(*)", "SELECT machine_id AS case_id, correlation_type, key, count(*)"),
        KEYS[KEYS.index("pairs AS ("):].split("exfil AS (")[0].rstrip().rstrip(","),
        """own_exfil AS (SELECT c_machine AS case_id, conn_id, count(*) AS n_files, len(list_distinct(list_append(list(DISTINCT file_tool), any_value(conn_tool)))) AS n_tools FROM pairs WHERE c_machine = f_machine GROUP BY ALL)""",
        """found AS (SELECT case_id, correlation_type, key, confidence FROM kept UNION ALL
            SELECT case_id, 'exfiltration', conn_id, least(82 + 6 * least(n_tools, 4) + 3 * least(n_files, 5), 99) / 100.0::DOUBLE FROM own_exfil)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, correlation_type, key) AS n FROM found)",
        select="""SELECT case_id, count(*) AS n_findings, count(*) FILTER (correlation_type = 'exfiltration') AS n_exfiltration, string_agg(correlation_type || '|' || key, ',' ORDER BY n) FILTER (n <= 5) AS strongest,
            count(*) FILTER (correlation_type = 'exfiltration') > 0 AS has_exfiltration FROM placed GROUP BY 1""",
    ),
    "reasons": with_ev(FIRST, FEATURE_SQL, *FOREST, *EXPLAINED, select="SELECT seq, reason, plain_english, technical_explanation, array_to_string(actions, ' | ') AS actions FROM told"),
    "scored_items": with_ev(
        FIRST,
        FEATURE_SQL,
        *FOREST,
        *EXPLAINED,
        select="SELECT seq, family, round(model_score, 6) AS model_score, rule_score, score, is_anomaly, array_to_string(list_transform(factors, lambda f: f.feature), ',') AS factors, array_to_string(list_transform(comparisons, lambda f: f.feature), ',') AS comparisons FROM told",
    ),
    "explained_anomalies": with_ev(FIRST, ON_FIRST, KEYS, FEATURE_SQL, *FOREST, *EXPLAINED, *SECTION, select="SELECT machine_id, row, seq, explain_instance, factor_lines, comparison_lines, link_lines, review_lines FROM section"),
    "tree_summaries": """WITH RECURSIVE p AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1000000 ELSE c_custkey // 4 END AS up, CASE WHEN c_custkey % 9 = 0 THEN 'tasksche.exe' ELSE 'p' || c_custkey % 13 || '.exe' END AS name FROM customer),
        walk AS (SELECT key AS root, key, name, 0 AS depth, [key] AS path FROM p WHERE up NOT IN (SELECT key FROM p)
            UNION ALL SELECT w.root, p.key, p.name, w.depth + 1, list_append(w.path, p.key) FROM walk w JOIN p ON p.up = w.key WHERE w.depth < 5)
        SELECT 'process_tree_' || root AS artifact_id, 'process_tree' AS evidence_type, string_agg(repeat('  ', depth) || name || ' (PID:' || key || ')', chr(10) ORDER BY path) AS value, 'medium' AS severity, 0.95::DOUBLE AS confidence, '' AS ioc_match, '' AS pids
        FROM walk GROUP BY root""",
    "scored_rollup": with_ev(
        "first_ones AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY seq) = 1)",
        "plain AS (SELECT *, CAST([] AS VARCHAR[]) AS ioc_match FROM first_ones)",
        _indicators("plain"),
        ROLLUP.replace(f"{RANK} AS r FROM ind", f"CASE WHEN seq % 5 = 0 THEN 5 ELSE {RANK} END AS r FROM ind"),
        select="SELECT type, indicator, severity, confidence, n_artifacts, surfaced FROM rolled",
    ),
    "explanation_notes": with_ev(
        FIRST,
        "plain AS (SELECT *, CAST([] AS VARCHAR[]) AS ioc_match FROM first_items)",
        _indicators("plain"),
        "firsts AS (SELECT type, indicator, first(value ORDER BY artifact_id) AS note FROM ind WHERE seq % 6 = 0 GROUP BY 1, 2)",
        select="SELECT type, indicator, CASE WHEN length(note) <= 40 THEN note ELSE rtrim(coalesce(nullif(regexp_replace(left(note, 40), '(?s) [^ ]*$', ''), ''), left(note, 40))) || '…' END AS note FROM firsts",
    ),
    "explanations": """SELECT CASE WHEN doc_id % 2 = 1 THEN 'a' || doc_id ELSE 'k' || doc_id END AS artifact_id, doc_id % 5 = 0 AS is_anomaly, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'informational' END AS severity,
        CASE WHEN doc_id % 8 = 0 THEN 'in short' WHEN doc_id % 4 = 0 THEN '-' ELSE 'why ' || doc_id END AS reason FROM documents WHERE doc_id IS NOT NULL""",
    "deep_closure": f"WITH RECURSIVE {CHAINS}, walk AS (SELECT key, up, has_parent FROM known WHERE is_flagged UNION SELECT p.key, p.up, p.has_parent FROM walk w JOIN known p ON w.has_parent AND p.key = w.up) SELECT key::VARCHAR AS pid, is_flagged FROM known WHERE key IN (SELECT key FROM walk)",
    "deep_tree": f"""WITH RECURSIVE {CHAINS}, walk AS (SELECT key, 0 AS depth, key::VARCHAR AS root FROM known WHERE NOT has_parent UNION ALL SELECT c.key, w.depth + 1, w.root FROM walk w JOIN known c ON c.has_parent AND c.up = w.key)
        SELECT row_number() OVER (ORDER BY root, depth)::INTEGER AS row, key::VARCHAR AS pid, depth FROM walk""",
    "feature_rows": with_ev(FIRST, FEATURE_SQL, select=f"SELECT seq, family, {F_LIST} FROM feats"),
    "rule_scores": with_ev(
        FIRST,
        FEATURE_SQL,
        SCORED,
        "banded AS (SELECT *, round(s, 4) AS score, s < -0.1 AS is_anomaly, CASE WHEN round(s, 4) < -0.4 THEN 5 WHEN round(s, 4) < -0.25 THEN 4 WHEN round(s, 4) < -0.1 THEN 3 ELSE 1 END AS band_rank, " + RANK + " AS own FROM scored)",
        select="SELECT seq, rule_score, score, is_anomaly, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - s)), 4) AS anomaly_confidence, CASE WHEN NOT is_anomaly THEN 'informational' ELSE CASE greatest(own, band_rank) WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' END END AS band FROM banded",
    ),
    "indicator_order": with_ev(
        FIRST,
        FEATURE_SQL,
        select="SELECT seq, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} > 0 THEN '{f}' END" for f, _ in sorted(features.INDICATORS, key=lambda x: -x[1])) + "], lambda x: x IS NOT NULL), ',') AS ranked FROM feats",
    ),
    "baseline_families": with_ev(
        FIRST,
        FEATURE_SQL,
        select="SELECT family, count(*) FILTER (severity = 'low' AND seq % 7 = 0 AND family <> 'process') AS n_baseline, CASE WHEN count(*) FILTER (severity = 'low' AND seq % 7 = 0 AND family <> 'process') > 0 THEN 'own' ELSE 'all' END AS baseline FROM feats GROUP BY 1",
    ),
    "baseline_diff": with_ev(
        FIRST,
        FEATURE_SQL,
        "base AS (SELECT * FROM feats WHERE severity = 'low' AND seq % 7 = 0)",
        f"base_long AS ({_long('base', 'family')})",
        "means AS (SELECT family, feature, avg(x) AS mean FROM base_long GROUP BY ALL)",
        f"own_long AS ({_long('feats', 'seq, family')})",
        "diffs AS (SELECT o.*, round(abs(x - mean), 4) AS difference, mean FROM own_long o JOIN means USING (family, feature) WHERE round(abs(x - mean), 4) > 0)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY difference DESC, feature_no) AS rank FROM diffs)",
        select="SELECT seq, rank::INTEGER AS rank, feature, difference, CASE WHEN x > mean THEN 'above' ELSE 'below' END AS direction FROM ranked WHERE rank <= 5",
    ),
    "machine_context": with_ev(FIRST, select="SELECT machine_id, count(*) AS n_items, count(DISTINCT evidence_type) AS n_types, array_to_string(list(artifact_id ORDER BY seq)[1:20], ',') AS first_ids FROM first_items GROUP BY 1"),
    "score_summary": with_ev(FIRST, FEATURE_SQL, SCORED, select="SELECT family, count(*) AS n, count(*) FILTER (s < -0.1) AS n_anomalies FROM scored GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (s < -0.1) FROM scored"),
    "forest_scores": with_ev(
        FIRST,
        FEATURE_SQL,
        *FOREST,
        select=f"SELECT seq, family, round(model_score, 6) AS model_score, round(model_score + ({RULE}), 4) AS score, round(model_score + ({RULE}), 9) < -0.1 AS is_anomaly FROM feats JOIN model_scores USING (family) WHERE [{F_LIST}] = x",
    ),
    "rule_attribution": with_ev(
        FIRST,
        FEATURE_SQL,
        "means AS (SELECT family, " + ", ".join(f"avg({f}) AS m_{f}" for f in features.WEIGHTS) + " FROM feats WHERE severity = 'low' AND seq % 7 = 0 GROUP BY 1)",
        f"vectors AS (SELECT DISTINCT family, {F_LIST} FROM feats)",
        select=" UNION ALL ".join(f"SELECT family, {F_LIST}, '{f}' AS feature, round(({w})::DOUBLE * ({f} - m_{f}), 6) + 0.0::DOUBLE AS phi FROM vectors JOIN means USING (family)" for f, w in features.WEIGHTS.items()),
    ),
    "item_indicators": with_ev(FIRST, rescored("first_items"), _indicators("rescored"), select="SELECT DISTINCT seq, type, indicator FROM ind"),
    "ioc_rollup": with_ev(FIRST, rescored("first_items"), _indicators("rescored"), ROLLUP, select="SELECT type, indicator, severity, confidence, tool, contexts, matches, n_artifacts, surfaced FROM rolled"),
    "ioc_counts": with_ev(
        FIRST,
        rescored("first_items"),
        _indicators("rescored"),
        ROLLUP,
        select="SELECT 'type' AS kind, type AS key, count(*) AS n, count(*) FILTER (surfaced) AS n_surfaced, count(*) FILTER (severity_rank = 5) AS n_critical FROM rolled GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (surfaced), count(*) FILTER (severity_rank = 5) FROM rolled GROUP BY 2",
    ),
    "folded": with_ev(
        FIRST,
        "low_items AS (SELECT * REPLACE (0.2::DOUBLE + confidence / 2 AS confidence), CAST([] AS VARCHAR[]) AS ioc_match FROM first_items WHERE severity = 'low')",
        _indicators("low_items"),
        ROLLUP,
        select="SELECT row_number() OVER (ORDER BY confidence DESC, type, indicator)::INTEGER AS row, type, indicator, CASE WHEN confidence >= 0.45 THEN 'anchored' ELSE 'bare' END AS tier FROM rolled WHERE NOT surfaced QUALIFY row <= 50",
    ),
    "key_findings": with_ev(
        FIRST,
        rescored("first_items"),
        r"""cells AS (
            SELECT *, list_concat(CASE WHEN evidence_type = 'dns_query' THEN ['Domain: ' || regexp_extract(value, '-> ([a-z0-9][a-z0-9.\-]*\.[a-z]{2,})', 1)] ELSE [] END,
                list_transform(list_filter(regexp_extract_all(value, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda x: NOT starts_with(x, '10.')), lambda x: 'IP Address: ' || x),
                CASE WHEN severity IN ('high', 'critical') OR len(ioc_match) > 0 THEN list_transform(list_filter(string_split(value, ' '), lambda x: regexp_matches(x, '\.(exe|dll|bat|ps1|vbs|cmd|scr)$')), lambda x: 'Suspicious File: ' || left(x, 60)) ELSE [] END) AS cell
            FROM rescored)""",
        """found AS (SELECT * FROM cells WHERE (severity IN ('high', 'critical') OR len(ioc_match) > 0) AND (len(cell) > 0 OR len(ioc_match) > 0)
            QUALIFY row_number() OVER (PARTITION BY evidence_type, value, severity ORDER BY seq) = 1)""",
        f"placed AS (SELECT *, row_number() OVER (ORDER BY {RANK} DESC, len(cell) > 0 DESC, seq)::INTEGER AS row, count(*) OVER () AS n_findings FROM found)",
        select="""SELECT row, seq, CASE evidence_type WHEN 'process' THEN 'Process' WHEN 'injected_code' THEN 'Code Injection' WHEN 'network_connection' THEN 'Network Connection' WHEN 'dns_query' THEN 'DNS Query' ELSE 'File Artifact' END AS type,
        severity, array_to_string(cell, '; ') AS indicators, array_to_string(list_sort(ioc_match), ', ') AS matches, n_findings FROM placed WHERE row <= 30""",
    ),
    "proc_nodes": with_ev(NODES, select="SELECT pid, ppid, name, CASE rank WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' END AS severity, artifact_id, first_seq, rank >= 4 AS is_flagged FROM nodes"),
    "lineage_closure": with_ev(NODES, CLOSURE, select="SELECT pid, ppid, is_flagged FROM flagged WHERE pid IN (SELECT pid FROM walk)").replace("WITH ev", "WITH RECURSIVE ev", 1),
    "process_tree": with_ev(NODES, TREE, select="SELECT row::INTEGER AS row, pid, depth FROM ordered WHERE row <= 40").replace("WITH ev", "WITH RECURSIVE ev", 1),
    "coverage": with_ev(
        "seen AS (SELECT source_tool, source_tool <> 'tsk_fls' AS real FROM ev)",
        select="""SELECT k.evidence, CASE WHEN count(*) FILTER (e.real) > 0 THEN 'Analysed' WHEN count(e.real) > 0 THEN 'Not analysed' ELSE 'Not provided' END AS status,
        coalesce(string_agg(DISTINCT CASE WHEN e.real THEN e.source_tool END, ','), '') AS tools, coalesce(string_agg(DISTINCT CASE WHEN NOT e.real THEN e.source_tool END, ','), '') AS attempted
        FROM (VALUES ('memory_dump', 'volatility3'), ('pcap', 'tshark'), ('disk_image', 'tsk_fls'), ('registry_hive', 'regripper'), ('log_files', 'plaso'), ('email', 'email'), ('browser', 'browser')) k(evidence, tool) LEFT JOIN seen e ON e.source_tool = k.tool GROUP BY 1"""
    ),
    "verdicts": with_ev(
        FIRST,
        FEATURE_SQL,
        SCORED,
        "per AS (SELECT machine_id || '/' || seq % 500 AS case_id, count(*) FILTER (s < -0.1) AS n FROM scored GROUP BY 1)",
        f"""typed AS (SELECT *, {texts(q.CASE_TYPES)}[split_part(case_id, '/', 2)::INT % 6 + 1] AS kind, split_part(case_id, '/', 2)::INT % 100 / 100.0::DOUBLE AS sure FROM per)""",
        "titled AS (SELECT *, array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM typed)",
        select="""SELECT case_id, n AS n_anomalies, CASE WHEN n >= 3 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS overall_severity, CASE WHEN n >= 3 THEN 'Supported' WHEN n >= 1 THEN 'Partially Supported' ELSE 'Not Evidenced' END AS hypothesis_verdict,
        CASE WHEN n >= 3 THEN 'Supported — multiple anomalous artifacts corroborate this hypothesis' WHEN n >= 1 THEN 'Partially Supported — anomalous artifact(s) detected; further manual review recommended'
            ELSE 'Not Evidenced — no anomalous artifacts detected in the current evidence set' END AS hypothesis_text,
        CASE WHEN n >= 3 THEN 'This investigation reveals strong indicators of a confirmed ' || title || ' incident. ' || n || ' high-confidence anomalies were detected across the evidence set. Immediate escalation to incident response is warranted.'
            WHEN n >= 1 THEN 'Evidence is consistent with ' || title || ' activity. ' || n || ' anomalous artifact(s) were identified with high confidence. Analyst review and targeted containment steps are recommended.'
            ELSE 'No anomalous artifacts were detected in the current evidence set. The incident report was classified as ' || title || ' with ' || printf('%.0f%%', sure * 100) || ' confidence. Manual review is recommended to confirm benign status or expand evidence scope.' END AS analyst_verdict FROM titled""",
    ),
    "priority_items": with_ev(
        FIRST,
        rescored("first_items"),
        "calm AS (SELECT * REPLACE (CASE WHEN machine_id = 'host-3' THEN 'low' ELSE severity END AS severity) FROM rescored)",
        "hot AS (SELECT *, severity IN ('critical', 'high') AS is_hot FROM calm)",
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY is_hot DESC, {RANK} DESC, len(ioc_match) > 0 DESC, confidence DESC, source_tool, seq)::INTEGER AS row, count(*) FILTER (is_hot) OVER (PARTITION BY machine_id) AS n FROM hot)",
        select="SELECT machine_id AS case_id, row, seq, severity FROM placed WHERE row <= 20 AND (is_hot OR n = 0)",
    ),
    "file_bodies": f"""WITH lines AS ({q.LINES_SQL['bodies']}) SELECT 'file_' || left(sha256(path), 12) AS artifact_id, CASE WHEN starts_with(md5, '* ') THEN 'DELETED file: ' ELSE 'Suspicious file: ' END || path AS value,
        CASE WHEN starts_with(md5, '* ') THEN 'high' ELSE 'medium' END AS severity, 0.75::DOUBLE AS confidence FROM lines WHERE (regexp_matches(path, '{_ENDS}') OR {holds('lower(path)', extraction.FILE_FOLDERS)} OR starts_with(md5, '* ')) AND NOT starts_with(mode, 'd/')""",
    "file_timeline": f"""WITH lines AS ({q.LINES_SQL['bodies']}) SELECT 'timeline_' || left(sha256(concat_ws('|', date, activity, path)), 12) AS artifact_id, 'Timeline: ' || path || ' (' || activity || ')' AS value, date AS timestamp, 'medium' AS severity
        FROM lines WHERE regexp_matches(path, '{_ENDS}') OR {holds('lower(path)', extraction.FILE_FOLDERS)}""",
    "registry_text": f"""WITH lines AS ({q.LINES_SQL['registry']}), t AS (SELECT value, trim(value) AS line, lower(trim(value)) AS low FROM lines) SELECT 'reg_' || left(sha256(value), 12) AS artifact_id, line AS value, CASE WHEN {holds('low', extraction.REGISTRY_HIGH_WORDS)} THEN 'high' ELSE 'medium' END AS severity
        FROM t WHERE line <> '' AND NOT starts_with(line, '#') AND NOT ends_with(line, ':') AND NOT starts_with(line, 'Launching') AND ({holds('low', extraction.REGISTRY_WORDS)} OR regexp_matches(low, '\\.(exe|dll|bat|ps1|vbs)'))""",
    "process_list": f"""WITH lines AS ({q.LINES_SQL['processes']}) SELECT 'proc_' || pid || '_' || replace(name, '.', '_') AS artifact_id, name || ' (PID:' || pid || ' PPID:' || ppid || ')' AS value, 'process' AS evidence_type,
        CASE WHEN lower(name) IN ('cmd.exe', 'powershell.exe') THEN 'high' ELSE 'low' END AS severity, 0.8::DOUBLE AS confidence FROM lines
        UNION ALL SELECT 'memprocfs_proc_' || pid, name || ' (PID ' || pid || ', PPID ' || ppid || ')', 'memprocfs_process', 'medium', 0.8 FROM lines""",
    "net_lines": f"WITH {_NET} SELECT artifact_id, value, severity FROM net",
    "injected": f"""WITH {_NET}, lines AS ({q.LINES_SQL['regions']}), known AS (SELECT DISTINCT regexp_extract(value, 'PID:(\\d+)', 1) AS pid FROM net WHERE severity = 'high'),
        marked AS (SELECT file, line_no, trim(value) AS t, regexp_matches(trim(value), '^[0-9]+\\s') AND contains(value, 'PAGE_') AS is_row FROM lines),
        carried AS (SELECT *, last_value(CASE WHEN is_row THEN split_part(t, ' ', 1) WHEN contains(t, 'PID') THEN '' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS pid FROM marked),
        per AS (SELECT pid, first(split_part(t, ' ', 2) ORDER BY line_no) FILTER (is_row) AS name, bool_or(is_row AND regexp_matches(lower(t), 'page_exec')) AS rwx, bool_or(regexp_matches(lower(t), '4d 5a')) AS pe FROM carried WHERE pid <> '' GROUP BY pid),
        told AS (SELECT *, pid IN (SELECT pid FROM known) OR (rwx AND pe) AS sure, name = 'chrome.exe' AS jit FROM per)
        SELECT 'malfind_' || pid AS artifact_id, 'Injected memory regions detected in ' || name || ' (PID:' || pid || '). Reasons: ' || CASE WHEN rwx AND pe THEN 'RWX region and embedded PE/shellcode detected' WHEN rwx THEN 'RWX region detected' WHEN pe THEN 'Embedded PE/shellcode detected'
            ELSE 'Injected regions detected (no RWX/PE signature)' END || CASE WHEN jit AND NOT sure AND (rwx OR pe) THEN '; Injection in JIT-capable process without corroborating IOC: down-ranked' WHEN jit AND sure THEN '; Corroborated by another IOC; down-rank skipped' ELSE '' END AS value,
            CASE WHEN jit AND NOT sure THEN 'medium' WHEN rwx AND pe THEN 'critical' WHEN rwx OR pe THEN 'high' ELSE 'medium' END AS severity,
            CASE WHEN jit AND NOT sure AND (rwx OR pe) THEN 0.65 WHEN rwx AND pe THEN 0.92 WHEN rwx OR pe THEN 0.86 ELSE 0.7 END::DOUBLE AS confidence FROM told""",
    "rule_scan": f"WITH lines AS ({q.LINES_SQL['registry']}) SELECT 'yara_' || left(sha256(value), 12) AS artifact_id, trim(value) AS value, 'high' AS severity FROM lines WHERE trim(value) <> ''",
    "analyser_plan": f"""WITH RECURSIVE {CASE_SQL}, kinds AS (SELECT ['pcap', 'memory_dump', 'disk_image'] AS k),
        tools AS (SELECT n_nationkey + 1 AS t, k[t % 3 + 1] AS input, CASE WHEN t % 4 = 0 THEN t - 1 WHEN t > 4 THEN t - 3 END AS needs, t / 100.0::DOUBLE AS phish, t % 5 AS default_order FROM nation, kinds),
        cases AS (SELECT case_id, case_type, CASE WHEN regexp_extract(case_id, '([0-9]+)', 1)::BIGINT % 3 <> 0 THEN ['disk_image', 'pcap'] ELSE string_split(types, ',') END AS given FROM contexts),
        chosen AS (SELECT case_id, t, needs, row_number() OVER (PARTITION BY case_id ORDER BY CASE case_type WHEN 'phishing' THEN phish ELSE 1 - phish END DESC, default_order, 'tool_' || t) AS rank FROM cases JOIN tools ON list_contains(given, input)),
        chain AS (SELECT case_id, t, 0 AS level FROM chosen UNION ALL SELECT c.case_id, c.t, h.level + 1 FROM chain h JOIN chosen c ON c.case_id = h.case_id AND c.needs = h.t),
        levels AS (SELECT case_id, t, max(level) AS level FROM chain GROUP BY ALL)
        SELECT case_id, 'tool_' || t AS name, row_number() OVER (PARTITION BY case_id ORDER BY level, rank)::INTEGER AS "order", t % 2 = 0 AS deep FROM chosen JOIN levels USING (case_id, t)""",
    "related_children": with_ev(NODES, "named AS (SELECT DISTINCT regexp_extract(value, 'PID:([0-9]+)', 1) AS pid FROM ev WHERE evidence_type = 'process' AND seq % 3 = 0)", select="SELECT pid, CASE rank WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' END AS severity, rank >= 4 OR pid IN (SELECT pid FROM named) AS is_flagged FROM nodes"),
    "dashboard": with_ev(select="SELECT machine_id AS case_id, count(*) AS n_items, count(*) FILTER (severity = 'critical') AS n_critical, 0::BIGINT AS n_iocs, 0::BIGINT AS n_trees FROM ev GROUP BY 1"),
    "text_digest": "SELECT doc_id, sha256(text) AS sha256, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(coalesce(nullif(regexp_replace(left(text, 60), '(?s) [^ ]*$', ''), ''), left(text, 60))) || '…' END AS short FROM documents",
    "type_labels": with_ev(
        select="""SELECT CASE WHEN seq % 3 = 0 THEN 'Odd Thing' ELSE CASE evidence_type WHEN 'process' THEN 'Process' WHEN 'injected_code' THEN 'Code Injection' WHEN 'network_connection' THEN 'Network Connection'
        WHEN 'dns_query' THEN 'DNS Query' WHEN 'file_artifact' THEN 'File Artifact' END END AS label, count(*) AS n FROM ev GROUP BY 1"""
    ),
} | {
    kind: with_ev(*SHARED, select=f"SELECT correlation_type, key, anchor, n_items, source_tools, confidence FROM kept WHERE correlation_type = '{kind}'")
    for kind in ("same_pid", "same_ip", "same_file", "same_domain", "same_timestamp")
}
