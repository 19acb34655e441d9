"""Extraction of evidence items from network fields, listings and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import any_of
from casewright.schema import make_items

# Fixed values of the extraction rules.
WATCH_PORTS = [4444, 4445, 1337, 31337, 8888, 9999, 6667, 6668]
DNS_ALLOWED_PARTS = [
    "apple.com", "icloud.com", "akamai", "akamaized.net", "akadns.net", "cloudflare", "fastly", "google", "gstatic",
    "googleapis", "ggpht", "amazonaws", "cloudfront", "azureedge", "microsoft", "windows.com", "windowsupdate",
    "msftncsi", "msftconnecttest", "mozilla", "ubuntu.com", "debian.org", "fedoraproject.org", "digicert", "verisign",
]
DNS_ALLOWED_ENDINGS = [".local", ".arpa", ".lan", ".internal", ".home"]
DNS_LABEL_LENGTH, DNS_ENTROPY = 12, 3.8
FILE_EXTENSIONS = [".exe", ".dll", ".bat", ".ps1", ".vbs", ".js", ".jar", ".scr", ".locked", ".encrypted"]
FILE_FOLDERS = ["temp", "tmp", "appdata\\roaming", "recycle", "programdata", "windows\\temp"]
TIMELINE_WORDS = ["run key", "startup", "scheduled task", "autorun", "powershell", "cmd.exe", "encoded", "download"]
REGISTRY_WORDS = ["run", "runonce", "userinit", "shell", "load", "autoruns", "startup", "services", "scheduled"]
REGISTRY_HIGH_WORDS = ["run", "runonce", "startup", "shell"]
MAIL_WORDS = ["urgent", "verify", "password", "bank", "login", "click here", "reset", "security alert"]
URL_WORDS = ["bit.ly", "tinyurl", "grabify", "phishing", "login-secure", "verify-account"]
WATCHED_PARENTS = ["cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe"]
MEMORY_PORTS = [4444, 4445, 1337, 31337, 8888, 9999]
RELATIONS = [("winword.exe", "powershell.exe"), ("excel.exe", "cmd.exe"), ("powershell.exe", "rundll32.exe"), ("mshta.exe", "cmd.exe"), ("wscript.exe", "powershell.exe"), ("explorer.exe", "powershell.exe")]
MODULE_WORDS = ["unknown", "temp", "appdata\\roaming", "programdata"]
JIT_PROCESSES = ["explorer.exe", "chrome.exe", "firefox.exe", "msedge.exe", "iexplore.exe", "opera.exe", "brave.exe", "svchost.exe", "wmiprvse.exe", "dllhost.exe"]
COMMAND_WORDS = ["-enc", "-encodedcommand", "invoke-", "downloadstring", "iex", "bypass", "hidden", "frombase64"]
TOOL_WARNINGS = ["unsatisfied requirement", "unable to validate", "traceback"]
FILE_MARKERS = ["\\appdata\\", "\\temp\\", "\\users\\public\\", "\\programdata\\", "\\startup", "\\runonce", "\\tasks\\", "\\intel\\", ".onion", ".ps1", ".vbs", ".js", ".hta", ".bat", ".cmd"]
RANSOM_ENDINGS = ["wnry", "wncry", "wcry", "wncryt", "locky", "zepto", "odin", "cerber", "cerber3", "crypt", "crypto", "crypted", "encrypted", "enc", "locked", "ecc", "ezz", "exx", "ryuk", "lockbit", "conti", "djvu"]
PAYLOAD_NAMES = ["@wanadecryptor@", "wanadecryptor", "wannadecryptor", "tasksche", "taskdl", "taskse", "mssecsvc", "wannacry", "wanacry", "@please_read_me@"]
BENIGN_DOMAINS = [
    "microsoft.com", "windows.com", "windowsupdate.com", "msftncsi.com", "msftconnecttest.com", "microsoftonline.com", "live.com", "msn.com",
    "office.com", "office365.com", "outlook.com", "bing.com", "skype.com", "xboxlive.com", "azure.com", "azureedge.net", "msedge.net",
    "windows.net", "msocdn.com", "s-microsoft.com", "microsoft.net", "mozilla.org", "mozilla.com", "mozilla.net", "firefox.com",
    "google.com", "googleapis.com", "gstatic.com", "googleusercontent.com", "google-analytics.com", "doubleclick.net", "gvt1.com", "gvt2.com",
    "youtube.com", "ytimg.com", "googlesyndication.com", "apple.com", "icloud.com", "mzstatic.com", "akamai.net", "akamaiedge.net",
    "akamaihd.net", "edgekey.net", "edgesuite.net", "llnwd.net", "cloudfront.net", "cloudflare.com", "fastly.net", "fbcdn.net",
    "amazonaws.com", "digicert.com", "verisign.com", "globalsign.com", "symantec.com", "entrust.net", "godaddy.com", "sectigo.com",
    "letsencrypt.org", "comodoca.com", "usertrust.com", "thawte.com", "geotrust.com", "ubuntu.com", "debian.org", "canonical.com",
    "archlinux.org", "launchpad.net", "kernel.org", "w3.org", "oasis-open.org", "ietf.org", "iana.org", "adobe.com", "intel.com",
    "nvidia.com", "amd.com", "dell.com", "hp.com", "lenovo.com", "java.com", "oracle.com",
]
GENERIC_TLDS = [
    "com", "net", "org", "info", "biz", "gov", "edu", "mil", "int", "name", "pro", "mobi", "asia", "xyz", "top", "site", "online", "club",
    "shop", "app", "dev", "onion", "work", "click", "link", "live", "icu", "fun", "buzz", "host", "space", "website", "press", "party",
    "stream", "download", "loan", "review", "date", "trade", "racing", "win", "bid", "faith", "cricket", "men",
]
#: Fixed: the two-letter domain endings.
COUNTRY_TLDS = """
    ac ad ae af ag ai al am ao ar at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw
    cx cy cz de dj dk dm do dz ec ee eg es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hn hr ht hu id ie il im in
    io iq ir is it je jm jo jp ke kg kh ki kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mk ml mm mn mo mp mq mr ms mt mu mv mw mx
    my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss
    st su sv sx sy sz tc td tg th tj tk tl tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
""".split()
AMBIGUOUS_TLDS = ["py", "pl", "sh", "so", "rs", "md", "pm", "ax", "nc"]
DOS_COMMANDS = [
    "append", "assign", "attrib", "chcp", "chkdsk", "choice", "command", "comp", "country", "ctty", "debug", "deltree", "diskcomp", "diskcopy",
    "display", "doskey", "edit", "edlin", "exe2bin", "expand", "fastopen", "fc", "fdisk", "find", "format", "graftabl", "graphics", "keyb",
    "label", "loadfix", "loadhigh", "mem", "mode", "more", "mscdex", "ntdetect", "nlsfunc", "power", "print", "replace", "restore", "scandisk",
    "setver", "share", "smartdrv", "sort", "subst", "sys", "tree", "undelete", "unformat", "win", "xcopy",
]
MAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
DOMAIN_PATTERN = r"(?i)(?<![@\\])\b(?:[a-z0-9-]{1,63}\.)+[a-z]{2,24}\b"
#: Names before which a host counts as one of a url.
URL_NAMES = "host:|referer:|referrer:|location:|origin:|url=|uri="
ONION_PATTERN = r"(?i)[a-z0-9]{16,56}\.onion"
#: Fixed: the digits of base58.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
WALLET_PATTERN = r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"
REGISTRY_PATTERNS = [
    r"""(?i)(?:HKLM|HKEY_LOCAL_MACHINE|HKCU|HKEY_CURRENT_USER|HKCR|HKEY_CLASSES_ROOT|HKU|HKEY_USERS)\\[^\s"'|]+""",
    r"""(?i)\\Registry\\Machine\\[^\s"'|]+""",
    r"""(?i)\\Registry\\User\\[^\s"'|]+""",
]


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """An id that depends on the row alone: prefix and the first 12 hex digits of a SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


# ---- Network fields -------------------------------------------------------------------------------------------------


def conversations(packets: DataFrame) -> DataFrame:
    """Bytes, packets and first time of each (src, dst, dport); severity by the port."""
    per = packets.where("src is not null and dst is not null and src <> '' and dst <> ''").groupBy("src", "dst", "dport").agg(F.sum("length").alias("bytes"), F.count("*").alias("packets"), F.min("epoch").alias("first_epoch"))
    return per.withColumn("severity", F.when(F.col("dport").isin(WATCH_PORTS), "high").otherwise("low"))


def watched_ports(packets: DataFrame, order: str = "seq") -> DataFrame:
    """For each watched port the first packet's ends and time, and the number of packets."""
    first = F.min_by(F.struct("src", "dst", "epoch"), order)
    per = packets.where(F.col("dport").isin(WATCH_PORTS)).groupBy("dport").agg(first.alias("f"), F.count("*").alias("packets"))
    return per.select("dport", "f.src", "f.dst", "f.epoch", "packets")


def longest_label(domain: Column) -> Column:
    """The longest label but the last one (the first of equals); the only label if there is one."""
    labels = F.filter(F.split(domain, r"\."), lambda x: x != "")
    body = F.when(F.size(labels) > 1, F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))).otherwise(labels)
    ranked = F.transform(body, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("label")))
    return F.coalesce(F.array_min(ranked)["label"], F.lit(""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / total)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def dns_scores(queries: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds label, label_entropy and severity (high for long random labels outside the allowed names)."""
    d = F.lower(F.col(domain))
    allowed = any_of(d, DNS_ALLOWED_PARTS) | F.coalesce(d.rlike("(" + "|".join(e.replace(".", r"\.") for e in DNS_ALLOWED_ENDINGS) + ")$"), F.lit(False))
    out = queries.withColumn("label", longest_label(d)).withColumn("label_entropy", F.round(entropy(F.col("label")), 4))
    odd = (F.length("label") >= DNS_LABEL_LENGTH) & (F.col("label_entropy") >= DNS_ENTROPY) & ~allowed
    return out.withColumn("severity", F.when(odd, "high").otherwise("low"))


def http_requests(rows: DataFrame, host: str = "host", uri: str = "uri") -> DataFrame:
    """An item for each request, its id from the digest of the uri."""
    return make_items(rows, F.concat(F.lit("http_"), F.substring(F.md5(uri), 1, 8)), "tshark", "http_request", F.concat(F.lit("HTTP request: "), host, uri), "medium", 0.75)


# ---- Listings and timelines -----------------------------------------------------------------------------------------


def listed_files(body: DataFrame) -> DataFrame:
    """Suspicious rows of a body listing (md5, path, inode, mode); folders are dropped, deleted files are high."""
    path, mode = F.trim("path"), F.trim(F.coalesce("mode", F.lit("")))
    deleted = F.contains(F.coalesce("md5", F.lit("")), F.lit("* "))
    odd = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_EXTENSIONS) + ")$") | any_of(F.lower(path), FILE_FOLDERS) | deleted
    kept = body.where(odd & ~F.startswith(mode, F.lit("d/")))
    return make_items(kept, stable_id("file", path), "tsk_fls", "file_artifact", F.concat(F.when(deleted, "DELETED file: ").otherwise("Suspicious file: "), path), F.when(deleted, "high").otherwise("medium"), 0.75)


def timeline_files(rows: DataFrame) -> DataFrame:
    """Rows (date, activity, path) of a file timeline with a suspicious path."""
    odd = F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_EXTENSIONS) + ")$") | any_of(F.lower("path"), FILE_FOLDERS)
    value = F.concat(F.lit("Timeline: "), "path", F.lit(" ("), F.col("activity"), F.lit(")"))
    return make_items(rows.where(odd), stable_id("timeline", "date", "activity", "path"), "tsk_fls", "timeline_event", value, "medium", 0.70, F.col("date"))


def timeline_events(rows: DataFrame) -> DataFrame:
    """Rows (datetime, source, description, filename) with a watched word in the description or the source."""
    odd = any_of(F.lower(F.coalesce("description", F.lit(""))), TIMELINE_WORDS) | any_of(F.lower(F.coalesce("source", F.lit(""))), TIMELINE_WORDS)
    return make_items(rows.where(odd), stable_id("plaso", "datetime", "source", "description"), "plaso", "timeline_event", F.concat_ws(": ", "source", "description"), "high", 0.72, F.col("datetime"))


def registry_lines(lines: DataFrame) -> DataFrame:
    """Registry text lines (value) with a persistence word or a program's ending; comments and headers are skipped."""
    line = F.trim("value")
    low = F.lower(line)
    body = (line != "") & ~F.startswith(line, F.lit("#")) & ~F.endswith(line, F.lit(":")) & ~F.startswith(line, F.lit("Launching"))
    odd = any_of(low, REGISTRY_WORDS) | low.rlike(r"\.(exe|dll|bat|ps1|vbs)")
    return make_items(lines.where(body & odd), stable_id("reg", "value"), "regripper", "registry_entry", line, F.when(any_of(low, REGISTRY_HIGH_WORDS), "high").otherwise("medium"), 0.75)


# ---- Mail and browser text ------------------------------------------------------------------------------------------


def word_hits(texts: DataFrame, text: str = "text", words: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row (keep, word) for each listed word that a text holds; the list is a literal, so there is no join."""
    words = MAIL_WORDS if words is None else words
    found = F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(F.col(text)), w))
    return texts.select(*keep, F.explode(found).alias("word"))


def suspicious_urls(lines: DataFrame, line: str = "value", words: list[str] | None = None) -> DataFrame:
    """Lines that hold a listed token."""
    return lines.where(any_of(F.lower(F.col(line)), URL_WORDS if words is None else words))


# ---- Memory tables --------------------------------------------------------------------------------------------------


def memory_fields(lines: DataFrame, line: str = "value") -> DataFrame:
    """Splits table lines at tabs, or at white space where there is none, without banners and blank lines."""
    text = F.trim(line)
    data = (text != "") & ~F.startswith(text, F.lit("Volatility")) & ~F.startswith(text, F.lit("Progress")) & ~F.upper(text).rlike(r"^(PID|OFFSET)\b")
    return lines.where(data).withColumn("fields", F.when(F.contains(text, F.lit("\t")), F.split(text, r"\t+")).otherwise(F.split(text, r"\s+")))


def processes(rows: DataFrame) -> DataFrame:
    """Rows (pid, ppid, name) as process items; watched names are high."""
    name = F.lower("name")
    value = F.concat(F.col("name"), F.lit(" (PID:"), F.col("pid"), F.lit(" PPID:"), F.col("ppid"), F.lit(")"))
    return make_items(rows, F.concat_ws("_", F.lit("proc"), "pid", F.regexp_replace("name", r"\.", "_")), "volatility3", "process", value, F.when(any_of(name, WATCHED_PARENTS), "high").otherwise("low"), 0.80)


def process_relations(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listed parent and child pairs among rows (pid, ppid, name), joined on the parent's id."""
    pairs = F.array(*(F.lit(f"{p}>{c}") for p, c in RELATIONS))
    child = rows.select(*keep, F.col("pid").alias("child_pid"), F.col("ppid").alias("pid"), F.col("name").alias("child_name"))
    parent = rows.select(*keep, "pid", F.col("name").alias("parent_name"))
    joined = child.join(parent, [*keep, "pid"])
    return joined.where(F.array_contains(pairs, F.concat_ws(">", F.lower("parent_name"), F.lower("child_name")))).select(*keep, F.col("pid").alias("parent_pid"), "parent_name", "child_pid", "child_name").distinct()


def command_lines(lines: DataFrame) -> DataFrame:
    """Rows of process id, name and arguments; tool warnings and rows without a name become markers.

    The value is what follows the name, or the name where nothing does.
    """
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    low = F.lower(text)
    data = (text != "") & ~F.contains(text, F.lit("Volatility 3 Framework")) & ~(F.contains(text, F.lit("PID")) & F.contains(text, F.lit("Process")))
    pid, name, rest = (F.regexp_extract(text, r"^(\S+)\s*(\S*)\s*(.*)$", g) for g in (1, 2, 3))
    kind = F.when(any_of(low, TOOL_WARNINGS), "parser_warning").when(name == "", "commandline_missing").otherwise("commandline")
    rows = lines.where(data).select(text.alias("text"), kind.alias("kind"), pid.alias("pid"), F.when(rest == "", name).otherwise(rest).alias("command"), any_of(low, COMMAND_WORDS).alias("hot"))
    plain = F.col("kind") == "commandline"
    artifact = F.when(plain, F.concat(F.lit("cmdline_"), "pid")).when(F.col("kind") == "commandline_missing", F.concat(F.lit("cmdline_empty_"), "pid")).otherwise(stable_id("cmdline_warning", "text"))
    severity = F.when(F.col("kind") == "parser_warning", "medium").when(plain & F.col("hot"), "high").otherwise("low")
    confidence = F.when(~plain, 1.0).when(F.col("hot"), 0.90).otherwise(0.60)
    return make_items(rows, artifact, "volatility3", F.col("kind"), F.when(plain, F.col("command")).otherwise(F.col("text")), severity, confidence)


def connections(lines: DataFrame) -> DataFrame:
    """Connection rows of at least 8 fields; a watched port on either side is high."""
    f = F.split(F.trim("value"), r"\s+", 10)
    rows = lines.withColumn("f", f).where(F.size("f") >= 8)
    local, foreign = F.col("f")[3].try_cast("int"), F.col("f")[5].try_cast("int")
    hot = F.coalesce(local.isin(MEMORY_PORTS), F.lit(False)) | F.coalesce(foreign.isin(MEMORY_PORTS), F.lit(False))
    pid = F.col("f")[7]
    value = F.concat(F.col("f")[1], F.lit(" "), F.col("f")[2], F.lit(":"), F.col("f")[3], F.lit(" -> "), F.col("f")[4], F.lit(":"), F.col("f")[5], F.lit(" (PID:"), pid, F.lit(")"))
    return make_items(rows, stable_id("net", F.col("value")), "volatility3", "network_connection", value, F.when(hot, "high").otherwise("low"), 0.80)


def corroborated_pids(items: DataFrame) -> DataFrame:
    """Process ids of high and critical command lines and connections."""
    hot = items.where(F.col("evidence_type").isin("commandline", "network_connection") & F.col("severity").isin("high", "critical"))
    text = F.concat_ws(" ", "artifact_id", "value")
    ids = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)\bpid[:\s#]*(\d+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\b(?:cmdline|net)_(\d+)\b"), F.lit(1)))
    return hot.select(F.explode(ids).alias("pid")).distinct()


def injected_regions(lines: DataFrame, corroborated: DataFrame | None = None, file: str = "file", order: str = "line_no") -> DataFrame:
    """One row for each process with injected regions, from table rows and the dump lines below them.

    A table row has a numeric process id and a page protection; other lines
    belong to the last such row of the file (carry-forward window), a header
    ends it. Executable memory and a program's signature together are critical,
    one of them is high, none medium. Processes that compile at run time come
    down to medium unless both were seen or another row corroborates the id.
    """
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    low = F.lower(text)
    header = F.contains(text, F.lit("Volatility 3 Framework")) | F.contains(text, F.lit("PID"))
    is_row = text.rlike(r"^[0-9]+\s") & F.contains(low, F.lit("page_"))
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(file, order, text.alias("text"), is_row.alias("is_row"), F.when(is_row, F.regexp_extract(text, r"^([0-9]+)", 1)).when(header, "").alias("mark"))
    tagged = marked.withColumn("pid", F.last("mark", ignorenulls=True).over(w)).where("pid <> ''")
    flags = F.regexp_extract(F.lower("text"), r"^\S+\s+\S+\s+(.*)$", 1)
    signature = F.lower("text").rlike(r"shellcode| mz|^mz|4d 5a|4d5a|50 45 00 00")
    rwx = F.col("is_row") & flags.rlike("rwx|rw-x|rx|page_exec|execute.*write|write.*execute")
    pe = signature | (F.col("is_row") & flags.rlike("mz|pe"))
    first_name = F.min_by(F.regexp_extract("text", r"^\S+\s+(\S+)", 1), F.when(F.col("is_row"), F.col(order)))
    per = tagged.groupBy("pid").agg(first_name.alias("name"), F.bool_or(rwx).alias("rwx"), F.bool_or(pe).alias("pe"))
    known = lines.sparkSession.createDataFrame([], "pid string") if corroborated is None else corroborated.select("pid").distinct()
    per = per.join(known.withColumn("sure", F.lit(True)), "pid", "left").withColumn("sure", F.coalesce("sure", F.lit(False)) | (F.col("rwx") & F.col("pe")))
    both, one, jit = F.col("rwx") & F.col("pe"), F.col("rwx") | F.col("pe"), F.lower("name").isin(JIT_PROCESSES)
    down = jit & ~F.col("sure") & one
    severity = F.when(down, "medium").when(both, "critical").when(one, "high").otherwise("medium")
    confidence = F.when(down, 0.65).when(both, 0.92).when(one, 0.86).otherwise(0.70)
    why = F.when(both, "RWX region and embedded PE/shellcode detected").when(F.col("rwx"), "RWX region detected").when(F.col("pe"), "Embedded PE/shellcode detected").otherwise("Injected regions detected (no RWX/PE signature)")
    more = F.when(down, "; Injection in JIT-capable process without corroborating IOC: down-ranked").when(jit & F.col("sure"), "; Corroborated by another IOC; down-rank skipped").otherwise("")
    value = F.concat(F.lit("Injected memory regions detected in "), "name", F.lit(" (PID:"), "pid", F.lit("). Reasons: "), why, more)
    return make_items(per, F.concat(F.lit("malfind_"), "pid"), "volatility3", "injected_code", value, severity, confidence, linked=F.array(F.concat(F.lit("proc_"), "pid")))


def module_lines(lines: DataFrame) -> DataFrame:
    """Module rows in unusual places."""
    return make_items(lines.where(any_of(F.lower("value"), MODULE_WORDS)), stable_id("dll", "value"), "volatility3", "dll", F.trim("value"), "medium", 0.70)


def file_objects(lines: DataFrame) -> DataFrame:
    """File objects by their place and name; each path once (any case).

    Ransomware endings and payload names are high at 0.95 wherever they lie. A
    folder with a random name below a staging folder, or two markers, is high;
    one marker is medium; none drops the row.
    """
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\t+| {2,}")
    rows = lines.withColumn("path", F.try_element_at(F.filter(parts, lambda p: p.rlike(r"[\\/]")), F.lit(-1))).where("path is not null")
    low = F.lower("path")
    name = F.regexp_extract(low, r"([^\\/]*)$", 1)
    sure = name.rlike(r"\.(" + "|".join(RANSOM_ENDINGS) + ")$") | any_of(name, PAYLOAD_NAMES)
    staging = F.translate(low, "/", "\\").rlike(r"\\(intel|programdata)\\(?=[a-z0-9]*[a-z])(?=[a-z0-9]*[0-9])[a-z0-9]{12,}(\\|$)")
    n = F.size(F.filter(F.array(*(F.lit(m) for m in FILE_MARKERS)), lambda m: F.contains(low, m)))
    severity = F.when(sure | staging | (n >= 2), "high").when(n == 1, "medium")
    w = Window.partitionBy("low").orderBy("value")
    kept = rows.withColumn("low", low).withColumn("sev", severity).withColumn("conf", F.when(sure, 0.95).when(staging | (n >= 2), 0.90).otherwise(0.80)).where("sev is not null")
    kept = kept.withColumn("n", F.row_number().over(w)).where("n = 1")
    return make_items(kept, stable_id("file", "low"), "volatility3", "file_artifact", F.col("path"), F.col("sev"), F.col("conf"))


def rule_hits(lines: DataFrame) -> DataFrame:
    """Every data line of a rule scan."""
    text = F.trim("value")
    data = (text != "") & ~F.startswith(text, F.lit("Volatility")) & ~F.startswith(text, F.lit("Progress")) & ~F.startswith(text, F.lit("Offset"))
    return make_items(lines.where(data), stable_id("yara", "value"), "volatility3", "yara_match", text, "high", 0.90)


def process_inventory(processes: DataFrame, tool: str = "memprocfs", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each process (pid, ppid, name) of a flat listing."""
    value = F.format_string("%s (PID %s, PPID %s)", "name", F.col("pid").cast("string"), F.col("ppid").cast("string"))
    return make_items(processes, F.concat(F.lit(f"{tool}_proc_"), F.col("pid").cast("string")), tool, f"{tool}_process", value, "medium", 0.80, keep=keep)


def status_rows(tool: str, message: str, spark) -> DataFrame:
    """The marker row of a tool that failed or found nothing."""
    return make_items(spark.range(1), F.lit(f"{tool}_status"), tool, f"{tool}_status", F.lit(message), "low", 1.0)


# ---- Sweeps over free text ------------------------------------------------------------------------------------------


def registered_tld(tld: Column) -> Column:
    """Whether a domain ending is a generic or a country's one."""
    return tld.isin([*GENERIC_TLDS, *COUNTRY_TLDS])


def onions(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Hidden-service names, lower-cased, each once for the kept columns."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(ONION_PATTERN), F.lit(0)), F.lower))
    return texts.where(F.contains(F.lower(F.col(text)), F.lit(".onion"))).select(*keep, F.explode(found).alias("value"))


def base58_hex(text: Column) -> Column:
    """The number that a base58 text writes, as 50 hex digits (25 bytes); null if it has other characters or is larger.

    Five limbs of 40 bits in an array are multiplied by 58 and carried for each character.
    """
    digits = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(BASE58), c) - 1)

    def step(limbs: Column, digit: Column) -> Column:
        carry, out = digit.cast("long"), []
        for i in range(5):
            value = F.get(limbs, F.lit(i)) * 58 + carry
            out.append(value.bitwiseAND((1 << 40) - 1) if i < 4 else F.least(value, F.lit(1 << 40)))  # what runs over stays over
            carry = F.shiftright(value, 40)
        return F.array(*out)

    start = F.array(*[F.lit(0).cast("long")] * 5)
    limbs = F.aggregate(digits, start, step)
    number = F.concat(*(F.lpad(F.hex(F.get(limbs, F.lit(i))), 10, "0") for i in reversed(range(5))))
    return F.when(F.forall(digits, lambda d: d >= 0) & (F.get(limbs, F.lit(4)) < (1 << 40)), number)


def wallet_checks(address: Column) -> Column:
    """Whether a base58 address decodes to 21 bytes with the right four check bytes (the first of their double SHA-256)."""
    number = base58_hex(address)
    digest = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(number, 1, 42)), 256)), 256)
    return F.coalesce(F.substring(digest, 1, 8) == F.lower(F.substring(number, 43, 8)), F.lit(False))


def wallets(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Wallet addresses with a right checksum, each once for the kept columns."""
    found = texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WALLET_PATTERN), F.lit(0)))).alias("value"))
    return found.where(wallet_checks(F.col("value")))


def mail_addresses(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = (), endings: list[str] | None = None) -> DataFrame:
    """Mail addresses of a registered domain and a plausible local part, each once for the kept columns; with endings, of domains that end so as written."""
    rows = texts.where(F.contains(F.col(text), F.lit("@"))).select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(MAIL_PATTERN), F.lit(0)))).alias("value"))
    local, domain = F.split_part("value", F.lit("@"), F.lit(1)), F.split_part("value", F.lit("@"), F.lit(2))
    labels = F.split(domain, r"\.")
    tld = F.lower(F.element_at(labels, -1))
    good = (F.size(labels) >= 2) & (F.length(F.element_at(labels, -2)) >= 2) & registered_tld(tld) & ~tld.isin(AMBIGUOUS_TLDS)
    good &= local.rlike("[A-Za-z]") & ~local.rlike(r"^\.|\.$|\.\.") & F.forall(labels, lambda x: x.rlike("^[A-Za-z0-9]$|^[A-Za-z0-9].*[A-Za-z0-9]$"))
    return rows.where(good if endings is None else good & F.element_at(labels, -1).isin(endings))


def registry_keys(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Registry keys of the three spellings, up to a space, quote or bar."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in REGISTRY_PATTERNS))))
    return texts.select(*keep, F.explode(found).alias("value"))


def domains(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Domains with their confidence: 0.45 in URL grammar, 0.20 bare, the highest over all occurrences.

    A text is read once for its hosts and once for each place that anchors one:
    runs after //, runs before a path or port, and what follows a header or
    parameter name. Hosts are tested against those short lists, not the text.
    """
    every = lambda pattern, group: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    runs = F.transform(F.concat(every(r"(?i)//([a-z0-9.-]+)", 1), every(r"(?i)(?<![a-z0-9.-])([a-z0-9.-]++)(?:[/?]|:[0-9])", 1)), F.lower)
    named = F.lower(F.array_join(F.array_distinct(every(rf"(?i)(?=((?:{URL_NAMES}).{{0,10}}[a-z0-9.-]*))", 1)), "\n"))  # zero-width, so that none hides another
    found = F.array_distinct(F.transform(every(DOMAIN_PATTERN, 0), F.lower))
    lists = texts.select(*keep, found.alias("_found"), F.array_distinct(runs).alias("_runs"), named.alias("_named")).where(F.size("_found") > 0)
    rows = lists.select(*keep, "_runs", "_named", F.explode("_found").alias("value"))
    rows = rows.withColumn("labels", F.split("value", r"\.")).withColumn("tld", F.element_at("labels", -1)).withColumn("sld", F.element_at("labels", -2))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    good = registered_tld(F.col("tld")) & (F.length("sld") >= 2) & F.forall("labels", lambda x: ~x.rlike("^-|-$"))
    good &= ~(F.col("tld").isin(AMBIGUOUS_TLDS) & (F.size("labels") < 3)) & ~F.arrays_overlap(suffixes, F.array(*(F.lit(d) for d in BENIGN_DOMAINS)))
    after_name = F.concat(F.lit(rf"(?:{URL_NAMES}).{{0,10}}\Q"), "value", F.lit(r"\E(?![a-z0-9.-])"))
    anchored = F.startswith("value", F.lit("www.")) | F.array_contains("_runs", F.col("value")) | F.when(F.contains("_named", F.col("value")), F.rlike("_named", after_name)).otherwise(F.lit(False))
    rows = rows.where(good).select(*keep, "value", "labels", "tld", "sld", anchored.alias("anchored"))
    two, short = F.size("labels") == 2, F.length("tld") == 2
    repeats = F.endswith("sld", F.col("tld")) & ((F.length("sld") - F.length(F.replace("sld", "tld", F.lit("")))) >= 4)
    junk = two & ((short & (F.length("sld") < 4)) | ((F.col("tld") == "com") & F.col("sld").isin(DOS_COMMANDS)) | (short & ((~F.contains("sld", F.lit("-")) & F.col("sld").rlike("[0-9]")) | repeats)))
    kept = rows.where(F.col("anchored") | ~junk)
    return kept.groupBy(*keep, "value").agg(F.max(F.when(F.col("anchored"), 0.45).otherwise(0.20)).alias("confidence"))


def sweep(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """All five sweeps in one table; a value belongs to the first kind that claims it (any case)."""
    kinds = [(onions, "suspicious_domain", "high", 0.95), (wallets, "suspicious_crypto", "high", 0.93), (mail_addresses, "email_address", "medium", 0.85), (registry_keys, "registry_key", "medium", 0.88), (domains, "suspicious_domain", "low", None)]
    out = None
    for rank, (find, kind, severity, confidence) in enumerate(kinds):
        found = find(texts, text, keep)
        score = F.col("confidence") if confidence is None else F.lit(confidence)
        rows = found.select(*keep, "value", F.lit(kind).alias("evidence_type"), F.lit(severity).alias("severity"), score.cast("double").alias("confidence"), F.lit(rank).alias("kind_rank"))
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy(*keep, F.lower("value")).orderBy("kind_rank", "value")
    return out.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "kind_rank")
