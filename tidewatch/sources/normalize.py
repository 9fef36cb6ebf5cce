"""Raw records of each source to the unified layout. Each normaliser is one projection over whatever columns exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import (
    basename, filled, first_filled, has, has_any, hash_id, low, nz, parse_int, starts_any)
from tidewatch.rules import labels as L
from tidewatch.schema import UNIFIED_COLUMNS, as_unified

# Code tables of the sources.
LOGON_TYPES = {2: "interactive", 3: "network", 4: "batch", 5: "service", 7: "unlock", 8: "network_cleartext",
               9: "new_credentials", 10: "remote_interactive", 11: "cached"}
SECURITY_TYPES = [([4624, 4625, 4634, 4647, 4648, 4672, 4776, 4768, 4769, 4771], "auth"),
                  ([4688, 4689, 7045, 4698], "process_create"),
                  ([4720, 4722, 4725, 4726, 4728, 4732, 4756, 4757], "account_change"),
                  ([5140, 5145, 5136, 5137], "object_access"), ([4740], "account_lockout")]
SYSMON_TYPES = {1: "process_create", 2: "file_modify", 3: "network_connection", 5: "process_end", 6: "driver_load",
                7: "image_load", 8: "remote_thread", 10: "process_access", 11: "file_create", 12: "registry_add",
                13: "registry_set", 15: "file_stream", 17: "pipe_create", 22: "dns_query", 23: "file_delete",
                25: "process_tamper"}
NESTED_EXTRA_TYPES = {4624: "auth", 4625: "auth_failure", 4648: "auth", 4688: "process_create", 4698: "process_create",
                      4720: "account_change", 4728: "account_change"}
NESTED_HIGH_PROCESSES = ["mimikatz.exe", "vssadmin.exe", "wce.exe", "procdump.exe", "wmic.exe", "certutil.exe",
                         "mshta.exe", "regsvr32.exe", "rundll32.exe", "bitsadmin.exe", "cscript.exe", "wscript.exe",
                         "powershell.exe", "cmd.exe"]
SENSITIVE_FILES = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", "/root/.ssh", "/etc/crontab", "/etc/ld.so.preload"]
DANGEROUS_COMMANDS = ["nc", "ncat", "netcat", "wget", "curl", "bash", "sh", "python", "perl", "ruby", "php", "socat",
                      "nmap", "masscan", "hydra", "mimikatz", "msfconsole", "msfvenom", "empire", "cobalt"]
RISKY_DIRS = ["/tmp/", "/dev/shm/", "/var/tmp/", "/run/shm/"]
THREAT_KINDS = ["trojan", "backdoor", "exploit", "ransomware", "worm", "virus", "adware", "riskware", "rootkit", "spy"]
THREAT_CRITICAL = ["trojan", "backdoor", "exploit", "rootkit", "ransomware", "trojan-ransom", "pdm:", "heur:",
                   "mimikatz", "meterpreter", "cobalt", "empire"]
THREAT_HIGH = ["worm", "virus", "downloader", "dropper", "spyware"]
THREAT_MEDIUM = ["adware", "riskware", "not-a-virus", "hacktool"]
FIREWALL_PORTS = [4444, 4445, 1337, 31337, 8080, 8443, 9001, 9050, 6667, 1080, 3389, 5985, 5986, 22, 23, 21, 2375, 2376]

Getter = Callable[..., Column]


def _getter(df: DataFrame) -> Getter:
    """First non-empty value among the names that exist, as text; matching is case-sensitive."""
    have = set(df.columns)

    def get(*names: str) -> Column:
        found = [F.col(f"`{n}`").cast("string") for n in names if n in have]
        return first_filled(*found) if found else F.lit(None).cast("string")

    return get


def _base(df: DataFrame, source: str, get: Getter) -> dict[str, Column]:
    return {"event_id": hash_id(*[F.col(f"`{c}`") for c in sorted(df.columns)]), "source_type": F.lit(source),
            "timestamp": get("timestamp", "TimeCreated", "time"), "hostname": get("hostname", "Computer", "host")}


def _emit(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return as_unified(df.select(*[v.alias(k) for k, v in cols.items() if k in UNIFIED_COLUMNS]))


def _lookup(key: Column, table: dict[int, str], default: str | None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def _in_sets(key: Column, sets: list[tuple[list[int], str]], default: str) -> Column:
    out = F
    for ids, v in sets:
        out = out.when(key.isin(ids), v)
    return out.otherwise(default)


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def logon_type(code: Column) -> Column:
    return _lookup(code.try_cast("int"), LOGON_TYPES, None)


def digest(hashes: Column, algo: str) -> Column:
    found = F.regexp_extract(nz(hashes), rf"{algo}=([0-9A-Fa-f]+)", 1)
    return F.when(found != "", found)


def windows_security(df: DataFrame) -> DataFrame:
    g = _getter(df)
    eid = _int(g("EventID", "event_id"))
    return _emit(df, _base(df, "windows_security", g) | {
        "os_platform": F.lit("windows"), "raw_event_id": eid, "raw_eid": eid,
        "user": g("SubjectUserName", "TargetUserName", "user"),
        "user_domain": g("SubjectDomainName", "TargetDomainName"), "user_sid": g("SubjectUserSid", "TargetSid"),
        "logon_type": logon_type(g("LogonType")), "auth_package": g("AuthenticationPackageName", "PackageName"),
        "privilege_list": nz(g("PrivilegeList")), "src_ip": g("IpAddress", "src_ip"), "src_port": g("IpPort"),
        "target_user": g("TargetUserName"), "target_computer": g("TargetServerName", "WorkstationName"),
        "process_name": nz(g("ProcessName", "NewProcessName")), "command_line": nz(g("CommandLine")),
        "service_name": g("ServiceName", "TaskName"),
        "severity": _in_sets(eid, [([4648, 4672, 4698, 4720, 4728, 4732, 4756, 7045], "high"),
                                   ([4688, 4625, 4740, 5140, 5145], "medium")], "info"),
        "event_type": _in_sets(eid, SECURITY_TYPES, "other")})


def sysmon(df: DataFrame) -> DataFrame:
    g = _getter(df)
    eid = _int(g("EventID", "event_id"))
    return _emit(df, _base(df, "sysmon", g) | {
        "os_platform": F.lit("windows"), "raw_event_id": eid, "raw_eid": eid,
        "process_name": basename(g("Image", "process_name")), "process_path": g("Image", "process_path"),
        "process_pid": g("ProcessId", "pid"), "parent_process": basename(g("ParentImage")),
        "parent_pid": g("ParentProcessId"), "command_line": nz(g("CommandLine", "command_line")),
        "process_hash_md5": digest(g("Hashes"), "MD5"), "process_hash_sha256": digest(g("Hashes"), "SHA256"),
        "process_signed": F.coalesce(g("Signed") == "true", F.lit(False)), "process_signature": g("Signature"),
        "user": g("User", "user"), "dst_ip": g("DestinationIp", "destination_ip"),
        "dst_port": g("DestinationPort", "destination_port"), "src_ip": g("SourceIp", "source_ip"),
        "dns_query": g("QueryName", "dns_query"), "file_path": g("TargetFilename", "file_path"),
        "registry_key": g("TargetObject"), "registry_value": g("Details"),
        "severity": _in_sets(eid, [([8, 10, 25], "critical"), ([1, 6, 7], "high"),
                                   ([3, 11, 12, 13, 17, 22], "medium")], "info"),
        "event_type": _lookup(eid, SYSMON_TYPES, "other")})


def active_directory(df: DataFrame) -> DataFrame:
    g = _getter(df)
    eid = _int(g("EventID"))
    ticket = g("TicketEncryptionType", "ticket_encryption")
    enc = parse_int(ticket)
    severity = (F.when((eid == 4662) & g("AccessMask").isin("0x100", "0x40100"), "critical")
                .when((eid == 4769) & enc.isin(0x17, 0x18), "critical")
                .when((eid == 4768) & g("PreAuthType").isin("0", "0x0"), "critical")
                .when(eid.isin(4648, 4771, 4728, 4732, 4756, 4757), "high").when(eid.isin(4720, 4726), "medium")
                .otherwise("info"))
    return _emit(df, _base(df, "active_directory", g) | {
        "os_platform": F.lit("windows"), "raw_event_id": eid, "raw_eid": eid, "user": g("SubjectUserName", "user"),
        "user_domain": g("SubjectDomainName"), "target_user": g("TargetUserName", "ServiceName"),
        "target_computer": g("ServiceName", "TargetServerName"), "src_ip": g("IpAddress", "src_ip"),
        "auth_package": g("AuthenticationPackageName"), "service_name": g("ServiceName"),
        "group_name": g("GroupName", "TargetUserName"), "privilege_list": nz(g("PrivilegeList")),
        "logon_type": logon_type(g("LogonType")), "ticket_encryption": ticket,
        "kerberos_ticket_type": F.when(eid == 4768, "TGT").otherwise("TGS"), "severity": severity,
        "event_type": F.when(eid.isin(4768, 4769, 4771, 4648, 4776), "auth").otherwise("account_change")})


def rebuilt_command(df: DataFrame) -> Column:
    """a0, a1, … up to the first gap, hex parts decoded; else the plain command."""
    g = _getter(df)
    have = set(df.columns)
    args = F.array(*[F.col(f"`a{i}`").cast("string") if f"a{i}" in have else F.lit(None).cast("string")
                     for i in range(20)])
    gap = F.array_position(F.transform(args, lambda a: a.isNull()), True)
    n = F.when(gap > 0, gap - 1).otherwise(20).cast("int")
    is_hex = lambda a: a.rlike("^[0-9A-Fa-f]{2,}$") & (F.length(a) % 2 == 0)
    plain = F.transform(F.slice(args, F.lit(1), n), lambda a: F.when(
        is_hex(a), F.decode(F.unhex(a), "utf-8")).otherwise(a))
    return F.when(n > 0, F.array_join(plain, " ")).otherwise(nz(g("cmd", "command_line")))


def linux_audit(df: DataFrame) -> DataFrame:
    g = _getter(df)
    kind = F.upper(nz(g("type")))
    uid, euid = g("uid", "auid"), g("euid")
    cmd = rebuilt_command(df)
    file, path, proc, sudo = g("name", "file_path"), g("exe", "process_path"), nz(g("comm", "process_name")), g(
        "cmd", "sudo_command")
    root = F.coalesce(uid == "0", F.lit(False)) | F.coalesce(euid == "0", F.lit(False))
    severity = (F.when(root & has_any(F.lower(cmd), ["/tmp", "/dev/shm"]), "critical")
                .when(starts_any(low(file), SENSITIVE_FILES), "critical")
                .when(F.lower(proc).isin(DANGEROUS_COMMANDS), "high").when(has_any(nz(path), RISKY_DIRS), "high")
                .when(filled(sudo), "medium").otherwise("info"))
    event_type = (F.when(has_any(kind, ["AUTH", "LOGIN", "CRED"]), "auth").when(has(kind, "EXEC"), "process_create")
                  .when(has_any(kind, ["CONNECT", "BIND"]), "network_connection")
                  .when(has_any(kind, ["OPEN", "WRITE", "PATH"]), "file_access").when(has(kind, "SYSCALL"), "syscall")
                  .otherwise("other"))
    return _emit(df, _base(df, "linux_auditd", g) | {
        "os_platform": F.lit("linux"), "raw_event_id": F.coalesce(g("type", "event_type"), F.lit("UNKNOWN")),
        "linux_uid": uid, "linux_euid": euid, "linux_auid": g("auid"),
        "user": F.coalesce(g("acct", "user"), F.concat(F.lit("uid:"), F.coalesce(uid, F.lit("None")))),
        "process_name": proc, "process_path": path, "process_pid": g("pid"), "parent_pid": g("ppid"),
        "command_line": cmd, "syscall": g("syscall", "SYSCALL"), "file_path": file, "dst_ip": g("addr", "dst_ip"),
        "dst_port": g("port", "dst_port"), "sudo_command": sudo, "event_type": event_type, "severity": severity})


def linux_auth(df: DataFrame) -> DataFrame:
    g = _getter(df)
    msg, fails = low(g("message", "msg")), _int(g("fail_count"))
    cases = [(has(msg, "accepted"), "auth", "info"), (has_any(msg, ["failed", "failure"]), "auth_failure", "medium"),
             (has(msg, "invalid user"), "auth_failure", "high"),
             (has(msg, "sudo") & has(msg, "root"), "privilege_escalation", "high"),
             (has(msg, "sudo"), "privilege_escalation", "medium")]
    kind, sev = F, F
    for cond, k, s in cases:
        kind, sev = kind.when(cond, k), sev.when(cond, s)
    return _emit(df, _base(df, "linux_auth", g) | {
        "os_platform": F.lit("linux"), "user": g("user", "account"), "src_ip": g("src_ip", "remote_host"),
        "src_port": g("src_port"), "sudo_command": g("command", "sudo_command"),
        "ssh_key_type": g("key_type", "ssh_key_type"), "process_name": F.coalesce(g("process"), F.lit("sshd")),
        "event_type": kind.otherwise("auth"),
        "severity": F.when(fails > 50, "critical").when(fails > 10, "high").otherwise(sev.otherwise("info"))})


def antivirus(df: DataFrame) -> DataFrame:
    g = _getter(df)
    threat = nz(g("threat_name", "VirusName", "ThreatName"))
    name = F.lower(threat)
    code = F.coalesce(g("event_type", "EventType"), F.lit("GNRL_EV_DETECT"))
    kind = F
    for word in THREAT_KINDS:
        kind = kind.when(has(name, word), word.capitalize())
    result = F.coalesce(g("result", "DetectionResult"), F.lit("Detected"))
    flagged = F.lower(result).isin("detected", "blocked", "not_cured", "not_disinfected")
    file = nz(g("object_path", "ObjectPath", "file_path"))
    severity = (F.when(has_any(name, THREAT_CRITICAL), "critical").when(has_any(name, THREAT_HIGH), "high")
                .when(has_any(F.lower(code), ["ransomware", "exploit"]), "critical")
                .when(has_any(name, THREAT_MEDIUM), "medium").otherwise("info"))
    return _emit(df, _base(df, "kaspersky", g) | {
        "os_platform": F.coalesce(g("os_platform"), F.lit("windows")), "threat_name": threat,
        "threat_category": F.coalesce(g("category"), F.when(threat == "", "unknown").otherwise(
            kind.otherwise("Other"))),
        "detection_result": result, "kaspersky_action": nz(g("action", "Action")), "file_path": file,
        "process_name": basename(file), "process_hash_md5": g("md5", "ObjectMD5"), "user": g("user", "UserName"),
        "src_ip": g("src_ip", "RemoteHost"), "raw_event_id": code, "event_type": F.lit("threat_detection"),
        "severity": severity, "label": F.when(flagged, 1), "label_source": F.when(flagged, "kaspersky")})


def firewall(df: DataFrame) -> DataFrame:
    g = _getter(df)
    action = F.coalesce(g("action", "act"), F.lit("ALLOW"))
    port = g("dpt", "dst_port", "destinationPort").try_cast("int")
    sent = g("out", "bytes_out", "bytesSent").try_cast("bigint")
    severity = (F.when(F.upper(action).isin("BLOCK", "DENY", "DROP", "REJECT"), "medium")
                .when(port.isin(FIREWALL_PORTS), "high").when(sent > 50_000_000, "high")
                .when(sent > 10_000_000, "medium").otherwise("info"))
    return _emit(df, _base(df, "firewall", g) | {
        "src_ip": g("src", "src_ip", "sourceAddress"), "src_port": g("spt", "src_port", "sourcePort"),
        "dst_ip": g("dst", "dst_ip", "destinationAddress"), "dst_port": port,
        "protocol": F.coalesce(g("proto", "protocol"), F.lit("tcp")), "bytes_sent": sent,
        "bytes_recv": g("in", "bytes_in", "bytesReceived").try_cast("bigint"), "raw_event_id": action,
        "event_type": F.lit("network_connection"), "severity": severity})


def pass_through(df: DataFrame) -> DataFrame:
    """Rows already in the unified layout; severity is re-derived so that it cannot carry the label."""
    g = _getter(df)
    have = [c for c in UNIFIED_COLUMNS if c in df.columns]
    out = df.withColumns({
        "source_type": F.coalesce(g("source_type"), F.lit("sysmon")),
        "event_id": F.coalesce(g("event_id"), hash_id(*[F.col(f"`{c}`") for c in sorted(df.columns)]))})
    return as_unified(out.select(*dict.fromkeys(have + ["source_type", "event_id"]))).withColumn(
        "raw_eid", F.coalesce(F.col("raw_eid"), F.col("raw_event_id").try_cast("int")))


def event_xml(df: DataFrame) -> DataFrame:
    """Parsed event XML: EventID, Computer and the EventData map `data`."""
    d = lambda *names: first_filled(*[F.element_at("data", n) for n in names])
    eid = F.coalesce(F.col("EventID").cast("int"), F.lit(0))
    image = nz(d("Image", "SourceImage", "NewProcessName"))
    lower_base = lambda c: F.lower(basename(c))
    return as_unified(df.select(
        hash_id(F.col("EventID"), F.col("Computer"), F.col("data")).alias("event_id"), F.lit("sysmon").alias("source_type"),
        F.col("Computer").alias("hostname"), F.lit("windows").alias("os_platform"), eid.alias("raw_event_id"),
        eid.alias("raw_eid"), lower_base(image).alias("process_name"), image.alias("process_path"),
        lower_base(d("ParentImage", "SourceImage")).alias("parent_process"), nz(d("CommandLine")).alias("command_line"),
        nz(d("User", "SubjectUserName", "SourceUser")).alias("user"),
        nz(d("DestinationIp", "DestinationIpAddress")).alias("dst_ip"), d("DestinationPort").alias("dst_port"),
        nz(d("SourceIp")).alias("src_ip"), F.when(eid == 10, lower_base(d("TargetImage"))).alias("target_user"),
        digest(d("Hashes"), "MD5").alias("process_hash_md5"), (low(d("Signed")) == "true").alias("process_signed"),
        nz(d("TargetFilename", "TargetObject")).alias("file_path"), label_free_severity(
            eid, lower_base(image), nz(d("DestinationIp", "DestinationIpAddress"))).alias("severity"),
        _lookup(eid, SYSMON_TYPES, "other").alias("event_type"), F.col("label").alias("label"),
        F.lit("splunk_xml").alias("label_source")))


def label_free_severity(eid: Column, process: Column, dst_ip: Column) -> Column:
    return (F.when(eid.isin(8, 10, 25), "critical").when(eid.isin(1, 7) & process.isin(NESTED_HIGH_PROCESSES), "high")
            .when((eid == 3) & (nz(dst_ip) != ""), "medium").otherwise("info"))


def _channel_source(channel: Column) -> Column:
    c = low(channel)
    return F.when(has(c, "sysmon"), "sysmon").when(has(c, "security"), "windows_security").otherwise("sysmon")


NESTED_SCHEMA = (
    "EventID string, Channel string, Computer string, TimeCreated string, `@timestamp` string, User string, "
    "AccountName string, hostname string, EventData map<string,string>, event_data map<string,string>, "
    "System struct<EventID:string,Channel:string,Computer:string>, "
    "winlog struct<event_id:string,channel:string,computer_name:string,event_data:map<string,string>>")


def nested_event(df: DataFrame, label: int | None = None, technique: str = "") -> DataFrame:
    """Nested records read with NESTED_SCHEMA; channel decides the source, severity never looks at the label."""
    data = F.coalesce("EventData", "event_data", "winlog.event_data", F.create_map().cast("map<string,string>"))
    d = lambda *names: first_filled(*[F.element_at(data, n) for n in names])
    eid = _int(F.element_at(F.split(nz(first_filled("EventID", "System.EventID", "winlog.event_id")), r"\."), 1))
    image = nz(d("Image", "NewProcessName"))
    proc = F.lower(basename(image))
    dst = nz(d("DestinationIp", "DestinationIpAddress"))
    hashes = d("Hashes")
    return as_unified(df.select(
        _channel_source(first_filled("Channel", "winlog.channel", "System.Channel")).alias("source_type"),
        hash_id(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias("event_id"),
        first_filled("TimeCreated", "`@timestamp`").alias("timestamp"),
        nz(first_filled("Computer", "hostname", "System.Computer", "winlog.computer_name")).alias("hostname"),
        F.lit("windows").alias("os_platform"), eid.alias("raw_event_id"), eid.alias("raw_eid"),
        _lookup(eid, SYSMON_TYPES | NESTED_EXTRA_TYPES, "other").alias("event_type"),
        label_free_severity(eid, proc, dst).alias("severity"), proc.alias("process_name"), image.alias("process_path"),
        digest(hashes, "MD5").alias("process_hash_md5"), digest(hashes, "SHA256").alias("process_hash_sha256"),
        (low(d("Signed")) == "true").alias("process_signed"),
        F.lower(basename(nz(d("ParentImage")))).alias("parent_process"),
        nz(d("CommandLine", "ProcessCommandLine")).alias("command_line"),
        nz(F.coalesce(d("User", "SubjectUserName", "TargetUserName"), first_filled("User", "AccountName"))).alias("user"),
        d("AuthenticationPackageName").alias("auth_package"), nz(d("PrivilegeList")).alias("privilege_list"),
        nz(d("SourceIp", "SourceAddress")).alias("src_ip"), d("SourcePort").alias("src_port"), dst.alias("dst_ip"),
        d("DestinationPort", "DestPort").alias("dst_port"), nz(d("TargetFilename", "TargetObject")).alias("file_path"),
        d("TargetObject").alias("registry_key"), d("Details").alias("registry_value"),
        d("TargetImage", "TargetUserName").alias("target_user"), F.lit(label).cast("int").alias("label"),
        F.lit(f"otrf_{technique}").alias("label_source")))


def reshape_training(df: DataFrame) -> DataFrame:
    """Flat training events (with a label column) to the unified layout."""
    g = _getter(df)
    eid = _int(F.element_at(F.split(nz(g("event_id")), r"\."), 1))
    return as_unified(df.select(
        _channel_source(g("channel")).alias("source_type"),
        hash_id(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias("event_id"), g("timestamp").alias("timestamp"),
        g("hostname").alias("hostname"), F.lit("windows").alias("os_platform"), eid.alias("raw_event_id"),
        eid.alias("raw_eid"), _lookup(eid, SYSMON_TYPES, "other").alias("event_type"),
        _in_sets(eid, [([8, 10, 25], "critical"), ([1, 7], "high"), ([3], "medium")], "info").alias("severity"),
        F.lower(basename(g("process_name"))).alias("process_name"), nz(g("process_name")).alias("process_path"),
        digest(g("hashes"), "MD5").alias("process_hash_md5"), digest(g("hashes"), "SHA256").alias("process_hash_sha256"),
        F.coalesce(g("signed").isin("true", "True"), F.lit(False)).alias("process_signed"),
        F.lower(basename(g("parent_image"))).alias("parent_process"), nz(g("command_line")).alias("command_line"),
        nz(g("user")).alias("user"), F.lit("").alias("privilege_list"), g("image_loaded").alias("file_path"),
        g("label").alias("label"), F.coalesce(g("source_type"), F.lit("existing_training")).alias("label_source")))


RECORDING_ALIASES = {
    "event_id": ["EventID", "event_id"], "process_name": ["Image", "ProcessName", "process_name", "NewProcessName"],
    "command_line": ["CommandLine", "command_line", "ProcessCommandLine"],
    "parent_image": ["ParentImage", "parent_image", "ParentProcessName"],
    "user": ["User", "user", "SubjectUserName", "TargetUserName", "UserName"],
    "hostname": ["ComputerName", "Computer", "hostname", "host"],
    "timestamp": ["TimeCreated", "UtcTime", "timestamp", "@timestamp"],
    "destination_ip": ["DestinationIp", "destination_ip", "dst_ip"],
    "destination_port": ["DestinationPort", "destination_port", "dst_port"],
    "hashes": ["Hashes", "hashes", "Hash", "md5", "sha256"], "logon_type": ["LogonType", "logon_type"],
    "channel": ["Channel", "channel", "log_name"]}


def recording_event(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Attack recordings: first non-empty alias per field; rows without command and process drop out."""
    g = _getter(df)
    ints = ("destination_port", "logon_type")
    out = df.select(*keep, *[(g(*names).try_cast("int") if f in ints else g(*names)).alias(f)
                             for f, names in RECORDING_ALIASES.items()])
    return out.where(filled("command_line") | filled("process_name"))


def tactic_from_path(path: Column) -> Column:
    text = F.lower(path)
    out = F
    for word in L.TACTIC_WORDS:
        out = out.when(has(text, word), word)
    return out.otherwise("unknown")


def mapped_class(key: Column, table: dict[str, str], default: str = L.DEFAULT_CLASS) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


FLOW_A = {"source_ip": ["Source IP", "Src IP", "src_ip"], "destination_ip": ["Destination IP", "Dst IP", "dst_ip"],
          "source_port": ["Source Port", "Src Port", "src_port"],
          "destination_port": ["Destination Port", "Dst Port", "dst_port"], "protocol": ["Protocol", "protocol"],
          "flow_duration": ["Flow Duration", "flow_duration"], "fwd_packets": ["Total Fwd Packets", "tot_fwd_pkts"],
          "bwd_packets": ["Total Backward Packets", "tot_bwd_pkts"],
          "bytes_per_sec": ["Flow Bytes/s", "flow_byts_s"], "packets_per_sec": ["Flow Packets/s", "flow_pkts_s"]}
FLOW_A_LABELS = ["Label", "label", "Attack", "attack_cat"]
FLOW_B = {"source_ip": "srcip", "destination_ip": "dstip", "source_port": "sport", "destination_port": "dsport",
          "protocol": "proto", "duration": "dur", "src_bytes": "sbytes", "dst_bytes": "dbytes", "src_ttl": "sttl",
          "dst_ttl": "dttl", "src_loss": "sloss", "dst_loss": "dloss", "service": "service", "src_load": "sload",
          "dst_load": "dload", "src_packets": "spkts", "dst_packets": "dpkts"}
_WHOLE = ("source_port", "destination_port", "fwd_packets", "bwd_packets", "src_bytes", "dst_bytes", "src_packets",
          "dst_packets", "src_ttl", "dst_ttl")
_REAL = ("flow_duration", "bytes_per_sec", "packets_per_sec", "duration", "src_load", "dst_load")


def _flow_value(name: str, value: Column) -> Column:
    if name in _WHOLE:
        return value.try_cast("double").try_cast("bigint")
    return value.try_cast("double") if name in _REAL else value


def flow_a(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flow records, first dialect; header names are trimmed first. No label column means no rows."""
    df = df.toDF(*[c.strip() for c in df.columns])
    g = _getter(df)
    label_col = next((c for c in FLOW_A_LABELS if c in df.columns), None)
    if label_col is None:
        return df.limit(0)
    raw = F.lower(F.trim(nz(label_col)))
    return df.select(*keep, *[_flow_value(n, g(*names)).alias(n) for n, names in FLOW_A.items()],
                     raw.alias("raw_label"), mapped_class(raw, L.FLOW_A_CLASS).alias("class"))


def flow_b(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    g = _getter(df)
    label_col = "attack_cat" if "attack_cat" in df.columns else "label"
    raw = F.lower(F.trim(F.coalesce(F.col(label_col).cast("string"), F.lit("normal")))) if label_col in df.columns else (
        F.lit("normal"))
    return df.select(*keep, *[_flow_value(n, g(src)).alias(n) for n, src in FLOW_B.items()], raw.alias("raw_label"),
                     mapped_class(raw, L.FLOW_B_CLASS).alias("class"))


NORMALISERS = {"windows_security": windows_security, "sysmon": sysmon, "active_directory": active_directory,
               "linux_auditd": linux_audit, "linux_auth": linux_auth, "kaspersky": antivirus, "firewall": firewall,
               "passthrough": pass_through}

