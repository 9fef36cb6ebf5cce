"""Queries on readers and normalisers. Raw records are projected from the events table, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.text import nz
from tidewatch.operators import features, scoring
from tidewatch.plans.detect import events, lit, r, r6, se
from tidewatch.plans.oracle_base import among, any_word
from tidewatch.rules import detection as D
from tidewatch.rules import labels as L
from tidewatch.schema import detection_view
from tidewatch.sources import normalize as N
from tidewatch.sources import readers as R

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def case_of(col: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k if isinstance(k, int) else lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def sets_of(col: str, sets, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN {among(ids)} THEN {lit(v)}" for ids, v in sets) + f" ELSE {lit(default)} END"


_KEYTXT = "CAST(event_key AS STRING)"
_LOGON = case_of("logon_type", N.LOGON_TYPES)


def raw_windows(spark, sf):
    return events(spark, sf).selectExpr(
        "event_id AS EventID", "user AS SubjectUserName", "logon_type AS LogonType", "source_ip AS IpAddress",
        "process_name AS ProcessName", "command_line AS CommandLine", "timestamp", "hostname AS Computer",
        f"{_KEYTXT} AS ServiceName", "'NTLM' AS PackageName")


@query("normalise_windows_security", f"WITH {se()} SELECT {_KEYTXT} AS service_name, event_id AS raw_eid, hostname, \"user\", {_LOGON} AS logon_type, "
       "'NTLM' AS auth_package, source_ip AS src_ip, " + sets_of("event_id", [
           ([4648, 4672, 4698, 4720, 4728, 4732, 4756, 7045], "high"), ([4688, 4625, 4740, 5140, 5145], "medium")], "info") +
       " AS severity, " + sets_of("event_id", N.SECURITY_TYPES, "other") + " AS event_type FROM se")
def normalise_windows_security(spark, sf):
    return N.windows_security(raw_windows(spark, sf)).select(
        "service_name", "raw_eid", "hostname", "user", "logon_type", "auth_package", "src_ip", "severity", "event_type")


def raw_sysmon(spark, sf):
    return events(spark, sf).selectExpr(
        "event_id AS EventID", "process_name AS Image", "parent_image AS ParentImage", "command_line AS CommandLine",
        "hashes AS Hashes", "signed AS Signed", "user AS User", "destination_ip AS DestinationIp",
        "destination_port AS DestinationPort", "query_name AS QueryName", "target_object AS TargetObject",
        f"{_KEYTXT} AS Details", "hostname AS Computer", "timestamp AS TimeCreated")


_BASE = "regexp_extract(process_name, '[^/\\\\]*$')"


@query("normalise_sysmon", f"WITH {se()} SELECT {_KEYTXT} AS registry_value, event_id AS raw_eid, {_BASE} AS process_name, parent_image AS "
       "parent_process, nullif(regexp_extract(hashes, 'MD5=([0-9A-Fa-f]+)', 1), '') AS process_hash_md5, coalesce(signed = 'true', false) AS "
       "process_signed, nullif(query_name, '') AS dns_query, destination_port AS dst_port, " + sets_of("event_id", [
           ([8, 10, 25], "critical"), ([1, 6, 7], "high"), ([3, 11, 12, 13, 17, 22], "medium")], "info") + " AS severity, " +
       case_of("event_id", N.SYSMON_TYPES, "'other'") + " AS event_type FROM se")
def normalise_sysmon(spark, sf):
    return N.sysmon(raw_sysmon(spark, sf)).select(
        "registry_value", "raw_eid", "process_name", "parent_process", "process_hash_md5", "process_signed", "dns_query", "dst_port",
        "severity", "event_type")


_ADE = "CASE CAST(event_key % 8 AS INT) WHEN 0 THEN 4768 WHEN 1 THEN 4769 WHEN 2 THEN 4662 WHEN 3 THEN 4771 WHEN 4 THEN 4728 WHEN 5 THEN 4720 ELSE 4776 END"
_ENC = "CASE CAST(event_key % 3 AS INT) WHEN 0 THEN '0x17' WHEN 1 THEN '18' ELSE '23' END"


@query("normalise_active_directory", f"WITH {se()}, t AS (SELECT *, {_ADE} AS e, {_ENC} AS enc FROM se) SELECT {_KEYTXT} AS service_name, e AS raw_eid, enc "
       "AS ticket_encryption, CASE WHEN e = 4768 THEN 'TGT' ELSE 'TGS' END AS kerberos_ticket_type, CASE WHEN e = 4662 AND event_key % 16 = 2 THEN "
       "'critical' WHEN e = 4769 AND enc IN ('0x17', '23') THEN 'critical' WHEN e = 4768 AND event_key % 16 = 0 THEN 'critical' WHEN e IN (4771, "
       "4728) THEN 'high' WHEN e = 4720 THEN 'medium' ELSE 'info' END AS severity, CASE WHEN e IN (4768, 4769, 4771, 4648, 4776) THEN 'auth' ELSE "
       "'account_change' END AS event_type FROM t")
def normalise_active_directory(spark, sf):
    raw = events(spark, sf).selectExpr(
        f"{_ADE} AS EventID", f"{_ENC} AS TicketEncryptionType", f"{_KEYTXT} AS ServiceName", "user AS SubjectUserName",
        "CASE WHEN event_key % 16 = 2 THEN '0x100' ELSE '0x2' END AS AccessMask", "CASE WHEN event_key % 16 = 0 THEN '0' ELSE '2' END AS PreAuthType")
    return N.active_directory(raw).select("service_name", "raw_eid", "ticket_encryption", "kerberos_ticket_type", "severity", "event_type")


_AUD = ("CASE CAST(event_key % 5 AS INT) WHEN 0 THEN 'EXECVE' WHEN 1 THEN 'USER_LOGIN' WHEN 2 THEN 'CONNECT' WHEN 3 THEN 'OPENAT' ELSE 'SYSCALL' END")
_COMM = "CASE CAST(event_key % 4 AS INT) WHEN 0 THEN 'nc' WHEN 1 THEN 'sshd' WHEN 2 THEN 'python' ELSE 'cron' END"


@query("normalise_linux_audit", f"WITH {se()}, t AS (SELECT *, {_AUD} AS ty, {_COMM} AS cm FROM se) SELECT {_KEYTXT} AS process_pid, CASE WHEN event_key % 6 = "
       "0 THEN 'ls -la /tmp' WHEN event_key % 6 = 1 THEN 'cat' ELSE '' END AS command_line, CASE WHEN event_key % 6 = 0 AND event_key % 7 = 0 THEN 'critical' WHEN "
       "event_key % 11 = 0 THEN 'critical' WHEN cm IN ('nc', 'python') THEN 'high' ELSE 'info' END AS severity, CASE WHEN ty = 'USER_LOGIN' THEN "
       "'auth' WHEN ty = 'EXECVE' THEN 'process_create' WHEN ty = 'CONNECT' THEN 'network_connection' WHEN ty = 'OPENAT' THEN 'file_access' ELSE "
       "'syscall' END AS event_type, concat('uid:', CASE WHEN event_key % 7 = 0 THEN '0' ELSE '1000' END) AS \"user\" FROM t")
def normalise_linux_audit(spark, sf):
    raw = events(spark, sf).selectExpr(
        f"{_AUD} AS type", f"{_COMM} AS comm", f"{_KEYTXT} AS pid", "CASE WHEN event_key % 7 = 0 THEN '0' ELSE '1000' END AS uid",
        "CASE WHEN event_key % 6 = 0 THEN 'ls' WHEN event_key % 6 = 1 THEN '636174' END AS a0", "CASE WHEN event_key % 6 = 0 THEN '-la' END AS a1",
        "CASE WHEN event_key % 6 = 0 THEN '2F746D70' END AS a2", "CASE WHEN event_key % 11 = 0 THEN '/etc/shadow' ELSE '/var/log/x' END AS name")
    out = N.linux_audit(raw)
    return out.select(F.col("process_pid").cast("string").alias("process_pid"), "command_line", "severity", "event_type", "user")


_MSG = ("CASE CAST(event_key % 6 AS INT) WHEN 0 THEN 'Accepted password' WHEN 1 THEN 'Failed password' WHEN 2 THEN 'Invalid user x' WHEN 3 THEN "
        "'sudo: root session' WHEN 4 THEN 'sudo: bob' ELSE 'session opened' END")


@query("normalise_linux_auth", f"WITH {se()} SELECT {_KEYTXT} AS ssh_key_type, CASE CAST(event_key % 6 AS INT) WHEN 1 THEN 'auth_failure' WHEN 2 THEN "
       "'auth_failure' WHEN 3 THEN 'privilege_escalation' WHEN 4 THEN 'privilege_escalation' ELSE 'auth' END AS event_type, CASE WHEN event_key % 70 "
       "> 50 THEN 'critical' WHEN event_key % 70 > 10 THEN 'high' ELSE CASE CAST(event_key % 6 AS INT) WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 "
       "THEN 'high' WHEN 4 THEN 'medium' ELSE 'info' END END AS severity FROM se")
def normalise_linux_auth(spark, sf):
    raw = events(spark, sf).selectExpr(f"{_MSG} AS message", "event_key % 70 AS fail_count", f"{_KEYTXT} AS key_type", "user")
    return N.linux_auth(raw).select("ssh_key_type", "event_type", "severity")


_THR = ("CASE CAST(event_key % 6 AS INT) WHEN 0 THEN 'HEUR:Trojan.Win32' WHEN 1 THEN 'Net-Worm.X' WHEN 2 THEN 'not-a-virus:Adware' WHEN 3 THEN '' WHEN 4 "
        "THEN 'Tool.Generic' ELSE 'Backdoor.Y' END")


@query("normalise_antivirus", f"WITH {se()} SELECT {_KEYTXT} AS process_hash_md5, CASE CAST(event_key % 6 AS INT) WHEN 0 THEN 'Trojan' WHEN 1 THEN 'Worm' WHEN 2 THEN "
       "'Virus' WHEN 3 THEN 'unknown' WHEN 4 THEN 'Other' ELSE 'Backdoor' END AS threat_category, CASE CAST(event_key % 6 AS INT) WHEN 0 THEN 'critical' "
       "WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 5 THEN 'critical' ELSE CASE WHEN event_key % 4 = 0 THEN 'critical' ELSE 'info' END END AS severity, "
       "'drop.exe' AS process_name, CASE WHEN event_key % 3 = 0 THEN 1 END AS label FROM se")
def normalise_antivirus(spark, sf):
    raw = events(spark, sf).selectExpr(
        f"{_THR} AS threat_name", f"{_KEYTXT} AS md5", "CASE WHEN event_key % 3 = 0 THEN 'Blocked' ELSE 'Disinfected' END AS result",
        "concat_ws(chr(92), 'C:', 'Temp', 'drop.exe') AS object_path", "CASE WHEN event_key % 4 = 0 THEN 'EXPLOIT_DETECTED' ELSE 'GNRL_EV_DETECT' END AS event_type")
    return N.antivirus(raw).select("process_hash_md5", "threat_category", "severity", "process_name", "label")


@query("normalise_firewall", f"WITH {se()} SELECT source_ip AS src_ip, destination_port AS dst_port, CAST(event_key * 10000 AS BIGINT) AS bytes_sent, CASE WHEN event_key % "
       f"7 = 0 THEN 'medium' WHEN destination_port IN {among(N.FIREWALL_PORTS)} THEN 'high' WHEN event_key * 10000 > 50000000 THEN 'high' WHEN event_key * "
       "10000 > 10000000 THEN 'medium' ELSE 'info' END AS severity FROM se")
def normalise_firewall(spark, sf):
    raw = events(spark, sf).selectExpr(
        "source_ip AS src", "destination_ip AS dst", "destination_port AS dpt", "event_key * 10000 AS `out`",
        "CASE WHEN event_key % 7 = 0 THEN 'drop' ELSE 'ALLOW' END AS action")
    return N.firewall(raw).select("src_ip", "dst_port", "bytes_sent", "severity")


# ---------------------------------------------------------------- XML, nested JSON, recordings
def event_xml_lines(spark, sf):
    """The event view rendered as one <Event> line per row."""
    data = lambda n, c: F.concat(F.lit(f'<Data Name="{n}">'), F.replace(F.replace(nz(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                                 F.lit("</Data>"))
    return events(spark, sf).select("event_key", F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>'), F.col("event_id").cast("string"),
        F.lit("</EventID><Computer>"), F.col("hostname"), F.lit("</Computer><Channel>"), F.col("channel"),
        F.lit("</Channel></System><EventData>"), data("Image", "process_name"), data("CommandLine", "command_line"),
        data("Hashes", "hashes"), data("User", "user"), data("DestinationIp", "destination_ip"), F.lit("</EventData></Event>")).alias("value"))


_XSEV = (f"CASE WHEN event_id IN (8, 10, 25) THEN 'critical' WHEN event_id IN (1, 7) AND lower({_BASE}) IN {among(N.NESTED_HIGH_PROCESSES)} THEN 'high' "
         "WHEN event_id = 3 AND destination_ip <> '' THEN 'medium' ELSE 'info' END")


@query("event_xml", f"WITH {se()} SELECT event_key, event_id, hostname, process_name, trim(command_line) AS command_line FROM se")
def event_xml(spark, sf):
    out = R.parse_event_xml(event_xml_lines(spark, sf))
    return out.select("event_key", F.col("EventID").alias("event_id"), F.col("Computer").alias("hostname"),
                      F.element_at("data", "Image").alias("process_name"), nz(F.element_at("data", "CommandLine")).alias("command_line"))


@query("normalise_event_xml", f"WITH {se()} SELECT hostname, event_id AS raw_eid, lower({_BASE}) AS process_name, nullif(regexp_extract(hashes, "
       f"'MD5=([0-9A-Fa-f]+)', 1), '') AS process_hash_md5, {_XSEV} AS severity, {case_of('event_id', N.SYSMON_TYPES, chr(39) + 'other' + chr(39))} AS "
       "event_type, 1 AS label FROM se")
def normalise_event_xml(spark, sf):
    return N.event_xml(R.parse_event_xml(event_xml_lines(spark, sf))).select(
        "hostname", "raw_eid", "process_name", "process_hash_md5", "severity", "event_type", "label")


def nested_json(spark, sf):
    ev = events(spark, sf)
    return ev.select(F.to_json(F.struct(
        F.col("channel").alias("Channel"), F.col("hostname").alias("Computer"), F.col("timestamp").alias("@timestamp"),
        F.struct(F.col("event_id").cast("string").alias("EventID")).alias("System"),
        F.create_map(F.lit("Image"), F.col("process_name"), F.lit("CommandLine"), F.col("command_line"), F.lit("DestinationIp"),
                     F.col("destination_ip"), F.lit("Hashes"), F.col("hashes"), F.lit("User"), F.col("user"), F.lit("Details"),
                     F.col("event_key").cast("string")).alias("EventData"))).alias("value"))


_ET = N.SYSMON_TYPES | N.NESTED_EXTRA_TYPES


@query("normalise_nested", f"WITH {se()} SELECT {_KEYTXT} AS registry_value, CASE WHEN channel = 'Security' THEN 'windows_security' ELSE 'sysmon' END AS "
       f"source_type, event_id AS raw_eid, lower({_BASE}) AS process_name, {_XSEV} AS severity, {case_of('event_id', _ET, chr(39) + 'other' + chr(39))} AS event_type, "
       "\"user\" FROM se")
def normalise_nested(spark, sf):
    rows = nested_json(spark, sf).select(F.from_json("value", N.NESTED_SCHEMA).alias("r")).select("r.*")
    return N.nested_event(rows, 1, "T1003").select("registry_value", "source_type", "raw_eid", "process_name", "severity", "event_type", "user")


@query("reshape_training", f"WITH {se()} SELECT event_id AS raw_eid, lower({_BASE}) AS process_name, " + sets_of("event_id", [
    ([8, 10, 25], "critical"), ([1, 7], "high"), ([3], "medium")], "info") + " AS severity, label, source_type AS label_source, count(*) AS n FROM se GROUP BY ALL")
def reshape_training(spark, sf):
    out = N.reshape_training(events(spark, sf))
    return out.groupBy("raw_eid", "process_name", "severity", "label", "label_source").agg(F.count(F.lit(1)).alias("n"))


@query("recording_events", f"WITH {se()} SELECT event_key, CAST(event_id AS STRING) AS event_id, process_name, nullif(command_line, '') AS command_line, hostname, "
       "logon_type FROM se")
def recording_events(spark, sf):
    raw = events(spark, sf).selectExpr("event_key", "event_id AS EventID", "process_name AS NewProcessName", "command_line AS ProcessCommandLine",
                                       "hostname AS ComputerName", "logon_type AS LogonType")
    return N.recording_event(raw, ("event_key",)).select("event_key", "event_id", "process_name", "command_line", "hostname", "logon_type")


@query("alias_view", f"WITH {se()} SELECT hostname, event_id, process_name, count(*) AS n FROM se GROUP BY ALL")
def alias_view(spark, sf):
    """Records in the vendor dialect seen through the alias map."""
    out = detection_view(raw_sysmon(spark, sf))
    return out.groupBy("hostname", "event_id", "process_name").agg(F.count(F.lit(1)).alias("n"))


_PATH = ("concat('/data/', CASE CAST(event_key % 4 AS INT) WHEN 0 THEN 'credential_access' WHEN 1 THEN 'Lateral-Movement' WHEN 2 THEN 'discovery' ELSE 'misc' "
         "END, '/f', CAST(event_key AS STRING), '.json')")


@query("path_tactics", f"WITH {se('event_key')}, t AS (SELECT event_key, CASE CAST(event_key % 4 AS INT) WHEN 0 THEN 'credential_access' WHEN 1 THEN "
       "'lateral-movement' WHEN 2 THEN 'discovery' ELSE 'unknown' END AS tactic FROM se) SELECT event_key, tactic, CASE tactic WHEN 'credential_access' THEN "
       "'malicious_critical' WHEN 'lateral-movement' THEN 'malicious_critical' ELSE 'suspicious_medium' END AS class FROM t")
def path_tactics(spark, sf):
    t = events(spark, sf, "event_key").select("event_key", N.tactic_from_path(F.expr(_PATH)).alias("tactic"))
    return t.withColumn("class", N.mapped_class(F.col("tactic"), L.TACTIC_CLASS))


_FLAB = "CASE CAST(event_key % 4 AS INT) WHEN 0 THEN ' BENIGN' WHEN 1 THEN 'DoS Hulk' WHEN 2 THEN 'PortScan' ELSE 'New Attack' END"


@query("flow_records_a", f"WITH {se()} SELECT event_key, source_ip, CAST(destination_port AS BIGINT) AS destination_port, CASE CAST(event_key % 4 AS INT) WHEN 0 THEN 'benign' "
       f"WHEN 1 THEN 'malicious_high' WHEN 2 THEN 'suspicious_low' ELSE 'suspicious_medium' END AS class, {r6('value')} AS bytes_per_sec, concat_ws(' ', "
       "concat('Connection from ', source_ip, ' to ', CASE WHEN destination_ip = '' THEN 'unknown' ELSE destination_ip END), concat('destination port ', "
       "CAST(destination_port AS STRING)), 'protocol 6') AS opening FROM se")
def flow_records_a(spark, sf):
    raw = events(spark, sf).selectExpr(
        "event_key", "source_ip AS ` Source IP`", "destination_ip AS `Dst IP`", "concat(CAST(destination_port AS STRING), '.0') AS ` Destination Port`",
        "'6' AS Protocol", "value AS `Flow Bytes/s`", f"{_FLAB} AS ` Label`")
    flows = N.flow_a(raw, ("event_key",))
    text = scoring.flow_text
    flows = flows.withColumns({c: F.lit(None).cast("string") for c in ("service", "src_bytes", "dst_bytes")})
    opening = F.regexp_replace(text(), r" rate .*$", "")
    return flows.select("event_key", "source_ip", "destination_port", "class", r("bytes_per_sec").alias("bytes_per_sec"), opening.alias("opening"))


@query("flow_records_b", f"WITH {se()} SELECT event_key, CAST(destination_port AS BIGINT) AS destination_port, CAST(event_key AS BIGINT) AS src_bytes, CASE CAST(event_key % 3 "
       "AS INT) WHEN 0 THEN 'malicious_critical' WHEN 1 THEN 'suspicious_low' ELSE 'benign' END AS class FROM se")
def flow_records_b(spark, sf):
    raw = events(spark, sf).selectExpr(
        "event_key", "source_ip AS srcip", "destination_ip AS dstip", "destination_port AS dsport", "event_key AS sbytes", "value AS dur",
        "CASE CAST(event_key % 3 AS INT) WHEN 0 THEN ' Exploits ' WHEN 1 THEN 'Generic' END AS attack_cat")
    return N.flow_b(raw, ("event_key",)).select("event_key", "destination_port", "src_bytes", "class")


# ---------------------------------------------------------------- raw Windows records
def raw_records(spark, sf):
    """EventID with high bits set and positional inserts."""
    blank = "''"
    ins = [blank] * 20
    ins[0], ins[1], ins[2], ins[4], ins[5] = "hostname", "user", "script_block_text", _KEYTXT, "process_name"
    ins[8], ins[10], ins[13], ins[18], ins[19] = "command_line", "'bad password'", "parent_image", "source_ip", "source_ip"
    return events(spark, sf).selectExpr("event_key", "event_id + 65536 * 16 AS EventID", f"array({', '.join(ins)}) AS StringInserts",
                                        "CASE WHEN event_id IN (7045) THEN 'System' WHEN event_id = 4104 THEN 'Microsoft-Windows-PowerShell/Operational' "
                                        "ELSE 'Security' END AS channel")


_ACTION = ("CASE event_id WHEN 4688 THEN 'process_creation' WHEN 4624 THEN 'logon_success' WHEN 4625 THEN 'logon_failure' WHEN 4104 THEN "
           "'powershell_execution' WHEN 7045 THEN 'service_installed' END")
_CK = any_word("lower(CASE event_id WHEN 4688 THEN command_line WHEN 4104 THEN script_block_text WHEN 7045 THEN \"user\" ELSE '' END)", D.COLLECTOR_KEYWORDS)
_CP = any_word("lower(process_name)", D.COLLECTOR_PROCESSES)


@query("raw_windows_records", f"WITH {se()} SELECT event_key, event_id, {_ACTION} AS action, CASE event_id WHEN 4688 THEN \"user\" WHEN 4624 THEN process_name WHEN 4625 THEN "
       "process_name WHEN 4104 THEN \"user\" END AS \"user\", CASE WHEN event_id IN (4624, 4625) THEN source_ip END AS source_ip FROM se")
def raw_windows_records(spark, sf):
    return R.raw_windows_record(raw_records(spark, sf), keep=("event_key",)).select(
        "event_key", F.col("event_id").cast("int").alias("event_id"), "action", "user", "source_ip")


@query("allowed_events", f"WITH {se()} SELECT event_key, CASE WHEN event_id IN (4625, 7045, 4104) OR (event_id = 4688 AND ({_CK} OR {_CP})) THEN 'warning' ELSE 'info' END AS "
       "severity FROM se WHERE event_id IN (4688, 4624, 4625, 4648, 7045, 4104)")
def allowed_events(spark, sf):
    return R.allowed_events(R.raw_windows_record(raw_records(spark, sf), keep=("event_key",))).select("event_key", "severity")


@query("incremental_read", f"WITH {se('event_key', 'hostname')}, s AS (SELECT hostname, max(event_key) AS last FROM se WHERE event_key < 500 AND hostname <> 'WS-0001' GROUP BY 1) "
       "SELECT event_key, se.hostname FROM se LEFT JOIN s ON se.hostname = s.hostname WHERE last IS NULL OR event_key > last")
def incremental_read(spark, sf):
    ev = events(spark, sf, "event_key", "hostname")
    seen = ev.where((F.col("event_key") < 500) & (F.col("hostname") != "WS-0001"))
    return R.newer_than(ev, seen, "hostname", "event_key").select("event_key", "hostname")


@query("positional_labels", "SELECT conv_id, turn, role FROM conversations")
def positional_labels(spark, sf):
    """Parallel arrays per conversation joined by position."""
    from tidewatch.schema import load

    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"))
    turns = c.select("conv_id", F.posexplode(F.transform("s", lambda x: x["turn"])).alias("pos", "turn"))
    roles = c.select("conv_id", F.posexplode(F.transform("s", lambda x: x["role"])).alias("pos", "role"))
    return turns.join(roles, ["conv_id", "pos"]).select("conv_id", "turn", "role")


# ---------------------------------------------------------------- whole load, labels, 90 features
def unified(spark, sf):
    ev = events(spark, sf)
    fw = ev.where("source_type = 'firewall'").selectExpr("source_ip AS src", "destination_ip AS dst", "destination_port AS dpt", "timestamp", "hostname")
    sm = raw_sysmon(spark, sf).join(ev.select(F.col("event_key").cast("string").alias("Details"), "source_type"), "Details").where(
        "source_type = 'sysmon'").drop("source_type")
    return R.load_sources({"firewall_events.json": ("firewall", fw), "sysmon_events.json": ("sysmon", sm)})


_AL = ("CASE WHEN contains(cmd, 'sekurlsa') OR contains(cmd, 'logonpasswords') THEN 'rule_lsass_dump' WHEN contains(cmd, 'delete shadows') AND contains(pn, "
       "'vssadmin') THEN 'rule_vss_delete' WHEN length(cmd) >= 20 AND regexp_matches(cmd, '(?:[-]enc(?:oded)?(?:command)?|[- ][Ee])[ ]+([A-Za-z0-9+/=]{20,})') AND "
       "contains(pn, 'powershell') THEN 'rule_ps_base64' WHEN contains(cmd, '-nop') AND contains(cmd, '-w hidden') THEN 'rule_ps_hidden' WHEN pn IN "
       f"{among([p for p in D.ENT_PROCESSES if p not in ('net.exe', 'net1.exe')])} THEN 'rule_susp_proc' WHEN event_id = 4648 THEN 'rule_pass_the_hash' WHEN pn IN "
       f"{among(L.BENIGN_PROCESSES)} AND signed = 'true' THEN 'rule_known_signed_proc' ELSE 'uncertain' END")


@query("auto_labels", f"WITH {se()}, t AS (SELECT *, lower(command_line) AS cmd, lower({_BASE}) AS pn FROM se WHERE source_type = 'sysmon'), a AS (SELECT {_AL} AS "
       "reason FROM t) SELECT reason AS label_source, CASE WHEN reason = 'uncertain' THEN NULL WHEN reason = 'rule_known_signed_proc' THEN 0 ELSE 1 END AS label, "
       "count(*) AS n FROM a GROUP BY ALL")
def auto_labels(spark, sf):
    out = unified(spark, sf).where("source_file = 'sysmon_events.json'")
    return out.groupBy("label_source", "label").agg(F.count(F.lit(1)).alias("n"))


@query("source_file_counts", f"WITH {se()} SELECT concat(source_type, '_events.json') AS source_file, count(*) AS n, count(CASE WHEN source_type = 'firewall' AND "
       f"destination_port IN {among(N.FIREWALL_PORTS)} THEN 1 END) AS risky FROM se WHERE source_type IN ('firewall', 'sysmon') GROUP BY 1")
def source_file_counts(spark, sf):
    return unified(spark, sf).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        (F.col("source_type") == "firewall") & (F.col("severity") == "high")).alias("risky"))


@query("labelled_rows", f"WITH {se()}, t AS (SELECT *, lower(command_line) AS cmd, lower({_BASE}) AS pn FROM se WHERE source_type = 'sysmon') SELECT count(*) AS n FROM t "
       f"WHERE {_AL} <> 'uncertain'")
def labelled_rows(spark, sf):
    return unified(spark, sf).where(F.col("label").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


_ENT = {
    "proc_suspicious_exact": f"pn IN {among(D.ENT_PROCESSES)}", "proc_lolbas": f"pn IN {among(D.LOLBAS)}",
    "proc_signed": "signed = 'true'", "proc_has_hash": "hashes <> ''", "cmd_lsass_cred": any_word("cmd", ["sekurlsa", "logonpasswords", "lsadump"]),
    "cmd_vss_delete": any_word("cmd", ["delete shadows", "vss"]), "cmd_schtasks": any_word("cmd", ["schtasks", "taskschd", "at "]),
    "cmd_ps_hidden": any_word("cmd", ["-nop", "-noninteractive", "-w hidden", "-windowstyle"]), "sev_high": "event_id IN (1, 6, 7)",
    "net_dst_external": "destination_ip LIKE '203.%'", "net_c2_port": "destination_port IN (4444)", "net_http_port": "destination_port IN (443, 8080)",
    "auth_admin_user": "contains(lower(\"user\"), 'admin')", "etype_network": "event_id = 3", "ad_explicit_creds": "event_id = 4648",
    "net_dns_external": "query_name <> '' AND (destination_ip LIKE '203.%' OR destination_ip = '')", "cmd_psexec_wmi": "contains(cmd, 'psexec')"}


@query("features_90", f"WITH {se()}, t AS (SELECT *, lower(command_line) AS cmd, lower({_BASE}) AS pn FROM se) SELECT {_KEYTXT} AS registry_value, " + ", ".join(
    f"CAST(CASE WHEN {c} THEN 1 ELSE 0 END AS DOUBLE) AS {n}" for n, c in _ENT.items()) + " FROM t")
def features_90(spark, sf):
    out = features.enterprise_90(N.sysmon(raw_sysmon(spark, sf)))
    return out.select("registry_value", *_ENT)


@query("features_90_totals")
def features_90_totals(spark, sf):
    """Sum of each of the 90 features, long form."""
    out = features.enterprise_90(N.sysmon(raw_sysmon(spark, sf)))
    row = out.agg(*[F.sum(c).alias(c) for c in features.ENTERPRISE_NAMES])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("total")) for c in features.ENTERPRISE_NAMES])).alias(
        "x")).select("x.*")


