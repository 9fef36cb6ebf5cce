"""Incidents: session correlation, roll-up, classification, severity, root cause, texts.

Every per-incident figure is a two-step aggregate whose first step is combined map-side, so an incident on a hot host
costs its distinct values, not its events. The event timeline stays a table; nested arrays appear only in the reports,
where the original shows the first few entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ioc import event_indicators_a
from tidewatch.functions.text import (
    any_of, cut, filled, has, has_any, indicator_uid, joined, listed, nz, percent, pin, safe_int)
from tidewatch.operators.matching import IOC_FIELDS, keyword_techniques, stage_texts, text_of
from tidewatch.operators.ordered import gap_sessions, join_grown, session_bucket, top_per_key, with_sessions
from tidewatch.operators.scoring import event_severity
from tidewatch.rules import incident as N
from tidewatch.session import materialise

def incident_id(host: Column, start_us: Column) -> Column:
    """IR-yyyymmdd-<32 hex digits>; the suffix is a digest of host and session start, so reruns give the same id.

    It is kept whole because incidents group and join by it: six digits meet by chance within some thousand sessions a day.
    """
    day = F.date_format(F.timestamp_micros(start_us), "yyyyMMdd")
    tail = F.upper(F.md5(F.concat(host, F.lit("|"), start_us.cast("string"))))
    return F.concat(F.lit("IR-"), day, F.lit("-"), tail)


def correlate(df: DataFrame, host: str = "hostname", ts: str = "event_ts", gap_minutes: int = N.GAP_MINUTES) -> DataFrame:
    """Events with incident_id: same host, no pause longer than the gap."""
    out = with_sessions(df, host, ts, gap_minutes)
    return out.withColumn("incident_id", incident_id(F.col(host), F.col("start_us")))


# ---------------------------------------------------------------- event interpretation
def interpret(staged: bool = False) -> Column:
    """struct<phase, description>: first case that fits, in fixed order."""
    proc, cmd, user, action = nz("process_name"), nz("command_line"), nz("user"), nz("action")
    text, eid = text_of("phase", staged), safe_int("event_id")
    says = lambda phase: has_any(text, N.PHASE_WORDS[phase])
    row = lambda phase, *parts: F.struct(F.lit(phase).alias("phase"), F.concat(
        *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("description"))
    brief = cut(cmd, 80)
    long_label = F.exists(F.split(nz("query_name"), r"\."), lambda p: F.length(p) > 20)
    return (
        F.when(says(N.CREDENTIAL), row(N.CREDENTIAL, "Credential dumping: ", proc, " executed by ", user, F.when(
            cmd != "", F.concat(F.lit(" ["), brief, F.lit("]"))).otherwise("")))
        .when(says(N.EXECUTION), row(N.EXECUTION, "PowerShell execution by ", user, F.when(
            has_any(text, ["-enc", "base64"]), " (encoded command)").otherwise("")))
        .when(says(N.PERSISTENCE), row(N.PERSISTENCE, "Persistence mechanism: ",
                                       F.when(cmd != "", brief).otherwise(action)))
        .when(eid.isin(7045, 4698), row(N.PERSISTENCE, F.when(eid == 7045, "Service installed").otherwise(
            "Scheduled task created"), " by ", user))
        .when(says(N.LATERAL), row(N.LATERAL, "Lateral movement: ", proc, " → remote execution"))
        .when(says(N.EVASION), row(N.EVASION, "Defense evasion: ", proc))
        .when(says(N.C2), row(N.C2, "C2 communication: ", proc))
        .when(says(N.DISCOVERY), row(N.DISCOVERY, "Discovery: ", F.when(cmd != "", brief).otherwise(proc)))
        .when(filled("query_name") & long_label, row(N.EXFIL, "DNS data exfiltration: ", cut(nz("query_name"), 60)))
        .when(eid == 4624, row(N.INITIAL, "Successful logon: ", user, " (type ",
                               F.coalesce(F.col("logon_type").cast("string"), F.lit("?")), ")"))
        .when(eid == 4625, row(N.INITIAL, "Failed logon attempt: ", user))
        .when(eid == 4648, row(N.CREDENTIAL, "Explicit credential use by ", user))
        .when(filled("image_loaded"), row(N.EVASION, "DLL loaded: ", nz("image_loaded")))
        .otherwise(row(N.UNKNOWN, F.when(filled("message"), nz("message")).otherwise(
            F.concat(F.lit("Event "), eid.cast("string"), F.lit(": "), proc)))))


def timeline(df: DataFrame, keep: tuple[str, ...] = ("incident_id", "event_key", "event_ts", "timestamp", "hostname",
                                                      "user", "ml_score")) -> DataFrame:
    """One row per event: phase, description, severity, technique ids and indicators. Scan-stage only."""
    eid = safe_int("event_id")
    kind = F.when(filled("action"), nz("action")).otherwise(F.concat(F.lit("event_"), eid.cast("string")))
    out = stage_texts(df, "kw", "phase", "ioc").withColumns({
        "_i": pin(interpret(True)), "_techniques": pin(keyword_techniques(True)),
        "_iocs": pin(event_indicators_a(IOC_FIELDS, combined=text_of("ioc", True)))})
    return out.select(
        *[c for c in keep if c in df.columns], "event_id", "process_name", "command_line", "logon_type",
        kind.alias("entry_type"), F.col("_i.phase").alias("phase"), F.col("_i.description").alias("description"),
        event_severity(F.coalesce(F.col("ml_score"), F.lit(0.0))).alias("severity"),
        F.col("_techniques").alias("techniques"), F.col("_iocs").alias("iocs"))


# ---------------------------------------------------------------- distinct side tables
def _first_seen(long: DataFrame, sessions: DataFrame | None, what: list[str], first: Column) -> DataFrame:
    """(incident_id, *what, f): the first sighting of each value per incident. With `sessions` (hostname, bucket,
    incident_id) the rows have hostname and bucket, are reduced per bucket first, and only those few rows meet the sessions."""
    if sessions is None:
        return long.groupBy("incident_id", *what).agg(F.min(first).alias("f"))
    few = long.groupBy("hostname", "bucket", *what).agg(F.min(first).alias("f"))
    placed = join_grown(few, sessions, ["hostname", "bucket"])
    return placed.groupBy("incident_id", *what).agg(F.min("f").alias("f"))


def _keys(sessions: DataFrame | None) -> list[str]:
    return ["incident_id"] if sessions is None else ["hostname", "bucket"]


def incident_techniques(tl: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """First sighting of each technique per incident: (incident_id, id, name, tactic, first_ts, first_key)."""
    long = tl.select(*_keys(sessions), "event_ts", "event_key", F.explode("techniques").alias("t")).withColumn("id", F.col("t.id"))
    return _first_seen(long, sessions, ["id"], F.struct(
        "event_ts", "event_key", F.col("t.rule_order").alias("rule_order"), F.col("t.name").alias("name"),
        F.col("t.tactic").alias("tactic"))).select("incident_id", "id", "f.*")


def incident_iocs(tl: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """First sighting of each indicator per incident, with uid, confidence and context."""
    long = tl.select(*_keys(sessions), "event_ts", "event_key", "event_id", "timestamp",
                     F.posexplode("iocs").alias("pos", "i")).withColumns({"type": F.col("i.type"), "value": F.col("i.value")})
    first = _first_seen(long, sessions, ["type", "value"], F.struct("event_ts", "event_key", "pos", "event_id", "timestamp"))
    tool = F.col("type") == "process"
    return first.select(
        "incident_id", "type", "value", indicator_uid(F.col("type"), F.col("value")).alias("uid"),
        F.when(tool, 0.9).otherwise(0.7).alias("confidence"),
        F.when(tool, "Suspicious tool").otherwise(F.concat(F.lit("Found in event "), F.col("f.event_id").cast(
            "string"))).alias("context"),
        F.col("f.timestamp").alias("first_seen"), F.col("f.event_ts").alias("first_ts"),
        F.col("f.event_key").alias("first_key"), F.col("f.pos").alias("pos"))


def ordered_names(df: DataFrame, key: str, value: str, order: list[str], alias: str, limit: int | None = None) -> DataFrame:
    """(key, alias: array) of distinct values in order of first sighting; `df` is already one row per (key, value)."""
    if limit:
        df = top_per_key(df, [key], [F.col(c) for c in order], limit).drop("rn")
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))),
                                           lambda s: s["_v"]).alias(alias))


# ---------------------------------------------------------------- roll-up
def _phase_flag(phase: str) -> Column:
    return F.max(F.col("phase") == phase)


PHASE_FLAGS = {"p_cred": N.CREDENTIAL, "p_exec": N.EXECUTION, "p_pers": N.PERSISTENCE, "p_lat": N.LATERAL,
               "p_evas": N.EVASION, "p_c2": N.C2, "p_disc": N.DISCOVERY, "p_exfil": N.EXFIL, "p_init": N.INITIAL}


def roll_up(tl: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row per incident with every figure and text of the rule-based investigation.

    `tl` has incident_id; or, with `sessions` (hostname, bucket, incident_id), it has bucket, and every figure is reduced per
    host and half hour before it meets the sessions: no event row is joined.
    """
    first = F.struct("event_ts", "event_key", "phase", "entry_type", "event_id", "logon_type", "process_name",
                     "description")
    sums, lows, highs = ["event_count", "severe_events", "ml_sum", "ml_n"], ["created_at", "host", "first"], ["updated_at", *PHASE_FLAGS]
    part = tl.withColumn("host", F.col("hostname")).groupBy(*_keys(sessions)).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("event_ts").alias("created_at"),
        F.max("event_ts").alias("updated_at"), F.min("host").alias("host"), F.sum("ml_score").alias("ml_sum"),
        F.count("ml_score").alias("ml_n"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe_events"),
        F.min(first).alias("first"), *[_phase_flag(p).alias(n) for n, p in PHASE_FLAGS.items()])
    if sessions is not None:
        part = join_grown(part, sessions, ["hostname", "bucket"]).groupBy("incident_id").agg(
            *[f(c).alias(c) for f, cs in ((F.sum, sums), (F.min, lows), (F.max, highs)) for c in cs])
    base = part.withColumn("avg_ml", F.try_divide("ml_sum", "ml_n")).drop("ml_sum", "ml_n")
    seen = F.struct("event_ts", "event_key")
    first_of = lambda c: _first_seen(tl.where(filled(c)).withColumn("_v", F.col(c)), sessions, ["_v"], seen).select(
        "incident_id", F.col("_v").alias(c), F.col("f").alias("s"))
    sides = [ordered_names(first_of("user"), "incident_id", "user", ["s"], "affected_users")]
    if sessions is None:
        sides.append(ordered_names(first_of("hostname"), "incident_id", "hostname", ["s"], "affected_hosts"))
    else:  # sessions are per host, so an incident has the one it is grouped by
        base = base.withColumn("affected_hosts", F.when(filled("host"), F.array("host")))
    techs = incident_techniques(tl, sessions)
    iocs = incident_iocs(tl, sessions)
    ioc_n = iocs.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_iocs"))
    ips = ordered_names(iocs.where(F.col("type") == "ip"), "incident_id", "value", ["first_ts", "first_key", "pos"],
                        "first_ips", limit=5)
    tech_names = techs.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("event_ts", "event_key", "rule_order", "id", "name", "tactic"))).alias(
            "techniques"))
    out = base
    for side in (*sides, tech_names, ioc_n, ips):
        out = join_grown(out, side, "incident_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({
        "affected_hosts": F.coalesce("affected_hosts", empty), "affected_users": F.coalesce("affected_users", empty),
        "first_ips": F.coalesce("first_ips", empty), "n_iocs": F.coalesce("n_iocs", F.lit(0)),
        "n_techniques": F.coalesce(F.size("techniques"), F.lit(0)),
        "technique_ids": F.coalesce(F.transform("techniques", lambda t: t["id"]), empty),
        "technique_names": F.coalesce(F.transform("techniques", lambda t: t["name"]), empty)})
    out = out.withColumn("n_techniques", F.size("technique_ids"))
    return _texts(_severity(_classify(out)))


def _classify(df: DataFrame) -> DataFrame:
    c = F.col
    brute = F.exists("technique_ids", lambda t: F.startswith(t, F.lit("T1110")))
    label = (F.when(c("p_cred") & c("p_lat"), "Credential theft with lateral movement")
             .when(c("p_cred"), "Credential access / dumping attempt").when(c("p_exfil"), "Data exfiltration detected")
             .when(c("p_c2"), "Command & Control communication")
             .when(c("p_pers") & c("p_exec"), "Malware execution with persistence")
             .when(c("p_pers"), "Persistence mechanism established")
             .when(c("p_exec") & c("p_evas"), "Evasive code execution").when(c("p_exec"), "Suspicious code execution")
             .when(brute, "Brute force / credential stuffing").otherwise("Suspicious activity detected"))
    return df.withColumn("classification", label)


def _severity(df: DataFrame) -> DataFrame:
    c = F.col
    n_phases = sum((c(f).cast("int") for f in PHASE_FLAGS), F.lit(0))
    critical = any_of(c(f) for f, p in PHASE_FLAGS.items() if p in N.CRITICAL_PHASES)
    score = (F.when(c("event_count") >= 10, 0.15).when(c("event_count") >= 5, 0.1).otherwise(0.0)
             + F.when(n_phases >= 4, 0.25).when(n_phases >= 2, 0.15).otherwise(0.0)
             + F.when(critical, 0.2).otherwise(0.0)
             + F.when(c("n_techniques") >= 5, 0.15).when(c("n_techniques") >= 3, 0.1).otherwise(0.0)
             + F.when(c("n_iocs") >= 5, 0.1).otherwise(0.0) + c("avg_ml") * 0.15
             + F.when(F.size("affected_hosts") > 1, 0.15).otherwise(0.0))
    out = df.withColumns({"n_phases": n_phases, "confidence": F.least(score, F.lit(1.0))})
    return out.withColumn("severity", event_severity(F.col("confidence")))


def _texts(df: DataFrame) -> DataFrame:
    c = F.col
    f = lambda n: F.col(f"first.{n}")
    proc = F.lower(nz(f("process_name")))
    logon = f("logon_type").cast("string")
    eid = nz(f("event_id"))
    starts = lambda phase: f("phase") == phase
    failed = has(f("entry_type"), "logon_failure") | has(eid, "4625")
    opened = starts(N.INITIAL) & ~failed & has(eid, "4624")
    causes = listed(
        (starts(N.INITIAL) & failed, "Brute force login attempt detected as initial vector"),
        (opened & (logon == "10"), "Unauthorized RDP access as initial entry point"),
        (opened & (logon == "3"), "Network logon suggesting lateral movement from another host"),
        (opened & ~logon.isin("3", "10"), "Suspicious authentication as initial access"),
        (starts(N.EXECUTION) & has(proc, "powershell"),
         "PowerShell-based attack, likely delivered via phishing or exploit"),
        (starts(N.EXECUTION) & ~has(proc, "powershell") & has(proc, "python"),
         "Script-based attack using Python runtime"),
        (starts(N.EXECUTION) & ~has_any(proc, ["powershell", "python"]) & has(proc, "mshta"),
         "HTML Application abuse, likely from malicious link/document"),
        (starts(N.EXECUTION) & ~has_any(proc, ["powershell", "python", "mshta"]),
         F.concat(F.lit("Suspicious execution of "), nz(f("process_name")))),
        (c("p_exec") & c("p_pers"), "Attacker established persistence after initial execution"),
        (c("p_cred"), "Credential harvesting indicates intent for privilege escalation or lateral movement"))
    fallback = F.concat(F.lit("Initial suspicious activity detected: "), cut(f("description"), 100))
    root = F.concat(F.when(F.size(causes) > 0, joined(causes, ". ")).otherwise(fallback), F.lit("."))
    n_hosts = F.size("affected_hosts").cast("string")
    privileged = F.filter("affected_users", lambda u: has_any(F.upper(u), N.PRIVILEGED_MARKS))
    impacts = listed(
        (c("p_cred"), "Credentials may be compromised - password reset required"),
        (c("p_lat"), F.concat(F.lit("Lateral movement to "), n_hosts, F.lit(" hosts detected"))),
        (c("p_exfil"), "Data exfiltration suspected - data loss assessment needed"),
        (c("p_pers"), "Persistence established - host may remain compromised after reboot"),
        (c("p_c2"), "Active C2 channel - attacker may have ongoing access"),
        (F.size(privileged) > 0, F.concat(F.lit("Privileged accounts involved: "), joined(privileged))))
    impact = F.when(F.size(impacts) > 0, joined(impacts, " | ")).otherwise(
        "Limited impact detected. Further monitoring recommended.")
    yes = F.lit(True)
    recs = listed(
        (yes, "Isolate affected host(s) from network"),
        (c("p_cred"), "Reset all credentials for affected users"),
        (c("p_cred"), "Force password change for all accounts on affected hosts"),
        (c("p_cred"), "Review Active Directory for unauthorized changes"),
        (c("p_pers"), "Remove all identified persistence mechanisms (scheduled tasks, services, registry keys)"),
        (c("p_pers"), "Perform full malware scan on affected hosts"),
        (c("p_lat"), "Scan all hosts in the network segment for compromise indicators"),
        (c("p_lat"), "Review network segmentation policies"),
        (c("p_c2"), "Block identified C2 IP addresses and domains at firewall"),
        (c("p_c2"), "Review proxy logs for additional C2 indicators"),
        (c("p_exfil"), "Assess scope of data exposure"),
        (c("p_exfil"), "Review DNS and proxy logs for data exfiltration indicators"),
        (c("p_exfil"), "Notify data protection officer if PII involved"),
        (F.size("first_ips") > 0, F.concat(F.lit("Block external IPs: "), joined(c("first_ips")))),
        (yes, "Preserve evidence and forensic artifacts"),
        (yes, "Document incident timeline for post-incident review"))
    phases = F.array_sort(listed(*[(c(k), p) for k, p in PHASE_FLAGS.items()]))
    findings = listed(
        (yes, F.concat(F.lit("Incident involves "), c("event_count").cast("string"),
                       F.lit(" security events across "), n_hosts, F.lit(" host(s)"))),
        (c("n_techniques") > 0, F.concat(F.lit("MITRE ATT&CK techniques identified: "),
                                         joined(F.slice("technique_names", 1, 5)))),
        (F.size(phases) > 0, F.concat(F.lit("Attack phases observed: "), joined(phases))),
        (c("n_iocs") > 0, F.concat(c("n_iocs").cast("string"),
                                   F.lit(" unique Indicators of Compromise extracted"))),
        (c("severe_events") > 0, F.concat(c("severe_events").cast("string"),
                                          F.lit(" critical/high severity events detected"))))
    return df.withColumns({"root_cause": root, "impact_assessment": impact, "recommendations": recs,
                           "key_findings": findings, "phases": phases})


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in N.SEVERITY_RANK.items() for x in kv])[severity]


def incident_list(incidents: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first."""
    out = incidents.select(F.col("incident_id").alias("id"), "host", "severity", "classification", "event_count",
                           F.lit("investigating").alias("status"), "created_at").orderBy(F.desc("created_at"), "id")
    return out.limit(limit) if limit else out


def phase_events(tl: DataFrame, phase: str, limit: int = 20) -> DataFrame:
    """Events of an incident in a phase (substring), oldest first, at most 50 per incident; no match stays empty."""
    hit = tl.where(has(F.lower("phase"), phase.strip().lower()))
    return top_per_key(hit, ["incident_id"], [F.col("event_ts"), F.col("event_key")], min(limit, 50))


# ---------------------------------------------------------------- reports
def top_entries(tl: DataFrame, n: int | None = 20) -> DataFrame:
    """First n timeline entries per incident as an array of structs; all of them without n."""
    order = [F.col("timestamp"), F.col("event_key")]
    first = top_per_key(tl, ["incident_id"], order, n) if n else tl.withColumn("rn", F.struct(*order))
    return first.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(
        "rn", "timestamp", "phase", "description", "severity",
        F.transform("techniques", lambda t: t["id"]).alias("technique_ids"),
        F.transform("iocs", lambda i: F.concat_ws(":", i["type"], i["value"])).alias("ioc_texts")))).alias("entries"))


def top_iocs(iocs: DataFrame, per_type: int | None, n: int | None) -> DataFrame:
    order = [F.col("first_ts"), F.col("first_key"), F.col("pos")]
    kept = top_per_key(iocs, ["incident_id", "type"], order, per_type) if per_type else top_per_key(
        iocs, ["incident_id"], order, n)
    return kept.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(
        "first_ts", "first_key", "pos", "type", "value", "context"))).alias("ioc_rows"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _with_report_inputs(incidents: DataFrame, tl: DataFrame, entries: int | None, iocs_per_type: int | None,
                        iocs_total: int | None) -> DataFrame:
    return join_grown(join_grown(incidents, top_entries(tl, entries), "incident_id", "left"),
                      top_iocs(incident_iocs(tl), iocs_per_type, iocs_total), "incident_id", "left")


def report_text(incidents: DataFrame, tl: DataFrame) -> DataFrame:
    """(incident_id, report): full investigation report with every timeline entry. A report is one row, so it has to fit in
    a task; the timeline table has the same entries as rows."""
    df = _with_report_inputs(incidents, tl, None, 10, None)
    rule, dash = "=" * 70, "-" * 70
    lit = F.lit
    icon = F.create_map(*[lit(x) for kv in N.SEVERITY_ICON.items() for x in kv])
    entry = lambda e: F.concat_ws(
        "\n", F.concat(lit("  "), e["timestamp"], lit("  "), icon[e["severity"]], lit(" ["), e["phase"], lit("]")),
        F.concat(lit("    "), e["description"]),
        F.when(F.size(e["technique_ids"]) > 0, F.concat(lit("    MITRE: "), joined(e["technique_ids"]))),
        F.when(F.size(e["ioc_texts"]) > 0, F.concat(lit("    IoCs: "), joined(F.slice(e["ioc_texts"], 1, 3)))), lit(""))
    kinds = F.array_distinct(F.transform("ioc_rows", lambda r: r["type"]))
    by_kind = F.transform(kinds, lambda k: F.concat_ws(
        "\n", F.concat(lit("  ["), F.upper(k), lit("]")), F.array_join(F.transform(
            F.filter("ioc_rows", lambda r: r["type"] == k),
            lambda r: F.concat(lit("    - "), r["value"], lit(" ("), r["context"], lit(")"))), "\n")))
    tech = F.transform("techniques", lambda t: F.concat_ws("\n", F.concat(lit("  "), t["id"], lit(" - "), t["name"]),
                                                           F.concat(lit("    Tactic: "), t["tactic"])))
    recs = F.transform("recommendations", lambda r, i: F.concat(lit("  "), (i + 1).cast("string"), lit(". "), r))
    block = lambda title: F.concat_ws("\n", lit(dash), lit(title), lit(dash))
    field = lambda label, c: F.concat(lit(label), c)
    text = _lines(
        lit(rule), lit("INCIDENT INVESTIGATION REPORT"), lit(rule), field("Incident ID:     ", F.col("incident_id")),
        field("Host:            ", F.col("host")), field("Severity:        ", F.upper("severity")),
        field("Confidence:      ", percent(F.col("confidence"))), lit("Status:          investigating"),
        field("Classification:  ", F.col("classification")), field("Created:         ", F.col("created_at").cast("string")),
        lit(""), block("CLASSIFICATION"), F.col("classification"), lit(""), block("ATTACK TIMELINE"),
        F.array_join(F.transform("entries", entry), "\n"),
        F.when(F.col("n_iocs") > 0, _lines(block("INDICATORS OF COMPROMISE (IoCs)"), F.array_join(by_kind, "\n"),
                                           lit(""))),
        F.when(F.col("n_techniques") > 0, _lines(block("MITRE ATT&CK MAPPING"), F.array_join(tech, "\n"), lit(""))),
        block("ROOT CAUSE ANALYSIS"), field("  ", F.col("root_cause")), lit(""), block("IMPACT ASSESSMENT"),
        field("  ", F.col("impact_assessment")), field("  Affected hosts: ", joined(F.col("affected_hosts"))),
        field("  Affected users: ", joined(F.col("affected_users"))), lit(""), block("RECOMMENDED RESPONSE"),
        F.array_join(recs, "\n"), lit(""), lit(rule))
    return df.select("incident_id", text.alias("report"))


def read_view(incidents: DataFrame, tl: DataFrame) -> DataFrame:
    """(incident_id, view): the short view, 20 timeline rows, 15 indicators, 5 recommendations, cut at 3,500."""
    df = _with_report_inputs(incidents, tl, 20, None, 15)
    lit = F.lit
    entry = lambda e: F.concat_ws(
        "\n", F.concat(lit("  ["), e["phase"], lit("] "), cut(e["timestamp"], 19), lit(" — "),
                       cut(e["description"], 120)),
        F.when(F.size(e["technique_ids"]) > 0, F.concat(lit("    MITRE: "), joined(e["technique_ids"]))),
        F.when(F.size(e["ioc_texts"]) > 0, F.concat(lit("    IoCs: "), joined(F.slice(e["ioc_texts"], 1, 3)))))
    count = lambda c: F.col(c).cast("string")
    text = _lines(
        F.concat(lit("INCIDENT: "), F.col("incident_id")), F.concat(lit("Host: "), F.col("host")),
        F.concat(lit("Severity: "), F.upper("severity")), F.concat(lit("Confidence: "), percent(F.col("confidence"))),
        F.concat(lit("Classification: "), F.col("classification")), lit("Status: investigating"),
        F.concat(lit("Total Events: "), count("event_count")),
        F.concat(lit("Affected Hosts: "), joined(F.col("affected_hosts"))),
        F.concat(lit("Affected Users: "), joined(F.col("affected_users"))), lit(""),
        F.concat(lit("ATTACK TIMELINE ("), count("event_count"), lit(" entries):")),
        F.array_join(F.transform("entries", entry), "\n"), lit(""),
        F.when(F.col("n_iocs") > 0, _lines(
            F.concat(lit("INDICATORS OF COMPROMISE ("), count("n_iocs"), lit(" total):")),
            F.array_join(F.transform("ioc_rows", lambda r: F.concat(lit("  "), r["type"], lit(": "), r["value"],
                                                                    lit(" — "), r["context"])), "\n"), lit(""))),
        F.when(F.col("n_techniques") > 0, _lines(
            F.concat(lit("MITRE ATT&CK TECHNIQUES ("), count("n_techniques"), lit(" identified):")),
            _technique_lines(), lit(""))),
        lit("KEY FINDINGS:"), F.array_join(F.transform("key_findings", lambda k: F.concat(lit("  • "), k)), "\n"),
        lit(""), F.concat(lit("ROOT CAUSE: "), F.col("root_cause")),
        F.concat(lit("IMPACT: "), F.col("impact_assessment")), lit("RECOMMENDATIONS:"),
        F.array_join(F.transform(F.slice("recommendations", 1, 5), lambda r: F.concat(lit("  • "), r)), "\n"))
    return df.select("incident_id", cut(text, 3500).alias("view"))


def _technique_lines() -> Column:
    lit = F.lit
    return F.array_join(F.transform("techniques", lambda t: F.concat(
        lit("  "), t["id"], lit(" — "), t["name"], lit(" ["), t["tactic"], lit("]"))), "\n")


def context_text(incidents: DataFrame, tl: DataFrame) -> DataFrame:
    """(incident_id, context): what an analyst gets to see, with the best-scored event's score and reason."""
    best = tl.groupBy("incident_id").agg(F.max("ml_score").alias("best_score"))
    df = join_grown(_with_report_inputs(incidents, tl, 20, None, 10), best, "incident_id")
    lit = F.lit
    count = lambda c: F.col(c).cast("string")
    entry = lambda e: F.concat_ws(
        "\n", F.concat(lit("  ["), e["phase"], lit("] "), cut(e["timestamp"], 19), lit(" — "),
                       cut(e["description"], 100)),
        F.when(F.size(e["technique_ids"]) > 0, F.concat(lit("    MITRE: "), joined(e["technique_ids"]))))
    text = _lines(
        lit("=" * 60), lit("SECURITY INCIDENT INVESTIGATION"), lit("=" * 60),
        F.concat(lit("Incident ID   : "), F.col("incident_id")), F.concat(lit("Host          : "), F.col("host")),
        F.concat(lit("Events        : "), count("event_count"), lit(" correlated log entries")),
        F.concat(lit("ML Detection  : "), percent(F.col("best_score")), lit(" confidence")),
        F.concat(lit("Affected Hosts: "), joined(F.col("affected_hosts"))),
        F.concat(lit("Affected Users: "), joined(F.col("affected_users"))), lit(""),
        F.concat(lit("ATTACK TIMELINE ("), count("event_count"), lit(" events):")),
        F.array_join(F.transform("entries", entry), "\n"), lit(""),
        F.when(F.col("n_iocs") > 0, _lines(
            F.concat(lit("INDICATORS OF COMPROMISE ("), count("n_iocs"), lit(" found):")),
            F.array_join(F.transform("ioc_rows", lambda r: F.concat(lit("  "), r["type"], lit(": "), r["value"])),
                         "\n"), lit(""))),
        F.when(F.col("n_techniques") > 0, _lines(
            F.concat(lit("MITRE ATT&CK TECHNIQUES ("), count("n_techniques"), lit(" identified):")),
            _technique_lines(), lit(""))),
        F.concat(lit("PRELIMINARY CLASSIFICATION: "), F.col("classification")),
        F.concat(lit("PRELIMINARY ROOT CAUSE: "), F.col("root_cause")))
    return df.select("incident_id", text.alias("context"))




# ---------------------------------------------------------------- whole investigation
def investigate(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents, timeline) of scored events.

    The row stage (texts, regexes, rules) is computed once and written to the checkpoint folder. Each roll-up branch reads its
    own columns of that table and reduces them per host and half hour; all rows of such a bucket share a session, so the small
    bucket table tells the incident. The timeline joins it row by row, for whoever reads entries.
    """
    rows = materialise(timeline(scored).withColumn("bucket", session_bucket("event_ts", N.GAP_MINUTES)))
    sessions = materialise(gap_sessions(rows, "hostname", "event_ts", N.GAP_MINUTES).select(
        "hostname", "bucket", incident_id(F.col("hostname"), F.col("start_us")).alias("incident_id")))
    return roll_up(rows, sessions), join_grown(rows, sessions, ["hostname", "bucket"]).drop("bucket")
