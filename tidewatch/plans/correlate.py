"""Queries on incidents: sessions, timelines, side tables, roll-ups, reports, the second investigator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.functions import ioc
from tidewatch.functions.text import nz, pin
from tidewatch.operators import features, incidents, matching, quality, scoring
from tidewatch.operators.ordered import join_grown, top_per_key
from tidewatch.plans.detect import (
    _CLASSIFIED, _CRITCMD, EXTENDED_HITS, KEYWORD_HITS, MERGED, PATTERN_HITS, ROUTED, any_word, b, big, card_catalogue, events, lit, r, r6,
    scored, se)
from tidewatch.rules import attack as A
from tidewatch.rules import incident as N
from tidewatch.rules import intel as I
from tidewatch.session import materialise

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def sessions_sql(src: str) -> str:
    return (f"sg AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY hostname ORDER BY event_ts, event_key) "
            f"<= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opened FROM {src}), sn AS (SELECT *, sum(opened) OVER (PARTITION BY "
            "hostname ORDER BY event_ts, event_key ROWS UNBOUNDED PRECEDING) AS session_no FROM sg), ss AS (SELECT *, "
            "epoch_us(min(event_ts) OVER (PARTITION BY hostname, session_no)) AS start_us FROM sn), ii AS (SELECT *, "
            "concat('IR-', strftime(make_timestamp(start_us), '%Y%m%d'), '-', upper(md5(concat(hostname, '|', "
            "CAST(start_us AS STRING))))) AS incident_id FROM ss)")


@query("session_correlation", f"WITH {se('event_key', 'event_ts', 'hostname')}, {sessions_sql('se')} SELECT event_key, "
       f"incident_id, {big('session_no')} AS session_no FROM ii")
def session_correlation(spark, sf):
    return incidents.correlate(events(spark, sf, "event_key", "event_ts", "hostname")).select(
        "event_key", "incident_id", b("session_no").alias("session_no"))


@query("session_sizes", f"WITH {se('event_key', 'event_ts', 'hostname')}, {sessions_sql('se')} SELECT hostname, incident_id, "
       "count(*) AS events, epoch_us(min(event_ts)) AS first_us, epoch_us(max(event_ts)) AS last_us FROM ii GROUP BY ALL")
def session_sizes(spark, sf):
    """Incident sizes straight from the half-hour buckets: the event rows are never joined or sorted."""
    from tidewatch.operators.ordered import gap_sessions

    s = gap_sessions(events(spark, sf, "event_key", "event_ts", "hostname"), "hostname", "event_ts")
    return s.groupBy("hostname", "start_us").agg(
        F.sum("n").alias("events"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")).select(
        "hostname", incidents.incident_id(F.col("hostname"), F.col("start_us")).alias("incident_id"), "events",
        "first_us", "last_us")


# ---------------------------------------------------------------- timeline
_TXT = "lower(concat_ws(' ', process_name, command_line, action))"
_PHASE = ("CASE " + " ".join(f"WHEN {any_word(_TXT, N.PHASE_WORDS[p])} THEN {lit(p)}" for p in (N.CREDENTIAL, N.EXECUTION)) +
          f" WHEN {any_word(_TXT, N.PHASE_WORDS[N.PERSISTENCE])} OR event_id IN (7045, 4698) THEN {lit(N.PERSISTENCE)} " +
          " ".join(f"WHEN {any_word(_TXT, N.PHASE_WORDS[p])} THEN {lit(p)}" for p in (N.LATERAL, N.EVASION, N.C2, N.DISCOVERY)) +
          f" WHEN query_name <> '' AND len(list_filter(string_split(query_name, '.'), lambda p: length(p) > 20)) > 0 THEN "
          f"{lit(N.EXFIL)} WHEN event_id IN (4624, 4625) THEN {lit(N.INITIAL)} WHEN event_id = 4648 THEN {lit(N.CREDENTIAL)} "
          f"WHEN image_loaded <> '' THEN {lit(N.EVASION)} ELSE {lit(N.UNKNOWN)} END")


@query("event_phases", f"WITH {se()} SELECT event_key, {_PHASE} AS phase FROM se")
def event_phases(spark, sf):
    return events(spark, sf).select("event_key", incidents.interpret()["phase"].alias("phase"))


@query("phase_descriptions", f"WITH {se()}, p AS (SELECT {_PHASE} AS phase, event_id, process_name, command_line, \"user\" AS u "
       "FROM se) SELECT phase, CASE phase WHEN 'Credential Access' THEN 'Credential dumping' WHEN 'Execution' THEN "
       "'PowerShell execution by' WHEN 'Lateral Movement' THEN 'Lateral movement' WHEN 'Discovery' THEN 'Discovery' ELSE "
       "'other' END AS opening, count(*) AS n FROM p WHERE NOT (phase = 'Credential Access' AND event_id = 4648 AND NOT "
       f"{any_word('lower(concat(process_name, command_line))', N.PHASE_WORDS[N.CREDENTIAL])}) GROUP BY ALL")
def phase_descriptions(spark, sf):
    t = events(spark, sf).select(incidents.interpret().alias("i")).select("i.*")
    d = F.col("description")
    opening = F
    for o in ("Credential dumping", "PowerShell execution by", "Lateral movement", "Discovery"):
        opening = opening.when(F.startswith(d, F.lit(o)), o)
    return (t.where(~F.startswith(d, F.lit("Explicit credential"))).groupBy("phase", opening.otherwise("other").alias(
        "opening")).agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- indicators of events
_COMB = ("concat_ws(' ', nullif(command_line, ''), nullif(script_block_text, ''), nullif(message, ''), nullif(service_file, "
         "''), nullif(source_ip, ''), nullif(destination_ip, ''), nullif(query_name, ''), nullif(image_loaded, ''))")
_PRIV = "(" + " OR ".join(f"starts_with(v, {lit(p)})" for p in (
    "10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3", "127.", "0.0.", "169.254.")) + ")"


def ioc_a_sql(src: str, key: str, text: str) -> str:
    parts = [f"SELECT {key}, {lit(k)} AS type, trim(unnest(regexp_extract_all({text}, {lit(p)}))) AS v FROM {src}"
             for k, p in I.IOC_PATTERNS_A.items()]
    return ("ia0 AS (" + " UNION ALL ".join(parts) + f"), ia AS (SELECT {key}, type, v AS value FROM ia0 WHERE v <> '' AND NOT "
            f"(type = 'ip' AND {_PRIV}) AND NOT (type = 'domain' AND v IN ('localhost', 'example.com')))")


_TOOL = any_word("lower(process_name)", I.TOOL_PROCESSES)
_IOCS = (ioc_a_sql("cb", "event_key", "txt").replace("ia0 AS (", f"cb AS (SELECT event_key, {_COMB} AS txt FROM se), ia0 AS (")
         + f", ei AS (SELECT * FROM ia UNION ALL SELECT event_key, 'process', process_name FROM se WHERE {_TOOL})")


@query("event_indicators", f"WITH {se()}, {_IOCS} SELECT event_key, type, value, count(*) AS n FROM ei GROUP BY ALL")
def event_indicators(spark, sf):
    ev = matching.stage_texts(events(spark, sf), "ioc")
    rows = ev.select("event_key", F.explode(ioc.event_indicators_a(incidents.IOC_FIELDS, combined=matching.text_of(
        "ioc", True))).alias("i"))
    return rows.groupBy("event_key", F.col("i.type").alias("type"), F.col("i.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- incidents over malicious events
_MAL = f"{ROUTED}, ml AS (SELECT * FROM ro WHERE classification = 'malicious'), {sessions_sql('ml')}, kset AS (SELECT 1)"
_FULL = (f"{_MAL}, {KEYWORD_HITS}, {_IOCS}, ph0 AS (SELECT *, {_PHASE} AS phase FROM ii), "
         "agg AS (SELECT incident_id, min(hostname) AS host, count(*) AS event_count, avg(ml_score) AS avg_ml, "
         "count(DISTINCT CASE WHEN phase <> 'Unknown' THEN phase END) AS n_phases, "
         + ", ".join(f"bool_or(phase = {lit(p)}) AS {n}" for n, p in incidents.PHASE_FLAGS.items()) +
         ", count(CASE WHEN ml_score >= 0.6 THEN 1 END) AS severe_events FROM ph0 GROUP BY 1), "
         "tn AS (SELECT incident_id, count(DISTINCT id) AS n_techniques, bool_or(starts_with(id, 'T1110')) AS brute FROM ii "
         "JOIN kh USING (event_key) GROUP BY 1), inn AS (SELECT incident_id, count(DISTINCT concat(ei.type, ':', ei.value)) AS "
         "n_iocs FROM ii JOIN ei USING (event_key) GROUP BY 1), "
         "us AS (SELECT incident_id, count(DISTINCT \"user\") AS n_users FROM ii GROUP BY 1), "
         "r0 AS (SELECT agg.*, coalesce(n_techniques, 0) AS n_techniques, coalesce(brute, false) AS brute, coalesce(n_iocs, 0) "
         "AS n_iocs, n_users FROM agg LEFT JOIN tn USING (incident_id) LEFT JOIN inn USING (incident_id) LEFT JOIN us USING "
         "(incident_id)), r1 AS (SELECT *, CASE WHEN p_cred AND p_lat THEN 'Credential theft with lateral movement' WHEN "
         "p_cred THEN 'Credential access / dumping attempt' WHEN p_exfil THEN 'Data exfiltration detected' WHEN p_c2 THEN "
         "'Command & Control communication' WHEN p_pers AND p_exec THEN 'Malware execution with persistence' WHEN p_pers THEN "
         "'Persistence mechanism established' WHEN p_exec AND p_evas THEN 'Evasive code execution' WHEN p_exec THEN "
         "'Suspicious code execution' WHEN brute THEN 'Brute force / credential stuffing' ELSE 'Suspicious activity detected' "
         "END AS classification, least(1.0, CASE WHEN event_count >= 10 THEN 0.15 WHEN event_count >= 5 THEN 0.1 ELSE 0 END + "
         "CASE WHEN n_phases >= 4 THEN 0.25 WHEN n_phases >= 2 THEN 0.15 ELSE 0 END + CASE WHEN p_cred OR p_exfil OR p_lat OR "
         "p_c2 THEN 0.2 ELSE 0 END + CASE WHEN n_techniques >= 5 THEN 0.15 WHEN n_techniques >= 3 THEN 0.1 ELSE 0 END + CASE "
         "WHEN n_iocs >= 5 THEN 0.1 ELSE 0 END + avg_ml * 0.15) AS confidence FROM r0), r2 AS (SELECT *, CASE WHEN "
         "round(confidence, 9) >= 0.8 THEN 'critical' WHEN round(confidence, 9) >= 0.6 THEN 'high' WHEN round(confidence, 9) "
         ">= 0.4 THEN 'medium' WHEN round(confidence, 9) >= 0.2 THEN 'low' ELSE 'info' END AS severity FROM r1)")


def investigated(spark, sf):
    return incidents.investigate(scored(spark, sf).where(F.col("classification") == "malicious"))


@query("incident_rollup", f"WITH {_FULL} SELECT incident_id, host, {big('event_count')} AS event_count, {big('n_phases')} AS "
       f"n_phases, {big('n_techniques')} AS n_techniques, {big('n_iocs')} AS n_iocs, {big('n_users')} AS n_users, "
       f"{big('severe_events')} AS severe_events, classification, {r6('confidence')} AS confidence, severity FROM r2")
def incident_rollup(spark, sf):
    inc, _ = investigated(spark, sf)
    return inc.select("incident_id", "host", b("event_count").alias("event_count"), b("n_phases").alias("n_phases"),
                      b("n_techniques").alias("n_techniques"), b("n_iocs").alias("n_iocs"),
                      b(F.size("affected_users")).alias("n_users"), b("severe_events").alias("severe_events"),
                      "classification", r("confidence").alias("confidence"), "severity")


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("open_incidents", f"WITH {_FULL} SELECT host, count(*) AS incidents, CAST(sum(event_count) AS BIGINT) AS events, max({_RANK}) AS "
       "worst, CAST(max(n_techniques) AS BIGINT) AS max_techniques FROM r2 GROUP BY 1 ORDER BY worst DESC, events DESC, host")
def open_incidents(spark, sf):
    inc, _ = investigated(spark, sf)
    return (inc.groupBy("host").agg(F.count(F.lit(1)).alias("incidents"), F.sum("event_count").alias("events"),
                                    F.max(incidents.severity_rank(F.col("severity"))).alias("worst"),
                                    F.max("n_techniques").cast("bigint").alias("max_techniques"))
            .orderBy(F.desc("worst"), F.desc("events"), "host"))


_FIRST = ("f1 AS (SELECT incident_id, arg_min(struct_pack(ph := phase, k := event_key, eid := event_id, lt := logon_type, pr := "
          "process_name, act := action), struct_pack(a := event_ts, b := event_key)) AS f FROM ph0 GROUP BY 1)")


@query("incident_impact", f"WITH {_FULL} SELECT incident_id, concat_ws(' | ', CASE WHEN p_cred THEN 'Credentials may be "
       "compromised - password reset required' END, CASE WHEN p_lat THEN 'Lateral movement to 1 hosts detected' END, CASE WHEN "
       "p_exfil THEN 'Data exfiltration suspected - data loss assessment needed' END, CASE WHEN p_pers THEN 'Persistence "
       "established - host may remain compromised after reboot' END, CASE WHEN p_c2 THEN 'Active C2 channel - attacker may have "
       "ongoing access' END) AS phase_impact, 3 + 3 * CAST(p_cred AS BIGINT) + 2 * CAST(p_pers AS BIGINT) + 2 * CAST(p_lat AS "
       "BIGINT) + 2 * CAST(p_c2 AS BIGINT) + 3 * CAST(p_exfil AS BIGINT) + CAST(incident_id IN (SELECT incident_id FROM ii JOIN "
       "ei USING (event_key) WHERE type = 'ip') AS BIGINT) AS n_recommendations FROM r2")
def incident_impact(spark, sf):
    inc, _ = investigated(spark, sf)
    text = F.regexp_replace("impact_assessment", r"( \| )?Privileged accounts involved: .*$", "")
    text = F.when(text == "Limited impact detected. Further monitoring recommended.", "").otherwise(text)
    return inc.select("incident_id", text.alias("phase_impact"), b(F.size("recommendations")).alias("n_recommendations"))


@query("incident_root_cause", f"WITH {_FULL}, {_FIRST}, rc AS (SELECT incident_id, f.ph AS ph, f.eid AS eid, f.lt AS lt, f.pr AS pr, "
       "f.act AS act, p_cred, p_exec, p_pers FROM r2 JOIN f1 USING (incident_id)) SELECT incident_id, ph AS first_phase, "
       "CAST(CASE WHEN ph = 'Initial Access' AND (act = 'logon_failure' OR eid IN (4624, 4625)) THEN 1 ELSE 0 END + CASE WHEN "
       "ph = 'Execution' THEN 1 ELSE 0 END + CASE WHEN p_exec AND p_pers THEN 1 ELSE 0 END + CASE WHEN p_cred THEN 1 ELSE 0 END "
       "AS BIGINT) AS n_causes FROM rc")
def incident_root_cause(spark, sf):
    inc, _ = investigated(spark, sf)
    c = F.col("root_cause")
    n = F.when(F.startswith(c, F.lit("Initial suspicious activity detected")), 0).otherwise(F.size(F.split(
        F.regexp_replace(F.regexp_replace(c, r"\.$", ""), r"\.exe", ""), r"\. ")))
    return inc.select("incident_id", F.col("first.phase").alias("first_phase"), b(n).alias("n_causes"))


@query("incident_techniques", f"WITH {_MAL}, {KEYWORD_HITS} SELECT incident_id, id, count(*) AS sightings FROM ii JOIN kh USING "
       "(event_key) GROUP BY ALL")
def incident_techniques(spark, sf):
    rows = materialise(scored(spark, sf).where(F.col("classification") == "malicious").select(
        "event_key", "event_ts", "hostname", F.transform(matching.keyword_techniques(), lambda t: t["id"]).alias("ids")))
    return incidents.correlate(rows).select("incident_id", F.explode("ids").alias("id")).groupBy("incident_id", "id").agg(
        F.count(F.lit(1)).alias("sightings"))


@query("incident_indicators", f"WITH {_FULL} SELECT incident_id, ei.type, ei.value, substring(md5(concat(ei.type, ':', ei.value)), 1, 12) AS "
       "uid, CAST(CASE WHEN ei.type = 'process' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM ii JOIN ei USING (event_key) "
       "GROUP BY ALL")
def incident_indicators(spark, sf):
    _, tl = investigated(spark, sf)
    return incidents.incident_iocs(tl).select("incident_id", "type", "value", "uid", "confidence")


@query("phase_events", f"WITH {_MAL}, p AS (SELECT incident_id, event_key, event_ts, {_PHASE} AS phase FROM ii) SELECT "
       "incident_id, event_key, phase FROM p WHERE contains(lower(phase), 'credential') QUALIFY row_number() OVER (PARTITION BY "
       "incident_id ORDER BY event_ts, event_key) <= 20")
def phase_events(spark, sf):
    _, tl = investigated(spark, sf)
    return incidents.phase_events(tl, "credential").select("incident_id", "event_key", "phase")


@query("incident_list", f"WITH {_FULL}, cr AS (SELECT incident_id, epoch_us(min(event_ts)) AS created_us FROM ii GROUP BY 1) SELECT "
       "incident_id AS id, host, severity, classification, event_count, created_us FROM r2 JOIN cr USING (incident_id) ORDER BY "
       "created_us DESC, id LIMIT 100")
def incident_list(spark, sf):
    inc, _ = investigated(spark, sf)
    return incidents.incident_list(inc, 100).select("id", "host", "severity", "classification", "event_count", F.unix_micros(
        F.col("created_at").cast("timestamp")).alias("created_us"))


@query("incident_report_lines", f"WITH {_FULL} SELECT incident_id, host, severity, {big('event_count')} AS event_count FROM r2")
def incident_report_lines(spark, sf):
    """The text report, read back: id, host, severity and the number of timeline entries."""
    inc, tl = (materialise(x) for x in investigated(spark, sf))
    text = incidents.report_text(inc, tl)
    line = lambda label: F.regexp_extract("report", label + r":\s+(.*)", 1)
    return text.select(line("Incident ID").alias("incident_id"), line("Host").alias("host"), F.lower(line(
        "Severity")).alias("severity"), b(F.regexp_count("report", F.lit(r"\n  [0-9-]{10} [0-9:]{8}  \["))).alias(
        "event_count"))


def _says(phase):
    return any_word(_TXT, N.PHASE_WORDS[phase])


_BRIEF = "substring(command_line, 1, 80)"
_DESCRIPTION = (
    f"CASE WHEN {_says(N.CREDENTIAL)} THEN concat('Credential dumping: ', process_name, ' executed by ', \"user\", CASE WHEN command_line <> '' THEN "
    f"concat(' [', {_BRIEF}, ']') ELSE '' END) WHEN {_says(N.EXECUTION)} THEN concat('PowerShell execution by ', \"user\", CASE WHEN "
    f"{any_word(_TXT, ['-enc', 'base64'])} THEN ' (encoded command)' ELSE '' END) WHEN {_says(N.PERSISTENCE)} THEN concat('Persistence mechanism: ', CASE "
    f"WHEN command_line <> '' THEN {_BRIEF} ELSE action END) WHEN event_id = 7045 THEN concat('Service installed by ', \"user\") WHEN event_id = 4698 "
    f"THEN concat('Scheduled task created by ', \"user\") WHEN {_says(N.LATERAL)} THEN concat('Lateral movement: ', process_name, ' → remote execution') "
    f"WHEN {_says(N.EVASION)} THEN concat('Defense evasion: ', process_name) WHEN {_says(N.C2)} THEN concat('C2 communication: ', process_name) WHEN "
    f"{_says(N.DISCOVERY)} THEN concat('Discovery: ', CASE WHEN command_line <> '' THEN {_BRIEF} ELSE process_name END) WHEN query_name <> '' AND "
    "len(list_filter(string_split(query_name, '.'), lambda p: length(p) > 20)) > 0 THEN concat('DNS data exfiltration: ', substring(query_name, 1, 60)) "
    "WHEN event_id = 4624 THEN concat('Successful logon: ', \"user\", ' (type ', coalesce(CAST(logon_type AS VARCHAR), '?'), ')') WHEN event_id = 4625 "
    "THEN concat('Failed logon attempt: ', \"user\") WHEN event_id = 4648 THEN concat('Explicit credential use by ', \"user\") WHEN image_loaded <> '' "
    "THEN concat('DLL loaded: ', image_loaded) WHEN message <> '' THEN message ELSE concat('Event ', CAST(event_id AS VARCHAR), ': ', process_name) END")
_DASHED = lambda title: f"{lit('-' * 70)}, {lit(title)}, {lit('-' * 70)}"
_KEEP = {"ip": f"NOT {_PRIV}", "domain": "v NOT IN ('localhost', 'example.com')"}
_EVENT_LIST = ("list_concat(" + ", ".join(
    f"list_transform(list_filter(list_transform(regexp_extract_all(txt, {lit(p)}), lambda v: trim(v)), lambda v: v <> '' AND {_KEEP.get(k, 'true')}), lambda v: "
    f"struct_pack(t := {lit(k)}, v := v))" for k, p in I.IOC_PATTERNS_A.items()) + f", CASE WHEN {_TOOL} THEN [struct_pack(t := 'process', v := process_name)] ELSE [] END)")
_PICKED = lambda *pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"
_CAUSES = _PICKED(
    ("ph = 'Initial Access' AND failed", "'Brute force login attempt detected as initial vector'"),
    ("opened AND lt = 10", "'Unauthorized RDP access as initial entry point'"),
    ("opened AND lt = 3", "'Network logon suggesting lateral movement from another host'"),
    ("opened AND lt NOT IN (3, 10)", "'Suspicious authentication as initial access'"),
    ("ph = 'Execution' AND contains(lower(pr), 'powershell')", "'PowerShell-based attack, likely delivered via phishing or exploit'"),
    ("ph = 'Execution' AND NOT contains(lower(pr), 'powershell') AND contains(lower(pr), 'python')", "'Script-based attack using Python runtime'"),
    ("ph = 'Execution' AND NOT contains(lower(pr), 'powershell') AND NOT contains(lower(pr), 'python') AND contains(lower(pr), 'mshta')",
     "'HTML Application abuse, likely from malicious link/document'"),
    ("ph = 'Execution' AND NOT contains(lower(pr), 'powershell') AND NOT contains(lower(pr), 'python') AND NOT contains(lower(pr), 'mshta')",
     "concat('Suspicious execution of ', pr)"),
    ("p_exec AND p_pers", "'Attacker established persistence after initial execution'"),
    ("p_cred", "'Credential harvesting indicates intent for privilege escalation or lateral movement'"))
_IMPACTS = _PICKED(
    ("p_cred", "'Credentials may be compromised - password reset required'"), ("p_lat", "'Lateral movement to 1 hosts detected'"),
    ("p_exfil", "'Data exfiltration suspected - data loss assessment needed'"),
    ("p_pers", "'Persistence established - host may remain compromised after reboot'"),
    ("p_c2", "'Active C2 channel - attacker may have ongoing access'"),
    ("len(privileged) > 0", "concat('Privileged accounts involved: ', array_to_string(privileged, ', '))"))
_ADVICE = _PICKED(
    ("true", "'Isolate affected host(s) from network'"), ("p_cred", "'Reset all credentials for affected users'"),
    ("p_cred", "'Force password change for all accounts on affected hosts'"), ("p_cred", "'Review Active Directory for unauthorized changes'"),
    ("p_pers", "'Remove all identified persistence mechanisms (scheduled tasks, services, registry keys)'"),
    ("p_pers", "'Perform full malware scan on affected hosts'"), ("p_lat", "'Scan all hosts in the network segment for compromise indicators'"),
    ("p_lat", "'Review network segmentation policies'"), ("p_c2", "'Block identified C2 IP addresses and domains at firewall'"),
    ("p_c2", "'Review proxy logs for additional C2 indicators'"), ("p_exfil", "'Assess scope of data exposure'"),
    ("p_exfil", "'Review DNS and proxy logs for data exfiltration indicators'"), ("p_exfil", "'Notify data protection officer if PII involved'"),
    ("len(ips) > 0", "concat('Block external IPs: ', array_to_string(ips, ', '))"), ("true", "'Preserve evidence and forensic artifacts'"),
    ("true", "'Document incident timeline for post-incident review'"))
_REPORT = (
    f"{_FULL}, ev0 AS (SELECT ph0.*, {_COMB} AS txt, {_DESCRIPTION} AS description FROM ph0), ev1 AS (SELECT *, {_EVENT_LIST} AS il FROM ev0), "
    "kl AS (SELECT event_key, list(id ORDER BY rule_order) AS ids FROM kh GROUP BY 1), "
    "el AS (SELECT incident_id, event_ts, event_key, list_filter([concat('  ', \"timestamp\", '  ', CASE WHEN ml_score >= 0.8 THEN '[!!!]' WHEN ml_score >= 0.6 "
    "THEN '[!!]' WHEN ml_score >= 0.4 THEN '[!]' WHEN ml_score >= 0.2 THEN '[.]' ELSE '[i]' END, ' [', phase, ']'), concat('    ', description), CASE WHEN ids IS "
    "NOT NULL THEN concat('    MITRE: ', array_to_string(ids, ', ')) END, CASE WHEN len(il) > 0 THEN concat('    IoCs: ', array_to_string(list_transform(il[1:3], "
    "lambda x: concat(x.t, ':', x.v)), ', ')) END, ''], lambda x: x IS NOT NULL) AS lines FROM ev1 LEFT JOIN kl USING (event_key)), "
    "tll AS (SELECT incident_id, flatten(list(lines ORDER BY event_ts, event_key)) AS tl FROM el GROUP BY 1), "
    "ix AS (SELECT incident_id, event_ts, event_key, event_id, unnest(il) AS tv, generate_subscripts(il, 1) AS pos FROM ev1), "
    "i1 AS (SELECT incident_id, event_ts, event_key, pos, tv.t AS t, tv.v AS v, CASE WHEN tv.t = 'process' THEN 'Suspicious tool' ELSE concat('Found in event ', "
    "CAST(event_id AS VARCHAR)) END AS ctx FROM ix QUALIFY row_number() OVER (PARTITION BY incident_id, tv.t, tv.v ORDER BY event_ts, event_key, pos) = 1), "
    "i2 AS (SELECT *, row_number() OVER (PARTITION BY incident_id, t ORDER BY event_ts, event_key, pos) AS rn FROM i1), "
    "i3 AS (SELECT incident_id, t, min(struct_pack(a := event_ts, b := event_key, c := pos)) AS f, list_concat([concat('  [', upper(t), ']')], list(concat('    - ', v, "
    "' (', ctx, ')') ORDER BY event_ts, event_key, pos)) AS l FROM i2 WHERE rn <= 10 GROUP BY 1, 2), i4 AS (SELECT incident_id, flatten(list(l ORDER BY f)) AS il "
    "FROM i3 GROUP BY 1), i5 AS (SELECT incident_id, list(v ORDER BY event_ts, event_key, pos) AS ips FROM i2 WHERE t = 'ip' AND rn <= 5 GROUP BY 1), "
    "m1 AS (SELECT incident_id, id, name, tactic, event_ts, event_key, rule_order FROM ii JOIN kh USING (event_key) QUALIFY row_number() OVER (PARTITION BY incident_id, "
    "id ORDER BY event_ts, event_key, rule_order) = 1), m2 AS (SELECT incident_id, flatten(list([concat('  ', id, ' - ', name), concat('    Tactic: ', tactic)] ORDER BY "
    "event_ts, event_key, rule_order)) AS ml FROM m1 GROUP BY 1), "
    "u1 AS (SELECT incident_id, \"user\" AS u, min(struct_pack(a := event_ts, b := event_key)) AS f FROM ii WHERE \"user\" <> '' GROUP BY 1, 2), u2 AS (SELECT incident_id, "
    "list(u ORDER BY f) AS users FROM u1 GROUP BY 1), "
    "fe AS (SELECT incident_id, phase AS ph, event_id AS eid, logon_type AS lt, process_name AS pr, description AS de, contains(CASE WHEN action <> '' THEN action ELSE "
    "concat('event_', CAST(event_id AS VARCHAR)) END, 'logon_failure') OR contains(CAST(event_id AS VARCHAR), '4625') AS failed FROM ev1 QUALIFY row_number() OVER "
    "(PARTITION BY incident_id ORDER BY event_ts, event_key) = 1), "
    "cr AS (SELECT incident_id, min(event_ts) AS created FROM ii GROUP BY 1), "
    "rp0 AS (SELECT r2.*, created, tl, coalesce(il, []) AS il, coalesce(ips, []) AS ips, ml, coalesce(users, []) AS users, ph, eid, lt, pr, de, failed, ph = 'Initial "
    "Access' AND NOT failed AND contains(CAST(eid AS VARCHAR), '4624') AS opened, list_filter(coalesce(users, []), lambda x: contains(upper(x), 'ADMIN') OR "
    "contains(upper(x), 'SYSTEM') OR contains(upper(x), 'ROOT')) AS privileged FROM r2 JOIN tll USING (incident_id) JOIN cr USING (incident_id) JOIN fe USING "
    "(incident_id) LEFT JOIN i4 USING (incident_id) LEFT JOIN i5 USING (incident_id) LEFT JOIN m2 USING (incident_id) LEFT JOIN u2 USING (incident_id)), "
    f"rp1 AS (SELECT *, {_CAUSES} AS causes, {_IMPACTS} AS impacts, {_ADVICE} AS advice FROM rp0), "
    f"rp AS (SELECT incident_id, list_concat([{lit('=' * 70)}, 'INCIDENT INVESTIGATION REPORT', {lit('=' * 70)}, concat('Incident ID:     ', incident_id), "
    "concat('Host:            ', host), concat('Severity:        ', upper(severity)), concat('Confidence:      ', CAST(CAST(floor(round(confidence * 100, 9) + 0.5) AS "
    "INTEGER) AS VARCHAR), '%'), 'Status:          investigating', concat('Classification:  ', classification), concat('Created:         ', CAST(created AS VARCHAR)), '', "
    f"{_DASHED('CLASSIFICATION')}, classification, '', {_DASHED('ATTACK TIMELINE')}], tl, CASE WHEN n_iocs > 0 THEN list_concat([{_DASHED('INDICATORS OF COMPROMISE (IoCs)')}], "
    f"il, ['']) ELSE [] END, CASE WHEN n_techniques > 0 THEN list_concat([{_DASHED('MITRE ATT&CK MAPPING')}], ml, ['']) ELSE [] END, [{_DASHED('ROOT CAUSE ANALYSIS')}, "
    "concat('  ', CASE WHEN len(causes) > 0 THEN array_to_string(causes, '. ') ELSE concat('Initial suspicious activity detected: ', substring(de, 1, 100)) END, '.'), '', "
    f"{_DASHED('IMPACT ASSESSMENT')}, concat('  ', CASE WHEN len(impacts) > 0 THEN array_to_string(impacts, ' | ') ELSE 'Limited impact detected. Further monitoring "
    "recommended.' END), concat('  Affected hosts: ', host), concat('  Affected users: ', array_to_string(users, ', ')), '', "
    f"{_DASHED('RECOMMENDED RESPONSE')}], list_transform(advice, lambda x, i: concat('  ', CAST(i AS VARCHAR), '. ', x)), ['', {lit('=' * 70)}]) AS lines FROM rp1)")


@query("incident_report_rows", f"WITH {_REPORT} SELECT incident_id, CAST(generate_subscripts(lines, 1) AS BIGINT) AS line_no, unnest(lines) AS text FROM rp")
def incident_report_rows(spark, sf):
    """Every line of every investigation report."""
    from tidewatch.operators.report_rows import report_rows

    inc, tl = (materialise(x) for x in investigated(spark, sf))
    return report_rows(inc, tl).select("incident_id", b("line_no").alias("line_no"), "text")


@query("incident_views", f"WITH {_FULL} SELECT incident_id, classification, {big('event_count')} AS event_count FROM r2")
def incident_views(spark, sf):
    """Short view and analyst context, read back."""
    inc, tl = (materialise(x) for x in investigated(spark, sf))
    both = join_grown(incidents.read_view(inc, tl), incidents.context_text(inc, tl), "incident_id")
    return both.select("incident_id", F.regexp_extract("view", r"Classification: (.*)", 1).alias("classification"), b(
        F.regexp_extract("context", r"Events        : (\d+)", 1)).alias("event_count"))


@query("first_event_per_incident", f"WITH {_MAL} SELECT incident_id, event_key FROM ii QUALIFY row_number() OVER (PARTITION BY "
       "incident_id ORDER BY event_ts, event_key) = 1")
def first_event_per_incident(spark, sf):
    rows = materialise(scored(spark, sf).where(F.col("classification") == "malicious").select("event_key", "event_ts", "hostname"))
    return incidents.correlate(rows).groupBy("incident_id").agg(F.min_by("event_key", F.struct("event_ts", "event_key")).alias(
        "event_key"))


@query("top_indicators", f"WITH {se()}, {_IOCS}, c AS (SELECT type, value, count(*) AS n FROM ei GROUP BY ALL) SELECT type, value, n "
       "FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, value) <= 10")
def top_indicators(spark, sf):
    rows = events(spark, sf).select(F.explode(ioc.event_indicators_a(incidents.IOC_FIELDS)).alias("i"))
    counts = rows.groupBy("i.type", "i.value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, ["type"], [F.desc("n"), F.col("value")], 10).drop("rn")


@query("manager_stats", f"WITH {_FULL} SELECT count(*) AS total_incidents, CAST(sum(event_count) AS BIGINT) AS total_events_correlated, "
       "count(DISTINCT host) AS active_incidents FROM r2")
def manager_stats(spark, sf):
    inc, _ = investigated(spark, sf)
    return quality.manager_stats(inc).select("total_incidents", "total_events_correlated", "active_incidents")


# ---------------------------------------------------------------- second investigator
_ITEXT = "concat(' ', lower(command_line), ' ', lower(process_name))"
_TYPE_ROWS = " UNION ALL ".join(
    f"SELECT incident_id, {o} AS o, {lit(name)} AS kind, " + " + ".join(
        [f"(CAST(len(list_intersect(techs, [{', '.join(lit(t) for t in techs)}])) AS DOUBLE) * CAST('0.3' AS DOUBLE)) * CAST('{w}' AS DOUBLE)"] +
        [f"CASE WHEN {pf} THEN CAST('{0.2 * w!r}' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for pf in [f"p_{o}_{j}" for j in range(len(pats))]]) + " AS s FROM iv"
    for o, (name, techs, pats, w, _) in enumerate(A.INCIDENT_TYPES))
_AT = "struct_pack(t := event_ts, k := event_key)"


def _flag_sql(p: str) -> str:
    one = f"bool_or(regexp_matches({_ITEXT}, {lit(p)}))"
    if ".*" not in p:
        return one
    a, z = p.split(".*")
    return (f"({one} OR coalesce(min(CASE WHEN contains({_ITEXT}, {lit(a)}) THEN {_AT} END) < "
            f"max(CASE WHEN contains({_ITEXT}, {lit(z)}) THEN {_AT} END), false))")


_FLAGS = ", ".join(f"{_flag_sql(p)} AS p_{o}_{j}" for o, (_, _, ps, _, _) in enumerate(A.INCIDENT_TYPES)
                   for j, p in enumerate(ps))
_INDICATOR_FIELDS = ("command_line", "destination_ip", "source_ip", "file_path", "hashes", "url", "domain")
_EVENT_IOCS = ("itx AS (SELECT event_key, concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in _INDICATOR_FIELDS) + ") AS txt FROM se), im AS ("
               + " UNION ALL ".join(f"SELECT event_key, {lit(k)} AS type, unnest(regexp_extract_all(txt, {lit('(?i)' + p)})) AS value FROM itx"
                                    for k, p in I.IOC_PATTERNS_B.items())
               + "), ib AS (SELECT event_key, count(DISTINCT (type, value)) AS n_iocs FROM im WHERE NOT (type = 'ip' AND "
               "regexp_matches(value, '^(10|127)[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]')) GROUP BY 1)")
_SECOND = (f"{se()}, {_CLASSIFIED}, {sessions_sql('se')}, {PATTERN_HITS}, {EXTENDED_HITS}, {MERGED}, {_EVENT_IOCS}, cl AS (SELECT ii.*, CASE WHEN p >= 0.5 THEN p ELSE 1 - "
           "p END AS conf, p >= 0.5 AS bad FROM ii JOIN h USING (event_key)), tlx AS (SELECT *, CASE WHEN NOT bad THEN "
           f"'informational' WHEN {_CRITCMD} OR conf >= 0.85 THEN 'critical' WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.5 THEN "
           "'medium' ELSE 'low' END AS sev FROM cl WHERE NOT (NOT bad AND conf > 0.7)), "
           "t1 AS (SELECT incident_id, id, arg_min(confidence, (event_ts, event_key)) AS c FROM tlx JOIN mg USING (event_key) GROUP BY 1, 2), "
           "te AS (SELECT incident_id, list(id) AS techs, string_agg(id, ',' ORDER BY round(c, 6) DESC, id) AS ranked FROM t1 GROUP BY 1), "
           f"fl AS (SELECT incident_id, {_FLAGS} FROM ii GROUP BY 1), iv AS (SELECT fl.*, coalesce(techs, []) AS techs, coalesce(ranked, '') AS ranked FROM fl "
           "LEFT JOIN te USING (incident_id)), "
           f"ty AS ({_TYPE_ROWS}), tot AS (SELECT incident_id, sum(s) AS total FROM ty GROUP BY 1), best AS (SELECT ty.incident_id, "
           "kind, CASE WHEN total > 0 THEN s / total ELSE 0 END AS share FROM ty JOIN tot USING (incident_id) QUALIFY "
           "row_number() OVER (PARTITION BY ty.incident_id ORDER BY s DESC, o) = 1), "
           "sv AS (SELECT incident_id, count(*) AS rows_, sum(coalesce(n_iocs, 0)) AS mentions, count(CASE WHEN sev IN ('high', 'critical') THEN 1 END) AS hi, "
           "count(CASE WHEN sev = 'critical' THEN 1 END) AS cr FROM tlx LEFT JOIN ib USING (event_key) GROUP BY 1), "
           "sc2 AS (SELECT incident_id, CASE WHEN rows_ IS NULL THEN 0 ELSE least(least(least(hi * 5, 30) + least(cr * 10, 25) + "
           f"least(len(techs) * 4, 20) + 5 * len(list_intersect(techs, [{', '.join(lit(t) for t in A.HIGH_IMPACT_TECHNIQUES)}])), 90) + "
           "least(mentions * 2, 10), 100) END AS threat_score FROM iv LEFT JOIN sv USING (incident_id))")


def second_timeline(spark, sf):
    """Classified rows with incident, techniques, indicators and severity, computed once."""
    f = features.v1_18(events(spark, sf))
    p, label, conf, _ = scoring.heuristic18({n: F.col(n) for n in features.V1_NAMES})
    ioc_text = F.concat_ws(" ", *[nz(c) for c in _INDICATOR_FIELDS])
    f = matching.stage_texts(f, "cmd", "proc", "parent").withColumn("_ioc_text", pin(ioc_text))
    rows = f.withColumns({"label": label, "confidence": conf, "matched": pin(matching.pattern_techniques(True)),
                          "iocs": pin(ioc.text_indicators_b(F.col("_ioc_text")))})
    rows = rows.withColumn("severity", scoring.classified_severity(F.col("label"), F.col("confidence"), nz("command_line")))
    staged = materialise(rows.select(
        "event_key", "event_ts", "hostname", "user", "command_line", "process_name", "script_block_text", "label", "confidence", "severity",
        "matched", "iocs", scoring.on_timeline(F.col("label"), F.col("confidence")).alias("shown")))
    merged = matching.merged_techniques(F.col("matched"), F.col("extended"))
    both = matching.with_extended(staged, card_catalogue(spark)).withColumn("techniques", merged)
    return materialise(incidents.correlate(both.drop("matched", "extended", "script_block_text")))


def second_rollup(tl):
    """Per incident: type, score, level, counts, findings and actions."""
    shown = tl.where("shown")
    techs = shown.select("incident_id", "event_ts", "event_key", F.explode("techniques").alias("t")).groupBy(
        "incident_id", F.col("t.id").alias("id")).agg(F.min(F.struct("event_ts", "event_key", "t.name", "t.tactic",
                                                                     "t.confidence")).alias("f"))
    tsets = techs.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.round("f.confidence", 6)).alias("c"), "id", F.col("f.name").alias("name"),
                                             F.col("f.tactic").alias("tactic")))).alias("ranked"))
    flags = tl.groupBy("incident_id").agg(
        *matching.incident_pattern_flags(), F.count_distinct(F.lower("hostname")).alias("hosts"),
        F.count(F.lit(1)).alias("total_events"), F.array_sort(F.collect_set(F.when(nz("user") != "", F.col("user")))).alias(
            "affected_users"))
    sev = shown.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("rows_shown"), F.count_if(F.col("severity").isin("high", "critical")).alias("hi"),
        F.count_if(F.col("severity") == "critical").alias("cr"), F.sum(F.size("iocs")).alias("ioc_mentions"),
        F.count_if(F.col("severity") != "informational").alias("malicious_events"), F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"))
    none = F.array().cast("array<string>")
    base = join_grown(join_grown(flags, tsets, "incident_id", "left"), sev, "incident_id", "left").withColumn(
        "technique_ids", F.coalesce(F.transform("ranked", lambda t: t["id"]), none))
    out = matching.incident_type(base)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    impact = F.size(F.array_intersect("technique_ids", F.array(*[F.lit(t) for t in A.HIGH_IMPACT_TECHNIQUES])))
    points = (F.least(n("hi") * 5, F.lit(30)) + F.least(n("cr") * 10, F.lit(25)) + F.least(
        F.size("technique_ids") * 4, F.lit(20)) + impact * 5)
    total = F.when(n("rows_shown") == 0, 0).otherwise(F.least(F.least(points, F.lit(90)) + F.least(
        n("ioc_mentions") * 2, F.lit(10)), F.lit(100)))
    out = out.withColumn("threat_score", total)
    return out.withColumn("threat_level", F.when(F.col("threat_score") >= 80, "critical").when(
        F.col("threat_score") >= 60, "high").when(F.col("threat_score") >= 40, "medium").when(
        F.col("threat_score") >= 20, "low").otherwise("informational"))


_LEVEL = ("CASE WHEN threat_score >= 80 THEN 'critical' WHEN threat_score >= 60 THEN 'high' WHEN threat_score >= 40 THEN 'medium' WHEN "
          "threat_score >= 20 THEN 'low' ELSE 'informational' END")


@query("ml_investigation", f"WITH {_SECOND} SELECT incident_id, CASE WHEN share < 0.2 THEN 'unknown' ELSE kind END AS incident_type, "
       f"{r6('share')} AS type_confidence, {big('len(techs)')} AS n_techniques, ranked AS techniques, {big('coalesce(hi, 0)')} AS high_events, "
       f"{big('coalesce(cr, 0)')} AS critical_events, {big('coalesce(mentions, 0)')} AS ioc_mentions, {big('threat_score')} AS threat_score, "
       f"{_LEVEL} AS threat_level FROM best JOIN iv USING (incident_id) JOIN sc2 USING (incident_id) LEFT JOIN sv USING (incident_id)")
def ml_investigation(spark, sf):
    """Per incident: type, merged techniques in order of confidence, severities, indicators, threat score and level."""
    out = second_rollup(second_timeline(spark, sf))
    n = lambda c: b(F.coalesce(F.col(c), F.lit(0)))
    return out.select("incident_id", "incident_type", r("type_confidence").alias("type_confidence"), b(F.size(
        "technique_ids")).alias("n_techniques"), F.array_join("technique_ids", ",").alias("techniques"), n("hi").alias("high_events"),
        n("cr").alias("critical_events"), n("ioc_mentions").alias("ioc_mentions"), n("threat_score").alias("threat_score"), "threat_level")


@query("ml_report")
def ml_report(spark, sf):
    """Text and JSON report of the second investigator."""
    from tidewatch.operators import reports

    tl = second_timeline(spark, sf)
    return reports.investigation_report(second_rollup(tl), tl)


# ---------------------------------------------------------------- stored-table operations
@query("events_by_host", f"WITH {se()} SELECT event_key, hostname, epoch_us(event_ts) AS ts_us FROM se WHERE hostname = 'WS-0008' "
       "ORDER BY event_ts DESC LIMIT 100")
def events_by_host(spark, sf):
    from tidewatch.sources.readers import stored

    return stored(events(spark, sf, "event_key", "hostname", "event_ts"), newest="event_ts", limit=100,
                  hostname="WS-0008").select("event_key", "hostname", F.unix_micros(F.col("event_ts").cast(
                      "timestamp")).alias("ts_us"))


@query("incident_upsert", f"WITH {se('event_key', 'event_ts', 'hostname')}, {sessions_sql('se')}, o AS (SELECT incident_id, min(hostname) "
       "AS host, count(*) AS n FROM ii GROUP BY 1) SELECT incident_id, host, CASE WHEN n > 1 THEN 'investigating' ELSE 'open' END "
       "AS status, n AS events FROM o")
def incident_upsert(spark, sf):
    """Upsert of new status values onto stored incidents, then a status update: the two table rewrites."""
    s = incidents.correlate(events(spark, sf, "event_key", "event_ts", "hostname")).groupBy("incident_id").agg(
        F.min("hostname").alias("host"), F.count(F.lit(1)).alias("events"))
    old = s.select("incident_id", "host", F.lit("new").alias("status"), F.lit(None).cast("bigint").alias("events"),
                   F.lit(None).cast("timestamp").alias("updated_at"))
    new = s.select("incident_id", F.lit("open").alias("status"), "events")
    merged = sinks.upsert(old, new, "incident_id")
    changes = s.where(F.col("events") > 1).select("incident_id", F.lit("investigating").alias("status"))
    return sinks.update_status(merged, changes).select("incident_id", "host", "status", "events")


@query("log_shipping", f"WITH {se()} SELECT event_key, CASE WHEN round(100 * score) >= 80 THEN 'error' WHEN round(100 * score) >= 60 "
       "THEN 'warn' ELSE 'info' END AS level, CASE WHEN round(100 * score) > 0 THEN concat('🚨 THREAT DETECTED [', "
       "CAST(CAST(round(100 * score) AS INT) AS STRING), '/100] ', event_type, ' on ', hostname, ' - Suspicious activity') ELSE "
       "concat(event_type, ' on ', hostname, ' - User: ', \"user\") END AS message FROM se")
def log_shipping(spark, sf):
    ev = events(spark, sf).withColumns({
        "threat_score": F.round(100 * F.col("score")).cast("int"), "summary": F.lit(None).cast("string"),
        "threat_level": F.lit(None).cast("string"), "reasoning": F.lit(None).cast("string"),
        "indicators": F.lit(None).cast("array<string>")})
    return sinks.ship_rows(ev).select("event_key", "level", "message")


