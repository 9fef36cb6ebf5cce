"""Queries on the event stream: views, scoring, features, matching, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import net
from tidewatch.functions.text import nz, pin, shannon_entropy, unique_ratio
from tidewatch.operators import assess, features, matching, scoring
from tidewatch.plans.oracle_base import (
    ANOMALOUS, ROUTED, SCORED, TEXTS, among, any_prefix, any_regex, any_word, base, big, lit, n_words, r6, se, yes)
from tidewatch.rules import attack as A
from tidewatch.rules import detection as D
from tidewatch.rules import incident as N
from tidewatch.rules import labels as L
from tidewatch.schema import security_events
from tidewatch.session import materialise

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def r(c, d: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def b(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def events(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return security_events(spark, sf, *names)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.route(scoring.score_events(events(spark, sf)))


# ---------------------------------------------------------------- scoring
@query("event_score", f"WITH {SCORED} SELECT event_key, {r6('base_score')} AS base_score, {r6('adv_score')} AS adv_score, "
       f"{r6('ml_score')} AS ml_score, {big('n_adv')} AS n_indicators, ml_score >= 0.5 AS is_malicious FROM sc")
def event_score(spark, sf):
    return scoring.score_events(events(spark, sf)).select(
        "event_key", r("base_score").alias("base_score"), r("adv_score").alias("adv_score"), r("ml_score").alias("ml_score"),
        b(F.size("adv_reasons")).alias("n_indicators"), "is_malicious")


@query("event_routing", f"WITH {ROUTED} SELECT event_key, classification, path, {ANOMALOUS} AS anomalous, "
       "CASE WHEN ml_score >= 0.8 THEN 'HIGH' WHEN ml_score >= 0.6 THEN 'MEDIUM' WHEN ml_score >= 0.5 THEN 'LOW' ELSE "
       "'BENIGN' END AS threat_level, CASE WHEN ml_score >= 0.8 THEN 'critical' WHEN ml_score >= 0.6 THEN 'high' WHEN "
       "ml_score >= 0.4 THEN 'medium' WHEN ml_score >= 0.2 THEN 'low' ELSE 'info' END AS severity FROM ro")
def event_routing(spark, sf):
    p = F.col("ml_score")
    return scored(spark, sf).select("event_key", "classification", "path", scoring.is_anomalous().alias("anomalous"),
                                    scoring.confidence_band(p).alias("threat_level"),
                                    scoring.event_severity(p).alias("severity"))


@query("enriched_alerts", f"WITH {ROUTED} SELECT event_key, CASE WHEN ml_score >= 0.8 THEN 'error' WHEN ml_score >= 0.6 "
       "THEN 'warn' ELSE 'info' END AS level, path, starts_with('THREAT', 'THREAT') AS tagged FROM ro WHERE "
       "classification = 'malicious'")
def enriched_alerts(spark, sf):
    hit = scored(spark, sf).where(F.col("classification") == "malicious")
    return scoring.enrich(hit).select("event_key", "level", F.col("ml_detection.path").alias("path"),
                                      F.startswith("log_message", F.lit("THREAT")).alias("tagged"))


_LEGACY = {
    "event_id_value": "CAST(eid AS DOUBLE)", "high_risk_event": yes(f"eid IN {among(D.HIGH_RISK_IDS)}"),
    "suspicious_process": yes(any_word("proc", D.PROCESSES)), "cmdline_length": "CAST(length(cmd) AS DOUBLE)",
    "keyword_count": f"CAST({n_words('every', D.KEYWORDS)} AS DOUBLE)",
    "has_base64": yes(any_word("every", D.ENCODED_MARKS)), "has_download": yes(any_word("every", D.DOWNLOAD_MARKS)),
    "has_hidden": yes(any_word("every", D.HIDDEN_MARKS)), "parent_suspicious": yes(any_word("par", D.PROCESSES)),
    "logon_type_value": "CAST(logon_type AS DOUBLE)", "remote_logon": yes("logon_type IN (3, 10)"),
    "system_user": yes(f'upper("user") IN {among(D.SERVICE_USERS)}'), "admin_user": yes('contains(upper("user"), \'ADMIN\')'),
    "dest_port_value": "CAST(destination_port AS DOUBLE)",
    "c2_port": yes(f"destination_port IN {among(D.WATCHED_PORTS)}")}


def _wide(features_sql: dict[str, str], extra: str = "") -> str:
    return (f"WITH {se()}, {TEXTS}{extra} SELECT event_key, " + ", ".join(f'{v} AS "{k}"' for k, v in features_sql.items())
            + " FROM " + ("w" if extra else "tx"))


@query("features_legacy", _wide(_LEGACY))
def features_legacy(spark, sf):
    return features.legacy16(events(spark, sf)).select("event_key", *_LEGACY)


_V1TEXT = ", w AS (SELECT *, concat_ws(' ', cmd, scr, proc, img) AS alltext FROM tx)"
_V1 = dict(zip(features.V1_NAMES, [
    yes(f"eid IN {among(D.V1_HIGH_RISK_IDS)}"), f"CAST({n_words('alltext', D.V1_KEYWORDS)} AS DOUBLE)",
    yes(any_word("proc", D.V1_PROCESSES)), yes("contains(cmd, '-enc') OR contains(cmd, 'base64') OR contains(alltext, "
                                               "'frombase64')"),
    yes(any_word("alltext", ["lsass", "sekurlsa", "procdump"])),
    yes("contains(proc, 'powershell') AND " + any_word("cmd", ["-enc", "-nop", "bypass", "hidden"])),
    r6("least(length(cmd) / 1000.0, 1.0)"), yes(any_word("alltext", ["socket", "connect", "webclient", "downloadstring"])),
    yes(any_word("alltext", ["schtasks", "reg add", "sc create", "runonce", "onlogon"])),
    yes(any_word("alltext", ["bypass", "amsi", "etw", "-nop", "hidden", "mshta"])),
    yes(any_word("alltext", ["psexec", "winrs", "wmic process"])),
    yes(any_word("alltext", ["cobalt", "beacon", "meterpreter", "shellcode"])),
    yes(any_word("par", ["outlook", "winword", "excel", "powerpnt", "iexplore", "firefox"])),
    yes(f"eid IN {among(D.SYSMON_IDS)}"), yes("eid IN (4672, 4648, 4624)"), r6("least(length(scr) / 2000.0, 1.0)"),
    yes(any_word("img", ["users/public", "appdata/local/temp", "downloads"])), yes("logon_type IN (3, 10)")]))


@query("features_18", _wide(_V1, _V1TEXT))
def features_18(spark, sf):
    return features.v1_18(events(spark, sf)).select("event_key", *[
        r(c).alias(c) if c.endswith("_norm") else F.col(c) for c in features.V1_NAMES])


_H18 = ("least(1.0, 0.2 * least(has_ps_bypass_flags, 4) + 0.15 * has_base64_encoding + CASE WHEN cmdline_length_norm > 0 "
        "THEN 0.2 ELSE 0 END + 0.15 * has_network_indicators + 0.15 * has_persistence_indicators + 0.1 * "
        "has_defense_evasion + CASE WHEN script_length_norm > 0 THEN 0.15 ELSE 0 END)")
_CLASSIFIED = f"f18 AS ({_wide(_V1, _V1TEXT)}), h AS (SELECT event_key, CAST({_H18} AS DOUBLE) AS p FROM f18)"
_CRITCMD = any_regex("lower(command_line)", A.CRITICAL_COMMANDS)


@query("classify_heuristic", f"WITH {_CLASSIFIED}, {se('event_key', 'command_line')}, c AS (SELECT h.event_key, p, CASE "
       "WHEN p >= 0.5 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS conf, "
       f"command_line FROM h JOIN se USING (event_key)) SELECT event_key, {r6('p')} AS p, label, {r6('conf')} AS "
       f"confidence, NOT (label = 'benign' AND conf > 0.7) AS on_timeline, CASE WHEN label = 'benign' THEN "
       f"'informational' WHEN {_CRITCMD} OR conf >= 0.85 THEN 'critical' WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.5 "
       "THEN 'medium' ELSE 'low' END AS severity FROM c")
def classify_heuristic(spark, sf):
    f = features.v1_18(events(spark, sf))
    p, label, conf, _ = scoring.heuristic18({n: F.col(n) for n in features.V1_NAMES})
    out = f.withColumns({"p": p, "label": label, "confidence": conf})
    return out.select("event_key", r("p").alias("p"), "label", r("confidence").alias("confidence"),
                      scoring.on_timeline(F.col("label"), F.col("confidence")).alias("on_timeline"),
                      scoring.classified_severity(F.col("label"), F.col("confidence"), nz("command_line")).alias(
                          "severity"))


def _one_hot(ids):
    return {f"eid_{i}": yes(f"eid = {i}") for i in ids}


_BTEXT = f", w AS (SELECT *, concat_ws(' ', cmd, scr, proc) AS alltext, {base('proc')} AS pbase FROM tx)"


def _behaviour(kw, procs, wide):
    more = lambda ws: ws if wide else []
    return {
        "kw_count_norm": r6(f"least({n_words('alltext', kw)} / 5.0, 1.0)"),
        "susp_process_exact": yes(f"pbase IN {among(procs)}"), "susp_process_partial": yes(any_word("pbase", procs)),
        "base64_encoded": yes(any_word("cmd", ["-enc", "base64"] + more(["encodedcommand"])) +
                              " OR contains(alltext, 'frombase64')"),
        "lsass_credential": yes(any_word("alltext", ["lsass", "sekurlsa", "procdump"] + more(["comsvcs"]))),
        "powershell_bypass": yes("contains(proc, 'powershell') AND " + any_word(
            "cmd", ["-enc", "-nop", "bypass", "hidden"] + more(["windowstyle"]))),
        "network_download": yes(any_word("alltext", ["webclient", "downloadstring", "invoke-webrequest"] + more(
            ["urlcache", "bitsadmin", "wget", "curl"]))),
        "persistence": yes(any_word("alltext", ["schtasks /create", "reg add", "sc create", "runonce", "onlogon"] + more(
            [D.RUN_KEY]))),
        "defense_evasion": yes(any_word("alltext", ["bypass", "amsi", "etw", "-nop", "hidden", "mshta"] + more(
            ["installutil", "regsvr32", "cmstp"]))),
        "lateral_movement": yes(any_word("alltext", ["psexec", "winrs", "wmic process"] + more(
            ["invoke-wmimethod", "dcom"])))}


def _tail(ports, parents):
    system = any_word("proc", ["windows\\system32", "windows\\syswow64", "program files"])
    return {
        "has_dest_ip": yes("destination_ip NOT IN ('', '0.0.0.0', '127.0.0.1')"),
        "suspicious_port": yes(f"destination_port IN {among(ports)}"),
        "suspicious_path": yes(f"NOT {system} AND " + any_word("proc", ["appdata", "temp", "downloads", "public",
                                                                        "programdata"])),
        "suspicious_parent": yes(any_word("par", parents)), "network_logon": yes("logon_type IN (3, 10)"),
        "external_src_ip": "CAST(0 AS DOUBLE)", "registry_op": yes("eid IN (12, 13, 14)"),
        "driver_load": yes("eid IN (6, 7)"), "process_injection": yes("eid IN (8, 10)")}


_DENSE = ("CASE WHEN length(cmd) > 50 AND len(list_distinct(string_split(cmd, ''))) / length(cmd) > 0.6 THEN 1.0 ELSE 0.0 "
          "END")
_V2 = _one_hot(D.TOP_IDS) | _behaviour(D.V2_KEYWORDS, D.V2_PROCESSES, False) | _tail(
    [4444, 1337, 8080, 9090, 3333, 31337, 5555], D.OFFICE_PARENTS[:6])
_V3 = _one_hot(D.TOP_IDS) | _behaviour(D.V3_KEYWORDS, D.V3_PROCESSES, True) | _tail(
    [4444, 1337, 8080, 9090, 3333, 31337, 5555, 6666, 7777], D.OFFICE_PARENTS) | {
    "has_hashes": yes("length(hashes) > 10"), "high_entropy_cmdline": f"CAST({_DENSE} AS DOUBLE)"}
_PATH = "(CASE WHEN img <> '' THEN img ELSE proc END)"
_INT = lambda c: any_prefix(c, D.INTERNAL_PREFIXES_V4)
_V4 = _one_hot(D.TOP_IDS_V4) | {
    "process_create": yes("eid = 1"), "network_event": yes("eid = 3"), "process_end": yes("eid = 5"),
    "driver_load": yes("eid = 6"), "image_load": yes("eid = 7"), "registry_event": yes("eid IN (12, 13, 14)"),
    "process_inject": yes("eid IN (8, 10)"), "dns_event": yes("eid = 22"),
    "signed_binary": "CAST(CASE WHEN signed IN ('true', 'True') THEN 1.0 WHEN signed IN ('false', 'False') THEN 0.0 WHEN "
    + any_word(_PATH, ["windows\\system32", "windows\\syswow64", "program files\\windows defender",
                       "program files\\google\\chrome"]) + " THEN 1.0 ELSE 0.5 END AS DOUBLE)",
    "system_path_binary": yes(any_word(_PATH, ["windows\\system32", "windows\\syswow64", "program files"])),
    "user_appdata_path": yes(any_word(_PATH, ["appdata", "\\temp\\", "\\tmp\\", "downloads", "public", "programdata"])),
    "registry_suspicious_key": yes(any_word("reg", D.SUSPICIOUS_REGISTRY)),
    "registry_benign_key": yes(any_word("reg", D.BENIGN_REGISTRY)), "dest_is_internal": yes(_INT("destination_ip")),
    "dest_is_external": yes(f"destination_ip <> '' AND NOT {_INT('destination_ip')}"),
    "dest_suspicious_port": yes("destination_port IN (4444, 1337, 31337, 9090, 3333, 5555, 6666, 7777, 8888)"),
    "dest_common_port": yes("destination_port IN (80, 443, 53, 389, 636, 88, 123, 445, 22, 3389)"),
} | _behaviour(D.V3_KEYWORDS, D.V3_PROCESSES, True) | {
    "has_hashes": yes("length(hashes) > 10"), "high_entropy_cmdline": f"CAST({_DENSE} AS DOUBLE)",
    "suspicious_parent": yes(any_word("par", D.OFFICE_PARENTS)), "network_logon": yes("logon_type IN (3, 10)"),
    "external_src_ip": yes(f"source_ip <> '' AND NOT {_INT('source_ip')}")}


@query("features_39", _wide(_V2, _BTEXT))
def features_39(spark, sf):
    return features.v2_39(events(spark, sf)).select("event_key", *[r(c).alias(c) for c in _V2])


@query("features_41", _wide(_V3, _BTEXT))
def features_41(spark, sf):
    return features.v3_41(events(spark, sf)).select("event_key", *[r(c).alias(c) for c in features.V3_NAMES])


@query("features_42", _wide(_V4, _BTEXT))
def features_42(spark, sf):
    return features.v4_42(events(spark, sf)).select("event_key", *[r(c).alias(c) for c in features.V4_NAMES])


_NB = {
    "nb_event_id": "CAST(eid AS DOUBLE)", "nb_is_high_risk_event": yes(f"eid IN {among(D.NB_HIGH_RISK_IDS)}"),
    "nb_is_suspicious_process": yes(any_word("proc", D.NB_PROCESSES)), "nb_cmdline_length": "CAST(length(cmd) AS DOUBLE)",
    "nb_suspicious_keyword_count": f"CAST({n_words('cmd', D.NB_KEYWORDS)} AS DOUBLE)",
    "nb_has_base64": yes("regexp_matches(cmd, '-enc|-e |base64|frombase64')"),
    "nb_has_download": yes("regexp_matches(cmd, 'download|webclient|invoke-webrequest|curl|wget')"),
    "nb_has_hidden": yes("regexp_matches(cmd, '-w hidden|-windowstyle h|hidden')"),
    "nb_parent_is_suspicious": yes(any_word("par", D.NB_PROCESSES)), "nb_logon_type": "CAST(logon_type AS DOUBLE)",
    "nb_is_remote_logon": yes("logon_type IN (3, 10)"),
    "nb_is_system_user": yes(f'upper("user") IN {among(D.SERVICE_USERS)}'),
    "nb_is_admin": yes('contains(lower("user"), \'admin\')'), "nb_dest_port": "CAST(destination_port AS DOUBLE)",
    "nb_is_common_c2_port": yes("destination_port IN (443, 8443, 8080, 4444, 5555, 1337)"),
    "nb_channel_encoded": "CAST(dense_rank() OVER (ORDER BY channel) - 1 AS DOUBLE)"}


@query("features_notebook", _wide(_NB))
def features_notebook(spark, sf):
    ev = events(spark, sf)
    return features.notebook_features(ev, features.label_codes(ev, "channel")).select("event_key", *_NB)


# ---------------------------------------------------------------- technique matching
_KW_TEXT = ("lower(concat_ws(' ', nullif(command_line, ''), nullif(process_name, ''), nullif(script_block_text, ''), "
            "nullif(action, '')))")
_RULES = "rules(rule_order, kw, id, name, tactic) AS (VALUES " + ", ".join(
    f"({i}, {lit(k)}, {lit(t)}, {lit(n)}, {lit(ta)})" for i, (k, t, n, ta) in enumerate(A.KEYWORD_TECHNIQUES)) + ")"
KEYWORD_HITS = (
    f"kt AS (SELECT event_key, event_id, {_KW_TEXT} AS txt FROM se), {_RULES}, kh AS (SELECT event_key, id, name, tactic, "
    "rule_order FROM kt JOIN rules ON contains(txt, kw) OR kw = CAST(event_id AS STRING) QUALIFY row_number() OVER "
    "(PARTITION BY event_key, id ORDER BY rule_order) = 1)")


@query("keyword_techniques", f"WITH {se()}, {KEYWORD_HITS} SELECT event_key, id, name, tactic FROM kh")
def keyword_techniques(spark, sf):
    return matching.explode_techniques(matching.stage_texts(events(spark, sf), "kw"), matching.keyword_techniques(True), ["event_key"]).select(
        "event_key", "id", "name", "tactic")


def _evidence_rows():
    rows = []
    for t in A.PATTERN_TECHNIQUES:
        key = f"{lit(t['id'])} AS id, {lit(t['name'])} AS name, {lit(t['tactic'])} AS tactic"
        if t.get("event_ids"):
            rows.append((key, f"event_id IN {among(t['event_ids'])}", 0.1, 0))
        rows += [(key, f"regexp_matches(lower(command_line), {lit(p)})", 0.3, 1) for p in t.get("patterns", [])]
        rows += [(key, f"contains(lower(process_name), {lit(p)})", 0.25, 1) for p in t.get("processes", [])]
        rows += [(key, f"contains(lower(parent_image), {lit(p)})", 0.2, 1) for p in t.get("parents", [])]
        if t.get("logon_types"):
            rows.append((key, f"logon_type IN {among(t['logon_types'])}", 0.3, 1))
        if t.get("ports"):
            rows.append((key, f"destination_port IN {among(t['ports'])}", 0.2, 1))
    return rows


PATTERN_HITS = ("ev AS (" + " UNION ALL ".join(
    f"SELECT event_key, {k}, {w} AS w, {e} AS e FROM se WHERE {c}" for k, c, w, e in _evidence_rows()) +
    "), ph AS (SELECT event_key, id, name, tactic, least(sum(CAST(w AS DOUBLE)), 1.0) AS confidence, sum(e) AS n_evidence "
    "FROM ev GROUP BY ALL HAVING sum(CAST(w AS DECIMAL(6, 2))) >= 0.3)")


@query("pattern_techniques", f"WITH {se()}, {PATTERN_HITS} SELECT event_key, id, name, tactic, {r6('confidence')} AS "
       f"confidence, {big('n_evidence')} AS n_evidence FROM ph")
def pattern_techniques(spark, sf):
    return matching.explode_techniques(matching.stage_texts(events(spark, sf), "cmd", "proc", "parent"), matching.pattern_techniques(True),
                                       ["event_key"]).select(
        "event_key", "id", "name", "tactic", r("confidence").alias("confidence"), b(F.size("evidence")).alias("n_evidence"))


_TAGS = " UNION ".join(
    f"SELECT event_key, {lit(t)} AS technique FROM tt WHERE {any_word('txt', ws)}" + (
        f" OR event_id IN {among(ids)}" if ids else "") for t, ws, ids in A.SCENARIO_TAGS)


@query("scenario_tags", f"WITH {se()}, tt AS (SELECT event_key, event_id, lower(concat(command_line, ' ', process_name)) "
       f"AS txt FROM se) {_TAGS}")
def scenario_tags(spark, sf):
    return events(spark, sf).select("event_key", F.explode(matching.scenario_tags()).alias("technique"))


_CARD_WORDS = {}
for _i, _n, _t, _d, _s, _m in A.TECHNIQUE_CARDS:
    for _w in dict.fromkeys(w for w in "".join(ch if ch.isalnum() else " " for ch in _n.lower()).split() if len(w) > 3):
        _CARD_WORDS.setdefault(_i, (_n, _t, []))[2].append(_w)
for _i, _extra in {"T1059": ["powershell", "hidden"], "T1053": ["schtasks", "create", "onstart"],
                   "T1048": ["badhost", "payload"], "T1204": ["chrome.exe", "https"]}.items():
    _CARD_WORDS[_i][2].extend(_extra)
_XVALUES = ", ".join(f"({lit(i)}, {lit(n)}, {lit(t)}, {lit(k)})" for i, (n, t, ks) in _CARD_WORDS.items() for k in ks)


def card_catalogue(spark):
    """Extended catalogue in the shape the bundle reader builds: id, name, tactic, keywords."""
    return spark.createDataFrame([(i, n, t, ks) for i, (n, t, ks) in _CARD_WORDS.items()],
                                 "id string, name string, tactic string, keywords array<string>")


EXTENDED_HITS = ("xt AS (SELECT event_key, lower(concat_ws(' ', command_line, process_name, script_block_text)) AS txt FROM se), "
                 f"cat(id, name, tactic, kw) AS (VALUES {_XVALUES}), xh AS (SELECT event_key, id, name, tactic, least(count(*) / 5.0, 1.0) AS "
                 "confidence FROM xt JOIN cat ON contains(txt, kw) GROUP BY ALL HAVING count(*) >= 2), xk AS (SELECT * FROM xh QUALIFY "
                 "row_number() OVER (PARTITION BY event_key ORDER BY confidence DESC, id) <= 10)")
MERGED = ("mo(id, o) AS (VALUES " + ", ".join(f"({lit(t['id'])}, {k})" for k, t in enumerate(A.PATTERN_TECHNIQUES)) + "), mg AS (SELECT event_key, id, "
          "confidence, false AS ext, o FROM ph JOIN mo USING (id) UNION ALL SELECT xk.event_key, xk.id, CAST(xk.confidence AS DOUBLE), true, 0 FROM xk "
          "ANTI JOIN ph USING (event_key, id))")


@query("extended_techniques", f"WITH {se()}, {EXTENDED_HITS} SELECT event_key, id, name, tactic, {r6('confidence')} AS confidence FROM xk")
def extended_techniques(spark, sf):
    return matching.extended_techniques(events(spark, sf), card_catalogue(spark), "event_key").select(
        "event_key", "id", "name", "tactic", r("confidence").alias("confidence"))


@query("merged_techniques", f"WITH {se()}, {PATTERN_HITS}, {EXTENDED_HITS}, {MERGED} SELECT event_key, id, {r6('confidence')} AS confidence, ext AS "
       "extended, row_number() OVER (PARTITION BY event_key ORDER BY round(confidence, 6) DESC, ext, o, id) AS place FROM mg")
def merged_techniques(spark, sf):
    """Pattern techniques and the extended ones that are not among them, in order of confidence."""
    rows = materialise(matching.stage_texts(events(spark, sf), "cmd", "proc", "parent").select(
        "event_key", "command_line", "process_name", "script_block_text", matching.pattern_techniques(True).alias("matched")))
    both = matching.with_extended(rows, card_catalogue(spark))
    merged = matching.merged_techniques(F.col("matched"), F.col("extended"))
    return both.select("event_key", F.posexplode(merged).alias("pos", "t")).select(
        "event_key", "t.id", r("t.confidence").alias("confidence"), "t.extended", b(F.col("pos") + 1).alias("place"))


@query("technique_lookup", "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT c.id, "
       "c.name, n.event_type, n.n FROM n, (VALUES ('T1048', 'Exfiltration Over Alternative Protocol'), ('T1071', "
       "'Application Layer Protocol')) AS c(id, name)")
def technique_lookup(spark, sf):
    """Cards that mention 'protocol', beside the event counts they explain."""
    cards = matching.lookup_technique(matching.technique_cards(spark), keyword="protocol").select("id", "name")
    counts = events(spark, sf, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    two = F.array(*[F.struct(F.lit(x["id"]).alias("id"), F.lit(x["name"]).alias("name")) for x in cards.collect()])
    return counts.select("event_type", "n", F.explode(two).alias("c")).select("c.id", "c.name", "event_type", "n")


# ---------------------------------------------------------------- baselines and labels
_KB = "lower(concat(command_line, ' ', process_name))"


@query("keyword_baseline", f"WITH {se()}, t AS (SELECT event_key, event_id, {_KB} AS x FROM se) SELECT event_key, CASE WHEN "
       f"{any_word('x', D.BASELINE_CRITICAL + D.BASELINE_HIGH)} OR event_id IN {among(D.BASELINE_IDS)} THEN 1 ELSE 0 END "
       f"AS pred, CAST(CASE WHEN {any_word('x', D.BASELINE_CRITICAL)} THEN 0.95 WHEN {any_word('x', D.BASELINE_HIGH)} THEN "
       f"0.8 WHEN event_id IN {among(D.BASELINE_IDS)} THEN 0.65 ELSE 0.9 END AS DOUBLE) AS confidence FROM t")
def keyword_baseline(spark, sf):
    pred, conf = scoring.keyword_baseline()
    return events(spark, sf).select("event_key", pred.alias("pred"), conf.alias("confidence"))


_BOOST = "greatest(0.0, " + ", ".join(f"CASE WHEN contains({_KB}, {lit(w)}) THEN {v} ELSE 0.0 END" for w, v in
                                      D.FUSION_WEIGHTS) + ")"


@query("pattern_fusion", f"WITH {se()} SELECT event_key, {r6(f'least(1.0, score * 0.7 + {_BOOST} * 0.3)')} AS fused FROM se")
def pattern_fusion(spark, sf):
    return events(spark, sf).select("event_key", r(scoring.pattern_fusion(F.col("score"))).alias("fused"))


_TT = "lower(concat_ws(' ', command_line, process_name, parent_image))"


@query("tier_labels", f"WITH {se()}, t AS (SELECT event_key, command_line, {_TT} AS x, source_type = 'sysmon' AS sample FROM "
       "se) SELECT event_key, CASE " + " ".join(
           f"WHEN {any_regex('x', L.TIERS_SHORT[c])} THEN {lit(c)}" for c in (
               "malicious_critical", "malicious_high", "suspicious_medium")) +
       f" WHEN {any_regex('x', L.TIERS_SHORT['suspicious_low'])} THEN CASE WHEN sample THEN 'suspicious_low' ELSE 'benign' "
       "END WHEN sample AND command_line <> '' THEN 'suspicious_low' ELSE 'benign' END AS class FROM t")
def tier_labels(spark, sf):
    return events(spark, sf).select("event_key", scoring.tier_label(
        attack_sample=F.col("source_type") == "sysmon").alias("class"))


# sigma-like patterns: (level, pattern); the last one does not compile and counts as a substring
_SIGMA = [("critical", "sekurlsa.*"), ("high", ".*-enc .*"), ("high", "vssadmin.*shadows"), ("medium", "whoami.*/priv"),
          ("low", "https://.*/home"), ("low", "psexec 10.")]


@query("sigma_class", f"WITH {se()}, t AS (SELECT event_key, {_TT} AS x FROM se) SELECT event_key, CASE " + " ".join(
    f"WHEN regexp_matches(x, {lit(p)}) THEN {lit(L.LEVEL_CLASS[lv])}" for lv in L.LEVEL_ORDER for l2, p in _SIGMA
    if l2 == lv) + " END AS class FROM t")
def sigma_class(spark, sf):
    rules = spark.createDataFrame(_SIGMA, "level string, pattern string")
    return events(spark, sf).select("event_key", matching.sigma_class(rules).alias("class"))


@query("address_tests", f"WITH {se('event_key', 'source_ip', 'destination_ip')} SELECT event_key, "
       f"{any_prefix('source_ip', D.PRIVATE_PREFIXES_IOC)} AS ioc_private, regexp_matches(source_ip, "
       "'^(10[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]168[.]|127[.])') AS rfc_private, destination_ip <> '' AND "
       "NOT regexp_matches(destination_ip, '^(10[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]168[.]|127[.])') AS dst_external, "
       f"{_INT('destination_ip')} AS dst_internal FROM se")
def address_tests(spark, sf):
    return events(spark, sf, "event_key", "source_ip", "destination_ip").select(
        "event_key", net.private_for_iocs("source_ip").alias("ioc_private"),
        net.private_rfc1918("source_ip").alias("rfc_private"), net.external_address("destination_ip").alias("dst_external"),
        net.internal_v4("destination_ip").alias("dst_internal"))


# ---------------------------------------------------------------- texts
def _part(label, c):
    return f"CASE WHEN {c} <> '' THEN concat({lit(label)}, {c}) END"


@query("event_text", f"WITH {se()} SELECT event_key, concat_ws(' | ', concat('Event ID ', CAST(event_id AS STRING)), "
       f"{_part('Type: ', 'event_type')}, {_part('Process: ', 'process_name')}, CASE WHEN command_line <> '' THEN "
       "concat('Command: ', substring(command_line, 1, 500)) END, " + _part('Parent: ', 'parent_image') + ", " +
       _part('User: ', '"user"') + ", CASE WHEN destination_ip <> '' THEN concat('Destination: ', destination_ip, ':', "
       "CAST(destination_port AS STRING)) END) AS txt, md5(concat_ws(chr(10), concat('  Event ID: ', CAST(event_id AS "
       "STRING)), " + ", ".join(_part(f'  {k}: ', f'"{c}"') for k, c in [
           ("Event Type", "event_type"), ("Process", "process_name"), ("Command Line", "command_line"),
           ("Parent Process", "parent_image"), ("User", "user"), ("Hostname", "hostname"), ("Channel", "channel")]) +
       ", concat('  Logon Type: ', CAST(logon_type AS STRING)), concat('  Source IP: ', source_ip), concat('  Destination "
       "Port: ', CAST(destination_port AS STRING)))) AS summary_md5 FROM se")
def event_text(spark, sf):
    return events(spark, sf).select("event_key", scoring.event_text().alias("txt"), F.md5(
        scoring.event_summary()).alias("summary_md5"))


@query("inferred_types", f"WITH {se('event_id')} SELECT CASE event_id " + " ".join(
    f"WHEN {k} THEN {lit(v)}" for k, v in A.EVENT_TYPE_BY_ID.items()) + " ELSE 'unknown' END AS kind, count(*) AS n FROM se "
    "GROUP BY 1")
def inferred_types(spark, sf):
    return events(spark, sf, "event_id").groupBy(scoring.inferred_type(F.col("event_id")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


@query("log_search", f"WITH {se()} SELECT event_key, hostname, event_id FROM se WHERE event_id = 4625 AND "
       "contains(lower(hostname), 'ws-00') AND contains(lower(concat_ws('|', command_line, process_name, parent_image, "
       "query_name, message, script_block_text, image_loaded)), 'psexec') ORDER BY event_key LIMIT 10")
def log_search(spark, sf):
    return scoring.search_events(events(spark, sf), keyword="psexec", event_id="4625", hostname="WS-00").select(
        "event_key", "hostname", "event_id")


@query("collector_flags", f"WITH {se()}, t AS (SELECT event_key, lower(concat_ws(' ', command_line, script_block_text, "
       f"service_file)) AS x, lower(process_name) AS p, action FROM se) SELECT event_key, {any_word('x', D.COLLECTOR_KEYWORDS)} "
       f"OR {any_word('p', D.COLLECTOR_PROCESSES)} OR action IN ('logon_failure', 'service_installed') AS suspicious FROM t")
def collector_flags(spark, sf):
    return events(spark, sf).select("event_key", scoring.collector_suspicious().alias("suspicious"))


_MET = "m AS (SELECT event_id AS event_key, value / 4.0 AS cpu_percent, 60 + value / 8.0 AS memory_percent, 70 + value / 10.0 AS disk_percent FROM events)"


@query("metric_anomalies", f"WITH {_MET} SELECT event_key, CAST((cpu_percent > 70) AS INT) + CAST((memory_percent > 80) AS INT) "
       "+ CAST((disk_percent > 85) AS INT) AS anomaly_count, CASE WHEN disk_percent > 95 THEN 'critical' WHEN disk_percent > "
       "85 THEN 'warning' WHEN memory_percent > 90 THEN 'critical' WHEN memory_percent > 80 THEN 'warning' WHEN cpu_percent > "
       "90 THEN 'critical' WHEN cpu_percent > 70 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN cpu_percent <= 70 AND "
       "memory_percent <= 80 AND disk_percent <= 85 THEN 'None' ELSE concat_ws(', ', CASE WHEN cpu_percent > 90 THEN "
       "'Critical CPU (>90%)' WHEN cpu_percent > 70 THEN 'High CPU (>70%)' END, CASE WHEN memory_percent > 90 THEN "
       "'Critical Memory (>90%)' WHEN memory_percent > 80 THEN 'High Memory (>80%)' END, CASE WHEN disk_percent > 95 THEN "
       "'Disk full (>95%)' WHEN disk_percent > 85 THEN 'Disk filling (>85%)' END) END AS anomalies FROM m")
def metric_anomalies(spark, sf):
    m = events(spark, sf, "event_key", "value").select(
        "event_key", (F.col("value") / 4.0).alias("cpu_percent"), (60 + F.col("value") / 8.0).alias("memory_percent"),
        (70 + F.col("value") / 10.0).alias("disk_percent"))
    return scoring.metric_anomalies(m).select("event_key", "anomaly_count", "severity", "anomalies")


# ---------------------------------------------------------------- assessment
_SIG = (f"{se()}, {PATTERN_HITS}, {TEXTS}, mt AS (SELECT event_key, count(*) AS n, count(DISTINCT tactic) AS tactics, "
        "max(confidence) AS mx, bool_or(tactic = 'lateral_movement') AS lat, bool_or(tactic = 'credential_access') AS cred, "
        "bool_or(tactic = 'impact') AS imp, count(CASE WHEN confidence >= 0.3 THEN 1 END) AS strong FROM ph GROUP BY 1), "
        "s AS (SELECT se.event_key, score AS ml, score >= 0.5 AS bad, source_ip LIKE '185.220.%' AS has_ioc, "
        "starts_with(source_ip, '185.220.101.1') AS ioc_bad, event_type, coalesce(n, 0) AS n, tactics, mx, coalesce(lat, "
        "false) AS lat, coalesce(cred, false) AS cred, coalesce(imp, false) AS imp, coalesce(strong, 0) AS strong, "
        "command_line FROM se LEFT JOIN mt USING (event_key)), "
        "a AS (SELECT *, event_type IN ('click', 'error') AS has_agent, CASE event_type WHEN 'click' THEN 0.05 ELSE 1.0 END * "
        "0.9 AS agent, CASE WHEN has_ioc THEN CASE WHEN ioc_bad THEN least(0.8 * 1.15, 1.0) ELSE 0.2 END ELSE 0 END AS ioc, "
        "CASE WHEN n > 0 THEN least(mx + least(tactics * 0.05, 0.25) + CASE WHEN cred AND lat THEN 0.2 ELSE 0 END + CASE WHEN "
        "imp THEN 0.15 ELSE 0 END, 1.0) ELSE 0 END AS mitre FROM s), "
        "wt AS (SELECT *, 0.35 + CASE WHEN has_ioc THEN 0.30 ELSE 0 END + CASE WHEN n > 0 THEN 0.20 ELSE 0 END + CASE WHEN "
        "has_agent THEN 0.15 ELSE 0 END AS tw FROM a), "
        "b0 AS (SELECT *, CAST(100 * (0.35 * ml + CASE WHEN has_ioc THEN 0.30 * ioc ELSE 0 END + CASE WHEN n > 0 THEN 0.20 * "
        "mitre ELSE 0 END + CASE WHEN has_agent THEN 0.15 * agent ELSE 0 END) / tw AS DOUBLE) AS s0 FROM wt), "
        "b1 AS (SELECT *, CASE WHEN has_ioc AND ioc_bad AND s0 < 85 THEN 85 ELSE s0 END AS s1 FROM b0), "
        "b2 AS (SELECT *, CASE WHEN bad AND contains(lower(command_line), 'sekurlsa') AND s1 < 80 THEN 80 ELSE s1 END AS s2 "
        "FROM b1), b3 AS (SELECT *, CASE WHEN lat AND cred AND s2 < 65 THEN 65 ELSE s2 END AS s3 FROM b2), "
        "b4 AS (SELECT *, CASE WHEN imp AND s3 < 65 THEN 65 ELSE s3 END AS s4 FROM b3), "
        "b5 AS (SELECT *, CASE WHEN bad AND has_ioc AND ioc_bad AND event_type = 'error' THEN least(s4 + least(s4 * 0.1, 10), "
        "100) ELSE s4 END AS s5, bad AND has_ioc AND ioc_bad AND event_type = 'error' AS f5 FROM b4), "
        "b6 AS (SELECT *, CASE WHEN event_type = 'click' AND ml < 0.6 AND s5 > 25 THEN 25 ELSE s5 END AS s6 FROM b5), "
        "b7 AS (SELECT *, CASE WHEN event_type = 'click' AND has_ioc AND NOT ioc_bad AND ml BETWEEN 0.5 AND 0.7 AND s6 > 40 "
        "THEN 40 ELSE s6 END AS s7, (s1 <> s0 OR s2 <> s1 OR s3 <> s2 OR s4 <> s3 OR f5 OR s6 <> s5) AS fired FROM b6), "
        "b8 AS (SELECT *, fired OR s7 <> s6 AS any_rule, 1 + CAST(has_ioc AS INT) + CAST(n > 0 AS INT) + CAST(has_agent AS "
        "INT) AS n_src, CAST(bad AS INT) + CAST(has_ioc AND ioc_bad AS INT) + CAST(strong >= 3 AS INT) + CAST(event_type = "
        "'error' AS INT) AS n_agree FROM b7), "
        "b9 AS (SELECT *, CASE WHEN round(s7, 1) >= 85 THEN 'critical' WHEN round(s7, 1) >= 65 THEN 'high' WHEN round(s7, 1) >= "
        "45 THEN 'medium' WHEN round(s7, 1) >= 25 THEN 'low' ELSE 'info' END AS severity, CASE WHEN n_src >= 3 AND n_agree / n_src >= 0.67 THEN 'high' WHEN n_src "
        ">= 2 AND (n_agree / n_src >= 0.5 OR any_rule) THEN 'medium' ELSE 'low' END AS level FROM b8)")


def signals(spark, sf):
    """Events with the four signals: the given score, an address verdict, the matched patterns, a verdict by type."""
    ev = matching.stage_texts(events(spark, sf), "cmd", "proc", "parent").withColumn("_techniques", pin(
        matching.pattern_techniques(True)))
    bad_ip = F.startswith("source_ip", F.lit("185.220.101.1"))
    agent = lambda v: F.struct(F.lit(v).alias("verdict"), F.lit(0.9).alias("confidence"),
                               F.array(F.lit("search_logs")).alias("tools_used"), F.lit(3).alias("reasoning_steps"))
    return ev.withColumns({
        "ml": assess.ml_signal(F.col("score"), F.col("score") >= 0.5, nz("command_line"), loaded=True),
        "ioc": F.when(F.startswith("source_ip", F.lit("185.220.")), F.struct(
            F.when(bad_ip, 0.8).otherwise(0.2).alias("score"), bad_ip.alias("is_malicious"),
            F.when(bad_ip, F.array(F.lit("VirusTotal"), F.lit("local"))).otherwise(F.array().cast("array<string>")).alias(
                "providers_hit"), F.lit(1).alias("indicator_count"))),
        "mitre": pin(assess.mitre_signal(F.col("_techniques"))),
        "agent": F.when(F.col("event_type") == "click", agent("FALSE_POSITIVE")).when(
            F.col("event_type") == "error", agent("MALICIOUS"))})


_ACT = "CASE concat(severity, '/', level) " + " ".join(f"WHEN {lit(f'{s}/{c}')} THEN {lit(a)}" for (s, c), a in
                                                    N.ACTIONS.items()) + " END"


@query("threat_assessment", f"WITH {_SIG} SELECT event_key, {r6('s0')} AS base_points, severity, level AS confidence_level, "
       f"{big('n_src')} AS n_sources, {big('n_agree')} AS n_agreeing, any_rule AS arbitrated, {_ACT} AS "
       "recommended_action FROM b9")
def threat_assessment(spark, sf):
    out = assess.assess(signals(spark, sf))
    return out.select("event_key", r("base_points").alias("base_points"), "severity", "confidence_level",
                      b(F.size("sources_available")).alias("n_sources"), b(F.size("sources_agreeing")).alias("n_agreeing"),
                      (F.size("arbitration_rules") > 0).alias("arbitrated"), "recommended_action")


@query("score_explained", "WITH t AS (SELECT event_id AS event_key, least(value / 3.0, 100.0) AS s FROM events), u AS (SELECT "
       "*, CASE WHEN s >= 85 THEN 'critical' WHEN s >= 65 THEN 'high' WHEN s >= 45 THEN 'medium' WHEN s >= 25 THEN 'low' "
       "ELSE 'info' END AS severity FROM t) SELECT event_key, severity, CASE severity " + " ".join(
           f"WHEN {lit(s)} THEN {lit(rg)}" for s, (rg, _) in N.BAND_TEXT.items()) + " END AS severity_range, " + ", ".join(
           f"CASE severity " + " ".join(f"WHEN {lit(s)} THEN {lit(N.ACTIONS[(s, k)])}" for s in N.BAND_TEXT) +
           f" END AS action_{k}" for k in ("high", "medium", "low")) + " FROM u")
def score_explained(spark, sf):
    t = events(spark, sf, "event_key", "value").withColumn("s", F.least(F.col("value") / 3.0, F.lit(100.0)))
    return assess.explain_score(t, "s").select("event_key", "severity", "severity_range", "action_high", "action_medium",
                                               "action_low")


_CH = "list_filter(string_split(command_line, ''), lambda c: c <> '')"


@query("text_statistics", f"WITH {se('event_key', 'command_line')}, t AS (SELECT event_key, command_line, {_CH} AS ch FROM se) "
       "SELECT event_key, round(coalesce(list_sum(list_transform(list_distinct(ch), lambda d: -(len(list_filter(ch, lambda c: "
       "c = d)) / len(ch)) * log2(len(list_filter(ch, lambda c: c = d)) / len(ch)))), 0.0), 6) AS entropy, CASE WHEN "
       "len(ch) > 0 THEN round(len(list_distinct(ch)) / len(ch), 6) END AS unique_ratio FROM t")
def text_statistics(spark, sf):
    return events(spark, sf, "event_key", "command_line").select(
        "event_key", r(shannon_entropy("command_line")).alias("entropy"), r(unique_ratio("command_line")).alias(
            "unique_ratio"))


