"""Text and JSON reports of the second investigator, one row per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ioc import confidence_b, context_b
from tidewatch.functions.text import joined, listed, percent
from tidewatch.operators.ordered import join_grown, top_per_key
from tidewatch.rules import attack as A
from tidewatch.rules import incident as N

# Summary sentences by incident type; %d takes the number of hosts.
SUMMARIES = {
    "ransomware": "A ransomware attack has been detected affecting %d system(s). The attack shows indicators of file "
                  "encryption and system recovery inhibition. Immediate containment is required.",
    "credential_theft": "Credential theft activity detected on %d system(s). Attackers may have compromised user "
                        "credentials. Password reset and MFA enforcement recommended.",
    "lateral_movement": "Lateral movement detected across %d hosts. Attackers are actively spreading through the "
                        "network. Network segmentation and isolation required.",
    "data_exfiltration": "Data exfiltration indicators found. Sensitive data may have been transferred outside the "
                         "network. Egress traffic review and data scope assessment needed.",
    "command_and_control": "Command and control (C2) activity detected on %d host(s). Systems may be under remote "
                           "attacker control. Block C2 indicators and isolate affected systems.",
    "malware": "Malware activity detected on %d system(s). Malicious code execution observed. Containment and forensic "
               "analysis required.",
    "persistence": "Persistence mechanisms established on %d system(s). Attackers have created backdoors for continued "
                   "access. Complete remediation of persistence mechanisms required.",
}
LEVEL_ICON = {"critical": "[!!!]", "high": "[!!]", "medium": "[!]", "low": "[.]", "informational": "[i]"}
LEVEL_MARK = {"critical": "[CRIT]", "high": "[HIGH]", "medium": "[MED ]", "low": "[LOW ]", "informational": "[INFO]"}


def _map(table: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def incident_iocs_b(tl: DataFrame) -> DataFrame:
    """Distinct indicators of shown events with confidence and context, first sighting kept."""
    long = tl.where("shown").select("incident_id", "event_ts", "event_key", F.posexplode("iocs").alias("pos", "i"))
    first = long.groupBy("incident_id", F.col("i.type").alias("type"), F.col("i.value").alias("value")).agg(
        F.min(F.struct("event_ts", "event_key", "pos")).alias("s"))
    return first.withColumns({"confidence": confidence_b(F.col("type"), F.col("value")),
                              "context": context_b(F.col("type"))})


def findings(df: DataFrame) -> DataFrame:
    """Adds key_findings and recommended_actions to rolled-up incidents joined with first_ips, first_domains, hashes."""
    c, lit = F.col, F.lit
    kind = c("incident_type")
    n = lambda x: F.coalesce(c(x), lit(0))
    found = listed(
        (lit(True), F.concat(lit("Incident classified as "), F.upper(kind))),
        (n("cr") > 0, F.concat(n("cr").cast("string"), lit(" critical severity events detected"))),
        (F.size("technique_ids") > 0, F.concat(lit("Primary attack techniques: "), joined(F.slice(
            "technique_ids", 1, 3)))),
        (c("hosts") > 1, F.concat(lit("Attack spread across "), c("hosts").cast("string"), lit(
            " hosts (lateral movement likely)"))),
        (n("rows_shown") >= 2, F.concat(lit("Attack timeline: "), c("first_ts").cast("string"), lit(" to "),
                                        c("last_ts").cast("string"))))
    by_type = F.create_map(*[x for k, v in N.TYPE_ACTIONS.items() for x in (lit(k), F.array(*[lit(a) for a in v]))])
    none = F.array().cast("array<string>")
    actions = F.concat(
        F.array(lit("Isolate affected systems from network")), F.coalesce(by_type[kind], none),
        listed((F.size("first_ips") > 0, F.concat(lit("Block IP addresses: "), joined(c("first_ips")))),
               (F.size("first_domains") > 0, F.concat(lit("Block domains: "), joined(c("first_domains")))),
               (c("n_hashes") > 0, "Add file hashes to EDR blocklist")))
    return df.withColumns({"key_findings": found, "recommended_actions": actions})


def investigation_report(rolled: DataFrame, tl: DataFrame) -> DataFrame:
    """(incident_id, report, report_json). The text shows 20 timeline rows and ten indicators per type and says how many more
    there are; the JSON has all of both. Techniques come in tactic order."""
    lit, c = F.lit, F.col
    iocs = incident_iocs_b(tl)
    order = [F.desc("confidence"), c("s"), c("value")]
    ranked = iocs.withColumn("rn", F.row_number().over(Window.partitionBy("incident_id", "type").orderBy(*order)))
    rows = ranked.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("type", "rn", "value", "confidence",
                                                                                  "context"))).alias("ioc_rows"))
    counts = iocs.groupBy("incident_id").agg(F.count(lit(1)).alias("n_iocs"), F.count_if(F.startswith(
        "type", lit("hash_"))).alias("n_hashes"))
    firsts = lambda t, name: top_per_key(iocs.where(c("type") == t), ["incident_id"], order, 5).groupBy(
        "incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))),
                                       lambda s: s["value"]).alias(name))
    numbered_rows = tl.where("shown").withColumn("rn", F.row_number().over(Window.partitionBy("incident_id").orderBy("event_ts", "event_key")))
    top = numbered_rows.groupBy(
        "incident_id").agg(F.array_sort(F.collect_list(F.struct(
            "rn", c("event_ts").cast("string").alias("timestamp"), "hostname", "severity", "process_name", "user",
            "confidence", "label", F.transform("techniques", lambda t: F.struct(
                t["id"].alias("id"), t["name"].alias("name"), t["tactic"].alias("tactic"))).alias("mitre_techniques"),
            "iocs"))).alias("entries"))
    none = F.array().cast("array<string>")
    df = rolled
    for part in (rows, counts, firsts("ip", "first_ips"), firsts("domain", "first_domains"), top):
        df = join_grown(df, part, "incident_id", "left")
    df = findings(df.withColumns({"first_ips": F.coalesce("first_ips", none), "first_domains": F.coalesce(
        "first_domains", none), "n_iocs": F.coalesce("n_iocs", lit(0)), "n_hashes": F.coalesce("n_hashes", lit(0))}))
    rule = "=" * 80
    summary = F
    for k, text in SUMMARIES.items():
        summary = summary.when(c("incident_type") == k, F.format_string(text, c("hosts")) if "%d" in text else lit(text))
    summary = summary.otherwise(F.concat(
        F.format_string("Security incident detected affecting %d system(s). Threat level: ", c("hosts")), c("threat_level"),
        lit(". Investigation and response required.")))
    entry = lambda e: F.concat_ws(
        "\n", F.concat(lit("["), F.lpad(e["rn"].cast("string"), 2, "0"), lit("] "), e["timestamp"]),
        F.concat(lit("     Host: "), e["hostname"]),
        F.concat(lit("     "), _map(LEVEL_MARK)[e["severity"]], lit(" Process: "), e["process_name"], lit(" | User: "),
                 e["user"], lit(" | ("), e["label"], lit(", "), percent(e["confidence"]), lit(")")),
        F.when(F.size(e["mitre_techniques"]) > 0, F.concat(lit("     MITRE: "), joined(F.transform(
            e["mitre_techniques"], lambda t: t["id"])))),
        F.when(F.size(e["iocs"]) > 0, F.concat(lit("     IoCs: "), joined(F.transform(
            F.slice(e["iocs"], 1, 3), lambda i: F.concat(i["type"], lit(":"), F.substring(i["value"], 1, 30)))))))
    kinds = F.array_distinct(F.transform("ioc_rows", lambda x: x["type"]))
    of_kind = lambda k: F.size(F.filter("ioc_rows", lambda x: x["type"] == k))
    ioc_text = F.array_join(F.transform(kinds, lambda k: F.concat_ws("\n", F.concat(F.upper(k), lit(":")), F.array_join(
        F.transform(F.filter("ioc_rows", lambda x: (x["type"] == k) & (x["rn"] <= 10)), lambda x: F.concat(
            lit("  - "), x["value"], lit(" (confidence: "), percent(x["confidence"]), lit(")"))), "\n"), F.when(
                of_kind(k) > 10, F.concat(lit("  ... and "), (of_kind(k) - 10).cast("string"), lit(" more"))))), "\n")

    def tactic_block(name):
        techs = F.filter("ranked", lambda t: t["tactic"] == name)
        rows = F.transform(techs, lambda t: F.concat(lit("  - "), t["id"], lit(": "), t["name"], lit(" ("), percent(
            -t["c"]), lit(")")))
        return F.when(F.size(techs) > 0, F.concat_ws("\n", lit(name.upper().replace("_", " ") + ":"), F.array_join(
            rows, "\n")))

    tactics = F.array_compact(F.array(*[tactic_block(w) for w in A.TACTIC_REPORT_ORDER]))
    numbered = lambda arr: F.array_join(F.transform(arr, lambda a, i: F.concat(lit("  "), (i + 1).cast("string"), lit(". "),
                                                                             a)), "\n")
    field = lambda label, v: F.concat(lit(label), v)
    text = F.concat_ws(
        "\n", lit(rule), lit("                    CYBER INCIDENT INVESTIGATION REPORT"), lit(rule), lit(""),
        field("Incident ID:      ", c("incident_id")),
        F.concat(lit("Incident Type:    "), F.upper("incident_type"), lit(" ("), percent(c("type_confidence")), lit(
            " confidence)")),
        F.concat(lit("Threat Level:     "), _map(LEVEL_ICON)[c("threat_level")], lit(" "), F.upper("threat_level")),
        F.concat(lit("Threat Score:     "), c("threat_score").cast("string"), lit("/100")),
        field("Events Analyzed:  ", c("total_events").cast("string")),
        field("Malicious Events: ", F.coalesce("malicious_events", lit(0)).cast("string")),
        field("Hosts Affected:   ", c("hosts").cast("string")),
        field("Users Affected:   ", F.size("affected_users").cast("string")), lit(rule), lit("EXECUTIVE SUMMARY"),
        summary, lit("KEY FINDINGS:"), numbered("key_findings"), lit(rule), lit("ATTACK TIMELINE"),
        F.coalesce(F.array_join(F.transform(F.slice("entries", 1, 20), entry), "\n"), lit("No significant events in timeline.")),
        F.when(c("rows_shown") > 20, F.concat(lit("... and "), (c("rows_shown") - 20).cast("string"), lit(" more events"))),
        lit(rule),
        lit("INDICATORS OF COMPROMISE (IoCs)"), field("Total IoCs Extracted: ", c("n_iocs").cast("string")), ioc_text,
        lit(rule), lit("MITRE ATT&CK MAPPING"),
        field("Techniques Identified: ", F.size("technique_ids").cast("string")), F.array_join(tactics, "\n"), lit(rule),
        lit("RECOMMENDED ACTIONS"), lit("IMMEDIATE ACTIONS:"), numbered(F.slice("recommended_actions", 1, 5)), lit(rule))
    as_json = F.to_json(F.struct(
        "incident_id", "incident_type", F.round("type_confidence", 6).alias("incident_type_confidence"), "threat_level",
        "threat_score", "total_events", "malicious_events", "affected_users", "key_findings", "recommended_actions",
        F.transform("ranked", lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"), t["tactic"].alias(
            "tactic"), (-t["c"]).alias("confidence"))).alias("mitre_techniques"), c("ioc_rows").alias("iocs"),
        c("entries").alias("timeline")))
    return df.select("incident_id", text.alias("report"), as_json.alias("report_json"))


