"""Investigation reports as rows (incident_id, section, line_no, text): an incident of any length never meets in one task.

Only the timeline grows with the events. Its line numbers are running sums of the entries' lines, taken minute by minute and
offset; the sections before and after it are short arrays of the incident's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import joined, percent
from tidewatch.operators.incidents import incident_iocs, top_iocs
from tidewatch.operators.ordered import join_grown, running_total
from tidewatch.rules import incident as N

RULE, DASH = "=" * 70, "-" * 70
IOCS_PER_TYPE = 10


def _lines(section: str, *parts: Column | str) -> Column:
    """array<struct<section, text>> of single lines; a part that is an array gives its lines."""
    arrays = []
    for p in parts:
        c = F.lit(p) if isinstance(p, str) else p[0] if isinstance(p, list) else p
        arrays.append(c if isinstance(p, list) else F.array(c))
    return F.transform(F.concat(*arrays), lambda t: F.struct(F.lit(section).alias("section"), t.alias("text")))


def _titled(section: str, title: str, *parts) -> Column:
    return _lines(section, DASH, title, DASH, *parts)


def _head() -> Column:
    field = lambda label, c: F.concat(F.lit(label), c)
    return F.concat(
        _lines("header", RULE, "INCIDENT INVESTIGATION REPORT", RULE, field("Incident ID:     ", F.col("incident_id")),
               field("Host:            ", F.col("host")), field("Severity:        ", F.upper("severity")),
               field("Confidence:      ", percent(F.col("confidence"))), "Status:          investigating",
               field("Classification:  ", F.col("classification")), field("Created:         ", F.col("created_at").cast("string")), ""),
        _titled("classification", "CLASSIFICATION", F.col("classification"), ""),
        _titled("timeline", "ATTACK TIMELINE"))


def _tail() -> Column:
    """Everything behind the timeline. Needs ioc_rows (ten per type) and, where there is one, the analysis."""
    c, lit = F.col, F.lit
    none = F.array().cast("array<struct<section:string,text:string>>")
    kinds = F.array_distinct(F.transform("ioc_rows", lambda r: r["type"]))
    iocs = F.flatten(F.transform(kinds, lambda k: F.concat(
        F.array(F.concat(lit("  ["), F.upper(k), lit("]"))),
        F.transform(F.filter("ioc_rows", lambda r: r["type"] == k),
                    lambda r: F.concat(lit("    - "), r["value"], lit(" ("), r["context"], lit(")"))))))
    techniques = F.flatten(F.transform("techniques", lambda t: F.array(
        F.concat(lit("  "), t["id"], lit(" - "), t["name"]), F.concat(lit("    Tactic: "), t["tactic"]))))
    advice = F.transform("recommendations", lambda r, i: F.concat(lit("  "), (i + 1).cast("string"), lit(". "), r))
    told = lambda part, name: F.coalesce(F.when(part, name), none)
    agent = F.concat(
        _titled("agent", "AI AGENT INVESTIGATION", F.concat(lit("  Verdict:    "), F.coalesce("verdict", lit("N/A"))),
                F.concat(lit("  Confidence: "), percent(F.coalesce("agent_confidence", lit(0.0)))),
                F.concat(lit("  Tools used: "), joined(F.coalesce("tools_used", F.array().cast("array<string>")))),
                F.concat(lit("  ReAct steps: "), F.coalesce("steps", lit(0)).cast("string"))),
        told(F.col("summary") != "", _lines("agent", "", "  Summary:", [F.transform(F.split("summary", "\n"), lambda s: F.concat(lit("    "), s))])),
        _lines("agent", ""))
    return F.concat(
        told(c("n_iocs") > 0, _titled("indicators", "INDICATORS OF COMPROMISE (IoCs)", [iocs], "")),
        told(c("n_techniques") > 0, _titled("techniques", "MITRE ATT&CK MAPPING", [techniques], "")),
        _titled("root cause", "ROOT CAUSE ANALYSIS", F.concat(lit("  "), c("root_cause")), ""),
        _titled("impact", "IMPACT ASSESSMENT", F.concat(lit("  "), c("impact_assessment")),
                F.concat(lit("  Affected hosts: "), joined(c("affected_hosts"))),
                F.concat(lit("  Affected users: "), joined(c("affected_users"))), ""),
        _titled("response", "RECOMMENDED RESPONSE", [advice]),
        told(c("analysed"), agent),
        told(c("incident_summary") != "", _titled("summary", "INCIDENT SUMMARY", F.concat(lit("  "), c("incident_summary")), "")),
        _lines("end", "", RULE))


def entry_lines(tl: DataFrame) -> DataFrame:
    """Timeline entries with their lines."""
    lit, c = F.lit, F.col
    icon = F.create_map(*[lit(x) for kv in N.SEVERITY_ICON.items() for x in kv])
    ioc_texts = F.transform(F.slice("iocs", 1, 3), lambda i: F.concat_ws(":", i["type"], i["value"]))
    lines = F.array_compact(F.array(
        F.concat(lit("  "), c("timestamp"), lit("  "), icon[c("severity")], lit(" ["), c("phase"), lit("]")),
        F.concat(lit("    "), c("description")),
        F.when(F.size("techniques") > 0, F.concat(lit("    MITRE: "), joined(F.transform("techniques", lambda t: t["id"])))),
        F.when(F.size("iocs") > 0, F.concat(lit("    IoCs: "), joined(ioc_texts))), lit("")))
    return tl.select("incident_id", "event_ts", "event_key", lines.alias("lines"))


def report_rows(incidents: DataFrame, tl: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """(incident_id, section, line_no, text): the full report of every incident, every timeline entry included.

    `analyses`: agent results, one row per incident: incident_id, verdict, agent_confidence, summary, tools_used, steps,
    incident_summary; any of them may be null, and incidents without a row have no such sections.
    """
    entries = entry_lines(tl).withColumn("size", F.size("lines"))
    numbered = running_total(entries, ["incident_id"], ["event_ts", "event_key"], "size", "before")
    length = entries.groupBy("incident_id").agg(F.sum("size").alias("timeline_lines"))
    # the timeline begins behind a fixed number of lines, so its entries never join the incidents
    first = 19
    timeline = numbered.select("incident_id", F.lit("timeline").alias("section"), "before", F.posexplode("lines").alias("pos", "text")).select(
        "incident_id", "section", (F.lit(first + 1) + F.col("before") + F.col("pos")).alias("line_no"), "text")
    told = {"verdict": "string", "agent_confidence": "double", "summary": "string", "tools_used": "array<string>", "steps": "int",
            "incident_summary": "string"}
    df = join_grown(join_grown(incidents, length, "incident_id"), top_iocs(incident_iocs(tl), IOCS_PER_TYPE, None), "incident_id", "left")
    if analyses is None:
        df = df.withColumns({"analysed": F.lit(False)} | {c: F.lit(None).cast(t) for c, t in told.items()})
    else:
        side = analyses.select("incident_id", *[F.col(c).cast(t).alias(c) if c in analyses.columns else F.lit(None).cast(t).alias(c)
                                                for c, t in told.items()], F.lit(True).alias("analysed"))
        df = join_grown(df, side, "incident_id", "left")
    head = df.select("incident_id", F.posexplode(_head()).alias("pos", "line")).select(
        "incident_id", "line.section", (F.col("pos") + 1).cast("long").alias("line_no"), "line.text")
    tail = df.select("incident_id", "timeline_lines", F.posexplode(_tail()).alias("pos", "line")).select(
        "incident_id", "line.section", (F.lit(first + 1) + F.col("timeline_lines") + F.col("pos")).alias("line_no"), "line.text")
    return head.unionByName(timeline).unionByName(tail)


def write_report_files(rows: DataFrame, path: str) -> None:
    """One JSON line per report line, by incident and line number inside each file."""
    rows.repartitionByRange("incident_id", "line_no").sortWithinPartitions("incident_id", "line_no").write.mode("errorifexists").json(path)
