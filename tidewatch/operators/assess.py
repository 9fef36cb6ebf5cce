"""Fusion of four optional signals into a 0-100 threat score, all as row arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import has_any, joined, listed, nz, percent
from tidewatch.rules import incident as N

ML_TYPE = "struct<score:double,is_malicious:boolean,reason:string,model_loaded:boolean>"
IOC_TYPE = "struct<score:double,is_malicious:boolean,providers_hit:array<string>,indicator_count:int>"
MITRE_TYPE = ("struct<techniques:array<struct<id:string,name:string,tactic:string,confidence:double>>,"
              "tactic_coverage:array<string>,max_confidence:double,has_lateral_movement:boolean,"
              "has_credential_access:boolean,has_impact:boolean>")
AGENT_TYPE = "struct<verdict:string,confidence:double,tools_used:array<string>,reasoning_steps:int>"
SIGNAL_TYPES = {"ml": ML_TYPE, "ioc": IOC_TYPE, "mitre": MITRE_TYPE, "agent": AGENT_TYPE}
SIGNALS = tuple(SIGNAL_TYPES)


def ml_signal(score: Column, malicious: Column, reason: Column, loaded: bool = False) -> Column:
    return F.struct(score.alias("score"), malicious.alias("is_malicious"), reason.alias("reason"),
                    F.lit(loaded).alias("model_loaded"))


def mitre_signal(techniques: Column) -> Column:
    """From pattern techniques; null when there are none."""
    tactics = F.array_distinct(F.transform(techniques, lambda t: t["tactic"]))
    return F.when(F.size(techniques) > 0, F.struct(
        F.transform(techniques, lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"),
                                                   t["tactic"].alias("tactic"), t["confidence"].alias("confidence"))
                    ).alias("techniques"),
        tactics.alias("tactic_coverage"),
        F.array_max(F.transform(techniques, lambda t: t["confidence"])).alias("max_confidence"),
        F.array_contains(tactics, "lateral_movement").alias("has_lateral_movement"),
        F.array_contains(tactics, "credential_access").alias("has_credential_access"),
        F.array_contains(tactics, "impact").alias("has_impact")))


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _is(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def band(score: Column) -> Column:
    out = F
    for floor, name in N.BANDS:
        out = out.when(score >= floor, name)
    return out.otherwise("info")


def recommended_action(severity: Column, confidence: Column) -> Column:
    """Fifteen fixed pairs, default on a miss."""
    table = F.create_map(*[F.lit(x) for (s, c), a in N.ACTIONS.items() for x in (f"{s}/{c}", a)])
    return F.coalesce(F.element_at(table, F.concat(severity, F.lit("/"), confidence)), F.lit(N.DEFAULT_ACTION))


def assess(df: DataFrame) -> DataFrame:
    """Needs nullable struct columns ml, ioc, mitre, agent (missing ones are taken as absent); adds the assessment."""
    for name, kind in SIGNAL_TYPES.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    verdict = F.upper(nz("agent.verdict"))
    hits, techs, tactics = (F.coalesce(F.size(x), F.lit(0)) for x in (
        "ioc.providers_hit", "mitre.techniques", F.array_distinct("mitre.tactic_coverage")))
    present = {"ml": c("ml").isNotNull(), "ioc": c("ioc").isNotNull(), "mitre": c("mitre").isNotNull() & (techs > 0),
               "agent": c("agent").isNotNull()}
    cred, lat, impact = (_is(f"mitre.{n}") for n in ("has_credential_access", "has_lateral_movement", "has_impact"))
    verdict_score = F
    for name, v in N.VERDICT_SCORE.items():
        verdict_score = verdict_score.when(verdict == name, v)
    spoken = verdict_score.otherwise(0.3) * F.least(c("agent.confidence"), F.lit(1.0))
    raw = {
        "ml": _unit(c("ml.score") * F.when(c("ml.model_loaded"), 1.0).otherwise(0.7)),
        "ioc": _unit(F.when(hits >= 2, F.least(c("ioc.score") * 1.15, F.lit(1.0))).otherwise(c("ioc.score"))),
        "mitre": F.least(c("mitre.max_confidence") + F.least(tactics * 0.05, F.lit(0.25))
                         + F.when(cred & lat, 0.20).otherwise(0.0) + F.when(impact, 0.15).otherwise(0.0), F.lit(1.0)),
        "agent": _unit(F.when(c("agent.reasoning_steps") >= 5, F.least(spoken * 1.1, F.lit(1.0))).otherwise(spoken)),
    }
    out = df.withColumns({f"_r_{s}": F.when(present[s], raw[s]).otherwise(0.0) for s in SIGNALS} | {
        f"_w_{s}": F.when(present[s], N.SIGNAL_WEIGHT[s]).otherwise(0.0) for s in SIGNALS})
    total = sum((c(f"_w_{s}") for s in SIGNALS), F.lit(0.0))
    share = lambda s: F.when(c("_total") > 0, c(f"_w_{s}") / c("_total")).otherwise(0.0)
    out = out.withColumn("_total", total)
    out = out.withColumn("base_points", sum((share(s) * c(f"_r_{s}") for s in SIGNALS), F.lit(0.0)) * 100)
    out = _arbitrate(out, verdict, hits, cred & lat, impact)
    strong = F.coalesce(F.size(F.filter("mitre.techniques", lambda t: t["confidence"] >= 0.3)), F.lit(0)) >= 3
    agree = {"ml": _is("ml.is_malicious"), "ioc": _is("ioc.is_malicious"), "mitre": strong,
             "agent": verdict.isin("MALICIOUS", "SUSPICIOUS")}
    out = out.withColumns({"sources_available": listed(*[(present[s], s) for s in SIGNALS]),
                           "sources_agreeing": listed(*[(agree[s], s) for s in SIGNALS])})
    n, k = F.size("sources_available"), F.size("sources_agreeing")
    ratio = k / F.greatest(n, F.lit(1))
    level = (F.when((n >= 3) & (ratio >= 0.67), "high")
             .when((n >= 2) & ((ratio >= 0.5) | (F.size("arbitration_rules") > 0)), "medium").otherwise("low"))
    out = out.withColumns({"severity": band(c("final_score")), "confidence_level": level,
                           **{f"{s}_contribution": F.round(share(s) * c(f"_r_{s}") * 100, 1) for s in SIGNALS}})
    out = out.withColumn("recommended_action", recommended_action(c("severity"), c("confidence_level")))
    out = out.withColumns({"explanation": _explanation(), "explanation_trace": _trace()})
    return out.drop(*[x for x in out.columns if x.startswith(("_r_", "_w_"))], "_total")


def _arbitrate(df: DataFrame, verdict: Column, hits: Column, combo: Column, impact: Column) -> DataFrame:
    """R1-R4 lift to a floor only from below it, R5 adds a bonus, R6 and R7 cap; each sees the score before it."""
    c = F.col
    bad_ioc, bad_ml = _is("ioc.is_malicious"), _is("ml.is_malicious")
    denied = verdict == "FALSE_POSITIVE"
    floors = [("R1", bad_ioc & (hits >= 2), 85.0),
              ("R2", bad_ml & has_any(F.lower(nz("ml.reason")), N.CREDENTIAL_REASON_WORDS), 80.0),
              ("R3", combo, 65.0), ("R4", impact, 65.0)]
    out, score = df, "base_points"
    rules: list[tuple[Column, Column]] = []
    for name, cond, floor in floors:
        out = out.withColumn(f"_hit_{name}", F.coalesce(cond, F.lit(False)) & (c(score) < floor))
        out = out.withColumn(f"_s_{name}", F.when(c(f"_hit_{name}"), floor).otherwise(c(score)))
        score = f"_s_{name}"
        rules.append((c(f"_hit_{name}"), F.lit(N.RULE_TEXT[name])))
    votes = bad_ml.cast("int") + bad_ioc.cast("int") + (verdict == "MALICIOUS").cast("int")
    bonus = F.least(c(score) * 0.10, F.lit(10.0))
    out = out.withColumns({"_votes": votes, "_bonus": bonus})
    out = out.withColumn("_s_R5", F.when(c("_votes") >= 3, F.least(c(score) + c("_bonus"), F.lit(100.0))).otherwise(
        c(score)))
    rules.append((c("_votes") >= 3, F.format_string(N.RULE_TEXT["R5"], c("_votes"), c("_bonus"))))
    ml = c("ml.score")
    caps = [("R6", denied & (c("agent.confidence") >= 0.7) & (ml < 0.6), 25.0),
            ("R7", c("ioc").isNotNull() & ~bad_ioc & denied & ml.between(0.5, 0.7), 40.0)]
    score = "_s_R5"
    for name, cond, cap in caps:
        out = out.withColumn(f"_hit_{name}", F.coalesce(cond, F.lit(False)) & (c(score) > cap))
        out = out.withColumn(f"_s_{name}", F.when(c(f"_hit_{name}"), cap).otherwise(c(score)))
        score = f"_s_{name}"
        rules.append((c(f"_hit_{name}"), F.lit(N.RULE_TEXT[name])))
    out = out.withColumns({"arbitration_rules": listed(*rules), "final_score": F.round(c(score), 1)})
    return out.drop(*[x for x in out.columns if x.startswith(("_hit_", "_s_R"))], "_votes", "_bonus")


def _explanation() -> Column:
    c, lit = F.col, F.lit
    cat = F.concat
    some = lambda arr, empty: F.when(F.size(arr) > 0, joined(arr)).otherwise(empty)
    reason = nz("ml.reason")
    ml = cat(lit("• ML Classifier: "), F.when(_is("ml.is_malicious"), "MALICIOUS").otherwise("BENIGN"), lit(" ("),
             percent(c("ml.score")), lit(" confidence)"), F.when(c("ml.model_loaded"), "").otherwise(
                 " [heuristic fallback]"), F.when(reason != "", cat(lit(" — "), reason)).otherwise(""))
    ioc = cat(lit("• IoC Lookup: "), F.when(_is("ioc.is_malicious"), "MALICIOUS").otherwise("CLEAN"), lit(" (score="),
              percent(c("ioc.score")), lit(", via "), some(c("ioc.providers_hit"), "no providers"), lit(")"))
    top = F.transform(F.slice("mitre.techniques", 1, 3), lambda t: F.concat_ws(" ", t["id"], t["name"]))
    mitre = cat(lit("• MITRE ATT&CK: "), F.size("mitre.techniques").cast("string"), lit(" techniques matched ["),
                joined(F.slice("mitre.tactic_coverage", 1, 3)), lit("] — "), joined(top))
    agent = cat(lit("• Agent Analysis: "), c("agent.verdict"), lit(" (confidence="), percent(c("agent.confidence")),
                lit(", tools="), F.size("agent.tools_used").cast("string"), lit(", steps="),
                c("agent.reasoning_steps").cast("string"), lit(")"))
    return F.concat_ws(
        "\n", cat(lit("Threat Assessment: "), F.upper("severity"), lit(" (score="),
                  F.format_string("%.0f", c("final_score")), lit("/100)")),
        F.when(c("ml").isNotNull(), ml), F.when(c("ioc").isNotNull(), ioc),
        F.when(F.size("mitre.techniques") > 0, mitre), F.when(c("agent").isNotNull(), agent),
        F.when(F.size("arbitration_rules") > 0, cat(lit("• Arbitration rules fired: "), joined(
            c("arbitration_rules"), "; "))),
        F.when(F.size("sources_agreeing") >= 2, cat(lit("• Consensus: "), joined(c("sources_agreeing")),
                                                    lit(" sources agree on malicious verdict"))))


def _trace() -> Column:
    """Step log: normalised signals, base score, fired rules, final line."""
    c = F.col
    signal = lambda s, label: F.when(F.array_contains("sources_available", s), F.format_string(
        f"{label}: %.2f", c(f"_r_{s}"))).otherwise(f"{label}: not available (skipped)")
    return F.concat(
        F.array(signal("ml", "ML"), signal("ioc", "IoC"), signal("mitre", "MITRE"), signal("agent", "Agent"),
                F.format_string("Base weighted score: %.1f / 100", c("base_points"))),
        F.transform("arbitration_rules", lambda r: F.concat(F.lit("Arbitration "), r)),
        F.array(F.concat(F.format_string("Final score: %.1f", c("final_score")), F.lit(" → severity="), c("severity"),
                         F.lit(", confidence="), c("confidence_level"))))


def explain_score(df: DataFrame, score: str) -> DataFrame:
    """Severity, range, description and the three actions for a 0-100 score."""
    texts = F.create_map(*[x for s, (r, d) in N.BAND_TEXT.items() for x in (
        F.lit(s), F.struct(F.lit(r).alias("range"), F.lit(d).alias("description")))])
    sev = band(F.col(score))
    return df.withColumns({
        "severity": sev, "severity_range": texts[sev]["range"], "description": texts[sev]["description"],
        **{f"action_{k}": recommended_action(sev, F.lit(k)) for k in ("high", "medium", "low")}})
