"""Row-level scoring rules: extra indicators, heuristics, routing, labels, texts. No shuffle anywhere here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.net import outside_logon
from tidewatch.functions.text import (
    any_of, basename, count_hits, cut, filled, has, has_any, is_encoded_command, joined, listed, low, nz,
    percent, pin, safe_int, search, starts_any)
from tidewatch.operators.features import LEGACY16, TEXT, detector_texts, legacy16
from tidewatch.rules import attack as A
from tidewatch.rules import detection as D
from tidewatch.rules import incident as N
from tidewatch.rules import labels as L


def _t(name: str) -> Column:
    return F.col(TEXT + name)


def _when(cases: list[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """Ordered first match."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(default)


# ---------------------------------------------------------------- extra indicators
def extra_indicators(df: DataFrame, staged: bool = False) -> DataFrame:
    """Adds adv_score (capped at 1) and adv_reasons; a `staged` input already carries the shared texts, which stay."""
    d = df if staged else detector_texts(df)
    image, query, every, eid, logon, port, proc = (_t(n) for n in ("image", "query", "all", "eid", "logon", "port",
                                                                    "proc"))
    unsigned = F.col("signed").isin("", "false")
    risky_dir = has_any(image, D.SIDELOAD_PATHS)
    original, shown = basename(low("original_filename")), basename(proc)
    renamed = (original != "") & (shown != "") & (original != shown) & has_any(original, D.PROCESSES)
    parts = F.split(query, r"\.")
    dns_hit = any_of(search(query, p) for p in D.DNS_PATTERNS)
    long_part = F.exists(parts, lambda p: F.length(p) > 20)
    head = F.element_at(parts, 1)
    digits, letters = F.length(F.regexp_replace(head, r"\D", "")), F.length(F.regexp_replace(head, r"[^a-z]", ""))
    mixed = (~dns_hit & ~long_part & (F.size(parts) >= 3) & (F.length(head) > 8) & (digits > 0) & (letters > 0)
             & (digits / F.length(head) > 0.2))
    fileless = F.when(F.length(nz("script_block_text")) > 50, count_hits(_t("script"), D.FILELESS_MARKS)).otherwise(0)
    evasion = search(nz("command_line"), "%[a-zA-Z]+%") & search(nz("command_line"), r"(?i)set\s+\w+=")
    loud = starts_any(nz("destination_ip"), D.PRIVATE_PREFIXES_LOGON + ["0."])
    no = F.coalesce(unsigned, F.lit(False))
    rows: list[tuple[Column, Column | float, Column | str]] = [
        (renamed, 0.6, F.concat(F.lit("renamed binary ("), original, F.lit(" -> "), shown, F.lit(")"))),
        (risky_dir & no, 0.55, "unsigned DLL from suspicious path"),
        (risky_dir & ~no, 0.3, "DLL from suspicious path"),
        (dns_hit, 0.6, F.concat(F.lit("DNS exfil pattern: "), cut(query, 50))),
        (long_part, 0.4, "long DNS subdomain label (data encoding)"),
        (mixed, 0.5, F.concat(F.lit("high-entropy DNS subdomain: "), cut(head, 30))),
        (eid == 4698, 0.4, "scheduled task created (4698)"),
        ((eid == 4698) & has_any(every, D.TASK_BOOT_MARKS), 0.15, "task runs as SYSTEM/on boot"),
        (eid == 7045, 0.45, "new service installed (7045)"),
        (logon == 9, 0.4, "NewCredentials logon (token theft)"),
        ((logon == 10) & outside_logon("source_ip"), 0.35,
         F.concat(F.lit("external RDP from "), nz("source_ip"))),
        (evasion, 0.35, "environment variable evasion"),
        (fileless >= 2, F.least(fileless, F.lit(4)) * 0.2,
         F.concat(F.lit("fileless indicators in script ("), fileless.cast("string"), F.lit(" hits)"))),
        ((eid == 3) & port.isin(D.CALLBACK_PORTS), 0.45,
         F.concat(F.lit("connection to C2 port "), port.cast("string"))),
        ((eid == 3) & filled("destination_ip") & ~loud & has_any(proc, D.OUTBOUND_PROCESSES), 0.35,
         F.concat(F.lit("outbound from LOLBin to "), nz("destination_ip"))),
        (has(proc, "wmiprvse") & (has(_t("parent"), "svchost") | (_t("parent") == "")), 0.4,
         "WMI provider execution (lateral movement indicator)"),
        (eid == 4648, 0.35, "explicit credential use (4648)"),
        ((eid == 7) & (image != "") & ~risky_dir & no, 0.25, "unsigned DLL loaded"),
    ]
    points = [F.when(c, F.lit(p) if isinstance(p, float) else p).otherwise(0.0) for c, p, _ in rows]
    total = points[0]
    for p in points[1:]:
        total = total + p
    out = d.withColumns({"adv_score": pin(F.least(total, F.lit(1.0))),
                         "adv_reasons": listed(*[(c, r) for c, _, r in rows])})
    return out if staged else out.drop(*[c for c in out.columns if c.startswith(TEXT)])


# ---------------------------------------------------------------- heuristics
def heuristic16(f: dict[str, Column]) -> tuple[Column, Column]:
    """Score and reasons from the 16 named features."""
    kw = f["keyword_count"]
    as_int = lambda c: c.cast("int").cast("string")
    rows = [
        (kw > 0, F.least(kw, F.lit(4.0)) * 0.25, F.concat(as_int(kw), F.lit(" suspicious keywords"))),
        (f["suspicious_process"] > 0, 0.15, "LOLBin"), (f["has_base64"] > 0, 0.2, "base64"),
        (f["has_download"] > 0, 0.15, "download"), (f["has_hidden"] > 0, 0.15, "hidden"),
        (f["parent_suspicious"] > 0, 0.1, "suspicious parent"),
        (f["high_risk_event"] > 0, 0.05, F.concat(F.lit("high-risk event "), as_int(f["event_id_value"]))),
        (f["remote_logon"] > 0, 0.1, "remote logon"),
        (f["c2_port"] > 0, 0.2, F.concat(F.lit("C2 port "), as_int(f["dest_port_value"]))),
    ]
    total = F.lit(0.0)
    for c, p, _ in rows:
        total = total + F.when(c, F.lit(p) if isinstance(p, float) else p).otherwise(0.0)
    return F.least(total, F.lit(1.0)), listed(*[(c, r) for c, _, r in rows])


def score_events(df: DataFrame, threshold: float = 0.5, base_score: str | None = None) -> DataFrame:
    """Final event score: base_score, adv_score, ml_score, is_malicious, ml_reason.

    The base is the 16-feature heuristic, or a model probability column when one is named.
    """
    scored = extra_indicators(detector_texts(df), staged=True)
    if base_score is None:
        wide = legacy16(scored, prefix="_f_", staged=True)
        base, reasons = heuristic16({n: F.col("_f_" + n) for n in LEGACY16})
        wide = wide.withColumns({"base_score": pin(base), "_reasons": reasons})
        text = F.when(F.size("_reasons") > 0, F.concat(F.lit("Heuristic: "), joined(F.col("_reasons")))).otherwise(
            "No indicators")
    else:
        wide = scored.withColumns({"base_score": F.col(base_score), "_reasons": F.lit(None)})
        text = F.lit("model")
    both = (F.col("base_score") + F.col("adv_score")) * 0.7
    out = wide.withColumns({
        "ml_score": pin(F.least(F.greatest("base_score", "adv_score", both), F.lit(1.0))),
        "ml_reason": F.when(F.size("adv_reasons") > 0, F.concat(text, F.lit(" + "), joined(F.col("adv_reasons"))))
        .otherwise(text)})
    out = out.withColumn("is_malicious", F.col("ml_score") >= threshold)
    return out.drop("_reasons", *[c for c in out.columns if c.startswith(("_f_", TEXT))])


def legacy_reason(f: dict[str, Column], p: Column) -> Column:
    kw = f["keyword_count"]
    parts = listed(
        (kw > 0, F.concat(kw.cast("int").cast("string"), F.lit(" malicious keywords"))),
        (f["suspicious_process"] > 0, "LOLBin process"), (f["has_base64"] > 0, "base64 encoded"),
        (f["has_download"] > 0, "download command"), (f["has_hidden"] > 0, "hidden window"),
        (f["parent_suspicious"] > 0, "suspicious parent"),
        (f["c2_port"] > 0, F.concat(F.lit("C2 port "), f["dest_port_value"].cast("int").cast("string"))))
    return _reason_text("ML-v1", p, parts, "pattern match")


def v3_reason(f: dict[str, Column], p: Column) -> Column:
    """Explains by feature name, so it also serves layouts where the positions differ."""
    kw = F.floor(f["kw_count_norm"] * 5).cast("int")
    parts = listed(
        (f["kw_count_norm"] > 0, F.concat(kw.cast("string"), F.lit(" suspicious keyword(s)"))),
        ((f["susp_process_exact"] > 0) | (f["susp_process_partial"] > 0), "suspicious process"),
        (f["base64_encoded"] > 0, "base64/encoded"), (f["lsass_credential"] > 0, "credential access"),
        (f["powershell_bypass"] > 0, "PowerShell bypass"), (f["network_download"] > 0, "network download"),
        (f["persistence"] > 0, "persistence"), (f["defense_evasion"] > 0, "defense evasion"),
        (f["lateral_movement"] > 0, "lateral movement"), (f["suspicious_port"] > 0, "C2 port"),
        (f["suspicious_parent"] > 0, "Office/browser parent"), (f["registry_op"] > 0, "registry op"),
        (f["driver_load"] > 0, "driver load"), (f["process_injection"] > 0, "process injection"),
        (f["high_entropy_cmdline"] > 0, "high-entropy cmdline"))
    return _reason_text("ML-v3", p, parts, "event-type match")


def _reason_text(tag: str, p: Column, parts: Column, empty: str) -> Column:
    return F.concat(F.lit(f"{tag} ("), percent(p), F.lit("): "),
                    F.when(F.size(parts) > 0, joined(parts)).otherwise(empty))


def heuristic18(f: dict[str, Column], compat: bool = True) -> tuple[Column, Column, Column, Column]:
    """(p, label, confidence, explanation) over the 18-feature layout.

    With `compat` the rules read the positions the original read: position 5 is the bypass flag, 3 the encoding flag,
    6 the command length, 7-9 network, persistence and evasion, 15 the script length.
    """
    names = ("has_ps_bypass_flags", "has_base64_encoding", "cmdline_length_norm", "has_network_indicators",
             "has_persistence_indicators", "has_defense_evasion", "script_length_norm")
    if not compat:
        names = ("suspicious_keyword_count", "is_suspicious_process", "has_base64_encoding", "has_network_indicators",
                 "has_persistence_indicators", "has_suspicious_parent", "has_c2_indicators")
    kw, lol, enc, down, hidden, parent, port = (f[n] for n in names)
    rows = [(kw > 0, F.least(kw, F.lit(4.0)) * 0.2, F.concat(kw.cast("int").cast("string"),
                                                           F.lit(" suspicious keywords"))),
            (lol > 0, 0.15, "LOLBin"), (enc > 0, 0.2, "base64"), (down > 0, 0.15, "download"),
            (hidden > 0, 0.15, "hidden"), (parent > 0, 0.1, "suspicious parent"), (port > 0, 0.15, "C2 port")]
    total = F.lit(0.0)
    for c, p, _ in rows:
        total = total + F.when(c, F.lit(p) if isinstance(p, float) else p).otherwise(0.0)
    p = F.least(total, F.lit(1.0))
    label = F.when(p >= 0.5, "malicious").otherwise("benign")
    parts = listed(*[(c, r) for c, _, r in rows])
    text = F.when(F.size(parts) > 0, F.concat(F.lit("Heuristic: "), joined(parts))).otherwise("No indicators")
    return p, label, F.when(p >= 0.5, p).otherwise(1 - p), text


# ---------------------------------------------------------------- predicates and routing
def is_anomalous(staged: bool = False) -> Column:
    """Signs that open the deep path; `staged` reads the lower-case texts that `route` computes once per row."""
    cmd, script, proc = (F.col(f"_a_{c}") if staged else low(c) for c in ("command_line", "script_block_text",
                                                                         "process_name"))
    eid = safe_int("event_id")
    tool = has_any(proc, D.ANOMALY_PROCESSES) & ((F.length(cmd) > 100) | has_any(cmd, D.ANOMALY_CONTEXT))
    outside = filled("source_ip") & ~starts_any(nz("source_ip"), ["10.", "192.168.", "172."])
    return (has_any(cmd, D.ANOMALY_KEYWORDS) | has_any(script, D.ANOMALY_KEYWORDS) | tool | (eid == 7045)
            | ((eid == 4104) & (F.length(script) > 200)) | ((eid == 4625) & outside)
            | (safe_int("logon_type").isin(3, 10) & outside_logon("source_ip")))


def route(df: DataFrame, benign: float = 0.5, certain: float = 0.8) -> DataFrame:
    """Adds `path` (fast/deep) and `classification` (benign/malicious) to scored events."""
    s = F.col("ml_score")
    texts = ("command_line", "script_block_text", "process_name")
    staged = df.withColumns({f"_a_{c}": pin(low(c)) for c in texts})
    deep = (s >= benign) & (s < certain) & is_anomalous(staged=True)
    return staged.withColumns({"classification": F.when(s >= benign, "malicious").otherwise("benign"),
                               "path": F.when(deep, "deep").otherwise("fast")}).drop(*[f"_a_{c}" for c in texts])


def should_forward(severity: Column) -> Column:
    return severity.isin("critical", "high", "medium")


def confidence_band(p: Column) -> Column:
    return F.when(p >= 0.8, "HIGH").when(p >= 0.6, "MEDIUM").when(p >= 0.5, "LOW").otherwise("BENIGN")


def event_severity(p: Column) -> Column:
    return (F.when(p >= 0.8, "critical").when(p >= 0.6, "high").when(p >= 0.4, "medium").when(p >= 0.2, "low")
            .otherwise("info"))


def classified_severity(label: Column, confidence: Column, command: Column) -> Column:
    """Severity of a classified event; benign is informational, some commands are critical outright."""
    return (F.when(label == "benign", "informational")
            .when(any_of(search(F.lower(command), p) for p in A.CRITICAL_COMMANDS), "critical")
            .when(confidence >= 0.85, "critical").when(confidence >= 0.7, "high").when(confidence >= 0.5, "medium")
            .otherwise("low"))


def on_timeline(label: Column, confidence: Column) -> Column:
    return ~((label == "benign") & (confidence > 0.7))


# ---------------------------------------------------------------- baselines and labels
def keyword_baseline() -> tuple[Column, Column]:
    """(prediction, confidence) by keywords and event ids."""
    text = F.concat(low("command_line"), F.lit(" "), low("process_name"))
    crit, high, ids = (has_any(text, D.BASELINE_CRITICAL), has_any(text, D.BASELINE_HIGH),
                       safe_int("event_id").isin(D.BASELINE_IDS))
    return (F.when(crit | high | ids, 1).otherwise(0),
            F.when(crit, 0.95).when(high, 0.80).when(ids, 0.65).otherwise(0.90))


def pattern_fusion(p: Column) -> Column:
    """0.7 of the model probability plus 0.3 of the heaviest matching pattern."""
    text = F.concat(low("command_line"), F.lit(" "), low("process_name"))
    boost = F.greatest(*[F.when(has(text, w), v).otherwise(0.0) for w, v in D.FUSION_WEIGHTS])
    return F.least(F.lit(1.0), p * 0.70 + boost * 0.30)


def tier_label(rule_class: Column | None = None, attack_sample: Column | None = None) -> Column:
    """Five-class label by regex tiers, over an optional rule-derived class that wins."""
    text = F.concat_ws(" ", low("command_line"), low("process_name"), low("parent_image"))
    sample = attack_sample if attack_sample is not None else nz("source_type").isin(L.ATTACK_SOURCES)
    tiers = [(search(text, "|".join(L.TIERS_SHORT[c])), c) for c in
             ("malicious_critical", "malicious_high", "suspicious_medium")]
    weak = search(text, "|".join(L.TIERS_SHORT["suspicious_low"]))
    body = _when(tiers + [(weak & sample, "suspicious_low"), (weak, "benign"),
                          (sample & filled("command_line"), "suspicious_low")], "benign")
    return F.coalesce(rule_class, body) if rule_class is not None else body


def auto_label(df: DataFrame) -> DataFrame:
    """Binary label and its reason over unified rows; null and 'uncertain' when no rule speaks."""
    cmd, proc, threat, file = low("command_line"), low("process_name"), low("threat_name"), low("file_path")
    uid, euid, eid = nz("linux_uid"), nz("linux_euid"), F.coalesce(F.col("raw_eid"), F.lit(0))
    cases = [
        (F.col("label") == 1, 1, "kaspersky_detection"),
        (low("detection_result").isin("disinfected", "deleted"), 1, "kaspersky_disinfected"),
        (has_any(cmd, ["sekurlsa", "logonpasswords"]), 1, "rule_lsass_dump"),
        (has_any(cmd, ["lsadump::dcsync", "lsadump::sam"]), 1, "rule_dcsync"),
        (has(cmd, "delete shadows") & has(proc, "vssadmin"), 1, "rule_vss_delete"),
        (has(cmd, "recoveryenabled no") & has(proc, "bcdedit"), 1, "rule_bcdedit_recovery"),
        (is_encoded_command(cmd) & has(proc, "powershell"), 1, "rule_ps_base64"),
        (has_any(cmd, ["-nop", "-noninteractive"]) & has(cmd, "-w hidden"), 1, "rule_ps_hidden"),
        (has_any(cmd, ["downloadstring", "downloadfile"]), 1, "rule_ps_download"),
        (has_any(cmd, ["iex(", " iex "]), 1, "rule_ps_iex"),
        (proc.isin([p for p in D.ENT_PROCESSES if p not in ("net.exe", "net1.exe")]), 1, "rule_susp_proc"),
        (has(proc, "certutil") & has_any(cmd, ["-decode", "-urlcache", "-encode"]), 1, "rule_certutil_abuse"),
        (has(proc, "mshta") & has_any(cmd, ["http://", "javascript:"]), 1, "rule_mshta_remote"),
        (has(proc, "regsvr32") & has(cmd, "/s") & has(cmd, "/u"), 1, "rule_regsvr32_scrobj"),
        (has_any(threat, ["trojan", "backdoor", "ransomware", "exploit", "worm"]), 1, "rule_kaspersky_threat"),
        ((eid == 4769) & F.col("ticket_encryption").isin("0x17", "0x18", "23", "24"), 1, "rule_kerberoasting"),
        (eid == 4648, 1, "rule_pass_the_hash"),
        ((uid != "0") & (euid == "0") & ~proc.isin("sudo", "su"), 1, "rule_linux_suid"),
        (starts_any(file, ["/tmp/", "/dev/shm/"]), 1, "rule_linux_tmp_exec"),
        (proc.isin(L.BENIGN_PROCESSES) & F.coalesce(F.col("process_signed"), F.lit(False))
         & ~has_any(cmd, ["base64", "encode", "-enc", "hidden"]), 0, "rule_known_signed_proc"),
        ((F.col("event_type") == "auth") & (F.col("logon_type") == "interactive")
         & (F.coalesce(F.col("severity"), F.lit("info")) == "info"), 0, "rule_normal_interactive_logon"),
        ((uid == "0") & proc.isin(L.LINUX_DAEMONS) & ~has_any(file, ["/tmp", "/dev/shm"]), 0, "rule_linux_daemon"),
    ]
    first = _when([(F.coalesce(c, F.lit(False)), F.struct(F.lit(y).alias("y"), F.lit(r).alias("r")))
                   for c, y, r in cases],
                  F.struct(F.lit(None).cast("int").alias("y"), F.lit("uncertain").alias("r")))
    return df.withColumn("_l", first).withColumns({"auto_label": F.col("_l.y"), "auto_reason": F.col("_l.r")}).drop("_l")


def binary_label(label: Column) -> Column:
    """Text, number or 'benign…' class name to 0/1."""
    text = F.lower(label.cast("string"))
    return F.coalesce(text.try_cast("int"), F.when(F.startswith(text, F.lit("benign")), 0).otherwise(1))


# ---------------------------------------------------------------- texts
def event_text(full: bool = True) -> Column:
    """Pipe-separated description used for embedding."""
    part = lambda label, c: F.when(filled(c), F.concat(F.lit(label), cut(nz(c), 500) if c == "command_line" else nz(c)))
    eid = F.when(nz("event_id").isin("", "0"), None).otherwise(F.concat(F.lit("Event ID "), nz("event_id")))
    port = safe_int("destination_port")
    where = F.when(filled("destination_ip"), F.concat(F.lit("Destination: "), nz("destination_ip"), F.when(
        port != 0, F.concat(F.lit(":"), port.cast("string"))).otherwise("")))
    parts = [eid]
    if full:
        parts.append(part("Type: ", "event_type"))
    parts += [part("Process: ", "process_name"), part("Command: ", "command_line"), part("Parent: ", "parent_image"),
              part("User: ", "user")]
    if full:
        parts.append(where)
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", "Unknown event").otherwise(text)


def event_summary() -> Column:
    """One line per field that carries something."""
    rows = [("Event ID", "event_id"), ("Event Type", "event_type"), ("Process", "process_name"),
            ("Command Line", "command_line"), ("Parent Process", "parent_image"), ("User", "user"),
            ("Hostname", "hostname"), ("Channel", "channel"), ("Logon Type", "logon_type"), ("Source IP", "source_ip"),
            ("Destination Port", "destination_port")]
    text = F.concat_ws("\n", *[F.when(~nz(c).isin("", "0"), F.concat(F.lit(f"  {k}: "), nz(c))) for k, c in rows])
    return F.when(text == "", "  (minimal event data)").otherwise(text)


def inferred_type(eid: Column) -> Column:
    return _when([(eid == k, F.lit(v)) for k, v in A.EVENT_TYPE_BY_ID.items()], "unknown")


def flow_text() -> Column:
    """Network flow as a sentence."""
    num = lambda c: F.format_string("%.0f", F.col(c))
    sent, recv = (F.coalesce(F.col(a), F.col(b), F.lit(0)) for a, b in (("src_bytes", "fwd_packets"),
                                                                          ("dst_bytes", "bwd_packets")))
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    return F.concat_ws(
        " ", F.concat(F.lit("Connection from "), name("source_ip"), F.lit(" to "), name("destination_ip")),
        F.when(some("destination_port"), F.concat(F.lit("destination port "), nz("destination_port"))),
        F.when(some("source_port"), F.concat(F.lit("source port "), nz("source_port"))),
        F.when(filled("protocol"), F.concat(F.lit("protocol "), nz("protocol"))),
        F.when(filled("service"), F.concat(F.lit("service "), nz("service"))),
        F.when((sent != 0) | (recv != 0), F.concat(F.lit("bytes sent "), sent.cast("string"), F.lit(" received "),
                                                    recv.cast("string"))),
        F.when(some("bytes_per_sec"), F.concat(F.lit("rate "), num("bytes_per_sec"), F.lit(" bytes/sec"))),
        F.when(some("packets_per_sec"), F.concat(num("packets_per_sec"), F.lit(" packets/sec"))))


def verdict(answer: Column) -> Column:
    """struct<verdict, confidence> from free text."""
    up = F.upper(answer)
    v = lambda name, c: F.struct(F.lit(name).alias("verdict"), F.lit(c).alias("confidence"))
    return _when([
        (has(up, "MALICIOUS") & has_any(up, ["NOT MALICIOUS", "NOT TRULY MALICIOUS"]), v("FALSE_POSITIVE", 0.7)),
        (has(up, "MALICIOUS"), v("MALICIOUS", 0.9)),
        (has_any(up, ["FALSE_POSITIVE", "FALSE POSITIVE"]), v("FALSE_POSITIVE", 0.8)),
        (has(up, "SUSPICIOUS"), v("SUSPICIOUS", 0.6)), (has(up, "BENIGN"), v("FALSE_POSITIVE", 0.7))],
        v("SUSPICIOUS", 0.5))


def enrich(df: DataFrame, assessed: bool = False, agent: bool = False) -> DataFrame:
    """Detection block, log level and message; with `assessed` the severity and score columns decide the level."""
    s = F.col("ml_score")
    level = (F.create_map(*[F.lit(x) for kv in N.LOG_LEVEL.items() for x in kv])[F.col("severity")] if assessed else
             F.when(s >= 0.8, "error").when(s >= 0.6, "warn").otherwise("info"))
    tag = F.concat(F.lit(" ["), F.upper("severity"), F.lit("]")) if assessed else F.lit("")
    process = F.coalesce(F.col("process_name"), F.lit("unknown"))
    tail = F.concat(F.lit("Agent: "), F.coalesce(F.col("agent.verdict"), F.lit("N/A")), F.lit(" - ")) if agent else F.lit(
        "")
    return df.withColumns({
        "ml_detection": F.struct(F.lit(True).alias("is_malicious"), percent(s, 1).alias("confidence"),
                                 F.col("ml_reason").alias("reason"), F.col("path").alias("path")),
        "level": F.coalesce(level, F.lit("warn")),
        "log_message": F.concat(F.lit("THREAT"), tag, F.lit(" ["), percent(s), F.lit("] "), process, F.lit(" - "), tail,
                                F.col("ml_reason"))})


def analysis_defaults(df: DataFrame) -> DataFrame:
    """Fill the standard analysis fields."""
    empty = F.array().cast("array<string>")
    defaults = {"threat_score": F.lit(0), "threat_level": F.lit("low"), "summary": F.lit("No threat detected"),
                "reasoning": F.lit(""), "indicators": empty, "recommended_actions": empty}
    return df.withColumns({
        c: F.coalesce(F.col(c).try_cast("int") if c == "threat_score" else F.col(c), d) if c in df.columns else d
        for c, d in defaults.items()})


# ---------------------------------------------------------------- collectors
def collector_suspicious() -> Column:
    text = F.concat_ws(" ", low("command_line"), low("script_block_text"), low("service_file"))
    return (has_any(text, D.COLLECTOR_KEYWORDS) | has_any(low("process_name"), D.COLLECTOR_PROCESSES)
            | nz("action").isin("logon_failure", "service_installed"))


def metric_anomalies(df: DataFrame, cpu: str = "cpu_percent", mem: str = "memory_percent",
                     disk: str = "disk_percent") -> DataFrame:
    """Threshold findings; the last metric that trips sets the severity."""
    c, m, d = F.col(cpu), F.col(mem), F.col(disk)
    found = listed((c > 90, "Critical CPU (>90%)"), ((c > 70) & (c <= 90), "High CPU (>70%)"),
                   (m > 90, "Critical Memory (>90%)"), ((m > 80) & (m <= 90), "High Memory (>80%)"),
                   (d > 95, "Disk full (>95%)"), ((d > 85) & (d <= 95), "Disk filling (>85%)"))
    sev = _when([(d > 95, "critical"), (d > 85, "warning"), (m > 90, "critical"), (m > 80, "warning"),
                 (c > 90, "critical"), (c > 70, "warning")], "info")
    return df.withColumn("_found", found).withColumns({
        "has_anomalies": F.size("_found") > 0,
        "anomalies": F.when(F.size("_found") > 0, joined(F.col("_found"))).otherwise("None"),
        "anomaly_count": F.size("_found"), "severity": sev,
        "message": F.format_string("CPU:%.1f%% MEM:%.1f%% DISK:%.1f%%", c, m, d)}).drop("_found")


def search_events(df: DataFrame, keyword: str = "", event_id: str = "", hostname: str = "", limit: int = 10,
                  arrival: str = "event_key") -> DataFrame:
    """Keyword over the whole record, exact event id, host substring; first matches in arrival order."""
    out = df
    if event_id:
        out = out.where(nz("event_id") == str(event_id))
    if hostname:
        out = out.where(has(low("hostname"), hostname.lower()))
    if keyword:
        record = F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        out = out.where(has(record, keyword.lower()))
    return out.orderBy(arrival).limit(limit)


