"""Phases, texts and action tables for incidents and assessments.

Fixed values.
"""

GAP_MINUTES = 30
CREDENTIAL, EXECUTION, PERSISTENCE, LATERAL = "Credential Access", "Execution", "Persistence", "Lateral Movement"
EVASION, C2, DISCOVERY, EXFIL = "Defense Evasion", "Command and Control", "Discovery", "Exfiltration"
INITIAL, UNKNOWN = "Initial Access", "Unknown"

PHASE_WORDS = {
    CREDENTIAL: ["mimikatz", "sekurlsa", "lsass", "procdump", "ntds"],
    EXECUTION: ["powershell", "invoke-", "iex", "-enc"],
    PERSISTENCE: ["schtasks", "sc create", "reg add", "onstart"],
    LATERAL: ["psexec", "winrs", "wmic process", "wmiprvse"],
    EVASION: ["bypass", "amsi", "hidden", "rundll32", "regsvr32"],
    C2: ["cobalt", "beacon", "meterpreter", "reverse"],
    DISCOVERY: ["whoami", "systeminfo", "ipconfig", "netstat", "nltest"],
}
CRITICAL_PHASES = [CREDENTIAL, EXFIL, LATERAL, C2]
PRIVILEGED_MARKS = ["ADMIN", "SYSTEM", "ROOT"]
SEVERITY_ICON = {"critical": "[!!!]", "high": "[!!]", "medium": "[!]", "low": "[.]", "info": "[i]"}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

# --- assessment --------------------------------------------------------------
SIGNAL_WEIGHT = {"ml": 0.35, "ioc": 0.30, "mitre": 0.20, "agent": 0.15}
VERDICT_SCORE = {"MALICIOUS": 1.0, "SUSPICIOUS": 0.6, "FALSE_POSITIVE": 0.05, "UNKNOWN": 0.3}
CREDENTIAL_REASON_WORDS = ["lsass", "sekurlsa", "credential", "dump"]
BANDS = [(85, "critical"), (65, "high"), (45, "medium"), (25, "low")]
BAND_TEXT = {
    "critical": ("85–100", "Immediate threat requiring emergency response"),
    "high": ("65–84", "Significant threat requiring analyst attention within 1 hour"),
    "medium": ("45–64", "Suspicious activity warranting investigation within business hours"),
    "low": ("25–44", "Low-confidence indicator, monitor for recurrence"),
    "info": ("0–24", "Informational event, likely benign"),
}
ACTIONS = {
    ("critical", "high"): "IMMEDIATE: Isolate host, escalate to SOC L3, preserve forensics",
    ("critical", "medium"): "URGENT: Escalate to SOC L2, begin containment, verify with analyst",
    ("critical", "low"): "URGENT: Manual review required — high severity but limited signal confidence",
    ("high", "high"): "ESCALATE: Assign incident to analyst within 1 hour",
    ("high", "medium"): "ESCALATE: Review within 1 hour, begin timeline reconstruction",
    ("high", "low"): "REVIEW: Gather additional context before escalation",
    ("medium", "high"): "INVESTIGATE: Standard investigation within business hours",
    ("medium", "medium"): "MONITOR: Watch for additional indicators",
    ("medium", "low"): "MONITOR: Low confidence — collect more telemetry",
    ("low", "high"): "LOG: Record and monitor for pattern",
    ("low", "medium"): "LOG: No immediate action required",
    ("low", "low"): "LOG: Likely false positive — verify rule quality",
    ("info", "high"): "IGNORE: Clean event, no action needed",
    ("info", "medium"): "IGNORE: Probably benign",
    ("info", "low"): "IGNORE: Insufficient signal",
}
DEFAULT_ACTION = "REVIEW: Manual assessment recommended"
LOG_LEVEL = {"critical": "error", "high": "error", "medium": "warn", "low": "info", "info": "info"}
RULE_TEXT = {
    "R1": "R1: ≥2 IoC providers confirmed malicious → score forced ≥85 (CRITICAL)",
    "R2": "R2: credential dump detected in ML reason → score ≥80",
    "R3": "R3: lateral_movement + credential_access combo → score ≥65 (HIGH)",
    "R4": "R4: MITRE impact tactic active → score ≥65",
    "R5": "R5: all %d sources agree → +%.1f bonus",
    "R6": "R6: Agent HIGH_CONFIDENCE FALSE_POSITIVE + ML < 0.6 → score capped at 25 (LOW)",
    "R7": "R7: IoC clean + Agent FP + ML uncertain → score capped at 40",
}

# --- second investigator -----------------------------------------------------
TYPE_ACTIONS = {
    "ransomware": ["Check backup integrity before restoration", "Block shadow copy deletion commands",
                   "Scan for ransom notes and encrypted files"],
    "credential_theft": ["Reset all potentially compromised credentials", "Enable MFA on all accounts",
                         "Review privileged account access"],
    "lateral_movement": ["Segment network to limit spread", "Disable RDP where not required",
                         "Review remote access policies"],
    "data_exfiltration": ["Identify exfiltrated data scope", "Review data loss prevention policies",
                          "Enable egress traffic monitoring"],
    "command_and_control": ["Block identified C2 indicators", "Review DNS logs for beaconing",
                            "Implement DNS sinkholing"],
}
