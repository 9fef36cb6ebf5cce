"""Label vocabularies, tactic and attack maps, regex tiers and augmentation words.

Fixed values.
"""

CLASSES = ["benign", "suspicious_low", "suspicious_medium", "malicious_high", "malicious_critical"]
LEVEL_CLASS = {"critical": "malicious_critical", "high": "malicious_high", "medium": "suspicious_medium",
               "low": "suspicious_low", "informational": "benign"}
LEVEL_ORDER = ["critical", "high", "medium", "low"]

TIERS_SHORT = {
    "malicious_critical": ["mimikatz", "sekurlsa", "lsass.*dump", "procdump.*lsass", "vssadmin.*delete.*shadow",
                           "bcdedit.*recoveryenabled.*no", "wmic.*shadowcopy.*delete", "ransomware", "encrypt.*files"],
    "malicious_high": ["powershell.*-enc", "powershell.*downloadstring", "powershell.*iex", "cmd.*/c.*powershell",
                       "certutil.*-urlcache", "bitsadmin.*transfer", "mshta.*http", "regsvr32.*/s.*/u",
                       "rundll32.*javascript", "wmic.*process.*call.*create", "psexec", "cobalt", "meterpreter",
                       "empire", "beacon"],
    "suspicious_medium": ["powershell.*-w.*hidden", "powershell.*bypass", "cmd.*/c.*del", "schtasks.*/create",
                          "sc.*create", "reg.*add.*run", "netsh.*firewall", "whoami.*/priv", "net.*user.*add",
                          "net.*localgroup.*admin"],
    "suspicious_low": ["powershell", r"cmd\.exe", "wscript", "cscript", "net.*user", "net.*share", "ipconfig",
                       "systeminfo", "tasklist", "netstat"],
}
ATTACK_SOURCES = ["evtx", "mordor"]

TACTIC_WORDS = ["credential-access", "credential_access", "defense-evasion", "defense_evasion", "execution",
                "persistence", "privilege-escalation", "privilege_escalation", "lateral-movement", "lateral_movement",
                "exfiltration", "impact", "command-and-control", "command_and_control", "collection", "discovery",
                "initial-access", "initial_access", "reconnaissance"]
TACTIC_CLASS = {
    "credential-access": "malicious_critical", "credential_access": "malicious_critical",
    "defense-evasion": "malicious_high", "defense_evasion": "malicious_high", "execution": "malicious_high",
    "persistence": "malicious_high", "privilege-escalation": "malicious_high", "privilege_escalation": "malicious_high",
    "lateral-movement": "malicious_critical", "lateral_movement": "malicious_critical",
    "exfiltration": "malicious_critical", "impact": "malicious_critical", "command-and-control": "malicious_high",
    "command_and_control": "malicious_high", "collection": "suspicious_medium", "discovery": "suspicious_medium",
    "initial-access": "malicious_high", "initial_access": "malicious_high", "reconnaissance": "suspicious_low",
}
FLOW_A_CLASS = {
    "benign": "benign", "normal": "benign", "bot": "malicious_critical", "infiltration": "malicious_critical",
    "heartbleed": "malicious_critical", "dos hulk": "malicious_high", "dos goldeneye": "malicious_high",
    "dos slowloris": "malicious_high", "dos slowhttptest": "malicious_high", "ddos": "malicious_high",
    "ftp-patator": "malicious_high", "ssh-patator": "malicious_high",
    "web attack – brute force": "suspicious_medium", "web attack – xss": "suspicious_medium",
    "web attack – sql injection": "suspicious_medium", "web attack brute force": "suspicious_medium",
    "web attack xss": "suspicious_medium", "web attack sql injection": "suspicious_medium",
    "portscan": "suspicious_low", "port scan": "suspicious_low",
}
FLOW_B_CLASS = {
    "normal": "benign", "generic": "suspicious_low", "exploits": "malicious_critical", "fuzzers": "suspicious_medium",
    "dos": "malicious_high", "reconnaissance": "suspicious_low", "analysis": "suspicious_medium",
    "backdoor": "malicious_critical", "shellcode": "malicious_critical", "worms": "malicious_critical",
}
DEFAULT_CLASS = "suspicious_medium"

BENIGN_PROCESSES = [
    "explorer.exe", "taskhostw.exe", "svchost.exe", "lsass.exe", "services.exe", "wininit.exe", "winlogon.exe",
    "csrss.exe", "smss.exe", "system", "idle", "spoolsv.exe", "fontdrvhost.exe", "notepad.exe", "wordpad.exe",
    "chrome.exe", "firefox.exe", "msedge.exe", "outlook.exe", "winword.exe", "excel.exe", "wuauclt.exe",
    "msiexec.exe", "conhost.exe",
]
LINUX_DAEMONS = ["sshd", "cron", "systemd", "init", "journald", "rsyslogd"]

AUGMENT_WORDS = [
    ("cmd", ["cmd.exe", "command", "cmd /c"]), ("powershell", ["powershell.exe", "pwsh", "pwsh.exe"]),
    ("python", ["python.exe", "python3", "py"]), ("admin", ["administrator", "ADMIN", "Administrator"]),
    ("user", ["USER", "User", "usr"]), ("system", ["SYSTEM", "System", "NT AUTHORITY\\SYSTEM"]),
    ("/c", ["-c", " /c ", "/C"]), ("/k", ["-k", " /k ", "/K"]),
    ("-enc", ["-EncodedCommand", "-e", "-ec", "-encodedcommand"]),
    ("-w hidden", ["-WindowStyle Hidden", "-win hidden", "-window hidden"]),
    ("http://", ["https://", "hxxp://", "http[:]//"]), ("c:\\", ["C:\\", "c:/", "C:/"]),
]
HOST_SUFFIXES = ["01", "02", "03", "A", "B", ""]
