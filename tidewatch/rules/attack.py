"""Technique catalogues and incident-type patterns.

Fixed values: list order is the match order.
"""

# keyword or event id -> technique, first hit per technique id wins
KEYWORD_TECHNIQUES = [
    ("powershell", "T1059.001", "PowerShell", "Execution"),
    ("cmd", "T1059.003", "Windows Command Shell", "Execution"),
    ("wscript", "T1059.005", "Visual Basic", "Execution"),
    ("cscript", "T1059.005", "Visual Basic", "Execution"),
    ("mshta", "T1218.005", "Mshta", "Defense Evasion"),
    ("python", "T1059.006", "Python", "Execution"),
    ("wmic", "T1047", "WMI", "Execution"),
    ("wmiprvse", "T1047", "WMI", "Execution"),
    ("schtasks", "T1053.005", "Scheduled Task", "Persistence"),
    ("sc create", "T1543.003", "Windows Service", "Persistence"),
    ("reg add", "T1547.001", "Registry Run Keys", "Persistence"),
    ("7045", "T1543.003", "Windows Service", "Persistence"),
    ("4698", "T1053.005", "Scheduled Task", "Persistence"),
    ("mimikatz", "T1003.001", "LSASS Memory", "Credential Access"),
    ("sekurlsa", "T1003.001", "LSASS Memory", "Credential Access"),
    ("lsass", "T1003.001", "LSASS Memory", "Credential Access"),
    ("procdump", "T1003.001", "LSASS Memory", "Credential Access"),
    ("ntds.dit", "T1003.003", "NTDS", "Credential Access"),
    ("psexec", "T1570", "Lateral Tool Transfer", "Lateral Movement"),
    ("winrs", "T1021.006", "Windows Remote Management", "Lateral Movement"),
    ("rundll32", "T1218.011", "Rundll32", "Defense Evasion"),
    ("regsvr32", "T1218.010", "Regsvr32", "Defense Evasion"),
    ("certutil", "T1140", "Deobfuscate/Decode Files", "Defense Evasion"),
    ("base64", "T1027", "Obfuscated Files", "Defense Evasion"),
    ("-enc", "T1027", "Obfuscated Files", "Defense Evasion"),
    ("bypass", "T1562.001", "Disable Security Tools", "Defense Evasion"),
    ("amsi", "T1562.001", "Disable Security Tools", "Defense Evasion"),
    ("cobalt", "T1071.001", "Web Protocols", "Command and Control"),
    ("meterpreter", "T1071.001", "Web Protocols", "Command and Control"),
    ("beacon", "T1071.001", "Web Protocols", "Command and Control"),
    ("reverse", "T1571", "Non-Standard Port", "Command and Control"),
    ("dns_exfil", "T1048.003", "Exfiltration Over DNS", "Exfiltration"),
    ("compress", "T1560.001", "Archive via Utility", "Collection"),
    ("whoami", "T1033", "System Owner/User Discovery", "Discovery"),
    ("systeminfo", "T1082", "System Information Discovery", "Discovery"),
    ("ipconfig", "T1016", "System Network Configuration", "Discovery"),
    ("netstat", "T1049", "System Network Connections", "Discovery"),
    ("tasklist", "T1057", "Process Discovery", "Discovery"),
    ("nltest", "T1482", "Domain Trust Discovery", "Discovery"),
    ("4625", "T1110", "Brute Force", "Credential Access"),
    ("logon_failure", "T1110", "Brute Force", "Credential Access"),
]

# technique -> additive evidence
PATTERN_TECHNIQUES = [
    dict(id="T1003.001", name="LSASS Memory", tactic="credential_access",
         patterns=["mimikatz", "sekurlsa", "lsass", "procdump.*lsass", "comsvcs.*minidump"],
         processes=["mimikatz.exe", "procdump.exe", "procdump64.exe"], event_ids=[10, 4688]),
    dict(id="T1003.002", name="Security Account Manager", tactic="credential_access",
         patterns=["reg.*save.*sam", "reg.*save.*system", "secretsdump"], event_ids=[4688]),
    dict(id="T1003.003", name="NTDS", tactic="credential_access",
         patterns=["ntdsutil", "vssadmin.*ntds", "ntds.dit"], event_ids=[4688]),
    dict(id="T1059.001", name="PowerShell", tactic="execution",
         patterns=["powershell", "-enc", "-encodedcommand", "invoke-expression", "iex"],
         processes=["powershell.exe", "pwsh.exe"], event_ids=[4688, 4104, 4103]),
    dict(id="T1059.003", name="Windows Command Shell", tactic="execution", patterns=["cmd.*/c", "cmd.*/k"],
         processes=["cmd.exe"], event_ids=[4688]),
    dict(id="T1204.002", name="Malicious File", tactic="execution",
         patterns=[r"\.exe$", r"\.dll$", r"\.scr$", r"\.bat$", r"\.ps1$"],
         parents=["outlook.exe", "winword.exe", "excel.exe"], event_ids=[4688, 11]),
    dict(id="T1547.001", name="Registry Run Keys", tactic="persistence",
         patterns=["currentversion.*run", "hklm.*run", "hkcu.*run"], event_ids=[13, 4688]),
    dict(id="T1053.005", name="Scheduled Task", tactic="persistence", patterns=["schtasks", "at.exe"],
         processes=["schtasks.exe", "at.exe"], event_ids=[4688, 4698, 4699, 4700, 4701, 4702]),
    dict(id="T1543.003", name="Windows Service", tactic="persistence", patterns=["sc.*create", "new-service"],
         event_ids=[4688, 7045]),
    dict(id="T1070.001", name="Clear Windows Event Logs", tactic="defense_evasion",
         patterns=["wevtutil.*cl", "clear-eventlog"], event_ids=[1102, 4688]),
    dict(id="T1562.001", name="Disable or Modify Tools", tactic="defense_evasion",
         patterns=["set-mppreference", "disable.*defender", "tamperprotection"], event_ids=[4688]),
    dict(id="T1027", name="Obfuscated Files or Information", tactic="defense_evasion",
         patterns=["base64", "-enc", "frombase64string", "gzipstream"], event_ids=[4688, 4104]),
    dict(id="T1021.001", name="Remote Desktop Protocol", tactic="lateral_movement", patterns=["mstsc", "rdp"],
         logon_types=[10], event_ids=[4624, 4625]),
    dict(id="T1021.002", name="SMB/Windows Admin Shares", tactic="lateral_movement",
         patterns=[r"\\\\.*\\c\$", r"\\\\.*\\admin\$", "psexec", "wmic.*process.*call.*create"],
         logon_types=[3], event_ids=[4624, 4688]),
    dict(id="T1021.006", name="Windows Remote Management", tactic="lateral_movement",
         patterns=["winrm", "invoke-command", "enter-pssession", "wsmprovhost"], event_ids=[4688]),
    dict(id="T1486", name="Data Encrypted for Impact", tactic="impact",
         patterns=["vssadmin.*delete.*shadows", "wmic.*shadowcopy.*delete", "bcdedit.*recoveryenabled.*no"],
         event_ids=[4688]),
    dict(id="T1490", name="Inhibit System Recovery", tactic="impact",
         patterns=["vssadmin.*delete", "wbadmin.*delete", "bcdedit.*set.*recoveryenabled"], event_ids=[4688]),
    dict(id="T1071.001", name="Web Protocols", tactic="command_and_control",
         patterns=["invoke-webrequest", "downloadstring", "webclient", "curl", "wget"],
         ports=[80, 443, 8080, 8443], event_ids=[3, 4688]),
    dict(id="T1573", name="Encrypted Channel", tactic="command_and_control", ports=[443, 8443, 4444, 5555],
         event_ids=[3]),
    dict(id="T1087.001", name="Local Account", tactic="discovery", patterns=["net.*user", "whoami", "query.*user"],
         event_ids=[4688]),
    dict(id="T1082", name="System Information Discovery", tactic="discovery",
         patterns=["systeminfo", "hostname", "ver", "wmic.*os"], event_ids=[4688]),
    dict(id="T1083", name="File and Directory Discovery", tactic="discovery",
         patterns=["dir.*", "tree", "get-childitem"], event_ids=[4688]),
    dict(id="T1041", name="Exfiltration Over C2 Channel", tactic="exfiltration",
         patterns=["compress-archive", "out-file", "upload"], event_ids=[3, 4688]),
    dict(id="T1566.001", name="Spearphishing Attachment", tactic="initial_access",
         parents=["outlook.exe", "winword.exe", "excel.exe", "powerpnt.exe"], event_ids=[4688]),
    dict(id="T1078", name="Valid Accounts", tactic="initial_access", logon_types=[10, 3], event_ids=[4624, 4648]),
]
EVIDENCE_WEIGHT = dict(event_id=0.1, pattern=0.3, process=0.25, parent=0.2, logon_type=0.3, port=0.2)
EVIDENCE_FLOOR = 0.3

# incident type, enum order decides ties: (type, techniques, patterns, weight, needs several hosts)
INCIDENT_TYPES = [
    ("malware", ["T1204.002", "T1059.001"], ["malware", "trojan", "virus", "backdoor"], 1.0, False),
    ("ransomware", ["T1486", "T1490"],
     ["ransom", "encrypt", "decrypt", "bitcoin", "readme.*decrypt", "vssadmin.*delete"], 1.5, False),
    ("credential_theft", ["T1003.001", "T1003.002", "T1003.003"],
     ["mimikatz", "sekurlsa", "lsass", "hashdump", "credential"], 1.3, False),
    ("lateral_movement", ["T1021.001", "T1021.002", "T1021.006"], ["psexec", "wmic.*process", "winrm", "mstsc"], 1.2,
     True),
    ("data_exfiltration", ["T1041"], ["exfil", "upload", "compress-archive", "ftp", "scp"], 1.2, False),
    ("persistence", ["T1547.001", "T1053.005", "T1543.003"], ["schtasks", "sc.*create", "run.*key"], 1.0, False),
    ("privilege_escalation", ["T1548", "T1134"], ["runas", "privilege", "elevate", "bypass.*uac"], 1.1, False),
    ("command_and_control", ["T1071.001", "T1573"], ["beacon", "c2", "callback", "reverse.*shell"], 1.1, False),
    ("reconnaissance", ["T1087.001", "T1082", "T1083"], ["whoami", "systeminfo", "net.*user", "ipconfig"], 0.8, False),
    ("phishing", ["T1566.001"], ["outlook", "email", "attachment", "macro"], 1.0, False),
]
HIGH_IMPACT_TECHNIQUES = ["T1486", "T1490", "T1003.001", "T1041"]
CRITICAL_COMMANDS = ["mimikatz", "sekurlsa", "vssadmin.*delete", "bcdedit.*no"]

EVENT_TYPE_BY_ID = {
    4688: "process_creation", 4689: "process_termination", 4624: "logon_success", 4625: "logon_failure",
    4648: "explicit_credential", 4672: "special_privileges", 4698: "scheduled_task_created", 7045: "service_installed",
    4104: "powershell_script", 1: "process_create_sysmon", 3: "network_connection", 11: "file_created",
    13: "registry_value", 1102: "log_cleared",
}

# scenario tagging: (technique, keywords, event ids)
SCENARIO_TAGS = [
    ("T1003", ["lsass", "procdump", "sekurlsa", "comsvcs", "mimikatz"], [8, 10]),
    ("T1059.001", ["-enc", "frombase64", "iex(", "downloadstring"], [4104]),
    ("T1490", ["vssadmin delete", "bcdedit"], []),
    ("T1021", ["psexec", "winrs"], []),
    ("T1105", ["certutil", "bitsadmin"], []),
    ("T1053", ["schtasks /create", "new-scheduledtask"], []),
    ("T1218", ["mshta", "regsvr32", "installutil", "msbuild"], []),
    ("T1047", ["wmic process", "wmic /node"], []),
    ("T1136", ["net user", "net localgroup"], []),
    ("T1071", ["cobalt", "beacon"], []),
    ("T1562", ["add-mppreference", "exclusionpath"], []),
    ("T1082", ["whoami", "systeminfo"], []),
]

# catalogue of parent techniques for lookups: (id, name, tactic, description, sub-techniques, mitigations)
TECHNIQUE_CARDS = [
    ("T1059", "Command and Scripting Interpreter", "Execution",
     "Adversaries may abuse command and script interpreters to execute commands, scripts, or binaries.",
     ["T1059.001 PowerShell", "T1059.003 Windows Command Shell", "T1059.005 Visual Basic", "T1059.007 JavaScript"],
     ["Execution Prevention", "Code Signing", "Antivirus/Antimalware"]),
    ("T1055", "Process Injection", "Defense Evasion, Privilege Escalation",
     "Adversaries inject code into processes to evade defenses and elevate privileges.",
     ["T1055.001 DLL Injection", "T1055.002 PE Injection", "T1055.003 Thread Execution Hijacking",
      "T1055.012 Process Hollowing"], ["Behavior Prevention", "Privileged Account Management"]),
    ("T1021", "Remote Services", "Lateral Movement",
     "Adversaries may use valid accounts to log into remote services for lateral movement.",
     ["T1021.001 RDP", "T1021.002 SMB/Windows Admin Shares", "T1021.003 DCOM", "T1021.006 Windows Remote Management"],
     ["MFA", "Network Segmentation", "Privileged Account Management"]),
    ("T1053", "Scheduled Task/Job", "Execution, Persistence, Privilege Escalation",
     "Adversaries may schedule tasks for execution at a specified date/time for persistence or privilege escalation.",
     ["T1053.005 Scheduled Task", "T1053.003 Cron"],
     ["Audit", "Operating System Configuration", "Privileged Account Management"]),
    ("T1486", "Data Encrypted for Impact", "Impact",
     "Adversaries may encrypt data on target systems to interrupt availability (ransomware).", [],
     ["Data Backup", "Behavior Prevention"]),
    ("T1566", "Phishing", "Initial Access",
     "Adversaries may send phishing messages to gain access to victim systems.",
     ["T1566.001 Spearphishing Attachment", "T1566.002 Spearphishing Link", "T1566.003 Spearphishing via Service"],
     ["User Training", "Antivirus/Antimalware", "Network Intrusion Prevention"]),
    ("T1078", "Valid Accounts", "Defense Evasion, Initial Access, Persistence, Privilege Escalation",
     "Adversaries may obtain and abuse valid account credentials for initial access, persistence, or privilege "
     "escalation.",
     ["T1078.001 Default Accounts", "T1078.002 Domain Accounts", "T1078.003 Local Accounts",
      "T1078.004 Cloud Accounts"], ["MFA", "Password Policies", "Privileged Account Management"]),
    ("T1547", "Boot or Logon Autostart Execution", "Persistence, Privilege Escalation",
     "Adversaries may configure system settings to automatically execute a program during boot or logon.",
     ["T1547.001 Registry Run Keys", "T1547.004 Winlogon Helper DLL", "T1547.009 Shortcut Modification"],
     ["Restrict Registry Permissions", "Software Configuration"]),
    ("T1071", "Application Layer Protocol", "Command and Control",
     "Adversaries may communicate using OSI application layer protocols to avoid detection.",
     ["T1071.001 Web Protocols", "T1071.002 File Transfer Protocols", "T1071.004 DNS"],
     ["Network Intrusion Prevention", "Network Filtering"]),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration",
     "Adversaries may steal data by exfiltrating it over a different protocol than the C2 channel.",
     ["T1048.001 Symmetric Encrypted", "T1048.002 Asymmetric Encrypted", "T1048.003 Unencrypted"],
     ["DLP", "Network Segmentation", "Network Filtering"]),
    ("T1070", "Indicator Removal", "Defense Evasion",
     "Adversaries may delete or modify artifacts to remove evidence of their presence.",
     ["T1070.001 Clear Windows Event Logs", "T1070.003 Clear Command History", "T1070.004 File Deletion"],
     ["Encrypt Sensitive Information", "Remote Data Storage", "Restrict File and Directory Permissions"]),
    ("T1027", "Obfuscated Files or Information", "Defense Evasion",
     "Adversaries may obfuscate payloads to make detection and analysis more difficult.",
     ["T1027.001 Binary Padding", "T1027.002 Software Packing", "T1027.005 Indicator Removal from Tools"],
     ["Antivirus/Antimalware", "Behavior Prevention"]),
    ("T1560", "Archive Collected Data", "Collection",
     "Adversaries may compress and encrypt collected data prior to exfiltration.",
     ["T1560.001 Archive via Utility", "T1560.002 Archive via Library"], ["Audit"]),
    ("T1204", "User Execution", "Execution",
     "Adversaries may rely upon user actions to execute malicious content.",
     ["T1204.001 Malicious Link", "T1204.002 Malicious File"],
     ["User Training", "Network Intrusion Prevention", "Execution Prevention"]),
]

# catalogue build
TACTIC_KEYS = {t: t.replace("-", "_") for t in [
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation",
    "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control",
    "exfiltration", "impact"]}
TACTIC_SEVERITY = {
    "credential_access": 90, "lateral_movement": 85, "exfiltration": 85, "impact": 80, "command_and_control": 75,
    "privilege_escalation": 70, "persistence": 65, "execution": 60, "defense_evasion": 55, "initial_access": 55,
    "discovery": 40, "collection": 50, "reconnaissance": 30, "resource_development": 25,
}
WINDOWS_PLATFORMS = ["windows", "azure ad", "office 365", "saas"]
TACTIC_REPORT_ORDER = ["initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion",
                       "credential_access", "discovery", "lateral_movement", "collection", "command_and_control",
                       "exfiltration", "impact"]
