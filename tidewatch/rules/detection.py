"""Word lists, event-id sets and path fragments used by the event scorers.

Fixed values: results depend on every entry and on the order shown.
"""

# --- main scorer -----------------------------------------------------------
KEYWORDS = [
    # credential dumping
    "mimikatz", "sekurlsa", "lsadump", "lsass", "procdump", "comsvcs", "ntds.dit", "sam", "dumpcreds",
    # script abuse
    "invoke-", "iex", "invoke-expression", "invoke-command", "downloadstring", "downloadfile", "webclient",
    "invoke-webrequest", "frombase64", "reflection", "assembly", "load", "powersploit", "empire", "nishang",
    # encoding and evasion
    "bypass", "hidden", "encoded", "-enc", "-e ", "base64", "-nop", "noprofile", "-windowstyle", "-w hidden",
    "amsi", "etw",
    # command and control
    "cobalt", "meterpreter", "reverse", "payload", "exploit", "beacon", "stager", "shellcode", "nc.exe", "netcat",
    "ncat", "socat",
    # lateral movement
    "psexec", "winrs", "wmic process", "wmiprvse",
    # persistence
    "schtasks", "/create", "onstart", "onlogon", "new-scheduledtask", "register-scheduledtask", "sc create",
    "sc config", "reg add", "run /v", "runonce",
    # staging
    "compress-archive", "7z a", "rar a",
    # living-off-the-land commands
    "certutil", "urlcache", "bitsadmin", "/transfer", "mshta", "javascript:", "vbscript:", "rundll32", "regsvr32",
    "/s /n /u /i:", "cmstp", "installutil", "msbuild",
    # reverse shells
    "socket", "subprocess", "os.dup2", "connect(", "tcpclient", "nettcpclient", "/bin/sh", "/bin/bash", "chr(",
]
PROCESSES = [
    "powershell", "pwsh", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin",
    "msiexec", "cmstp", "installutil", "msbuild", "schtasks", "at.exe", "sc.exe", "reg.exe", "net.exe", "net1.exe",
    "python", "python3", "python.exe", "pythonw.exe", "java", "java.exe", "javaw.exe", "node", "node.exe", "ruby",
    "perl", "php", "wmic", "wmic.exe", "wmiprvse", "psexec", "psexec64", "nltest", "dsquery", "klist", "whoami",
    "systeminfo", "ipconfig", "nslookup", "netstat", "tasklist", "query", "mimikatz", "procdump", "processhacker",
]
HIGH_RISK_IDS = [
    4688, 4689, 4624, 4625, 4648, 4672, 4698, 4699, 4700, 4701, 4702, 7045, 7036, 4104, 4103,
    1, 3, 7, 8, 10, 11, 12, 13, 15, 22, 23, 25, 4720, 4726, 4732, 4756,
]
ENCODED_MARKS = ["-enc", "-e ", "base64", "frombase64"]
DOWNLOAD_MARKS = ["download", "webclient", "invoke-webrequest", "urlcache"]
HIDDEN_MARKS = ["-w hidden", "-windowstyle h", "hidden"]
SERVICE_USERS = ["SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE"]
WATCHED_PORTS = [443, 8443, 8080, 4444, 5555, 1337, 1234, 9999, 31337]

# --- extra indicators ------------------------------------------------------
SIDELOAD_PATHS = ["users/public", "appdata/local/temp", "downloads", "programdata", "windows/temp", "recycle"]
TASK_BOOT_MARKS = ["system", "onstart", "onlogon", "/ru"]
FILELESS_MARKS = ["reflection", "assembly", "load", "frombase64", "invoke", "virtualalloc", "createthread", "shellcode",
                  "getprocaddress", "kernel32"]
CALLBACK_PORTS = [4444, 5555, 1337, 31337, 9999, 1234, 8888]
OUTBOUND_PROCESSES = ["powershell", "cmd", "python", "wscript", "mshta", "rundll32", "regsvr32"]
DNS_PATTERNS = [
    r"[a-zA-Z0-9+/=]{10,}\.[a-zA-Z0-9.-]+\.[a-z]{2,}",
    r"([a-f0-9]{8,}\.){2,}",
    r"^[a-zA-Z0-9._-]+\.[a-zA-Z0-9]{8,}\.[a-zA-Z0-9.-]+\.[a-z]{2,}$",
]

# --- anomaly predicate that opens the deep path ----------------------------
ANOMALY_KEYWORDS = [
    "mimikatz", "invoke-", "powershell", "bypass", "hidden", "encoded", "downloadstring", "iex", "webclient",
    "frombase64", "empire", "cobalt", "meterpreter", "reverse", "shell", "payload", "exploit", "dump", "lsass",
    "sekurlsa", "psexec", "nc.exe", "netcat", "-enc", "-e ", "base64", "procdump", "ntds.dit",
]
ANOMALY_PROCESSES = ["powershell", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil",
                     "bitsadmin", "msiexec"]
ANOMALY_CONTEXT = ["-", "/", "http", "base64"]

# --- 18-feature layout -----------------------------------------------------
V1_KEYWORDS = [
    "mimikatz", "invoke-", "powershell", "bypass", "hidden", "encoded", "downloadstring", "iex", "webclient",
    "frombase64", "empire", "cobalt", "meterpreter", "reverse", "shell", "payload", "exploit", "dump", "lsass",
    "sekurlsa", "wmic", "psexec", "nc.exe", "netcat", "certutil", "bitsadmin", "regsvr32", "rundll32", "mshta",
]
V1_PROCESSES = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe",
                "certutil.exe", "bitsadmin.exe", "msiexec.exe", "wmic.exe", "schtasks.exe", "at.exe", "net.exe",
                "net1.exe", "psexec.exe", "psexesvc.exe"]
V1_HIGH_RISK_IDS = [4688, 4689, 4624, 4625, 4648, 4672, 4698, 4699, 4700, 4701, 4702, 7045, 4104, 4103,
                    1, 3, 7, 8, 10, 11, 12, 13, 1102]
SYSMON_IDS = [1, 3, 7, 8, 10, 11, 12, 13, 15, 22, 23, 25]

# --- 39/41/42-feature layouts ----------------------------------------------
TOP_IDS = [1, 3, 5, 6, 7, 8, 10, 11, 12, 13, 22, 4624, 4625, 4648, 4672, 4688, 4698, 4720, 7045, 4104]
TOP_IDS_V4 = [1, 3, 5, 6, 7, 12, 13, 22, 4624, 4688]
V2_KEYWORDS = [
    "mimikatz", "sekurlsa", "lsadump", "lsass", "procdump", "comsvcs", "ntds.dit", "dumpcreds", "invoke-", "iex",
    "downloadstring", "downloadfile", "webclient", "frombase64", "reflection", "powersploit", "empire", "nishang",
    "bypass", "hidden", "-enc", "base64", "-nop", "noprofile", "-windowstyle", "amsi", "etw", "cobalt", "meterpreter",
    "payload", "exploit", "beacon", "shellcode", "nc.exe", "netcat", "socat", "psexec", "winrs", "wmic process",
    "schtasks /create", "sc create", "reg add", "certutil -urlcache", "bitsadmin /transfer", "mshta", "rundll32",
    "regsvr32",
]
V2_PROCESSES = ["powershell", "pwsh", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin",
                "msiexec", "installutil", "msbuild", "wmic", "psexec", "mimikatz", "procdump"]
V3_KEYWORDS = [
    "mimikatz", "sekurlsa", "lsadump", "lsass", "procdump", "comsvcs", "ntds.dit", "dumpcreds", "invoke-", "iex",
    "downloadstring", "webclient", "frombase64", "reflection", "powersploit", "empire", "bypass", "hidden", "-enc",
    "base64", "-nop", "amsi", "etw", "cobalt", "meterpreter", "payload", "beacon", "shellcode", "nc.exe", "netcat",
    "psexec", "winrs", "wmic process", "schtasks /create", "sc create", "reg add", "certutil -urlcache",
    "bitsadmin /transfer", "mshta", "rundll32", "regsvr32", "installutil", "msbuild",
]
V3_PROCESSES = ["powershell", "pwsh", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin",
                "installutil", "msbuild", "wmic", "psexec", "mimikatz", "procdump"]
RUN_KEY = "hkcu\\software\\microsoft\\windows\\currentversion\\run"
SUSPICIOUS_REGISTRY = [
    "software\\microsoft\\windows\\currentversion\\run",
    "software\\microsoft\\windows\\currentversion\\runonce",
    "system\\currentcontrolset\\services",
    "software\\microsoft\\windows nt\\currentversion\\winlogon",
    "software\\microsoft\\windows nt\\currentversion\\image file execution options",
    "software\\classes\\clsid", "sam\\sam", "security\\policy\\secrets",
]
BENIGN_REGISTRY = [
    "windows defender", "windowsupdate", "windows update", "currentversion\\uninstall", "explorer\\recentdocs",
    "fontsubstitutes", "fonts", "dhcp", "tcpip\\parameters\\interfaces", "eventlog", "print\\printers",
]
OFFICE_PARENTS = ["outlook", "winword", "excel", "powerpnt", "iexplore", "firefox", "chrome"]

# --- address prefixes, one list per caller ----------------------------------
PRIVATE_PREFIXES_IOC = ["10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3", "127.", "0.0.",
                        "169.254."]
INTERNAL_PREFIXES_V4 = ["10.", "192.168."] + [f"172.{i}." for i in range(16, 32)] + ["127.", "::1", "169.254.", "0."]
PRIVATE_PREFIXES_LOGON = ["10.", "192.168.", "172.", "127."]

# --- 90-feature layout ------------------------------------------------------
SOURCES = ["windows_security", "sysmon", "active_directory", "linux_auditd", "linux_auth", "kaspersky", "firewall"]
ENT_PROCESSES = [
    "mimikatz.exe", "wce.exe", "pwdump.exe", "fgdump.exe", "procdump.exe", "vssadmin.exe", "bcdedit.exe", "wbadmin.exe",
    "net.exe", "net1.exe", "psexec.exe", "psexecsvc", "wmic.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe",
    "certutil.exe", "bitsadmin.exe", "msiexec.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "csc.exe",
    "cmstp.exe", "mavinject.exe", "microsoft.workflow.compiler.exe", "aspnet_compiler.exe", "nc.exe", "ncat.exe",
    "socat", "xterm", "nmap", "masscan", "sqlmap", "cobalt", "beacon", "meterpreter", "empire.exe", "pupy", "lsass",
]
LOLBAS = [
    "certutil.exe", "bitsadmin.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "installutil.exe", "csc.exe",
    "msiexec.exe", "wmic.exe", "cmstp.exe", "mavinject.exe", "infdefaultinstall.exe", "pcwrun.exe",
    "syncappvpublishingserver.exe", "appsyncpublishingserver.exe", "expand.exe", "extrac32.exe", "findstr.exe",
    "hh.exe", "makecab.exe", "odbcconf.exe", "pcalua.exe", "regasm.exe", "regsvc.exe", "regsvcs.exe", "replace.exe",
    "msdeploy.exe", "msdt.exe", "nltest.exe",
]
SYSTEM_PATHS = ["c:\\windows\\system32", "c:\\windows\\syswow64", "c:\\windows\\sysnative", "c:\\program files",
                "c:\\windows\\winsxs"]
SCRIPT_EXTENSIONS = [".vbs", ".js", ".jse", ".wsf", ".wsh", ".ps1", ".bat", ".cmd", ".hta", ".scr", ".pif", ".com",
                     ".lnk"]
CRITICAL_LINUX_PATHS = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", "/root/.ssh/authorized_keys", "/etc/crontab",
                        "/etc/cron.d", "/etc/ld.so.preload", "/proc/sys/kernel", "/.bashrc", "/.bash_profile", "/home/"]
PARENT_CHILD = [("winword.exe", "cmd.exe"), ("excel.exe", "cmd.exe"), ("outlook.exe", "powershell.exe"),
                ("explorer.exe", "wmic.exe"), ("svchost.exe", "powershell.exe"), ("lsass.exe", "cmd.exe")]
MASQUERADE = ["svch0st", "svchost32", "lsas", "csrss32", "explorer32", "rundl132", "noteapd", "lsaas", "wmiprvs"]
QUIET_CLIENTS = ["chrome.exe", "firefox.exe", "msedge.exe", "svchost.exe", "wuauclt.exe"]

# --- notebook features -------------------------------------------------------
NB_KEYWORDS = ["mimikatz", "invoke-", "powershell", "bypass", "hidden", "encoded", "downloadstring", "iex", "webclient",
               "frombase64", "empire", "cobalt", "meterpreter", "reverse", "shell", "payload", "exploit", "dump",
               "lsass", "sekurlsa", "wmic", "psexec", "nc.exe", "netcat"]
NB_PROCESSES = ["powershell", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin",
                "msiexec"]
NB_HIGH_RISK_IDS = [4688, 4689, 4624, 4625, 4648, 4672, 4698, 4699, 4700, 4701, 4702, 7045, 4104, 4103,
                    1, 3, 7, 8, 10, 11, 12, 13]
HIGH_TACTICS = ["Credential Access", "Lateral Movement", "Privilege Escalation", "Defense Evasion",
                "Command and Control", "Execution"]
MEDIUM_TACTICS = ["Discovery", "Persistence", "Other"]

# --- keyword baselines --------------------------------------------------------
BASELINE_CRITICAL = ["mimikatz", "sekurlsa", "lsadump", "procdump", "comsvcs", "vssadmin delete", "bcdedit",
                     "wmic shadowcopy"]
BASELINE_HIGH = ["-enc", "frombase64", "downloadstring", "iex(", "iex ", "certutil -urlcache", "bitsadmin /transfer",
                 "psexec", "cobalt", "meterpreter", "shellcode", "invoke-expression"]
BASELINE_IDS = [8, 10, 4104, 7045, 4698]
FUSION_WEIGHTS = [("lsass", 0.3), ("procdump", 0.3), ("mimikatz", 0.4), ("comsvcs", 0.3), ("-enc", 0.2),
                  ("frombase64", 0.25), ("iex(", 0.25), ("certutil -urlcache", 0.2), ("bitsadmin", 0.2),
                  ("psexec", 0.25), ("winrs", 0.15), ("wmic process", 0.2), ("sc create", 0.2), ("sc config", 0.15)]

# --- collector rules ----------------------------------------------------------
CHANNEL_ALLOW = {
    "Security": [4688, 4689, 4624, 4625, 4648, 4672, 4720, 4722, 4723, 4724, 4725, 4726, 4732, 4733, 4756, 4740, 4768,
                 4769, 5140, 5145],
    "Microsoft-Windows-PowerShell/Operational": [4103, 4104, 4105, 4106],
    "System": [7045, 7036, 7040, 1074, 6005, 6006],
    "Application": [1000, 1001, 1002],
}
CHANNEL_SEVERITY = {
    ("Security", 4625): "warning", ("Security", 4740): "warning", ("Security", 4720): "info",
    ("Security", 4688): "info", ("Microsoft-Windows-PowerShell/Operational", 4104): "warning",
    ("System", 7045): "warning", ("System", 1074): "info", ("Application", 1000): "warning",
    ("Application", 1001): "warning", ("Application", 1002): "error",
}
COLLECTOR_KEYWORDS = [
    "invoke-expression", "iex", "invoke-command", "downloadstring", "downloadfile", "invoke-webrequest", "iwr", "curl",
    "wget", "-enc", "-e ", "frombase64", "mimikatz", "invoke-mimikatz", "dumpcreds", "powersploit", "empire",
    "bloodhound", "rubeus", "bypass", "noprofile", "-nop", "hidden", "amsi", "etw", "reflection", "psexec", "winrs",
    "wmic process", "sekurlsa", "lsadump", "ntds.dit", "procdump", "comsvcs.dll",
]
COLLECTOR_PROCESSES = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe",
                       "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "msiexec.exe", "psexec.exe", "wmic.exe"]
