"""Indicator patterns and the small offline threat-intelligence table.

Fixed values.
"""

IOC_PATTERNS_A = {
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "domain": r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z]{2,})+\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "url": r"https?://[^\s\"<>]+",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "file_path": r"[A-Z]:\\[\w\\. -]+\.\w{2,4}",
    "registry": r"HK(?:LM|CU|CR|U|CC)\\[\w\\]+",
}
COMMON_DOMAINS = ["localhost", "example.com"]
TOOL_PROCESSES = ["mimikatz", "cobalt", "meterpreter", "psexec"]

IOC_PATTERNS_B = {
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+"
              r"(?:com|net|org|io|ru|cn|xyz|top|info|biz|co|cc|pw|tk|ml|ga|cf|gq)\b",
    "hash_md5": r"\b[a-fA-F0-9]{32}\b",
    "hash_sha1": r"\b[a-fA-F0-9]{40}\b",
    "hash_sha256": r"\b[a-fA-F0-9]{64}\b",
    "url": r"https?://[^\s<>\"']+",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "file_path": r"[A-Za-z]:\\(?:[^\\\/:*?\"<>|\r\n]+\\)*[^\\\/:*?\"<>|\r\n]*",
    "registry": r"(?:HKLM|HKCU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER)\\[^\s]+",
}
IOC_CONTEXT_B = {
    "ip": "Network communication endpoint", "domain": "Domain name in communication", "hash_md5": "MD5 file hash",
    "hash_sha1": "SHA1 file hash", "hash_sha256": "SHA256 file hash", "url": "URL accessed", "email": "Email address",
    "file_path": "File system path", "registry": "Registry key",
}
BAD_IP_PREFIXES = ["185.220.101.", "45.33.32.", "192.42.116.", "104.244.72."]
BAD_DOMAIN_WORDS = ["malware", "c2", "evil", "hack", "backdoor", "trojan"]
BAD_URL_WORDS = ["download", "payload", "update", "install"]

LOCAL_INTEL = [
    ("ip", "185.220.101.1", "Known malicious IP (local threat DB)"),
    ("ip", "185.220.101.2", "Known malicious IP (local threat DB)"),
    ("ip", "185.220.101.3", "Known malicious IP (local threat DB)"),
    ("ip", "45.33.32.156", "Known malicious IP (local threat DB)"),
    ("ip", "104.244.72.115", "Known malicious IP (local threat DB)"),
    ("ip", "192.42.116.1", "Known malicious IP (local threat DB)"),
    ("domain", "malware-c2.evil.com", "Known malicious domain (local threat DB)"),
    ("domain", "phishing-kit.badactor.net", "Known malicious domain (local threat DB)"),
    ("domain", "exfil-data.darkweb.onion", "Known malicious domain (local threat DB)"),
    ("domain", "update-flash.fakecdn.com", "Known malicious domain (local threat DB)"),
    ("hash", "e99a18c428cb38d5f260853678922e03", "WannaCry ransomware"),
    ("hash", "5d41402abc4b2a76b9719d911017c592", "Known malware sample"),
]
LOCAL_PROCESSES = [
    ("mimikatz.exe", "Credential dumping tool"), ("psexec.exe", "Remote execution (often abused)"),
    ("cobalt", "Potential Cobalt Strike beacon"), ("nc.exe", "Netcat for Windows"),
    ("procdump.exe", "Memory dumping tool"), ("lazagne.exe", "Credential recovery tool"),
    ("bloodhound", "AD enumeration tool"), ("rubeus.exe", "Kerberos attack tool"),
    ("sharphound", "BloodHound data collector"),
]
NOT_LISTED = "not in local DB"
PROVIDER_WEIGHT = {"VirusTotal": 0.6, "AbuseIPDB": 0.5, "local": 0.3}
LOCAL_CONFIDENCE = 0.6
