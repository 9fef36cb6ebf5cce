"""Feature layouts: one double column per feature, all built-in expressions.

Each builder first materialises the normalised texts it needs in one projection, then derives the features in a second
one, so that no lower() or fold is evaluated per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.net import external_address, internal_v4
from tidewatch.functions.text import (
    basename, count_hits, ends_any, filled, flag, fold_ascii, has, has_any, is_encoded_command, low, nz,
    parse_int, pin, safe_int, search, shannon_entropy, starts_any, unique_ratio)
from tidewatch.rules import detection as D

TEXT = "_t_"


def _stage(df: DataFrame, **texts: Column) -> DataFrame:
    return df.withColumns({TEXT + k: pin(v) for k, v in texts.items()})


def _t(name: str) -> Column:
    return F.col(TEXT + name)


def _drop_stage(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(TEXT)])


def _emit(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    return _drop_stage(df.withColumns({k: v.cast("double") for k, v in features.items()}))


def folded(c: str) -> Column:
    return F.lower(fold_ascii(c))


# ---------------------------------------------------------------- legacy 16
LEGACY16 = ["event_id_value", "high_risk_event", "channel_bucket", "suspicious_process", "cmdline_length",
            "keyword_count", "has_base64", "has_download", "has_hidden", "parent_suspicious", "logon_type_value",
            "remote_logon", "system_user", "admin_user", "dest_port_value", "c2_port"]


def detector_texts(df: DataFrame) -> DataFrame:
    """Texts shared by the 16-feature layout and the extra indicators."""
    every = F.concat_ws(" ", *[F.when(filled(c), nz(c)) for c in (
        "command_line", "script_block_text", "image_loaded", "service_file", "message", "parent_command_line")])
    return _stage(df, all=F.lower(fold_ascii(every)), proc=F.lower(fold_ascii(F.lower(nz("process_name")))),
                  cmd=folded("command_line"), parent=folded("parent_image"), script=folded("script_block_text"),
                  image=low("image_loaded"), query=low("query_name"), eid=safe_int("event_id"),
                  logon=safe_int("logon_type"), port=safe_int("destination_port"))


def legacy16(df: DataFrame, prefix: str = "", staged: bool = False) -> DataFrame:
    user = F.upper(nz("user"))
    df = df if staged else detector_texts(df)
    values = [
        _t("eid"), _t("eid").isin(D.HIGH_RISK_IDS),
        F.pmod(F.xxhash64(F.coalesce(F.col("channel"), F.lit("Security"))), F.lit(12)),
        has_any(_t("proc"), D.PROCESSES), F.length(_t("cmd")), count_hits(_t("all"), D.KEYWORDS),
        has_any(_t("all"), D.ENCODED_MARKS), has_any(_t("all"), D.DOWNLOAD_MARKS), has_any(_t("all"), D.HIDDEN_MARKS),
        has_any(_t("parent"), D.PROCESSES), _t("logon"), _t("logon").isin(3, 10), user.isin(D.SERVICE_USERS),
        has(user, "ADMIN"), _t("port"), _t("port").isin(D.WATCHED_PORTS)]
    named = {prefix + n: v.cast("double") for n, v in zip(LEGACY16, values)}
    return df.withColumns(named) if staged else _drop_stage(df.withColumns(named))


# ---------------------------------------------------------------- 18 features
V1_NAMES = ["is_high_risk_event", "suspicious_keyword_count", "is_suspicious_process", "has_base64_encoding",
            "has_lsass_access", "has_ps_bypass_flags", "cmdline_length_norm", "has_network_indicators",
            "has_persistence_indicators", "has_defense_evasion", "has_lateral_movement", "has_c2_indicators",
            "has_suspicious_parent", "is_sysmon_event", "is_privilege_event", "script_length_norm",
            "has_dll_sideloading", "is_network_rdp_logon"]


def v1_18(df: DataFrame, prefix: str = "") -> DataFrame:
    staged = _stage(df, cmd=low("command_line"), script=low("script_block_text"), proc=low("process_name"),
                    image=low("image_loaded"), parent=low("parent_image"), eid=safe_int("event_id"))
    staged = _stage(staged, all=F.concat_ws(" ", _t("cmd"), _t("script"), _t("proc"), _t("image")))
    every, cmd = _t("all"), _t("cmd")
    values = [
        flag(_t("eid").isin(D.V1_HIGH_RISK_IDS)),
        count_hits(every, D.V1_KEYWORDS),
        flag(has_any(_t("proc"), D.V1_PROCESSES)),
        flag(has_any(cmd, ["-enc", "base64"]) | has(every, "frombase64")),
        flag(has_any(every, ["lsass", "sekurlsa", "procdump"])),
        flag(has(_t("proc"), "powershell") & has_any(cmd, ["-enc", "-nop", "bypass", "hidden"])),
        F.least(F.length(cmd) / 1000.0, F.lit(1.0)),
        flag(has_any(every, ["socket", "connect", "webclient", "downloadstring"])),
        flag(has_any(every, ["schtasks", "reg add", "sc create", "runonce", "onlogon"])),
        flag(has_any(every, ["bypass", "amsi", "etw", "-nop", "hidden", "mshta"])),
        flag(has_any(every, ["psexec", "winrs", "wmic process"])),
        flag(has_any(every, ["cobalt", "beacon", "meterpreter", "shellcode"])),
        flag(has_any(_t("parent"), D.OFFICE_PARENTS[:6])),
        flag(_t("eid").isin(D.SYSMON_IDS)),
        flag(_t("eid").isin(4672, 4648, 4624)),
        F.least(F.length(_t("script")) / 2000.0, F.lit(1.0)),
        flag(has_any(_t("image"), D.SIDELOAD_PATHS[:3])),
        flag(nz("logon_type").isin("3", "10"))]
    return _emit(staged, {prefix + n: v for n, v in zip(V1_NAMES, values)})


# ---------------------------------------------------------------- 39 / 41 / 42 features
def _behaviour_texts(df: DataFrame) -> DataFrame:
    staged = _stage(df, cmd=folded("command_line"), proc=folded("process_name"), script=folded("script_block_text"),
                    parent=folded("parent_image"), eid=safe_int("event_id"), port=safe_int("destination_port"),
                    image=low("image_loaded"), reg=low("target_object"))
    return _stage(staged, all=F.concat_ws(" ", _t("cmd"), _t("script"), _t("proc")), base=basename(_t("proc")))


def _wordy(keywords, processes, wide: bool) -> dict[str, Column]:
    """The behavioural block shared by the three layouts; `wide` adds the later word lists."""
    cmd, every, base = _t("cmd"), _t("all"), _t("base")
    extra = lambda words: words if wide else []
    return {
        "kw_count_norm": F.least(count_hits(every, keywords) / 5.0, F.lit(1.0)),
        "susp_process_exact": flag(base.isin(processes)),
        "susp_process_partial": flag(has_any(base, processes)),
        "base64_encoded": flag(has_any(cmd, ["-enc", "base64"] + extra(["encodedcommand"])) | has(every, "frombase64")),
        "lsass_credential": flag(has_any(every, ["lsass", "sekurlsa", "procdump"] + extra(["comsvcs"]))),
        "powershell_bypass": flag(has(_t("proc"), "powershell") & has_any(
            cmd, ["-enc", "-nop", "bypass", "hidden"] + extra(["windowstyle"]))),
        "network_download": flag(has_any(every, ["webclient", "downloadstring", "invoke-webrequest"] + extra(
            ["urlcache", "bitsadmin", "wget", "curl"]))),
        "persistence": flag(has_any(every, ["schtasks /create", "reg add", "sc create", "runonce", "onlogon"] + extra(
            [D.RUN_KEY]))),
        "defense_evasion": flag(has_any(every, ["bypass", "amsi", "etw", "-nop", "hidden", "mshta"] + extra(
            ["installutil", "regsvr32", "cmstp"]))),
        "lateral_movement": flag(has_any(every, ["psexec", "winrs", "wmic process"] + extra(
            ["invoke-wmimethod", "dcom"]))),
    }


def _dense_text_flag() -> Column:
    """Long command line made of mostly distinct characters."""
    return flag((F.length(_t("cmd")) > 50) & (unique_ratio(_t("cmd")) > 0.6))


def _v23_tail(ports: list[int], parents: list[str]) -> dict[str, Column]:
    proc, eid = _t("proc"), _t("eid")
    system = has_any(proc, ["windows\\system32", "windows\\syswow64", "program files"])
    return {
        "has_dest_ip": flag(filled("destination_ip") & ~nz("destination_ip").isin("0.0.0.0", "127.0.0.1")),
        "suspicious_port": flag(_t("port").isin(ports)),
        "suspicious_path": flag(~system & has_any(proc, ["appdata", "temp", "downloads", "public", "programdata"])),
        "suspicious_parent": flag(has_any(_t("parent"), parents)),
        "network_logon": flag(nz("logon_type").isin("3", "10")),
        "external_src_ip": F.lit(0.0),  # an empty prefix in the original list makes every address internal
        "registry_op": flag(eid.isin(12, 13, 14)),
        "driver_load": flag(eid.isin(6, 7)),
        "process_injection": flag(eid.isin(8, 10)),
    }


def _one_hot(ids: list[int]) -> dict[str, Column]:
    return {f"eid_{i}": flag(_t("eid") == i) for i in ids}


def v2_39(df: DataFrame, prefix: str = "") -> DataFrame:
    feats = {**_one_hot(D.TOP_IDS), **_wordy(D.V2_KEYWORDS, D.V2_PROCESSES, False),
             **_v23_tail([4444, 1337, 8080, 9090, 3333, 31337, 5555], D.OFFICE_PARENTS[:6])}
    return _emit(_behaviour_texts(df), {prefix + k: v for k, v in feats.items()})


V3_NAMES = [f"eid_{i}" for i in D.TOP_IDS] + [
    "kw_count_norm", "susp_process_exact", "susp_process_partial", "base64_encoded", "lsass_credential",
    "powershell_bypass", "network_download", "persistence", "defense_evasion", "lateral_movement", "has_dest_ip",
    "suspicious_port", "suspicious_path", "suspicious_parent", "network_logon", "external_src_ip", "registry_op",
    "driver_load", "process_injection", "has_hashes", "high_entropy_cmdline"]


def v3_41(df: DataFrame, prefix: str = "") -> DataFrame:
    feats = {**_one_hot(D.TOP_IDS), **_wordy(D.V3_KEYWORDS, D.V3_PROCESSES, True),
             **_v23_tail([4444, 1337, 8080, 9090, 3333, 31337, 5555, 6666, 7777], D.OFFICE_PARENTS),
             "has_hashes": flag(F.length(nz("hashes")) > 10), "high_entropy_cmdline": _dense_text_flag()}
    return _emit(_behaviour_texts(df), {prefix + k: v for k, v in feats.items()})


def v4_42(df: DataFrame, prefix: str = "") -> DataFrame:
    eid, reg, port = _t("eid"), _t("reg"), _t("port")
    path = F.when(_t("image") != "", _t("image")).otherwise(_t("proc"))
    known_vendor = has_any(path, ["windows\\system32", "windows\\syswow64", "program files\\windows defender",
                                  "program files\\google\\chrome"])
    feats = {
        **_one_hot(D.TOP_IDS_V4),
        "process_create": flag(eid == 1), "network_event": flag(eid == 3), "process_end": flag(eid == 5),
        "driver_load": flag(eid == 6), "image_load": flag(eid == 7), "registry_event": flag(eid.isin(12, 13, 14)),
        "process_inject": flag(eid.isin(8, 10)), "dns_event": flag(eid == 22),
        "signed_binary": F.when(F.col("signed").isin("true", "True"), 1.0)
        .when(F.col("signed").isin("false", "False"), 0.0).when(known_vendor, 1.0).otherwise(0.5),
        "system_path_binary": flag(has_any(path, ["windows\\system32", "windows\\syswow64", "program files"])),
        "user_appdata_path": flag(has_any(path, ["appdata", "\\temp\\", "\\tmp\\", "downloads", "public",
                                                 "programdata"])),
        "registry_suspicious_key": flag(has_any(reg, D.SUSPICIOUS_REGISTRY)),
        "registry_benign_key": flag(has_any(reg, D.BENIGN_REGISTRY)),
        "dest_is_internal": flag(internal_v4("destination_ip")),
        "dest_is_external": flag(filled("destination_ip") & ~internal_v4("destination_ip")),
        "dest_suspicious_port": flag(port.isin(4444, 1337, 31337, 9090, 3333, 5555, 6666, 7777, 8888)),
        "dest_common_port": flag(port.isin(80, 443, 53, 389, 636, 88, 123, 445, 22, 3389)),
        **_wordy(D.V3_KEYWORDS, D.V3_PROCESSES, True),
        "has_hashes": flag(F.length(nz("hashes")) > 10),
        "high_entropy_cmdline": _dense_text_flag(),
        "suspicious_parent": flag(has_any(_t("parent"), D.OFFICE_PARENTS)),
        "network_logon": flag(nz("logon_type").isin("3", "10")),
        "external_src_ip": flag(filled("source_ip") & ~internal_v4("source_ip")),
    }
    return _emit(_behaviour_texts(df), {prefix + k: v for k, v in feats.items()})


V4_NAMES = [f"eid_{i}" for i in D.TOP_IDS_V4] + [
    "process_create", "network_event", "process_end", "driver_load", "image_load", "registry_event", "process_inject",
    "dns_event", "signed_binary", "system_path_binary", "user_appdata_path", "registry_suspicious_key",
    "registry_benign_key", "dest_is_internal", "dest_is_external", "dest_suspicious_port", "dest_common_port",
    "kw_count_norm", "susp_process_exact", "susp_process_partial", "base64_encoded", "lsass_credential",
    "powershell_bypass", "network_download", "persistence", "defense_evasion", "lateral_movement", "has_hashes",
    "high_entropy_cmdline", "suspicious_parent", "network_logon", "external_src_ip"]


# ---------------------------------------------------------------- 90 features over unified rows
def enterprise_90(df: DataFrame, prefix: str = "") -> DataFrame:
    """Unified rows to 90 features, in three projections of about thirty to keep generated code small."""
    staged = _stage(df, proc=F.trim(low("process_name")), path=low("process_path"),
                    parent=F.trim(low("parent_process")), cmd=low("command_line"), threat=low("threat_name"),
                    file=low("file_path"), user=low("user"), target=low("target_user"), result=low("detection_result"),
                    priv=nz("privilege_list"), type=nz("event_type"), src=nz("source_type"),
                    sev=F.coalesce(F.col("severity"), F.lit("info")), uid=nz("linux_uid"), euid=nz("linux_euid"),
                    rawpath=nz("process_path"), enc=parse_int("ticket_encryption"),
                    port=F.coalesce(F.col("dst_port"), F.lit(0)), eid=F.coalesce(F.col("raw_eid"), F.lit(0)),
                    sent=F.coalesce(F.col("bytes_sent"), F.lit(0)), out=external_address("dst_ip"),
                    inn=external_address("src_ip"))
    t, kind, sev = _t, _t("type"), _t("sev")
    one = {f"src_{s}": flag(t("src") == s) for s in D.SOURCES}
    one |= {
        "src_other": flag(~t("src").isin(D.SOURCES)),
        "etype_process_create": flag(kind == "process_create"), "etype_network": flag(kind == "network_connection"),
        "etype_auth": flag(kind == "auth"), "etype_threat_detection": flag(kind == "threat_detection"),
        "etype_registry": flag(kind.isin("registry_add", "registry_set")),
        "etype_file": flag(kind.isin("file_create", "file_access", "file_modify", "file_delete")),
        **{f"sev_{s}": flag(sev == s) for s in ("critical", "high", "medium", "low", "info")},
        "sev_high_or_critical": flag(sev.isin("critical", "high")),
        "proc_suspicious_exact": flag(t("proc").isin(D.ENT_PROCESSES)), "proc_lolbas": flag(t("proc").isin(D.LOLBAS)),
        "proc_system_path": flag(starts_any(t("path"), D.SYSTEM_PATHS)),
        "proc_signed": flag(F.col("process_signed")),
        "proc_suspicious_ext": flag(ends_any(t("cmd"), D.SCRIPT_EXTENSIONS) | has_any(
            t("cmd"), [" " + e for e in D.SCRIPT_EXTENSIONS])),
        "proc_appdata_temp": flag(has_any(t("path"), ["appdata", "temp", "/tmp"])),
        "proc_suspicious_dir": flag(has_any(t("path"), ["/dev/shm", "c:\\users\\public", "c:\\windows\\temp"])),
        "proc_has_hash": flag(filled("process_hash_md5") | filled("process_hash_sha256")),
        "proc_parent_child_susp": flag(F.concat(t("parent"), F.lit(">"), t("proc")).isin(
            [f"{a}>{b}" for a, b in D.PARENT_CHILD])),
        "proc_masquerade": flag(has_any(t("proc"), D.MASQUERADE)),
    }
    two = {
        "cmd_base64_encoded": flag(is_encoded_command(t("cmd"))),
        "cmd_lsass_cred": flag(has_any(t("cmd"), ["sekurlsa", "logonpasswords", "lsadump"])),
        "cmd_vss_delete": flag(has_any(t("cmd"), ["delete shadows", "vss"])),
        "cmd_ps_hidden": flag(has_any(t("cmd"), ["-nop", "-noninteractive", "-w hidden", "-windowstyle"])),
        "cmd_download": flag(has_any(t("cmd"), ["downloadstring", "downloadfile", "invoke-webrequest"])),
        "cmd_invoke_expression": flag(has_any(t("cmd"), ["invoke-expression", " iex", "iex("])),
        "cmd_net_user_group": flag(has_any(t("cmd"), ["net user", "net localgroup", "net group"])),
        "cmd_registry_modify": flag(has_any(t("cmd"), ["reg add", "reg delete", "regedit"])),
        "cmd_schtasks": flag(has_any(t("cmd"), ["schtasks", "taskschd", "at "])),
        "cmd_high_entropy": flag(F.when(F.length(t("cmd")) > 30, shannon_entropy(t("cmd")) > 4.5)),
        "net_dst_external": flag(t("out")), "net_src_external": flag(t("inn")),
        "net_c2_port": flag(t("port").isin(4444, 4445, 1337, 31337, 9001, 9050, 6667, 1080)),
        "net_http_port": flag(t("port").isin(80, 443, 8080, 8443)),
        "net_rdp_smb_port": flag(t("port").isin(22, 3389, 5985, 5986, 445, 135, 139)),
        "net_common_svc_port": flag(t("port").isin(21, 25, 53, 110, 143, 993, 995)),
        "net_large_transfer_10mb": flag(t("sent") > 10_000_000),
        "net_huge_transfer_100mb": flag(t("sent") > 100_000_000),
        "net_dns_external": flag(filled("dns_query") & (t("out") | ~filled("dst_ip"))),
        "net_netcat": flag(t("proc").isin("nc.exe", "ncat.exe", "socat") & (kind == "network_connection")),
        "auth_network_logon": flag(F.col("logon_type") == "network"),
        "auth_new_creds": flag(F.col("logon_type") == "new_credentials"),
        "auth_ntlm": flag(F.upper(nz("auth_package")) == "NTLM"),
        "auth_admin_user": flag(has(t("user"), "admin")),
        "auth_service_account": flag(has_any(t("user"), ["service", "svc_", "$"])),
        "auth_empty_user": flag(t("user").isin("", "-")),
        "priv_sedebug": flag(has(t("priv"), "seDebug")),
        "priv_high_privs": flag(has_any(t("priv"), ["seTakeOwnership", "seTcb"])),
        "auth_lockout": flag(kind == "account_lockout"), "auth_failure": flag(kind == "auth_failure"),
    }
    three = {
        "ad_kerberos_rc4": flag(t("enc").isin(0x17, 0x18)), "ad_kerberos_aes": flag(t("enc").isin(0x11, 0x12)),
        "ad_tgt_request": flag(F.col("kerberos_ticket_type") == "TGT"),
        "ad_tgs_request": flag(F.col("kerberos_ticket_type") == "TGS"),
        "ad_krbtgt_target": flag(has(t("target"), "krbtgt")),
        "ad_cross_domain_access": flag(filled("target_computer") & t("inn")),
        "ad_dcsync": flag((t("eid") == 4662) & has(nz("registry_value"), "0x100")),
        "ad_explicit_creds": flag(t("eid") == 4648),
        "ad_group_membership_change": flag(t("eid").isin(4728, 4732, 4756, 4757)),
        "ad_account_created_deleted": flag(t("eid").isin(4720, 4726)),
        "linux_root_uid": flag((t("uid") == "0") | (t("euid") == "0")),
        "linux_suid_escalation": flag((t("uid") != "0") & (t("euid") == "0")),
        "linux_unset_auid": flag(F.col("linux_auid").isin("-1", "4294967295", "unset")),
        "linux_critical_path": flag(starts_any(t("file"), D.CRITICAL_LINUX_PATHS)),
        "linux_tmp_execution": flag(has_any(t("rawpath"), ["/tmp/", "/dev/shm"])),
        "linux_sudo": flag(filled("sudo_command")),
        "linux_cron": flag(has(t("cmd"), "crontab") | has(t("file"), "cron")),
        "linux_kernel_module": flag(has_any(t("cmd"), ["insmod", "modprobe", "rmmod"])),
        "linux_execve": flag(F.col("syscall").isin("execve", "execveat")),
        "linux_network_syscall": flag(F.col("syscall").isin("connect", "bind", "accept")),
        "kas_labeled_malicious": flag((t("src") == "kaspersky") & t("result").isin(
            "detected", "blocked", "not_cured", "disinfected")),
        "kas_major_threat": flag(has_any(t("threat"), ["trojan", "backdoor", "ransomware", "exploit"])),
        "kas_behavioral_heuristic": flag(has_any(t("threat"), ["pdm:", "heur:"])),
        "kas_ransomware": flag(has(t("threat"), "ransom")),
        "kas_detection_confirmed": flag(t("result").isin("detected", "blocked", "not_cured")),
        "cmd_cobalt_beacon": flag(has_any(t("cmd"), ["cobalt", "beacon", "meterpreter"])),
        "cmd_empire_powersploit": flag(has_any(t("cmd"), ["empire", "powersploit", "invoke-mimikatz"])),
        "cmd_psexec_wmi": flag(has_any(t("cmd"), ["psexec", "wmiexec", "dcomexec"])),
        "etype_scheduled_task": flag(has(F.lower(kind), "scheduled task") | (t("eid") == 4698)),
        "net_external_unusual_proc": flag(t("out") & (kind == "network_connection") & ~t("proc").isin(D.QUIET_CLIENTS)),
    }
    out = staged
    for block in (one, two, three):
        out = out.withColumns({prefix + k: v.cast("double") for k, v in block.items()})
    return _drop_stage(out)


ENTERPRISE_NAMES = [f"src_{s}" for s in D.SOURCES] + [
    "src_other", "etype_process_create", "etype_network", "etype_auth", "etype_threat_detection", "etype_registry",
    "etype_file", "sev_critical", "sev_high", "sev_medium", "sev_low", "sev_info", "sev_high_or_critical",
    "proc_suspicious_exact", "proc_lolbas", "proc_system_path", "proc_signed", "proc_suspicious_ext",
    "proc_appdata_temp", "proc_suspicious_dir", "proc_has_hash", "proc_parent_child_susp", "proc_masquerade",
    "cmd_base64_encoded", "cmd_lsass_cred", "cmd_vss_delete", "cmd_ps_hidden", "cmd_download", "cmd_invoke_expression",
    "cmd_net_user_group", "cmd_registry_modify", "cmd_schtasks", "cmd_high_entropy", "net_dst_external",
    "net_src_external", "net_c2_port", "net_http_port", "net_rdp_smb_port", "net_common_svc_port",
    "net_large_transfer_10mb", "net_huge_transfer_100mb", "net_dns_external", "net_netcat", "auth_network_logon",
    "auth_new_creds", "auth_ntlm", "auth_admin_user", "auth_service_account", "auth_empty_user", "priv_sedebug",
    "priv_high_privs", "auth_lockout", "auth_failure", "ad_kerberos_rc4", "ad_kerberos_aes", "ad_tgt_request",
    "ad_tgs_request", "ad_krbtgt_target", "ad_cross_domain_access", "ad_dcsync", "ad_explicit_creds",
    "ad_group_membership_change", "ad_account_created_deleted", "linux_root_uid", "linux_suid_escalation",
    "linux_unset_auid", "linux_critical_path", "linux_tmp_execution", "linux_sudo", "linux_cron",
    "linux_kernel_module", "linux_execve", "linux_network_syscall", "kas_labeled_malicious", "kas_major_threat",
    "kas_behavioral_heuristic", "kas_ransomware", "kas_detection_confirmed", "cmd_cobalt_beacon",
    "cmd_empire_powersploit", "cmd_psexec_wmi", "etype_scheduled_task", "net_external_unusual_proc"]


# ---------------------------------------------------------------- notebook layout
def notebook_features(df: DataFrame, channel_codes: DataFrame | None = None) -> DataFrame:
    """Exploratory layout; channel codes come from `label_codes`, a small table joined by value."""
    staged = _stage(df, proc=low("process_name"), cmd=low("command_line"), parent=low("parent_image"),
                    eid=safe_int("event_id"), logon=safe_int("logon_type"), port=safe_int("destination_port"),
                    user=F.upper(nz("user")))
    cmd = _t("cmd")
    feats = {
        "nb_event_id": _t("eid"), "nb_is_high_risk_event": flag(_t("eid").isin(D.NB_HIGH_RISK_IDS)),
        "nb_is_suspicious_process": flag(has_any(_t("proc"), D.NB_PROCESSES)),
        "nb_cmdline_length": F.length(cmd), "nb_suspicious_keyword_count": count_hits(cmd, D.NB_KEYWORDS),
        "nb_has_base64": flag(search(cmd, "-enc|-e |base64|frombase64")),
        "nb_has_download": flag(search(cmd, "download|webclient|invoke-webrequest|curl|wget")),
        "nb_has_hidden": flag(search(cmd, "-w hidden|-windowstyle h|hidden")),
        "nb_parent_is_suspicious": flag(has_any(_t("parent"), D.NB_PROCESSES)),
        "nb_logon_type": _t("logon"), "nb_is_remote_logon": flag(_t("logon").isin(3, 10)),
        "nb_is_system_user": flag(_t("user").isin(D.SERVICE_USERS)), "nb_is_admin": flag(has(_t("user"), "ADMIN")),
        "nb_dest_port": _t("port"), "nb_is_common_c2_port": flag(_t("port").isin(443, 8443, 8080, 4444, 5555, 1337)),
    }
    out = _emit(staged, feats)
    if channel_codes is not None:
        out = (out.withColumn("_channel", F.coalesce(F.col("channel"), F.lit("Unknown")))
               .join(channel_codes.select(F.col("value").alias("_channel"),
                                          F.col("code").cast("double").alias("nb_channel_encoded")), "_channel", "left")
               .drop("_channel"))
    return out


def label_codes(df: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    """Distinct values numbered in sorted order, from 0. Pre-aggregated; the vocabulary is what gets ordered."""
    from pyspark.sql import Window

    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).distinct()
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


def tactic_severity(tactic: Column) -> Column:
    """2 for attack tactics, 1 for medium ones, else 0."""
    return (F.when(tactic.isNull(), 0).when(has_any(tactic, D.HIGH_TACTICS), 2)
            .when(has_any(tactic, D.MEDIUM_TACTICS), 1).otherwise(0))


