"""Building blocks of the reference SQL: text snippets for an ANSI engine, written apart from the Spark code."""

from __future__ import annotations

from tidewatch.rules import detection as D
from tidewatch.schema import EVENT_VIEW


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


def any_word(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def n_words(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {lit(w)}) AS INT)" for w in words) + ")"


def any_prefix(col: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {lit(w)})" for w in words) + ")"


def any_regex(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {lit(p)})" for p in patterns) + ")"


def yes(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def se(*names: str) -> str:
    picked = names or tuple(EVENT_VIEW)
    return "se AS (SELECT " + ", ".join(f'{EVENT_VIEW[n]} AS "{n}"' for n in picked) + " FROM events)"


def base(col: str) -> str:
    return f"regexp_extract({col}, '[^/\\\\]*$')"


TEXTS = (
    "tx AS (SELECT *, lower(concat_ws(' ', nullif(command_line, ''), nullif(script_block_text, ''), "
    "nullif(image_loaded, ''), nullif(service_file, ''), nullif(message, ''), nullif(parent_command_line, ''))) AS "
    "every, lower(process_name) AS proc, lower(command_line) AS cmd, lower(parent_image) AS par, "
    "lower(script_block_text) AS scr, lower(image_loaded) AS img, lower(query_name) AS q, event_id AS eid, "
    "lower(target_object) AS reg FROM se)")

_dns = any_regex("q", D.DNS_PATTERNS)
_long = "len(list_filter(string_split(q, '.'), lambda p: length(p) > 20)) > 0"
_head = "string_split(q, '.')[1]"
_risky = any_word("img", D.SIDELOAD_PATHS)
_unsigned = "coalesce(signed IN ('', 'false'), false)"
_orig, _shown = base("lower(original_filename)"), base("proc")
_fileless = f"(CASE WHEN length(script_block_text) > 50 THEN {n_words('scr', D.FILELESS_MARKS)} ELSE 0 END)"
_out = f"(source_ip <> '' AND NOT {any_prefix('source_ip', D.PRIVATE_PREFIXES_LOGON)})"
ADV_TERMS = [
    (f"{_orig} <> '' AND {_shown} <> '' AND {_orig} <> {_shown} AND {any_word(_orig, D.PROCESSES)}", "0.6"),
    (f"{_risky} AND {_unsigned}", "0.55"), (f"{_risky} AND NOT {_unsigned}", "0.3"), (_dns, "0.6"), (_long, "0.4"),
    (f"NOT {_dns} AND NOT ({_long}) AND len(string_split(q, '.')) >= 3 AND length({_head}) > 8 AND "
     f"length(regexp_replace({_head}, '[^0-9]', '', 'g')) > 0 AND length(regexp_replace({_head}, '[^a-z]', '', 'g')) > 0 "
     f"AND length(regexp_replace({_head}, '[^0-9]', '', 'g')) / length({_head}) > 0.2", "0.5"),
    ("eid = 4698", "0.4"), (f"eid = 4698 AND {any_word('every', D.TASK_BOOT_MARKS)}", "0.15"), ("eid = 7045", "0.45"),
    ("logon_type = 9", "0.4"), (f"logon_type = 10 AND {_out}", "0.35"),
    ("regexp_matches(command_line, '%[a-zA-Z]+%') AND regexp_matches(command_line, '(?i)set\\s+\\w+=')", "0.35"),
    (f"{_fileless} >= 2", f"0.2 * least({_fileless}, 4)"),
    (f"eid = 3 AND destination_port IN {among(D.CALLBACK_PORTS)}", "0.45"),
    (f"eid = 3 AND destination_ip <> '' AND NOT {any_prefix('destination_ip', D.PRIVATE_PREFIXES_LOGON + ['0.'])} AND "
     f"{any_word('proc', D.OUTBOUND_PROCESSES)}", "0.35"),
    ("contains(proc, 'wmiprvse') AND (contains(par, 'svchost') OR par = '')", "0.4"), ("eid = 4648", "0.35"),
    (f"eid = 7 AND img <> '' AND NOT {_risky} AND {_unsigned}", "0.25"),
]
_total = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0.0 END" for c, p in ADV_TERMS)
_count = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in ADV_TERMS)
_kw = n_words("every", D.KEYWORDS)
_lol, _plol = any_word("proc", D.PROCESSES), any_word("par", D.PROCESSES)
_enc, _down, _hid = (any_word("every", w) for w in (D.ENCODED_MARKS, D.DOWNLOAD_MARKS, D.HIDDEN_MARKS))
BASE_SCORE = (
    f"least(1.0, 0.25 * least({_kw}, 4) + CASE WHEN {_lol} THEN 0.15 ELSE 0 END + CASE WHEN {_enc} THEN 0.2 ELSE 0 END "
    f"+ CASE WHEN {_down} THEN 0.15 ELSE 0 END + CASE WHEN {_hid} THEN 0.15 ELSE 0 END + CASE WHEN {_plol} THEN 0.1 "
    f"ELSE 0 END + CASE WHEN eid IN {among(D.HIGH_RISK_IDS)} THEN 0.05 ELSE 0 END + CASE WHEN logon_type IN (3, 10) "
    f"THEN 0.1 ELSE 0 END + CASE WHEN destination_port IN {among(D.WATCHED_PORTS)} THEN 0.2 ELSE 0 END)")
SCORED = (
    f"{se()}, {TEXTS}, parts AS (SELECT *, CAST({BASE_SCORE} AS DOUBLE) AS base_score, "
    f"CAST(least(1.0, {_total}) AS DOUBLE) AS adv_score, {_count} AS n_adv, {_kw} AS kw FROM tx), "
    "sc AS (SELECT *, least(1.0, greatest(base_score, adv_score, (base_score + adv_score) * 0.7)) AS ml_score FROM parts)")

_anom_tool = (f"({any_word('proc', D.ANOMALY_PROCESSES)} AND (length(cmd) > 100 OR "
              f"{any_word('cmd', D.ANOMALY_CONTEXT)}))")
ANOMALOUS = (
    f"({any_word('cmd', D.ANOMALY_KEYWORDS)} OR {any_word('scr', D.ANOMALY_KEYWORDS)} OR {_anom_tool} OR eid = 7045 OR "
    f"(eid = 4104 AND length(scr) > 200) OR (eid = 4625 AND source_ip <> '' AND NOT "
    f"{any_prefix('source_ip', ['10.', '192.168.', '172.'])}) OR (logon_type IN (3, 10) AND {_out}))")
# scores are sums of twentieths, so a rounding step before the threshold keeps 0.5 and 0.8 exact in both engines
ROUTED = (
    f"{SCORED}, ro AS (SELECT *, CASE WHEN ml_score >= 0.5 THEN 'malicious' ELSE 'benign' END AS classification, "
    f"CASE WHEN ml_score >= 0.5 AND ml_score < 0.8 AND {ANOMALOUS} THEN 'deep' ELSE 'fast' END AS path FROM sc)")
