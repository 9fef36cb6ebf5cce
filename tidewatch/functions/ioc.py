"""Indicator extraction as one array column per event; explode for the long form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.net import private_for_iocs, private_rfc1918
from tidewatch.functions.text import has_any, low, nz, starts_any
from tidewatch.rules import intel as I


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


#: What every hit of a pattern holds. A text without it is not searched: an address pattern tries each run of letters from every start.
HOLDS = {"url": "://", "email": "@", "file_path": ":\\", "registry": "hk"}


def _found(text: Column, kind: str, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind not in HOLDS:
        return hits
    return F.when(F.contains(F.lower(text) if kind == "registry" else text, F.lit(HOLDS[kind])), hits).otherwise(F.array().cast("array<string>"))


def text_indicators_a(text: Column) -> Column:
    """First pattern set over a text: array<struct<type, value>>, in type order then text order."""
    parts = []
    for kind, pattern in I.IOC_PATTERNS_A.items():
        found = F.transform(_found(text, kind, pattern), lambda v: F.trim(v))
        if kind == "ip":
            found = F.filter(found, lambda v: ~private_for_iocs(v))
        elif kind == "domain":
            found = F.filter(found, lambda v: ~v.isin(I.COMMON_DOMAINS))
        parts.append(_typed(kind, F.filter(found, lambda v: v != "")))
    return F.concat(*parts)


def event_indicators_a(text_fields: list[str], process: str = "process_name", combined: Column | None = None) -> Column:
    """First pattern set over several event fields, plus known attack tools by process name."""
    if combined is None:
        combined = F.concat_ws(" ", *[F.when(nz(c) != "", nz(c)) for c in text_fields])
    tool = F.when(has_any(low(process), I.TOOL_PROCESSES),
                  F.array(F.struct(F.lit("process").alias("type"), nz(process).alias("value"))))
    empty = F.array().cast("array<struct<type:string,value:string>>")
    return F.concat(text_indicators_a(combined), F.coalesce(tool, empty))


def text_indicators_b(text: Column) -> Column:
    """Second pattern set (case-insensitive), distinct per text."""
    parts = []
    for kind, pattern in I.IOC_PATTERNS_B.items():
        found = F.array_distinct(_found(text, kind, "(?i)" + pattern))
        if kind == "ip":
            found = F.filter(found, lambda v: ~private_rfc1918(v))
        parts.append(_typed(kind, found))
    return F.concat(*parts)


def confidence_b(kind: Column, value: Column) -> Column:
    base_domain = F.when(has_any(F.lower(value), I.BAD_DOMAIN_WORDS), 0.8).otherwise(0.5)
    short = F.when(F.length(value) < 10, 0.1).otherwise(0.0)
    return F.least(
        F.when(kind == "ip", F.when(starts_any(value, I.BAD_IP_PREFIXES), 0.9).otherwise(0.5))
        .when(kind == "domain", base_domain + short)
        .when(kind.isin("hash_md5", "hash_sha1", "hash_sha256"), 0.7)
        .when((kind == "url") & has_any(F.lower(value), I.BAD_URL_WORDS), 0.75)
        .otherwise(0.5), F.lit(1.0))


def context_b(kind: Column) -> Column:
    out = None
    for k, v in I.IOC_CONTEXT_B.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise("Indicator")


def indicator_type(value: Column) -> Column:
    return (F.when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
            .when(value.rlike("^[a-fA-F0-9]{32}$"), "hash_md5")
            .when(value.rlike("^[a-fA-F0-9]{40}$"), "hash_sha1")
            .when(value.rlike("^[a-fA-F0-9]{64}$"), "hash_sha256")
            .when(F.startswith(value, F.lit("http://")) | F.startswith(value, F.lit("https://")), "url")
            .when(F.contains(value, F.lit(".")) & ~F.endswith(value, F.lit(".exe")), "domain")
            .otherwise("process"))
