"""Address tests, one per caller because the callers disagree on what is private."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import filled, nz, search, starts_any
from tidewatch.rules import detection as D


def private_for_iocs(ip: Column | str) -> Column:
    """Prefix list that also takes 172.2x and 172.3x whole."""
    return starts_any(nz(ip), D.PRIVATE_PREFIXES_IOC)


def private_rfc1918(ip: Column | str) -> Column:
    """Octet test: 10/8, 172.16/12, 192.168/16, 127/8; text that is no number is not private."""
    parts = F.split(nz(ip), r"\.")
    first, second = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    whole = F.forall(parts, lambda p: p.try_cast("int").isNotNull())
    inside = (first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)) | (
        first == 127)
    return F.coalesce(whole & inside, F.lit(False))


def internal_v4(ip: Column | str) -> Column:
    return starts_any(nz(ip), D.INTERNAL_PREFIXES_V4)


def external_address(ip: Column | str) -> Column:
    """Filled and outside the private ranges."""
    return filled(ip) & ~search(nz(ip), r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|::1$)")


def outside_logon(ip: Column | str) -> Column:
    """Filled and not under 10., 192.168., 172. or 127."""
    return filled(ip) & ~starts_any(nz(ip), D.PRIVATE_PREFIXES_LOGON)
