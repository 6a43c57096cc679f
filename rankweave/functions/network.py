"""Guards for fetches and callers: addresses, roles."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Address ranges that no crawl may reach.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")
# What each role may do.
SCOPES = {"admin": ("search", "ingest", "delete", "admin"), "writer": ("search", "ingest"), "reader": ("search",)}


def is_blocked(ip: str | None) -> bool:
    """Whether an address is outside the public internet; what is no address is blocked. One mapped into IPv6 counts as what it maps."""
    try:
        address = ipaddress.ip_address((ip or "").strip("[]").split("%")[0])
    except ValueError:
        return True
    address = getattr(address, "ipv4_mapped", None) or address
    return any(address in ipaddress.ip_network(n) for n in (BLOCKED_V4 if address.version == 4 else BLOCKED_V6))


@F.pandas_udf(BooleanType())
def _blocked_v6(ips: pd.Series) -> pd.Series:
    return ips.map(is_blocked)


def blocked_v4(ip: Column) -> Column:
    """Whether a dotted address lies in a blocked range; what is no address is blocked."""
    parts = F.split(ip, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("int") for i in range(4)]
    number = sum((o.cast("long") * (1 << (24 - 8 * i)) for i, o in enumerate(octets)), F.lit(0).cast("long"))
    inside = F.lit(False)
    for n in map(ipaddress.ip_network, BLOCKED_V4):
        inside = inside | number.between(int(n.network_address), int(n.broadcast_address))
    sound = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for o in octets:
        sound = sound & o.between(0, 255)
    return ~F.coalesce(sound, F.lit(False)) | F.coalesce(inside, F.lit(True))


def blocked_address(ip: Column) -> Column:
    """Whether an address, IPv4 or IPv6, is outside the public internet. Only what has a colon leaves the JVM."""
    return F.when(F.coalesce(ip.contains(":"), F.lit(False)), _blocked_v6(ip)).otherwise(blocked_v4(ip))


def scopes_of(roles: Column) -> Column:
    """The sorted scopes of an array of roles; unknown ones give none."""
    table = F.create_map(*[x for r, s in SCOPES.items() for x in (F.lit(r), F.array(*[F.lit(v) for v in s]))])
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(roles, none), lambda r: F.coalesce(F.try_element_at(table, r), none)))))
