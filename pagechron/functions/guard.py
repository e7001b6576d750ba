"""Which URLs may be fetched on a page's word: public web hosts only."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import has_web_scheme, host_of

# Names and address blocks of local networks.
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".home.arpa")
PRIVATE_V4 = [ipaddress.ip_network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.168.0.0/16 198.18.0.0/15 224.0.0.0/4 240.0.0.0/4".split()]
PRIVATE_V6 = [ipaddress.ip_network(n) for n in "::/128 ::1/128 fc00::/7 fe80::/10 ff00::/8".split()]
MAPPED_V6 = [ipaddress.ip_network(n) for n in ("::ffff:0:0/96", "64:ff9b::/96")]


def _number(part: str) -> int | None:
    """A part of an address in decimal, octal or hexadecimal."""
    if re.fullmatch("0[xX][0-9A-Fa-f]*", part):
        return int(part[2:] or "0", 16)
    if re.fullmatch("0[0-7]+", part):
        return int(part, 8)
    return int(part) if re.fullmatch("[0-9]+", part, re.A) else None


def ipv4(host: str) -> ipaddress.IPv4Address | None:
    """The address a host spells, in any form that browsers read; null for a name."""
    parts = [_number(p) for p in host.removesuffix(".").split(".")]
    if None in parts or not 1 <= len(parts) <= 4 or any(p > 255 for p in parts[:-1]) or parts[-1] >= 256 ** (5 - len(parts)):
        return None
    return ipaddress.IPv4Address(sum(p << (8 * (3 - k)) for k, p in enumerate(parts[:-1])) + parts[-1])


def is_safe(url: str | None) -> bool:
    """An http or https URL of a public host, without credentials."""
    try:
        parts = urlsplit((url or "").strip())
        host, _ = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not host or parts.username is not None or parts.password is not None:
        return False
    if "[" in parts.netloc:
        try:
            at = ipaddress.IPv6Address(host.split("%")[0])
        except ValueError:
            return False
        inner = next((ipaddress.IPv4Address(int(at) & 0xFFFFFFFF) for n in MAPPED_V6 if at in n), None)
        return not any(at in n for n in PRIVATE_V6) and not (inner and any(inner in n for n in PRIVATE_V4))
    at = ipv4(host)
    if at is not None:
        return not any(at in n for n in PRIVATE_V4)
    return "." in host and host != "localhost" and not host.endswith(LOCAL_SUFFIXES)


def absolute(base: str | None, href: str | None) -> str | None:
    """A link resolved against its page, without fragment changes; null if neither makes a URL."""
    if not href:
        return None
    try:
        out = urljoin(base or "", href.strip())
        parts = urlsplit(out)
    except ValueError:
        return None
    if not parts.scheme or not parts.netloc:
        return None
    return out if parts.path or parts.query else out + "/"


def is_safe_fetch_target(url: Column) -> Column:
    """Column form of is_safe, a batch of URLs at a time."""

    @F.pandas_udf("boolean")
    def safe(urls: pd.Series) -> pd.Series:
        return urls.map(is_safe, na_action=None)

    return safe(url)


def resolve_url(base: Column, href: Column) -> Column:
    """Column form of absolute."""

    @F.pandas_udf("string")
    def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([absolute(b, h) for b, h in zip(base, href, strict=True)], dtype=object)

    return resolved(base, href)


def resolves_publicly(urls, dns):
    """strict policy: of (url, host) those whose every address in (host, address) is public.

    A host that dns doesn't know passes, as with no resolver.
    """
    spelled = F.when(F.contains("address", F.lit(":")), F.concat(F.lit("http://["), F.col("address"), F.lit("]/"))).otherwise(F.concat(F.lit("http://"), F.col("address"), F.lit("/")))
    known = dns.groupBy("host").agg(F.bool_and(is_safe_fetch_target(spelled)).alias("_public"))
    return urls.join(known, "host", "left").filter(F.coalesce("_public", F.lit(True))).drop("_public")


def may_fetch(urls, policy: str = "literal", dns=None):
    """The rows of (url) that a policy lets be fetched.

    off: any web URL; literal: hosts that don't spell a private address; strict:
    also none whose address in ``dns`` (host, address) is private, where it is given.
    """
    if policy not in ("literal", "strict", "off"):
        raise ValueError("policy must be literal, strict or off")
    if policy == "off":
        return urls.filter(has_web_scheme(F.col("url")))
    safe = urls.filter(is_safe_fetch_target(F.col("url")))
    if policy == "literal" or dns is None:
        return safe
    return resolves_publicly(safe.withColumn("host", host_of(F.col("url"))), dns).select(*urls.columns)


def follow_redirects(urls, redirects, most: int = 3):
    """url to final_url over (url, location), each hop guarded; null where a hop is unsafe or one too many."""
    hops = redirects.select(F.col("url").alias("_from"), resolve_url(F.col("url"), F.col("location")).alias("_to"))
    out = urls.select("url", F.when(is_safe_fetch_target(F.col("url")), F.col("url")).alias("final_url"))
    for _ in range(most):
        step = out.join(hops, out.final_url == hops["_from"], "left")
        out = step.select("url", F.when(F.col("_from").isNull(), F.col("final_url")).when(is_safe_fetch_target(F.col("_to")), F.col("_to")).alias("final_url"))
    last = out.join(hops.select("_from").distinct(), out.final_url == F.col("_from"), "left")
    return last.select("url", F.when(F.col("_from").isNull(), F.col("final_url")).alias("final_url"))
