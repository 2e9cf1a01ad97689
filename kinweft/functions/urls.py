"""URL predicates and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_web_url(c: Column) -> Column:
    """http or https with a host; false for null and malformed."""
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0), F.lit(False))


def looks_like_url(c: Column) -> Column:
    """The prefix alone, so that malformed ones can be counted."""
    return F.coalesce(F.lower(c).rlike("^https?://"), F.lit(False))


def is_allowed_url(c: Column, host: str, prefix: str) -> Column:
    """https, this host, no port, user, query or fragment, and a path below prefix."""
    part = lambda p: F.try_parse_url(c, F.lit(p))
    bare = part("QUERY").isNull() & part("REF").isNull() & part("USERINFO").isNull() & (part("AUTHORITY") == host)
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & (F.lower(part("HOST")) == host) & bare & F.startswith(part("PATH"), F.lit(prefix)), F.lit(False))


def is_thumbnail_of(thumb: Column, original: Column, widths: list[int], most: int | None = None) -> Column:
    """Whether thumb is ``/thumb/<path of original>/<width>px-<file>`` with a known width."""
    path, name = F.try_parse_url(original, F.lit("PATH")), F.element_at(F.split(original, "/"), -1)
    last = F.element_at(F.split(thumb, "/"), -1)
    width = F.regexp_extract(last, r"^(\d+)px-", 1)
    file = F.regexp_replace(last, r"^\d+px-", "")
    same = F.try_url_decode(file) == F.try_url_decode(name)
    fits = width.isin([str(w) for w in widths if most is None or w <= most])
    return F.coalesce(F.contains(thumb, F.concat(F.lit("/thumb"), path)) & same & fits, F.lit(False))


def query_parameter(c: Column, key: str) -> Column:
    """The decoded value of a parameter of a query string or URL; null where absent."""
    return F.try_url_decode(F.nullif(F.regexp_extract(c, rf"[?&]{key}=([^&#]*)", 1), F.lit("")))


def is_safe_path(c: Column) -> Column:
    """A relative path that stays below its root."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.coalesce(~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), ".."), F.lit(False))


def ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    n = sum((F.element_at(parts, k + 1).cast("bigint") * (256 ** (3 - k)) for k in range(4)), F.lit(0))
    return F.when(c.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), n)


def is_public_ipv4(c: Column) -> Column:
    """Outside the private, loopback, link-local, shared, documentation and multicast ranges."""
    n = ipv4_number(c)
    # First address and prefix length of the special ranges.
    ranges = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3)]
    inside = F.lit(False)
    for first, bits in ranges:
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(first.split(".")))
        inside = inside | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(~inside, F.lit(False))
