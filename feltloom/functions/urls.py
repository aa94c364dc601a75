"""URL predicates, parts and builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feltloom.functions.text import _c


def part(url: Column | str, which: str) -> Column:
    return F.try_parse_url(_c(url), F.lit(which))


def query_value(url: Column | str, key: str) -> Column:
    """The decoded value of a query parameter, or null."""
    return F.try_url_decode(F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(key)))


def with_query(url: Column | str, key: str, value: Column) -> Column:
    """The URL with a query parameter set; one that is there is replaced."""
    escaped = F.url_encode(value.cast("string"))
    has = _c(url).rlike(rf"[?&]{key}=")
    joint = F.when(_c(url).contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(has, F.regexp_replace(_c(url), F.lit(rf"([?&]{key}=)[^&#]*"), F.concat(F.lit("$1"), escaped))).otherwise(F.concat(_c(url), joint, F.lit(f"{key}="), escaped))


def is_web(url: Column | str) -> Column:
    """An absolute http or https URL with a host."""
    return F.coalesce(F.lower(part(F.trim(_c(url)), "PROTOCOL")).isin("http", "https") & (F.coalesce(part(F.trim(_c(url)), "HOST"), F.lit("")) != ""), F.lit(False))


def resolve(base: str, url: Column | str) -> Column:
    """An absolute URL from an absolute, scheme-relative or root-relative one; null for any other."""
    u = F.trim(_c(url))
    scheme, host = base.split("://")[0], base.split("://")[1].split("/")[0]
    return F.when(u.rlike(r"(?i)^https?://"), u).when(u.startswith("//"), F.concat(F.lit(f"{scheme}:"), u)).when(u.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), u))


def site_path(url: Column | str, hosts: list[str]) -> Column:
    """The path of an http(s) URL (or a root-relative one) of one of the hosts; null for any other."""
    u = F.trim(_c(url))
    host, scheme = F.lower(F.coalesce(part(u, "HOST"), F.lit(""))), F.coalesce(F.lower(part(u, "PROTOCOL")), F.lit(""))
    before = F.regexp_extract(u, r"^[^?#]*", 0)  # what a parser takes for the path of a root-relative one, too
    return F.when(u.startswith("/") & ~u.startswith("//"), before).when(host.isin(hosts) & scheme.isin("http", "https", ""), F.coalesce(part(u, "PATH"), before))


def on_site(url: Column | str, hosts: list[str], path: str) -> Column:
    """Whether it is such a URL and its path matches."""
    return F.when(_c(url).isNotNull(), F.coalesce(site_path(url, hosts).rlike(path), F.lit(False)))
