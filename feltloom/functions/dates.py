"""Dates and times. Session time zone is UTC; civil dates name their zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feltloom.functions.text import ITALIAN_MONTHS, _c


def parse_first(x: Column | str, *formats: str) -> Column:
    """The timestamp by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(_c(x), F.lit(f)) for f in formats])


def rfc1123z(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "EEE, dd MMM yyyy HH:mm:ss xx")


def long_date(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "d MMMM yyyy")


def italian_date(d: Column | str) -> Column:
    """``5 Ott 2026``, whatever the locale."""
    return F.concat_ws(" ", F.day(_c(d)).cast("string"), F.element_at(F.array(*map(F.lit, ITALIAN_MONTHS)), F.month(_c(d))), F.year(_c(d)).cast("string"))


def civil_date(ts: Column | str, zone: str = "Europe/Rome") -> Column:
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def retry_after_seconds(x: Column | str, now: Column | str) -> Column:
    """A Retry-After header as seconds: a number or an HTTP date; negative, past or unreadable is 0."""
    at = F.try_to_timestamp(F.regexp_replace(F.trim(_c(x)), r"^\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    seconds = F.coalesce(F.trim(_c(x)).try_cast("bigint"), F.unix_timestamp(at) - F.unix_timestamp(_c(now)), F.lit(0))
    return F.greatest(seconds, F.lit(0)).cast("bigint")


def publication_date(own: Column | str, *later: Column | str, observed: Column | str) -> Column:
    """An item's own date, else the first known of the later ones, else when it was observed."""
    return F.coalesce(_c(own), *map(_c, later), _c(observed))
