"""Ages, freshness and deadlines; `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_time(c: Column) -> Column:
    """Epoch seconds, ISO 8601 with or without a zone (UTC then); null for anything else."""
    number = F.when(c.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.timestamp_micros((F.trim(c).cast("double") * 1_000_000).cast("long")))
    return F.coalesce(number, F.try_to_timestamp(F.trim(c)))


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


def age_seconds(at: Column, now: Column) -> Column:
    """Never negative; null if either is."""
    age = epoch_seconds(now) - epoch_seconds(at)
    return F.when(age < 0, 0.0).otherwise(age)


def age_hours(at: Column, now: Column, digits: int = 1) -> Column:
    return F.round(age_seconds(at, now) / 3600, digits)


def age_days(at: Column, now: Column, digits: int = 1) -> Column:
    return F.round(age_seconds(at, now) / 86400, digits)


def days_remaining(until: Column, now: Column) -> Column:
    return F.floor((epoch_seconds(until) - epoch_seconds(now)) / 86400).cast("long")


def expiry_level(until: Column, now: Column, soon: int = 14) -> Column:
    left = days_remaining(until, now)
    return F.when(until.isNull(), "unparseable").when(left < 0, "expired").when(left <= soon, "expiring-soon").otherwise("ok")


def rpo_status(last: Column, now: Column, hours: float = 24) -> Column:
    return F.when(last.isNull(), "never").when(age_seconds(last, now) > hours * 3600, "breach").otherwise("within")


def cache_hit(cached_at: Column, now: Column, ttl_seconds: Column, tag: Column, current_tag: Column) -> Column:
    return (age_seconds(cached_at, now) <= ttl_seconds) & tag.eqNullSafe(current_tag)


def next_retry(now: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + (seconds * 1_000_000).cast("long"))


def sla_state(oldest: Column, now: Column, seconds: float = 300) -> Column:
    return F.when(oldest.isNull(), "ok").when(age_seconds(oldest, now) > seconds, "stale").otherwise("ok")


def freshness(present: Column, observed: Column, healthy: Column, now: Column, seconds: float) -> Column:
    """missing, unknown, stale, degraded or ok, the first that holds."""
    return F.when(~present, "missing").when(observed.isNull(), "unknown").when(age_seconds(observed, now) > seconds, "stale").when(~healthy, "degraded").otherwise("ok")


def review_state(deadline: Column, now: Column) -> Column:
    return F.when(deadline.isNull(), "reopened").when(now >= deadline, "due").otherwise("open")


def from_nanos(ns: Column) -> Column:
    """A time from nanoseconds since 1970, in whole numbers, as a double cannot hold them."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def only_complete_clock(complete: Column, now: Column, prior: Column) -> Column:
    return F.when(complete, now).otherwise(prior)
