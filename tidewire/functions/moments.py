"""Time functions; `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with microseconds, which are left out where zero."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("+00:00"))


def age_seconds(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000)


def window_start(last_success: Column, now: Column) -> Column:
    """Polls look 6 hours behind the last success, or 7 days back where there is none."""
    return F.coalesce(last_success - F.expr("INTERVAL 6 HOURS"), now - F.expr("INTERVAL 7 DAYS"))


def is_due(last_success: Column, last_error: Column, minutes: Column, now: Column) -> Column:
    last = F.greatest(last_success, last_error)
    return last.isNull() | (F.timestamp_add("MINUTE", minutes, last) <= now)


def backoff_seconds(attempts: Column) -> Column:
    """60 s doubling with each attempt, an hour at most."""
    return F.least(F.lit(60.0) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(3600.0)).cast("bigint")


def relative(ts: Column, now: Column) -> Column:
    """just now, minutes, hours, days, then the date."""
    s = age_seconds(ts, now)
    n = lambda d: F.floor(s / d).cast("string")
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(n(60), F.lit("m ago")))
        .when(s < 86400, F.concat(n(3600), F.lit("h ago")))
        .when(s < 7 * 86400, F.concat(n(86400), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def reading_minutes(seconds: Column) -> Column:
    """Half a minute rounds up; one minute at least."""
    return F.greatest(F.lit(1), F.floor(seconds / 60 + F.lit(0.5))).cast("int")


def short_date(ts: Column) -> Column:
    """Jan 5, 2024; empty for null."""
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit(""))


def eastern_time(ts: Column) -> Column:
    """9:05 AM EST: a UTC time on the clock of New York; empty for null."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    # In whole hours, how far that clock is behind tells summer time.
    behind = F.round((F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(local.cast("timestamp"))) / 3600)
    return F.coalesce(F.concat(F.date_format(local, "h:mm a"), F.when(behind == 4, " EDT").otherwise(" EST")), F.lit(""))
