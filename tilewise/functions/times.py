"""Time as numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    since = F.expr(f"CAST(`{ts}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL DAY TO SECOND)")
    part = lambda what: F.extract(F.lit(what), since).cast("decimal(20,6)")
    return (((part("DAYS") * 24 + part("HOURS")) * 60 + part("MINUTES")) * 60_000_000 + (part("SECONDS") * 1_000_000)).cast("bigint")


def seconds(ts: str) -> Column:
    """Seconds since 1970 as double."""
    return micros(ts) / 1e6
