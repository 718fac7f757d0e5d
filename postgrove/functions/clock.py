"""Times derived from a given now; nothing here reads the machine's clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# Days that a posting stays in the feed, and that an imported one stays in its own.
FEED_DAYS, IMPORT_DAYS, LIFETIME_DAYS = 15, 21, 21
BACKFILL_DAYS = 7


def ntz(at: datetime) -> Column:
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def midnight(now: datetime) -> datetime:
    return now.replace(hour=0, minute=0, second=0, microsecond=0)


def cutoff(now: datetime, days: int = FEED_DAYS) -> datetime:
    """UTC midnight ``days`` ago."""
    return midnight(now) - timedelta(days=days)


def in_zone(ts: Column, zone: str) -> Column:
    """A UTC wall time as the wall time of ``zone``."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")
