"""Filters as boolean columns (FLT1-FLT25). Each is a plain expression, so Catalyst pushes down what the file format can use."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from postgrove.functions.clock import FEED_DAYS, IMPORT_DAYS, cutoff, midnight, ntz
from postgrove.functions.nulls import is_or_null, not_equal, not_in, not_matching

# What the type filter looks for.
TYPE_PATTERNS = {"part-time": r"(?i)part[\s-]*time", "contract": r"(?i)contract|freelance|temporary", "remote": r"(?i)remote|work\s*from\s*home|wfh"}
REMOTE_PLACE = r"(?i)remote|work\s*from\s*home|wfh|anywhere"
INTERNSHIP = r"(?i)intern"
TYPES = ("internship", "full-time", "part-time", "contract", "remote")


def active(now: datetime) -> Column:
    """FLT1: shown, not expired, and posted within the window."""
    cut = ntz(cutoff(now, FEED_DAYS))
    posted, expires = F.col("posted_at"), F.col("expires_at")
    return is_or_null(F.col("status"), "active") & ((expires > ntz(now)) | (expires.isNull() & (posted >= cut))) & (posted >= cut)


def outside_sources(sources: list[str]) -> Column:
    """FLT2: a missing source passes."""
    return not_in(F.col("source"), sources)


def imported(source: str, now: datetime) -> Column:
    """FLT3: rows of one imported source, by their own flag or, where it is missing, by status."""
    shown = F.col("feed_active") | (F.col("feed_active").isNull() & is_or_null(F.col("status"), "active"))
    return (F.col("source") == source) & shown & (F.col("posted_at") >= ntz(cutoff(now, IMPORT_DAYS)))


def contains(column: str, needle: str) -> Column:
    """FLT5, FLT6: the needle is literal text in any case."""
    return F.lower(column).contains(needle.lower())


def search(needle: str) -> Column:
    """FLT4: company or role."""
    return contains("company", needle) | contains("role", needle)


def search_live(needle: str) -> Column:
    """FLT15: live rows are searched over company and role together, so a hit may span both."""
    return F.lower(F.concat(F.coalesce("company", F.lit("")), F.lit(" "), F.coalesce("role", F.lit("")))).contains(needle.lower())


def of_type(kind: str) -> Column:
    """FLT7-FLT10. ``internship`` also matches "International", as it should."""
    if kind == "internship":
        return F.col("role").rlike(INTERNSHIP)
    if kind == "full-time":
        return not_matching(F.col("role"), INTERNSHIP)
    if kind == "remote":
        return F.col("employment_type").rlike(TYPE_PATTERNS[kind]) | F.col("location").rlike(REMOTE_PLACE)
    if kind in TYPE_PATTERNS:
        return F.col("employment_type").rlike(TYPE_PATTERNS[kind])
    raise ValueError(f"type must be one of {', '.join(TYPES)}")


def posted_between(first: datetime | None, last: datetime | None) -> Column:
    """FLT11: both ends count; reversed ends are an error."""
    if first and last and first > last:
        raise ValueError("the posted range is reversed")
    out = F.lit(True)
    if first:
        out = out & (F.col("posted_at") >= ntz(first))
    if last:
        out = out & (F.col("posted_at") <= ntz(last))
    return out


def posted_between_clamped(first: datetime | None, last: datetime | None, now: datetime) -> Column:
    """FLT12: a lower end before the import window is dropped, as the base filter is stricter."""
    return posted_between(first if first and first >= cutoff(now, IMPORT_DAYS) else None, last)


def named_window(name: str, now: datetime, first: datetime | None = None, last: datetime | None = None) -> Column:
    """FLT13, FLT14: calendar windows of the reader; ``now`` and the days are the reader's wall time."""
    day, today = timedelta(days=1), midnight(now)
    if name == "custom":
        first, last = first or last, last or first
        if first is None:
            return F.lit(True)
        first, last = sorted((midnight(first), midnight(last)))
        span = (first, last + day)
    else:
        span = {"today": (today, today + day), "yesterday": (today - day, today), "last_7": (today - 6 * day, today + day), "last_21": (today - 20 * day, today + day), "last_30": (today - 29 * day, today + day)}[name]
    return (F.col("posted_at") >= ntz(span[0])) & (F.col("posted_at") < ntz(span[1]))


def page_parameters(page: int | str | None = None, limit: int | str | None = None, sort: str = "newest", usual_limit: int = 20) -> tuple[int, int, str]:
    """FLT16: page and limit as whole numbers in their bounds and a known sort, or a ValueError. Missing ones have their usual values."""
    def whole(value: int | str | None, usual: int, name: str, most: int | None = None) -> int:
        text = str(usual if value is None else value).strip()
        if not (text.isascii() and text.isdigit()) or int(text) < 1 or (most is not None and int(text) > most):
            raise ValueError(f"{name} must be a whole number from 1" + (f" to {most}" if most else ""))
        return int(text)

    if sort not in ("newest", "oldest"):
        raise ValueError("sort must be newest or oldest")
    return whole(page, 1, "page"), whole(limit, usual_limit, "limit", 100), sort


def instant(value: str | None, name: str) -> datetime | None:
    """FLT16: an ISO 8601 date or date-time, in UTC without a zone; a ValueError for anything else, null for none."""
    if value is None:
        return None
    try:
        found = datetime.fromisoformat(value.strip())
    except ValueError:
        raise ValueError(f"{name} must be an ISO 8601 date or date-time") from None
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def posting_id(value: str) -> str:
    """FLT16: 24 hexadecimal digits, or a ValueError."""
    if len(value) != 24 or any(c not in "0123456789abcdefABCDEF" for c in value):
        raise ValueError("a posting's id has 24 hexadecimal digits")
    return value.lower()


def claimable(now: datetime) -> Column:
    """FLT18."""
    due = F.col("next_retry_at")
    return (F.col("status") == "pending") | ((F.col("status") == "retry_wait") & (due.isNull() | (due <= ntz(now))))


def stale_claim(now: datetime, minutes: int = 5) -> Column:
    """FLT19."""
    claimed = F.col("claimed_at")
    return (F.col("status") == "processing") & (claimed.isNull() | (claimed <= ntz(now - timedelta(minutes=minutes))))


def recoverable(now: datetime, days: int, excluded: str) -> Column:
    """FLT20."""
    return not_equal(F.col("source"), excluded) & (F.col("posted_at") >= ntz(now - timedelta(days=days)))


def reprocessable(now: datetime, days: int, excluded: str) -> Column:
    """FLT21: active, not verified, of another source, of the last days."""
    return is_or_null(F.col("status"), "active") & not_equal(F.col("verified"), True) & recoverable(now, days, excluded)


def has_lead() -> Column:
    """FLT22: something to start a search from."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled("company") | filled("apply_url") | filled("source_url")


def host_under(column: str, suffix: str) -> Column:
    """FLT23: the host itself or one below it."""
    return (F.col(column) == suffix) | F.col(column).endswith("." + suffix)


def channel_enabled() -> Column:
    """FLT24, after a left join with the registry: unknown channels are allowed."""
    return F.coalesce("is_active", F.lit(True))


def unverified_link() -> Column:
    """FLT25."""
    return F.col("apply_url").isNotNull() & not_equal(F.col("verified"), True) & (F.col("url_status").isNull() | F.col("url_status").isin("needs_review", "broken"))
