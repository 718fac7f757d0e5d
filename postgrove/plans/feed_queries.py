"""Feed and filter queries over the postings stand-in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postgrove.operators import feed, predicates as P
from postgrove.plans.registry import query
from postgrove.sources.tables import POSTINGS_SQL, QUEUE_SQL, postings, queue

NOW = datetime(1998, 6, 15, 12)
EVENT_NOW = datetime(2024, 1, 20, 12)
SOURCES = ("BUILDING", "MACHINERY")
_ACTIVE = """(status = 'active' OR status IS NULL) AND (expires_at > TIMESTAMP '1998-06-15 12:00:00' OR (expires_at IS NULL AND posted_at >= TIMESTAMP '1998-05-31'))
    AND posted_at >= TIMESTAMP '1998-05-31'"""
_OUTSIDE = "(source IS NULL OR source NOT IN ('BUILDING', 'MACHINERY'))"
_PUBLIC = "id, company, role, batch, location, employment_type, posted_at, coalesce(verified, FALSE) AS verified"
_WITH = f"WITH {POSTINGS_SQL} "
_BASE = feed.FeedQuery(now=NOW, exclude_sources=SOURCES)
_WHERE = f"WHERE {_ACTIVE} AND {_OUTSIDE}"


def _keys(name: str, condition, where: str) -> None:
    """Registers a filter over all postings: which ids pass."""

    @query(name, f"{_WITH} SELECT id FROM postings WHERE {where}")
    def run(spark, sf_dir):
        return postings(spark, sf_dir).where(condition()).select("id")


@query("feed_page", f"{_WITH} SELECT {_PUBLIC} FROM postings {_WHERE} ORDER BY posted_at DESC, id DESC LIMIT 20")
def feed_page(spark, sf_dir):
    """FLT1, FLT2, SRT1, SRT2, SRC1: the newest page."""
    return feed.feed_page(postings(spark, sf_dir), _BASE)


@query("page_offset", f"{_WITH} SELECT {_PUBLIC} FROM postings {_WHERE} ORDER BY posted_at, id LIMIT 7 OFFSET 14")
def page_offset(spark, sf_dir):
    """SRT1, SRT2: the third page, oldest first."""
    return feed.feed_page(postings(spark, sf_dir), feed.FeedQuery(now=NOW, exclude_sources=SOURCES, page=3, limit=7, sort="oldest"))


@query("feed_total", f"{_WITH} SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS total_pages FROM postings {_WHERE}")
def feed_total(spark, sf_dir):
    """SRT2: total and pages."""
    return feed.feed_total(postings(spark, sf_dir), _BASE)


@query("feed_all_pages", f"{_WITH} SELECT {_PUBLIC} FROM postings {_WHERE}")
def feed_all_pages(spark, sf_dir):
    """SRT11, SRC2: one scan for all pages."""
    return feed.feed_all(postings(spark, sf_dir), _BASE)


@query("feed_search", f"{_WITH} SELECT {_PUBLIC} FROM postings {_WHERE} AND (contains(lower(company), '00000012') OR contains(lower(role), '(java)'))")
def feed_search(spark, sf_dir):
    """FLT4: a literal needle, brackets included."""
    p = postings(spark, sf_dir)
    return p.where(_BASE.condition() & (P.contains("company", "00000012") | P.contains("role", "(Java)"))).select(*feed.public())


@query("feed_point", f"{_WITH}, first AS (SELECT min(id) AS id FROM postings {_WHERE}) SELECT {_PUBLIC} FROM postings WHERE id = (SELECT id FROM first) AND {_ACTIVE} AND {_OUTSIDE}")
def feed_point(spark, sf_dir):
    """FLT17: the posting with the smallest visible id, looked up by key under the same filter."""
    p = postings(spark, sf_dir).where(_BASE.condition())
    return p.join(p.agg(F.min("id").alias("id")), "id", "left_semi").select(*feed.public())


@query("feed_pool", f"{_WITH} SELECT id, posted_at FROM postings {_WHERE} ORDER BY posted_at DESC, id DESC LIMIT 500")
def feed_pool(spark, sf_dir):
    """SRT3: the newest 500."""
    return feed.pool(postings(spark, sf_dir), _BASE).select("id", "posted_at")


_keys("feed_active", lambda: P.active(NOW), _ACTIVE)
_keys("feed_exclude_source", lambda: P.outside_sources(list(SOURCES)), _OUTSIDE)
_keys(
    "feed_imported",
    lambda: P.imported("FURNITURE", NOW),
    "source = 'FURNITURE' AND (feed_active OR (feed_active IS NULL AND (status = 'active' OR status IS NULL))) AND posted_at >= TIMESTAMP '1998-05-25'",
)
_keys("feed_batch", lambda: P.contains("batch", "2025"), "contains(lower(batch), '2025')")
_keys("feed_location", lambda: P.contains("location", "DELHI"), "contains(lower(location), 'delhi')")
_keys("feed_type_internship", lambda: P.of_type("internship"), "regexp_matches(role, 'intern', 'i')")
_keys("feed_type_full_time", lambda: P.of_type("full-time"), "role IS NULL OR NOT regexp_matches(role, 'intern', 'i')")
_keys("feed_type_part_time", lambda: P.of_type("part-time"), r"regexp_matches(employment_type, 'part[\s-]*time', 'i')")
_keys("feed_type_contract", lambda: P.of_type("contract"), "regexp_matches(employment_type, 'contract|freelance|temporary', 'i')")
_keys("feed_type_remote", lambda: P.of_type("remote"), r"regexp_matches(employment_type, 'remote|work\s*from\s*home|wfh', 'i') OR regexp_matches(location, 'remote|work\s*from\s*home|wfh|anywhere', 'i')")
_keys("feed_posted_range", lambda: P.posted_between(datetime(1998, 1, 1), datetime(1998, 3, 1)), "posted_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-01'")
_keys("feed_posted_clamped", lambda: P.posted_between_clamped(datetime(1998, 1, 1), datetime(1998, 6, 1), NOW) & (F.col("posted_at") >= "1998-05-25"), "posted_at BETWEEN TIMESTAMP '1998-05-25' AND TIMESTAMP '1998-06-01'")
_keys("feed_today", lambda: P.named_window("today", NOW), "posted_at >= TIMESTAMP '1998-06-15' AND posted_at < TIMESTAMP '1998-06-16'")
_keys("feed_yesterday", lambda: P.named_window("yesterday", NOW), "posted_at >= TIMESTAMP '1998-06-14' AND posted_at < TIMESTAMP '1998-06-15'")
_keys("feed_date_window", lambda: P.named_window("last_7", NOW), "posted_at >= TIMESTAMP '1998-06-09' AND posted_at < TIMESTAMP '1998-06-16'")
_keys("feed_last_30", lambda: P.named_window("last_30", NOW), "posted_at >= TIMESTAMP '1998-05-17' AND posted_at < TIMESTAMP '1998-06-16'")
_keys("feed_custom_reversed", lambda: P.named_window("custom", NOW, datetime(1998, 3, 9), datetime(1998, 3, 2)), "posted_at >= TIMESTAMP '1998-03-02' AND posted_at < TIMESTAMP '1998-03-10'")
_keys("internship_window", lambda: P.named_window("last_21", NOW), "posted_at >= TIMESTAMP '1998-05-26' AND posted_at < TIMESTAMP '1998-06-16'")
_keys("internship_single_day", lambda: P.named_window("custom", NOW, None, datetime(1998, 3, 2)), "posted_at >= TIMESTAMP '1998-03-02' AND posted_at < TIMESTAMP '1998-03-03'")
_keys("live_search", lambda: P.search_live("5 react"), "contains(lower(coalesce(company, '') || ' ' || coalesce(role, '')), '5 react')")
_keys("recovery_window", lambda: P.recoverable(NOW, 14, "BUILDING"), "(source IS NULL OR source <> 'BUILDING') AND posted_at >= TIMESTAMP '1998-06-01 12:00:00'")
_keys(
    "reprocess_candidates",
    lambda: P.reprocessable(NOW, 30, "BUILDING"),
    "(status = 'active' OR status IS NULL) AND verified IS DISTINCT FROM TRUE AND (source IS NULL OR source <> 'BUILDING') AND posted_at >= TIMESTAMP '1998-05-16 12:00:00'",
)
_keys("has_lead", lambda: P.has_lead(), "coalesce(trim(company), '') <> '' OR coalesce(trim(apply_url), '') <> '' OR coalesce(trim(source_url), '') <> ''")
_keys("unverified_links", lambda: P.unverified_link(), "apply_url IS NOT NULL AND verified IS DISTINCT FROM TRUE AND (url_status IS NULL OR url_status IN ('needs_review', 'broken'))")


@query("null_rules", """
SELECT * FROM (SELECT f, (f IS NULL OR f = 'active') AS is_active, f IS DISTINCT FROM 'active' AS other, (f IS NULL OR f NOT IN ('active', 'closed')) AS outside,
    (f IS NULL OR NOT regexp_matches(f, 'act')) AS unmatched FROM (VALUES (NULL), ('active'), ('closed'), ('expired'), ('')) t(f))""")
def null_rules(spark, sf_dir):
    """The four rules for missing values, on literal rows."""
    from postgrove.functions.nulls import is_or_null, not_equal, not_in, not_matching

    f = F.col("f")
    rows = spark.createDataFrame([(None,), ("active",), ("closed",), ("expired",), ("",)], "f string")
    return rows.select("f", is_or_null(f, "active").alias("is_active"), not_equal(f, "active").alias("other"), not_in(f, ["active", "closed"]).alias("outside"), not_matching(f, "act").alias("unmatched"))


@query("claimable_count", f"""WITH {QUEUE_SQL} SELECT count(*) AS n FROM queue WHERE status = 'pending' OR (status = 'retry_wait' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20 12:00:00'))""")
def claimable_count(spark, sf_dir):
    """FLT18."""
    return queue(spark, sf_dir).where(P.claimable(EVENT_NOW)).agg(F.count(F.lit(1)).alias("n"))


@query("stale_claims", f"""WITH {QUEUE_SQL} SELECT id FROM queue WHERE status = 'processing' AND (claimed_at IS NULL OR claimed_at <= TIMESTAMP '2024-01-20 11:55:00')""")
def stale_claims(spark, sf_dir):
    """FLT19, ST5."""
    return queue(spark, sf_dir).where(P.stale_claim(EVENT_NOW)).select("id")


@query("channel_gate", f"""WITH {QUEUE_SQL}, registry AS (SELECT * FROM (VALUES ('channel1', FALSE), ('channel2', TRUE), ('channel3', NULL)) t(channel_key, is_active))
SELECT q.channel, count(*) AS n FROM queue q LEFT JOIN registry r ON lower(q.channel) = r.channel_key WHERE coalesce(r.is_active, TRUE) GROUP BY q.channel""")
def channel_gate(spark, sf_dir):
    """FLT24: paused channels drop out, unknown ones stay."""
    registry = spark.createDataFrame([("channel1", False), ("channel2", True), ("channel3", None)], "channel_key string, is_active boolean")
    joined = queue(spark, sf_dir).withColumn("channel_key", F.lower("channel")).join(registry, "channel_key", "left")
    return joined.where(P.channel_enabled()).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
