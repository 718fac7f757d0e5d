"""Reports over the postings and queue stand-ins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postgrove.operators import predicates as P, reports as R
from postgrove.plans import twins as W
from postgrove.plans.feed_queries import NOW, SOURCES, _ACTIVE, _OUTSIDE
from postgrove.plans.registry import query
from postgrove.schemas import QUEUE_STATUSES
from postgrove.session import read_table, spread
from postgrove.sources.tables import AUDITED_SQL, POSTINGS_SQL, QUEUE_SQL, audited, postings, queue

_Q = f"WITH {QUEUE_SQL}"
_P = f"WITH {POSTINGS_SQL}"
_STATS = """stats AS (SELECT lower(channel) AS channel_key, count(*) AS messages, count(job_id) AS jobs_extracted, count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status IN ('pending', 'processing', 'retry_wait')) AS waiting, count(*) FILTER (status = 'failed') AS failed, max(received_at) AS last_at FROM queue GROUP BY 1)"""
_REGISTRY = [("channel1", True), ("channel7", False), ("channel39", True), ("elsewhere", True)]
_REGISTRY_SQL = "registry AS (SELECT * FROM (VALUES ('channel1', TRUE), ('channel7', FALSE), ('channel39', TRUE), ('elsewhere', TRUE)) t(channel_key, is_active))"
_JOBS = "jobs AS (SELECT lower(channel) AS channel_key, count(*) AS jobs FROM queue WHERE job_id IS NOT NULL GROUP BY 1)"
_REPORT = f"""{_STATS}, {_REGISTRY_SQL}, {_JOBS}, report AS (SELECT r.channel_key, r.is_active, coalesce(messages, 0) AS messages, coalesce(jobs_extracted, 0) AS jobs_extracted, coalesce(completed, 0) AS completed,
    coalesce(waiting, 0) AS waiting, coalesce(failed, 0) AS failed, coalesce(jobs, 0) AS jobs, last_at FROM registry r LEFT JOIN stats USING (channel_key) LEFT JOIN jobs USING (channel_key))"""


def _registry(spark):
    return spark.createDataFrame(_REGISTRY, "channel_key string, is_active boolean")


def _report(spark, sf_dir):
    q = queue(spark, sf_dir)
    return R.channel_report(_registry(spark), R.channel_stats(q), R.count_by(q.where("job_id IS NOT NULL"), "channel", ignore_case=True))


@query("status_counts_zero_filled", f"""{_Q} SELECT s AS status, count(id) AS n FROM (VALUES ('pending'), ('processing'), ('retry_wait'), ('completed'), ('failed')) t(s) LEFT JOIN queue ON status = s GROUP BY s
    UNION ALL SELECT 'total', count(*) FROM queue""")
def status_counts(spark, sf_dir):
    """AGG1: ``failed`` has none here and ``archived`` counts in the total only."""
    return R.status_counts(queue(spark, sf_dir), QUEUE_STATUSES)


@query("channel_stats", f"{_Q}, {_STATS} SELECT * FROM stats")
def channel_stats(spark, sf_dir):
    """AGG2."""
    return R.channel_stats(queue(spark, sf_dir))


@query("jobs_per_channel", f"{_Q} SELECT lower(channel) AS key, count(*) AS n FROM queue WHERE job_id IS NOT NULL GROUP BY 1")
def jobs_per_channel(spark, sf_dir):
    """AGG3."""
    return R.count_by(queue(spark, sf_dir).where("job_id IS NOT NULL"), "channel", ignore_case=True)


@query("rows_per_channel", f"{_Q} SELECT channel AS key, count(*) AS n FROM queue GROUP BY 1")
def rows_per_channel(spark, sf_dir):
    """AGG4."""
    return R.count_by(queue(spark, sf_dir), "channel")


@query("span_per_source", f"{_P} SELECT source AS key, count(*) AS n, min(posted_at) AS first_at, max(posted_at) AS last_at FROM postings GROUP BY 1")
def span_per_source(spark, sf_dir):
    """AGG5."""
    return R.span_by(postings(spark, sf_dir), "source")


@query("channel_report_left_join", f"{_Q}, {_REPORT} SELECT * FROM report")
def channel_report(spark, sf_dir):
    """JN1."""
    return _report(spark, sf_dir)


@query("fleet_totals", f"""{_Q}, {_REPORT} SELECT count(*) AS channels, count(*) FILTER (is_active) AS active, count(*) FILTER (messages = 0) AS silent, sum(messages)::BIGINT AS messages,
    sum(jobs_extracted)::BIGINT AS jobs_extracted, sum(failed)::BIGINT AS failed, sum(jobs)::BIGINT AS jobs, max(last_at) AS last_at FROM report""")
def fleet_totals(spark, sf_dir):
    """AGG7."""
    return R.fleet_totals(_report(spark, sf_dir))


@query("orphan_channels_anti", f"""{_Q}, {_REGISTRY_SQL}, configured AS (SELECT * FROM (VALUES ('channel5', 0), ('channel1', 1), ('nowhere', 2)) t(channel_key, position)),
    named AS (SELECT channel_key, min(position) AS position FROM (SELECT * FROM configured UNION ALL SELECT lower(channel), NULL FROM queue) GROUP BY 1)
    SELECT channel_key, row_number() OVER (ORDER BY coalesce(position, 1000000), channel_key) AS place FROM named WHERE channel_key NOT IN (SELECT channel_key FROM registry)""")
def orphan_channels(spark, sf_dir):
    """JN2, AGG6, SRT7: the place is the order of display."""
    from pyspark.sql import Window

    configured = spark.createDataFrame([("channel5", 0), ("channel1", 1), ("nowhere", 2)], "channel_key string, position int")
    stored = queue(spark, sf_dir).select(R.channel_key().alias("channel_key")).distinct()
    found = R.orphan_channels(configured, stored, _registry(spark))
    order = Window.orderBy(F.coalesce("position", F.lit(1_000_000)), "channel_key")  # channels only: a few rows
    return found.select("channel_key", F.row_number().over(order).cast("long").alias("place"))


@query("window_counts", f"{_P} SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER ({_ACTIVE}) AS visible FROM postings")
def window_counts(spark, sf_dir):
    """AGG8."""
    return R.window_counts(postings(spark, sf_dir), P.active(NOW))


@query("month_bucket", f"{_P} SELECT strftime(posted_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (status = 'expired') AS bad FROM postings GROUP BY 1")
def month_bucket(spark, sf_dir):
    """SC26."""
    return postings(spark, sf_dir).groupBy(R.month("posted_at").alias("month")).agg(R.n().alias("n"), R.count_where(F.col("status") == "expired").alias("bad"))


@query("facet_audit", f"""{_P}, f AS (SELECT coalesce(source, 'none') AS source, coalesce(url_status, 'none') AS url_status, strftime(posted_at, '%Y-%m') AS month, coalesce(status = 'expired', FALSE) AS bad FROM postings)
    SELECT 'source' AS facet, source AS value, count(*) AS n, count(*) FILTER (bad) AS bad FROM f GROUP BY 2 UNION ALL SELECT 'url_status', url_status, count(*), count(*) FILTER (bad) FROM f GROUP BY 2
    UNION ALL SELECT 'month', month, count(*), count(*) FILTER (bad) FROM f GROUP BY 2""")
def facet_audit(spark, sf_dir):
    """AGG9, simplified to three facets: one scan, grouping sets."""
    rows = postings(spark, sf_dir).withColumn("bad", F.coalesce(F.col("status") == "expired", F.lit(False))).select("source", "url_status", "posted_at", "bad")
    return R.audit(rows.withColumnRenamed("source", "of"), {"source": F.col("of"), "url_status": F.col("url_status"), "month": R.month("posted_at")})


def _why(n: str) -> str:
    """The reason of a link judged by ``W.judged``, by lists and patterns written out here."""
    under = lambda hosts: rf"regexp_matches({n}_host, '(^|\.)({hosts})$')"
    return rf"""CASE WHEN {n}_link IS NULL THEN CASE WHEN trim(coalesce(url, '')) = '' THEN 'no link' ELSE 'not a web link' END WHEN NOT contains({n}_host, '.') THEN 'no public host'
        WHEN {under('freshershunt[.]in')} THEN 'aggregator ' || {n}_host WHEN {under('bit[.]ly|linktr[.]ee|t[.]co')} THEN 'wrapper ' || {n}_host
        WHEN {under('myworkdayjobs[.]com')} THEN CASE WHEN {W.matches_company(f'{n}_host', 'company')} THEN 'applicant system of the company ' ELSE 'applicant system ' END || {n}_host
        WHEN {under('forms[.]gle')} THEN 'form' WHEN {under('linkedin[.]com')} THEN 'job board ' || {n}_host WHEN {n}_host LIKE '%.gov.in' THEN 'official domain'
        WHEN {W.matches_company(f'{n}_host', 'company')} THEN 'host of the company ' || {n}_host WHEN regexp_matches({n}_host, '(^|\.)(careers|jobs)\.') THEN 'careers host ' || {n}_host
        WHEN regexp_matches({n}_path, '/(jobs?|careers|apply)(/|$)') THEN 'path of an application' ELSE 'no sign' END"""


@query("link_audit", rf"""WITH {AUDITED_SQL}, own AS (SELECT *, link AS url FROM audited), {W.judged('j', 'own', 'url', 'company')}, told AS (SELECT *, {_why('j')} AS why, trim(coalesce(url, '')) <> '' AS given FROM j),
    bodies AS (SELECT company, regexp_replace(unnest(regexp_extract_all(body, 'https?://[^\s<>"''`)\]}}]+', 0, 'i')), '[.,;:!?\x{{2026}}"'')\]}}]+$', '') AS url FROM audited), {W.judged('b', 'bodies', 'url', 'company')},
    pairs AS (
        SELECT 'posts' AS facet, CASE WHEN given THEN 'with a link' ELSE 'without a link' END AS value, given AND j_kind IN ('aggregator', 'suspicious') AS bad FROM told
        UNION ALL SELECT 'month', coalesce(strftime(created, '%Y-%m'), 'unknown'), given AND j_kind IN ('aggregator', 'suspicious') FROM told
        UNION ALL SELECT 'verdict', j_kind, j_kind IN ('aggregator', 'suspicious') FROM told WHERE given
        UNION ALL SELECT 'reason', j_kind || ': ' || why, j_kind IN ('aggregator', 'suspicious') FROM told WHERE given
        UNION ALL SELECT 'host', coalesce(j_host, 'unparseable'), j_kind IN ('aggregator', 'suspicious') FROM told WHERE given
        UNION ALL SELECT 'channel', coalesce(source, '?') || ' / @' || coalesce(channel, '?'), j_kind IN ('aggregator', 'suspicious') FROM told WHERE given
        UNION ALL SELECT 'body host', b_host, true FROM b WHERE b_kind = 'aggregator')
    SELECT facet, value, count(*) AS n, count(*) FILTER (bad) AS bad FROM pairs GROUP BY ALL""")
def link_audit(spark, sf_dir):
    """AGG9 over all documents as posts with links: verdicts, reasons, hosts, months, channels and hosts in bodies in one scan."""
    return R.link_audit(audited(spark, sf_dir))


@query("group_members", "SELECT min(doc_id) OVER (PARTITION BY text) AS \"group\", doc_id AS member FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def group_members(spark, sf_dir):
    """AGG10: every document whose text others share, with the first of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return R.group_members(docs, "digest", "doc_id")


@query("group_having_dups", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(*) > 1")
def group_having_dups(spark, sf_dir):
    """AGG10 over texts."""
    docs = read_table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return R.repeated_groups(docs, "digest", "doc_id")


_SPELT = "CASE id % 3 WHEN 0 THEN upper(substr(company, 1, 17)) WHEN 1 THEN substr(company, 1, 17) ELSE ' ' || lower(substr(company, 1, 17)) END"


@query("top_companies", f"""{_P}, spelt AS (SELECT lower(trim(c)) AS folded, trim(c) AS spelling, count(*) AS n, min(id) AS first FROM (SELECT id, {_SPELT} AS c FROM postings) WHERE trim(c) <> '' GROUP BY 1, 2),
    ranked AS (SELECT folded, spelling, sum(n) OVER (PARTITION BY folded) AS total, row_number() OVER (PARTITION BY folded ORDER BY n DESC, first) AS k FROM spelt)
    SELECT spelling AS name, total::BIGINT AS n FROM ranked WHERE k = 1 ORDER BY total DESC, spelling LIMIT 10""")
def top_companies(spark, sf_dir):
    """AGG11, SRT8: companies cut to groups and spelt in three ways."""
    p = postings(spark, sf_dir).select("id", F.expr(_SPELT).alias("company"))
    return R.top_companies(p, 10)


_STOP_SQL = ", ".join(f"'{w}'" for w in R.STOP_WORDS)


@query("popular_terms", rf"""WITH tokens AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(lower(trim(text)), '[^a-z0-9+#.]+')), '^\.+|\.+$', '', 'g') AS t FROM documents)
    WHERE length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP_SQL})),
    counted AS (SELECT t, count(*) AS n FROM tokens GROUP BY 1 ORDER BY n DESC, t LIMIT 25)
    SELECT CASE WHEN length(t) <= 3 AND regexp_matches(t, '^[a-z]+$') THEN upper(t) ELSE upper(substr(t, 1, 1)) || substr(t, 2) END AS term, n FROM counted""")
def popular_terms(spark, sf_dir):
    """AGG12 over whole texts."""
    return R.popular_terms(spread(read_table(spark, sf_dir, "documents").select("text")), 25, "text")


@query("logo_rows", f"""{_P}, l AS (SELECT id, source, CASE WHEN id % 5 = 3 THEN 'logo' || id END AS logo FROM postings)
    SELECT source AS company_key, min_by(id, (CASE WHEN logo IS NULL THEN 1 ELSE 0 END)::BIGINT * 1000000000000 + id) AS id, min_by(coalesce(logo, ''), (CASE WHEN logo IS NULL THEN 1 ELSE 0 END)::BIGINT * 1000000000000 + id) AS logo FROM l GROUP BY 1""")
def logo_rows(spark, sf_dir):
    """AGG13."""
    p = postings(spark, sf_dir).withColumn("logo", F.when(F.col("id") % 5 == 3, F.concat(F.lit("logo"), F.col("id").cast("string"))))
    return R.logo_rows(p, F.col("source"), "logo").fillna({"logo": ""})


@query("outcome_counts", f"{_P} SELECT count(*) FILTER (o = 'created') AS created, count(*) FILTER (o = 'updated') AS updated, count(*) FILTER (o = 'skipped') AS skipped FROM (SELECT CASE WHEN status IS NULL THEN 'skipped' WHEN id % 2 = 0 THEN 'created' ELSE 'updated' END AS o FROM postings)")
def outcome_counts(spark, sf_dir):
    """AGG14."""
    outcome = F.when(F.col("status").isNull(), "skipped").when(F.col("id") % 2 == 0, "created").otherwise("updated")
    return R.outcome_counts(postings(spark, sf_dir).select(outcome.alias("outcome")), ("created", "updated", "skipped"))


@query("high_water_mark", f"{_Q} SELECT channel AS key, max(message_id) AS high_water FROM queue GROUP BY 1")
def high_water_mark(spark, sf_dir):
    """AGG15."""
    return R.high_water(queue(spark, sf_dir), "channel", "message_id")


@query("cost_roll_up", f"{_Q} SELECT user_id AS job, sum(attempts)::BIGINT AS calls, bool_or(value > 50) AS ever_paid, arg_max(status, (received_at, id)) AS status FROM queue GROUP BY 1")
def cost_roll_up(spark, sf_dir):
    """AGG16."""
    q = queue(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("attempts").alias("calls"), (F.col("value") > 50).alias("used_paid"), "status", "received_at", "id")
    return R.cost_roll_up(q)


@query("daily_counts_spine", f"""{_Q}, spine AS (SELECT (DATE '2024-01-26' + d::INT) AS day FROM range(7) t(d)),
    c AS (SELECT (received_at + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS n FROM queue GROUP BY 1), f AS (SELECT spine.day, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (day))
    SELECT day::VARCHAR AS day, n, greatest(2.0::DOUBLE, 100.0::DOUBLE * n / greatest(1, (SELECT max(n) FROM f))) AS height FROM f""")
def daily_counts(spark, sf_dir):
    """AGG17: days of a reader in India, the last of them after the data ends."""
    return R.daily_counts(queue(spark, sf_dir), datetime(2024, 2, 1, 9), "Asia/Kolkata")


@query("daily_counts_of_feed", f"""{_P}, shown AS (SELECT posted_at FROM postings WHERE {_ACTIVE} AND {_OUTSIDE}), spine AS (SELECT (DATE '1998-06-09' + d::INT) AS day FROM range(7) t(d)),
    c AS (SELECT (posted_at + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS n FROM shown GROUP BY 1), f AS (SELECT spine.day, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (day))
    SELECT day::VARCHAR AS day, n, greatest(2.0::DOUBLE, 100.0::DOUBLE * n / greatest(1, (SELECT max(n) FROM f))) AS height FROM f""")
def daily_counts_of_feed(spark, sf_dir):
    """AGG17 over what the feed shows (FLT1, FLT2), in days of a reader in India."""
    shown = postings(spark, sf_dir).where(P.active(NOW) & P.outside_sources(list(SOURCES)))
    return R.daily_counts(shown, NOW, "Asia/Kolkata", at="posted_at")


@query("profile_completeness", "SELECT * FROM (VALUES (1, 100), (2, 50), (3, 0)) t(id, points)")
def profile_completeness(spark, sf_dir):
    """AGG18 on literal profiles."""
    rows = [(1, ["a"], ["b"], ["c"], ["d"]), (2, ["a", "b"], [], None, ["d"]), (3, [], None, [], None)]
    p = spark.createDataFrame(rows, "id int, a array<string>, b array<string>, c array<string>, d array<string>")
    return p.select("id", R.completeness(["a", "b", "c", "d"]).alias("points"))


@query("top_sources", f"{_P} SELECT source AS key, count(*) AS n FROM postings GROUP BY 1 ORDER BY n DESC, key LIMIT 3")
def top_sources(spark, sf_dir):
    """SRT8."""
    return R.count_by(postings(spark, sf_dir), "source").orderBy(F.desc("n"), "key").limit(3)
