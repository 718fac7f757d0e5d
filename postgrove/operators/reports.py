"""Counting reports (AGG1-AGG18) and the channel report (JN1, JN2). All group with partial aggregation before the shuffle; dimensions are small and joined last."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrove.functions import urls as U
from postgrove.functions.clock import in_zone, midnight, ntz

# Links in a body and what is cut off behind them.
BODY_LINK = r"""(?i)https?://[^\s<>"'`)\]}]+"""
AUDIT_TAIL = "[.,;:!?\u2026\"')\\]}]+$"

# Words that say nothing about a role.
STOP_WORDS = (
    "a an and any are as at batch by campus drive for free fresher freshers from hiring in is job jobs join link multiple new now of off on opening openings "
    "opportunities opportunity or other post recruitment role roles the to urgent vacancy various with work year years"
).split()


def n() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def status_counts(df: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """AGG1: a row per known status, zero if none has it, and ``total`` over all rows, unknown ones too."""
    known = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = df.groupBy("status").agg(n().alias("n"))
    rows = known.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.unionByName(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("status"), "n"))


def channel_key(c: str = "channel") -> Column:
    """Lower case, without spaces around or the leading @."""
    return F.regexp_replace(F.lower(F.trim(c)), "^@", "")


def channel_stats(queue: DataFrame) -> DataFrame:
    """AGG2."""
    status = F.col("status")
    return queue.groupBy(channel_key().alias("channel_key")).agg(
        n().alias("messages"),
        F.count("job_id").alias("jobs_extracted"),
        count_where(status == "completed").alias("completed"),
        count_where(status.isin("pending", "processing", "retry_wait")).alias("waiting"),
        count_where(status == "failed").alias("failed"),
        F.max("received_at").alias("last_at"),
    )


def count_by(df: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    """AGG3, AGG4, SRT8: most first, equal counts by key."""
    return df.groupBy((F.lower(key) if ignore_case else F.col(key)).alias("key")).agg(n().alias("n"))


def span_by(df: DataFrame, key: str, at: str = "posted_at") -> DataFrame:
    """AGG5."""
    return df.groupBy(F.col(key).alias("key")).agg(n().alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def channel_report(channels: DataFrame, stats: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN1: every registered channel with its numbers, zero where it has none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counted = jobs.select(F.col("key").alias("channel_key"), F.col("n").alias("jobs"))
    return channels.join(stats, "channel_key", "left").join(counted, "channel_key", "left").select(
        "channel_key", "is_active", *[zero(c) for c in ("messages", "jobs_extracted", "completed", "waiting", "failed", "jobs")], "last_at"
    )


def orphan_channels(configured: DataFrame, stored: DataFrame, registered: DataFrame) -> DataFrame:
    """JN2, AGG6: named in the configuration or in stored rows but not registered; configured ones first in their order, the rest A to Z."""
    named = configured.select("channel_key", "position").unionByName(stored.select("channel_key", F.lit(None).cast("int").alias("position")))
    return named.groupBy("channel_key").agg(F.min("position").alias("position")).join(registered, "channel_key", "left_anti")


def fleet_totals(report: DataFrame) -> DataFrame:
    """AGG7."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.agg(n().alias("channels"), count_where(F.col("is_active")).alias("active"), count_where(F.col("messages") == 0).alias("silent"), *[total(c) for c in ("messages", "jobs_extracted", "failed", "jobs")], F.max("last_at").alias("last_at"))


def window_counts(df: DataFrame, visible: Column) -> DataFrame:
    """AGG8: total, verified and visible in one pass."""
    return df.agg(n().alias("total"), count_where(F.col("verified")).alias("verified"), count_where(visible).alias("visible"))


def audit(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """AGG9: counts over several facets in one pass by grouping sets; ``bad`` counts the rows marked bad."""
    names = list(facets)
    rows = df.withColumns({f: F.coalesce(c, F.lit("none")) for f, c in facets.items()})
    grouped = rows.groupingSets([[f] for f in names], *names).agg(n().alias("n"), count_where(F.col("bad")).alias("bad"), F.grouping_id().alias("set"))
    ids = {((1 << len(names)) - 1) ^ (1 << (len(names) - 1 - k)): f for k, f in enumerate(names)}
    facet = F.coalesce(*[F.when(F.col("set") == i, F.lit(f)) for i, f in ids.items()])
    return grouped.select(facet.alias("facet"), F.coalesce(*names).alias("value"), "n", "bad")


def link_audit(posts: DataFrame) -> DataFrame:
    """AGG9 over posts (id, link, company, body, source, channel, created): in one scan, counts (n) of all that the audit asks for, as (facet, value) pairs, and how many of them have an
    aggregator's or a suspicious link (bad). A post's own link and those in its body are judged by the same expression; pairs are counted before they are exchanged."""
    url = F.regexp_replace(F.col("_x.url"), AUDIT_TAIL, "")
    in_body = F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(BODY_LINK), F.lit(0)), lambda u: F.struct(F.lit(False).alias("own"), u.alias("url")))
    each = posts.withColumn("_x", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("own"), F.lit(None).cast("string").alias("url"))), in_body)))
    each = each.select("company", "source", "channel", "created", F.col("_x.own").alias("own"), F.when(F.col("_x.own"), F.col("link")).otherwise(url).alias("url"))
    judged = U.judge(each, F.col("url"), F.col("company"), "_j")
    own, kind = F.col("own"), F.col("_j_kind")
    given = own & F.coalesce(F.trim("url") != "", F.lit(False))
    month_of = F.coalesce(F.date_format("created", "yyyy-MM"), F.lit("unknown"))
    host = F.coalesce("_j_host", F.lit("unparseable"))
    channel = F.concat_ws(" / ", F.coalesce("source", F.lit("?")), F.concat(F.lit("@"), F.coalesce("channel", F.lit("?"))))
    facets = [
        (own, "posts", F.when(given, "with a link").otherwise("without a link")), (own, "month", month_of), (given, "verdict", kind), (given, "reason", F.concat_ws(": ", kind, "_j_reason")),
        (given, "host", host), (given, "channel", channel), (~own & (kind == "aggregator"), "body host", host),
    ]
    pairs = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(facet).alias("facet"), value.alias("value"))) for when, facet, value in facets]))
    bad = F.coalesce(kind.isin("aggregator", "suspicious"), F.lit(False)) & (given | ~own)
    return judged.select(F.explode(pairs).alias("f"), bad.alias("bad")).groupBy("f.facet", "f.value").agg(n().alias("n"), count_where(F.col("bad")).alias("bad"))


def group_members(df: DataFrame, key: str, id_: str) -> DataFrame:
    """AGG10's members: (group, member) for each row of a group of more than one, the group named by its first id. Groups are counted first and joined
    back, so none is gathered, and a group that holds much of the table is split by the join."""
    groups = df.groupBy(key).agg(n().alias("_n"), F.min(id_).alias("group")).where(F.col("_n") > 1).select(F.col(key).alias("_key"), "group")
    return df.join(groups, df[key].eqNullSafe(groups["_key"])).select("group", df[id_].alias("member"))


def repeated_groups(df: DataFrame, key: str, id_: str) -> DataFrame:
    """AGG10: groups of more than one row, by their size and first and last id (``group_members`` has the members)."""
    return df.groupBy(key).agg(n().alias("n"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id")).where(F.col("n") > 1)


def top_companies(df: DataFrame, limit: int, name: str = "company", key: str = "id") -> DataFrame:
    """AGG11: companies in any spelling; shown as most spell it, the spelling seen first if equally many do."""
    trimmed = F.trim(name)
    spelt = df.where(F.coalesce(trimmed != "", F.lit(False))).groupBy(F.lower(trimmed).alias("folded"), trimmed.alias("spelling")).agg(n().alias("n"), F.min(key).alias("first"))
    shown = F.max_by("spelling", F.struct("n", (-F.col("first")).alias("first")))
    return spelt.groupBy("folded").agg(shown.alias("name"), F.sum("n").alias("n")).select("name", "n").orderBy(F.desc("n"), "name").limit(limit)


def popular_terms(df: DataFrame, limit: int, column: str = "role") -> DataFrame:
    """AGG12: words of a title, each once a row. ``+ # .`` belong to names of technologies."""
    # Full stops go from the ends of words in one pass over the text; what is no term is left out of the counts, which are few.
    text = F.regexp_replace(F.lower(F.trim(column)), r"(?<![a-z0-9+#.])\.+|\.+(?![a-z0-9+#.])", "")
    counted = df.select(F.explode(F.array_distinct(F.split(text, r"[^a-z0-9+#.]+"))).alias("token")).groupBy("token").agg(n().alias("n"))
    terms = counted.where((F.length("token") >= 2) & ~F.col("token").rlike(r"^[0-9]+$") & ~F.col("token").isin(*STOP_WORDS))
    counted = terms.orderBy(F.desc("n"), "token").limit(limit)
    upper = (F.length("token") <= 3) & F.col("token").rlike("^[a-z]+$")
    return counted.select(F.when(upper, F.upper("token")).otherwise(F.concat(F.upper(F.substring("token", 1, 1)), F.expr("substring(token, 2)"))).alias("term"), "n")


def logo_rows(df: DataFrame, company: Column, logo: str, key: str = "id") -> DataFrame:
    """AGG13: for each company the first row with a logo, else its first row."""
    return df.groupBy(company.alias("company_key")).agg(F.min_by(F.struct(key, logo), F.struct(F.col(logo).isNull(), F.col(key))).alias("best")).select("company_key", f"best.{key}", f"best.{logo}")


def outcome_counts(decisions: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    """AGG14: one row of counters."""
    return decisions.agg(*[count_where(F.col("outcome") == o).alias(o) for o in outcomes])


def high_water(df: DataFrame, key: str, mark: str) -> DataFrame:
    """AGG15."""
    return df.groupBy(F.col(key).alias("key")).agg(F.max(mark).alias("high_water"))


def cost_roll_up(df: DataFrame) -> DataFrame:
    """AGG16: calls of all attempts of a job, flags of its newest."""
    newest = F.max_by(F.struct("status", "used_paid"), F.struct("received_at", "id"))
    return df.groupBy("job").agg(F.sum("calls").alias("calls"), F.max("used_paid").alias("ever_paid"), newest.alias("new")).select("job", "calls", "ever_paid", F.col("new.status").alias("status"))


def daily_counts(df: DataFrame, now: datetime, zone: str, days: int = 7, at: str = "received_at") -> DataFrame:
    """AGG17: the reader's last days, zero-filled, with bar heights in percent of the highest (2 at least). ``now`` is the reader's wall time."""
    last = midnight(now)
    first = last - timedelta(days=days - 1)
    day = F.date_trunc("day", in_zone(F.col(at), zone))
    counted = df.where((day >= ntz(first)) & (day <= ntz(last))).groupBy(F.to_date(day).alias("day")).agg(n().alias("n"))
    spine = df.sparkSession.range(days).select(F.date_add(F.lit(first.date()), F.col("id").cast("int")).alias("day"))
    filled = spine.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    peak = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy()))  # ``days`` rows
    return filled.select(F.col("day").cast("string").alias("day"), "n", F.greatest(F.lit(2.0), F.lit(100.0) * F.col("n") / peak).alias("height"))


def completeness(lists: list[str]) -> Column:
    """AGG18: 25 points for each list that is not empty."""
    total = F.lit(0)
    for c in lists:
        total = total + F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 25).otherwise(0)
    return total


def month(at: str) -> Column:
    """SC26."""
    return F.date_format(at, "yyyy-MM")
