"""Deduplication, lookups and state changes over snapshots (SET1-SET5, JN4-JN8, JN10, ST1-ST19, SNK1-SNK5, SRC4).

A snapshot is a DataFrame; each function gives the rows to write next. One row of a key is picked by partial aggregation, so a hot key is no hot task."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrove.functions.clock import LIFETIME_DAYS, ntz
from postgrove.functions.urls import resolved_fields
from postgrove.operators.predicates import claimable, stale_claim

# Delays and bounds of the work queues.
BASE_MS, MOST_MS, MOST_ATTEMPTS = 5_000, 600_000, 6


def pick(df: DataFrame, keys: list[str], first_by: list[Column]) -> DataFrame:
    """One whole row per key: the first by ``first_by``, of which nulls come first."""
    order = [c.alias(f"_{k}") for k, c in enumerate(first_by)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def latest(events: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """ST1: the newest event of each key is its state; equal times fall to the larger id."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(at, id_)).alias("_row")).select("_row.*")


def first_spellings(named: DataFrame) -> DataFrame:
    """SET1, SRC10 over (name, position): each name once in any case, without spaces around or the leading @, as first spelt."""
    clean = F.regexp_replace(F.trim("name"), "^@", "")
    rows = named.select(clean.alias("name"), "position").where("name != ''")
    return rows.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", F.struct("position", "name")).alias("name"), F.min("position").alias("position")).drop("_key")


def message_key() -> Column:
    """SET2: the channel's id, or its name in small letters without @, with the message's id."""
    channel = F.coalesce("channel_id", F.regexp_replace(F.lower(F.trim("channel")), "^@", ""))
    return F.concat_ws(":", channel, F.col("message_id").cast("string"))


def admitted(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """SNK1, SET2: the messages to append. Of equal keys the one received first goes in, unless its key is stored already."""
    once = pick(messages.withColumn("message_key", message_key()), ["message_key"], [F.col("received_at"), F.col("id")])
    return once.join(stored.select("message_key"), "message_key", "left_anti")


def survivors(queue: DataFrame) -> DataFrame:
    """SET4: of a job's entries the one that got furthest: verified and completed, in work, with a link, with calls, with paid calls, queued last, largest id."""
    down = lambda c: -F.coalesce(F.col(c).cast("int"), F.lit(0))
    done = ~((F.col("status") == "completed") & F.coalesce("verified", F.lit(False)))
    order = [done, F.col("status") != "processing", F.col("apply_url").isNull(), down("calls"), down("used_paid"), -F.unix_micros(F.col("enqueued_at").cast("timestamp")), -F.col("id")]
    return pick(queue, ["job_id"], order)


def claim(queue: DataFrame, now: datetime, k: int = 1) -> DataFrame:
    """ST2, SRT5: the ``k`` oldest claimable entries as they stand after the claim. Spark has no row-level swap: one writer claims for all workers."""
    oldest = queue.where(claimable(now)).orderBy("received_at", "message_id", "id").limit(k)
    return oldest.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "claimed_at": ntz(now)})


def backoff_ms(attempts: Column, retry_after_ms: Column | None = None, base: int = BASE_MS, most: int = MOST_MS) -> Column:
    """ST3: doubles with each attempt up to ``most``; a positive wait that the other side asked for counts instead, up to ``most`` too."""
    power = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30))
    curve = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), power)).cast("long")
    return curve if retry_after_ms is None else F.when(retry_after_ms > 0, F.least(retry_after_ms, F.lit(most))).otherwise(curve).cast("long")


def retried(failed: DataFrame, now: datetime, most: int = MOST_ATTEMPTS) -> DataFrame:
    """ST4 over entries with retry_after_ms: wait for the next attempt, or give up at ``most``."""
    over = F.col("attempts") >= most
    delay = F.when(over, 0).otherwise(backoff_ms(F.col("attempts"), F.col("retry_after_ms"))).cast("long")
    due = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + delay * 1000).cast("timestamp_ntz")
    return failed.withColumns({"status": F.when(over, "failed").otherwise("retry_wait"), "delay_ms": delay, "next_retry_at": F.when(~over, due), "claimed_at": F.lit(None).cast("timestamp_ntz")})


def recovered(queue: DataFrame, now: datetime, minutes: int = 5) -> DataFrame:
    """ST5: claims whose worker is gone wait again."""
    gone = F.coalesce(stale_claim(now, minutes), F.lit(False))
    return queue.withColumns({"status": F.when(gone, "pending").otherwise(F.col("status")), "claimed_at": F.when(~gone, F.col("claimed_at"))})


def enqueued(existing: DataFrame, asked: DataFrame, now: datetime) -> DataFrame:
    """ST6 over job_id, status, verified, attempts: entries in work or verified stay as they are, others start anew, unknown jobs are added; ``outcome`` says which."""
    both = asked.select("job_id").distinct().join(existing.withColumn("_known", F.lit(True)), "job_id", "left")
    keep = F.col("_known") & ((F.col("status") == "processing") | ((F.col("status") == "completed") & F.coalesce("verified", F.lit(False))))
    keep = F.coalesce(keep, F.lit(False))
    return both.select(
        "job_id", F.when(keep, F.col("status")).otherwise("pending").alias("status"), F.when(keep, F.col("attempts")).otherwise(0).alias("attempts"),
        F.when(keep, "kept").when(F.col("_known"), "reset").otherwise("created").alias("outcome"), F.when(~keep, ntz(now)).alias("enqueued_at"),
    )


def sync_plan(incoming: DataFrame, stored: DataFrame, found_table: bool = True) -> DataFrame:
    """SET3, JN6, JN7, ST12: what a full import changes, as (action, id, pos).

    ``incoming`` (pos, source_id, company, apply_url, posted_on) has the rows in file order, ``stored`` (id, source_id, company, apply_url) those of the source.
    A row finds its stored twin by its identity, else by company and link, else by link alone; where several rows find one twin, or new ones share a link, the last in the
    file stays. Rows without a date are not seen. Stored rows that nothing found expire, unless the file had no table."""
    dated = pick(incoming.where("posted_on IS NOT NULL"), ["source_id"], [F.col("pos")])
    by = lambda keys, name: stored.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min("id").alias(name))
    met = dated.join(by(["source_id"], "_a"), "source_id", "left").join(by(["company", "apply_url"], "_b"), ["company", "apply_url"], "left").join(by(["apply_url"], "_c"), "apply_url", "left")
    met = met.select("pos", F.coalesce("_a", "_b", "_c").alias("id"), F.coalesce("apply_url", "source_id").alias("link"))
    updated = met.where("id IS NOT NULL").groupBy("id").agg(F.max("pos").alias("pos"))
    created = met.where("id IS NULL").groupBy("link").agg(F.max("pos").alias("pos"))
    plan = updated.select(F.lit("updated").alias("action"), "id", "pos").unionByName(created.select(F.lit("created").alias("action"), F.lit(None).cast("long").alias("id"), "pos"))
    if not found_table:
        return plan
    return plan.unionByName(stored.join(updated, "id", "left_anti").select(F.lit("expired").alias("action"), "id", F.lit(None).cast("long").alias("pos")))


def unseen(rows: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """JN10: what a list does not have yet."""
    return rows.join(seen.select(key), key, "left_anti")


def live_fold(shown: DataFrame, arrived: DataFrame, visible: Column, sort: str = "newest", both_ends: bool = False) -> DataFrame:
    """ST10, ST17-ST19 over (place, id, ...) and arrivals (seq, event, id, ...): the newest update of a shown row replaces it in place; created rows that are
    visible and not shown go in front, newest first. A list sorted oldest first takes none, or with ``both_ends`` takes them at its end."""
    columns = [c for c in shown.columns if c not in ("place", "id")]
    updates = latest(arrived.where("event = 'updated'"), "id", "seq", "seq").select("id", F.struct(*columns).alias("_new"))
    kept = shown.join(updates, "id", "left").select("place", "id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    if sort != "newest" and not both_ends:
        return kept
    fresh = pick(arrived.where("event = 'created'").where(visible), ["id"], [F.col("seq")]).join(shown.select("id"), "id", "left_anti")
    place = -F.col("seq") if sort == "newest" else F.col("seq") + (1 << 40)
    return kept.unionByName(fresh.select(place.alias("place"), "id", *columns))


def guarded_update(rows: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """SNK3 over updates (id, old, new): only a row that still has the expected value changes; ``modified`` says so."""
    met = rows.join(updates, "id", "left")
    hit = F.col("new").isNotNull() & F.col("old").eqNullSafe(F.col(column))
    return met.select(*[F.when(hit, F.col("new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns], hit.alias("modified"))


def reverted(audit: DataFrame, posts: DataFrame) -> DataFrame:
    """ST7, JN8: the value before a run for each post of its audit log (id, post_id, old_url, new_url, created_at). A post whose link is no longer the last one
    written is a conflict, and so is one whose log has a gap, where an entry does not start from the value that the one before it wrote."""
    order = Window.partitionBy("post_id").orderBy("created_at", "id")
    before = F.lag("new_url").over(order)
    chained = audit.withColumn("_gap", F.coalesce((F.row_number().over(order) > 1) & ~F.col("old_url").eqNullSafe(before), F.lit(False)))
    ends = chained.groupBy("post_id").agg(
        F.min_by(F.struct("old_url"), F.struct("created_at", "id")).alias("first"), F.max_by(F.struct("new_url"), F.struct("created_at", "id")).alias("last"), F.bool_or("_gap").alias("gap")
    )
    met = ends.join(posts.select(F.col("id").alias("post_id"), "apply_url"), "post_id")
    fine = F.col("apply_url").eqNullSafe(F.col("last.new_url")) & ~F.col("gap")
    return met.select("post_id", F.when(fine, "reverted").otherwise("conflict").alias("outcome"), F.when(fine, F.col("first.old_url")).otherwise(F.col("apply_url")).alias("apply_url"))


def discovery_results(queue: DataFrame, posts: DataFrame) -> DataFrame:
    """JN4: posts with what their finished search found; one that failed for good asks for review."""
    found = (F.col("q_status") == "completed") & F.col("q_url").isNotNull()
    q = queue.select(F.col("job_id").alias("id"), F.col("status").alias("q_status"), F.col("apply_url").alias("q_url"))
    met = posts.join(q, "id", "left")
    return met.select("id", F.when(found, F.col("q_url")).otherwise(F.col("apply_url")).alias("apply_url"), F.when(found, "verified").when(F.col("q_status") == "failed", "needs_review").otherwise(F.col("url_status")).alias("url_status"))


def with_stored_logo(rows: DataFrame, known: DataFrame) -> DataFrame:
    """JN5: the logo that any row of the company has, in any case; the smallest, so that the result is one."""
    logos = known.where("coalesce(trim(logo), '') != ''").groupBy(F.lower("company").alias("_company")).agg(F.min("logo").alias("_logo"))
    return rows.join(logos, F.lower(rows["company"]) == logos["_company"], "left").select(*rows.columns, F.col("_logo").alias("stored_logo"))


def expires(created: Column, given: Column, days: int = LIFETIME_DAYS) -> Column:
    """ST16."""
    return F.coalesce(given, created + F.expr(f"INTERVAL {days} DAYS"))


def merged_profile(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """ST14: fields that were edited by hand, or that the new reading has none of, stay."""
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    return old.join(n, "id", "left").select("id", "manual_fields", *[F.when(F.array_contains("manual_fields", c), F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in fields])


def registered(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """ST15, AGG15 over registry (channel_key, is_active, last_message_id): new channels come in active; known ones keep their switch and the higher mark."""
    marks = seen.groupBy("channel_key").agg(F.max("message_id").alias("_mark"))
    both = registry.join(marks, "channel_key", "full")
    return both.select("channel_key", F.coalesce("is_active", F.lit(True)).alias("is_active"), F.greatest("last_message_id", "_mark").alias("last_message_id"))


def history(messages: DataFrame, now: datetime, days: int = 7, most: int = 1000) -> DataFrame:
    """SRC4: the newest ``most`` messages of the last days, to be read oldest first; ``truncated`` if more may lie within."""
    newest = messages.where(F.col("received_at") >= ntz(now - timedelta(days=days))).orderBy(F.desc("received_at"), F.desc("id")).limit(most + 1)
    whole = Window.partitionBy()  # at most most + 1 rows
    placed = newest.withColumns({"_n": F.count(F.lit(1)).over(whole), "_k": F.row_number().over(whole.orderBy(F.desc("received_at"), F.desc("id")))})
    return placed.where(F.col("_k") <= most).withColumn("truncated", F.col("_n") > most).drop("_n", "_k")


def rolling_rate(calls: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """ST8, ST9 as analysis: calls of the key in the last ``seconds``, and the seconds since the one before."""
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    rows = calls.withColumn("_s", second)
    order = Window.partitionBy(key).orderBy("_s")
    return rows.withColumns({"n_last": F.count(F.lit(1)).over(order.rangeBetween(-seconds + 1, 0)), "gap": F.col("_s") - F.lag("_s").over(Window.partitionBy(key).orderBy("_s", "id"))}).drop("_s")


def decision_report(decisions: DataFrame, path: str) -> None:
    """SNK4: CSV with quoted values and doubled quotes."""
    decisions.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def change_log(before: DataFrame, after: DataFrame, column: str, run: str, now: datetime) -> DataFrame:
    """SNK5: an audit row for each changed value; it is written before the change is."""
    a = after.select("id", F.col(column).alias("_new"))
    met = before.join(a, "id").where(~F.col(column).eqNullSafe(F.col("_new")))
    return met.select(F.col("id").alias("post_id"), F.lit(run).alias("run"), F.col(column).alias("old_url"), F.col("_new").alias("new_url"), ntz(now).alias("created_at"))


def created(posts: DataFrame, now: datetime) -> DataFrame:
    """SNK2 over (id, company, apply_url, source_url, ...): the rows that the only write path appends. Links are judged on the way in whatever their writer claims; ``discover`` marks
    those that the search for a link is started for. Columns of the same names give way; all others go along."""
    made = ("apply_url", "url_status", "source_url", "candidate", "verified", "checked_at", "found_by", "discover")
    judged = posts.withColumn("_f", resolved_fields(F.col("apply_url"), F.col("company"), F.col("source_url")))
    verified = F.col("_f.url_status") == "verified"
    new = {"verified": verified, "checked_at": ntz(now), "found_by": F.when(verified, "direct_extraction"), "discover": ~verified} | {c: F.col(f"_f.{c}") for c in made[:4]}
    return judged.select(*[c for c in posts.columns if c not in made], *[new[c].alias(c) for c in made])
