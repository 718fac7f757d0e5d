"""Deduplication, lookup and state queries over the stand-ins and literal rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postgrove.functions.text import posted_date
from postgrove.operators import state as S
from postgrove.plans.registry import query
from postgrove.session import read_table
from postgrove.sources.markdown import table_rows
from postgrove.sources.tables import QUEUE_SQL, queue

NOW = datetime(2024, 1, 20, 12)
_Q = f"WITH {QUEUE_SQL}"


@query("dedup_message_key", f"""{_Q} SELECT min(id) AS id, lower(channel) || ':' || message_id AS message_key FROM (SELECT *, row_number() OVER (PARTITION BY lower(channel), message_id ORDER BY received_at, id) AS k FROM queue)
    WHERE k = 1 AND message_id % 3 > 0 GROUP BY 2""")
def dedup_message_key(spark, sf_dir):
    """SET2, SNK1: new keys only; every third key is stored already."""
    q = queue(spark, sf_dir).withColumn("channel_id", F.lit(None).cast("string"))
    stored = q.where("message_id % 3 = 0").select(S.message_key().alias("message_key"))
    return S.admitted(q, stored).select("id", "message_key")


@query("dedup_survivor", f"""{_Q} SELECT user_id AS job_id, arg_min(id, (CASE WHEN status = 'completed' AND value > 50 THEN 0 ELSE 1 END, CASE WHEN status = 'processing' THEN 0 ELSE 1 END, CASE WHEN job_id IS NULL THEN 1 ELSE 0 END, -attempts,
    -epoch_us(received_at), -id)) AS id FROM queue GROUP BY 1""")
def dedup_survivor(spark, sf_dir):
    """SET4."""
    q = queue(spark, sf_dir).select(
        F.col("user_id").alias("job_id"), "id", "status", (F.col("value") > 50).alias("verified"), F.col("job_id").cast("string").alias("apply_url"), F.col("attempts").alias("calls"), F.lit(False).alias("used_paid"), F.col("received_at").alias("enqueued_at")
    )
    return S.survivors(q).select("job_id", "id")


@query("latest_state", f"{_Q} SELECT channel, arg_max(id, (received_at, id)) AS id, arg_max(status, (received_at, id)) AS status FROM queue GROUP BY 1")
def latest_state(spark, sf_dir):
    """ST1."""
    return S.latest(queue(spark, sf_dir), "channel", "received_at", "id").select("channel", "id", "status")


@query("claim_oldest", f"""{_Q} SELECT id, 'processing' AS status, attempts + 1 AS attempts FROM queue WHERE status = 'pending' OR (status = 'retry_wait' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20 12:00:00'))
    ORDER BY received_at, message_id, id LIMIT 3""")
def claim_oldest(spark, sf_dir):
    """ST2, SRT5."""
    return S.claim(queue(spark, sf_dir), NOW, 3).select("id", "status", "attempts")


@query("next_retries", f"{_Q} SELECT id FROM queue WHERE status = 'retry_wait' AND next_retry_at IS NOT NULL ORDER BY next_retry_at, id LIMIT 10")
def next_retries(spark, sf_dir):
    """SRT6."""
    return queue(spark, sf_dir).where("status = 'retry_wait' AND next_retry_at IS NOT NULL").orderBy("next_retry_at", "id").limit(10).select("id")


_DELAYS = [(1, None, 5_000), (2, None, 10_000), (3, None, 20_000), (4, None, 40_000), (40, None, 600_000), (1000, None, 600_000), (1, 45_000, 45_000), (5, 3_000, 3_000), (1, 5_000_000, 600_000), (2, 0, 10_000), (2, -1_000, 10_000)]


@query("retry_backoff", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {ms})" for k, (_, _, ms) in enumerate(_DELAYS)) + ") t(id, delay_ms)")
def retry_backoff(spark, sf_dir):
    """ST3 on literal attempts."""
    df = spark.createDataFrame([(k, a, r) for k, (a, r, _) in enumerate(_DELAYS)], "id int, attempts long, retry_after_ms long")
    return df.select("id", S.backoff_ms(F.col("attempts"), F.col("retry_after_ms")).alias("delay_ms"))


@query("retry_or_fail", f"""{_Q} SELECT id, CASE WHEN attempts >= 6 THEN 'failed' ELSE 'retry_wait' END AS status, CASE WHEN attempts < 6 THEN TIMESTAMP '2024-01-20 12:00:00' + to_milliseconds((5000 * pow(2, attempts - 1))::BIGINT) END AS next_retry_at
    FROM queue WHERE status = 'processing'""")
def retry_or_fail(spark, sf_dir):
    """ST4."""
    failed = queue(spark, sf_dir).where("status = 'processing'").withColumn("retry_after_ms", F.lit(None).cast("long"))
    return S.retried(failed, NOW).select("id", "status", "next_retry_at")


@query("recovered_claims", f"""{_Q}, r AS (SELECT id, CASE WHEN status = 'processing' AND (claimed_at IS NULL OR claimed_at <= TIMESTAMP '2024-01-20 11:55:00') THEN 'pending' ELSE status END AS status FROM queue) SELECT status, count(*) AS n FROM r GROUP BY 1""")
def recovered_claims(spark, sf_dir):
    """ST5."""
    return S.recovered(queue(spark, sf_dir), NOW).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("enqueue_upsert", "SELECT * FROM (VALUES (1, 'processing', 3, 'kept'), (2, 'completed', 1, 'kept'), (3, 'pending', 0, 'reset'), (4, 'pending', 0, 'reset'), (5, 'pending', 0, 'created')) t(job_id, status, attempts, outcome)")
def enqueue_upsert(spark, sf_dir):
    """ST6 on literal entries."""
    have = [(1, "processing", None, 3), (2, "completed", True, 1), (3, "completed", False, 2), (4, "failed", None, 6), (9, "pending", None, 0)]
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 5)], "job_id int")
    return S.enqueued(spark.createDataFrame(have, "job_id int, status string, verified boolean, attempts int"), asked, NOW).select("job_id", "status", "attempts", "outcome")


_STORED = "stored AS (SELECT o_orderkey AS id, 's' || o_orderkey AS source_id, 'c' || (o_custkey % 7) AS company, 'u' || (o_orderkey // 2) AS apply_url FROM orders WHERE o_orderkey % 4 < 3)"
_INCOMING = """incoming AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 's' END || o_orderkey AS source_id, 'c' || (o_custkey % 7) AS company, 'u' || (o_orderkey // 2) AS apply_url
    FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 11 > 0)"""


@query("sync_plan", f"""WITH {_STORED}, {_INCOMING}, m AS (SELECT pos, coalesce(a.id, b.id, c.id) AS id, apply_url FROM incoming LEFT JOIN (SELECT source_id, min(id) AS id FROM stored GROUP BY 1) a USING (source_id)
    LEFT JOIN (SELECT company, apply_url, min(id) AS id FROM stored GROUP BY 1, 2) b USING (company, apply_url) LEFT JOIN (SELECT apply_url, min(id) AS id FROM stored GROUP BY 1) c USING (apply_url)),
    u AS (SELECT id, max(pos) AS pos FROM m WHERE id IS NOT NULL GROUP BY 1)
    SELECT 'updated' AS action, id, pos FROM u UNION ALL SELECT 'created', NULL, max(pos) FROM m WHERE id IS NULL GROUP BY apply_url UNION ALL SELECT 'expired', id, NULL FROM stored WHERE id NOT IN (SELECT id FROM u)""")
def sync_plan(spark, sf_dir):
    """SET3, JN6, JN7, ST12, JN10 over orders; every eleventh row has no date."""
    o = read_table(spark, sf_dir, "orders")
    key, of = F.col("o_orderkey"), [F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("company"), F.concat(F.lit("u"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("apply_url")]
    name = lambda head: F.concat(head, key.cast("string")).alias("source_id")
    stored = o.where(key % 4 < 3).select(key.alias("id"), name(F.lit("s")), *of)
    incoming = o.where(key % 3 > 0).select(key.alias("pos"), name(F.when(key % 5 == 0, "x").otherwise("s")), *of, F.when(key % 11 > 0, F.col("o_orderdate")).alias("posted_on"))
    return S.sync_plan(incoming, stored)


@query("upsert_fallback_match", "SELECT * FROM (VALUES ('updated', 1, 1), ('updated', 2, 4), ('created', NULL, 6), ('expired', 3, NULL)) t(action, id, pos)")
def upsert_fallback_match(spark, sf_dir):
    """JN6 on literal rows: by identity, by company and link, by link alone where the later row wins, new ones that share a link."""
    stored = [(1, "a", "A", "u1"), (2, "b", "B", "u2"), (3, "c", "C", None)]
    rows = [(1, "a", "Z", "u9", "d"), (2, "n1", "B", "u2", "d"), (3, "a", "Z", "u2", "d"), (4, "n2", "Q", "u2", "d"), (5, "n3", "N", "u5", "d"), (6, "n4", "M", "u5", "d"), (7, "c", "C", None, None)]
    return S.sync_plan(spark.createDataFrame(rows, "pos long, source_id string, company string, apply_url string, posted_on string"), spark.createDataFrame(stored, "id long, source_id string, company string, apply_url string"))


@query("reconcile_expired_anti", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def reconcile_expired(spark, sf_dir):
    """JN7, JN10: stored rows that the new snapshot does not have."""
    seen = read_table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return S.unseen(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), seen)


@query("seen_append_anti", "SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def seen_append(spark, sf_dir):
    """JN10, ST18."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return S.unseen(e, e.where("event_type = 'view'")).select("id")


@query("live_fold", "SELECT * FROM (VALUES (-5, 9, 'new'), (-3, 8, 'first'), (1, 1, 'changed'), (2, 2, 'b')) t(place, id, role)")
def live_fold(spark, sf_dir):
    """ST10, ST17, ST19 on literal rows: an update of an unknown row adds nothing, a repeated arrival counts once, hidden ones do not."""
    shown = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "place long, id long, role string")
    arrived = [(1, "updated", 1, "x"), (2, "updated", 1, "changed"), (3, "created", 8, "first"), (4, "created", 8, "again"), (5, "created", 9, "new"), (6, "created", 2, "dup"), (7, "updated", 7, "none"), (8, "created", 6, "hidden")]
    return S.live_fold(shown, spark.createDataFrame(arrived, "seq long, event string, id long, role string"), F.col("role") != "hidden")


@query("guarded_updates", "SELECT * FROM (VALUES (1, 'n', TRUE), (2, 'y', FALSE), (3, 'm', TRUE), (4, 'z', FALSE)) t(id, apply_url, modified)")
def guarded_updates(spark, sf_dir):
    """SNK3 on literal rows; null is an expected value like any other."""
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "id int, apply_url string")
    return S.guarded_update(rows, spark.createDataFrame([(1, "x", "n"), (2, "q", "n"), (3, None, "m")], "id int, old string, new string"), "apply_url")


@query("audit_revert", "SELECT * FROM (VALUES (1, 'reverted', 'a'), (2, 'conflict', 'other'), (3, 'conflict', 'q'), (4, 'reverted', NULL)) t(post_id, outcome, apply_url)")
def audit_revert(spark, sf_dir):
    """ST7, JN8 on a literal log: an unbroken chain, a value changed since, a gap, a null before the run."""
    log = [(1, 1, "a", "b", "1"), (2, 1, "b", "c", "2"), (3, 2, "a", "b", "1"), (4, 3, "a", "b", "1"), (5, 3, "p", "q", "2"), (6, 4, None, "z", "1")]
    posts = spark.createDataFrame([(1, "c"), (2, "other"), (3, "q"), (4, "z")], "id int, apply_url string")
    return S.reverted(spark.createDataFrame(log, "id int, post_id int, old_url string, new_url string, created_at string"), posts)


@query("audit_revert_state", """SELECT user_id AS post_id, CASE WHEN arg_max(event_id, (ts, event_id)) % 2 = 0 THEN 'reverted' ELSE 'conflict' END AS outcome FROM events GROUP BY 1""")
def audit_revert_state(spark, sf_dir):
    """ST7 over events as a log whose entries follow each other; posts whose last entry is odd were changed since."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("post_id"), F.col("ts").alias("created_at"))
    old = F.lag(F.col("id").cast("string")).over(Window.partitionBy("post_id").orderBy("created_at", "id"))
    log = e.withColumns({"old_url": old, "new_url": F.col("id").cast("string")})
    last = S.latest(e, "post_id", "created_at", "id").select(F.col("post_id").alias("id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("changed").alias("apply_url"))
    return S.reverted(log, last).select("post_id", "outcome")


@query("change_log", f"SELECT event_id AS post_id, event_type AS old_url, 'seen' AS new_url FROM events WHERE event_type <> 'view'")
def change_log(spark, sf_dir):
    """SNK5: rows whose value changes."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("apply_url"))
    after = e.withColumn("apply_url", F.when(F.col("apply_url") == "view", "view").otherwise("seen"))
    return S.change_log(e, after, "apply_url", "run", NOW).select("post_id", "old_url", "new_url")


@query("discovery_results", f"""{_Q} SELECT o_orderkey AS id, CASE WHEN status = 'completed' AND job_id IS NOT NULL THEN job_id::VARCHAR END AS apply_url, CASE WHEN status = 'completed' AND job_id IS NOT NULL THEN 'verified' WHEN status = 'archived' THEN 'needs_review' ELSE 'pending' END AS url_status
    FROM orders LEFT JOIN queue ON id = o_orderkey""")
def discovery_results(spark, sf_dir):
    """JN4."""
    q = queue(spark, sf_dir).select(F.col("id").alias("job_id"), F.when(F.col("status") == "archived", "failed").otherwise(F.col("status")).alias("status"), F.col("job_id").cast("string").alias("apply_url"))
    posts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("apply_url"), F.lit("pending").alias("url_status"))
    return S.discovery_results(q, posts)


@query("stored_logos", "SELECT * FROM (VALUES (1, 'l1'), (2, NULL)) t(id, stored_logo)")
def stored_logos(spark, sf_dir):
    """JN5 on literal companies."""
    known = spark.createDataFrame([("ACME", "l2"), ("Acme", "l1"), ("Bolt", " "), ("Bolt", None)], "company string, logo string")
    return S.with_stored_logo(spark.createDataFrame([(1, "acme"), (2, "bolt")], "id int, company string"), known).select("id", "stored_logo")


@query("expiry_stamp", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2000-01-01' ELSE o_orderdate + INTERVAL 21 DAY END AS expires_at FROM orders")
def expiry_stamp(spark, sf_dir):
    """ST16."""
    o = read_table(spark, sf_dir, "orders")
    given = F.when(F.col("o_orderkey") % 2 == 0, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return o.select(F.col("o_orderkey").alias("id"), S.expires(F.col("o_orderdate"), given).alias("expires_at"))


@query("manual_edits", "SELECT * FROM (VALUES (1, 'old', 'NEW'), (2, 'keep', 'b')) t(id, city, role)")
def manual_edits(spark, sf_dir):
    """ST14 on literal profiles."""
    old = spark.createDataFrame([(1, ["city"], "old", "a"), (2, [], "keep", "b")], "id int, manual_fields array<string>, city string, role string")
    return S.merged_profile(old, spark.createDataFrame([(1, "new", "NEW"), (2, None, None)], "id int, city string, role string"), ["city", "role"]).drop("manual_fields")


@query("registry_upsert", "SELECT * FROM (VALUES ('a', FALSE, 9), ('b', TRUE, 7), ('c', TRUE, 3)) t(channel_key, is_active, last_message_id)")
def registry_upsert(spark, sf_dir):
    """ST15, AGG15 on literal channels: a paused one stays paused."""
    have = spark.createDataFrame([("a", False, 9), ("b", True, 5)], "channel_key string, is_active boolean, last_message_id int")
    return S.registered(have, spark.createDataFrame([("a", 2), ("b", 7), ("c", 1), ("c", 3)], "channel_key string, message_id int"))


@query("spelling_union", "SELECT * FROM (VALUES ('JobsNow', 0), ('devhub', 1), ('News', 3)) t(name, position)")
def spelling_union(spark, sf_dir):
    """SET1, SRC10 on literal names."""
    return S.first_spellings(spark.createDataFrame([("@JobsNow", 0), (" devhub", 1), ("jobsnow", 2), ("News", 3), ("DEVHUB ", 4), (" ", 5)], "name string, position int"))


@query("history_scan", f"{_Q} SELECT id, TRUE AS truncated FROM queue WHERE received_at >= TIMESTAMP '2024-01-13 12:00:00' ORDER BY received_at DESC, id DESC LIMIT 100")
def history_scan(spark, sf_dir):
    """SRC4."""
    return S.history(queue(spark, sf_dir), NOW, 7, 100).select("id", "truncated")


@query("rolling_rate", """SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n_last,
    epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS gap FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""")
def rolling_rate(spark, sf_dir):
    """ST8, ST9 as analysis, with an hour as the window."""
    return S.rolling_rate(queue(spark, sf_dir), "user_id", "received_at", 3600).select("id", "n_last", "gap")


_README = """# Jobs
| Company | Role | Location | Posted | Link |
| --- | --- | --- | --- | --- |
| <b>Acme</b> | [Intern](https://x.example) | Pune | 2026-09-05 | [Apply](https://a.example/1) |
| ![l](p.png) Bolt | Engineer | | 5 Sep 2026 | <a href="https://b.example/2">go</a> |
| Cord |  | Delhi | 2026-09-05 | https://c.example/3 |

| Title | Employer | Date |
|---|---|---|
| Dev | Dune | n/a |
text
| not | a | table |
"""


@query("markdown_tables", """SELECT * FROM (VALUES (3, 'Acme', 'Intern', 'Pune', '2026-09-05', 'https://a.example/1', FALSE), (4, 'Bolt', 'Engineer', NULL, '2026-09-05', 'https://b.example/2', FALSE),
    (5, 'Cord', '', 'Delhi', '2026-09-05', 'https://c.example/3', TRUE), (9, 'Dune', 'Dev', NULL, NULL, NULL, FALSE)) t(pos, company, role, location, posted_on, apply_url, skipped)""")
def markdown_tables(spark, sf_dir):
    """SRC6, SC19 on a literal file: aliases, separators, two tables, a row without a role, a table-like line without header."""
    files = spark.createDataFrame([("readme", _README)], "file string, value string")
    return table_rows(files, posted_date).select("pos", "company", "role", "location", F.col("posted_on").cast("string").alias("posted_on"), "apply_url", "skipped")
