"""Streaming queries over events as a source of files; each must give what the batch operator gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postgrove.plans.registry import query
from postgrove.session import read_table, shared_folder
from postgrove.streaming import admission as A, live as L, posts as P


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    return P.message_stream(spark, sf_dir, "events.parquet", read_table(spark, sf_dir, "events").schema)


def _messages(rows):
    return rows.select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("channel_id"), F.concat(F.lit("@Channel"), (F.col("user_id") % 40).cast("string")).alias("channel"), F.floor(F.col("event_id") / 2).cast("long").alias("message_id"), F.col("ts").alias("received_at"))


_ONCE = "SELECT 'channel' || (user_id % 40) || ':' || (event_id // 2) AS message_key, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY 1"


@query("stream_ingest", _ONCE)
def stream_ingest(spark, sf_dir):
    """SRC3, SNK1: the stream stores what the batch would."""
    return P.ingest(_messages(_events(spark, sf_dir)), _folder(spark, "ingest"), _folder(spark, "ingest-log")).select("message_key", "id")


@query("stream_after_backlog", f"""WITH b AS (SELECT 'channel' || (user_id % 40) || ':' || (event_id // 2) AS message_key, arg_min(event_id, (ts, event_id)) AS id FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT message_key, id FROM b UNION ALL SELECT * FROM ({_ONCE}) a WHERE a.message_key NOT IN (SELECT message_key FROM b)""")
def stream_after_backlog(spark, sf_dir):
    """SRC5: history first, then the live source without what history had."""
    history = _messages(read_table(spark, sf_dir, "events").where("event_type = 'view'"))
    return P.ingest(_messages(_events(spark, sf_dir)), _folder(spark, "ingest"), _folder(spark, "ingest-log"), history).select("message_key", "id")


@query("stream_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    """Tumbling windows of a day in complete mode; nothing here is late."""
    found = P.windowed_counts(_events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type")
    rows = P.run_to_files(found, _folder(spark, "daily"), _folder(spark, "daily-log"), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n")


def _calls(spark, sf_dir):
    """Events as calls of their users, which take some hours each; some are refused and ask for a pause."""
    e = read_table(spark, sf_dir, "events")
    hours = lambda x: (x * 3_600_000).cast("long")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), hours(F.col("event_id") % 11 + 1).alias("took"), F.when(F.col("event_id") % 13 == 0, hours(F.lit(18))).alias("retry_after"))


@query("stream_turns")
def stream_turns(spark, sf_dir):
    """ST8: calls of a user wait for their turn, 2 a day and one at a time, and refused ones bring a pause of 18 hours. Each start depends on those before it, so SQL has no twin; a test replays it."""
    calls = A.call_stream(spark, _calls(spark, sf_dir), _folder(spark, "calls"))
    return P.run_to_files(A.turns(calls, 2, 86_400_000), _folder(spark, "turns"), _folder(spark, "turns-log")).withColumn("waited", F.col("started") - F.col("arrived"))


@query("stream_admission")
def stream_admission(spark, sf_dir):
    """ST8: calls of a user are admitted up to 3 an hour and refused beyond. Each verdict depends on those before it, so SQL has no twin; a test replays it."""
    calls = A.call_stream(spark, _calls(spark, sf_dir).withColumns({"took": F.lit(0).cast("long"), "retry_after": F.lit(None).cast("long")}), _folder(spark, "calls"))
    said = P.run_to_files(A.turns(calls, 3, 3_600_000, wait=False), _folder(spark, "admission"), _folder(spark, "admission-log"))
    return said.select("key", "id", F.col("started").isNotNull().alias("admitted"))


@query("broadcast_feed", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'imported' ELSE 'main' END AS feed, CASE WHEN event_id % 2 = 0 THEN 'created' ELSE 'updated' END AS event FROM events")
def broadcast_feed(spark, sf_dir):
    """SNK6."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("event_id") % 2 == 0).alias("is_new"))
    return P.broadcast_rows(rows, ["view"]).select("id", "feed", "event")


@query("live_feed", f"""WITH e AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'created' WHEN 'error' THEN 'listed' ELSE 'updated' END AS event, CASE WHEN user_id % 3 = 0 THEN 'imported' ELSE 'main' END AS feed, value FROM events),
    come AS (SELECT feed, id, min(seq) AS seq FROM e WHERE event = 'listed' OR (event = 'created' AND value > 20) GROUP BY ALL),
    shown AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'imported' ELSE 'main' END AS feed, c_custkey AS id, -1 AS seq, c_custkey AS place, c_acctbal AS value FROM customer WHERE c_custkey % 4 = 0),
    rows_in AS (SELECT * FROM shown UNION ALL SELECT c.feed, c.id, c.seq, CASE c.feed WHEN 'main' THEN -c.seq - 1 ELSE c.seq + {L.END} END, e.value FROM come c JOIN e USING (feed, id, seq) WHERE (c.feed, c.id) NOT IN (SELECT (feed, id) FROM shown)),
    last AS (SELECT feed, id, max(seq) AS seq FROM e WHERE event = 'updated' GROUP BY ALL)
    SELECT r.feed, r.id, r.place::BIGINT AS place, (CASE WHEN l.seq > r.seq THEN u.value ELSE r.value END)::DOUBLE AS value FROM rows_in r LEFT JOIN last l USING (feed, id) LEFT JOIN e u ON u.feed = l.feed AND u.id = l.id AND u.seq = l.seq""")
def live_feed(spark, sf_dir):
    """SNK6, ST10, ST19: events of users reach two feeds, one newest first and one oldest first, which show some customers before."""
    side = lambda key: F.when(F.col(key) % 3 == 0, "imported").otherwise("main")
    kind = F.when(F.col("event_type") == "view", "created").when(F.col("event_type") == "error", "listed").otherwise("updated")
    events = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), kind.alias("event"), side("user_id").alias("source"), F.col("user_id").alias("id"), F.col("value").cast("double").alias("value"))
    shown = read_table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(side("c_custkey").alias("feed"), F.col("c_custkey").alias("place"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("value"))
    feeds = [L.Feed("main", "value > 20"), L.Feed("imported", "value > 20", ("imported",), newest_first=False, both_ends=True)]
    rows = L.run(events, _folder(spark, "live"), _folder(spark, "live-log"), feeds, shown)
    return rows.select("feed", "id", F.col("place")[0].alias("place"), "value")
