"""Rules at their borders, and streams against a replay."""

from __future__ import annotations

import statistics
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from postgrove.operators import predicates as P, state as S
from postgrove.operators.feed import FeedQuery
from postgrove.plans import catalogue
from postgrove.session import read_table
from postgrove.streaming import posts


def test_feed_cutoff(spark):
    """Fifteen days back from midnight, to the second."""
    now = datetime(2026, 9, 5, 12)
    times = ["2026-09-05 00:00:00", "2026-08-21 23:59:59", "2026-08-20 23:59:59", "2026-08-16 00:00:00"]
    rows = spark.createDataFrame([(k, "active", t) for k, t in enumerate(times)], "id int, status string, t string").select("id", "status", F.col("t").cast("timestamp_ntz").alias("posted_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    assert [r["id"] for r in rows.where(P.active(now)).orderBy("id").collect()] == [0, 1]


@pytest.mark.parametrize("bad", [{"page": 0}, {"limit": 101}, {"limit": 0}, {"sort": "random"}])
def test_page_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        P.page_parameters(**bad)


def test_page_parameters_as_texts():
    assert P.page_parameters() == (1, 20, "newest") and P.page_parameters(" 3 ", "100", "oldest") == (3, 100, "oldest") and P.page_parameters(usual_limit=24)[1] == 24
    for bad in ({"page": "x"}, {"page": "-1"}, {"page": "1.5"}, {"limit": "１０"}, {"page": ""}):
        with pytest.raises(ValueError):
            P.page_parameters(**bad)


def test_instants_and_ids_are_checked():
    assert P.instant(None, "from") is None and P.instant("2026-09-05", "from") == datetime(2026, 9, 5) and P.instant(" 2026-09-05T12:00:00+05:30", "from") == datetime(2026, 9, 5, 6, 30)
    assert P.posting_id("0123456789abcdefABCDEF00") == "0123456789abcdefabcdef00"
    for bad in ("", "soon", "2026-13-01"):
        with pytest.raises(ValueError):
            P.instant(bad, "from")
    for bad in ("", "12", "0123456789abcdefABCDEFgg"):
        with pytest.raises(ValueError):
            P.posting_id(bad)


def test_reversed_range_and_unknown_type_are_errors():
    with pytest.raises(ValueError):
        P.posted_between(datetime(2026, 2, 1), datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        P.of_type("odd")


def test_feed_query_is_one_condition(spark):
    q = FeedQuery(now=datetime(2026, 9, 5), search="a", batch="b", location="c", type="remote", posted_from=datetime(2026, 9, 1))
    assert "posted_at" in str(q.condition())


def test_admission_equals_replay(spark, sf_dir):
    calls = sorted((r["user_id"], r["second"], r["event_id"]) for r in read_table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")).collect())
    want, starts = {}, {}
    for user, second, event in calls:
        live = [s for s in starts.get(user, []) if s > second - 3600]
        want[event] = len(live) < 3
        starts[user] = live + [second] * want[event]
    got = {r["id"]: r["admitted"] for r in catalogue.queries()["stream_admission"](spark, sf_dir).collect()}
    assert got == want


def test_what_a_batch_reads_does_not_grow_with_history(spark, tmp_path):
    """Fifty batches of a hundred messages, ten of them old ones: each looks up and writes its own keys only."""
    make = lambda ids: spark.createDataFrame([(k, None, f"c{k % 30}", k, str(k), "x" * 50) for k in ids], "id long, channel_id string, channel string, message_id long, received_at string, text string").coalesce(1)
    for n in range(50):
        make([*range(90 * n, 90 * n + 90), *(k * 7 % max(1, 90 * n) for k in range(10))]).write.parquet(f"{tmp_path}/in/{n:02d}")
    schema = make([]).schema
    progress = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryIdle(self, event): ...
        def onQueryProgress(self, event):
            progress.append(event.progress)

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        stored = posts.ingest(posts.message_stream(spark, f"{tmp_path}/in/*", "*.parquet", schema), f"{tmp_path}/out", f"{tmp_path}/log")
        assert stored.count() == stored.select("message_key").distinct().count() == 4500
        for _ in range(100):
            if len(progress) >= 50:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    states = [p.stateOperators[0] for p in progress if p.stateOperators]
    for metric in ("rocksdbGetCount", "rocksdbTotalBytesRead", "rocksdbTotalBytesWritten"):
        each = [int(x.customMetrics[metric]) for x in states]
        assert statistics.median(each[-10:]) <= 1.1 * statistics.median(each[5:15])
    assert states[-1].numRowsTotal == 4500 and len(states) >= 50 and not any(int(x.customMetrics["rocksdbNumReplayChangelogFiles"]) for x in states)


def test_of_a_batch_the_earliest_message_is_stored(spark, tmp_path):
    """History goes before live messages, and equal times fall to the id."""
    shape = "id long, channel_id string, channel string, message_id long, received_at string, text string"
    spark.createDataFrame([(5, None, "a", 1, "2", "x"), (4, None, "a", 1, "2", "y"), (3, None, "a", 1, "3", "z"), (6, None, None, 1, "1", "x"), (7, None, "b", 2, "1", "x")], shape).coalesce(1).write.parquet(f"{tmp_path}/in/one")
    stream = posts.message_stream(spark, f"{tmp_path}/in/*", "*.parquet", spark.createDataFrame([], shape).schema)
    history = spark.createDataFrame([(9, None, "B", 2, "8", "old")], shape)
    got = {(r["message_key"], r["id"]) for r in posts.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/log", history).collect()}
    assert got == {("a:1", 4), ("b:2", 9), ("1", 6)}


def test_restarted_ingest_stores_nothing_twice(spark, tmp_path):
    """A second run over one more file adds only its new keys."""
    make = lambda rows: spark.createDataFrame(rows, "id long, channel_id string, channel string, message_id long, received_at string, text string")
    make([(1, None, "@A", 1, "1", "x"), (2, None, "a", 1, "2", "x"), (3, None, "b", 1, "1", " ")]).coalesce(1).write.parquet(f"{tmp_path}/in/one")
    schema = make([]).schema

    def run():
        stream = posts.message_stream(spark, f"{tmp_path}/in/*", "*.parquet", schema)
        return sorted((r["message_key"], r["id"]) for r in posts.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/log").collect())

    assert run() == [("a:1", 1)]
    make([(4, None, "A", 1, "9", "x"), (5, "c9", "A", 2, "9", "x")]).coalesce(1).write.parquet(f"{tmp_path}/in/two")
    assert run() == [("a:1", 1), ("c9:2", 5)]
    assert run() == [("a:1", 1), ("c9:2", 5)]


def test_csv_report_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi", twice')], "id int, reason string")
    S.decision_report(rows, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True, escape='"').first()["reason"] == 'say "hi", twice'


def test_history_says_whether_it_was_cut(spark):
    rows = spark.createDataFrame([(k, f"2024-01-{10 + k:02d} 00:00:00") for k in range(9)], "id int, t string").select("id", F.col("t").cast("timestamp_ntz").alias("received_at"))
    now = datetime(2024, 1, 19)
    whole, cut = S.history(rows, now, 7, 100).collect(), S.history(rows, now, 7, 3).collect()
    assert len(whole) == 7 and not whole[0]["truncated"] and {r["id"] for r in cut} == {6, 7, 8} and all(r["truncated"] for r in cut)


def test_library_without_the_subpackage():
    """No module outside the subpackage imports it."""
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    assert all("postgrove.llm" not in p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts)
