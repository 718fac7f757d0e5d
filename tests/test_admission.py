"""Calls in line against a replay that moves from event to event."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postgrove.plans import catalogue
from postgrove.plans.stream_queries import _calls
from postgrove.streaming import admission, posts


def replay(calls: list[tuple], most: int, window: int, concurrency: int) -> dict:
    """id: start, of (id, arrived, took, retry_after): the clock goes from one moment at which something may change to the next."""
    coming = sorted(calls, key=lambda c: (c[1], c[0]))
    moments = {c[1] for c in calls}
    line, starts, running, paused_until, out = [], [], [], -1, {}
    while moments:
        now = min(moments)
        moments.discard(now)
        for end, retry_after in running:
            if end == now and retry_after:
                paused_until = max(paused_until, now + retry_after)
                moments.add(paused_until)
        running = [r for r in running if r[0] > now]
        while coming and coming[0][1] <= now:
            line.append(coming.pop(0))
        while line and len(running) < concurrency and paused_until <= now and sum(s > now - window for s in starts) < most:
            i, _, took, retry_after = line.pop(0)
            out[i] = now
            starts.append(now)
            moments |= {now + window, now + took}
            if took:
                running.append((now + took, retry_after))
            elif retry_after:
                paused_until = max(paused_until, now + retry_after)
                moments.add(paused_until)
        moments = {m for m in moments if m > now}
    return out


@pytest.mark.parametrize("most,window,concurrency", [(10, 60, 1), (3, 50, 2), (2, 1000, 5), (1, 1, 1)])
def test_starts_of_a_line_equal_the_replay(most, window, concurrency):
    draw = random.Random(most)
    for _ in range(200):
        calls, at = [], 0
        for i in range(draw.randint(0, 40)):
            at += draw.choice([0, 0, 1, 5, 30, 200])
            calls.append((i, at, draw.choice([0, 1, 7, 40]), draw.choice([0, 0, 0, 25, 300])))
        line, got = admission.Line([], [], []), {}
        for i, arrived, took, retry_after in calls:
            got[i] = line.next_start(arrived, most, window, concurrency)
            line.start(got[i], took, retry_after, most, concurrency)
            assert len(line.starts) <= most and len(line.ends) <= concurrency
        assert got == replay(calls, most, window, concurrency)


def test_turns_of_all_events(spark, sf_dir):
    by_user: dict[int, list] = {}
    for r in _calls(spark, sf_dir).select("key", "id", F.unix_millis("at").alias("at"), "took", "retry_after").collect():
        by_user.setdefault(r["key"], []).append((r["id"], r["at"], r["took"], r["retry_after"] or 0))
    want = {i: s for calls in by_user.values() for i, s in replay(calls, 2, 86_400_000, 1).items()}
    rows = catalogue.queries()["stream_turns"](spark, sf_dir).collect()
    assert {r["id"]: r["started"] for r in rows} == want and len(rows) == len(want)
    assert any(r["waited"] > 0 for r in rows) and all(r["waited"] >= 0 for r in rows)


def test_a_restarted_stream_goes_on_with_its_line(spark, tmp_path):
    """Two runs over files that come one after another give what one line gives; a late call gets no row, and what the watermark has not passed waits."""
    second = lambda n: datetime.fromtimestamp(1_700_000_000 + n, timezone.utc)
    put = lambda name, rows: spark.createDataFrame([("k", i, second(s), 5_000, r) for i, s, r in rows], f"key string, {admission.CALL}").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    first, then = [(1, 0, None), (2, 1, 20_000), (3, 2, None), (4, 2, None)], [(5, 1000, None), (6, 1001, None), (7, 1, None)]

    def run() -> dict:
        stream = spark.readStream.schema(f"key string, {admission.CALL}").parquet(f"{tmp_path}/in/*")
        said = admission.turns(stream, 3, 60_000, late="10 seconds", step=1000)
        return {r["id"]: (r["started"] - 1_700_000_000_000) / 1000 for r in posts.run_to_files(said, f"{tmp_path}/out", f"{tmp_path}/log").collect()}

    put("a", first)
    assert run() == {}
    put("b", [(9, 900, None)])
    assert run() == {1: 0, 2: 5, 3: 30, 4: 60}
    put("c", then)
    put("d", [(None, 10**6, None)])
    assert run() == {1: 0, 2: 5, 3: 30, 4: 60, 9: 900, 5: 1000, 6: 1005}
