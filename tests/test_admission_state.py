"""How waiting calls lie in state: exact keys and ids, few reads and writes, chunks of bounded size."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest

from postgrove.plans import catalogue
from postgrove.streaming import admission, posts
from tests.test_admission import replay

FIRST = datetime(2023, 11, 14, 22, 13, 20, tzinfo=timezone.utc)


def test_keys_and_large_ids_are_exact_beside_the_closing_row(spark, tmp_path):
    """The closing row has no key and no id; it came in one batch with others, whose whole numbers became fractions: keys were lost and their lines mixed up."""
    calls = [(None if k == 7 else k, 2**60 + 300 * n + k, FIRST + timedelta(seconds=n), 5000, None) for n in range(3) for k in range(300)]
    calls += [(1, None, FIRST, 1, None), (1, 5, None, 1, None)]
    table = spark.createDataFrame(calls, f"key long, {admission.CALL}")
    got = posts.run_to_files(admission.turns(admission.call_stream(spark, table, f"{tmp_path}/calls"), 3, 60_000), f"{tmp_path}/out", f"{tmp_path}/log")
    zero = int(FIRST.timestamp() * 1000)
    assert got.schema["key"].dataType == table.schema["key"].dataType
    assert {(r["key"], r["id"], r["started"] - zero) for r in got.collect()} == {(c[0], c[1], 5000 * ((c[1] - 2**60) // 300)) for c in calls[:900]} and got.count() == 900


def test_all_events_are_admitted_or_refused_under_their_own_user(spark, tmp_path):
    """``stream_admission`` over users with 2 to 5 events in an hour: the fourth and fifth are refused, and a user without a number is a user."""
    rows = [(1000 * k + n, (FIRST + timedelta(minutes=n)).replace(tzinfo=None), None if k == 3 else k) for k in range(200) for n in range(2 + k % 4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["stream_admission"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((u, i, i % 1000 < 3) for i, _, u in rows), key=repr)


@pytest.mark.parametrize("kind,keys", [("string", ["a", "", None, "ü=1"]), ("date", [FIRST.date(), None]), ("double", [0.1, 1e300])])
def test_keys_of_other_types(spark, tmp_path, kind, keys):
    table = spark.createDataFrame([(k, i, FIRST, 1000, 0) for i, k in enumerate(keys + keys)], f"key {kind}, {admission.CALL}")
    got = posts.run_to_files(admission.turns(admission.call_stream(spark, table, f"{tmp_path}/calls")), f"{tmp_path}/out", f"{tmp_path}/log").collect()
    assert {(r["key"], r["id"], r["started"] - r["arrived"]) for r in got} == {(k, i, i // len(keys) * 1000) for i, k in enumerate(keys + keys)}


def test_state_is_read_and_written_by_chunks(spark, tmp_path):
    """Sparse calls: 40 keys, 2 400 calls, nearly each in a cell of its own, of which each took some eight state calls before."""
    calls = [(k, 60 * k + n, FIRST + timedelta(days=n, hours=k), 1000, None) for k in range(40) for n in range(60)]
    stream = admission.call_stream(spark, spark.createDataFrame(calls, f"key long, {admission.CALL}"), f"{tmp_path}/calls")
    rows = []
    run = admission.turns(stream, 3, 3_600_000).writeStream.foreachBatch(lambda batch, _: rows.append(batch.count())).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    done = [o for p in run.recentProgress for o in p["stateOperators"]]
    assert sum(rows) == 2400
    assert 0 < sum(o["customMetrics"]["rocksdbGetCount"] + o["customMetrics"]["rocksdbPutCount"] for o in done) < 2400


class Kept:
    """A state in memory in place of Spark's."""

    def __init__(self):
        self.values, self.timers = {}, set()
        self.getValueState = lambda *_: SimpleNamespace(get=lambda: self.values.get("index"), update=lambda v: self.values.update(index=v), clear=lambda: self.values.pop("index", None))
        self.registerTimer = self.timers.add
        self.maps = {}

    def getMapState(self, name, *_):
        kept = self.maps.setdefault(name, {})
        return SimpleNamespace(getValue=kept.get, updateValue=kept.__setitem__, removeKey=kept.pop)


@pytest.mark.parametrize("wait", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_chunks_of_unordered_calls_equal_the_replay(monkeypatch, seed, wait):
    draw = random.Random(seed)
    for name, value in (("CHUNK", draw.choice([2, 8])), ("HELD", draw.choice([1, 16, 1000])), ("LINES", draw.choice([1, 3]))):
        monkeypatch.setattr(admission, name, value)
    step, state, got, told = draw.choice([1, 50, 1000]), Kept(), {}, []
    turns = admission.Turns(2, 60, 1, step, wait)
    turns.init(state)
    span = draw.choice([1, 40, 3000])
    for until in [*range(0, 4000, 400), 10**6]:
        new = [(draw.choice("abc"), len(told) + i, draw.randint(until, until + span), draw.choice([0, 7, 40]), draw.choice([0, 0, 25])) for i in range(draw.choice([0, 1, 60]))] if until < 4000 else []
        told += new
        parts = [pd.DataFrame(new[a : a + 9], columns=admission._COLUMNS.names) for a in range(0, len(new), 9)]
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda u=until: u)
        list(turns.handleInputRows((0,), iter(parts), now))
        for timer in sorted(t for t in state.timers if t <= until):
            for rows in turns.handleExpiredTimer((0,), now, None):
                assert (rows["arrived"] < until).all()
                got |= {i: None if pd.isna(s) else s for i, s in zip(rows["id"], rows["started"])}
            state.timers.discard(timer)
        for begin, (packed,) in state.maps["chunks"].items():
            calls = admission.pa.ipc.open_stream(packed).read_all()
            assert begin[0] <= calls["arrived"][0].as_py() and (len(calls) <= admission.CHUNK or len(set(calls["arrived"].to_pylist())) == 1)
    assert not state.maps["chunks"] and not state.timers and "index" not in state.values
    for key in "abc":
        calls = [c[1:] for c in told if c[0] == key]
        if wait:
            want = replay(calls, 2, 60, 1)
        else:
            line, want = admission.Line([], [], []), {}
            for i, arrived, took, retry_after in sorted(calls, key=lambda c: (c[1], c[0])):
                goes = line.next_start(arrived, 2, 60, 1) == arrived
                want[i] = arrived if goes else None
                if goes:
                    line.start(arrived, took, retry_after, 2, 1)
        assert {i: got[i] for i, *_ in calls} == want
    assert len(got) == len(told)
