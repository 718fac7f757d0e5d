"""The live feed gives what one event after the other gives, whatever the batches, retries and restarts."""

from __future__ import annotations

import random

from postgrove.streaming import live as L

EVENT = "seq long, event string, source string, id long, value double, `odd name` struct<`a b`:string>"
SHOWN = "feed string, place long, id long, value double, `odd name` struct<`a b`:string>"
FEEDS = [L.Feed("main", "value > 0"), L.Feed("imported", "value > 0", ("page",), newest_first=False, both_ends=True), L.Feed("quiet", "true", ("quiet",), newest_first=False)]


def some(r: random.Random, n: int, first: int):
    kinds = ["created", "updated", "listed", "updated", "odd", None]
    return [(first + k, r.choice(kinds), ["page", "quiet", "x", None][i % 4], i if r.random() < 0.97 else None, r.choice([None, -1.0, 1.0, 2.0]), (str(k),)) for k in range(n) for i in [r.randrange(40)]]


def one_by_one(shown, events):
    """{(feed, id): (place, value, odd)}, an event at a time."""
    held = {(f, i): ((p,), v, o[0]) for f, p, i, v, o in shown}
    for seq, event, source, i, value, odd in events:
        feed = {"page": "imported", "quiet": "quiet"}.get(source, "main")
        if i is None or event not in L.KINDS:
            continue
        if event == "updated":
            if (feed, i) in held:
                held[feed, i] = (held[feed, i][0], value, odd[0])
        elif (feed, i) not in held and (event == "listed" or (feed != "quiet" and value is not None and value > 0)):
            held[feed, i] = ((-seq - 1,) if feed == "main" else (seq + L.END,), value, odd[0])
    return held


def found(df):
    return {(r["feed"], r["id"]): (tuple(r["place"]), r["value"], r["odd name"][0]) for r in df.collect()}


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_lists_and_sinks(spark, tmp_path):
    r = random.Random(3)
    source, target, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    shown = [("main", k, k * 4 + 2, 1.0, ("s",)) for k in range(4)] + [("imported", k, k * 8, 1.0, ("s",)) for k in range(3)]
    first = spark.createDataFrame(shown, SHOWN)
    gone: list = []
    for part in range(5):
        rows = some(r, 40, part * 100)
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        gone += rows
        lists = L.run(stream(spark, source), target, log, FEEDS, first, most=2)
        assert found(lists) == one_by_one(shown, gone)
    again = L.run(stream(spark, source), target, log, FEEDS, first)
    assert found(again) == one_by_one(shown, gone)
    sound = [e for e in gone if e[3] is not None and e[1] in L.KINDS]
    for feed, sources in (("main", ("x", None)), ("imported", ("page",)), ("quiet", ("quiet",))):
        assert sorted(x["seq"] for x in L.sent(spark, target, feed).collect()) == sorted(e[0] for e in sound if e[2] in sources)
    assert len(L.whole(spark, f"{target}/lists")) <= 2 and len(L.whole(spark, f"{target}/changes")) <= 4


def test_a_lost_log_repeats_all_batches_and_changes_nothing(spark, tmp_path):
    r = random.Random(4)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = some(r, 60, 0)
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(source)
    once = found(L.run(stream(spark, source), target, str(tmp_path / "log1"), FEEDS))
    twice = found(L.run(stream(spark, source), target, str(tmp_path / "log2"), FEEDS))
    assert once == twice == one_by_one([], rows)
    n = sum(L.sent(spark, target, f.name).count() for f in FEEDS)
    assert n == sum(1 for e in rows if e[3] is not None and e[1] in L.KINDS)


def test_pages_replace_the_list_and_live_rows_stay_in_front(spark, tmp_path):
    source, target, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    put = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    put([(1, "created", "x", 10, 1.0, ("a",)), (2, "created", "x", 11, 1.0, ("b",))])
    L.run(stream(spark, source), target, log, FEEDS, spark.createDataFrame([("main", 0, 5, 1.0, ("s",))], SHOWN))
    pages = spark.createDataFrame([("main", 0, 10, 2.0, ("page",)), ("main", 1, 6, 2.0, ("page",))], SHOWN)
    order = lambda df: [(x["id"], x["odd name"][0]) for x in df.where("feed = 'main'").orderBy("place").collect()]
    assert order(L.replace(spark, target, pages, 3)) == [(11, "b"), (5, "s"), (10, "page"), (6, "page")]
    put([(4, "created", "x", 12, 1.0, ("c",)), (5, "updated", "x", 6, 1.0, ("d",)), (6, "updated", "x", 99, 1.0, ("e",))])
    assert order(L.run(stream(spark, source), target, log, FEEDS)) == [(12, "c"), (11, "b"), (5, "s"), (10, "page"), (6, "d")]


def test_nothing_read_gives_nothing(spark, tmp_path):
    assert L.lists(spark, str(tmp_path / "none")) is None and L.sent(spark, str(tmp_path / "none"), "main") is None
