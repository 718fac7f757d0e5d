"""ST8: calls of a key wait in line and start one after another, under a rolling limit, a number of running calls and the pauses that a refusing server asks for.

A call starts at the earliest time, not before the one ahead of it, at which fewer than ``concurrency`` calls run, fewer than ``most`` have started within the
``window`` and no pause holds. A call runs for ``took``; one with a ``retry_after`` was refused, and from its end on nothing of its key starts for that long.

Keys are dealt to a fixed number of buckets, and a bucket's waiting calls, of all its keys, lie in state as chunks: Arrow tables of disjoint ranges of time, of
``CHUNK`` calls at most (more only where more came in one millisecond). When the watermark has passed a cell of ``step``, a timer of the bucket reads the chunks up to there one after
the other and starts their calls in order. So no key's line is gathered, and state is read and written by chunks, not by calls: a task holds ``HELD`` new calls or one
chunk, and of up to ``LINES`` keys the last ``most`` starts, the ends of at most ``concurrency`` running calls and their pauses. The state is in
RocksDB. Calls later than ``late`` behind the newest are left out, as everywhere behind a watermark; calls that arrive together start in order of id.
A row without an id is no call, but moves the watermark on: it closes a source that has come to its end."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postgrove.session import spread
from postgrove.streaming.posts import use_rocksdb

#: What a call is: when it came, how long it runs and what pause it brings, in milliseconds.
CALL = "id long, at timestamp, took long, retry_after long"
#: The most calls of a chunk, the most new calls put away at once, and the most keys whose lines are held at once.
CHUNK, HELD, LINES = 8192, 131_072, 20_000
_COLUMNS = pa.schema([("key", pa.string()), ("id", pa.int64()), ("arrived", pa.int64()), ("took", pa.int64()), ("retry_after", pa.int64())])
_ORDER = [("arrived", "ascending"), ("id", "ascending")]


class Line:
    """The state of one key, and when its next call starts."""

    def __init__(self, starts: list[int], ends: list[int], pauses: list[tuple[int, int]]):
        self.starts, self.ends, self.pauses = starts, ends, pauses

    def next_start(self, arrived: int, most: int, window: int, concurrency: int) -> int:
        starts, ends, pauses, at = self.starts, self.ends, self.pauses, arrived
        if starts and starts[-1] > at:
            at = starts[-1]
        free = starts[-most] + window if len(starts) >= most else at
        if free > at:
            at = free
        if len(ends) >= concurrency and ends[-concurrency] > at:
            at = ends[-concurrency]
        again = bool(pauses)
        while again:  # the other limits are lifted for good by now, but one pause may lead into another
            again = False
            for begin, until in pauses:
                if begin <= at < until:
                    at, again = until, True
        return at

    def start(self, at: int, took: int, retry_after: int, most: int, concurrency: int) -> None:
        """Notes a start; nothing starts before it any more, so what has ended by then goes."""
        starts, ends, end = self.starts, self.ends, at + took
        starts.append(at)
        if len(starts) > most:
            del starts[0]
        while ends and ends[0] <= at:
            del ends[0]
        if took > 0:
            insort(ends, end)
            if len(ends) > concurrency:
                del ends[0]
        if self.pauses:
            self.pauses = [p for p in self.pauses if p[1] > at]
        if retry_after > 0 and end + retry_after > at:
            self.pauses.append((end, end + retry_after))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _COLUMNS) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _parts(table: pa.Table) -> list[pa.Table]:
    """A table in order of time in parts of half a chunk, so that more fits in; calls of one millisecond stay together."""
    at, begin, parts = table["arrived"].to_numpy(), 0, []
    while len(at) - begin > CHUNK:
        middle = at[begin + CHUNK // 2]
        cut = int(np.searchsorted(at, middle))
        cut = cut if cut > begin else int(np.searchsorted(at, middle, "right"))
        parts.append(table.slice(begin, cut - begin))
        begin = cut
    return [p for p in (*parts, table.slice(begin)) if len(p)]


class Turns(StatefulProcessor):
    def __init__(self, most: int, window: int, concurrency: int, step: int, wait: bool):
        self.most, self.window, self.concurrency, self.step, self.wait = most, window, concurrency, step, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "begins array<long>, timer long")
        self.chunks = handle.getMapState("chunks", "begin long", "calls binary")
        self.lines = handle.getMapState("lines", "key string", "starts array<long>, ends array<long>, pause_from array<long>, pause_until array<long>")

    def _chunk(self, begin: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.chunks.getValue((begin,))[0])).read_all()

    def _put_away(self, held: list[pa.Table], begins: list[int]) -> list[int]:
        """Adds calls to the chunks of their time; gives where all chunks begin now."""
        new = pa.concat_tables(held).sort_by(_ORDER)
        at = new["arrived"].to_numpy()
        cuts = [0, *np.searchsorted(at, begins[1:]).tolist(), len(at)] if begins else [0, len(at)]
        after = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                after.append(begins[k])
                continue
            table = new.slice(a, b - a)
            if begins:
                table = pa.concat_tables([self._chunk(begins[k]), table]).sort_by(_ORDER)
            for n, part in enumerate(_parts(table)):
                begin = part["arrived"][0].as_py()
                if n == 0 and begins:
                    if begin < begins[k]:
                        self.chunks.removeKey((begins[k],))
                    begin = min(begin, begins[k])
                self.chunks.updateValue((begin,), (_packed(part),))
                after.append(begin)
        return after

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begins, timer = self.index.get() or ([], None)
        begins, held, touched = list(begins), [], False
        for part in rows:
            calls = part[part["key"].notna()]
            if len(calls):
                held.append(pa.Table.from_pandas(calls[_COLUMNS.names], schema=_COLUMNS, preserve_index=False))
            if sum(map(len, held)) >= HELD:
                begins, held, touched = self._put_away(held, begins), [], True
        if held:
            begins, touched = self._put_away(held, begins), True
        if touched:
            due = (begins[0] // self.step + 1) * self.step
            if timer is None or due < timer:
                self.handle.registerTimer(timer := due)
            self.index.update((begins, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // self.step * self.step
        begins, lines = list((self.index.get() or ([], None))[0]), {}
        while begins and begins[0] < until:
            begin = begins.pop(0)
            table = self._chunk(begin)
            self.chunks.removeKey((begin,))
            due = int(np.searchsorted(table["arrived"].to_numpy(), until))
            if due:
                yield self._started(table.slice(0, due), lines)
            if due < len(table):
                rest = table.slice(due)
                begins.insert(0, rest["arrived"][0].as_py())
                self.chunks.updateValue((begins[0],), (_packed(rest),))
        self._keep(lines)
        if begins:
            timer = (begins[0] // self.step + 1) * self.step
            self.handle.registerTimer(timer)
            self.index.update((begins, timer))
        else:
            self.index.clear()

    def _started(self, calls: pa.Table, lines: dict[str, Line]) -> pd.DataFrame:
        """Calls in order of time with their starts; ``lines`` has the lines of keys met before."""
        starts, most, window, concurrency, wait = [], self.most, self.window, self.concurrency, self.wait
        for key, arrived, took, retry_after in zip(calls["key"].to_pylist(), *(calls[c].to_numpy().tolist() for c in ("arrived", "took", "retry_after"))):
            line = lines.get(key)
            if line is None:
                if len(lines) >= LINES:
                    self._keep(lines)
                kept = self.lines.getValue((key,)) or ([], [], [], [])
                line = lines[key] = Line(list(kept[0]), list(kept[1]), list(zip(kept[2], kept[3])))
            start = line.next_start(arrived, most, window, concurrency)
            goes = wait or start == arrived
            if goes:
                line.start(start, took, retry_after, most, concurrency)
            starts.append(start if goes else None)
        return calls.select(["key", "id", "arrived"]).to_pandas().assign(started=pd.array(starts, "Int64"))

    def _keep(self, lines: dict[str, Line]) -> None:
        for key, line in lines.items():
            self.lines.updateValue((key,), (line.starts, line.ends, [a for a, _ in line.pauses], [b for _, b in line.pauses]))
        lines.clear()


def turns(calls: DataFrame, most: int = 10, window: int = 60_000, concurrency: int = 1, wait: bool = True, late: str = "10 minutes", step: int | None = None, buckets: int = 256) -> DataFrame:
    """A stream of calls (key, id, at, took, retry_after) as (key, id, arrived, started), times in milliseconds. ``wait``: if not, a call that
    cannot start at once does not start at all (``started`` is null) and counts for nothing. ``buckets`` is how many tasks can share the work, and stays for as long as the
    stream's log; keys are of a type that becomes text and back."""
    use_rocksdb(calls.sparkSession)
    kind = calls.schema["key"].dataType
    number = lambda c, name: F.coalesce(c.cast("long"), F.lit(0)).alias(name)  # noqa: E731  no null, since pandas has no null among whole numbers
    text = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))
    text = F.when(F.col("id").isNotNull() & F.col("at").isNotNull(), text).alias("key")  # null if the row is no call
    rows = calls.withWatermark("at", late).select(text, number(F.unix_millis("at"), "arrived"), *[number(F.col(c), c) for c in ("id", "took", "retry_after")], "at")
    rows = rows.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets)))
    shape = StructType([StructField("key", StringType()), *(StructField(c, LongType()) for c in ("id", "arrived", "started"))])
    processor = Turns(most, window, concurrency, step or window, wait)
    started = rows.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")
    return started.withColumn("key", F.when(F.col("key") != "", F.expr("substr(key, 2)")).cast(kind))


def call_stream(spark: SparkSession, calls: DataFrame, folder: str) -> DataFrame:
    """Calls of a table as a stream that ends: they are written to ``folder`` with a closing row, and read as one batch, since files of a table are in no order of time."""
    mark = calls.limit(0).select("key").join(spark.range(1), F.lit(True), "right").select("key", F.lit(None).cast("long").alias("id"), F.lit("2200-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("took"), F.lit(0).cast("long").alias("retry_after"))
    every = calls.select("key", "id", "at", "took", "retry_after").unionByName(mark)
    spread(every).write.parquet(folder)
    return spark.readStream.schema(every.schema).parquet(folder)
