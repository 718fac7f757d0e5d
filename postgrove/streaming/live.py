"""A live feed (SNK6, ST10, ST17-ST19): a stream of events goes to its feeds' sinks, and into a versioned list of what each feed shows.

An event (seq, event, source, id, ...) is ``created`` (a new row), ``updated`` (a row changed) or ``listed`` (a row of a refreshed first page). ``seq`` numbers events in the order
of arrival, from 0 to below 2^40. What a feed shows of an id follows from two of its events alone, the first that puts it in and the last update, and both are found by
aggregation: so a batch writes only the changes it brings, whatever the list's length, and the list is one aggregation over the newest base and the changes since. Bases are
rewritten when the changes have grown to their size or are many.

Folders under ``target``, numbered, overwritten by a retry and read only when whole: ``sent/batch=k/feed=f`` has what was sent to a feed, ``changes/batch=k`` the changes of a
batch, ``lists/base=n.r`` the lists after n batches (``r``: the number of a replacement, else 0)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrove.streaming.posts import files_of

#: Changes are folded into a new base after this many batches even if they are small, so that few folders are read.
MOST_CHANGES = 64
#: Places of rows put behind a list start here.
END = 1 << 40
KINDS = ("created", "updated", "listed")
KEYS = ("feed", "id")


@dataclass(frozen=True)
class Feed:
    """What a feed shows: ``listed`` rows, and created ones that are ``visible``; in front if sorted newest first, else at the end, where created ones come only with ``both_ends``.
    ``visible`` is a SQL condition over an event. ``sources`` are those it is dedicated to; None for the feed of all other sources."""

    name: str
    visible: str
    sources: tuple[str, ...] | None = None
    newest_first: bool = True
    both_ends: bool = False


def routed(events: DataFrame, feeds: list[Feed]) -> DataFrame:
    """SNK6: events with their feed. One without an id, a number or a known kind is no event."""
    others = next(f.name for f in feeds if f.sources is None)
    named = [F.when(F.col("source").isin(*f.sources), F.lit(f.name)) for f in feeds if f.sources is not None]
    sound = F.col("id").isNotNull() & F.col("seq").isNotNull() & F.col("event").isin(*KINDS)
    return events.where(sound).withColumn("feed", F.coalesce(*named, F.lit(others)))


def values_of(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c not in ("seq", "event", "source", *KEYS)]


def changes(events: DataFrame, feeds: list[Feed]) -> DataFrame:
    """(feed, id, come, last): of routed events, the first of each id that puts it into its feed's list, and its last update; either may be null."""
    shown = F.struct(*[F.col(quoted(c)) for c in values_of(events)])
    of = lambda f: F.col("feed") == f.name
    enters = reduce(lambda a, b: a | b, [of(f) & ((F.col("event") == "listed") | ((F.col("event") == "created") & F.expr(f.visible) & F.lit(f.newest_first or f.both_ends))) for f in feeds])
    front = reduce(lambda a, b: a | b, [of(f) for f in feeds if f.newest_first], F.lit(False))
    place = F.array(F.when(front, -F.col("seq") - 1).otherwise(F.col("seq") + END))
    come = F.when(F.coalesce(enters, F.lit(False)), F.struct("seq", place.alias("place"), shown.alias("row")))
    last = F.when(F.col("event") == "updated", F.struct("seq", shown.alias("row")))
    return folded(events.select(*KEYS, come.alias("come"), last.alias("last")).where("come IS NOT NULL OR last IS NOT NULL"))


def folded(entries: DataFrame) -> DataFrame:
    """Changes of one id as one; it does not matter in how many steps this is done, as ``seq`` decides."""
    return entries.groupBy(*KEYS).agg(F.min_by("come", "come.seq").alias("come"), F.max_by("last", "last.seq").alias("last"))


def settled(entries: DataFrame) -> DataFrame:
    """ST10: rows that are in, with their last update if it came after them. An update never brings a row in, and a second arrival changes nothing."""
    newer = F.coalesce(F.col("last.seq") > F.col("come.seq"), F.lit(False))
    now = F.when(newer, F.col("last.row")).otherwise(F.col("come.row"))
    return entries.where("come IS NOT NULL").select(*KEYS, F.struct("come.seq", "come.place", now.alias("row")).alias("come"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished folders in ``folder``, in order."""
    files, at = files_of(spark, folder)
    if not files.exists(at):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(x.getPath().getName() for x in files.listStatus(at) if files.exists(path(x.getPath(), "_SUCCESS")))


def number(name: str) -> int:
    return int(name.partition("=")[2].partition(".")[0])


def held(spark: SparkSession, target: str) -> tuple[str | None, list[str]]:
    """The newest base, and the changes since."""
    bases = whole(spark, f"{target}/lists")
    base = bases[-1] if bases else None
    since = number(base) if base else 0
    return base, [c for c in whole(spark, f"{target}/changes") if number(c) >= since]


def entries_of(spark: SparkSession, target: str) -> DataFrame | None:
    base, since = held(spark, target)
    rows = [spark.read.parquet(f"{target}/lists/{base}").withColumn("last", F.lit(None))] if base else []
    if since:
        fresh = spark.read.parquet(*[f"{target}/changes/{c}" for c in since])
        rows = [r.withColumn("last", F.lit(None).cast(fresh.schema["last"].dataType)) for r in rows] + [fresh]
        return folded(reduce(DataFrame.unionByName, rows))
    return rows[0].withColumn("last", F.lit(None).cast("struct<seq:bigint,row:string>")) if rows else None


def lists(spark: SparkSession, target: str) -> DataFrame | None:
    """(feed, place, id, ...): what the feeds show now, to be read by ``place``; None before anything was written."""
    base, since = held(spark, target)
    if base is None and not since:
        return None
    rows = settled(entries_of(spark, target)) if since else spark.read.parquet(f"{target}/lists/{base}")
    return rows.select("feed", "come.place", "id", "come.row.*")


def put_base(rows: DataFrame, target: str, n: int, replacement: int = 0) -> None:
    rows.write.mode("overwrite").parquet(f"{target}/lists/base={n:09d}.{replacement:013d}")


def compact(spark: SparkSession, target: str, most: int = MOST_CHANGES) -> None:
    """Folds the changes into a new base if they have its size or are ``most``. What the base before it made needless is removed; that base and the changes since stay for readers."""
    base, since = held(spark, target)
    size = lambda name: (lambda files, at: files.getContentSummary(at).getLength())(*files_of(spark, f"{target}/{name}"))
    if not since or (len(since) < most and base and sum(size(f"changes/{c}") for c in since) < size(f"lists/{base}")):
        return
    put_base(settled(entries_of(spark, target)), target, number(since[-1]) + 1)
    kept = number(base) if base else 0
    old = [f"lists/{b}" for b in whole(spark, f"{target}/lists") if base and b < base] + [f"changes/{c}" for c in whole(spark, f"{target}/changes") if number(c) < kept]
    for name in old:
        files, at = files_of(spark, f"{target}/{name}")
        files.delete(at, True)


def run(events: DataFrame, target: str, checkpoint: str, feeds: list[Feed], shown: DataFrame | None = None, most: int = MOST_CHANGES) -> DataFrame | None:
    """Reads the stream up and gives the lists. ``shown`` (feed, place, id, ...) is what the lists hold before the first run; later runs go on with what is stored.
    ``target`` and ``checkpoint`` belong together."""
    spark = events.sparkSession
    values = values_of(events)
    if shown is not None and not whole(spark, f"{target}/lists"):
        row = F.struct(*[F.col(quoted(c)).cast(events.schema[c].dataType).alias(c) for c in values])
        put_base(shown.select("feed", "id", F.struct(F.lit(-1).cast("long").alias("seq"), F.array(F.col("place").cast("long")).alias("place"), row.alias("row")).alias("come")), target, 0)

    def put(batch: DataFrame, k: int) -> None:
        sent = f"{target}/sent/batch={k:09d}"
        routed(batch.withColumn("seq", F.col("seq").cast("long")), feeds).hint("rebalance").write.mode("overwrite").partitionBy("feed").parquet(sent)
        if any(number(b) > k for b in whole(spark, f"{target}/lists")):
            return  # a batch that ran before and is in a base already
        fields = batch.withColumns({"seq": F.col("seq").cast("long"), "feed": F.lit("")}).schema
        changes(spark.read.schema(fields).parquet(sent), feeds).hint("rebalance").write.mode("overwrite").parquet(f"{target}/changes/batch={k:09d}")
        compact(spark, target, most)

    running = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return lists(spark, target)


def sent(spark: SparkSession, target: str, feed: str) -> DataFrame | None:
    """What was sent to a feed, each event once however often its batch ran."""
    done = whole(spark, f"{target}/sent")
    return spark.read.option("basePath", f"{target}/sent").parquet(*[f"{target}/sent/{b}" for b in done]).where(F.col("feed") == feed).drop("batch") if done else None


def replace(spark: SparkSession, target: str, pages: DataFrame, seq: int) -> DataFrame:
    """ST17: the fetched ``pages`` (feed, place, id, ...) take the lists' place between two runs; rows that only the lists have stay, in their order, in front. ``seq`` is the number of the fetch
    among the events. Pages are from then on what an update must be later than."""
    base, since = held(spark, target)
    rows = settled(entries_of(spark, target)) if since else spark.read.parquet(f"{target}/lists/{base}")
    row = rows.schema["come"].dataType["row"].dataType
    fields = F.struct(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in row.fields])
    new = pages.select(*KEYS, F.struct(F.lit(seq).cast("long").alias("seq"), F.array(F.lit(0).cast("long"), F.col("place").cast("long")).alias("place"), fields.alias("row")).alias("come"))
    front = F.concat(F.array(F.lit(-seq - 1).cast("long")), "come.place")
    kept = rows.join(pages.select(*KEYS), list(KEYS), "left_anti").select(*KEYS, F.struct("come.seq", front.alias("place"), "come.row").alias("come"))
    put_base(kept.unionByName(new), target, number(since[-1]) + 1 if since else number(base), seq)
    return lists(spark, target)
