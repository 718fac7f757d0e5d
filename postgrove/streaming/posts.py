"""Structured Streaming over files of messages (SRC3, SRC5, SNK1, SNK6, ST10). The rules are those of the batch operators.

Deduplication is unbounded, as keys stay unique for ever: the keys seen, and nothing else of a message, are state in RocksDB. A batch looks up and writes its own keys only, so what it
reads does not grow with what is stored. Each batch is
written to a folder named by its number and overwritten if it runs again, so a restarted stream stores nothing twice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postgrove.operators.state import message_key

def message_stream(spark: SparkSession, folder: str, name: str, schema: StructType, channels: list[str] | None = None, files_per_batch: int = 1) -> DataFrame:
    """SRC3: messages as they arrive in a folder; those without text, or of channels that are not listened to, are skipped."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    if "text" in schema.names:
        rows = rows.where(F.coalesce(F.trim("text") != "", F.lit(False)))
    return rows.where(F.lower("channel").isin(*[c.lower() for c in channels])) if channels is not None else rows


def files_of(spark: SparkSession, path: str) -> tuple:
    """The store that holds ``path``, and the path, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def batches_in(spark: SparkSession, target: str) -> list[str]:
    """The names of the batch folders under ``target``."""
    files, root = files_of(spark, target)
    return sorted(x.getPath().getName() for x in files.listStatus(root) if x.getPath().getName().startswith("batch=")) if files.exists(root) else []


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of a micro-batch the first of each key by ``order``; rows without a key go. A task holds the rows of its keys' firsts."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = pa.Table.from_batches([batch])
            found = (found if held is None else pa.concat_tables([held, found])).filter(pc.is_valid(pc.field(key)))
            found = found.sort_by([(c, "ascending") for c in (key, *order)])
            keys = found.column(key).combine_chunks()
            held = found.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))])) if len(keys) else found
        yield from held.to_batches() if held is not None else []

    return rows.repartition(key).mapInArrow(reduce, rows.schema)


def ingest(messages: DataFrame, target: str, checkpoint: str, backlog: DataFrame | None = None) -> DataFrame:
    """SNK1, SRC5: appends messages with new keys (message_key added) under ``target`` until the source is read up; gives what is stored.

    Of the messages of a batch with one key the earliest is stored. ``backlog`` is the history read beside the live source: it lies beside the target from the first run on, is
    in the first batch whole, and goes before live messages, so what both have is stored once. Later runs go on with it or without."""
    spark, history = messages.sparkSession, f"{target}-backlog"
    use_rocksdb(spark)
    files, at = files_of(spark, history)
    if not files.exists(at):
        (spark.createDataFrame([], messages.schema) if backlog is None else backlog.select(*messages.columns)).write.parquet(history)
    both = spark.readStream.schema(messages.schema).parquet(history).withColumn("_rank", F.lit(0)).unionByName(messages.withColumn("_rank", F.lit(1)))
    keyed = first_of_each(both.withColumn("message_key", message_key()), "message_key", ["_rank", "received_at", "id"])
    new = keyed.dropDuplicates(["message_key"]).drop("_rank")
    return run_to_files(new, target, checkpoint)


def messages_of_none(spark: SparkSession, messages: DataFrame) -> DataFrame:
    return spark.createDataFrame([], messages.schema)


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk from now on, of which a batch uploads its changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` behind the newest are left out, as the history scan's cutoff does."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def broadcast_rows(changes: DataFrame, dedicated: list[str]) -> DataFrame:
    """SNK6: each change with the feed it belongs to, by its source, and its event."""
    feed = F.when(F.col("source").isin(*dedicated), "imported").otherwise("main")
    return changes.withColumn("feed", F.coalesce(feed, F.lit("main"))).withColumn("event", F.when(F.col("is_new"), "created").otherwise("updated"))


def run_to_files(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now, each batch into a folder of its own that a rerun overwrites; gives all batches, or in complete mode the last, which holds everything."""
    spark = stream.sparkSession
    put = lambda batch, k: batch.hint("rebalance").write.mode("overwrite").parquet(f"{target}/batch={k:09d}")  # noqa: E731  few files for a small batch
    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    held = batches_in(spark, target)
    paths = [f"{target}/{name}" for name in (held[-1:] if mode == "complete" else held)]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def visible_stream(stream: DataFrame, condition: Column) -> DataFrame:
    """ST10, FLT15: live rows pass the same filter as stored ones."""
    return stream.where(condition)
