"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word shingles. All coordinates of a signature come from two permutations: the
first places every shingle on a circle, the second is read from that place on, one step further for each
coordinate. Bands of coordinates are bucket keys. Only one of several equal sets takes part.

Links within a bucket are found without listing its pairs; buckets with the same members count once. In turns, every member
is compared with one centre of its bucket (first the member with most bucket mates, which is the original rather than a
copy), and the links join components. A bucket is settled when all its members that have been no centre are one component. Another turn follows while
many pairs would be left; what is still open then is compared block by block, members outside the largest component with all, and a block gives
only the links that join components. So no link among bucket mates of different components is missed, and what
is written grows with the rows, not with their pairs. Every link is confirmed on the full sets. With the default bands,
a pair at the threshold of 0.8 meets in no bucket with a probability of 3 in a million.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a text with fewer words than a shingle
is one shingle, and a text of any length is taken whole; rows with the same id are one document, whose texts are linked; rows without an id have no
component and are kept; an empty table gives an empty one; columns beside doc_id and text are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from postgrove.llm.common import Scratch, read_table, stored

PLACES = 1 << 20
BANDS, ROWS = 32, 5
#: The most turns of comparing with one centre before blocks are compared, and how many pairs a member that blocks would compare make another turn worth its jobs.
TURNS, PAIRS_A_MEMBER = 3, 4096
_U = np.uint64


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles; words end at ASCII white space, A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))
    n = len(h) - size + 1
    x = np.zeros(n, dtype=_U)
    for k in range(size):
        x = (x ^ x >> _U(31)) * _U(0x9E3779B97F4A7C15) + h[k : k + n] * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    return np.unique(x)


class Circulant:
    """Signatures from two permutations of PLACES points, the same on every machine."""

    def __init__(self, coordinates: int, bands: int, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.place = draw.permutation(PLACES).astype(np.int32)
        value = draw.permutation(PLACES).astype(np.int32)
        self.read = np.lib.stride_tricks.sliding_window_view(np.concatenate([value, value[:coordinates]]), coordinates)
        self.salt = draw.integers(1, 1 << 63, size=(bands, coordinates // bands), dtype=np.uint64) | _U(1)
        self.bands = bands

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.place[(shingles >> _U(17)).astype(np.int64) & PLACES - 1]
        best = None
        for k in range(0, len(at), 4096):  # a long text in parts
            low = self.read[at[k : k + 4096]].min(axis=0)
            best = low if best is None else np.minimum(best, low)
        return best

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band."""
        x = (signature.astype(_U).reshape(self.bands, -1) + _U(1)) * self.salt
        x ^= x >> _U(29)
        total = (x * self.salt).sum(axis=1, dtype=_U)
        total ^= total >> _U(32)
        return (total * _U(0xD6E8FEB86659FD93)).view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set, bands): ``set`` is a digest of the shingle set, null for none."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circulant(bands * rows, bands)
        for batch in batches:
            count, names, keys = [], [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), size)
                count.append(len(s))
                names.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                keys.append(circle.keys(circle.signature(s)) if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, `set` binary, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach. Labels spread along links and then
    jump to their label's label, so the number of rounds is about the logarithm of the longest path."""
    both = scratch.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = scratch.stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        root = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        new = scratch.stored(spread.join(root, "low").select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def crowded_buckets(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, mates): the buckets that several sets share, of those with the same members one. ``mates`` adds up the sizes of all
    buckets of a node."""
    marks = ("mark0", "mark1")
    member = sets.select("node", F.explode("bands").alias("key"), *[F.xxhash64("set", F.lit(m)).alias(m) for m in marks])
    many = member.groupBy("key").agg(F.count(F.lit(1)).alias("many"), *[F.bit_xor(m).alias(m) for m in marks]).where("many > 1")
    one = many.groupBy("many", *marks).agg(F.min("key").alias("key")).select("key", "many")
    bucket = scratch.stored(member.select("node", "key").join(one, "key"), "members")
    return scratch.stored(bucket.join(bucket.groupBy("node").agg(F.sum("many").alias("mates")), "node").select("key", "node", "mates"), "buckets")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 256, turns: int = TURNS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        return stored(_near_duplicates(docs, size, percent, bands, rows, block, turns, scratch), "near-duplicates")


def _near_duplicates(docs: DataFrame, size: int, percent: int, bands: int, rows: int, block: int, turns: int, scratch: Scratch) -> DataFrame:
    signed = scratch.stored(signatures(docs, size, bands, rows), "signatures")
    # The sets: each is stood for by its smallest id.
    sets = scratch.stored(signed.where("`set` IS NOT NULL AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "sets")
    bucket = crowded_buckets(sets, scratch)

    # The texts of all that have bucket mates, by node.
    mates = bucket.select("node").distinct()
    texts = scratch.stored(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(mates.hint("merge"), "node"), "texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, its = None, None
        for batch in batches:
            a, b, ta, tb = batch.columns
            out = []
            for k in range(batch.num_rows):
                text = ta[k].as_py()
                if text != last:
                    last, its = text, shingle_set(text, size)
                if similar(its, shingle_set(tb[k].as_py(), size), percent):
                    out.append(k)
            yield pa.record_batch([a.take(pa.array(out, pa.int64())), b.take(pa.array(out, pa.int64()))], ["a", "b"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked. Pairs are small and meet the texts first, so only the texts of pairs are shuffled, by ``a``, which many share."""
        pairs = scratch.stored(pairs, "pairs")
        of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(pairs.select("a").distinct(), "a", "left_semi")
        return pairs.join(of_b, "b").join(of_a.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")

    def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
        """``labels`` after ``links`` between nodes have joined their components."""
        of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(named.where("a != b").distinct(), scratch).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        return scratch.stored(labels.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "components")

    # An id with several texts links their sets.
    several = signed.where("`set` IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low != high").select("doc_id")
    same_id = signed.select("doc_id", "set").join(several, "doc_id").join(sets.select("set", "node"), "set").where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    same_id = scratch.stored(same_id, "same-id")
    labels = scratch.stored(mates.union(same_id.select("a")).union(same_id.select("b")).distinct().withColumn("component", F.col("node")), "components")
    if not same_id.isEmpty():
        labels = relabelled(labels, same_id)
    placed = bucket.withColumn("asked", F.lit(False)).join(labels, "node")
    for turn in range(turns + 1):
        # Open buckets: members that were no centre yet fall into several components; the largest of these is the main one.
        sizes = placed.where("NOT asked").groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        main = (
            sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("many"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("key", F.col("top.component").alias("main"), "many", (F.col("many") - F.col("top.n")).alias("few"))
        )
        if turn == turns:
            break
        if turn:
            left = main.agg(F.sum(F.col("few").cast("double") * F.col("many")).alias("pairs"), F.sum("many").alias("members")).first()
            if (left["pairs"] or 0) <= PAIRS_A_MEMBER * (left["members"] or 0):
                break
        unsettled = scratch.stored(placed.join(main, "key"), "open")
        may = ~F.col("asked") & (F.lit(turn == 0) | (F.col("component") != F.col("main")))
        first = unsettled.where(may).groupBy("key").agg(F.max(F.struct("mates", F.xxhash64("node").alias("rank"), F.col("node").alias("centre"), F.col("component").alias("its"))).alias("c")).select("key", "c.centre", "c.its")
        centred = scratch.stored(unsettled.join(first, "key").withColumn("asked", F.col("asked") | (F.col("node") == F.col("centre"))), "centred")
        spokes = centred.where("NOT asked AND component != its").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        links = scratch.stored(confirmed(spokes), "spokes")
        labels = relabelled(labels, links)
        placed = scratch.stored(centred.select("key", "node", "mates", "asked").join(labels, "node"), "placed")

    # What is still open, block by block. Members that have been centres are done with.
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    rows_of = placed.where("NOT asked").join(main, "key").withColumns({"outside": F.col("component") != F.col("main"), "q": blocks("few"), "m": blocks("many")})
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    columns = ("key", "node", "component", "outside")
    asking = rows_of.where("outside").select(*columns, F.lit(True).alias("asks"), deal("q").alias("q"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("m"))
    asked = rows_of.select(*columns, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("q"), deal("m").alias("m"))

    def compare(table: pa.Table) -> pa.Table:
        """The links of one block that join components: a pair is passed over if its components are joined by then."""
        asks, outside = table.column("asks").to_numpy(), table.column("outside").to_numpy()
        node, label = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        held = [shingle_set(x.as_py(), size) for x in table.column("text")]
        sizes = np.array([len(x) for x in held])
        found = []
        for i in np.flatnonzero(asks):
            # Two that are both outside meet in two blocks; the one in which the smaller asks will do.
            fits = np.minimum(sizes, sizes[i]) * 100 >= percent * np.maximum(sizes, sizes[i])
            others = np.flatnonzero(~asks & (label != label[i]) & fits & (~outside | (node > node[i])))
            if not len(others):
                continue
            flat, begins = np.concatenate([held[j] for j in others]), np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
            at = np.minimum(np.searchsorted(held[i], flat), len(held[i]) - 1)
            both = np.add.reduceat((held[i][at] == flat).astype(np.int64), begins)
            for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)]:
                if label[j] != label[i]:
                    found.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    rest = scratch.stored(asking.unionByName(asked), "blocks").join(texts, "node").select("key", "q", "m", "node", "component", "outside", "asks", "text")
    labels = relabelled(labels, scratch.stored(rest.groupBy("key", "q", "m").applyInArrow(compare, "a long, b long"), "links"))
    label = sets.select("set", "node").join(labels, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    return signed.select("doc_id", "n_shingles", "set").join(label, "set", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` linked at a similarity of 0.8 over shingles of two words."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
