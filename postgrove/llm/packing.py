"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Tokenising gives one row per piece. The lengths' histogram (at most ``capacity`` rows, whatever the
corpus) goes to the driver, where the configuration linear program over it - one variable per way to
fill a sequence - is solved by multiplicative weights: each round prices the lengths, a knapsack dynamic
program finds for every length the best filling that holds it, and the lengths that have been covered
least gain weight. The fractional solution is rounded down to whole sequences and what is left of the
histogram goes in by best fit, again by whole classes of equal sequences. The plan's size depends on the
capacity alone; the pieces then find their places by their rank among the pieces of equal length.

Defined results: a null text counts as an empty one, and an empty text still has its end token; rows that
repeat are packed each; a null doc_id is carried along; extra columns of the input are left out and may have any name; a text of any length is encoded whole and cut into pieces; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from postgrove.llm.common import read_table, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Where a space touches white space on both sides, or ends the text after some: there the vocabulary's
#: pattern may join what a cut before each space would part.
RUNS = re.compile(r"\s (?:\s|\Z)")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file with their ids; the library cuts texts at them before anything else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that take in white space or stand only as words are not supported")
    return {t["content"]: t["id"] for t in found}


class Encoder:
    """Byte-level BPE of whole texts with a bounded memory of the segments seen.

    A text is cut before each space; the vocabulary's pattern never joins across such a cut (texts with runs
    of white space are encoded in one go), so a segment always has the same ids. A text that holds an added
    token is cut at it; the token has its own id and what stands between is encoded as texts. These are the ids
    that the ``tokenizers`` library gives for the JSON file of the same vocabulary; the tests compare both.
    """

    def __init__(self, ranks_path: str, pattern: str, end: int, remember: int = 500_000, added: dict[str, int] | None = None):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end, self.remember, self.seen, self.added = end, remember, {}, added or {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def segment(self, text: str) -> np.ndarray:
        ids = self.seen.get(text)
        if ids is None:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            ids = self.seen[text] = np.array(self.encode(text), dtype="<u4").tobytes()
        return ids

    def in_one_go(self, text: str) -> bytes:
        """The ids of a whole text, added tokens among them."""
        parts = self.cuts.split(text) if self.cuts else [text]
        ids = [x for k, part in enumerate(parts) for x in ([self.added[part]] if k % 2 else self.encode(part))]
        return np.array(ids, dtype="<u4").tobytes()

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each document closed by the end token; the documents' borders."""
        n, whole = len(texts), [bool(RUNS.search(t) or self.cuts and self.cuts.search(t)) for t in texts]
        parts = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), " ")
        first = np.asarray(parts.offsets)[:-1]
        count = np.diff(np.asarray(parts.offsets))
        coded = parts.values.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        names = coded.dictionary.to_pylist()
        heads = parts.values.take(pa.array(first)).to_pylist()
        blobs = [self.segment(" " + x) for x in names]
        blobs += [self.in_one_go(t) if w else self.segment(h) for t, w, h in zip(texts, whole, heads)]
        blobs.append(np.array([self.end], dtype="<u4").tobytes())
        codes[first] = len(names) + np.arange(n)
        of = np.repeat(np.arange(n), count)
        spread = np.full(len(codes) + n, len(blobs) - 1)
        spread[np.arange(len(codes)) + of] = codes
        sizes = np.array([len(b) // 4 for b in blobs])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pool, lengths = np.frombuffer(b"".join(blobs), dtype="<u4"), sizes[spread]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(begins[spread] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.concatenate([[0], ends[np.cumsum(count + 1) - 1]]) if n else np.zeros(1, dtype=np.int64)
        return ids, borders


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, ranks: str | None = None, end: int = 2, batch_chars: int = 2_000_000, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text). Only documents over ``capacity`` are cut; then all pieces but the first are full.
    ``added``: the added tokens, those of the vocabulary's JSON file if not given."""
    import public_tokenizers

    tokens = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if added is None else added

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end, added=tokens)

        def rows(ids_of: list, texts: list) -> pa.RecordBatch:
            ids, borders = encoder.documents(texts)
            total = np.diff(borders)
            n = -(-total // capacity)
            first = total - (n - 1) * capacity
            of = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[of], capacity)
            raw, at = memoryview(np.ascontiguousarray(ids).view(np.uint8)), (borders[of] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            return pa.record_batch([pa.array(ids_of, pa.int64()).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            ids_of, texts, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids_of.append(i)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= batch_chars:
                    yield rows(ids_of, texts)
                    ids_of, texts, held = [], [], 0
            if texts:
                yield rows(ids_of, texts)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


# ---- the configuration linear program, over the histogram only


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most that a filling of at most c is worth; take[c]: a length in it (0: none). values[l]: of length l, 0 unused."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        worth = values[1 : c + 1] + best[c - 1 :: -1]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] and values[k + 1] > 0:
            best[c], take[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, take


def filling(take: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if take[room]:
            out.append(int(take[room]))
            room -= out[-1]
        else:
            room -= 1
    return out


def fractional(histogram: dict[int, int], capacity: int, rounds: int = 60, step: float = 0.1, rate: float = 1.0) -> tuple[dict[tuple[int, ...], float], float]:
    """Multiplicative weights on the configuration program: fillings with their fractional numbers, which
    cover no length more than once, and the best lower bound on the number of sequences that the prices prove.

    A round covers at most ``step`` more of each length, by the fillings whose price is near the best; a
    length's weight falls as the exponential of how far it is covered."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths.tolist()], dtype=float)
    at = {int(x): k for k, x in enumerate(lengths)}
    covered, x, bound = np.zeros(len(lengths)), {}, 0.0
    for _ in range(rounds):
        price = lengths / capacity * np.exp(-rate * (covered - covered.min()))
        values = np.zeros(capacity + 1)
        values[lengths] = np.where(covered < 1 - 1e-9, price, 0)
        best, take = knapsack(values, capacity)
        if not best[capacity]:
            break
        bound = max(bound, float((need * values[lengths]).sum() / best[capacity]))
        budget = np.minimum(step, 1 - covered) * need
        for k in np.argsort(-(values[lengths] + best[capacity - lengths]), kind="stable").tolist():
            if budget[k] <= 0:
                continue
            held = Counter([int(lengths[k]), *filling(take, capacity - int(lengths[k]))])
            if capacity - sum(held.elements()) > capacity // 64 and covered.mean() < 0.9:
                continue
            much = min(budget[at[y]] / c for y, c in held.items())
            if much > 0:
                lay = tuple(sorted(held.elements(), reverse=True))
                x[lay] = x.get(lay, 0.0) + much
                for y, c in held.items():
                    budget[at[y]] -= c * much
                    covered[at[y]] += c * much / need[at[y]]
    return x, bound


def rounded(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Whole sequences: the fractional numbers rounded down, and what is left by best fit; also the proven lower bound."""
    if not histogram:
        return [], 0.0
    x, bound = fractional(histogram, capacity)
    left = dict(histogram)
    plan = [(lay, int(much)) for lay, much in sorted(x.items()) if much >= 1]
    for lay, n in plan:
        for y in lay:
            left[y] -= n
    return plan + best_fit(left, capacity), bound


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room; equal sequences are filled as one class."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    for y in sorted((k for k, n in histogram.items() if n), reverse=True):
        n = histogram[y]
        while n:
            room = min((r for r, held in open_by_room.items() if r >= y and held), default=None)
            if room is None:
                room, lay, many = capacity, (), n
            else:
                lay, many = next(iter(open_by_room[room].items()))
            each = min(room // y, max(1, n // max(1, many)))
            used = min(many, n // each) if lay else n // each
            if not lay:  # new sequences hold as many as fit; a last one holds the rest
                each = min(room // y, n)
                used = n // each
            else:
                del open_by_room[room][lay]
                if many > used:
                    open_by_room[room][lay] = many - used
            held = open_by_room.setdefault(room - each * y, {})
            held[lay + (y,) * each] = held.get(lay + (y,) * each, 0) + used
            n -= used * each
    return [p for held in open_by_room.values() for p in held.items()]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For pieces of a length by rank: from which rank on they go to which sequences and at what offset."""
    rows, base, used = [], 0, {}
    for lay, n in plan:
        offset = 0
        for y in lay:
            rows.append((y, used.get(y, 0), base, offset))
            used[y] = used.get(y, 0) + n
            offset += y
        base += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T))


def pack(docs: DataFrame, capacity: int = 1024, **how) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, capacity, **how), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(rounded(histogram, capacity)[0])
    key = table["length"] << 44 | table["rank"]

    # A length may hold a third of all pieces: they are ranked in buckets, and buckets follow each other.
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    inside = dealt.withColumn("n", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("many"))
        .select("length", "bucket", (F.sum("many").over(Window.partitionBy("length").orderBy("bucket")) - F.col("many")).alias("before"))
    )
    ranked = inside.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, length << 44 | rank, side="right") - 1
            sequence = table["sequence"][k] + rank - table["rank"][k]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][k])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
