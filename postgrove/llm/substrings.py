"""Removal of repeated passages, found by recompression.

Rounds name token runs and pairs: a maximal run of one symbol becomes a symbol, then every pair of a left and
a right symbol does; a symbol's side in a round is a bit of its own name. Names are fingerprints of
content, so they are global without being handed out, equal passages get the same symbols but for a few at
their borders, and a round is a narrow pass over a chunk of documents. Two Spark exchanges follow.

* Reveal: neighbouring high-level symbols are counted over the corpus. A passage that repeats shares all of
  them that lie well inside it, so a window with an unshared one inside cannot repeat. (After two rounds a window's border
  has disturbed at most BORDER words on each side; a window with a run or a period of two in it is always kept.)
* Verify: the remaining windows are compared by fingerprints of their words of 96 bits and more, and the first place
  (smallest document, then smallest start) of each is found.

Both exchanges move, for each chunk, the distinct fingerprints only, packed as arrays; the answer is one bit
for each. A passage that a third of the corpus holds is thus one entry per chunk, never a group of rows.

Defined results: a null text counts as one without words; rows without an id come after all others; rows with
the same id are one document, of which equal starts are no repeats of each other; texts shorter than a window
stay; words are parted by ASCII white space only and otherwise compared byte for byte; a text of any length is one part of a chunk;
an empty table gives an empty one; other columns of any type and name go along unchanged, but for n_words and n_removed, which give way to the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from postgrove.llm.common import quoted, read_table, stored

WINDOW = 20
ROUNDS, BORDER = 2, 6
CHUNK_BYTES = 4_000_000
LAST = np.iinfo(np.int64).max
_U = np.uint64


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A fingerprint of two names."""
    b = np.atleast_1d(np.asarray(b, dtype=_U))
    x = a * _U(0x9E3779B97F4A7C15) + (b ^ b >> _U(29)) * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ x >> _U(32)


def compress_round(symbol: np.ndarray, start: np.ndarray, doc: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: runs, then pairs. ``start`` is each symbol's first word, ``doc`` its document."""
    again = np.zeros(len(symbol), dtype=bool)
    again[1:] = (symbol[1:] == symbol[:-1]) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(~again)
    size = np.diff(np.append(head, len(symbol)))
    name = np.where(size > 1, mix(symbol[head], size), symbol[head])
    start, doc = start[head], doc[head]
    left = mix(name, step + 1) & _U(1) == 0
    pair = np.flatnonzero(left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])) if len(name) else np.zeros(0, dtype=np.int64)
    name[pair] = mix(name[pair], name[pair + 1])
    kept = np.ones(len(name), dtype=bool)
    kept[pair + 1] = False
    return name[kept], start[kept], doc[kept]


class Words:
    """A chunk's documents in order of id: words, their fingerprints, and what follows from them."""

    def __init__(self, ids: np.ndarray, blob: bytes, ends: np.ndarray):
        text = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
        order = np.lexsort((np.arange(len(ids)), ids))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.order, self.ids = order, ids[order]
        self.text, self.borders = text, list(zip(begins[order].tolist(), ends[order].tolist()))
        self.docs = [text[a:b].split() for a, b in self.borders]
        count = np.array([len(w) for w in self.docs], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)])
        n = int(self.first[-1])
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in self.docs for w in words), dtype=_U, count=n)
        self.doc = np.repeat(np.arange(len(count)), count)

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of neighbouring high-level symbols of one document, with their first word and the word after them."""
        name, start, doc = self.hash, np.arange(len(self.hash)), self.doc
        for step in range(ROUNDS):
            name, start, doc = compress_round(name, start, doc, step)
        end = np.append(start[1:], len(self.hash))
        both = np.flatnonzero(doc[1:] == doc[:-1])
        return mix(name[both], name[both + 1]), start[both], end[both + 1]

    def windows(self) -> np.ndarray:
        """All words at which a window starts."""
        n = len(self.hash) - WINDOW + 1
        return np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)

    def candidates(self, start: np.ndarray, end: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Windows with no unshared symbol well inside, and windows with a run or a period of two."""
        n, at = len(self.hash), self.windows()
        low, high = np.maximum(end[~shared] - WINDOW + BORDER, 0), start[~shared] - BORDER
        low, high = low[high >= low], high[high >= low]
        unshared = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1))
        h, odd = self.hash, np.zeros(n + 1, dtype=np.int64)
        odd[1 : n] += h[1:] == h[:-1]
        if n > 3:
            odd[1 : n - 2] += (h[2:-1] == h[:-3]) & (h[3:] == h[1:-2])
        odd = np.cumsum(odd)
        return at[(unshared[at] == 0) | (odd[at + WINDOW - 1] > odd[at])]

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit fingerprints of the windows at ``at``, from sums over powers of an odd base."""
        out = []
        for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
            power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(len(self.hash), base, dtype=_U)]))
            back = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(len(self.hash), pow(base, -1, 1 << 64), dtype=_U)]))
            total = np.concatenate([[_U(0)], np.cumsum(self.hash * power[:-1], dtype=_U)])
            out.append(mix((total[at + WINDOW] - total[at]) * back[at], base & 0xFFFF))
        return out[0], out[1]


def dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each 64-bit fingerprint and 32 bits of it that are independent of the bucket."""
    return (key % _U(buckets)).astype(np.int64), (key // _U(buckets) & _U(0xFFFFFFFF)).astype(np.uint32)


def distinct_keys(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, low) of ``key``, sorted; which of them occur more than once; and where each key is among them."""
    bucket, low = dealt(key, buckets)
    packed, inverse, count = np.unique(bucket.astype(_U) << _U(32) | low, return_inverse=True, return_counts=True)
    return (packed >> _U(32)).astype(np.int64), (packed & _U(0xFFFFFFFF)).astype(np.uint32), count > 1, inverse


def slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of a sorted array of buckets."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(bucket)).tolist()):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` as chunks of about ``chunk_bytes``, compressed and written once: every later pass sees the same chunks. All columns but the text go along as they are, the id as ``_pg_id``."""
    along_of = F.struct(F.col("doc_id").alias("_pg_id"), *[F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, made = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3), 0
        ids, texts, along, held = [], [], [], 0  # along: stretches of the column

        def chunk() -> pa.RecordBatch:
            nonlocal made, ids, texts, along, held
            ends = np.cumsum([len(x) for x in texts])
            words = sum(x.count(b" ") + x.count(b"\n") + 1 for x in texts)
            row = pa.record_batch([pa.array([part << 32 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(texts))], pa.binary()), pa.array([ends], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(along)), pa.array([words], pa.int64())], ["chunk", "ids", "blob", "ends", "along", "n_words"])
            made, ids, texts, along, held = made + 1, [], [], [], 0
            return row

        for batch in batches:
            taken = 0
            for k, (i, t) in enumerate(zip(batch.column(0), batch.column(1))):
                ids.append(i.as_py() if i.is_valid else int(LAST))
                texts.append((t.as_py() or "").encode())
                held += len(texts[-1])
                if held >= chunk_bytes:
                    along.append(batch.column(2).slice(taken, k + 1 - taken))
                    taken = k + 1
                    yield chunk()
            if taken < batch.num_rows:
                along.append(batch.column(2).slice(taken))
        if ids:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long"), "text", along_of.alias("along"))
    kinds = [("chunk", LongType()), ("ids", ArrayType(LongType())), ("blob", BinaryType()), ("ends", ArrayType(LongType())), ("along", ArrayType(rows.schema["along"].dataType)), ("n_words", LongType())]
    return stored(rows.mapInArrow(build, StructType([StructField(*k) for k in kinds])), "chunks")


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Words, dict[str, list]]]:
    """Each chunk with its words and the answers that were joined to it."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
            words = Words(row["ids"].values.to_numpy(), row["blob"].as_py(), row["ends"].values.to_numpy())
            yield row["chunk"].as_py(), words, {name: row[name].as_py() or [] for name in batch.schema.names if name.startswith("said_")} | {"along": row.get("along")}


def answers(said: list[dict], bucket: np.ndarray) -> np.ndarray:
    """The bits of all buckets, in the order of the sorted ``bucket`` array that was asked about."""
    by = {x["bucket"]: x["bits"] for x in said}
    out = np.zeros(len(bucket), dtype=bool)
    for b, part in slices(bucket):
        out[part] = np.unpackbits(np.frombuffer(by[b], dtype=np.uint8), count=part.stop - part.start).astype(bool)
    return out


def asked(chunks: DataFrame, ask: Callable, judge: Callable, name: str) -> DataFrame:
    """Per chunk: ``ask(words, said)`` gives sorted buckets and arrays of bytes per entry; the rows of a bucket meet in
    ``judge``, which gives a bit for each entry; the answers of a chunk come back as one row (chunk, said_``name``)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, said in chunks_of(batches):
            bucket, entries = ask(words, said)
            rows = [(b, chunk, entries[part].tobytes()) for b, part in slices(bucket)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["bucket", "chunk", "entries"])

    def meet(table: pa.Table) -> pa.Table:
        bits = judge([np.frombuffer(x.as_py(), dtype=np.uint8) for x in table.column("entries")])
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], ["bucket", "chunk", "bits"])

    bits = chunks.mapInArrow(send, "bucket long, chunk long, entries binary").groupBy("bucket").applyInArrow(meet, "bucket long, chunk long, bits binary")
    return stored(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"said_{name}")), f"said-{name}")


_ENTRY = np.dtype([("low", "<u4"), ("second", "<u8"), ("doc", "<i8"), ("start", "<u4")])


def deduplicated(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, as_words: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and, as text, the kept words joined by one space. A text of which nothing goes stays as
    it is, unless ``as_words``. Input columns named n_words or n_removed give way."""
    docs = docs.drop("n_words", "n_removed")
    chunks = chunked(docs, chunk_bytes)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, total // 3_000_000)

    def ask_symbols(words: Words, said: dict) -> tuple[np.ndarray, np.ndarray]:
        bucket, low, _, _ = distinct_keys(words.symbols()[0], buckets)
        return bucket, low

    def judge_symbols(entries: list[np.ndarray]) -> list[np.ndarray]:
        keys = [e.view("<u4") for e in entries]
        _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        return np.split(count[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])

    def candidate_groups(words: Words, said: dict):
        """The candidate windows in order of fingerprint and place; which of them open a group of equals; bucket and entry of each group."""
        key, start, end = words.symbols()
        bucket, _, twice, inverse = distinct_keys(key, buckets)
        shared = (answers(said["said_symbols"], bucket) | twice)[inverse] if len(key) else np.zeros(0, dtype=bool)
        at = words.candidates(start, end, shared)
        one, two = words.fingerprints(at)
        bucket, low = dealt(one, buckets)
        order = np.lexsort((at, two, low, bucket))
        at, two, bucket, low = at[order], two[order], bucket[order], low[order]
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (two[1:] != two[:-1])
        entry = np.zeros(int(opens.sum()), dtype=_ENTRY)
        doc = words.doc[at]
        entry["low"], entry["second"], entry["doc"], entry["start"] = low[opens], two[opens], words.ids[doc[opens]], (at - words.first[doc])[opens]
        return at, opens, bucket[opens], entry

    def ask_windows(words: Words, said: dict) -> tuple[np.ndarray, np.ndarray]:
        _, _, bucket, entry = candidate_groups(words, said)
        return bucket, entry

    def judge_windows(entries: list[np.ndarray]) -> list[np.ndarray]:
        x = np.concatenate([e.view(_ENTRY) for e in entries])
        order = np.lexsort((x["start"], x["doc"], x["second"], x["low"]))
        y = x[order]
        opens = np.ones(len(y), dtype=bool)
        opens[1:] = (y["low"][1:] != y["low"][:-1]) | (y["second"][1:] != y["second"][:-1])
        first = np.maximum.accumulate(np.where(opens, np.arange(len(y)), 0))
        bit = np.zeros(len(x), dtype=bool)
        bit[order] = (y["doc"] != y["doc"][first]) | (y["start"] != y["start"][first])
        return np.split(bit, np.cumsum([len(e) // _ENTRY.itemsize for e in entries])[:-1])

    symbols = asked(chunks.drop("along"), ask_symbols, judge_symbols, "symbols")
    known = chunks.join(symbols, "chunk", "left")
    windows = asked(known.drop("along"), ask_windows, judge_windows, "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, said in chunks_of(batches):
            at, opens, bucket, entry = candidate_groups(words, said)
            group, place = np.cumsum(opens) - 1, at - words.first[words.doc[at]]
            later = (words.ids[words.doc[at]] != entry["doc"][group]) | (place != entry["start"][group]) if len(at) else np.zeros(0, dtype=bool)
            gone = at[later | answers(said["said_windows"], bucket)[group]] if len(at) else at
            n = len(words.hash)
            removed = np.cumsum(np.bincount(gone, minlength=n + 1) - np.bincount(gone + WINDOW, minlength=n + 1))[:n] > 0 if n else np.zeros(0, dtype=bool)
            rows = []
            for k, of in enumerate(words.docs):
                lost = removed[words.first[k] : words.first[k + 1]]
                n_lost = int(lost.sum())
                whole = words.text[slice(*words.borders[k])]
                kept = b" ".join(compress(of, (~lost).tolist())) if n_lost else b" ".join(of) if as_words else whole
                rows.append((kept.decode(), len(of), n_lost))
            kinds = (pa.string(), pa.int64(), pa.int64())
            along = said["along"].values.take(pa.array(words.order))
            yield pa.record_batch([*[pa.array(c, t) for c, t in zip(zip(*rows), kinds)], along], ["text", "n_words", "n_removed", "along"])

    kinds = [("text", StringType()), ("n_words", LongType()), ("n_removed", LongType()), ("along", chunks.schema["along"].dataType.elementType)]
    cleaned = known.join(windows, "chunk", "left").mapInArrow(cut, StructType([StructField(*k) for k in kinds]))
    back = {"text": F.col("text")} | {c: F.col("along")["_pg_id" if c == "doc_id" else c] for c in docs.columns if c != "text"}
    return cleaned.select(*[back[c].alias(c) for c in docs.columns], "n_words", "n_removed")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of WINDOW words and more that stand earlier in ``documents`` are removed."""
    return deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), as_words=True).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
windows AS (
    SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS said,
        count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM words),
judged AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) > 1 AS again FROM windows WHERE n = 20),
covered AS (
    SELECT w.doc_id, w.i, w.w, coalesce(bool_or(j.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
    FROM words w LEFT JOIN judged j USING (doc_id, i)),
byd AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN byd USING (doc_id)
"""
