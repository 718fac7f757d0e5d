"""Phrase collocations by hashed counting: while phrases of one length are counted exactly, those of the next are counted in buckets.

Texts become chunks once: distinct words of each language, and word numbers in order with a mark between pieces. Each pass then
reads the chunks. The pass of length s counts the phrases of s words that can still be frequent and adds the phrases of s + 1 words
to buckets by their hash. Two bitmaps of bounded size go to all tasks: the buckets of length s that reached the least count, and the phrases
of s - 1 words that are frequent, hashed. A phrase is counted when its own bucket is set and both phrases of one word less
inside it are frequent; hashing lets some rare ones through, never a frequent one out, and the exact counts, kept by the phrases' own texts,
decide. A phrase is put into a bucket only if both phrases of one word less in it are still counted themselves.

Buckets travel as sorted places and counts, merged in each task before, and are summed slice by slice in a stream. Counts are summed in every chunk and task before they are exchanged, so a
frequent word or phrase is one row per task. There are as many buckets as a quarter of the words, up to ``MOST_BUCKETS``.

Defined results: a null text counts as one without words, a null language as ``und``; rows that repeat count each; texts of any length are one part of a chunk and
are counted whole; an empty table gives no rows; columns beside lang and text are not read and may have any name. Scores are exact up to counts of 10^16.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from postgrove.llm.common import read_table, stored
from postgrove.llm.substrings import mix

CHUNK_BYTES = 8_000_000
#: Buckets of a slice; of all slices at least and at most.
SLICE, LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 16, 1 << 28
#: Bucket counts that a task holds before it sends them.
HELD = 2_000_000
# The characters that end a piece, those that part words; ASCII letters are lower-cased.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_KIND = bytes(2 if c in _ENDS else c in _BLANKS for c in range(256))


def numbered_words(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a text, and their numbers from 1 on in order; 0 is the end of a piece."""
    kind = np.frombuffer(raw.translate(_KIND), dtype=np.uint8)
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    letters = np.frombuffer(raw.translate(_LOWER), dtype=np.uint8)[word]
    offsets = np.append(0, np.cumsum(sizes)).astype("<i4")
    coded = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    ends = np.cumsum(kind == 2, dtype=np.int32)[starts]
    place = np.arange(len(starts)) + np.cumsum(np.diff(ends, prepend=ends[:1]) > 0)
    numbers = np.zeros(place[-1] + 2 if len(place) else 1, dtype="<i4")
    numbers[place] = coded.indices.to_numpy() + 1
    return coded.dictionary, numbers


#: Words of a chunk stand language by language. ``n_words`` and ``n_distinct`` are by language; ``sizes``, ``letters`` and ``codes`` are compressed.
CHUNKS = "langs array<string>, n_words array<long>, n_distinct array<long>, sizes binary, letters binary, codes binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (lang, text) as chunks, written once. Words without an end of a piece between them are neighbours."""

    def chunk(texts: dict[str, list[bytes]]) -> pa.RecordBatch:
        words, codes, known = [], [], 0
        for raw in texts.values():
            names, numbers = numbered_words(b"\n".join(raw))
            words.append(names)
            codes.append(np.where(numbers > 0, numbers + np.int32(known), np.int32(0)))
            known += len(names)
        pack = lambda array: zstandard.ZstdCompressor(level=1).compress(array)
        flat = pa.concat_arrays(words)
        sizes = np.diff(np.frombuffer(flat.buffers()[1], dtype="<i4")[: known + 1])
        row = (list(texts), [int((x > 0).sum()) for x in codes], [len(x) for x in words], pack(sizes.tobytes()), pack(flat.buffers()[2] or b""), pack(np.concatenate(codes).tobytes()))
        kinds = (pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3)
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds)], ["langs", "n_words", "n_distinct", "sizes", "letters", "codes"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                texts.setdefault(lang, []).append(text.as_py().encode())
                held += len(texts[lang][-1])
                if held >= chunk_bytes:
                    yield chunk(texts)
                    texts, held = {}, 0
        if texts:
            yield chunk(texts)

    return stored(docs.select(F.coalesce("lang", F.lit("und")), "text").mapInArrow(build, CHUNKS), "phrase-chunks")


class Chunk:
    """A chunk's words, their numbers in order, and hashes of words that hold the language too."""

    def __init__(self, row: dict):
        unpack = lambda name: zstandard.ZstdDecompressor().decompress(row[name].as_py())
        self.langs = row["langs"].values
        n_distinct = row["n_distinct"].values.to_numpy()
        self.lang_of = np.repeat(np.arange(len(n_distinct)), n_distinct)
        offsets = np.append(0, np.cumsum(np.frombuffer(unpack("sizes"), dtype="<i4"))).astype("<i4")
        self.words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(unpack("letters")))
        self.codes = np.frombuffer(unpack("codes"), dtype="<i4").astype(np.int64)
        self.fine = self.codes > 0
        self.hash = np.append(np.uint64(0), hashes(self.langs.take(pa.array(self.lang_of)), self.words))

    def valid(self, size: int) -> np.ndarray:
        """Where a phrase of ``size`` words starts."""
        n = max(0, len(self.codes) - size + 1)
        fine = self.fine[:n].copy()
        for k in range(1, size):
            fine &= self.fine[k : k + n]
        return fine

    def numbers(self, at: np.ndarray, size: int) -> list[np.ndarray]:
        """First words, second words and so on of the phrases at ``at``."""
        return [self.codes[at + k] for k in range(size)]

    def hashed(self, numbers: list[np.ndarray]) -> np.ndarray:
        """Hashes of phrases."""
        out = self.hash[numbers[0]]
        for x in numbers[1:]:
            out = mix(out, self.hash[x])
        return out

    def distinct(self, at: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct phrases among those at ``at``, by the numbers of their words, and how often each stands there."""
        base, numbers = len(self.words) + 1, self.numbers(at, size)
        if not len(at):
            return numbers, at
        if base**size >= 1 << 63:  # the numbers of a phrase do not fit into one
            number = numbers[0]
            for x in numbers[1:]:
                _, number = np.unique(number * base + x, return_inverse=True)
            _, first, count = np.unique(number, return_index=True, return_counts=True)
            return self.numbers(at[first], size), count
        key = numbers[0]
        for x in numbers[1:]:
            key = key * base + x
        key.sort()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count, key, out = np.diff(np.append(heads, len(key))), key[heads], []
        for _ in range(size - 1):
            key, last = np.divmod(key, base)
            out.append(last)
        return [key, *out[::-1]], count

    def phrases(self, numbers: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of phrases."""
        parts = [self.words.take(pa.array(x - 1)) for x in numbers]
        text = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        return self.langs.take(pa.array(self.lang_of[numbers[0] - 1])), text


def hashes(langs: pa.Array, words: pa.Array, step: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of words (none is empty) with their languages: sums over mixed letters and places, ``step`` bytes or a word at a time."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    coded = langs.dictionary_encode()
    of = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))[coded.indices.to_numpy()]
    ends = np.frombuffer(words.buffers()[1], dtype="<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters, out = np.frombuffer(words.buffers()[2], dtype=np.uint8), np.empty(len(words), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(ends[0], ends[-1], step)), len(words)))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        starts = ends[a:b] - ends[a]
        place = np.arange(ends[b] - ends[a]) - np.repeat(starts, np.diff(ends[a : b + 1]))
        out[a:b] = np.add.reduceat(mix((place << 8 | letters[ends[a] : ends[b]]).astype(np.uint64) + np.uint64(1)), starts)
    return mix(out, of)


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk({name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)})


class Buckets:
    """Counts by bucket, held as sorted places until they are sent by slices."""

    def __init__(self, buckets: int):
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self.parts, self.held = [], 0

    def add(self, hashed: np.ndarray, count: np.ndarray) -> bool:
        """Adds to the counts; true if it is time to send them."""
        self.parts.append(((hashed >> self.shift).astype(np.int64), count))
        self.held += len(hashed)
        return self.held >= HELD

    def send(self) -> Iterator[pa.RecordBatch]:
        place = np.concatenate([p for p, _ in self.parts]) if self.parts else np.zeros(0, dtype=np.int64)
        count = np.concatenate([c for _, c in self.parts]) if self.parts else place
        self.parts, self.held = [], 0
        if not len(place):
            return
        order = np.argsort(place, kind="stable")
        place, count = place[order], count[order]
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        # More than 255 is as good as 255: the least count is below.
        place, count = place[heads], np.minimum(np.add.reduceat(count, heads), 255).astype(np.uint8)
        cuts = np.flatnonzero(np.append(True, place[1:] // SLICE != place[:-1] // SLICE))
        low = (place % SLICE).astype("<u2")
        rows = [(int(place[a]) // SLICE, low[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(place)).tolist())]
        yield _rows(slices=rows)


PASS = "lang string, phrase string, n long, slice int, places binary, counts binary"
_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("slice", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])


def _rows(phrases: tuple = (), slices: list = ()) -> pa.RecordBatch:
    """Counts of phrases, or slices of buckets, as rows of one table."""
    n = len(slices) if slices else len(phrases[0])
    columns = [*phrases, *[None] * 3] if phrases else [*[None] * 3, *zip(*slices)]
    return pa.record_batch([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _PASS)], schema=_PASS)


def bitmap(rows: DataFrame, buckets: int, least: int) -> np.ndarray:
    """The buckets that reached ``least``, a bit for each: of fixed size, whatever the corpus."""
    slices = buckets // SLICE

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if k not in held:
                    held[k] = np.zeros(SLICE, dtype=np.int64)
                held[k][np.frombuffer(places.as_buffer(), dtype="<u2")] += np.frombuffer(counts.as_buffer(), dtype=np.uint8)
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in held.values()]
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    out = np.zeros(buckets // 8, dtype=np.uint8)
    sums = rows.select("slice", "places", "counts").repartition(max(1, min(slices, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "slice")
    # All parts are summed at once, in one job; a local iterator would sum one part after another. What comes back is MOST_BUCKETS bits at most.
    for r in sums.mapInArrow(fold, "slice int, bits binary").collect():
        at = r["slice"] * SLICE // 8
        out[at : at + SLICE // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def is_set(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    place = (hashed >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0


def hashed_phrases(frequent: DataFrame, buckets: int, least: int) -> DataFrame:
    """The frequent phrases as slices of buckets, each with the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Buckets(buckets)
        for batch in batches:
            langs, words = batch.column(0), pc.split_pattern(batch.column(1), " ")
            of = pa.array(np.repeat(np.arange(len(langs)), np.diff(np.asarray(words.offsets))))
            each, starts = hashes(langs.take(of), words.values), np.asarray(words.offsets)[:-1]
            size = len(each) // max(1, len(langs))
            out = each[starts]
            for k in range(1, size):
                out = mix(out, each[starts + k])
            if sums.add(out, np.full(len(out), least)):
                yield from sums.send()
        yield from sums.send()

    return frequent.select("lang", "phrase").mapInArrow(run, PASS)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """For each length up to ``longest`` the phrases of ``docs`` (lang, text) that stand at least ``least`` times (at most 255), as
    (lang, phrase, n); and (lang, n) with all words of each language."""
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = docs.sparkSession
    chunks = chunked(docs, chunk_bytes)
    words = stored(chunks.select(F.explode(F.arrays_zip("langs", "n_words")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.n_words").alias("n")).where("n > 0"), "words-by-language")
    total = words.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (total // 4).bit_length()))
    found, sent = [], None

    def counting(size: int, sent):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Buckets(buckets)
            shorter, own = sent.value if sent else (None, None)
            for c in chunks_of(batches):
                here = c.valid(size)
                if shorter is not None:
                    part = c.valid(size - 1)
                    if size == 2:
                        part &= np.append(False, is_set(shorter, c.hash[1:]))[c.codes]
                    else:
                        at = np.flatnonzero(part)
                        part[at] = is_set(shorter, c.hashed(c.numbers(at, size - 1)))
                    here &= part[:-1] & part[1:]
                    at = np.flatnonzero(here)
                    here[at] = is_set(own, c.hashed(c.numbers(at, size)))
                numbers, n = c.distinct(np.flatnonzero(here), size)
                if len(n):
                    yield _rows(phrases=(*c.phrases(numbers), n))
                if size < longest and len(here) > 1:
                    numbers, n = c.distinct(np.flatnonzero(here[:-1] & here[1:]), size + 1)
                    if sums.add(c.hashed(numbers), n):
                        yield from sums.send()
            yield from sums.send()

        return count

    for size in range(1, longest + 1):
        done = stored(chunks.mapInArrow(counting(size, sent), PASS), f"phrases-{size}")
        counts = done.where("slice IS NULL")
        found.append(stored(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"frequent-{size}"))
        if size < longest:
            bits = bitmap(hashed_phrases(found[-1], buckets, least), buckets, least), bitmap(done.where("slice IS NOT NULL"), buckets, least)
            sent = spark.sparkContext.broadcast(bits)
    return found, words


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered_percent: int = 50, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language by their lowest-scoring cut.

    A phrase goes if a longer one that holds its words has at least ``covered_percent`` of its count."""
    found, words = frequent_phrases(docs, longest, least, **how)
    known = found[0]
    for f in found[1:-1]:
        known = known.unionByName(f)
    candidates = found[1]
    for f in found[2:]:
        candidates = candidates.unionByName(f)
    split = candidates.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).withColumn("m", F.size("w"))
    cut = lambda begin, many: F.array_join(F.slice("w", begin, many), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    counted = lambda side, n: known.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    score = F.expr("CAST(a AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(18, 0)) * 1000000 div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = cuts.join(counted("left", "l"), ["lang", "left"]).join(counted("right", "r"), ["lang", "right"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (
        split.where("m > 2")
        .withColumn("many", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
        .withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("many") + 1)))
        .groupBy("lang", cut(F.col("begin"), F.col("many")).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language may hold any share of the phrases: the best of each of its parts first, then the best of these.
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))
    best = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of 2 to 3 words of each language of ``documents``."""
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
one AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(w) AS phrase FROM pieces) GROUP BY ALL),
two AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS phrase FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS phrase FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM one GROUP BY lang),
cuts AS (
    SELECT lang, phrase, n AS a, 1 AS k, split_part(phrase, ' ', 1) AS x, split_part(phrase, ' ', 2) AS y FROM two
    UNION ALL SELECT lang, phrase, n, 1, split_part(phrase, ' ', 1), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM three
    UNION ALL SELECT lang, phrase, n, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM three),
known AS (FROM one UNION ALL FROM two),
scored AS (
    SELECT c.*, p.n AS l, q.n AS r, (1000000::HUGEINT * a * a // (p.n::HUGEINT * q.n))::BIGINT AS score
    FROM cuts c JOIN known p ON p.lang = c.lang AND p.phrase = c.x JOIN known q ON q.lang = c.lang AND q.phrase = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, phrase, max(n) AS m FROM (
        SELECT lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, n FROM three
        UNION ALL SELECT lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), n FROM three) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, words.n, score
FROM lowest s JOIN words ON words.lang = s.lang LEFT JOIN longer b ON b.lang = s.lang AND b.phrase = s.phrase
WHERE b.m IS NULL OR 100 * b.m < 50 * a
QUALIFY rank <= 2000
"""
