"""Periodic runs of words, found by counting matches at every lag and scanning only lags with enough of them.

A run is a longest stretch of words with period q, q being its smallest period, that covers at least ``REPEATS`` periods and
``SHORTEST`` words. At lag q it is an island of at least need(q) = max(SHORTEST - q, (REPEATS - 1) q) consecutive places whose words match
those q further on, so a lag with fewer matches in all holds no run. The matches are counted exactly for all lags at once: words
that are frequent in a document by the autocorrelation of their places (fast Fourier transforms, summed before one inverse), all others by the
differences of pairs of their places. Lags are then taken upwards. A run of period d matches with itself at every multiple of d;
these matches are taken off the counts, and no other run of such a lag shares a match with it, since an overlap that long would give both the
period d. What is left to scan is sieved: an island of need(q) places holds a whole aligned block of half that length, so blocks
drop out at the first of some sampled places that does not match, and islands are read off around the blocks that remain.

A document is one row and stays in one task, so nothing is shuffled. Time and memory follow its length; the sampled places make the scans of a text without
periods cost about n log n comparisons.

Defined results: a null text counts as one without words; documents without words or runs have no runs and keep all their words; a null doc_id is carried along;
rows that repeat get equal results; a text of any length is searched whole; an empty table gives an empty one; columns beside doc_id and text are not
read and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postgrove.llm.common import read_table

SHORTEST, REPEATS = 24, 3
#: Sampled places of a block before its island is read.
SAMPLED = 32


class _Codes(dict):
    """Numbers for words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def lag_matches(words: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to ``most`` how many places match the one so far on (at lag 0: 0)."""
    n = len(words)
    places = np.argsort(words, kind="stable")
    of = words[places]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(starts, n))
    width = 1 << int(n + most).bit_length()
    # A pair costs one step, a transform some for each of its points and halvings.
    heavy = sizes * (sizes - 1.0) > width * np.log2(width) / 2
    found = np.zeros(most + 1, dtype=np.int64)
    if heavy.any():
        power = np.zeros(width // 2 + 1)
        for a, size in zip(starts[heavy].tolist(), sizes[heavy].tolist()):
            here = np.zeros(width)
            here[places[a : a + size]] = 1
            spectrum = np.fft.rfft(here)
            power += spectrum.real**2 + spectrum.imag**2
        # The transforms' error follows the square of the places; where it might reach a half, counts are bounds from above.
        slack = 4e-16 * np.log2(width) * (sizes[heavy].astype(float) ** 2).sum()
        found += np.floor(np.fft.irfft(power, width)[: most + 1] + 0.5 + slack).astype(np.int64)
    light = np.flatnonzero(~heavy & (sizes > 1))
    light = light[np.argsort(-sizes[light], kind="stable")]
    counts = sizes[light]
    spread = np.repeat(starts[light] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
    places, group = places[spread], np.repeat(np.arange(len(counts)), counts)
    for k in range(1, int(counts[0]) if len(counts) else 0):
        upto = int(counts[: np.searchsorted(-counts, -k)].sum())  # only words with more than k places
        places, group = places[:upto], group[:upto]
        lag = (places[k:] - places[:-k])[group[k:] == group[:-k]]
        lag = lag[lag <= most]
        found += np.bincount(lag, minlength=most + 1)
    found[0] = 0
    return found


def islands(words: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """The longest stretches [a, b) of at least ``need`` places that match those ``lag`` further on."""
    n = len(words) - lag
    block = (need + 1) // 2
    alive = np.arange(0, n - block + 1, block)
    step = max(1, block // SAMPLED)
    for k in range(0, block, step):
        alive = alive[words[alive + k] == words[alive + k + lag]]
        if not len(alive):
            return []
    # An island reaches less than a block over its first and last whole ones.
    low, high = np.maximum(alive - block, 0), np.minimum(alive + 2 * block, n)
    opens = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    found = []
    for a, b in zip(low[opens].tolist(), high[np.append(opens[1:], len(alive)) - 1].tolist()):
        same = np.zeros(b - a + 2, dtype=np.int8)
        same[1:-1] = words[a:b] == words[a + lag : b + lag]
        edge = np.flatnonzero(np.diff(same))
        found += [(a + x, a + y) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()) if y - x >= need]
    return found


def runs_of(words: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period."""
    n = len(words)
    most = n // repeats
    if n < shortest or most < 1:
        return []
    lags = np.arange(most + 1)
    needed = np.maximum(shortest - lags, (repeats - 1) * lags)
    matches = lag_matches(words, most)
    found: list[tuple[int, int, int]] = []
    for q in np.flatnonzero(matches >= needed).tolist():
        if not q or matches[q] < needed[q]:
            continue
        for a, b in islands(words, q, int(needed[q])):
            if any((words[a : b + q - d] == words[a + d : b + q]).all() for d in divisors(q)):
                continue
            found.append((a, b + q - a, q))
            self_matched = np.arange(q, min(most, b + q - a) + 1, q)
            matches[self_matched] -= b + q - a - self_matched
    return sorted(found, key=lambda r: (r[0], r[2]))


def divisors(q: int) -> list[int]:
    """The largest proper divisors of q: q over each of its primes."""
    out, left, p = [], q, 2
    while p * p <= left:
        if left % p == 0:
            out.append(q // p)
            while left % p == 0:
                left //= p
        p += 1
    return out + ([q // left] if left > 1 else [])


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, part_chars: int = 4_000_000, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of ``docs`` (doc_id, text); ``collapsed``: the words that no run repeats, joined by a space.
    ``prepare`` may give other words for a document before they are searched."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id: int | None, text: str) -> tuple[int, list[tuple[int, int, int]], str]:
            words = text.encode().split()
            words = prepare(doc_id, words) if prepare else words
            codes = _Codes()
            runs = runs_of(np.fromiter(map(codes.__getitem__, words), dtype=np.int32, count=len(words)))
            kept = compress(words, (~dropped(len(words), runs)).tolist()) if runs else words
            return len(words), runs, b" ".join(kept).decode()

        def rows(at: pa.Array, said: list[tuple]) -> pa.RecordBatch:
            flat = np.array([r for _, runs, _ in said for r in runs], dtype=np.int64).reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *(len(runs) for _, runs, _ in said)]), pa.int32())
            runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN)))
            return pa.record_batch([at, pa.array([n for n, _, _ in said], pa.int64()), runs, pa.array([t for *_, t in said], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            said, begin, held = [], 0, 0
            for k, (at, text) in enumerate(zip(*batch.columns)):
                said.append(row(at.as_py(), text.as_py() or ""))
                held += len(said[-1][2]) + 24 * len(said[-1][1])
                if held >= part_chars or k + 1 == batch.num_rows:
                    yield rows(batch.column(0).slice(begin, k + 1 - begin), said)
                    said, begin, held = [], k + 1, 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, RUNS)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by a checksum of the id, repeat a stretch of their own words from some word on. (The query's contract asks for these.)"""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all ``documents``, a tenth of which loop from some word on, and the digests of runs and kept words."""
    found = periodic_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=looped)
    # Comparing length / period by products keeps it exact; runs come by start and period, so the first of equals stays.
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda kept, r: F.when(kept.isNull() | (r["length"] * kept["period"] > kept["length"] * r["period"]), r).otherwise(kept))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
