"""Periodic runs against a plain search of every lag."""

from __future__ import annotations

import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from brute import SPACE, sha  # noqa: E402

from postgrove.llm import periodic, registry  # noqa: E402
from postgrove.session import read_table  # noqa: E402


def plain_runs(words: list, shortest: int = 24, repeats: int = 3) -> list[tuple[int, int, int]]:
    """Every stretch with a period, extended word by word; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, repeats * q):
                best.setdefault((i, length), q)
            i = j + 1
    return sorted((i, length, q) for (i, length), q in best.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 6, 40])
def test_random_words_with_planted_repeats(letters):
    draw = random.Random(letters)
    for turn in range(60):
        words = [draw.randrange(letters) for _ in range(draw.randint(0, 150))]
        for _ in range(draw.randint(0, 4)):
            part = [draw.randrange(letters) for _ in range(draw.randint(1, 30))]
            cut = (part * 9)[: draw.randint(1, 120)]
            at = draw.randint(0, len(words))
            words[at:at] = cut + (cut[::-1] if turn % 3 == 0 else [])
        codes = np.array(words, dtype=np.int32)
        assert periodic.runs_of(codes) == plain_runs(words)
        assert periodic.runs_of(codes, 4, 2) == plain_runs(words, 4, 2)


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_counts_of_matches_are_exact_for_frequent_and_rare_words(letters):
    draw = np.random.Generator(np.random.PCG64(letters))
    words = (draw.random(5000) ** 3 * letters).astype(np.int32)
    got = periodic.lag_matches(words, 1600)
    assert got.tolist() == [0] + [int((words[q:] == words[:-q]).sum()) for q in range(1, 1601)]


def test_long_texts_take_a_moment():
    """One word throughout, two words at random, a long period with faults, and no period at all."""
    draw = np.random.Generator(np.random.PCG64(1))
    n = 200_000
    same = np.zeros(n, dtype=np.int32)
    assert periodic.runs_of(same) == [(0, n, 1)]
    loop = np.tile(draw.integers(0, 1000, 50_001, dtype=np.int32), 4)
    assert periodic.runs_of(loop) == [(0, len(loop), 50_001)]
    loop[100_000] = -1
    assert periodic.runs_of(loop) == []
    assert periodic.runs_of(draw.integers(0, 1000, n, dtype=np.int32)) == []
    two = draw.integers(0, 2, 20_000, dtype=np.int32)
    two[5000:5400] = np.tile([0, 1, 1, 0, 1], 80)
    assert any(p == 5 and m >= 400 for _, m, p in periodic.runs_of(two))


def plain_row(doc_id: int, text: str | None) -> tuple:
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_on_all_documents(spark, sf_dir):
    want = {plain_row(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()}
    got = registry.queries()["op12_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want and any(r[1] for r in want)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "x y " * 12), (3, " \n"), (4, "a b\tc d " * 60_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "my `odd`": F.lit(1)})
    got = sorted(((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(rows, part_chars=10).collect()), key=str)
    want = [("1", 0, [], ""), ("2", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 180_000, [(0, 180_000, 3)], "a b c d"), ("None", 24, [(0, 24, 2)], "x y")]
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(rows.where("doc_id < 0")).count() == 0 and not re.search("Exchange", periodic.periodic_runs(rows)._jdf.queryExecution().toString())
