"""Collocations against SQL and plain counting; hashing only thins out what is counted."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postgrove.llm import collocations, registry


def plain(rows: list[tuple], longest: int = 3, least: int = 10, top: int = 2000, percent: int = 50) -> set:
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(w[k : k + size])) for k in range(len(w) - size + 1))
    kept = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in kept.items():
        for size in range(2, len(w)):
            for k in range(len(w) - size + 1):
                key = (lang, w[k : k + size])
                inside[key] = max(a, inside.get(key, 0))
    out = {}
    for (lang, w), a in kept.items():
        if 100 * inside.get((lang, w), 0) >= percent * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, words[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    words = ["The", "cat", "é", "\x00", "\x1c", "x" * 300, "New", "york", "times", "of", "und", "-", "　", "b c"]
    ends = [" ", " ", " ", "\t ", ". ", "\n", ",", "\r\n", "?!"]
    rows = []
    for _ in range(400):
        text = "".join(draw.choice(["New York Times", draw.choice(words), draw.choice(words)]) + draw.choice(ends) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "en", "de", None, "und"]), draw.choice([text] * 9 + [None])))
    return rows + [("fr", "a " * 20_000), ("en", "")]


def said(df) -> set:
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 5, "top": 7}, {"longest": 2}, {"covered_percent": 90, "chunk_bytes": 500}])
def test_collocations_equal_plain_counting(spark, corpus, how):
    docs = spark.createDataFrame(corpus, "lang string, text string").withColumns({"n": F.lit("clash"), "my `odd`": F.lit(1)}).repartition(3)
    names = {"longest": "longest", "least": "least", "top": "top", "covered_percent": "percent"}
    want = plain(corpus, **{names[k]: v for k, v in how.items() if k in names})
    assert said(collocations.collocations(docs, **how)) == want and want


def test_full_buckets_and_early_sending_change_nothing(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "lang string, text string")
    monkeypatch.setattr(collocations, "HELD", 50)
    assert said(collocations.collocations(docs, chunk_bytes=2000, buckets=collocations.SLICE)) == plain(corpus)


def test_buckets_thin_out_what_is_counted(spark, corpus):
    """With the bitmaps fewer phrases are counted than stand in the texts, and every frequent one is."""
    docs = spark.createDataFrame(corpus, "lang string, text string")
    (one, two, three), words = collocations.frequent_phrases(docs, least=10)
    assert all(df.where("n < 10").count() == 0 and df.count() > 0 for df in (one, two, three))
    bits = collocations.bitmap(collocations.hashed_phrases(two, collocations.SLICE, 10), collocations.SLICE, 10)
    set_bits = int(sum(bin(b).count("1") for b in bits.tolist()))
    assert 0 < set_bits <= two.count() and dict(map(tuple, words.collect())) == {r[0]: r[6] for r in plain(corpus)}


def test_scores_are_exact_beyond_64_bits(spark):
    score = "CAST(a AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(18, 0)) * 1000000 div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    draw = random.Random(2)
    rows = [(a := draw.randint(1, 9 * 10**15), a + draw.randint(0, 10**15), a + draw.randint(0, 10**15)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{score} AS s").collect()
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([("en", None), (None, ""), ("en", "a b")], "lang string, text string")
    assert collocations.collocations(empty).count() == 0 and collocations.collocations(empty.where("lang = 'x'")).count() == 0


def test_buckets_are_summed_in_one_job(spark):
    """Summing one part of the buckets after another left most cores idle."""
    rows = spark.createDataFrame([("en", f"w{k} of") for k in range(2000)], "lang string, phrase string")
    buckets = 64 * collocations.SLICE
    slices = collocations.stored(collocations.hashed_phrases(rows, buckets, 10), "slices-of-a-test")
    context = spark.sparkContext
    context.setJobGroup("buckets-of-a-test", "")
    try:
        bits = collocations.bitmap(slices, buckets, 10)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert int(np.unpackbits(bits).sum()) > 1900
    assert len(context.statusTracker().getJobIdsForGroup("buckets-of-a-test")) <= 2


def test_words_are_numbered_in_order():
    raw = "The the\tTHE, é\x1cé \x00;; x\n\n. . the ".encode()
    names, numbers = collocations.numbered_words(raw)
    assert [names[k - 1].as_py() if k else None for k in numbers.tolist()] == ["the", "the", "the", None, "é\x1cé", "\x00", None, "x", None, "the", None]
    assert len(names) == 4 and all(len(collocations.numbered_words(x)[0]) == 0 for x in (b"", b" ", b"\n.,"))


@pytest.mark.parametrize("base", [20, 1 << 40])
def test_distinct_phrases_of_a_chunk(base):
    """Also where a phrase's numbers do not fit into one number."""
    draw = np.random.default_rng(4)
    chunk = object.__new__(collocations.Chunk)
    chunk.codes, chunk.words = draw.integers(0, 6, 500), range(base)
    chunk.fine = chunk.codes > 0
    for size in (1, 2, 3):
        at = np.flatnonzero(chunk.valid(size))
        numbers, n = chunk.distinct(at, size)
        want = Counter(tuple(chunk.codes[k : k + size].tolist()) for k in range(501 - size) if chunk.codes[k : k + size].all())
        assert dict(zip(zip(*(x.tolist() for x in numbers)), n.tolist())) == want


def test_hashes_hold_places_and_languages():
    words, langs = pa.array(["ab", "ba", "ab", "a" * 1000, "é", "ab"]), pa.array(["en", "en", "de", "en", "", "en"])
    each = collocations.hashes(langs, words)
    assert len(set(each.tolist())) == 5 and each[0] == each[5]
    assert (collocations.hashes(langs, words, step=1) == each).all() and (collocations.hashes(langs[2:], words[2:]) == each[2:]).all()


def test_op11_equals_sql(spark, sf_dir, same_as_sql):
    same_as_sql(registry.queries()["op11_collocations"](spark, sf_dir), collocations.SQL)
