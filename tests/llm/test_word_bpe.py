"""BPE by speculation against the tokenizers library, and its checks of pairs against exact merging."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from brute import sha  # noqa: E402

from postgrove.llm import registry  # noqa: E402
from postgrove.llm.word_bpe import LONG, Coder, Vocabulary, decode, encode  # noqa: E402
from postgrove.session import read_table  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "er", "the", "'s", "'", "1", "23", "!", "...", "é", "É", "ß", "漢", "한", "ᄀ", "ᅡ", "क", '\u093e', '\u0301', '\x1c', '\x85', " ", '\n', '\u3000', '\U0001f600', "<|endoftext|>", "<|startoftext|>", "<|", "</w>", "İ", "Σ", '\xb2', '\u2167', '\u1c89', '\x00', '\ufffd', "ň"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def same(coder: Coder, library: Tokenizer, texts: list[str]) -> None:
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, dtype="<i4").tolist() for b in coder.encode(texts)] == want


def test_random_texts_have_the_ids_of_the_library(vocabulary, library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(ODD, k=draw.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(draw.choices("abcdeinorst", k=draw.randint(1, 90))) for _ in range(3000)]
    texts += ["a" * k for k in range(1, 150)] + ["ab" * 4000, "x" * (LONG + 1)]
    same(Coder(vocabulary), library, texts)
    same(Coder(vocabulary, remember=10), library, texts[:50] + texts[:50])


def test_every_character_has_the_ids_of_the_library(vocabulary, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(Coder(vocabulary), library, ["a" + "1".join(chars[k : k + 64]) for k in range(0, len(chars), 64)])


def test_a_pair_is_compatible_when_merging_leaves_its_border(vocabulary):
    v, draw = vocabulary, random.Random(5)
    inner, last = sorted(v.inner, key=v.inner.get), sorted(v.last, key=v.last.get)
    pairs = [(draw.choice(inner), draw.choice(last)) for _ in range(3000)] + [(a, b) for a in ("a", "aa", "aaa", "aaaa") for b in ("a", "aa", "aaa", "aaaa") if a in v.inner and b in v.last]
    fine = v.compatible(np.array([v.inner[a] for a, _ in pairs]), np.array([v.last[b] for _, b in pairs]))
    want = [v.merged_long(a + b) == [v.inner[a], v.last[b]] for a, b in pairs]
    assert fine.tolist() == want and 0 < sum(want) < len(want)
    words = [a + b for a, b in pairs]
    assert v.merged(words) == [v.merged_long(w) for w in words]


def test_op13_on_all_documents(spark, sf_dir, library):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = registry.queries()["op13_word_bpe"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and [tuple(r) for r in got.collect()] and {tuple(r) for r in got.collect()} == want


def test_odd_rows(spark, library):
    texts = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "Sälze <|endoftext|> " * 40_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "my `odd`": F.lit(1)})
    got = decode(encode(rows, part_chars=1000), part_ids=1000).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]), r["text"]) for r in got) == sorted((str(i), len(x := library.encode(t or "", add_special_tokens=False).ids), library.decode(x, skip_special_tokens=False)) for i, t in texts)
    assert decode(encode(rows.where("doc_id < 0"))).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [None, -5, 49407, 10**6, 320])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode(ids).collect()} == {1: "", 2: library.decode([49407, 320], skip_special_tokens=False)}
