"""Vectors, media, notices, chats and pieces: recall, exact round trips and plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from postgrove.llm import ann, chat, licenses, media, registry, sentencepiece
from postgrove.session import read_table


def brute_nearest(rows, k=10, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = sorted((dd, j) for dd, j in zip(d.tolist(), ids.tolist()) if j != i)[:k]
            out[int(i)] = [(j, dd) for dd, j in order]
    return out


@pytest.mark.parametrize("per_shard,block", [(4096, 1024), (500, 16)])
def test_recall_of_nearest_neighbours(spark, per_shard, block):
    """Against brute force over the 2 000 vectors of sf0.1, in one shard and one part and in several of both."""
    rows = read_table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    found = ann.nearest(rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), ann.index(rows, rows_per_shard=per_shard), block=block).orderBy("query_id", "rank").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    assert all(abs(d - dict(want[q])[j]) < 1e-9 for q in want for j, d in got[q] if j in dict(want[q]))


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in read_table(spark, sf, "embeddings").collect()], every=100)
    found = registry.queries()["op1_nearest_neighbours"](spark, sf).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(q, k) for q in sorted(want) for k in range(1, 11)]
    hits = sum(r["vec_id"] in {j for j, _ in want[r["query_id"]]} for r in found)
    assert hits / len(found) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0])] + [(k, [1.0, 0.0]) for k in range(20, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(ask, ann.index(df)).orderBy("rank").collect()]
    assert got == [(k + 1, v, 0.0) for k, v in enumerate([7, *range(20, 29)])]
    few = df.where("vec_id IN (0, 8)")
    assert [tuple(r) for r in ann.nearest(ask, ann.index(few)).collect()] == [(0, 1, 8, 1.0)]
    assert ann.nearest(ask.where("query_id < 0"), ann.index(df.where("vec_id < 0"))).count() == 0


def test_media_digests(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in read_table(spark, sf_dir, "documents").collect()}
    for r in registry.queries()["op4_media_columns"](spark, sf_dir).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert f"frames {len(payload) // 576}," in r["feature"] and r["media_bytes"] > len(payload)


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_payload_round_trip(raw):
    payload = media.payload_of(raw)
    stream = media.write_stream(payload, len(raw))
    seen = media.Stream(stream, {}, {}).summary()
    assert media.read_payload(stream, seen["frame_offsets"]) == payload
    assert seen["crc_bad"] == seen["skipped_bytes"] == 0 and seen["n_samples"] == len(payload) and dict(seen["tags"])["payload_bytes"] == str(len(raw))


def test_resynchronisation(spark):
    """Junk before, between and after frames is skipped; a broken checksum is counted; null and noise have defined results."""
    a = media.write_stream(media.payload_of(b"abc" * 600), 1800)
    frames = [a[k : k + media.FRAME] for k in range(len(a) - 5 * media.FRAME, len(a), media.FRAME)]
    bad = bytearray(frames[2])
    bad[4] ^= 1
    junk = b"\xff\x00noise\xff\xfb"
    stream = junk + frames[1] + frames[1] + b"xx" + frames[1] + bytes(bad) + frames[1] + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    df = media.index_media(spark.createDataFrame([(1, bytearray(stream)), (2, None), (3, bytearray(b"no audio")), (4, bytearray())], "id int, media binary"))
    got = {r["id"]: r["media_index"] for r in df.collect()}
    assert got[1]["n_frames"] == 5 and got[1]["crc_bad"] == 1 and got[1]["crc_good"] == 4 and got[1]["skipped_bytes"] == len(junk) + 2 and got[1]["tags"]["TIT2"] == "Song"
    assert got[1]["duration"] == "9/50" and got[2] is None and got[3]["n_frames"] == 0 and got[3]["duration"] is None and got[4]["n_frames"] == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    every = [x for held in at.values() for x in held]
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, v in at.items() if v))


def test_license_base_places(spark, sf_dir):
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "CC-BY cc.by, CC  BY"), (-4, "General Public License all rights reserved, general public licenses"), (-5, "ccby"), (-6, "É cc by")], "doc_id long, text string")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_notices_with_edits_are_found(spark):
    said = "x y relased under the MIT licence. z"
    other = "released under a mitten licence"
    rows = licenses.scan(spark.createDataFrame([(1, said), (2, other), (3, "nothing at all")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0]["labels"] == "mit" and [(s["start"], s["end"]) for s in rows[0]["spans"]] == [(2, 7)] and 0.8 < rows[0]["score"] < 1
    assert rows[2]["labels"] == "" and rows[2]["score"] == 0


@given(st.integers(0, len(licenses.NOTICES) - 1), st.lists(st.tuples(st.integers(0, 200), st.sampled_from("idr"), st.sampled_from("abcxyz")), max_size=3))
@settings(max_examples=80, deadline=None)
def test_every_notice_within_its_errors_is_found(k, edits):
    label, notice = list(licenses.NOTICES.items())[k]
    errors = min(licenses.MOST_EDITS, max(1, len(notice) // licenses.CHARS_AN_EDIT))
    text = notice
    for at, kind, c in edits[:errors]:
        at %= len(text)
        text = text[:at] + {"i": c, "d": "", "r": c}[kind] + text[at + (kind != "i") :]
    assert label in {f[2] for f in licenses.Searcher(licenses.NOTICES).find(f"some words {text} other words")}


@given(st.sampled_from(["user", "assistant", "system", "tool", "", "a] b", "[INST]"]), st.text(st.sampled_from("ab\\[]<>/IsNST=lbrSY \n"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_turns_read_back(role, text):
    said = chat.format_turn(role, text)
    assert chat.read_turn(said) == (role, text)
    body = chat.escape(text)
    assert not any(c in body for c in chat.CONTROLS)


def test_layouts_become_canonical_turns(spark):
    records = [
        {"role": "user", "text": "a"}, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"prompt": "a", "completion": "b"}, {"instruction": "a", "input": "c", "output": "b"}, {"system": "s", "prompt": "a", "response": "b"}, {"odd": 1}, None,
    ]
    rows = spark.createDataFrame([(k, 0, None if r is None else json.dumps(r)) for k, r in enumerate(records)], "conv_id long, turn long, record string")
    turns = chat.canonical_turns(rows)
    got: dict = {}
    for r in turns.orderBy("conv_id", "item").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    two = [("user", "a"), ("assistant", "b")]
    assert got == {0: [("user", "a")], 1: two, 2: [("user", "ab")], 3: two, 4: two, 5: [("user", "a\n\nc"), ("assistant", "b")], 6: [("system", "s"), *two], 7: [(None, None)], 8: [("", "")]}
    assert chat.unknown_layouts(turns).first()["n_records"] == 1
    digest = {r["conv_id"]: r for r in chat.digest_chat(chat.format_chat(turns)).collect()}
    assert digest[4]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and digest[4]["loss_chars"] == 1 and digest[0]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.digest_chat(chat.format_chat(chat.canonical_turns(rows.where("conv_id < 0")))).count() == 0


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return sentencepiece.Model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def best_score(part: str, library, unknown: float) -> float:
    """Of all segmentations, by trying every piece at every place."""
    pieces = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    best = [0.0] + [-np.inf] * len(part)
    for b in range(1, len(part) + 1):
        for a in range(b):
            score = pieces.get(part[a:b], unknown if b - a == 1 else -np.inf)
            best[b] = max(best[b], best[a] + score)
    return best[-1]


def test_segments_have_the_best_score(model, library):
    scores = {i: library.get_score(i) for i in range(library.get_piece_size())}
    for text in ("hello world", "unbelievable antidisestablishmentarianism", "a", "  two  spaces", "naïve Straße 中文字 😀😀", "x" * 40):
        part = "▁" + text.replace(" ", "▁")
        ids = model.segment(part)
        unknown = sum(1 for i in ids if i in model.byte)
        singles = [c for c in part if c not in {library.id_to_piece(i) for i in range(library.get_piece_size())}]
        assert unknown == sum(len(c.encode()) for c in singles)
        got = sum(scores[i] for i in ids if i not in model.byte) + model.unknown * len(singles)
        assert abs(got - best_score(part, library, model.unknown)) < 1e-4


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_round_trip(model, text):
    ids = np.frombuffer(model.encode(text), dtype="<i4").tolist()
    assert model.decode(ids) == text.replace("▁", " ")


def test_parts_segmented_together_equal_those_segmented_alone(model, monkeypatch):
    draw = random.Random(7)
    letters = ["e", "n", "th", "ing", "Ã", "é", "中", "文字", "😀", "\n", "\x00", "\uffff", "\U0010ffff", "ß", "ation", "▁"]
    parts = list({("▁" if draw.random() < 0.8 else "") + "".join(draw.choices(letters[:-1], k=draw.randint(1, 20))) for _ in range(3000)} | {"▁", "▁▁▁", "\x00", "x" * 63})
    ids, count = model.segment_all(parts)
    ends = np.cumsum(count).tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [model.segment(p) for p in parts]
    texts = ["", "a b a", " ".join(letters), "▁", "y" * 500 + " a"]
    want = [[i for p in sentencepiece.PARTS.findall("▁" + t.replace(" ", "▁")) if t for i in model.segment(p)] for t in texts]
    model.forget()
    asked = []
    alone = model.segment
    monkeypatch.setattr(model, "segment", lambda part: asked.append(part) or alone(part))
    for _ in range(2):
        values, count, same = model.encode_all(texts)
        assert values.tolist() == sum(want, []) and count.tolist() == [len(x) for x in want] and same == [True, True, False, False, True]
    assert asked == ["▁" + "y" * 500] * 2 and max(map(len, model.known)) < sentencepiece.LONG


def test_parts_that_are_not_spelt_are_told(model, monkeypatch):
    """A model without bytes writes one id for all unknown characters."""
    monkeypatch.setattr(model, "of_byte", {})
    model.forget()
    texts = ["a \uffff", "hello", "a a"]
    _, count, same = model.encode_all(texts)
    model.forget()
    assert same == [False, True, True] and count.min() > 0


def test_the_memory_of_parts_is_bounded(model, monkeypatch):
    monkeypatch.setattr(model, "remember", 50)
    want = model.encode("aa bb cc")
    for k in range(30):
        model.encode_all([" ".join(f"w{k}x{j}" for j in range(20))])
        assert len(model.known) < 80
    assert model.encode("aa bb cc") == want


def test_decoding_equals_library(model, library):
    for text in ("hello world", "naïve 中文 😀", " lead", "tail ", ""):
        ids = library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_encoded_column(spark):
    rows = [(1, None), (2, ""), (3, "hello"), (3, "hello"), (4, "word " * 30_000), (5, "a▁b")]
    df = sentencepiece.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.collect()}
    assert df.count() == 6 and got[1]["n_ids"] == got[2]["n_ids"] == 0 and got[1]["round_trip"] and got[4]["round_trip"] and not got[5]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(df.select("doc_id", "ids")).collect()}
    assert back[3] == "hello" and back[4] == "word " * 30_000 and back[1] == ""
