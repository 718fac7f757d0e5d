"""Nulls, empty tables, clashing names, malformed records and repeated notices; and whole queries against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postgrove.llm import ann, chat, licenses, media, registry, sentencepiece
from postgrove.session import read_table

TEXTS = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "released under the mit license " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated, without an id and very long; with columns called like results."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.withColumns({"n_words": F.lit("kept"), "media": F.lit(None).cast("binary"), "media_index": F.lit(1), "ids": F.lit("x"), "labels": F.lit(2.5)})


def test_media_of_odd_rows(odd):
    stored = media.store_payload(odd)
    got = sorted((str(r["doc_id"]), r["n_bytes"]) for r in stored.collect())
    assert got == sorted((str(i), len((t or "").encode())) for i, t in TEXTS) and media.store_payload(odd.where("doc_id < 0")).count() == 0
    again = media.index_media(media.index_media(stored))
    assert again.columns == ["doc_id", "n_bytes", "media", "media_index"]
    assert all(media.read_payload(r["media"], r["media_index"]["frame_offsets"])[: r["n_bytes"]] in {(t or "").encode() for _, t in TEXTS} for r in again.collect())


def test_notices_of_odd_rows(odd):
    got = {(r["doc_id"], r["n_words"], r["n_fuzzy"], r["labels"]) for r in licenses.scan(odd).collect()}
    assert got == {(1, 0, 0, ""), (2, 0, 0, ""), (None, 1, 0, ""), (3, 15000, 3000, "mit")} and licenses.scan(odd.where("doc_id < 0")).count() == 0


def test_pieces_of_odd_rows(odd):
    got = {(r["doc_id"], r["round_trip"]) for r in sentencepiece.encode(odd).collect()}
    assert got == {(1, True), (2, True), (None, True), (3, True)} and sentencepiece.encode(odd.where("doc_id < 0")).count() == 0
    assert sentencepiece.decode(sentencepiece.encode(odd.where("doc_id < 0"))).count() == 0


def test_malformed_records_and_conversations_without_an_id(spark):
    rows = spark.createDataFrame([(1, 0, "{bad"), (1, 1, '{"role": "user", "text": "a"}'), (None, 0, '{"role": "assistant", "text": "b"}'), (2, 0, "5"), (3, 0, "[" * 100_000), (4, 0, "")], "conv_id long, turn long, record string")
    turns = chat.canonical_turns(rows.withColumn("layout", F.lit("clash")))
    unknown = {r["fingerprint"]: r["n_records"] for r in chat.unknown_layouts(turns).collect()}
    assert unknown.pop(chat.MALFORMED) == 2 and list(unknown.values()) == [1]
    digest = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digest_chat(chat.format_chat(turns)).collect()}
    assert digest == {1: (1, 0), None: (1, 1), 4: (1, 0)}


def test_vectors_of_no_use(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0]), (3, [])], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    graphs = ann.index(df)
    assert graphs.count() == 0 and ann.nearest(df.withColumnRenamed("vec_id", "query_id"), graphs).count() == 0


def edit_ends(notice: str, text: str, errors: int) -> list[int]:
    """For every end in ``text``, the fewest edits that turn some stretch that ends there into ``notice``."""
    row = np.arange(len(notice) + 1)
    best = [int(row[-1])]
    for c in text:
        new = np.empty_like(row)
        new[0] = 0
        for i, n in enumerate(notice):
            new[i + 1] = min(row[i] + (n != c), row[i + 1] + 1, new[i] + 1)
        row = new
        best.append(int(row[-1]))
    return best


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(12))
def test_all_spans_of_notices(seed):
    """Copies with and without edits, adjacent, apart and cut short: every end that a notice reaches within its errors lies in or at a span that was found, spans do not overlap, and their errors are true."""
    draw = random.Random(seed)
    label, notice = draw.choice(list(licenses.NOTICES.items()))
    searcher = licenses.Searcher({label: notice})
    errors = searcher.notices[0][2]
    parts = []
    for _ in range(6):
        copy = notice
        for _ in range(draw.randint(0, errors + 1)):
            at = draw.randrange(len(copy))
            copy = copy[:at] + draw.choice(["", "q", copy[at] + "z"]) + copy[at + 1 :]
        parts += [copy, draw.choice([" ", "", " filler words ", notice[: len(notice) // 2]])]
    text = "".join(parts)
    found = searcher.find(text)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    for a, b, _, score in found:
        assert distance(text[a:b], notice) == round((1 - score) * len(notice)) <= errors
    ends = edit_ends(notice, text, errors)
    for end, e in enumerate(ends):
        if e <= errors:
            assert any(a <= end and end - len(notice) - errors < b for a, b, *_ in found), (end, e)


def test_the_notice_that_a_better_one_hid():
    searcher = licenses.Searcher(licenses.NOTICES)
    for text in ("relexased under the mit license released under the mit license", "released under the mit license relexased under the mit license"):
        assert [round((1 - s) * 30) for *_, s in searcher.find(text)] in ([1, 0], [0, 1])


def test_the_sentencepiece_query_has_the_best_scores(spark, sf_dir):
    """Each part of each document is segmented by trying every piece at every place; the query's ids have the same total score and decode to the text."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
    longest, unknown = max(map(len, scores)), min(scores.values()) - sentencepiece.UNKNOWN_PENALTY
    known: dict[str, float] = {}

    def best(part: str) -> float:
        if part not in known:
            row = [0.0]
            for b in range(1, len(part) + 1):
                row.append(max(row[a] + scores.get(part[a:b], unknown if b - a == 1 else -np.inf) for a in range(max(0, b - longest), b)))
            known[part] = row[-1]
        return known[part]

    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, sf_dir, "documents").collect()}
    rows = registry.queries()["op7_sentencepiece"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        whole = ("▁" + text.replace(" ", "▁")) if text else ""
        want = sum(best("▁" + part) if k else best(part) for k, part in enumerate(whole.split("▁")) if k or part)
        got = sum(library.get_score(i) for i in r["ids"] if not library.is_byte(i)) + unknown * sum(1 for c in whole if c not in scores)
        assert abs(got - want) < 1e-2 * max(1, len(text) ** 0.5), r["doc_id"]
        assert r["round_trip"] == ("▁" not in text)
