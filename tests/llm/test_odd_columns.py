"""Columns with odd names and nested types through every stage of the pipeline and the media index; odd JSON through chat formatting."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postgrove.llm import chat, media

ODD = ["my `odd` col", "a.b", "nested", "toxic", "n_words"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    held = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nested = F.struct(F.lit(1).alias("my field"), F.lit("x").alias("b`c"), F.array(F.struct(F.lit(2).alias("a.b"))).alias("l"))
    return held.withColumns({"my `odd` col": F.col("doc_id") * 2, "a.b": F.lit("dot"), "nested": nested, "toxic": F.lit("kept"), "n_words": F.lit(7)})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_odd_columns(name, stage, spark, sf_dir, docs):
    """Names of results give way in the classifier and the passages' cutter; everything else stays as it is."""
    given = docs.drop("toxic", "n_words") if name in ("toxicity", "substring_dedup") else docs
    got = stage(spark, given, sf_dir)
    assert got.columns == given.columns and got.schema["nested"].dataType.simpleString() == given.schema["nested"].dataType.simpleString()
    rows = got.select("doc_id", "`my ``odd`` col`", "`a.b`", "nested.`my field`").collect()
    assert rows and all(r[1] == 2 * r[0] and r[2] == "dot" and r[3] == 1 for r in rows)


def test_stages_take_empty_tables(spark, sf_dir, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.drop("toxic", "n_words").where("doc_id < 0"), sf_dir).count() == 0


def test_media_index_keeps_odd_columns(docs):
    kept = docs.select("doc_id", "text", "nested", "`a.b`").limit(5)
    stored = media.store_payload(kept).join(kept.drop("text"), "doc_id")
    rows = media.index_media(stored).collect()
    assert len(rows) == 5 and all(r["nested"]["my field"] == 1 and r["a.b"] == "dot" and r["media_index"]["n_frames"] > 0 for r in rows)


def test_lone_surrogates_and_deep_nesting(spark):
    deep = ["[" * 900 + "]" * 900, '{"a":' * 1200 + "1" + "}" * 1200, "[" * 50_000 + "]" * 50_000]
    plain = '{"role":"user","text":"\\ud800 x \\ud83d\\ude00"}'
    records = [plain, '{"\\udfff": 1, "role": "assistant", "text": "b\\udc00"}', json.dumps({"role": "user", "text": "y", "x": json.loads(deep[0])}), *deep]
    rows = spark.createDataFrame([(k, 0, r) for k, r in enumerate(records)], "conv_id long, turn long, record string")
    turns = chat.canonical_turns(rows)
    assert {r["conv_id"]: (r["role"], r["text"]) for r in turns.where("layout IS NOT NULL").collect()} == {0: ("user", "� x \U0001f600"), 1: ("assistant", "b�"), 2: ("user", "y")}
    assert sum(r["n_records"] for r in chat.unknown_layouts(turns).collect()) == 3
    assert chat.digest_chat(chat.format_chat(turns)).count() == 3 and chat.digest_chat(chat.format_chat(turns.where("conv_id < 0"))).count() == 0
