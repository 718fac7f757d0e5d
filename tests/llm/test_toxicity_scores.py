"""The chain's probabilities against a plain sum over each document's features."""

import math

import pytest

pytest.importorskip("postgrove.llm")

from postgrove.llm import toxicity  # noqa: E402
from postgrove.llm.common import read_table  # noqa: E402


def test_scores_equal_plain_sums(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels)
    said = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, sf_dir).collect()}
    texts = docs.collect()
    assert len(said) == len(texts) and any(r["toxic"] for r in said.values())
    for doc_id, text in texts:
        columns = toxicity.features(text or "").tolist()
        earlier = []
        for m in chain:
            evidence = sum(m.weights[c] for c in columns) * (max(1, len(columns)) / 100) ** -toxicity.LENGTH_POWER
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, evidence + sum(a * b for a, b in zip(m.slopes, earlier)) + m.bias)))))
        assert [said[doc_id][f"p_{c}"] for c in toxicity.CHAIN] == pytest.approx(earlier, abs=1e-9)
        assert said[doc_id]["toxic"] == (said[doc_id]["p_toxic"] >= 0.5)
