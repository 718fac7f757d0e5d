"""Copies of a notice side by side, the worse ones first."""

from __future__ import annotations

from postgrove.llm import licenses


def test_worse_copies_before_better_ones_are_found(spark):
    copies = ["relased under the mt license", "relased under the mit license", "released under the mit license"]
    said = [" ".join(copies[1:]), " ".join(copies), " ".join(copies[::-1]), "x ".join(["", *copies])]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_fuzzy"] for r in rows] == [2, 3, 3, 3]
    assert [(s["start"], s["end"], round(s["score"] * 30)) for s in rows[1]["spans"]] == [(0, 5, 28), (5, 10, 29), (10, 15, 30)]
