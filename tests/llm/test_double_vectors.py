"""Double vectors keep their digits, however large or small, and graphs are exchanged a bounded number of times."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from postgrove.llm import ann


def test_scores_are_those_of_the_doubles(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.7]), (2, [1e300, -1e300]), (3, [1e-300, 2e-300]), (4, [0.1, 0.2 + 1e-12]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(df.withColumnRenamed("vec_id", "query_id"), ann.index(df)).collect()}
    known = dict(rows)
    assert set(got) == {(a, b) for a in range(5) for b in range(5) if a != b}
    for (a, b), score in got.items():
        assert score == pytest.approx(math.dist(known[a], known[b]), rel=1e-15) and math.isfinite(score)
    assert got[0, 1] == 0.5385164807134504 and 0 < got[0, 4] < 2e-12


@pytest.mark.parametrize("block,rows_per_shard", [(1024, 4096), (40, 100)])
def test_random_doubles_against_brute_force(spark, block, rows_per_shard):
    draw = random.Random(9)
    vectors = {i: [draw.gauss(0, 1) for _ in range(16)] for i in range(600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    got = ann.nearest(asked, ann.index(df, rows_per_shard=rows_per_shard), block=block).collect()
    x, hits = np.array([vectors[i] for i in range(600)]), 0
    for q in range(0, 600, 3):
        away = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        best = set(np.argsort(away)[:10].tolist())
        mine = [(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
        assert sorted(r for r, *_ in mine) == list(range(1, 11)) and all(s == pytest.approx(away[v], rel=1e-14) for _, v, s in mine)
        hits += len(best & {v for _, v, _ in mine})
    assert hits >= 0.95 * 2000
