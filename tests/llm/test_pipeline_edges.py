"""Null, empty, repeated and very long documents, and rows without an id, through the pipeline's stages one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from postgrove.session import read_table

N = 10**9


def test_odd_documents_pass_through_all_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(N + 1, None), (N + 2, ""), (N + 2, ""), (None, "an odd row without any id"), (N + 3, "".join(f"w{k} " for k in range(50_000)))]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    kept = docs.unionByName(odd)
    whole = kept.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        mine = kept.where(f"doc_id >= {N} OR doc_id IS NULL").select("doc_id", "text").collect()
        assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in mine) == sorted((str(i), len(t or "")) for i, t in rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    pieces = packed.where(f"doc_id >= {N} OR doc_id IS NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("ids")).collect()
    found = {r["doc_id"]: (r["n"], r["ids"]) for r in pieces}
    assert found[N + 1] == (1, 1) and found[N + 2] == (2, 2) and found[None][0] == 1 and found[N + 3][0] > 100 and kept.count() < whole
