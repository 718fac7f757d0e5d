"""Packing of texts with added tokens, against the tokenizers library as it comes."""

from __future__ import annotations

import zlib

import numpy as np

from postgrove.llm import packing


def test_added_tokens_have_their_own_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> x", "a <|endoftext|>b  <|endoftext|>  \n", "<|endoftext|><|endoftext|>", "<|endoftext", "plain words", "w " * 700 + "<|endoftext|>" + " w" * 700]
    rows = packing.tokenized_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=4096).collect()
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows}
    for k, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes())), text
