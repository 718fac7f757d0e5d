"""The queries of the thirteen operators and their DuckDB SQL."""

from __future__ import annotations

from postgrove.llm import ann, chat, collocations, licenses, media, near_dedup, packing, periodic, secrets, sentencepiece, substrings, toxicity, word_bpe

_QUERIES = {
    "op1_nearest_neighbours": ann.op1_nearest_neighbours,
    "op11_collocations": collocations.op11_collocations,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_word_bpe": word_bpe.op13_word_bpe,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op5_license_scan": licenses.op5_license_scan,
    "op4_media_columns": media.op4_media_columns,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op9_secret_scan": secrets.op9_secret_scan,
}
_SQL = {
    "op10_substring_dedup": substrings.SQL,
    "op11_collocations": collocations.SQL,
    "op6_chat_formatting": chat.SQL,
    "op9_secret_scan": secrets.SQL,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
