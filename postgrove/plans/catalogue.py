"""All registered queries of the postings engine with their DuckDB twins."""

from __future__ import annotations

from postgrove.plans import evidence_queries, feed_queries, link_queries, ranking_queries, reader_queries, report_queries, state_queries, stream_queries, table_queries, text_queries  # noqa: F401
from postgrove.plans.registry import QUERIES, SQL, Query


#: What reads no table: rules on literal rows, kept as readable cases for the tests. Every operator behind them has a registered query over a table too.
CASES = frozenset(
    """discovery_cascade sanitized_labels null_rules url_normalize_literals url_verdict_literals public_links link_candidates redirect_walk linkify rank_reasons job_type_canon experience_parse
    place_spellings quick_match profile_completeness retry_backoff enqueue_upsert upsert_fallback_match live_fold guarded_updates audit_revert stored_logos manual_edits registry_upsert spelling_union
    markdown_tables url_extract field_acceptance table_dates table_cells tidy_text clean_lists skill_match canonical_skills normalize_posts""".split()
)


def queries() -> dict[str, Query]:
    return {name: f for name, f in QUERIES.items() if name not in CASES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name not in CASES}


def cases() -> dict[str, tuple[Query, str]]:
    return {name: (QUERIES[name], SQL[name]) for name in sorted(CASES)}
