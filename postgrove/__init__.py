"""Postings analytics on Spark: feeds, reports, ranking, text and link functions, deduplication and sync."""
