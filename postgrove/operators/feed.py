"""The feed: filters of a request, total order, stable pages and exact totals (SRT1-SRT4, SRT11, FLT17)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postgrove.operators import predicates as P

def public() -> list[Column]:
    """What a reader may see of a posting."""
    return [F.col(c) for c in ("id", "company", "role", "batch", "location", "employment_type", "posted_at")] + [F.coalesce("verified", F.lit(False)).alias("verified")]


@dataclass(frozen=True)
class FeedQuery:
    now: datetime
    search: str | None = None
    batch: str | None = None
    location: str | None = None
    type: str | None = None
    posted_from: datetime | None = None
    posted_to: datetime | None = None
    exclude_sources: tuple[str, ...] = ()
    page: int = 1
    limit: int = 20
    sort: str = "newest"

    def condition(self) -> Column:
        parts = [P.active(self.now), P.outside_sources(list(self.exclude_sources)), P.posted_between(self.posted_from, self.posted_to)]
        parts += [P.search(self.search)] if self.search else []
        parts += [P.contains("batch", self.batch)] if self.batch else []
        parts += [P.contains("location", self.location)] if self.location else []
        parts += [P.of_type(self.type)] if self.type else []
        return reduce(lambda a, b: a & b, parts)


def ordered(df: DataFrame, sort: str = "newest", at: str = "posted_at", key: str = "id") -> DataFrame:
    """A total order in both directions: ties of time fall to the id, so pages never overlap."""
    return df.orderBy(F.desc(at), F.desc(key)) if sort == "newest" else df.orderBy(F.asc(at), F.asc(key))


def feed_page(postings: DataFrame, q: FeedQuery) -> DataFrame:
    """One page; plans as a single top-k over the pruned scan."""
    page, limit, sort = P.page_parameters(q.page, q.limit, q.sort)
    return ordered(postings.where(q.condition()).select(*public()), sort).offset((page - 1) * limit).limit(limit)


def feed_total(postings: DataFrame, q: FeedQuery) -> DataFrame:
    """The exact number of matches and pages."""
    return postings.where(q.condition()).agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / q.limit).cast("long").alias("total_pages"))


def feed_all(postings: DataFrame, q: FeedQuery) -> DataFrame:
    """Every page in one scan."""
    return postings.where(q.condition()).select(*public())


def posting(postings: DataFrame, q: FeedQuery, key: int) -> DataFrame:
    """One posting under the same visibility."""
    return postings.where((F.col("id") == key) & q.condition()).select(*public())


def pool(postings: DataFrame, q: FeedQuery, size: int = 500) -> DataFrame:
    """The newest ``size`` matches: what may be scored."""
    return ordered(postings.where(q.condition())).limit(size)
