"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages and live
secrets are cut out, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of ``documents``.

Defined results: a null or empty text is judged as an empty one, is near to no other, has nothing to cut or redact, and is packed as its end token alone; a text of any length is
read whole; rows that repeat an id share its fate, and a row without an id stays and is packed with a null id; an empty table passes through all stages; further columns of any type and name go along through
all stages but the last, except that the results of the classifier (p_kind_1 and so on, p_toxic, toxic) and of the passages' cutter (n_words, n_removed) replace columns called like them on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrove.llm import near_dedup, packing, secrets, substrings, toxicity
from postgrove.llm.common import quoted, read_table, stored

#: No SQL can express the classifier, so run() is tested against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, rejects go."""
    return toxicity.classify(docs, read_table(spark, sf_dir, "labels")).where("NOT toxic").select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 over shingles of five words, the document with the smallest id stays."""
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that stand earlier are cut; every document stays."""
    return substrings.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced by a marker; widely copied examples and every document stay."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
