"""Resumes whose first word has letters without a capital of one letter."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from postgrove.functions.text import capitals
from postgrove.plans import catalogue
from tests.conftest import rows_of

WORDS = ["Üß, gete und Masse", "Üßch sch der küssch", "ﬁx ff fi fix", "ŉa na nna", "ẗx tx", "ᾳ1 b ai1", "ǆx dx", "ſa sa", "ıa ia", "1ẚ aʾ 1a", "", " ", "ß ss", None]


def test_first_words_in_capitals_equal_sql(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["resume_fields"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    said = con.execute(catalogue.oracle_sql()["resume_fields"])
    names = [d[0] for d in said.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, said.fetchall())


@pytest.mark.parametrize("low,high", [("straße", "STRAẞE"), ("ﬁne", "ﬁNE"), ("ᾳᾶ😀é", "ᾼᾶ😀É"), ("", ""), (None, None)])
def test_capitals_are_one_letter_each(spark, low, high):
    assert spark.createDataFrame([(low,)], "x string").select(capitals(F.col("x"))).first()[0] == high
