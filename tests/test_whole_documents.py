"""Text queries read documents of every language."""

from __future__ import annotations

import __spark_entry__
from postgrove.session import read_table


def test_normalisation_is_over_all_languages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    assert __spark_entry__.queries()["normalized_text"](spark, sf_dir).count() == docs.count() > docs.where("lang = 'en'").count()
