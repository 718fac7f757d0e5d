"""Every registered query of the postings engine against its DuckDB twin."""

from __future__ import annotations

import pytest

import __spark_entry__
from postgrove.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalogue.CASES))
def test_literal_case_equals_its_rows(name, spark, sf_dir, same_as_sql):
    run, sql = catalogue.cases()[name]
    same_as_sql(run(spark, sf_dir), sql)


def test_what_has_no_sql_has_a_test_of_its_own():
    """Calls whose starts depend on each other are replayed in test_admission and test_streaming_and_rules."""
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"stream_admission", "stream_turns"}


def test_entry(spark):
    page = __spark_entry__.entry(spark)
    assert page.columns[0] == "id" and page.count() <= 20


def test_feed_plan_is_one_top_k_over_pruned_pushed_scans(spark, sf_dir):
    plan = catalogue.queries()["feed_page"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters: [" in plan and "o_totalprice" not in plan.split("Physical Plan")[1]
