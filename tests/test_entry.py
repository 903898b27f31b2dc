"""The registry: names of oracles, a plan per query, one shuffle for a search."""

import os

import pytest

import __spark_entry__ as registry

SMALL = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_a_search_without_a_stored_index_shuffles_once(spark):
    from quillon.operators.index import Index
    from quillon.queries import DOCUMENTS, T, ast, table
    from quillon.plans.compile import Compiler

    index = Index(table(spark, SMALL, "documents"), DOCUMENTS)
    got = plan(Compiler(index).compile(ast.Bool(should=(T("the"), T("der"), T("que")))).frame)
    assert got.count("Exchange hashpartitioning") == 2  # term counts, then documents: the first combines per task
    assert "ReadSchema: struct<doc_id:bigint,text:string" in got


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["q_bool_should", "q_match_or", "q_bool_nested", "q_prefix", "explain_terms", "topk"])
def test_a_search_reads_the_stored_postings_by_term(spark, name):
    from quillon.queries import QUERIES

    got = plan(QUERIES[name](spark, SMALL))
    assert "regexp_extract_all" not in got and "PushedFilters: [" in got and "term" in got[got.index("PushedFilters: ["):]
    assert got.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in got
    assert "positions" not in got


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_a_look_up_is_the_only_job_before_a_search(spark):
    """Once the index is stored, compiling reads its statistics and dictionary and nothing else."""
    from quillon.queries import QUERIES

    QUERIES["q_match_or"](spark, SMALL)
    tracker, group = spark.sparkContext.statusTracker(), "one-search"
    spark.sparkContext.setJobGroup(group, group)
    QUERIES["q_match_or"](spark, SMALL)
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 3
