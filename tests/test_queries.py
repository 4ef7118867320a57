"""Every query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from suite.compare import compare, connect

SF = os.environ.get("FUNCLAB_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE, NO_SQL = entry.QUERIES, entry.ORACLE, entry.NO_SQL

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and not set(NO_SQL) & set(ORACLE)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF) is None


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["language", "configuration", "experiment", "model"] and df.count() > 0


PLANS = ["experiments", "oversample", "few_shot_prompts", "line_metrics", "score_matrix", "overlap_semi_join", "strip_comments"]


@needs_data
@pytest.mark.parametrize("name", PLANS)
def test_no_cross_join_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@needs_data
def test_texts_are_not_shuffled_by_a_split(spark):
    from suite import views
    from funclab.operators import sampling

    placed = sampling.stratified_split(views.v_clean(spark, SF), sampling.experiment_list(spark), ["language", "configuration"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
