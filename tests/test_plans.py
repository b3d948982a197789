"""Plan shape checks: no pair explosion, distributed top-k, no single-partition
windows over data in the running aggregates, pruned scans."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def _plan(spark, name):
    return Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j01_same_story_pairs", "j02_contained_pairs", "j03_match_verdicts",
                                  "j07_similarity_pairs", "a12_silhouette"])
def test_pair_jobs_have_no_cartesian_product(spark, name):
    p = _plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p or name == "j03_match_verdicts"


def test_funnel_is_a_distributed_top_k_on_a_pruned_scan(spark):
    p = _plan(spark, "k02_hard_cap")
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


@pytest.mark.parametrize("name", ["w08_running_counter", "w07_consecutive_failures", "t32_batch_index",
                                  "a18_counter_totals", "a17_histogram_summary"])
def test_running_aggregates_do_not_gather_data_in_one_partition(spark, name):
    p = _plan(spark, name)
    # what enters a single partition is already aggregated (a row for each piece) or limited
    lines = [line.lstrip(" :+-*()0123456789") for line in p.split("\n")]
    for i, line in enumerate(lines):
        if line.startswith("Exchange SinglePartition"):
            below = next(x for x in lines[i + 1:] if not x.startswith(("Project", "Sort", "Filter", "InputAdapter", "AQEShuffleRead")))
            assert below.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate", "LocalLimit")), below


def test_counters_aggregate_before_the_shuffle(spark):
    p = _plan(spark, "a18_counter_totals")
    assert "partial_sum" in p
