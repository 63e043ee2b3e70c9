"""Plan-shape guards: the scale properties the design relies on, checked on
the physical plans of every registered query."""

import re

import pytest

import __spark_entry__ as entry_mod
from clickwise.plans.registry import REGISTRY
from tests.conftest import SF001

QUERIES = sorted(REGISTRY)
# Their scans are in the jobs that write the tables they read back.
STORED = {n for n in QUERIES if n.startswith(("report_", "streamed_"))}

# Upper bounds on shuffles.
MAX_EXCHANGES = {"minute_log": 4, "latest_wins": 5, "hourly_rollup": 6, "daily_rollup": 7,
                 "minute_agg": 4, "dedup_24h": 5}


def _plan(spark, name):
    df = entry_mod.queries()[name](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", QUERIES)
def test_no_round_robin(spark, name):
    assert "RoundRobinPartitioning" not in _plan(spark, name)


def _assert_pruned(plan):
    schemas = re.findall(r"events\.parquet.*?ReadSchema: struct<([^>]*)>", plan)
    assert schemas  # every registered query reads events
    for schema in schemas:
        assert len(schema.split(",")) <= 3, schema  # of event_id, ts, user_id, event_type, value, props


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORED))
def test_event_scans_are_pruned(spark, name):
    _assert_pruned(_plan(spark, name))


@pytest.mark.parametrize("source", ["_minute_log", "_arrivals"])
def test_scans_of_stored_queries_are_pruned(spark, source):
    """What the report_ and streamed_ queries write their tables from."""
    from clickwise.plans import catalog
    _assert_pruned(getattr(catalog, source)(spark, SF001)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(MAX_EXCHANGES))
def test_exchange_budget(spark, name):
    plan = _plan(spark, name)
    n = len(re.findall(r"Exchange (hashpartitioning|RoundRobinPartitioning|rangepartitioning|SinglePartition)", plan))
    assert n <= MAX_EXCHANGES[name], n
