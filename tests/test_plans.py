from pathlib import Path

import pytest

from fraylens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_name_rules_need_no_nested_loop(spark):
    assert "NestedLoop" not in plan(spark, "catalog_roles")


def test_phase_entries_read_the_events_once(spark):
    found = plan(spark, "phase_entries")
    assert found.count("events.parquet") == 1 and found.count("Window [") == 2
