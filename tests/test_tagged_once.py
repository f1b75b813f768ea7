import pytest

from fraylens.operators.staging import staged
from fraylens.plans import registry
from tests.test_cost import optimized, write_events


def test_a_packed_table_that_joins_take_counts_four_times_its_files(spark):
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = spark.range(20_000).selectExpr("id % 7 AS log_id", "'1704067200000-12' AS pull_id")
    taken = staged(rows.coalesce(1), packed=True, joined=True)
    assert size(taken) >= 4 * size(staged(rows.coalesce(1), packed=True))
    assert taken.columns == rows.columns and taken.exceptAll(rows).isEmpty() and taken.count() == 20_000
    assert "CartesianProduct" not in taken._jdf.queryExecution().executedPlan().toString()


class Asked(Exception):
    pass


def test_the_join_that_tags_events_runs_once(spark, tmp_path, monkeypatch):
    write_events(spark, tmp_path)
    fights = registry.gap_fights(spark, str(tmp_path), tagged_once=True)
    plan = optimized(fights.tagged)
    assert "get_json_object" not in plan and plan.count("Join") == plan.count("Range") == 1  # the row beside the written table
    assert fights.tagged.count() == registry.gap_fights(spark, str(tmp_path)).tagged.count() > 0

    def asked(spark, sf_dir, tagged_once=False):
        raise Asked(tagged_once)

    monkeypatch.setattr(registry, "gap_fights", asked)
    for name in ("challenge_totals", "challenge_players", "fight_documents"):
        with pytest.raises(Asked) as found:
            registry.QUERIES[name](spark, str(tmp_path))
        assert found.value.args == (True,)
