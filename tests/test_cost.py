"""What plans read and repeat, as far as it decides their cost."""

from pyspark.sql import functions as F

from fraylens.operators import victories
from fraylens.plans import registry
from fraylens.sources import logs, parse
from fraylens.sources.sample_catalog import sample_catalog


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def write_events(spark, folder):
    rows = [(i, 1_704_067_200 + i * 300, i % 3, ["purchase", "view", "click", "signup", "error"][i % 5], 10.0 + i, f'{{"k": {i * 7 % 100}}}') for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string")
    events.select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")


def test_full_analysis_reads_events_and_tagged_events_as_written(spark, tmp_path):
    write_events(spark, tmp_path)
    fights = registry.full_fights(spark, str(tmp_path))
    assert "get_json_object" not in optimized(fights.events)
    plan = optimized(fights.tagged)
    assert "Join" not in plan and "get_json_object" not in plan
    lazy = registry.gap_fights(spark, str(tmp_path)).events
    assert fights.events.exceptAll(lazy).isEmpty() and fights.events.count() == lazy.count() == 200


def test_victory_hits_carry_no_row_of_their_own_for_every_event(spark, tmp_path):
    write_events(spark, tmp_path)
    events = registry.combat_events(spark, str(tmp_path)).withColumn("local_player_id", F.lit(None).cast("string"))
    definitions = sample_catalog(spark).encounter_defs
    plan = optimized(victories.victory_hits(events, definitions))
    assert "Join Inner" in plan and "LeftOuter" not in plan
    both = victories.with_hits(events, definitions).where("hit IS NOT NULL").select("line_number", "hit")
    alone = victories.with_hits(events, definitions, own_rows=False).select("line_number", "hit")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))


def test_parser_computes_what_several_fields_use_once(spark):
    rows = [("a", "combat_2031-03-09_05_06_07_123456.txt", 1, "[07:08:09.010] [] [] [] []")]
    plan = optimized(parse.parse_lines(spark.createDataFrame(rows, logs.LINE_SCHEMA)))
    trims = plan.count("regexp_replace(") + plan.count("trim(")
    assert trims < 150
