from pyspark.sql import functions as F

from fraylens.operators.segment import tag_pulls
from fraylens.operators.staging import staged
from tests.build import ORLA, WARDEN, damage, flat


def test_a_staged_table_is_as_large_to_the_optimizer_as_its_rows(spark):
    rows = spark.range(50_000).select((F.col("id") % 7).alias("log_id"), F.lit("1704067200000-12").alias("pull_id"), F.lit(5).cast("bigint").alias("start_line"))
    table = staged(rows.coalesce(1))
    told = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert told >= 50_000 * (8 + 16 + 8)
    assert table.count() == 50_000 and table.distinct().count() == 7


def test_a_packed_table_holds_the_same_rows(spark):
    rows = spark.range(1_000).select((F.col("id") % 7).alias("log_id"), F.array(F.lit("a"), F.lit(None)).alias("names"))
    assert sorted(staged(rows, packed=True).collect()) == sorted(rows.collect())


def test_the_line_bins_of_pulls_are_never_broadcast(spark):
    events = flat(spark, [damage(100 * i, ORLA, WARDEN) for i in range(6)])
    rows = [("log", "a", 2, 4), ("log", "b", 5, 100_000)]
    pulls = staged(spark.createDataFrame(rows, "log_id string, pull_id string, start_line bigint, close_line bigint"))
    tagged = tag_pulls(events, pulls)
    assert "BroadcastExchange" not in tagged._jdf.queryExecution().executedPlan().toString()
    found = sorted((r.line_number, r.pull_id) for r in tagged.select("line_number", "pull_id").collect())
    assert found == [(2, "a"), (3, "a"), (5, "b"), (6, "b")]
