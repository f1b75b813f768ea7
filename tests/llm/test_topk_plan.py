from pyspark.sql import functions as F

from fraylens.llm import topk


def test_copies_of_query_blocks_are_never_broadcast(spark):
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.sin(x * F.col("id"))).alias("embedding"))
    found = topk.top_k(rows, F.col("vec_id") % 50 == 0, 5, block=16, query_block=3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("query_id").count().where("count = 5").count() == 8
