from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fraylens.sources import sinks


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n_logs, n_lines, type_):
    line, log = F.col("id") % n_lines, (F.col("id") / n_lines).cast("bigint")
    base = spark.range(n_logs * n_lines).select(log.alias("log_id"), F.lit("1-1").alias("pull_id"), line.alias("line_number"), F.lit(type_).alias("type"))
    return base.withColumn("bucket_index", F.floor(F.col("line_number") / 5).cast("bigint")).withColumn("part", F.lit(0).cast("bigint"))


def files(path):
    return len(list(Path(path).glob("guild_id=*/report_code=*/*.parquet")))


def test_a_report_is_written_by_few_tasks(apart, tmp_path):
    path = str(tmp_path / "events")
    sinks.write_event_buckets(rows(apart, 40, 100, "damage"), "g", path)
    assert 40 <= files(path) <= 40 + 8
    sinks.write_event_buckets(rows(apart, 40, 100, "heal").where("bucket_index % 2 = 0"), "g", path)
    assert 40 <= files(path) <= 40 + 8
    found = apart.read.parquet(path).groupBy("report_code", "type").count().collect()
    assert sorted((int(r.report_code), r.type, r["count"]) for r in found) == [(i, t, 50) for i in range(40) for t in ("damage", "heal")]


def test_one_huge_report_is_written_by_many_tasks(apart, tmp_path):
    path = str(tmp_path / "events")
    sinks.write_event_buckets(rows(apart, 1, 4000, "damage"), "g", path)
    assert files(path) >= 4 and apart.read.parquet(path).select("line_number").distinct().count() == 4000
