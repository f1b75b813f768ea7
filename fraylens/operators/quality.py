"""Checks a good corpus and a good catalogue pass; each yields its offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraylens.sources.catalog import observed_health


def _finding(check: str, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")]


def unknown_lines(events: DataFrame, detail_column: str = "type") -> DataFrame:
    """Logs with lines the parser could not classify."""
    counts = events.groupBy("log_id").agg(F.count_if(F.col("type") == "unknown").alias("n"))
    return counts.filter(F.col("n") > 0).select(*_finding("unknown lines", F.col("log_id"), F.col("n")))


def bad_ids(table: DataFrame, column: str, check: str, digits: str = r"^\d+$") -> DataFrame:
    """Ids that repeat or are not numeric."""
    counts = table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    wrong = counts.filter((F.col("n") > 1) | ~F.coalesce(F.col(column).rlike(digits), F.lit(False)))
    return wrong.select(*_finding(check, F.col(column), F.col("n")))


def encounter_integrity(encounters: DataFrame, operations: DataFrame) -> DataFrame:
    """Repeated encounters, unknown operations, victims that are no boss, upper-case names, phases out of order."""
    repeated = encounters.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ops = operations.select(F.col("id").alias("operation_id"))
    orphans = encounters.join(ops, "operation_id", "left_anti")
    victims = encounters.withColumn("extra", F.array_except("victory_requires", "boss_names")).filter(F.size("extra") > 0)
    names = encounters.select("id", F.explode(F.concat("boss_names", "victory_requires")).alias("name"))
    phases = encounters.select("id", F.posexplode("phases").alias("pos", "ph"))
    return (
        repeated.select(*_finding("encounter id unique", F.col("id"), F.col("n")))
        .unionByName(orphans.select(*_finding("operation known", F.col("id"), F.col("operation_id"))))
        .unionByName(victims.select(*_finding("victims are bosses", F.col("id"), F.array_join("extra", ","))))
        .unionByName(names.filter(F.col("name") != F.lower("name")).select(*_finding("names lower case", F.col("id"), F.col("name"))))
        .unionByName(
            phases.filter(F.col("ph.phase_order") != F.col("pos") + 1).select(*_finding("phases ordered", F.col("id"), F.col("pos")))
        )
    )


def health_drift(events: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed-NPC rows whose name or largest health no longer match the corpus."""
    actual = observed_health(events).select("npc_id", F.col("name").alias("__name"), F.col("max_hp").alias("__hp"))
    joined = observed.join(actual, "npc_id", "left")
    same = F.col("__name").eqNullSafe(F.col("name")) & F.col("__hp").eqNullSafe(F.col("max_hp"))
    seen = F.concat_ws(" ", F.coalesce("__name", F.lit("absent")), F.col("__hp").cast("string"))
    return joined.filter(~same).select(*_finding("observed health", F.col("npc_id"), seen))


def bucket_round_trip(events: DataFrame, restored: DataFrame, keys: list[str]) -> DataFrame:
    """Pulls whose restored events differ from the originals in number or order."""
    original = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line_number", "type")).alias("h"))
    window = Window.partitionBy(*keys, "bucket_index", "part").orderBy("position")
    stepped = restored.withColumn("before", F.lag("line_number").over(window))
    back = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("line_number", "type")).alias("g"),
        F.count_if(F.col("line_number") <= F.col("before")).alias("out_of_order"),
    )
    joined = original.join(back, keys, "full_outer")
    same = F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("g")) & (F.coalesce("out_of_order", F.lit(0)) == 0)
    return joined.filter(~same).select(*_finding("bucket round trip", F.concat_ws("/", *keys), F.col("m")))
