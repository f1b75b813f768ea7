"""Ability usage: totals, breakdowns and cast intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import combat
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.options import Options


def ability_rows(tagged: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """Activations by players and damage by players, one row each."""
    cast = (F.col("type") == "ability") & (F.col("phase") == "activate")
    hit = F.col("type") == "damage"
    target = F.when(combat.player("target"), F.concat(F.lit("player:"), F.col("target_id"))).when(
        combat.npc("target"), F.concat(F.lit("npc:"), F.coalesce("target_id", "target_npc_id"))
    )
    landed = hit & (F.col("amount") > 0)

    def one(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    used = (cast | hit) & F.col("ability_id").isNotNull() & combat.player("source")
    return tagged.filter(used).select(
        *keys, "line_number", "ts_ms", "ability_id", "ability_name",
        F.col("source_id").alias("player_id"), F.col("source_name").alias("player_name"),
        F.when(hit, target).alias("target_id"),
        F.when(hit, F.col("target_name")).alias("target_name"),
        F.when(hit, F.col("target_npc_id")).alias("target_npc_id"),
        one(cast).alias("casts"), one(landed).alias("hits"), one(hit & ~landed).alias("misses"),
        one(landed & F.col("critical")).alias("critical_hits"),
        F.when(landed, combat.applied()).otherwise(F.lit(0)).alias("damage"),
    )


def _measures(whole: bool) -> list[Column]:
    cast = "bigint" if whole else "double"
    counts = [F.sum(c).cast("bigint").alias(c) for c in ("casts", "hits", "misses", "critical_hits")]
    return [*counts, F.sum("damage").cast(cast).alias("damage")]


def usage(rows: DataFrame, by: list[str], whole: bool = False) -> DataFrame:
    """Ability measures and exact distinct targets at any grain.

    Targets are made distinct by a grouping of their own, which spreads a hot
    ability over its targets before the final count.
    """
    per_target = rows.groupBy(*by, "target_id").agg(*_measures(whole))
    return per_target.groupBy(*by).agg(*_measures(whole), F.count("target_id").alias("targets"))


def ability_usage(rows: DataFrame, abilities: DataFrame, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    """Totals per ability with the catalogue's name, attack type and damage type."""
    logged = rows.groupBy(*keys, "ability_id").agg(F.min_by("ability_name", "line_number").alias("logged_name"))
    meta = abilities.select("ability_id", F.col("name").alias("catalog_name"), "attack_type", "damage_type")
    full = usage(rows, [*keys, "ability_id"], whole).join(logged, [*keys, "ability_id"]).join(meta, "ability_id", "left")
    return full.withColumn("name", F.coalesce("catalog_name", "logged_name")).drop("catalog_name", "logged_name")


def ability_targets(rows: DataFrame, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    """Breakdown of an ability by the target it hit or missed."""
    hit = rows.filter(F.col("target_id").isNotNull())
    return hit.groupBy(*keys, "ability_id", "target_id").agg(
        F.min_by("target_name", "line_number").alias("target_name"),
        F.min_by("target_npc_id", "line_number").alias("target_npc_id"),
        *_measures(whole),
    ).drop("casts")


def cast_intervals(rows: DataFrame, options: Options, keys: list[str] = PULL) -> DataFrame:
    """Times between casts of one ability by one player.

    A true zero interval reads as "unset" to the minimum, so the minimum is over
    the intervals after the last zero, or zero when none follow.
    """
    group = [*keys, "ability_id", "player_id"]
    block = scan.line_block(options.block_lines)
    casts = rows.filter(F.col("casts") == 1).select(*group, "line_number", "ts_ms")
    lagged = scan.running(casts, group, ["line_number"], block, {"prev": scan.last(F.col("ts_ms"), inclusive=False)})
    timed = lagged.withColumn("interval_ms", F.greatest(F.lit(0), F.col("ts_ms") - F.col("prev")))
    timed = timed.withColumn("interval_ms", F.when(F.col("prev").isNotNull(), F.col("interval_ms")))
    zero = F.when(F.col("interval_ms") == 0, 1).otherwise(0).cast("bigint")
    runs = scan.running(timed, group, ["line_number"], block, {"zeros": scan.total(zero)})
    per_run = runs.groupBy(*group, "zeros").agg(
        F.min_by("ts_ms", "line_number").alias("first_cast_at"), F.min("line_number").alias("first_line"),
        F.max_by("ts_ms", "line_number").alias("last_cast_at"), F.max("line_number").alias("last_line"),
        F.sum("interval_ms").alias("total_ms"), F.count("interval_ms").alias("intervals"),
        F.min(F.when(F.col("interval_ms") > 0, F.col("interval_ms"))).alias("shortest"),
        F.max("interval_ms").alias("longest"), F.count(F.lit(1)).alias("casts"),
    )
    return per_run.groupBy(*group).agg(
        F.sum("casts").alias("casts"),
        F.min_by("first_cast_at", "first_line").alias("first_cast_at"),
        F.max_by("last_cast_at", "last_line").alias("last_cast_at"),
        F.coalesce(F.sum("total_ms") / F.sum("intervals"), F.lit(0.0)).alias("average_ms"),
        F.coalesce(F.max_by(F.struct("shortest"), F.col("zeros")).getField("shortest"), F.lit(0)).alias("minimum_ms"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("maximum_ms"),
    )
