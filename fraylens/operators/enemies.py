"""Enemy instances: lifecycle, totals, and what each player did to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import combat
from fraylens.operators.metrics import rates
from fraylens.operators.segment import PULL

ENEMY_SUMS = [
    "damage_taken", "damage_dealt", "absorbed", "critical_hits", "critical_damage", "mitigated_damage", "overkill", "threat",
]


def _dealt_to_npc() -> Column:
    return combat.raid_damage()


def _dealt_by_npc() -> Column:
    return (F.col("type") == "damage") & combat.npc("source") & combat.player("target")


def sightings(tagged: DataFrame) -> DataFrame:
    """Every appearance of an NPC instance, source slot before target slot.

    ``observed`` appearances report a max health; ``touched`` ones are raid
    damage, damage to a player, or a death.
    """

    def side(name: str, slot: int, touched: Column) -> Column:
        fields = F.struct(
            F.coalesce(F.col(f"{name}_id"), F.col(f"{name}_npc_id")).alias("instance_id"),
            F.col(f"{name}_npc_id").alias("npc_id"),
            F.col(f"{name}_name").alias("raw_name"),
            F.col(f"{name}_hp").alias("hp"),
            F.col(f"{name}_max_hp").alias("max_hp"),
            F.lit(slot).alias("slot"),
            F.coalesce(F.col(f"{name}_max_hp") > 0, F.lit(False)).alias("observed"),
            F.coalesce(touched, F.lit(False)).alias("touched"),
            (F.coalesce(touched, F.lit(False)) & (F.col("type") == "damage")).alias("fought"),
            ((F.col("type") == "death") & F.lit(slot == 1)).alias("died"),
        )
        return F.when(combat.npc(name), fields)

    died = (F.col("type") == "death") & combat.npc("target")
    pair = F.array(side("source", 0, _dealt_by_npc()), side("target", 1, _dealt_to_npc() | died))
    rows = tagged.select(*PULL, "line_number", "ts_ms", F.explode(pair).alias("s"))
    rows = rows.filter(F.col("s").isNotNull()).select(*PULL, "line_number", "ts_ms", "s.*")
    return rows.filter(F.col("observed") | F.col("touched"))


def enemy_lifecycle(seen: DataFrame, npc_catalog: DataFrame) -> DataFrame:
    """First and last sighting, engagement, death and health of every instance.

    The last word on health wins even after a death, so a logged corpse can
    raise ``final_hp`` again.
    """
    order = F.struct("line_number", "slot")
    line = F.struct("line_number")
    life = seen.groupBy(*PULL, "instance_id").agg(
        F.min_by(F.struct("npc_id", "raw_name", "observed", "ts_ms"), order).alias("first"),
        F.max_by("ts_ms", order).alias("last_seen_at"),
        F.min_by("ts_ms", F.when(F.col("fought"), line)).alias("fought_at"),
        F.max_by("ts_ms", F.when(F.col("died"), line)).alias("died_at"),
        F.max(F.when(F.col("observed"), F.col("max_hp"))).alias("max_hp"),
        F.max_by(
            F.struct(F.when(F.col("died"), F.lit(0)).otherwise(F.col("hp")).alias("hp")), order
        ).alias("last_hp"),
        F.sum(F.col("died").cast("bigint")).alias("deaths"),
        F.min(order).alias("first_order"),
    )
    names = npc_catalog.select(F.col("npc_id"), F.col("name").alias("__catalog_name"))
    named = life.withColumn("npc_id", F.col("first.npc_id")).join(names, "npc_id", "left")
    return named.select(
        *PULL, "instance_id", "npc_id",
        F.coalesce("__catalog_name", "first.raw_name").alias("name"),
        F.col("first.raw_name").alias("raw_name"),
        F.when(F.col("__catalog_name").isNotNull(), "catalog").otherwise("log").alias("identity_source"),
        F.col("first.ts_ms").alias("first_seen_at"),
        F.when(~F.col("first.observed"), F.col("first.ts_ms")).otherwise(F.col("fought_at")).alias("engaged_at"),
        "last_seen_at", "died_at", "max_hp", F.col("last_hp.hp").alias("final_hp"), "deaths",
        F.col("first_order.line_number").alias("first_line"), F.col("first_order.slot").alias("first_slot"),
    )


def enemy_contributions(tagged: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """Damage rows attributed to the enemy side, dealt and received alike."""
    applied = combat.applied()
    received = _dealt_to_npc()

    def instance(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_id"), F.col(f"{side}_npc_id"))

    rows = tagged.filter(received | _dealt_by_npc()).select(
        *keys, "line_number", "ts_ms",
        F.when(received, instance("target")).otherwise(instance("source")).alias("instance_id"),
        F.when(received, F.col("source_id")).alias("player_id"),
        F.when(received, F.col("source_name")).alias("player_name"),
        "damage_type", "mitigation",
        applied.alias("type_amount"),
        F.when(received, applied).otherwise(F.lit(0)).alias("damage_taken"),
        F.when(received, F.lit(0)).otherwise(applied).alias("damage_dealt"),
        F.coalesce(F.col("absorbed"), F.lit(0)).alias("absorbed"),
        F.when(F.col("critical"), 1).otherwise(0).alias("critical_hits"),
        F.when(F.col("critical"), applied).otherwise(F.lit(0)).alias("critical_damage"),
        combat.mitigated().alias("mitigated_damage"),
        combat.overkill().alias("overkill"),
        F.coalesce(F.col("threat"), F.lit(0)).alias("threat"),
        F.when(F.col("amount") > 0, 1).otherwise(0).alias("damage_hits"),
    )
    return rows


def enemy_totals(rows: DataFrame, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    cast = "bigint" if whole else "double"
    return rows.groupBy(*keys, "instance_id").agg(*[F.sum(c).cast(cast).alias(c) for c in ENEMY_SUMS])


def enemy_type_totals(rows: DataFrame, kind: str, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    """Long form of an enemy's per-type maps (``damage_type`` or ``mitigation``)."""
    amount = F.col("type_amount") if kind == "damage_type" else F.col("mitigated_damage")
    cast = "bigint" if whole else "double"
    kept = rows.filter(F.col(kind).isNotNull() & (amount != 0))
    return kept.groupBy(*keys, "instance_id", kind).agg(F.sum(amount).cast(cast).alias("amount"))


def enemy_players(rows: DataFrame, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    """What each player dealt to each enemy; add ``segment_index`` to the keys for phases."""
    cast = "bigint" if whole else "double"
    sums = ["damage_hits", "critical_hits", "critical_damage", "mitigated_damage", "overkill", "threat"]
    return rows.filter(F.col("player_id").isNotNull()).groupBy(*keys, "instance_id", "player_id").agg(
        F.min_by("player_name", "line_number").alias("player_name"),
        F.sum("damage_taken").cast(cast).alias("damage"),
        *[F.sum(c).cast(cast).alias(c) for c in sums],
        F.min_by("ts_ms", "line_number").alias("first_damage_at"),
        F.max_by("ts_ms", "line_number").alias("last_damage_at"),
    )


def enemy_player_rates(players: DataFrame, lifecycle: DataFrame, pulls: DataFrame) -> DataFrame:
    """Rates of each player against one enemy, from first hit to its death or the pull's last activity."""
    ends = lifecycle.select(*PULL, "instance_id", "died_at").join(pulls.select(*PULL, "ended_at"), PULL)
    joined = players.join(ends, [*PULL, "instance_id"])
    span = F.greatest(F.lit(1), F.coalesce("died_at", "ended_at") - F.col("first_damage_at"))
    active = F.greatest(F.lit(0), F.col("last_damage_at") - F.col("first_damage_at"))
    idle = {c: F.lit(0) for c in (
        "healing", "damage_taken", "actions", "overhealing", "healing_critical_hits", "healing_events",
        "defenses", "incoming_attacks", "shielded_hits", "incoming_hits")}
    full = rates(joined.withColumns(idle).withColumn("active_ms", active), span)
    return full.drop(*idle, "hps", "dtps", "apm", "overheal_percent", "healing_crit_percent", "defense_percent", "shield_percent")
