"""Column expressions over the flat combat-event table (see ``fraylens.schemas``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK_TYPES = ("damage", "heal", "death", "applyEffect", "removeEffect", "ability")


def applied() -> Column:
    """Health that really changed: the effective part when logged, else the rolled amount."""
    return F.coalesce(F.col("effective"), F.col("amount"))


def mitigated() -> Column:
    """Part of the roll that never landed (mitigation of a hit, overheal of a heal)."""
    return F.greatest(F.lit(0), F.col("amount") - applied())


def overkill() -> Column:
    return F.when(F.col("target_hp").isNull(), F.lit(0)).otherwise(
        F.greatest(F.lit(0), applied() - F.col("target_hp"))
    )


def is_type(*types: str) -> Column:
    return F.col("type").isin(*types)


def player(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_kind") == "player", F.lit(False))


def npc(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_kind") == "npc", F.lit(False))


def player_id(side: str) -> Column:
    return F.when(F.col(f"{side}_kind") == "player", F.col(f"{side}_id"))


def actor_key(side: str) -> Column:
    """``p:<player>`` or ``n:<npc class>``; stable across a fight."""
    return F.when(player(side), F.concat(F.lit("p:"), F.col(f"{side}_id"))).when(
        npc(side), F.concat(F.lit("n:"), F.col(f"{side}_npc_id"))
    )


def spoken() -> list[Column]:
    """Names that may prove a victory: an effect speaks when it comes or goes, a category only of unclassified events."""
    return [
        F.col("ability_name"),
        F.when(F.col("type").isin("applyEffect", "removeEffect"), F.col("effect_name")),
        F.when(F.col("type") == "other", F.col("category_name")),
    ]


def is_activity() -> Column:
    """Events that open or refresh a pull."""
    cast = (F.col("type") == "ability") & (F.col("phase") == "activate") & player("source")
    return F.coalesce(is_type("damage", "heal", "death") | cast, F.lit(False))


def is_clock() -> Column:
    """Events that move the last-activity clock of an open pull."""
    return F.coalesce(is_type(*CLOCK_TYPES), F.lit(False))


def is_state(state: str) -> Column:
    return F.coalesce((F.col("type") == "combatState") & (F.col("state") == state), F.lit(False))


def raid_damage() -> Column:
    """Damage a player deals to an NPC, the only damage a meter counts."""
    return (F.col("type") == "damage") & player("source") & npc("target")


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale`` that reads 0 on an empty denominator."""
    value = numerator.cast("double") / denominator.cast("double") * F.lit(scale)
    return F.when(denominator == 0, F.lit(0.0)).otherwise(value)


def seconds(duration_ms: Column) -> Column:
    return F.greatest(duration_ms, F.lit(1)).cast("double") / F.lit(1000.0)


def hp_percent(hp: Column, max_hp: Column) -> Column:
    return F.when(
        hp.isNotNull() & max_hp.isNotNull() & (max_hp != 0),
        hp.cast("double") / max_hp.cast("double") * F.lit(100.0),
    )


def normalise(text: Column) -> Column:
    return F.lower(F.trim(text))
