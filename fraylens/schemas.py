"""Schemas of the event table.

Parsing and the wire use the nested form; operators work on the flat form, whose
narrow columns prune well in a columnar scan.  Order inside a log is
``line_number``, never time: timestamps may step backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = "struct<name:string,id:string>"
ACTOR = (
    "struct<kind:string,name:string,playerId:string,npcId:string,instanceId:string,"
    "position:struct<x:double,y:double,z:double,facing:double>,hp:bigint,maxHp:bigint>"
)
VALUE = (
    "struct<kind:string,amount:double,effective:double,critical:boolean,damageType:string,"
    "mitigation:string,absorbed:double,reflected:boolean,charges:double>"
)

#: Payload of one event as it travels in a batch (JSON) and as the parser emits it.
EVENT_FIELDS = {
    "timestamp": "bigint",
    "lineNumber": "bigint",
    "type": "string",
    "source": ACTOR,
    "target": ACTOR,
    "ability": NAMED,
    "threat": "double",
    "value": VALUE,
    "effect": NAMED,
    "category": NAMED,
    "charges": "double",
    "resource": NAMED,
    "direction": "string",
    "amount": "double",
    "phase": "string",
    "state": "string",
    "revived": "boolean",
    "zone": NAMED,
    "serverId": "string",
    "groupSize": "int",
    "difficulty": "string",
    "logVersion": "string",
    "advancedClass": NAMED,
    "discipline": NAMED,
    "role": "string",
    "raw": "string",
    "reason": "string",
}
EVENT = "struct<" + ",".join(f"{k}:{v}" for k, v in EVENT_FIELDS.items()) + ">"

FLAT_COLUMNS = [
    "line_number", "ts_ms", "type", "phase", "state",
    "source_kind", "source_id", "source_name", "source_npc_id", "source_hp", "source_max_hp", "source_pos",
    "target_kind", "target_id", "target_name", "target_npc_id", "target_hp", "target_max_hp", "target_pos",
    "ability_id", "ability_name", "effect_id", "effect_name", "category_name",
    "amount", "effective", "critical", "damage_type", "mitigation", "absorbed", "reflected", "charges", "threat",
    "zone_id", "zone_name", "server_id", "group_size", "difficulty",
    "advanced_class", "discipline", "role",
]


def _actor_columns(side: str):
    actor = F.col(side)
    is_player = actor["kind"] == "player"
    return [
        actor["kind"].alias(f"{side}_kind"),
        F.when(is_player, actor["playerId"])
        .otherwise(F.coalesce(actor["instanceId"], actor["npcId"]))
        .alias(f"{side}_id"),
        actor["name"].alias(f"{side}_name"),
        actor["npcId"].alias(f"{side}_npc_id"),
        actor["hp"].alias(f"{side}_hp"),
        actor["maxHp"].alias(f"{side}_max_hp"),
        actor["position"].alias(f"{side}_pos"),
    ]


def flatten(events: DataFrame, *keep: str) -> DataFrame:
    """Nested events to the flat operator schema; ``keep`` names the key columns to carry."""
    value = F.col("value")
    return events.select(
        *keep,
        F.col("lineNumber").alias("line_number"),
        F.col("timestamp").alias("ts_ms"),
        "type", "phase", "state",
        *_actor_columns("source"),
        *_actor_columns("target"),
        F.col("ability.id").alias("ability_id"),
        F.col("ability.name").alias("ability_name"),
        F.col("effect.id").alias("effect_id"),
        F.col("effect.name").alias("effect_name"),
        F.col("category.name").alias("category_name"),
        F.coalesce(value["amount"], F.col("amount")).alias("amount"),
        value["effective"].alias("effective"),
        F.coalesce(value["critical"], F.lit(False)).alias("critical"),
        value["damageType"].alias("damage_type"),
        value["mitigation"].alias("mitigation"),
        value["absorbed"].alias("absorbed"),
        F.coalesce(value["reflected"], F.lit(False)).alias("reflected"),
        F.coalesce(F.col("charges"), value["charges"]).alias("charges"),
        "threat",
        F.col("zone.id").alias("zone_id"),
        F.col("zone.name").alias("zone_name"),
        F.col("serverId").alias("server_id"),
        F.col("groupSize").alias("group_size"),
        "difficulty",
        F.col("advancedClass.name").alias("advanced_class"),
        F.col("discipline.name").alias("discipline"),
        "role",
    )
