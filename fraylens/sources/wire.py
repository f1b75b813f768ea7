"""Event batches from clients: ``{sessionId, sequence, events: [...]}`` as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.schemas import EVENT

BATCH_SCHEMA = f"sessionId string, sequence bigint, events array<{EVENT}>"

#: Most events in one batch, and the longest texts accepted.
MAX_BATCH_EVENTS = 500
_ENUMS = {
    "phase": ("activate", "deactivate", "cancel", "interrupt"),
    "direction": ("spend", "restore"),
    "difficulty": ("Story", "Veteran", "Master"),
    "role": ("tank", "healer", "dps"),
}
_DAMAGE = ("kinetic", "energy", "internal", "elemental")
_MITIGATION = ("miss", "dodge", "parry", "deflect", "immune", "resist", "shield", "unknown")
_REQUIRED = {
    "damage": ("value",), "heal": ("value",), "applyEffect": ("effect",), "removeEffect": ("effect",), "modifyCharges": ("effect",),
    "resource": ("direction", "resource", "amount"), "ability": ("phase",), "combatState": ("state",), "death": ("revived",),
    "revived": ("revived",), "target": ("state",), "taunt": (), "threat": (), "fallingDamage": ("amount",), "areaEntered": ("zone",),
    "disciplineChanged": ("advancedClass", "discipline"), "other": ("category",), "unknown": ("raw", "reason"),
}
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def read_batches(raw: DataFrame, column: str = "value") -> DataFrame:
    """Raw JSON text with its parsed batch; text that is no batch parses to null."""
    return raw.withColumn("batch", F.from_json(F.col(column), BATCH_SCHEMA))


def _within(text: Column, limit: int) -> Column:
    return text.isNull() | (F.length(text) <= limit)


def _entity_ok(entity: Column) -> Column:
    present = entity["name"].isNotNull() & entity["id"].isNotNull()
    return entity.isNull() | (present & _within(entity["name"], 128) & _within(entity["id"], 32))


def _actor_ok(actor: Column) -> Column:
    is_player, is_npc = actor["kind"] == "player", actor["kind"] == "npc"
    player = is_player & actor["playerId"].isNotNull() & _within(actor["playerId"], 32) & _within(actor["name"], 64)
    npc = is_npc & actor["npcId"].isNotNull() & _within(actor["npcId"], 32) & _within(actor["instanceId"], 32) & _within(actor["name"], 128)
    return actor.isNull() | (actor["name"].isNotNull() & F.coalesce(player | npc, F.lit(False)))


def _value_ok(value: Column) -> Column:
    magnitude = (
        (value["kind"] == "magnitude") & value["amount"].isNotNull() & value["critical"].isNotNull() & value["reflected"].isNotNull()
        & (value["damageType"].isNull() | value["damageType"].isin(*_DAMAGE))
        & (value["mitigation"].isNull() | value["mitigation"].isin(*_MITIGATION))
    )
    charges = (value["kind"] == "charges") & value["charges"].isNotNull()
    return value.isNull() | F.coalesce(magnitude | charges, F.lit(False))


def event_fault(event: Column) -> Column:
    """Why an event does not fit the schema of its type, or null when it does."""
    kind = event["type"]

    def fault(broken: Column, reason: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(reason))

    missing = F.lit(False)
    for name, fields in _REQUIRED.items():
        for field in fields:
            missing = missing | ((kind == name) & event[field].isNull())
    enums = F.lit(False)
    for field, allowed in _ENUMS.items():
        enums = enums | (event[field].isNotNull() & ~event[field].isin(*allowed))
    states = F.when(kind == "combatState", ~event["state"].isin("enter", "exit")).when(kind == "target", ~event["state"].isin("set", "cleared")).otherwise(False)
    revived = F.when(kind == "death", event["revived"]).when(kind == "revived", ~event["revived"]).otherwise(False)
    sizes = event["groupSize"].isNotNull() & ~event["groupSize"].isin(4, 8, 16)
    hits_magnitude = kind.isin("damage", "heal") & (event["value"]["kind"] != "magnitude")
    entities = F.lit(True)
    for field in ("ability", "effect", "category", "resource", "zone", "advancedClass", "discipline"):
        entities = entities & _entity_ok(event[field])
    long_text = ~(_within(event["serverId"], 32) & _within(event["logVersion"], 32) & _within(event["raw"], 4096) & _within(event["reason"], 256))
    return F.coalesce(
        fault(~kind.isin(*_REQUIRED), "unknown event type"),
        fault((event["timestamp"] < 0) | (event["lineNumber"] < 0), "bad timestamp or line number"),
        fault(missing, "missing field"),
        fault(enums | states | revived | sizes, "value outside its enumeration"),
        fault(~(_actor_ok(event["source"]) & _actor_ok(event["target"])), "bad actor"),
        fault(~entities, "bad named entity"),
        fault(hits_magnitude | ~_value_ok(event["value"]), "bad value"),
        fault(long_text, "text too long"),
    )


def check_batches(batches: DataFrame) -> DataFrame:
    """Batches with the reason they are rejected, null for good ones; one bad event rejects its batch."""
    batch = F.col("batch")
    first_fault = F.array_compact(F.transform(batch["events"], event_fault))
    reason = (
        F.when(batch.isNull() | batch["events"].isNull(), "not a batch")
        .when(~F.coalesce(batch["sessionId"].rlike(_UUID), F.lit(False)), "bad session id")
        .when(F.coalesce(batch["sequence"] < 0, F.lit(True)), "bad sequence")
        .when(F.size(batch["events"]) > MAX_BATCH_EVENTS, "too many events")
        .otherwise(F.try_element_at(first_fault, F.lit(1)))
    )
    return batches.withColumn("reason", reason)


def accepted_events(checked: DataFrame) -> DataFrame:
    """Events of good batches, in batch order."""
    good = checked.filter(F.col("reason").isNull())
    exploded = good.select(F.col("batch.sessionId").alias("session_id"), F.col("batch.sequence").alias("sequence"), F.explode("batch.events").alias("e"))
    return exploded.select("session_id", "sequence", "e.*")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def first_hellos(hellos: DataFrame) -> DataFrame:
    """The hello that opened each session; a repeated hello resumes it and changes nothing."""
    others = [c for c in hellos.columns if c != "session_id"]
    first = hellos.groupBy("session_id").agg(F.min_by(F.struct(*others), F.col("arrived_at")).alias("h"))
    return first.select("session_id", "h.*")
