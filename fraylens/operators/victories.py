"""Victory triggers of encounter definitions as rows, met by equality joins.

A trigger tree becomes one row a leaf and key: which signal of an event it wants, the
id or name it looks for, and filters on the event's actors. Events carry the same keys,
so a hit is an equality on (signal, key) and a few column tests; nothing is folded and
no definition reaches the driver.

Only triggers that an event decides by itself are met: casts, effects, damage,
healing, threat, deaths, new targets and boss health. A trigger on the state of a pull
(counters, phases, timers, shields, elapsed time, first appearances, changes of charges,
the local player's target) cannot end a pull before the pull is known; ``mechanics``
evaluates those.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.operators.challenges import compared
from fraylens.operators.segment import PULL

#: Signals of the trigger kinds, and where each lists what it looks for.
SIGNALS = {
    "abilityCast": ("cast", "abilities"), "effectApplied": ("applied", "effects"), "effectRemoved": ("removed", "effects"),
    "damageTaken": ("damage", "abilities"), "damageDealt": ("damage", "abilities"), "healingTaken": ("heal", "abilities"),
    "healingDealt": ("heal", "abilities"), "threatModified": ("threat", "abilities"), "entityDeath": ("death", "selector"),
    "targetSet": ("aim", "selector"), "bossHpBelow": ("health", "selector"), "bossHpAbove": ("health", "selector"),
}
_FILTER = "struct<kind:string,ids:array<string>,names:array<string>>"
_LEAF = (
    f"definition_id string, bosses array<string>, signal string, key string, source {_FILTER}, target {_FILTER}, mitigation array<string>, threat double, "
    "low double, high double, position array<struct<entity:string,axis:string,operator:string,value:double>>"
)
#: Filters that look at nothing but the actor; the others need the state of a pull.
_FILTERS = {"any", "player", "otherPlayer", "notLocal", "localPlayer", "npc", "boss", "add", "selector"}


def _leaves(trigger: dict) -> Iterator[dict]:
    if trigger["kind"] == "anyOf":
        for part in trigger["conditions"]:
            yield from _leaves(part)
    elif trigger["kind"] in SIGNALS and all((trigger.get(side) or {"kind": "any"})["kind"] in _FILTERS for side in ("source", "target")):
        yield trigger


def _chosen(selectors: list[dict] | None) -> tuple[list[str], list[str]]:
    ids = [str(s["id"]) for s in selectors or [] if s.get("id") is not None]
    return ids, [s["name"].strip().lower() for s in selectors or [] if s.get("id") is None]


def _filter(given: dict | None) -> dict | None:
    if given is None or given["kind"] == "any":
        return None
    ids, names = _chosen(given.get("selectors"))
    return {"kind": given["kind"], "ids": ids, "names": names}


def _rows(definition_id: str, bosses: list[str], body: str) -> Iterator[tuple]:
    trigger = json.loads(body).get("victoryTrigger")
    for leaf in _leaves(trigger) if trigger else ():
        signal, listed = SIGNALS[leaf["kind"]]
        ids, names = _chosen(leaf.get(listed))
        sided = signal not in ("death", "health")
        limits = {"bossHpBelow": (None, leaf.get("percent")), "bossHpAbove": (leaf.get("percent"), None)}.get(leaf["kind"], (None, None))
        source, target = (_filter(leaf.get("source")) if sided and signal != "aim" else None), (_filter(leaf.get("target")) if sided else None)
        placed = [] if signal in ("aim", "health") else [{**c, "entity": "target" if signal == "death" else c["entity"], "value": float(c["value"])} for c in leaf.get("position") or []]
        for key in [f"id:{i}" for i in ids] + [f"name:{n}" for n in names] or ["*"]:
            yield definition_id, bosses, signal, key, source, target, leaf.get("mitigation") or [], leaf.get("threat"), *limits, placed


def trigger_rows(encounter_defs: DataFrame) -> DataFrame:
    """One row a leaf of a victory trigger and thing it looks for (``*``: anything)."""
    columns = [c.split()[0] for c in _LEAF.split(", ")]

    def run(batches):
        for batch in batches:
            found = [r for d in batch.itertuples(index=False) for r in _rows(d.id, list(d.boss_npc_ids if d.boss_npc_ids is not None else []), d.definition_json)]
            yield pd.DataFrame(found, columns=columns)

    return encounter_defs.select("id", "boss_npc_ids", "definition_json").mapInPandas(run, _LEAF)


def _signals() -> Column:
    """What an event tells: signal, id and name of what it is about, and health left in percent."""

    def said(signal: str, when: Column, id_: Column, name: Column, percent: Column | None = None) -> Column:
        left = F.lit(None).cast("double") if percent is None else percent
        return F.when(when, F.struct(F.lit(signal).alias("signal"), id_.alias("id"), F.lower(F.trim(F.coalesce(name, F.lit("")))).alias("name"), left.alias("percent")))

    kind, ability, effect = F.col("type"), (F.col("ability_id"), F.col("ability_name")), (F.col("effect_id"), F.col("effect_name"))
    known = F.col("ability_id").isNotNull()
    struck = (kind == "damage") & (F.col("target_kind") == "npc") & F.col("target_hp").isNotNull() & (F.col("target_max_hp") > 0)
    told = [
        said("cast", (kind == "ability") & (F.col("phase") == "activate") & known, *ability),
        said("applied", (kind == "applyEffect") & F.col("effect_id").isNotNull(), *effect),
        said("removed", (kind == "removeEffect") & F.col("effect_id").isNotNull(), *effect),
        said("damage", (kind == "damage") & known, *ability), said("heal", (kind == "heal") & known, *ability),
        said("threat", kind.isin("threat", "taunt") & known, *ability),
        said("death", (kind == "death") & F.col("target_kind").isNotNull(), F.col("target_npc_id"), F.col("target_name")),
        said("aim", (kind == "target") & (F.col("state") == "set") & F.col("source_kind").isNotNull(), F.col("source_npc_id"), F.col("source_name")),
        said("health", struck, F.col("target_npc_id"), F.col("target_name"), F.col("target_hp") / F.col("target_max_hp") * 100),
    ]
    return F.filter(F.array(*told), lambda s: s.isNotNull())


def _suits(side: str) -> Column:
    f, kind, id_, npc = F.col(f"{side}_filter"), F.col(f"{side}_kind"), F.col(f"{side}_id"), F.col(f"{side}_npc_id")
    boss, local = F.coalesce(F.array_contains("bosses", npc), F.lit(False)), F.col("local_player_id")
    name = F.lower(F.trim(F.coalesce(f"{side}_name", F.lit(""))))
    everything = (F.size(f["ids"]) == 0) & (F.size(f["names"]) == 0)
    test = (
        F.when(f["kind"] == "player", kind == "player").when(f["kind"] == "otherPlayer", (kind == "player") & ~id_.eqNullSafe(local))
        .when(f["kind"] == "notLocal", ~id_.eqNullSafe(local)).when(f["kind"] == "localPlayer", (kind == "player") & id_.eqNullSafe(local))
        .when(f["kind"] == "npc", kind == "npc").when(f["kind"] == "boss", boss).when(f["kind"] == "add", npc.isNotNull() & ~boss)
        .otherwise(everything | F.coalesce(F.array_contains(f["ids"], npc), F.lit(False)) | F.array_contains(f["names"], name))
    )
    return f.isNull() | (kind.isNotNull() & F.coalesce(test, F.lit(False)))


def _placed(c: Column) -> Column:
    place = F.when(c["entity"] == "source", F.col("source_pos")).when(c["entity"] == "target", F.col("target_pos"))
    on = F.when(c["axis"] == "x", place["x"]).when(c["axis"] == "y", place["y"]).when(c["axis"] == "z", place["z"]).when(c["axis"] == "facing", place["facing"])
    return F.coalesce(compared(on, c["operator"], c["value"]), F.lit(False))


#: Signal of the row that every event keeps when it is met with the rules.
_SELF = "."


def with_hits(events: DataFrame, encounter_defs: DataFrame, own_rows: bool = True) -> DataFrame:
    """Every event once with a null ``hit`` (``own_rows``), and once more for each definition (``hit``) whose trigger a signal of it meets.

    No aggregate, so it also works on a stream. ``events`` need ``local_player_id``.
    """
    columns = events.columns
    rules = trigger_rows(encounter_defs).withColumnsRenamed({"source": "source_filter", "target": "target_filter", "mitigation": "avoid", "threat": "moves"})
    keyed = F.flatten(F.transform(_signals(), lambda s: F.filter(F.array(*[
        F.when(k.isNotNull(), F.struct(s["signal"].alias("signal"), k.alias("key"), s["percent"].alias("percent")))
        for k in (F.concat(F.lit("id:"), s["id"]), F.concat(F.lit("name:"), s["name"]), F.lit("*"))
    ]), lambda k: k.isNotNull())))
    own = F.array(F.struct(F.lit(_SELF).alias("signal"), F.lit("").alias("key"), F.lit(None).cast("double").alias("percent")))
    told = events.withColumn("__told", F.explode(F.concat(own, keyed) if own_rows else keyed)).select(*columns, "__told.*")
    met = told.join(rules, ["signal", "key"], "left" if own_rows else "inner")
    fits = (
        F.col("definition_id").isNotNull() & _suits("source") & _suits("target")
        & ((F.size("avoid") == 0) | F.coalesce(F.array_contains("avoid", F.col("mitigation")), F.lit(False)))
        & (F.col("moves").isNull() | F.coalesce(F.col("moves") == F.col("threat"), F.lit(False)))
        & (F.col("low").isNull() | (F.col("percent") >= F.col("low"))) & (F.col("high").isNull() | (F.col("percent") <= F.col("high")))
        & F.forall("position", _placed)
    )
    return met.where((F.col("signal") == _SELF) | fits).select(*columns, F.col("definition_id").alias("hit"))


def victory_hits(events: DataFrame, encounter_defs: DataFrame) -> DataFrame:
    """(log_id, line_number, victory_of): definitions whose victory trigger an event meets.

    ``events`` need ``local_player_id`` (``segment.session_context``).
    """
    columns = [
        "log_id", "line_number", "type", "phase", "state", "local_player_id", "mitigation", "threat", "ability_id", "ability_name", "effect_id", "effect_name",
        "target_hp", "target_max_hp", *[f"{s}_{c}" for s in ("source", "target") for c in ("kind", "id", "npc_id", "name", "pos")],
    ]
    met = with_hits(events.select(*columns), encounter_defs, own_rows=False)
    return met.groupBy("log_id", "line_number").agg(F.sort_array(F.collect_set("hit")).alias("victory_of"))


def runtime_wins(tagged: DataFrame, hits: DataFrame, bindings: DataFrame) -> DataFrame:
    """First line of every pull at which the trigger of the definition bound there was met; the first one holds from the start."""
    order = Window.partitionBy(*PULL).orderBy("at_line")
    held = bindings.select(
        *PULL, "definition_id", F.when(F.lag("at_line").over(order).isNotNull(), F.col("at_line")).otherwise(F.lit(-1)).alias("after"), F.lead("at_line").over(order).alias("until")
    )
    met = tagged.select(*PULL, "line_number", "ts_ms").join(hits.withColumn("definition_id", F.explode("victory_of")), ["log_id", "line_number"])
    inside = (F.col("line_number") > F.col("after")) & (F.col("until").isNull() | (F.col("line_number") <= F.col("until")))
    won = met.join(held, [*PULL, "definition_id"]).where(inside)
    return won.groupBy(*PULL).agg(F.min(F.struct("line_number", "ts_ms", "definition_id")).alias("w")).select(*PULL, "w.*")
