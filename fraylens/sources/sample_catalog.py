"""Catalogue that goes with the projected test table (``fraylens.sources.tables``)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from fraylens.sources.catalog import Catalog


def _phase(order, name, trigger, death=None):
    return (None, order, name, "", trigger, death)


def _challenge(id_, metric, *conditions, enabled=True, difficulties=()):
    return {"id": id_, "name": id_.title(), "metric": metric, "enabled": enabled, "difficulties": list(difficulties), "conditions": list(conditions)}


ROWS = {
    "operations": [
        ("opa", "Alpha Station", "North", ["z0"], ["zone 0"], False, ["Story", "Veteran"], [4, 8]),
        ("opb", "Beta Vault", "South", ["z9"], ["zone 1"], False, ["Story", "Veteran", "Master"], [8, 16]),
        ("opc", "Gamma Lair", "West", ["z2"], [], True, ["Master"], [8]),
    ],
    # id, name, operation, order, catalogue order, bosses, required, adds, boss ids, add ids, single, victory, phases
    "encounters": [
        ("e1", "Gate Keeper", "opa", 1, 1, ["alpha warden"], [], ["Drone"], ["0"], ["8"], [], "Boss defeated",
         [_phase(1, "Opening", "Encounter start"), _phase(2, "Burn", "Below 40% or 25%")]),
        ("e2", "Twin Lords", "opa", 2, 2, ["beta lord", "gamma lord"], ["beta lord", "gamma lord"], [], ["1", "2"], [],
         ["beta lord"], "Both bosses defeated",
         [_phase(1, "Opening", "Encounter start"), _phase(2, "Split", "At 70%", "gamma lord"), _phase(3, "Fury", "At 20%")]),
        ("e3", "Vault Puzzle", "opb", 1, 3, ["vault core"], [], [], [], [], [], "Puzzle core aligned",
         [_phase(1, "Rings", "Encounter start"), _phase(2, "Ability 5", "Ring lock")]),
        ("e4", "Night Beast", "opb", 2, 4, ["night beast"], [], ["Swarm"], ["4"], [], ["night beast"], "Boss defeated",
         [_phase(1, "Hunt", "Encounter start"), _phase(2, "Frenzy", "50%")]),
        ("e5", "Lair Queen", "opc", 1, 5, ["beta lord"], [], [], [], [], [], "All lords defeated",
         [_phase(1, "Nest", "Encounter start")]),
    ],
    "npc_catalog": [
        ("0", "Alpha Warden", ["Alpha Warden"], "boss", True, True, False, "e1", "Gate Keeper", "Alpha Station", "a", False),
        ("1", "Beta Lord", ["Beta Lord"], "boss", True, True, True, "e2", "Twin Lords", "Alpha Station", "a", False),
        ("2", "Gamma Lord", ["Gamma Lord"], "boss", True, True, False, "e2", "Twin Lords", "Alpha Station", "a", False),
        ("4", "Night Beast", ["Night Beast"], "boss", True, True, True, "e4", "Night Beast", "Beta Vault", "b", False),
        ("6", "Drone Tender", ["Drone Tender"], "mechanic", False, False, False, "e1", "Gate Keeper", "Alpha Station", "a", False),
    ],
    "observed": [("e4", "Night Beast", "5", "z1", "Veteran", 8, 6_000_000)],
    "abilities": [(str(i), f"Known {i}", "tech" if i % 2 else "ranged", "energy" if i % 3 else "kinetic") for i in range(0, 20, 3)],
    "off_gcd": [(str(i),) for i in range(0, 20, 4)],
    "interrupts": [("0",), ("10",)],
    "encounter_defs": [
        ("d1", "Gate Keeper", ["0"], json.dumps({
            "entityNpcIds": {},
            "victoryTrigger": {"kind": "anyOf", "conditions": [
                {"kind": "effectApplied", "effects": [{"id": "4"}], "source": {"kind": "player"}}, {"kind": "entityDeath", "selector": [{"id": "7"}]},
            ]},
            "phases": [
                {"id": "open", "order": 1, "name": "Opening", "startTrigger": {"kind": "combatStart"}},
                {"id": "burn", "order": 2, "name": "Burn", "startTrigger": {"kind": "counterReaches", "counterId": "hits", "value": 2}, "resetsCounters": ["hits"]},
            ],
            "counters": [{"id": "hits", "name": "Hits", "incrementOn": {"kind": "damageDealt", "abilities": [], "source": {"kind": "player"}}}],
            "timers": [{"id": "t", "name": "T", "trigger": {"kind": "phaseEntered", "phaseId": "burn"}, "durationMs": 1_800_000, "enabled": True, "canRefresh": False}],
            "challenges": [
                _challenge("open-damage", "damage", {"type": "phase", "phase_ids": ["open"]}, {"type": "source", "match": "any_player"}),
                _challenge("burn-heal", "effective_healing", {"type": "phase", "phase_ids": ["burn"]}),
                _challenge("low-boss", "damage", {"type": "boss_hp_range", "npc_id": 0, "max_hp": 50}, {"type": "target", "match": "boss"}),
                _challenge("armed", "damage_taken", {"type": "counter", "counter_id": "hits", "operator": "lte", "value": 3}),
                _challenge("kicks", "interrupt_count"),
                _challenge("off", "damage", enabled=False),
            ],
        })),
        ("d2", "Twin Lords", ["1", "2"], json.dumps({
            "victoryTrigger": {"kind": "bossHpBelow", "percent": 3, "selector": [{"id": "1"}, {"name": "Npc 2"}]},
            "phases": [{"id": "all", "order": 1, "name": "All", "startTrigger": {"kind": "combatStart"}}],
            "shields": [{"id": "s", "targetNpcIds": ["1", "2"], "hp": [{"total": 900, "difficulties": []}],
                         "startTrigger": {"kind": "npcAppears", "selector": [{"id": "1"}, {"id": "2"}]}, "endTrigger": {"kind": "entityDeath", "selector": [{"id": "1"}]}}],
            "entityNpcIds": {"crew": ["5"]},
            "challenges": [
                _challenge("casts", "ability_count", {"type": "target", "match": "any_player"}, {"type": "ability", "ability_ids": ["2", "3", 4]}),
                _challenge("marks", "effect_count", {"type": "effect", "effect_ids": ["0", "2"]}, {"type": "source", "match": "any_except_local"}),
                _challenge("stacks", "effect_stacks", {"type": "effect", "effect_ids": ["1", "3", "5"]}),
                _challenge("soaked", "damage_absorbed", {"type": "target", "match": {"selector": ["npc 2", 1, "crew"]}}),
                _challenge("mid-band", "healing", {"type": "boss_hp_range", "min_hp": 30, "max_hp": 60}),
                _challenge("mended", "healing_taken", {"type": "target", "match": "other_players"}, difficulties=["Story", "Veteran"]),
                _challenge("focus", "damage", {"type": "target", "match": "current_target"}),
            ],
        })),
    ],
    "defensives": [("Ward", "0", "self"), ("Iron Skin", None, "absorb"), ("Guard", "5", "external")],
}


def sample_catalog(spark: SparkSession) -> Catalog:
    return Catalog.from_rows(spark, ROWS)
