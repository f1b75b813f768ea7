"""Challenges and victory triggers on small hand-made pulls."""

import json

import pytest
from pyspark.sql import functions as F

from fraylens.operators import segment, victories
from fraylens.operators.challenges import Challenges
from fraylens.options import Options
from fraylens.plans.fights import Fights
from fraylens.sources.catalog import Catalog
from tests.build import BEM, CATALOG_ROWS, HYDRA, ORLA, RAT, WARDEN, area, cast, combat_state, damage, event, flat, heal


def challenge(id_, metric, *conditions, **more):
    return {"id": id_, "name": id_, "metric": metric, "enabled": True, "difficulties": [], "conditions": list(conditions), **more}


DEFINITION = {
    "entityNpcIds": {"rats": ["n501"]},
    "phases": [
        {"id": "calm", "order": 1, "startTrigger": {"kind": "combatStart"}},
        {"id": "storm", "order": 2, "startTrigger": {"kind": "abilityCast", "abilities": [{"id": "gust"}]}, "endTrigger": {"kind": "abilityCast", "abilities": [{"id": "lull"}]}},
    ],
    "counters": [{"id": "gusts", "incrementOn": {"kind": "abilityCast", "abilities": [{"id": "gust"}]}}],
    "challenges": [
        challenge("calm hits", "damage", {"type": "phase", "phase_ids": ["calm"]}),
        challenge("storm hits", "damage", {"type": "phase", "phase_ids": ["storm"]}, {"type": "target", "match": {"selector": ["glass warden", "rats"]}}),
        challenge("after a gust", "effective_healing", {"type": "counter", "counter_id": "gusts", "operator": "gte", "value": 1}),
        challenge("weak", "damage", {"type": "boss_hp_range", "max_hp": 30}),
        challenge("piles", "effect_stacks", {"type": "effect", "effect_ids": ["glow"]}),
        challenge("story only", "damage", difficulties=["Story"]), challenge("off", "damage", enabled=False), challenge("odd", "damage", {"type": "moon"}),
    ],
}


def warden(share):
    return {**WARDEN, "hp": int(share * WARDEN["max_hp"])}


def glow(ts, type_, charges=None):
    return event(ts, type_, BEM, BEM, effect_id="glow", effect_name="Glow", charges=charges)


FIGHT = [
    area(0), combat_state(1_000, "enter"), damage(1_000, ORLA, warden(0.9), 100), damage(2_000, BEM, RAT, 7), glow(2_500, "applyEffect", 2), glow(2_600, "modifyCharges", 5),
    cast(3_000, WARDEN, ORLA, "gust", "Gust"), damage(4_000, ORLA, warden(0.3), 40), heal(4_500, BEM, 90, 60), glow(4_600, "removeEffect"), damage(5_000, BEM, RAT, 3),
    damage(5_500, BEM, HYDRA, 2), cast(6_000, WARDEN, ORLA, "lull", "Lull"), damage(7_000, ORLA, warden(0.5), 11), glow(7_500, "applyEffect"), damage(8_000, ORLA, warden(0.2), 5),
]


@pytest.fixture(scope="module")
def fights(spark):
    catalog = Catalog.from_rows(spark, {**CATALOG_ROWS, "encounter_defs": [("warden", "Warden", ["n500"], json.dumps(DEFINITION))]})
    return Fights(flat(spark, FIGHT), catalog, Options())


def test_challenges(fights):
    totals = {r.challenge_id: (r.value, r.event_count, r.duration_ms) for r in fights.challenges.totals.collect()}
    assert totals == {
        "calm hits": (107.0, 2, 2_000), "storm hits": (43.0, 2, 3_000), "after a gust": (60.0, 1, 5_000),
        "weak": (40.0 + 3 + 2 + 5, 4, 4_000), "piles": (6.0, 2, 7_000), "odd": (0.0, 0, 7_000),
    }
    players = {(r.challenge_id, r.player_name): (r.value, round(r.percent, 3)) for r in fights.challenges.players.collect()}
    assert players["calm hits", "Orla"] == (100.0, 93.458) and players["storm hits", "Bem"] == (3.0, 6.977) and players["piles", "Bem"] == (6.0, 100.0)
    assert isinstance(fights.challenges, Challenges) and ("odd", "Orla") not in players


def hits(spark, trigger, rows):
    defs = Catalog.from_rows(spark, {"encounter_defs": [("d", "D", ["n500"], json.dumps({"victoryTrigger": trigger}))]}).encounter_defs
    events = segment.session_context(flat(spark, rows), Options())
    return [r.line_number for r in victories.victory_hits(events, defs).where(F.array_contains("victory_of", "d")).orderBy("line_number").collect()]


@pytest.mark.parametrize(
    ("trigger", "lines"),
    [
        ({"kind": "damageDealt", "abilities": [], "source": {"kind": "player"}}, []),  # these hits name no ability
        ({"kind": "abilityCast", "abilities": [{"id": "gust"}, {"name": " LULL "}]}, [7, 13]),
        ({"kind": "abilityCast", "abilities": [], "target": {"kind": "localPlayer"}, "source": {"kind": "boss"}}, [7, 13]),
        ({"kind": "anyOf", "conditions": [{"kind": "effectRemoved", "effects": [{"id": "glow"}]}, {"kind": "anyOf", "conditions": [{"kind": "bossHpBelow", "percent": 20, "selector": [{"name": "Glass Warden"}]}]}]}, [10, 16]),
        ({"kind": "effectApplied", "effects": [{"id": "glow"}], "target": {"kind": "otherPlayer"}}, [5, 15]),
        ({"kind": "counterReaches", "counterId": "x", "value": 1}, []), ({"kind": "never"}, []),
    ],
)
def test_victory_hits(spark, trigger, lines):
    assert hits(spark, trigger, FIGHT) == lines


def test_a_trigger_shortens_the_silence(spark):
    """With the trigger met the pull ends after 3 s of silence, so a hit at 10.5 s opens the next one."""
    rows = [area(0), damage(1_000, ORLA, WARDEN), damage(6_000, ORLA, WARDEN), cast(7_000, BEM, BEM, "bow", "Bow"), damage(10_500, BEM, WARDEN), damage(15_500, BEM, WARDEN)]
    ends = {}
    for name, trigger in [("met", {"kind": "abilityCast", "abilities": [{"id": "bow"}]}), ("not met", {"kind": "never"})]:
        catalog = Catalog.from_rows(spark, {**CATALOG_ROWS, "encounter_defs": [("d", "D", ["n500"], json.dumps({"victoryTrigger": trigger}))]})
        fights = Fights(flat(spark, rows), catalog, Options())
        ends[name] = sorted((r.started_at, r.ended_at) for r in fights.pulls.collect())
        assert [r.cleared for r in fights.outcomes.orderBy("started_at").collect()][0] == (name == "met")
    assert ends == {"met": [(1_000, 7_000), (10_500, 15_500)], "not met": [(1_000, 15_500)]}
