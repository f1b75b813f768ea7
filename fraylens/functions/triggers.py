"""Triggers and conditions of encounter definitions, compiled once into predicates.

A signal is a small dict (``kind`` plus what the kind carries); entities are
dicts with ``kind``, ``id``, ``npc_id``, ``name`` and ``pos``.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

Predicate = Callable[[dict], bool]

_COMPARE = {
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge,
}


def compare(left, how: str, right) -> bool:
    test = _COMPARE.get(how)
    return test is not None and test(left, right)


def _selects(selectors: list[dict] | None) -> Callable[[str | None, str], bool]:
    """An id decides when the selector has one, else the name; no selectors select everything."""
    ids = {s["id"] for s in selectors or [] if s.get("id") is not None}
    names = {s["name"].strip().lower() for s in selectors or [] if s.get("id") is None}
    if not selectors:
        return lambda id_, name: True
    return lambda id_, name: id_ in ids or (name or "").strip().lower() in names


_FILTERS: dict[str, Callable[[dict, dict], bool]] = {
    "player": lambda e, s: e["kind"] == "player",
    "otherPlayer": lambda e, s: e["kind"] == "player" and e["id"] != s["local"],
    "notLocal": lambda e, s: e["id"] != s["local"],
    "localPlayer": lambda e, s: e["kind"] == "player" and e["id"] == s["local"],
    "npc": lambda e, s: e["kind"] == "npc",
    "boss": lambda e, s: e["npc_id"] is not None and e["npc_id"] in s["bosses"],
    "add": lambda e, s: e["npc_id"] is not None and e["npc_id"] not in s["bosses"],
    "currentTarget": lambda e, s: e["id"] == s["aim"],
}


def _entity(filter_: dict | None) -> Callable[[dict | None, dict], bool]:
    if filter_ is None or filter_["kind"] == "any":
        return lambda e, s: True
    if filter_["kind"] == "selector":
        chosen = _selects(filter_["selectors"])
        return lambda e, s: e is not None and chosen(e["npc_id"], e["name"])
    test = _FILTERS[filter_["kind"]]
    return lambda e, s: e is not None and test(e, s)


def _placed(constraints: list[dict] | None, pick: Callable[[dict, str], dict | None]) -> Predicate:
    def check(signal: dict) -> bool:
        for c in constraints or []:
            entity = pick(signal, c["entity"])
            position = entity and entity.get("pos")
            if not position or not compare(position[c["axis"]], c["operator"], c["value"]):
                return False
        return True

    return check


def _sided(trigger: dict) -> Predicate:
    source, target = _entity(trigger.get("source")), _entity(trigger.get("target"))
    placed = _placed(trigger.get("position"), lambda s, side: s.get(side))
    return lambda s: source(s.get("source"), s) and target(s.get("target"), s) and placed(s)


def _named(signal_kind: str, field: str, selectors: str) -> Callable[[dict], Predicate]:
    def build(trigger: dict) -> Predicate:
        chosen, sided = _selects(trigger[selectors]), _sided(trigger)
        mitigations = set(trigger.get("mitigation") or [])
        threat = trigger.get("threat")

        def check(s: dict) -> bool:
            thing = s.get(field)
            return (
                s["kind"] == signal_kind and thing is not None and chosen(*thing) and sided(s)
                and (not mitigations or s.get("mitigation") in mitigations) and (threat is None or s.get("threat") == threat)
            )

        return check

    return build


def _charges(trigger: dict) -> Predicate:
    chosen = _selects(trigger.get("effects")) if trigger["kind"] == "chargesChanged" else lambda id_, name: True
    direction = trigger.get("direction")

    def check(s: dict) -> bool:
        if s["kind"] != "chargesChanged" or not chosen(*s["effect"]):
            return False
        before, now = s.get("before"), s.get("charges")
        if direction is None or before is None or now is None:
            return True
        return now > before if direction == "increase" else now < before

    return check


def _health(trigger: dict) -> Predicate:
    chosen = _selects(trigger["selector"]) if trigger.get("selector") is not None else None
    below, limit = trigger["kind"] == "bossHpBelow", trigger["percent"]

    def check(s: dict) -> bool:
        if s["kind"] != "bossHp":
            return False
        entity = s.get("entity") or s.get("target")
        if chosen is not None and (entity is None or not chosen(entity["npc_id"], entity["name"])):
            return False
        return s["percent"] <= limit if below else s["percent"] >= limit

    return check


def _appearance(trigger: dict) -> Predicate:
    chosen = _selects(trigger["selector"])
    target = _entity(trigger.get("target"))
    kind = trigger["kind"]
    other = "source" if kind == "targetSet" else "target"

    def about(s: dict) -> dict | None:
        return s.get("entity") or s.get(other)

    placed = _placed(trigger.get("position"), lambda s, _side: about(s))

    def check(s: dict) -> bool:
        entity = about(s) if s["kind"] == kind else None
        if entity is None or not chosen(entity["npc_id"], entity["name"]):
            return False
        return target(s.get("target"), s) if kind == "targetSet" else placed(s)

    return check


def _elapsed(trigger: dict) -> Predicate:
    limit = trigger["seconds"] * 1000
    return lambda s: s["kind"] == "timeElapsed" and s["elapsed"] >= limit and s["elapsed_before"] < limit


def _keyed(signal_kind: str, field: str, key: str) -> Callable[[dict], Predicate]:
    return lambda t: lambda s: s["kind"] == signal_kind and s[field] == t[key]


def _reaches(t: dict) -> Predicate:
    return lambda s: s["kind"] == "counterChanged" and s["counter"] == t["counterId"] and s["now"] == t["value"] and s["before"] != t["value"]


def _any(trigger: dict) -> Predicate:
    parts = [compile_trigger(c) for c in trigger["conditions"]]
    return lambda s: any(p(s) for p in parts)


_BUILDERS: dict[str, Callable[[dict], Predicate]] = {
    "combatStart": lambda t: lambda s: s["kind"] == "combatStart",
    "combatEnd": lambda t: lambda s: s["kind"] == "combatEnd",
    "abilityCast": _named("abilityCast", "ability", "abilities"),
    "effectApplied": _named("effectApplied", "effect", "effects"),
    "effectRemoved": _named("effectRemoved", "effect", "effects"),
    "damageTaken": _named("damage", "ability", "abilities"),
    "damageDealt": _named("damage", "ability", "abilities"),
    "healingTaken": _named("healing", "ability", "abilities"),
    "healingDealt": _named("healing", "ability", "abilities"),
    "threatModified": _named("threatModified", "ability", "abilities"),
    "chargesChanged": _charges,
    "selfChargesChanged": _charges,
    "bossHpBelow": _health,
    "bossHpAbove": _health,
    "npcAppears": _appearance,
    "entityDeath": _appearance,
    "targetSet": _appearance,
    "phaseEntered": _keyed("phaseEntered", "phase", "phaseId"),
    "phaseEnded": _keyed("phaseEnded", "phase", "phaseId"),
    "anyPhaseChange": lambda t: lambda s: s["kind"] in ("phaseEntered", "phaseEnded"),
    "counterReaches": _reaches,
    "counterChanges": _keyed("counterChanged", "counter", "counterId"),
    "timerExpires": _keyed("timerExpires", "timer", "timerId"),
    "timerStarted": _keyed("timerStarted", "timer", "timerId"),
    "timerCanceled": _keyed("timerCanceled", "timer", "timerId"),
    "timeElapsed": _elapsed,
    "manual": lambda t: lambda s: s["kind"] == "manual",
    "never": lambda t: lambda s: False,
    "anyOf": _any,
}


def compile_trigger(trigger: dict | None) -> Predicate:
    """Predicate over signals; a missing trigger never matches."""
    return (lambda s: False) if trigger is None else _BUILDERS[trigger["kind"]](trigger)


def check_condition(condition: dict, state) -> bool:
    """Evaluates a condition against ``state`` (``counter``, ``phase_order``, ``phase_id``, ``remaining_ms``)."""
    kind = condition["kind"]
    if kind == "allOf":
        return all(check_condition(c, state) for c in condition["conditions"])
    if kind == "anyOf":
        return any(check_condition(c, state) for c in condition["conditions"])
    if kind == "not":
        return not check_condition(condition["condition"], state)
    if kind == "phaseActive":
        by_order = state.phase_order in (condition.get("phaseOrders") or [])
        return by_order or (state.phase_id is not None and state.phase_id in (condition.get("phaseIds") or []))
    if kind == "counterCompare":
        return compare(state.counter(condition["counterId"]), condition["operator"], condition["value"])
    if kind == "counterCompareCounter":
        return compare(state.counter(condition["counterId"]), condition["operator"], state.counter(condition["otherCounterId"]))
    return compare(state.remaining_ms(condition["timerId"]) / 1000, condition["operator"], condition["seconds"])
