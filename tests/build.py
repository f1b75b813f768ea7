"""Small hand-made events and catalogue rows for the tests."""

from fraylens.schemas import FLAT_COLUMNS

FLAT_TYPES = {
    "line_number": "bigint", "ts_ms": "bigint", "source_hp": "bigint", "source_max_hp": "bigint",
    "target_hp": "bigint", "target_max_hp": "bigint", "amount": "double", "effective": "double",
    "critical": "boolean", "absorbed": "double", "reflected": "boolean", "charges": "double", "threat": "double",
    "group_size": "int", "source_pos": "struct<x:double,y:double,z:double,facing:double>",
    "target_pos": "struct<x:double,y:double,z:double,facing:double>",
}
FLAT_SCHEMA = "log_id string, " + ", ".join(f"{c} {FLAT_TYPES.get(c, 'string')}" for c in FLAT_COLUMNS)


def who(kind, id_, name, npc_id=None, hp=None, max_hp=None, pos=None):
    return {"kind": kind, "id": id_, "name": name, "npc_id": npc_id, "hp": hp, "max_hp": max_hp, "pos": pos}


ORLA = who("player", "p7", "Orla", hp=640, max_hp=700)
BEM = who("player", "p9", "Bem", hp=580, max_hp=580)
WARDEN = who("npc", "w-31", "Glass Warden", "n500", 2_400_000, 9_600_000)
RAT = who("npc", "v-4", "Cave Rat", "n501", 1_500, 1_500)
HYDRA = who("npc", "h-2", "Tide Hydra", "n502", 900_000, 1_000_000)
OBELISK = who("npc", "o-8", "Mirror Obelisk", "n503", 70_000, 70_000)


def event(ts, type_, source=None, target=None, **fields):
    row = {"ts_ms": ts, "type": type_, **fields}
    for side, actor in (("source", source), ("target", target)):
        for key, value in (actor or {}).items():
            row[f"{side}_{key}"] = value
    return row


def damage(ts, source, target, amount=1000, **fields):
    fields = {"effective": amount, "critical": False, "damage_type": "energy", **fields}
    return event(ts, "damage", source, target, amount=amount, **fields)


def heal(ts, source, amount, effective):
    return event(ts, "heal", source, source, amount=amount, effective=effective, critical=False)


def cast(ts, source, target, id_, name):
    return event(ts, "ability", source, target, phase="activate", ability_id=id_, ability_name=name)


def death(ts, victim):
    return event(ts, "death", None, victim)


def combat_state(ts, state):
    return event(ts, "combatState", ORLA, state=state)


def area(ts):
    return event(ts, "areaEntered", ORLA, zone_name="Salt Caverns", zone_id="z77", server_id="s3", group_size=4, difficulty="Veteran")


def discipline(ts, player, name, role):
    return event(ts, "disciplineChanged", player, advanced_class="Sentry", discipline=name, role=role)


def flat(spark, rows, log_id="log"):
    """Rows (or {log: rows}) to a flat event table; line numbers count from one."""
    logs = rows if isinstance(rows, dict) else {log_id: rows}
    out = []
    for log, events in logs.items():
        for number, row in enumerate(events, 1):
            full = {"line_number": number, **row}
            out.append(tuple([log] + [_cast(c, full.get(c)) for c in FLAT_COLUMNS]))
    return spark.createDataFrame(out, FLAT_SCHEMA)


def _cast(column, value):
    return float(value) if FLAT_TYPES.get(column) == "double" and value is not None else value


def phase(order, name, trigger, style="Style"):
    return (None, order, name, style, trigger, None)


def encounter(id_, bosses, operation="op", order=1, catalog_order=1, requires=(), adds=(), ids=(), add_ids=(),
              single=(), victory="Boss defeated", phases=()):
    return (id_, id_.title(), operation, order, catalog_order, list(bosses), list(requires), list(adds), list(ids),
            list(add_ids), list(single), victory, list(phases) or [phase(1, "Only", "Encounter start")])


CATALOG_ROWS = {
    "operations": [
        ("salt", "Salt Caverns", "", ["z77"], ["salt caverns"], False, ["Story", "Veteran", "Master"], [4, 8]),
        ("peak", "Howling Peak", "", [], ["howling peak"], False, ["Story", "Veteran"], [8]),
    ],
    "encounters": [
        encounter("peak_obelisk", ["mirror obelisk", "obelisk"], "peak", 1, 1, victory="Prism puzzle aligned"),
        encounter("peak_hydra", ["tide hydra"], "peak", 2, 2, phases=[
            phase(1, "Scales", "Encounter start"), phase(2, "Venom", "Under 66% health"), phase(3, "Rage", "33%")]),
        encounter("salt_warden", ["glass warden"], "salt", 1, 3, adds=["Shardling"], ids=["n500"]),
        encounter("salt_twins", ["ember twin", "frost twin"], "salt", 2, 4, requires=["ember twin", "frost twin"]),
    ],
    "npc_catalog": [],
    "off_gcd": [("free-1",)],
    "interrupts": [("snap",)],
}
