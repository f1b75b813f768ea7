"""ANSI-SQL twins of the registered queries, for checking results in another engine.

Every statement is a chain of common table expressions over the given tables.
They restate the semantics with plain windows and aggregates and share nothing
with the Spark plans but the projection of the event table.
"""

from __future__ import annotations

from fraylens.functions import fixed
from fraylens.sources.sample_catalog import ROWS
from fraylens.sources.tables import SCALED_OPTIONS as O
from fraylens.sources.tables import combat_sql

DIALECT = {"ts": "epoch_us(ts)//1000", "k": "json_extract_string(props, '$.k')"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _values(columns: str, rows: list) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def _exploded(position: int) -> list:
    return [(row[0], item) for row in ROWS["encounters"] for item in row[position]]


_PLAYER_SOURCE = "source_kind = 'player'"
_RAID = "type = 'damage' AND source_kind = 'player' AND target_kind = 'npc'"
_ON_PLAYER = "type = 'damage' AND target_kind = 'player'"

CTES: dict[str, str] = {
    "ev": combat_sql(DIALECT),
    "ops": _values("operation_id, operation_name, is_lair", [(r[0], r[1], r[5]) for r in ROWS["operations"]]),
    "op_zone_ids": _values("operation_id, zone_id", [(r[0], z) for r in ROWS["operations"] for z in r[3]]),
    "op_zone_names": _values("operation_id, zone_name", [(r[0], z) for r in ROWS["operations"] for z in r[4]]),
    "enc": _values(
        "encounter_id, encounter_name, operation_id, enc_order, catalog_order, victory_event",
        [(r[0], r[1], r[2], r[3], r[4], r[11]) for r in ROWS["encounters"]],
    ),
    "enc_boss": _values("encounter_id, name", _exploded(5)),
    "enc_req": _values("encounter_id, name", _exploded(6)),
    "enc_adds": _values("encounter_id, name", _exploded(7)),
    "enc_boss_ids": _values("encounter_id, npc_id", _exploded(8)),
    "enc_add_ids": _values("encounter_id, npc_id", _exploded(9)),
    "enc_single": _values("encounter_id, name", _exploded(10)),
    "enc_phases": _values(
        "encounter_id, phase_order, name, threshold, death_name",
        [
            (r[0], p[1], p[2].lower(), max(map(float, __import__("re").findall(r"(\d+)%", p[4])), default=None), p[5])
            for r in ROWS["encounters"] for p in r[12]
        ],
    ),
    "npc": _values("npc_id, name, role", [(r[0], r[1], r[3]) for r in ROWS["npc_catalog"]]),
    "observed": _values("encounter_id, npc_id", [(r[0], r[2]) for r in ROWS["observed"]]),
    "abil": _values("ability_id, name, attack_type, damage_type", ROWS["abilities"]),
    "offgcd": _values("ability_id", ROWS["off_gcd"]),
    "kicks": _values("ability_id", ROWS["interrupts"]),
    "defs": _values("name, effect_id, category", ROWS["defensives"]),
    "disc": _values("discipline, role, combat_style", fixed.table(fixed.DISCIPLINES)),
    # Context in force at every event.
    "ctx": """
SELECT *, z.zone_id AS ctx_zone_id, z.zone_name AS ctx_zone_name, z.difficulty AS ctx_difficulty, z.group_size AS ctx_group_size FROM (
 SELECT ev.*,
  last_value(CASE WHEN type = 'areaEntered' THEN {'zone_id': zone_id, 'zone_name': zone_name, 'difficulty': difficulty, 'group_size': group_size} END IGNORE NULLS)
   OVER w AS z,
  last_value(CASE WHEN type = 'areaEntered' THEN server_id END IGNORE NULLS) OVER w AS ctx_server_id,
  first_value(CASE WHEN type IN ('areaEntered', 'combatState') AND source_kind = 'player' THEN source_id END IGNORE NULLS) OVER w AS local_player_id
 FROM ev WINDOW w AS (PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "prior": """
SELECT *, max(ts_ms) OVER (PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_ts FROM ctx""",
    "indexed": f"""
SELECT *, CAST(sum(CASE WHEN prior_ts IS NULL OR ts_ms - prior_ts >= {O.idle_ms} THEN 1 ELSE 0 END)
 OVER (PARTITION BY log_id ORDER BY line_number) AS BIGINT) AS pull_index FROM prior""",
    "sessioned": """
SELECT *, concat(CAST(first_value(ts_ms) OVER (PARTITION BY log_id, pull_index ORDER BY line_number) AS VARCHAR), '-', CAST(pull_index AS VARCHAR)) AS pull_id
FROM indexed""",
    "pulls": """
SELECT log_id, pull_id, pull_index, arg_min(ts_ms, line_number) AS started_at, max(ts_ms) AS ended_at,
 min(line_number) AS start_line, max(line_number) AS last_line, count(*) AS event_count,
 max(ts_ms) - arg_min(ts_ms, line_number) AS duration_ms,
 CASE WHEN pull_index < max(pull_index) OVER (PARTITION BY log_id) THEN 'sustained-silence' ELSE 'stream-ended' END AS end_reason,
 first(ctx_zone_id ORDER BY line_number) AS ctx_zone_id, first(ctx_zone_name ORDER BY line_number) AS ctx_zone_name,
 first(ctx_difficulty ORDER BY line_number) AS ctx_difficulty, first(ctx_group_size ORDER BY line_number) AS ctx_group_size,
 first(ctx_server_id ORDER BY line_number) AS ctx_server_id, first(local_player_id ORDER BY line_number) AS local_player_id
FROM sessioned GROUP BY log_id, pull_id, pull_index""",
    "t": """
SELECT *, coalesce(effective, amount) AS ap, greatest(0, amount - coalesce(effective, amount)) AS lost
FROM sessioned WHERE type NOT IN ('areaEntered', 'disciplineChanged')""",
    # Actors.
    "dealt": f"""
SELECT log_id, pull_id, source_id AS actor_id, min(line_number) AS first_line, sum(ap) AS damage,
 count(*) FILTER (amount > 0) AS damage_hits, count(*) FILTER (critical) AS critical_hits,
 sum(CASE WHEN critical THEN ap ELSE 0 END) AS critical_damage, sum(lost) AS lost,
 sum(CASE WHEN target_hp IS NULL THEN 0 ELSE greatest(0, ap - target_hp) END) AS overkill, sum(coalesce(threat, 0)) AS threat
FROM t WHERE {_RAID} GROUP BY ALL""",
    "taken": f"""
SELECT log_id, pull_id, target_id AS actor_id, min(line_number) AS first_line, sum(ap) AS damage_taken, sum(coalesce(absorbed, 0)) AS absorbed,
 count(*) AS incoming_attacks, count(*) FILTER (amount > 0) AS incoming_hits,
 count(*) FILTER (amount = 0 AND mitigation IS NOT NULL) AS defenses, count(*) FILTER (mitigation = 'shield') AS shielded_hits, sum(lost) AS lost
FROM t WHERE {_ON_PLAYER} GROUP BY ALL""",
    "healed": f"""
SELECT log_id, pull_id, source_id AS actor_id, min(line_number) AS first_line, sum(ap) AS healing, sum(lost) AS overhealing,
 count(*) AS healing_events, count(*) FILTER (critical) AS healing_critical_hits
FROM t WHERE type = 'heal' AND {_PLAYER_SOURCE} GROUP BY ALL""",
    "acted": f"""
SELECT log_id, pull_id, source_id AS actor_id, min(line_number) AS first_line, count(*) AS actions,
 count(*) FILTER (ability_id IN (SELECT ability_id FROM offgcd)) AS off_gcd_actions
FROM t WHERE type = 'ability' AND phase = 'activate' AND {_PLAYER_SOURCE} GROUP BY ALL""",
    "kicked": f"""
SELECT log_id, pull_id, source_id AS actor_id, min(line_number) AS first_line, count(*) AS interrupts
FROM t WHERE type = 'ability' AND phase = 'interrupt' AND ability_id IN (SELECT ability_id FROM kicks) AND {_PLAYER_SOURCE} GROUP BY ALL""",
    "fell": """
SELECT log_id, pull_id, target_id AS actor_id, min(line_number) AS first_line, count(*) AS deaths
FROM t WHERE type = 'death' AND target_kind = 'player' GROUP BY ALL""",
    "actor_keys": " UNION ALL ".join(
        f"SELECT log_id, pull_id, actor_id, first_line FROM {c}" for c in ("dealt", "taken", "healed", "acted", "kicked", "fell")
    ),
    "actors": """
SELECT k.log_id, k.pull_id, k.actor_id, concat('Player ', k.actor_id) AS name, k.first_line,
 CAST(coalesce(d.damage, 0) AS BIGINT) AS damage, CAST(coalesce(h.healing, 0) AS BIGINT) AS healing,
 CAST(coalesce(h.overhealing, 0) AS BIGINT) AS overhealing, CAST(coalesce(x.damage_taken, 0) AS BIGINT) AS damage_taken,
 CAST(coalesce(x.absorbed, 0) AS BIGINT) AS absorbed, coalesce(a.actions, 0) AS actions,
 coalesce(a.actions, 0) - coalesce(a.off_gcd_actions, 0) AS on_gcd_actions, coalesce(a.off_gcd_actions, 0) AS off_gcd_actions,
 coalesce(i.interrupts, 0) AS interrupts, coalesce(d.damage_hits, 0) AS damage_hits, coalesce(h.healing_events, 0) AS healing_events,
 coalesce(h.healing_critical_hits, 0) AS healing_critical_hits, coalesce(x.incoming_attacks, 0) AS incoming_attacks,
 coalesce(x.incoming_hits, 0) AS incoming_hits, coalesce(x.defenses, 0) AS defenses, coalesce(x.shielded_hits, 0) AS shielded_hits,
 coalesce(d.critical_hits, 0) AS critical_hits, CAST(coalesce(d.critical_damage, 0) AS BIGINT) AS critical_damage,
 CAST(coalesce(d.lost, 0) + coalesce(x.lost, 0) AS BIGINT) AS mitigated_damage, CAST(coalesce(d.overkill, 0) AS BIGINT) AS overkill,
 CAST(coalesce(d.threat, 0) AS BIGINT) AS threat, coalesce(f.deaths, 0) AS deaths
FROM (SELECT log_id, pull_id, actor_id, min(first_line) AS first_line FROM actor_keys GROUP BY ALL) k
LEFT JOIN dealt d USING (log_id, pull_id, actor_id) LEFT JOIN taken x USING (log_id, pull_id, actor_id)
LEFT JOIN healed h USING (log_id, pull_id, actor_id) LEFT JOIN acted a USING (log_id, pull_id, actor_id)
LEFT JOIN kicked i USING (log_id, pull_id, actor_id) LEFT JOIN fell f USING (log_id, pull_id, actor_id)""",
    "declared": """
SELECT log_id, source_id AS actor_id, line_number, advanced_class, discipline, role FROM ev WHERE type = 'disciplineChanged' AND source_kind = 'player'""",
    "rostered": """
SELECT a.*, r.discipline, r.role AS declared_role, coalesce(r.advanced_class, s.combat_style) AS combat_style, p.duration_ms
FROM actors a ASOF LEFT JOIN declared r ON a.log_id = r.log_id AND a.actor_id = r.actor_id AND a.first_line >= r.line_number
LEFT JOIN disc s ON s.discipline = r.discipline JOIN pulls p ON p.log_id = a.log_id AND p.pull_id = a.pull_id""",
    "rated": """
SELECT *, damage / secs AS dps, healing / secs AS hps, damage_taken / secs AS dtps, actions / secs * 60.0 AS apm,
 CASE WHEN healing + overhealing = 0 THEN 0 ELSE overhealing / (healing + overhealing) * 100.0 END AS overheal_percent,
 CASE WHEN damage_hits = 0 THEN 0 ELSE critical_hits / damage_hits * 100.0 END AS damage_crit_percent,
 CASE WHEN healing_events = 0 THEN 0 ELSE healing_critical_hits / healing_events * 100.0 END AS healing_crit_percent,
 CASE WHEN incoming_attacks = 0 THEN 0 ELSE defenses / incoming_attacks * 100.0 END AS defense_percent,
 CASE WHEN incoming_hits = 0 THEN 0 ELSE shielded_hits / incoming_hits * 100.0 END AS shield_percent,
 CASE WHEN declared_role IS NOT NULL THEN declared_role WHEN healing > 10000 AND healing > damage * 0.5 THEN 'healer'
  WHEN damage_taken > 50000 AND damage_taken > damage * 0.8 THEN 'tank' ELSE 'dps' END AS role
FROM (SELECT *, CAST(greatest(duration_ms, 1) AS DOUBLE) / 1000.0 AS secs FROM rostered)""",
    "typed": f"""
SELECT log_id, pull_id, source_id AS actor_id, damage_type, mitigation, ap, lost FROM t WHERE {_RAID}
UNION ALL SELECT log_id, pull_id, target_id, damage_type, mitigation, ap, lost FROM t WHERE {_ON_PLAYER}""",
    "bucketed": f"""
SELECT t.*, CAST(greatest(0, (ts_ms - p.started_at) // {O.bucket_ms}) AS BIGINT) AS bucket_index
FROM t JOIN pulls p USING (log_id, pull_id)""",
    # Enemies.
    "seen": f"""
SELECT *, (observed OR touched) AS counts FROM (
 SELECT log_id, pull_id, line_number, 0 AS slot, ts_ms, source_id AS instance_id, source_npc_id AS npc_id, source_name AS raw_name,
  source_hp AS hp, source_max_hp AS max_hp, source_max_hp > 0 AS observed, ({_ON_PLAYER}) AS touched, ({_ON_PLAYER}) AS fought, false AS died
 FROM t WHERE source_kind = 'npc'
 UNION ALL
 SELECT log_id, pull_id, line_number, 1, ts_ms, target_id, target_npc_id, target_name, target_hp, target_max_hp, target_max_hp > 0,
  (({_RAID}) OR type = 'death'), coalesce(({_RAID}), false), type = 'death'
 FROM t WHERE target_kind = 'npc')""",
    "enemies": """
SELECT log_id, pull_id, instance_id, s.npc_id, coalesce(n.name, s.raw_name) AS name, s.raw_name,
 CASE WHEN n.name IS NULL THEN 'log' ELSE 'catalog' END AS identity_source, first_seen_at,
 CASE WHEN NOT first_observed THEN first_seen_at ELSE fought_at END AS engaged_at, last_seen_at, died_at, max_hp, final_hp, deaths, first_line, first_slot
FROM (
 SELECT log_id, pull_id, instance_id, first(npc_id ORDER BY line_number, slot) AS npc_id, first(raw_name ORDER BY line_number, slot) AS raw_name,
  first(observed ORDER BY line_number, slot) AS first_observed, first(ts_ms ORDER BY line_number, slot) AS first_seen_at,
  last(ts_ms ORDER BY line_number, slot) AS last_seen_at, first(ts_ms ORDER BY line_number) FILTER (fought) AS fought_at,
  last(ts_ms ORDER BY line_number) FILTER (died) AS died_at, max(max_hp) FILTER (observed) AS max_hp,
  last(CASE WHEN died THEN 0 ELSE hp END ORDER BY line_number, slot) AS final_hp, count(*) FILTER (died) AS deaths,
  min(line_number) AS first_line, first(slot ORDER BY line_number, slot) AS first_slot
 FROM seen WHERE counts GROUP BY log_id, pull_id, instance_id) s LEFT JOIN npc n ON n.npc_id = s.npc_id""",
    "foe_rows": f"""
SELECT log_id, pull_id, line_number, ts_ms, target_id AS instance_id, source_id AS player_id, ap AS damage_taken, 0 AS damage_dealt,
 absorbed, critical, ap, lost, target_hp, threat, amount, damage_type, mitigation FROM t WHERE {_RAID}
UNION ALL SELECT log_id, pull_id, line_number, ts_ms, source_id, NULL, 0, ap, absorbed, critical, ap, lost, target_hp, threat, amount, damage_type, mitigation
FROM t WHERE type = 'damage' AND source_kind = 'npc' AND target_kind = 'player'""",
    "foe_players": """
SELECT log_id, pull_id, instance_id, player_id, CAST(sum(damage_taken) AS BIGINT) AS damage,
 count(*) FILTER (amount > 0) AS damage_hits, count(*) FILTER (critical) AS critical_hits,
 CAST(sum(CASE WHEN critical THEN ap ELSE 0 END) AS BIGINT) AS critical_damage, CAST(sum(lost) AS BIGINT) AS mitigated_damage,
 CAST(sum(CASE WHEN target_hp IS NULL THEN 0 ELSE greatest(0, ap - target_hp) END) AS BIGINT) AS overkill,
 CAST(sum(coalesce(threat, 0)) AS BIGINT) AS threat,
 first(ts_ms ORDER BY line_number) AS first_damage_at, last(ts_ms ORDER BY line_number) AS last_damage_at
FROM foe_rows WHERE player_id IS NOT NULL GROUP BY ALL""",
    # Abilities.
    "used": f"""
SELECT *, CASE WHEN type = 'ability' THEN 1 ELSE 0 END AS c, CASE WHEN type = 'damage' AND amount > 0 THEN 1 ELSE 0 END AS h,
 CASE WHEN type = 'damage' AND amount <= 0 THEN 1 ELSE 0 END AS m, CASE WHEN type = 'damage' AND amount > 0 AND critical THEN 1 ELSE 0 END AS cr,
 CASE WHEN type = 'damage' AND amount > 0 THEN ap ELSE 0 END AS dm,
 CASE WHEN type = 'damage' THEN CASE target_kind WHEN 'player' THEN concat('player:', target_id) WHEN 'npc' THEN concat('npc:', target_id) END END AS tgt
FROM t WHERE ((type = 'ability' AND phase = 'activate') OR type = 'damage') AND ability_id IS NOT NULL AND {_PLAYER_SOURCE}""",
    # Encounters.
    "engaged": f"""
SELECT g.*, coalesce(n.name, raw_name) AS canonical_name, lower(trim(coalesce(n.name, raw_name))) AS name FROM (
 SELECT log_id, pull_id, target_npc_id AS npc_id, target_name AS raw_name, min(line_number) AS first_line FROM t WHERE {_RAID} GROUP BY ALL) g
LEFT JOIN npc n USING (npc_id)""",
    "dead": """
SELECT g.*, coalesce(n.name, raw_name) AS canonical_name FROM (
 SELECT log_id, pull_id, target_npc_id AS npc_id, target_name AS raw_name, min(line_number) AS first_line
 FROM t WHERE type = 'death' AND target_kind = 'npc' GROUP BY ALL) g LEFT JOIN npc n USING (npc_id)""",
    # The sample definition bound at the end of a pull, and the line after which it took over from the other.
    "def_bound": """
SELECT log_id, pull_id, CASE WHEN f1 IS NULL AND f2 IS NULL THEN 'd1' WHEN f0 IS NULL OR least(f1, f2) < f0 OR (f1 IS NOT NULL AND f2 IS NOT NULL) THEN 'd2' ELSE 'd1' END AS definition_id,
 CASE WHEN f0 < least(f1, f2) AND f1 IS NOT NULL AND f2 IS NOT NULL THEN greatest(f1, f2) ELSE -1 END AS from_line
FROM (SELECT log_id, pull_id, min(first_line) FILTER (npc_id = '0') AS f0, min(first_line) FILTER (npc_id = '1') AS f1, min(first_line) FILTER (npc_id = '2') AS f2
 FROM engaged WHERE npc_id IN ('0', '1', '2') GROUP BY ALL)""",
    "triggered": """
SELECT log_id, line_number, 'd1' AS definition_id FROM ctx WHERE (type = 'applyEffect' AND effect_id = '4' AND source_kind = 'player') OR (type = 'death' AND target_npc_id = '7')
UNION ALL SELECT log_id, line_number, 'd2' FROM ctx
WHERE type = 'damage' AND target_kind = 'npc' AND target_max_hp > 0 AND (target_npc_id = '1' OR lower(trim(target_name)) = 'npc 2') AND target_hp / target_max_hp * 100 <= 3""",
    "def_won": """
SELECT DISTINCT b.log_id, b.pull_id FROM t JOIN triggered g USING (log_id, line_number) JOIN def_bound b ON b.log_id = t.log_id AND b.pull_id = t.pull_id
WHERE CASE g.definition_id WHEN 'd2' THEN b.definition_id = 'd2' AND line_number > from_line ELSE b.definition_id = 'd1' OR line_number <= from_line END""",
    "enc_all_ids": "SELECT encounter_id, npc_id FROM enc_boss_ids UNION SELECT encounter_id, npc_id FROM observed",
    "facts": """
SELECT log_id, pull_id, b.encounter_id, concat('n:', b.name) AS ev, 2 AS pts, min(first_line) AS first_line FROM engaged e JOIN enc_boss b USING (name) GROUP BY ALL
UNION ALL SELECT log_id, pull_id, encounter_id, 'id', 8, min(first_line) FROM engaged JOIN enc_all_ids USING (npc_id) GROUP BY ALL""",
    "scored": """
SELECT f.log_id, f.pull_id, f.encounter_id, catalog_order, count(*) FILTER (ev <> 'id') AS matched_bosses,
 CAST(sum(pts) + CASE WHEN (p.ctx_zone_id, any_value(enc.operation_id)) IN (SELECT zone_id, operation_id FROM op_zone_ids) THEN 6
  WHEN (lower(trim(p.ctx_zone_name)), any_value(enc.operation_id)) IN (SELECT zone_name, operation_id FROM op_zone_names) THEN 4 ELSE 0 END AS BIGINT) AS score
FROM facts f JOIN enc USING (encounter_id) JOIN pulls p ON p.log_id = f.log_id AND p.pull_id = f.pull_id
GROUP BY f.log_id, f.pull_id, f.encounter_id, catalog_order, p.ctx_zone_id, p.ctx_zone_name""",
    "matches": """
SELECT log_id, pull_id, encounter_id, matched_bosses, score FROM (
 SELECT *, row_number() OVER (PARTITION BY log_id, pull_id ORDER BY score DESC, catalog_order) AS rn FROM scored) WHERE rn = 1""",
    "step_scores": """
SELECT f.log_id, f.pull_id, m.at_line, f.encounter_id, catalog_order,
 sum(pts) + CASE WHEN (any_value(p.ctx_zone_id), any_value(enc.operation_id)) IN (SELECT zone_id, operation_id FROM op_zone_ids) THEN 6
  WHEN (lower(trim(any_value(p.ctx_zone_name))), any_value(enc.operation_id)) IN (SELECT zone_name, operation_id FROM op_zone_names) THEN 4 ELSE 0 END AS score
FROM facts f JOIN (SELECT DISTINCT log_id, pull_id, first_line AS at_line FROM facts) m ON m.log_id = f.log_id AND m.pull_id = f.pull_id AND f.first_line <= m.at_line
JOIN enc USING (encounter_id) JOIN pulls p ON p.log_id = f.log_id AND p.pull_id = f.pull_id
GROUP BY f.log_id, f.pull_id, m.at_line, f.encounter_id, catalog_order""",
    "steps": """
SELECT log_id, pull_id, at_line, encounter_id FROM (
 SELECT *, row_number() OVER (PARTITION BY log_id, pull_id, at_line ORDER BY score DESC, catalog_order) AS rn FROM step_scores) WHERE rn = 1""",
    "markers": _values("marker", [(m,) for m in fixed.VICTORY_MARKERS]),
    "said": """
SELECT log_id, pull_id, line_number, ts_ms, lower(concat_ws(' ', ability_name, spoken_effect, spoken_category)) AS text,
 concat_ws(' / ', ability_name, spoken_effect, spoken_category) AS said, CASE WHEN source_kind = 'player' THEN source_id END AS actor_id, target_npc_id
FROM (SELECT *, CASE WHEN type IN ('applyEffect', 'removeEffect') THEN effect_name END AS spoken_effect,
 CASE WHEN type = 'other' THEN category_name END AS spoken_category FROM t)""",
    "evidence": f"""
SELECT log_id, pull_id, ts_ms, said, actor_id, target_npc_id, line_number FROM (
 SELECT s.*, row_number() OVER (PARTITION BY s.log_id, s.pull_id ORDER BY s.line_number) AS rn
 FROM said s ASOF JOIN steps b ON s.log_id = b.log_id AND s.pull_id = b.pull_id AND s.line_number > b.at_line
 JOIN enc e ON e.encounter_id = b.encounter_id
 WHERE NOT regexp_matches(lower(e.victory_event), '{fixed.BOSS_DEFEAT_TEXT}')
  AND EXISTS (SELECT 1 FROM markers WHERE contains(lower(e.victory_event), marker) AND contains(s.text, marker))) WHERE rn = 1""",
    "dead_names": """
SELECT DISTINCT log_id, pull_id, lower(trim(raw_name)) AS name FROM dead UNION SELECT DISTINCT log_id, pull_id, lower(trim(canonical_name)) FROM dead""",
    "wanted": """
SELECT encounter_id, name, true AS every FROM enc_req UNION ALL SELECT encounter_id, name, false FROM enc_boss WHERE encounter_id NOT IN (SELECT encounter_id FROM enc_req)""",
    "cleared": """
SELECT log_id, pull_id, encounter_id,
 (evidence OR (wanted_n = 1 AND id_dead AND down = 0) OR CASE WHEN every THEN down = wanted_n ELSE down > 0 END) AS cleared
FROM (
 SELECT m.log_id, m.pull_id, m.encounter_id, count(*) AS wanted_n, count(d.name) AS down, bool_or(w.every) AS every,
  (m.log_id, m.pull_id) IN (SELECT log_id, pull_id FROM evidence UNION ALL SELECT log_id, pull_id FROM def_won) AS evidence,
  (m.log_id, m.pull_id, m.encounter_id) IN (SELECT log_id, pull_id, encounter_id FROM dead JOIN enc_boss_ids USING (npc_id)) AS id_dead
 FROM matches m JOIN wanted w USING (encounter_id)
 LEFT JOIN dead_names d ON d.log_id = m.log_id AND d.pull_id = m.pull_id AND d.name = w.name GROUP BY m.log_id, m.pull_id, m.encounter_id)""",
    "health": """
SELECT log_id, pull_id, kind, npc_id, max(max_hp) AS max_hp, last(hp ORDER BY line_number, slot) AS hp,
 first(name ORDER BY max_hp DESC, line_number, slot) AS seen_name FROM (
 SELECT log_id, pull_id, line_number, 0 AS slot, source_kind AS kind, source_npc_id AS npc_id, source_name AS name, source_hp AS hp, source_max_hp AS max_hp FROM t WHERE source_max_hp > 0
 UNION ALL SELECT log_id, pull_id, line_number, 1, target_kind, target_npc_id, target_name, target_hp, target_max_hp FROM t WHERE target_max_hp > 0)
GROUP BY log_id, pull_id, kind, npc_id""",
    "boss": f"""
SELECT b.log_id, b.pull_id, b.npc_id AS boss_npc_id, b.name AS boss_name, b.max_hp AS boss_max_hp, b.hp AS boss_hp,
 CAST(b.hp AS DOUBLE) / b.max_hp * 100.0 AS boss_hp_percent,
 ((b.log_id, b.pull_id) IN (SELECT log_id, pull_id FROM matches)
  OR b.max_hp >= coalesce((SELECT max(max_hp) FROM health q WHERE q.log_id = b.log_id AND q.pull_id = b.pull_id AND q.kind = 'player') * {O.boss_health_multiple}, {O.boss_absolute_floor})) AS is_likely_boss
FROM (
 SELECT e.log_id, e.pull_id, e.npc_id, max_hp, hp, CASE WHEN canonical_name <> raw_name THEN canonical_name ELSE seen_name END AS name,
  row_number() OVER (PARTITION BY e.log_id, e.pull_id ORDER BY max_hp DESC, first_line) AS rn
 FROM engaged e JOIN health h ON h.log_id = e.log_id AND h.pull_id = e.pull_id AND h.npc_id = e.npc_id AND h.kind = 'npc') b WHERE rn = 1""",
    "took_part": f"""
SELECT DISTINCT log_id, pull_id, source_id AS player_id FROM t
WHERE ({_RAID}) OR (type = 'heal' AND {_PLAYER_SOURCE}) OR (type = 'ability' AND phase = 'activate' AND {_PLAYER_SOURCE})""",
    "pdeaths": """
SELECT log_id, pull_id, target_id AS player_id, target_name AS name, line_number AS death_line, ts_ms AS died_at FROM t WHERE type = 'death' AND target_kind = 'player'""",
    "outcomes": """
SELECT p.*, m.encounter_id, coalesce(c.cleared, false) AS cleared, b.boss_npc_id, b.boss_name, b.boss_max_hp, b.boss_hp, b.boss_hp_percent, b.is_likely_boss,
 CASE WHEN m.encounter_id IS NOT NULL AND c.cleared THEN 'kill'
  WHEN m.encounter_id IS NULL AND (p.log_id, p.pull_id, b.boss_npc_id) IN (SELECT log_id, pull_id, npc_id FROM dead) THEN 'kill'
  WHEN coalesce(w.wiped, false) THEN 'wipe'
  WHEN m.encounter_id IS NOT NULL OR coalesce(b.is_likely_boss, false) THEN CASE WHEN end_reason = 'sustained-silence' THEN 'wipe' ELSE 'incomplete' END
  WHEN (p.log_id, p.pull_id) IN (SELECT log_id, pull_id FROM dead) THEN 'kill'
  WHEN (p.log_id, p.pull_id) IN (SELECT log_id, pull_id FROM pdeaths) THEN 'wipe' ELSE 'incomplete' END AS outcome,
 (SELECT count(DISTINCT player_id) FROM pdeaths q WHERE q.log_id = p.log_id AND q.pull_id = p.pull_id) AS players_dead,
 (SELECT count(*) FROM pdeaths q WHERE q.log_id = p.log_id AND q.pull_id = p.pull_id) AS player_deaths
FROM pulls p LEFT JOIN matches m USING (log_id, pull_id) LEFT JOIN cleared c USING (log_id, pull_id) LEFT JOIN boss b USING (log_id, pull_id)
LEFT JOIN (
 SELECT a.log_id, a.pull_id, bool_and((a.log_id, a.pull_id, a.player_id) IN (SELECT log_id, pull_id, player_id FROM pdeaths)) AS wiped
 FROM took_part a JOIN pulls q ON q.log_id = a.log_id AND q.pull_id = a.pull_id
 WHERE q.local_player_id IS NULL OR q.local_player_id <> a.player_id GROUP BY a.log_id, a.pull_id) w ON w.log_id = p.log_id AND w.pull_id = p.pull_id""",
    "roles": """
SELECT e.*, m.encounter_id,
 CASE WHEN (m.encounter_id, e.npc_id) IN (SELECT encounter_id, npc_id FROM enc_boss_ids) THEN 'boss'
  WHEN (m.encounter_id, e.npc_id) IN (SELECT encounter_id, npc_id FROM enc_add_ids) THEN 'mechanic'
  WHEN n.role IS NOT NULL THEN n.role
  WHEN (m.encounter_id, lower(trim(e.name))) IN (SELECT encounter_id, name FROM enc_boss) THEN 'boss'
  WHEN EXISTS (SELECT 1 FROM enc_adds a WHERE a.encounter_id = m.encounter_id AND contains(lower(trim(e.name)), lower(trim(a.name)))) THEN 'mechanic'
  ELSE 'unknown' END AS role
FROM enemies e JOIN matches m ON m.log_id = e.log_id AND m.pull_id = e.pull_id LEFT JOIN npc n ON n.npc_id = e.npc_id""",
    "first_boss": """
SELECT log_id, pull_id, instance_id AS boss_instance_id, CASE WHEN max_hp <> 0 AND final_hp IS NOT NULL THEN CAST(final_hp AS DOUBLE) / max_hp * 100.0 END AS remaining FROM (
 SELECT *, row_number() OVER (PARTITION BY log_id, pull_id ORDER BY first_line, first_slot) AS rn FROM roles WHERE role = 'boss') WHERE rn = 1""",
    "fights": """
SELECT o.*, f.boss_instance_id, f.remaining, CAST(coalesce(d.damage, 0) AS BIGINT) AS damage FROM outcomes o
LEFT JOIN first_boss f ON f.log_id = o.log_id AND f.pull_id = o.pull_id
LEFT JOIN (SELECT log_id, pull_id, sum(damage) AS damage FROM dealt GROUP BY ALL) d ON d.log_id = o.log_id AND d.pull_id = o.pull_id""",
    "trash": """
SELECT e.log_id, 'trash' AS kind, concat(e.pull_id, ':', e.instance_id) AS fight_id, e.name AS subject,
 coalesce(e.engaged_at, e.first_seen_at) AS started_at, coalesce(e.died_at, o.ended_at) AS ended_at,
 greatest(0, coalesce(e.died_at, o.ended_at) - coalesce(e.engaged_at, e.first_seen_at)) AS duration_ms,
 CASE WHEN e.died_at IS NULL THEN o.outcome ELSE 'kill' END AS outcome
FROM enemies e JOIN outcomes o ON o.log_id = e.log_id AND o.pull_id = e.pull_id
WHERE o.encounter_id IS NULL AND (e.log_id, e.pull_id, e.instance_id) IN (SELECT log_id, pull_id, instance_id FROM foe_players)""",
    # Effects and audits.
    "fx": """
SELECT log_id, pull_id, line_number, ts_ms, type, effect_id, effect_name, charges, target_id, source_id,
 sum(CASE WHEN type IN ('applyEffect', 'removeEffect') THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, pull_id, effect_id, target_id ORDER BY line_number) AS w
FROM t WHERE type IN ('applyEffect', 'removeEffect', 'modifyCharges') AND target_kind IS NOT NULL""",
    "fx_named": """
SELECT t.*, coalesce(a.name, b.name) AS defensive, coalesce(a.category, b.category) AS category FROM t
LEFT JOIN (SELECT * FROM defs WHERE effect_id IS NOT NULL) a ON a.effect_id = t.effect_id
LEFT JOIN defs b ON lower(b.name) = lower(trim(t.effect_name))
WHERE type IN ('applyEffect', 'removeEffect') AND coalesce(a.name, b.name) IS NOT NULL""",
    "victims": f"""
SELECT log_id, pull_id, line_number, ts_ms, target_id AS player_id, type AS kind, ability_name AS ability, source_name AS source, amount, ap AS effective, critical,
 CASE WHEN type = 'damage' THEN absorbed END AS absorbed, CASE WHEN type = 'damage' THEN mitigation END AS mitigation, NULL AS defensive_category,
 target_hp AS hp, CASE WHEN target_hp IS NOT NULL AND target_max_hp <> 0 THEN CAST(target_hp AS DOUBLE) / target_max_hp * 100.0 END AS hp_percent
FROM t WHERE type IN ('damage', 'heal') AND target_kind = 'player'
UNION ALL
SELECT log_id, pull_id, line_number, ts_ms, player_id, CASE type WHEN 'applyEffect' THEN 'defensive' ELSE 'defensiveEnd' END, defensive, source_name, 0, 0, false, NULL, NULL, category,
 CASE WHEN lands THEN target_hp END, CASE WHEN lands AND target_hp IS NOT NULL AND target_max_hp <> 0 THEN CAST(target_hp AS DOUBLE) / target_max_hp * 100.0 END
FROM (
 SELECT *, target_id AS player_id, true AS lands FROM fx_named WHERE target_kind = 'player'
 UNION ALL SELECT *, source_id, false FROM fx_named WHERE {_PLAYER_SOURCE} AND NOT (target_kind = 'player' AND target_id = source_id))""",
    "audit": f"""
SELECT d.log_id, d.pull_id, d.player_id, d.death_line, d.died_at, v.* EXCLUDE (log_id, pull_id, player_id), d.died_at - v.ts_ms AS offset_ms
FROM pdeaths d JOIN victims v ON v.log_id = d.log_id AND v.pull_id = d.pull_id AND v.player_id = d.player_id
 AND v.ts_ms BETWEEN d.died_at - {O.audit_window_ms} AND d.died_at""",
    # Signups over the orders table.
    "signups": """
SELECT o_custkey AS operation_id, o_orderkey % 40 AS user_id, concat('User ', CAST(o_orderkey % 40 AS VARCHAR(20))) AS display_name,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('Char ', CAST(o_orderkey % 40 AS VARCHAR(20))) END AS character_name,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'tank' WHEN '2-HIGH' THEN 'healer' WHEN '3-MEDIUM' THEN 'dps' WHEN '4-NOT SPECIFIED' THEN 'bench' ELSE 'declined' END AS status,
 o_orderdate AS responded_at, o_orderkey AS signup_order FROM orders""",
    "answers": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY operation_id, user_id ORDER BY responded_at DESC, signup_order DESC) AS rn FROM signups) WHERE rn = 1""",
    "schedule": """
SELECT c_custkey AS operation_id, c_nationkey % 3 AS guild_id, concat('Raid ', c_mktsegment) AS title,
 TIMESTAMP '1999-01-01 00:00:00' + INTERVAL 1 DAY * (c_custkey % 60) AS scheduled_for,
 CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 END AS group_size,
 CASE c_custkey % 4 WHEN 0 THEN 'Story' WHEN 1 THEN 'Veteran' WHEN 2 THEN 'Master' END AS difficulty,
 CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1998-12-31 00:00:00' END AS cancelled_at FROM customer""",
    "lim": """
SELECT operation_id, CASE group_size WHEN 16 THEN 4 WHEN 4 THEN 1 ELSE 2 END AS tanks, CASE group_size WHEN 16 THEN 4 WHEN 4 THEN 1 ELSE 2 END AS healers,
 CASE group_size WHEN 16 THEN 8 WHEN 4 THEN 2 ELSE 4 END AS dps FROM schedule""",
    "placed": """
SELECT a.*, place, CASE status WHEN 'tank' THEN l.tanks WHEN 'healer' THEN l.healers WHEN 'dps' THEN l.dps END AS role_limit,
 CASE WHEN status NOT IN ('tank', 'healer', 'dps') THEN status
  WHEN place <= CASE status WHEN 'tank' THEN l.tanks WHEN 'healer' THEN l.healers ELSE l.dps END THEN 'confirmed' ELSE 'waitlisted' END AS placement
FROM (SELECT *, row_number() OVER (PARTITION BY operation_id, status ORDER BY responded_at, user_id) AS place FROM answers) a JOIN lim l USING (operation_id)""",
    "roster": """
SELECT l.operation_id, coalesce(tanks, 0) AS tanks, coalesce(healers, 0) AS healers, coalesce(dps, 0) AS dps, coalesce(waitlisted, 0) AS waitlisted,
 coalesce(bench, 0) AS bench, coalesce(declined, 0) AS declined, coalesce(signups, 0) AS signups,
 coalesce(tanks, 0) + coalesce(healers, 0) + coalesce(dps, 0) AS confirmed, lt + lh + ld AS total_slots,
 coalesce(tanks, 0) + coalesce(healers, 0) + coalesce(dps, 0) >= lt + lh + ld AS is_full,
 greatest(0, lt - coalesce(tanks, 0)) AS open_tanks, greatest(0, lh - coalesce(healers, 0)) AS open_healers, greatest(0, ld - coalesce(dps, 0)) AS open_dps
FROM (SELECT operation_id, tanks AS lt, healers AS lh, dps AS ld FROM lim) l LEFT JOIN (
 SELECT operation_id, count(*) FILTER (status = 'tank' AND placement = 'confirmed') AS tanks, count(*) FILTER (status = 'healer' AND placement = 'confirmed') AS healers,
  count(*) FILTER (status = 'dps' AND placement = 'confirmed') AS dps, count(*) FILTER (placement = 'waitlisted') AS waitlisted,
  count(*) FILTER (status = 'bench') AS bench, count(*) FILTER (status = 'declined') AS declined, count(*) AS signups
 FROM placed GROUP BY operation_id) c USING (operation_id)""",
    # Characters over events and orders.
    "sightings_by_owner": """
SELECT log_id AS owner_id, source_id AS player_id, ctx_server_id AS server_id, source_name AS name, line_number AS seen_order FROM ctx WHERE source_kind = 'player'""",
    "seen_chars": """
SELECT owner_id, player_id, server_id, name FROM (
 SELECT *, row_number() OVER (PARTITION BY owner_id, player_id, coalesce(server_id, '') ORDER BY live DESC, seen_order DESC) AS rn FROM (
  SELECT *, 0 AS live FROM sightings_by_owner WHERE seen_order % 2 = 0 UNION ALL SELECT *, 1 FROM sightings_by_owner WHERE seen_order % 2 = 1)) WHERE rn = 1""",
    "linked": """
SELECT DISTINCT CAST(o_orderkey % 12 AS BIGINT) AS user_id, CAST(o_custkey % 1500 AS VARCHAR(20)) AS player_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'he0' WHEN 1 THEN 'he1' END AS server_id FROM orders""",
    # Challenges of the two sample definitions, each written out as the filter that it is.
    "chal_list": _values(
        "definition_id, challenge_id, metric",
        [
            ("d1", "open-damage", "damage"), ("d1", "burn-heal", "effective_healing"), ("d1", "low-boss", "damage"), ("d1", "armed", "damage_taken"),
            ("d1", "kicks", "interrupt_count"), ("d2", "casts", "ability_count"), ("d2", "marks", "effect_count"), ("d2", "stacks", "effect_stacks"),
            ("d2", "soaked", "damage_absorbed"), ("d2", "mid-band", "healing"), ("d2", "mended", "healing_taken"), ("d2", "focus", "damage"),
        ],
    ),
    "chal_all": """
SELECT b.log_id, b.pull_id, challenge_id, metric, from_line, p.started_at, p.ended_at FROM def_bound b JOIN chal_list USING (definition_id) JOIN pulls p USING (log_id, pull_id)
WHERE challenge_id <> 'mended' OR p.ctx_difficulty IN ('Story', 'Veteran')""",
    "chal_state": """
SELECT t.*, definition_id, from_line, p.local_player_id AS me, p.ctx_difficulty AS hard, p.ended_at AS pull_end,
 count(*) FILTER (type = 'damage' AND source_kind = 'player') OVER w AS n,
 last_value(CASE WHEN target_npc_id = '0' AND target_hp IS NOT NULL THEN target_hp / target_max_hp * 100 WHEN source_npc_id = '0' AND source_hp IS NOT NULL THEN source_hp / source_max_hp * 100 END IGNORE NULLS) OVER w AS hp0,
 last_value(CASE WHEN target_npc_id = '1' AND target_hp IS NOT NULL THEN target_hp / target_max_hp * 100 WHEN source_npc_id = '1' AND source_hp IS NOT NULL THEN source_hp / source_max_hp * 100 END IGNORE NULLS) OVER w AS hp1,
 last_value(CASE WHEN target_npc_id = '2' AND target_hp IS NOT NULL THEN target_hp / target_max_hp * 100 WHEN source_npc_id = '2' AND source_hp IS NOT NULL THEN source_hp / source_max_hp * 100 END IGNORE NULLS) OVER w AS hp2,
 last_value(CASE WHEN type = 'target' AND source_id = p.local_player_id THEN CASE WHEN state = 'cleared' THEN '' ELSE target_id END END IGNORE NULLS) OVER w AS aim
FROM t JOIN def_bound b USING (log_id, pull_id) JOIN pulls p USING (log_id, pull_id)
WINDOW w AS (PARTITION BY t.log_id, t.pull_id ORDER BY t.line_number)""",
    # The phase of the definition: opening, burn after two hits of players, and the single phase of the other one when it takes over.
    "def_phased": """
SELECT *, CAST(CASE WHEN from_line >= 0 AND line_number >= from_line THEN CASE WHEN n_over >= 2 THEN 2 ELSE 1 END WHEN definition_id = 'd1' OR from_line >= 0 THEN CASE WHEN n >= 2 THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS segment_index
FROM (SELECT *, max(n) FILTER (line_number <= from_line) OVER (PARTITION BY log_id, pull_id) AS n_over FROM chal_state)""",
    "chal_ev": """
SELECT *, n < 2 AS opening, CASE WHEN n < 2 THEN n ELSE n - 2 END <= 3 AS armed, coalesce(hp0 <= 50, false) AS low,
 coalesce(hp1 BETWEEN 30 AND 60, false) OR coalesce(hp2 BETWEEN 30 AND 60, false) AS mid FROM chal_state WHERE line_number > from_line""",
    "chal_hits": """
SELECT log_id, pull_id, challenge_id, line_number, player_id, name, CAST(amount AS DOUBLE) AS amount FROM (
 SELECT log_id, pull_id, line_number, 'open-damage' AS challenge_id, source_id AS player_id, source_name AS name, amount FROM chal_ev
  WHERE definition_id = 'd1' AND type = 'damage' AND source_kind = 'player' AND opening
 UNION ALL SELECT log_id, pull_id, line_number, 'burn-heal', source_id, source_name, coalesce(effective, amount) FROM chal_ev
  WHERE definition_id = 'd1' AND type = 'heal' AND source_kind = 'player' AND NOT opening
 UNION ALL SELECT log_id, pull_id, line_number, 'low-boss', source_id, source_name, amount FROM chal_ev
  WHERE definition_id = 'd1' AND type = 'damage' AND source_kind = 'player' AND target_kind = 'npc' AND target_npc_id = '0' AND low
 UNION ALL SELECT log_id, pull_id, line_number, 'armed', target_id, target_name, amount FROM chal_ev
  WHERE definition_id = 'd1' AND type = 'damage' AND target_kind = 'player' AND armed
 UNION ALL SELECT log_id, pull_id, line_number, 'kicks', source_id, source_name, 1 FROM chal_ev
  WHERE definition_id = 'd1' AND type = 'ability' AND phase = 'interrupt' AND source_kind = 'player'
 UNION ALL SELECT log_id, pull_id, line_number, 'casts', target_id, target_name, 1 FROM chal_ev
  WHERE definition_id = 'd2' AND type = 'ability' AND phase = 'activate' AND target_kind = 'player' AND ability_id IN ('2', '3', '4')
 UNION ALL SELECT log_id, pull_id, line_number, 'marks', source_id, source_name, 1 FROM chal_ev
  WHERE definition_id = 'd2' AND type = 'applyEffect' AND source_kind = 'player' AND effect_id IN ('0', '2') AND source_id IS DISTINCT FROM me
 UNION ALL SELECT log_id, pull_id, line_number, 'soaked', source_id, source_name, coalesce(absorbed, 0) FROM chal_ev
  WHERE definition_id = 'd2' AND type = 'damage' AND source_kind = 'player' AND target_kind = 'npc' AND target_npc_id IN ('1', '2', '5')
 UNION ALL SELECT log_id, pull_id, line_number, 'mid-band', source_id, source_name, amount FROM chal_ev
  WHERE definition_id = 'd2' AND type = 'heal' AND source_kind = 'player' AND mid
 UNION ALL SELECT log_id, pull_id, line_number, 'mended', target_id, target_name, coalesce(effective, amount) FROM chal_ev
  WHERE definition_id = 'd2' AND type = 'heal' AND target_kind = 'player' AND target_id IS DISTINCT FROM me AND hard IN ('Story', 'Veteran')
 UNION ALL SELECT log_id, pull_id, line_number, 'focus', source_id, source_name, amount FROM chal_ev
  WHERE definition_id = 'd2' AND type = 'damage' AND source_kind = 'player' AND target_id = nullif(aim, '')
) WHERE amount <> 0""",
    "chal_piles": """
SELECT log_id, pull_id, player_id, pile, min(line_number) AS line_number, arg_min(name, line_number) AS name, max(height) FILTER (NOT gone) AS height, bool_or(gone) AS gone FROM (
 SELECT log_id, pull_id, source_id AS player_id, source_name AS name, line_number, type = 'removeEffect' AS gone,
  CASE WHEN type = 'applyEffect' THEN coalesce(charges, 1) ELSE coalesce(charges, 0) END AS height,
  coalesce(sum(CASE WHEN type = 'removeEffect' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, pull_id, source_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pile
 FROM chal_ev WHERE definition_id = 'd2' AND type IN ('applyEffect', 'modifyCharges', 'removeEffect') AND source_kind = 'player' AND effect_id IN ('1', '3', '5')
) GROUP BY ALL""",
    "chal_players": """
SELECT log_id, pull_id, challenge_id, player_id, arg_min(name, line_number) AS player_name, sum(amount) AS value, count(*) AS event_count FROM chal_hits GROUP BY ALL
UNION ALL SELECT log_id, pull_id, 'stacks', player_id, arg_min(name, line_number), CAST(sum(coalesce(height, 0)) AS DOUBLE), count(*) FILTER (height > 0 OR (height IS NOT NULL AND NOT gone)) FROM chal_piles GROUP BY ALL""",
    "chal_islands": """
SELECT log_id, pull_id, challenge_id, greatest(0, arg_max(until, line_number) - arg_min(ts_ms, line_number)) AS ms FROM (
 SELECT *, sum(CASE WHEN active AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, pull_id, challenge_id ORDER BY line_number) AS island FROM (
  SELECT *, lag(active) OVER w AS was, coalesce(lead(ts_ms) OVER w, pull_end) AS until FROM (
   SELECT log_id, pull_id, line_number, ts_ms, pull_end, 'low-boss' AS challenge_id, low AS active FROM chal_ev WHERE definition_id = 'd1'
   UNION ALL SELECT log_id, pull_id, line_number, ts_ms, pull_end, 'armed', armed FROM chal_ev WHERE definition_id = 'd1'
   UNION ALL SELECT log_id, pull_id, line_number, ts_ms, pull_end, 'mid-band', mid FROM chal_ev WHERE definition_id = 'd2')
  WINDOW w AS (PARTITION BY log_id, pull_id, challenge_id ORDER BY line_number))
) WHERE active GROUP BY log_id, pull_id, challenge_id, island""",
    "chal_totals": """
SELECT a.log_id, a.pull_id, a.challenge_id, a.metric, coalesce(v.value, 0) AS value, coalesce(v.event_count, 0) AS event_count,
 CAST(CASE WHEN a.challenge_id = 'open-damage' THEN greatest(0, coalesce(b.at, a.ended_at) - a.started_at)
  WHEN a.challenge_id = 'burn-heal' THEN coalesce(greatest(0, a.ended_at - b.at), 0)
  WHEN a.challenge_id IN ('low-boss', 'armed', 'mid-band') THEN coalesce(i.ms, 0) ELSE greatest(0, a.ended_at - a.started_at) END AS BIGINT) AS duration_ms
FROM chal_all a LEFT JOIN (SELECT log_id, pull_id, challenge_id, sum(value) AS value, CAST(sum(event_count) AS BIGINT) AS event_count FROM chal_players GROUP BY ALL) v USING (log_id, pull_id, challenge_id)
LEFT JOIN (SELECT log_id, pull_id, arg_min(ts_ms, line_number) AS at FROM chal_ev WHERE definition_id = 'd1' AND n >= 2 GROUP BY ALL) b USING (log_id, pull_id)
LEFT JOIN (SELECT log_id, pull_id, challenge_id, CAST(sum(ms) AS BIGINT) AS ms FROM chal_islands GROUP BY ALL) i USING (log_id, pull_id, challenge_id)""",
}


_ENCOUNTERS = ", ".join(
    "{{'id': {0}, 'bosses': {1}, 'required': {2}, 'boss_ids': {3}, 'ids': {4}, 'zone_ids': {5}, 'zone_names': {6}, 'words': {7}}}".format(
        _literal(e[0]),
        *("[" + ", ".join(map(_literal, items)) + "]::VARCHAR[]" for items in (
            e[5], e[6], e[8], [*e[8], *(o[2] for o in ROWS["observed"] if o[0] == e[0])],
            *((op[3], op[4]) for op in ROWS["operations"] if op[0] == e[2]).__next__(),
            [] if __import__("re").search(fixed.BOSS_DEFEAT_TEXT, e[11].lower()) else [m for m in fixed.VICTORY_MARKERS if m in e[11].lower()],
        )),
    )
    for e in sorted(ROWS["encounters"], key=lambda e: e[4])
)
#: Score of every encounter of the list ``enc`` for the engaged ``names`` and ``ids`` in a zone, and the place of the best one.
_SCORES = """list_transform(enc, lambda e: CASE WHEN len(list_intersect(e.bosses, names1)) = 0 AND len(list_intersect(e.ids, ids1)) = 0 THEN -1 ELSE
 2 * len(list_intersect(e.bosses, names1)) + CASE WHEN len(list_intersect(e.ids, ids1)) > 0 THEN 8 ELSE 0 END
 + CASE WHEN coalesce(list_contains(e.zone_ids, zone_id1), false) THEN 6 WHEN coalesce(list_contains(e.zone_names, lower(trim(zone_name1))), false) THEN 4 ELSE 0 END END)"""

#: The segmentation rule told event by event, one recursion step a line of every log.
FULL_PULLS = f"""
SELECT log_id, concat(CAST(started_at AS VARCHAR), '-', CAST(pull_index AS VARCHAR)) AS pull_id, pull_index, started_at, ended_at, start_line, close_line,
 ended_at - started_at AS duration_ms, end_reason, c.ctx_zone_id AS ctx_zone_id, c.ctx_zone_name AS ctx_zone_name, c.ctx_difficulty AS ctx_difficulty,
 c.ctx_group_size AS ctx_group_size, c.ctx_server_id AS ctx_server_id, c.local_player_id AS local_player_id
FROM (
 SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY start_line) AS pull_index FROM (
  SELECT log_id, shut.start_line AS start_line, shut.started_at AS started_at, shut.ended_at AS ended_at, shut.close_line AS close_line, shut.end_reason AS end_reason, shut.c AS c, shut.hit AS hit FROM seg WHERE shut IS NOT NULL
  UNION ALL
  SELECT s.log_id, start_line, started_at, greatest(last_act, started_at), m.last_line + 1, 'stream-ended', c, hit
  FROM seg s JOIN (SELECT log_id, max(rn) AS rn FROM feed GROUP BY log_id) l ON s.log_id = l.log_id AND s.rn = l.rn
  JOIN (SELECT log_id, max(line_number) AS last_line FROM ev GROUP BY log_id) m ON m.log_id = s.log_id WHERE start_line IS NOT NULL
 ) WHERE hit AND ended_at - started_at >= {O.min_duration_ms})"""

RECURSION = {
    "feed": f"""
SELECT x.log_id, row_number() OVER (PARTITION BY x.log_id ORDER BY x.line_number) AS rn, x.line_number AS line, ts_ms AS ts,
 type = 'areaEntered' AS area, coalesce(type = 'combatState' AND state = 'enter', false) AS enter, coalesce(type = 'combatState' AND state = 'exit', false) AS leaves,
 coalesce(type IN ('damage', 'heal', 'death') OR (type = 'ability' AND phase = 'activate' AND source_kind = 'player'), false) AS acts,
 type IN ('damage', 'heal', 'death', 'applyEffect', 'removeEffect', 'ability') AS ticks,
 coalesce({_RAID}, false) AS struck, coalesce({_RAID} AND coalesce(effective, amount) > 0, false) AS hits,
 type = 'death' AND coalesce(target_kind = 'npc', false) AS dies, target_npc_id AS npc_id,
 lower(trim(target_name)) AS raw_name, lower(trim(coalesce(n.name, target_name))) AS npc_name,
 lower(concat_ws(' ', ability_name, CASE WHEN type IN ('applyEffect', 'removeEffect') THEN effect_name END, CASE WHEN type = 'other' THEN category_name END)) AS words,
 coalesce(g.defs, []) AS defs,
 {{'ctx_zone_id': ctx_zone_id, 'ctx_zone_name': ctx_zone_name, 'ctx_difficulty': ctx_difficulty, 'ctx_group_size': ctx_group_size, 'ctx_server_id': ctx_server_id, 'local_player_id': local_player_id}} AS now_c
FROM ctx x LEFT JOIN npc n ON n.npc_id = x.target_npc_id
LEFT JOIN (SELECT log_id, line_number, list(DISTINCT definition_id) AS defs FROM triggered GROUP BY ALL) g ON g.log_id = x.log_id AND g.line_number = x.line_number
WHERE type <> 'disciplineChanged'""",
    "seg": f"""
SELECT DISTINCT log_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS started_at, CAST(NULL AS BIGINT) AS last_act, CAST(NULL AS BIGINT) AS last_closed,
 false AS pending, []::VARCHAR[] AS names, []::VARCHAR[] AS ids, []::VARCHAR[] AS dead_names, []::VARCHAR[] AS dead_ids, false AS proven, []::VARCHAR[] AS met, CAST(NULL AS BIGINT) AS matched, false AS hit,
 CAST(NULL AS STRUCT(ctx_zone_id VARCHAR, ctx_zone_name VARCHAR, ctx_difficulty VARCHAR, ctx_group_size INTEGER, ctx_server_id VARCHAR, local_player_id VARCHAR)) AS c,
 CAST(NULL AS STRUCT(start_line BIGINT, started_at BIGINT, ended_at BIGINT, close_line BIGINT, end_reason VARCHAR, c STRUCT(ctx_zone_id VARCHAR, ctx_zone_name VARCHAR, ctx_difficulty VARCHAR, ctx_group_size INTEGER, ctx_server_id VARCHAR, local_player_id VARCHAR), hit BOOLEAN)) AS shut
FROM feed
UNION ALL
SELECT log_id, rn, start1, began1, CASE WHEN start1 IS NULL THEN NULL WHEN adds AND ticks THEN ts ELSE act1 END, closed1, pending1,
 names1, ids1, dead_names1, dead_ids1, proven1 OR (bound1 IS NOT NULL AND list_contains(met1, bound1)), CASE WHEN bound1 IS NULL THEN met1 ELSE [] END,
 match1, hit1, c1, shut
FROM (
 SELECT *,
  CASE WHEN adds AND matched0 IS NOT NULL THEN proven0 OR len(list_filter(enc[matched0].words, lambda w: contains(words, w))) > 0 ELSE proven0 END AS proven1,
  CASE WHEN adds AND struck THEN list_position({_SCORES}, nullif(list_max({_SCORES}), -1)) ELSE matched0 END AS match1,
  CASE WHEN adds AND dies THEN list_distinct(list_concat(dead_names0, [raw_name, npc_name])) ELSE dead_names0 END AS dead_names1,
  CASE WHEN adds AND dies THEN list_distinct(list_append(dead_ids0, npc_id)) ELSE dead_ids0 END AS dead_ids1,
  CASE WHEN adds THEN list_distinct(list_concat(met0, defs)) ELSE met0 END AS met1,
  CASE WHEN NOT list_contains(ids1, '0') AND NOT list_contains(ids1, '1') AND NOT list_contains(ids1, '2') THEN NULL
   WHEN NOT list_contains(ids1, '0') THEN 'd2' WHEN list_contains(ids1, '1') AND list_contains(ids1, '2') THEN 'd2'
   WHEN NOT list_contains(ids1, '1') AND NOT list_contains(ids1, '2') THEN 'd1'
   WHEN list_position(ids1, '0') < coalesce(list_position(ids1, '1'), list_position(ids1, '2')) THEN 'd1' ELSE 'd2' END AS bound1,
  hit0 OR (adds AND hits) AS hit1
 FROM (
  SELECT *, c1.ctx_zone_id AS zone_id1, c1.ctx_zone_name AS zone_name1, start1 IS NOT NULL AND NOT area AND NOT leaves AS adds,
   CASE WHEN start1 IS NOT NULL AND struck AND NOT list_contains(names0, npc_name) THEN list_append(names0, npc_name) ELSE names0 END AS names1,
   CASE WHEN start1 IS NOT NULL AND struck AND NOT list_contains(ids0, npc_id) THEN list_append(ids0, npc_id) ELSE ids0 END AS ids1
  FROM (
   SELECT *, CASE WHEN opens THEN line ELSE start0 END AS start1, CASE WHEN opens THEN ts ELSE began0 END AS began1, CASE WHEN opens THEN ts ELSE act0 END AS act1, CASE WHEN opens THEN now_c ELSE c0 END AS c1,
    CASE WHEN leaves THEN true WHEN acts OR area OR shut IS NOT NULL THEN false ELSE pending END AS pending1
   FROM (
    SELECT *, (enter OR acts) AND start0 IS NULL AND (closed1 IS NULL OR ts - closed1 >= {O.reopen_guard_ms}) AS opens FROM (
     SELECT *, CASE WHEN ends THEN NULL ELSE start_line END AS start0, CASE WHEN ends THEN NULL ELSE started_at END AS began0, CASE WHEN ends THEN NULL ELSE last_act END AS act0,
      CASE WHEN ends THEN last_act ELSE last_closed END AS closed1, CASE WHEN ends THEN []::VARCHAR[] ELSE names END AS names0, CASE WHEN ends THEN []::VARCHAR[] ELSE ids END AS ids0,
      CASE WHEN ends THEN []::VARCHAR[] ELSE dead_names END AS dead_names0, CASE WHEN ends THEN []::VARCHAR[] ELSE dead_ids END AS dead_ids0, CASE WHEN ends THEN false ELSE proven END AS proven0,
      CASE WHEN ends THEN []::VARCHAR[] ELSE met END AS met0, CASE WHEN ends THEN NULL ELSE matched END AS matched0, CASE WHEN ends THEN false ELSE hit END AS hit0, CASE WHEN ends THEN NULL ELSE c END AS c0,
      CASE WHEN ends THEN {{'start_line': start_line, 'started_at': started_at, 'ended_at': greatest(last_act, started_at), 'close_line': line,
       'end_reason': CASE WHEN area THEN 'stream-ended' ELSE 'sustained-silence' END, 'c': c, 'hit': hit}} END AS shut
     FROM (
      SELECT s.log_id, e.rn, s.start_line, s.started_at, s.last_act, s.last_closed, s.pending, s.names, s.ids, s.dead_names, s.dead_ids, s.proven, s.met, s.matched, s.hit, s.c, e.* EXCLUDE (log_id, rn), k.enc,
       s.start_line IS NOT NULL AND (e.area OR (NOT e.leaves AND e.ts - s.last_act >= CASE
        WHEN s.matched IS NOT NULL AND (s.proven OR CASE
         WHEN len(k.enc[s.matched].required) > 0 THEN len(list_intersect(k.enc[s.matched].required, s.dead_names)) = len(k.enc[s.matched].required)
          OR (len(k.enc[s.matched].required) = 1 AND len(list_intersect(k.enc[s.matched].boss_ids, s.dead_ids)) > 0)
         ELSE len(list_intersect(k.enc[s.matched].bosses, s.dead_names)) > 0
          OR (len(k.enc[s.matched].bosses) = 1 AND len(list_intersect(k.enc[s.matched].boss_ids, s.dead_ids)) > 0) END) THEN {O.boss_cleanup_ms}
        WHEN s.pending THEN {O.exit_grace_ms} ELSE {O.idle_ms} END)) AS ends
      FROM seg s JOIN feed e ON e.log_id = s.log_id AND e.rn = s.rn + 1, (SELECT [{_ENCOUNTERS}] AS enc) k
     )))))
)""",
    "full_pulls": FULL_PULLS,
}


def full_statement(select: str) -> str:
    """As ``statement``, with the pulls that the whole rule cuts instead of those of plain silence."""
    first = ["ev", "ops", "op_zone_ids", "op_zone_names", "enc", "enc_boss", "enc_req", "enc_adds", "enc_boss_ids", "enc_add_ids", "enc_single", "enc_phases", "npc"]
    first += ["observed", "abil", "offgcd", "kicks", "defs", "disc", "ctx", "triggered"]
    tables = {n: CTES[n] for n in first} | RECURSION | {
        "pulls": "SELECT * FROM full_pulls",
        "sessioned": "SELECT x.*, p.pull_id, p.pull_index FROM ctx x JOIN full_pulls p ON p.log_id = x.log_id AND x.line_number >= p.start_line AND x.line_number < p.close_line",
    }
    tables |= {n: sql for n, sql in CTES.items() if n not in tables and n not in ("prior", "indexed")}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in tables.items()) + "\n" + select


def statement(select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items()) + "\n" + select
