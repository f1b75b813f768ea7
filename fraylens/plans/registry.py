"""Named queries over the given tables, each with its ANSI-SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.functions import combat, text
from fraylens.operators import (
    abilities, accounts, deaths, effects, encounters, enemies, mechanics, metrics, quality, rollups, roster, segment, victories,
)
from fraylens.operators.segment import CONTEXT, PULL
from fraylens.operators.staging import new_path, staged
from fraylens.plans import ansi
from fraylens.plans.fights import Fights
from fraylens.sources import catalog as catalogs
from fraylens.sources import parse, sinks, wire
from fraylens.sources.sample_catalog import sample_catalog
from fraylens.sources.tables import SCALED_OPTIONS, combat_events, project_combat, read_table
from fraylens.streaming import announcer, arrivals, live, publish

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

O = SCALED_OPTIONS
RATES = ["dps", "hps", "dtps", "apm", "overheal_percent", "damage_crit_percent", "healing_crit_percent", "defense_percent", "shield_percent"]


def register(name: str, oracle: str | None = None, full: bool = False) -> Callable[[Query], Query]:
    """``full``: the twin reads the pulls of the whole segmentation rule."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = (ansi.full_statement if full else ansi.statement)(oracle)
        return query

    return add


def gap_fights(spark: SparkSession, sf_dir: str, tagged_once: bool = False) -> Fights:
    return Fights(combat_events(spark, sf_dir), sample_catalog(spark), O, gap_only=True, whole=True, tagged_once=tagged_once)


def full_fights(spark: SparkSession, sf_dir: str) -> Fights:
    return Fights(combat_events(spark, sf_dir), sample_catalog(spark), O, whole=True, stored=True)


def on_gaps(name: str, oracle: str | None = None, tagged_once: bool = False):
    """Registers a query written over the gap-only ``Fights`` of the event table; ``tagged_once``: many of its steps read the tagged events."""

    def add(build: Callable[[Fights], DataFrame]):
        register(name, oracle)(lambda spark, sf_dir: build(gap_fights(spark, sf_dir, tagged_once)))
        return build

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Adapter, sessions and context.

_PLAIN = (
    "log_id, line_number, ts_ms, type, phase, state, source_kind, source_id, source_name, source_npc_id, source_hp, source_max_hp, "
    "target_kind, target_id, target_name, target_npc_id, target_hp, target_max_hp, ability_id, ability_name, effect_id, effect_name, "
    "amount, effective, critical, damage_type, mitigation, absorbed, charges, threat, zone_id, zone_name, server_id, group_size, "
    "difficulty, advanced_class, discipline, role"
)


@register("combat_events", f"SELECT {_PLAIN} FROM ev")
def _combat_events(spark, sf_dir):
    return combat_events(spark, sf_dir).select(*_PLAIN.split(", "))


@register("gap_sessions", "SELECT log_id, pull_id, pull_index, started_at, ended_at, start_line, last_line, event_count, duration_ms FROM pulls")
def _gap_sessions(spark, sf_dir):
    return segment.gap_sessions(combat_events(spark, sf_dir), O)


@register("session_context", f"SELECT log_id, line_number, {', '.join(CONTEXT)} FROM ctx")
def _session_context(spark, sf_dir):
    return segment.session_context(combat_events(spark, sf_dir), O).select("log_id", "line_number", *CONTEXT)


@register(
    "local_player",
    "SELECT log_id, max(local_player_id) AS local_player_id, min(CASE WHEN local_player_id IS NOT NULL THEN line_number END) AS known_from FROM ctx GROUP BY log_id",
)
def _local_player(spark, sf_dir):
    known = F.when(F.col("local_player_id").isNotNull(), F.col("line_number"))
    scanned = segment.session_context(combat_events(spark, sf_dir), O)
    return scanned.groupBy("log_id").agg(F.max("local_player_id").alias("local_player_id"), F.min(known).alias("known_from"))


# Actors.

_TOTALS = ", ".join(metrics.ACTOR_SUMS)


@on_gaps("actor_totals", f"SELECT log_id, pull_id, actor_id, name, first_line, {_TOTALS} FROM actors")
def _actor_totals(f):
    return metrics.totals(f.contributions, PULL, whole=True).drop("first_action_at", "last_action_at")


@on_gaps(
    "actor_rates",
    "SELECT log_id, pull_id, actor_id, role, discipline, combat_style, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in RATES) + " FROM rated",
)
def _actor_rates(f):
    return rounded(f.actors.select(*PULL, "actor_id", "role", "discipline", "combat_style", *RATES), *RATES)


@on_gaps("damage_by_type", "SELECT log_id, pull_id, actor_id, damage_type, CAST(sum(ap) AS BIGINT) AS amount FROM typed WHERE damage_type IS NOT NULL AND ap <> 0 GROUP BY ALL")
def _damage_by_type(f):
    return metrics.type_totals(f.contributions, PULL, "damage_type", whole=True)


@on_gaps("mitigation_by_type", "SELECT log_id, pull_id, actor_id, mitigation, CAST(sum(lost) AS BIGINT) AS amount FROM typed WHERE mitigation IS NOT NULL AND lost <> 0 GROUP BY ALL")
def _mitigation_by_type(f):
    return metrics.type_totals(f.contributions, PULL, "mitigation", whole=True)


@on_gaps("participants", "SELECT * FROM took_part")
def _participants(f):
    return f.participants


@on_gaps(
    "metric_buckets",
    """SELECT b.log_id, b.pull_id, b.bucket_index, player_id, damage, healing, damage_taken FROM (
 SELECT log_id, pull_id, CAST(0 AS BIGINT) AS bucket_index FROM pulls
 UNION SELECT log_id, pull_id, bucket_index FROM bucketed WHERE type = 'damage' OR (type = 'heal' AND source_kind = 'player')) b
LEFT JOIN (
 SELECT log_id, pull_id, bucket_index, player_id, CAST(sum(d) AS BIGINT) AS damage, CAST(sum(h) AS BIGINT) AS healing, CAST(sum(x) AS BIGINT) AS damage_taken FROM (
  SELECT log_id, pull_id, bucket_index, source_id AS player_id, ap AS d, 0 AS h, 0 AS x FROM bucketed WHERE type = 'damage' AND source_kind = 'player' AND target_kind = 'npc'
  UNION ALL SELECT log_id, pull_id, bucket_index, source_id, 0, ap, 0 FROM bucketed WHERE type = 'heal' AND source_kind = 'player'
  UNION ALL SELECT log_id, pull_id, bucket_index, target_id, 0, 0, ap FROM bucketed WHERE type = 'damage' AND target_kind = 'player') GROUP BY ALL) s
USING (log_id, pull_id, bucket_index)""",
)
def _metric_buckets(f):
    return f.buckets


@on_gaps(
    "interrupt_list",
    "SELECT log_id, pull_id, line_number, ts_ms, ability_id, ability_name, source_id, source_name, target_npc_id, "
    "CASE WHEN target_kind = 'npc' THEN coalesce(n.name, target_name) END AS target_name "
    "FROM t LEFT JOIN npc n ON n.npc_id = target_npc_id WHERE type = 'ability' AND phase = 'interrupt' AND ability_id IN (SELECT ability_id FROM kicks)",
)
def _interrupt_list(f):
    return metrics.interrupt_list(f.tagged, f.catalog.interrupts, f.catalog.npc_catalog)


@register(
    "session_roster",
    """SELECT p.log_id, p.player_id, CASE WHEN d.line_number IS NOT NULL THEN d.server ELSE p.server END AS server_id,
 coalesce(d.name, p.name) AS name, d.advanced_class, d.discipline, d.role
FROM (SELECT log_id, player_id, first(server ORDER BY line_number, slot) AS server, first(name ORDER BY line_number, slot) AS name FROM (
  SELECT log_id, line_number, 0 AS slot, source_id AS player_id, source_name AS name, server FROM before_area WHERE source_kind = 'player'
  UNION ALL SELECT log_id, line_number, 1, target_id, target_name, server FROM before_area WHERE target_kind = 'player') GROUP BY ALL) p
LEFT JOIN (SELECT * FROM (SELECT log_id, source_id AS player_id, line_number, source_name AS name, server, advanced_class, discipline, role,
  row_number() OVER (PARTITION BY log_id, source_id ORDER BY line_number DESC) AS rn FROM before_area WHERE type = 'disciplineChanged') WHERE rn = 1) d
 ON d.log_id = p.log_id AND d.player_id = p.player_id""".replace(
        "before_area",
        "(SELECT *, last_value(CASE WHEN type = 'areaEntered' THEN server_id END IGNORE NULLS) OVER "
        "(PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS server FROM ev)",
    ),
)
def _session_roster(spark, sf_dir):
    return metrics.session_roster(combat_events(spark, sf_dir), O)


# Enemies.

@on_gaps(
    "enemy_totals",
    """SELECT log_id, pull_id, instance_id, CAST(sum(damage_taken) AS BIGINT) AS damage_taken, CAST(sum(damage_dealt) AS BIGINT) AS damage_dealt,
 CAST(sum(coalesce(absorbed, 0)) AS BIGINT) AS absorbed, count(*) FILTER (critical) AS critical_hits,
 CAST(sum(CASE WHEN critical THEN ap ELSE 0 END) AS BIGINT) AS critical_damage, CAST(sum(lost) AS BIGINT) AS mitigated_damage,
 CAST(sum(CASE WHEN target_hp IS NULL THEN 0 ELSE greatest(0, ap - target_hp) END) AS BIGINT) AS overkill, CAST(sum(coalesce(threat, 0)) AS BIGINT) AS threat
FROM foe_rows GROUP BY ALL""",
)
def _enemy_totals(f):
    return enemies.enemy_totals(f.enemy_rows, whole=True)


@on_gaps("enemy_damage_by_type", "SELECT log_id, pull_id, instance_id, damage_type, CAST(sum(ap) AS BIGINT) AS amount FROM foe_rows WHERE damage_type IS NOT NULL AND ap <> 0 GROUP BY ALL")
def _enemy_types(f):
    return enemies.enemy_type_totals(f.enemy_rows, "damage_type", whole=True)


@on_gaps("enemy_lifecycle", "SELECT * FROM enemies")
def _enemy_lifecycle(f):
    return f.enemies


@on_gaps(
    "enemy_players",
    """SELECT p.* EXCLUDE (first_damage_at, last_damage_at), first_damage_at, last_damage_at, greatest(0, last_damage_at - first_damage_at) AS active_ms,
 round(damage / (CAST(greatest(1, coalesce(e.died_at, q.ended_at) - first_damage_at) AS DOUBLE) / 1000.0), 4) AS dps
FROM foe_players p JOIN enemies e USING (log_id, pull_id, instance_id) JOIN pulls q ON q.log_id = p.log_id AND q.pull_id = p.pull_id""",
)
def _enemy_players(f):
    rated = enemies.enemy_player_rates(f.enemy_players, f.enemies, f.pulls)
    kept = rated.drop("player_name", "died_at", "ended_at", "damage_crit_percent")
    return rounded(kept, "dps")


# Abilities.

@on_gaps(
    "ability_usage",
    """SELECT log_id, pull_id, u.ability_id, CAST(sum(c) AS BIGINT) AS casts, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(m) AS BIGINT) AS misses,
 CAST(sum(cr) AS BIGINT) AS critical_hits, CAST(sum(dm) AS BIGINT) AS damage, count(DISTINCT tgt) AS targets,
 coalesce(any_value(a.name), first(ability_name ORDER BY line_number)) AS name, any_value(a.attack_type) AS attack_type, any_value(a.damage_type) AS damage_type
FROM used u LEFT JOIN abil a USING (ability_id) GROUP BY log_id, pull_id, u.ability_id""",
)
def _ability_usage(f):
    return f.ability_usage


@on_gaps(
    "ability_players",
    """SELECT log_id, pull_id, ability_id, source_id AS player_id, CAST(sum(c) AS BIGINT) AS casts, CAST(sum(h) AS BIGINT) AS hits,
 CAST(sum(m) AS BIGINT) AS misses, CAST(sum(cr) AS BIGINT) AS critical_hits, CAST(sum(dm) AS BIGINT) AS damage, count(DISTINCT tgt) AS targets FROM used GROUP BY ALL""",
)
def _ability_players(f):
    return abilities.usage(f.ability_rows, [*PULL, "ability_id", "player_id"], whole=True)


@on_gaps(
    "ability_targets",
    """SELECT log_id, pull_id, ability_id, tgt AS target_id, first(target_name ORDER BY line_number) AS target_name, first(target_npc_id ORDER BY line_number) AS target_npc_id,
 CAST(sum(h) AS BIGINT) AS hits, CAST(sum(m) AS BIGINT) AS misses, CAST(sum(cr) AS BIGINT) AS critical_hits, CAST(sum(dm) AS BIGINT) AS damage
FROM used WHERE tgt IS NOT NULL GROUP BY ALL""",
)
def _ability_targets(f):
    return abilities.ability_targets(f.ability_rows, whole=True)


@on_gaps(
    "cast_intervals",
    """SELECT log_id, pull_id, ability_id, player_id, count(*) AS casts, first(ts_ms ORDER BY line_number) AS first_cast_at, last(ts_ms ORDER BY line_number) AS last_cast_at,
 round(coalesce(avg(gap), 0), 4) AS average_ms, coalesce(max(gap), 0) AS maximum_ms,
 coalesce(min(gap) FILTER (gap > 0 AND zeros = zeros_max), 0) AS minimum_ms
FROM (SELECT *, max(zeros) OVER (PARTITION BY log_id, pull_id, ability_id, player_id) AS zeros_max FROM (
 SELECT *, sum(CASE WHEN gap = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, pull_id, ability_id, player_id ORDER BY line_number) AS zeros FROM (
  SELECT log_id, pull_id, ability_id, source_id AS player_id, line_number, ts_ms,
   greatest(0, ts_ms - lag(ts_ms) OVER (PARTITION BY log_id, pull_id, ability_id, source_id ORDER BY line_number)) + CASE WHEN lag(ts_ms) OVER (PARTITION BY log_id, pull_id, ability_id, source_id ORDER BY line_number) IS NULL THEN NULL ELSE 0 END AS gap
  FROM used WHERE c = 1))) GROUP BY ALL""",
)
def _cast_intervals(f):
    return rounded(abilities.cast_intervals(f.ability_rows, O), "average_ms")


# Encounters and outcomes.

@on_gaps("npc_names", "SELECT DISTINCT npc_id, raw_name, canonical_name, CASE WHEN npc_id IN (SELECT npc_id FROM npc) THEN 'catalog' ELSE 'log' END AS name_source FROM engaged")
def _npc_names(f):
    named = encounters.npc_names(f.engaged.select("npc_id", "raw_name").distinct(), f.catalog.npc_catalog, name_column="raw_name")
    return named


@on_gaps("engaged_npcs", "SELECT log_id, pull_id, npc_id, name, first_line FROM engaged")
def _engaged(f):
    return f.engaged.select(*PULL, "npc_id", "name", "first_line")


@on_gaps(
    "all_engaged_dead",
    """SELECT log_id, pull_id, count(*) AS engaged, count(*) FILTER (gone) AS dead, bool_and(gone) AS all_dead FROM (
 SELECT DISTINCT log_id, pull_id, npc_id, (log_id, pull_id, npc_id) IN (SELECT log_id, pull_id, npc_id FROM dead) AS gone FROM engaged) GROUP BY ALL""",
)
def _all_dead(f):
    return encounters.all_engaged_dead(f.engaged, f.dead)


@on_gaps("encounter_match", "SELECT log_id, pull_id, encounter_id, matched_bosses, score FROM matches")
def _match(f):
    return f.matches


@on_gaps("encounter_match_steps", "SELECT log_id, pull_id, at_line, encounter_id FROM steps")
def _match_steps(f):
    return f.running_matches.select(*PULL, "at_line", "encounter_id")


@on_gaps("encounter_cleared", "SELECT log_id, pull_id, encounter_id, cleared FROM cleared")
def _cleared(f):
    return f.cleared


@on_gaps("victory_evidence", "SELECT log_id, pull_id, ts_ms, said, actor_id, target_npc_id, line_number FROM evidence")
def _evidence(f):
    return f.evidence


@on_gaps("entity_roles", "SELECT log_id, pull_id, instance_id, npc_id, name, encounter_id, role FROM roles")
def _roles(f):
    return f.entity_roles.select(*PULL, "instance_id", "npc_id", "name", "encounter_id", "role")


@on_gaps(
    "catalog_roles",
    """SELECT log_id, pull_id, instance_id, e.npc_id, e.name, CASE WHEN n.role IS NOT NULL THEN n.role
 WHEN e.npc_id IN (SELECT npc_id FROM enc_boss_ids) THEN 'boss' WHEN e.npc_id IN (SELECT npc_id FROM enc_add_ids) THEN 'mechanic'
 WHEN EXISTS (SELECT 1 FROM enc_adds a WHERE contains(lower(trim(e.name)), lower(trim(a.name)))) THEN 'mechanic'
 WHEN lower(trim(e.name)) IN (SELECT name FROM enc_boss) THEN 'boss' ELSE 'unknown' END AS role
FROM enemies e LEFT JOIN npc n ON n.npc_id = e.npc_id""",
)
def _catalog_roles(f):
    return encounters.catalog_roles(f.enemies, f.catalog).select(*PULL, "instance_id", "npc_id", "name", "role")


@on_gaps("boss_of_pull", "SELECT log_id, pull_id, boss_npc_id, boss_name, boss_max_hp, boss_hp, round(boss_hp_percent, 4) AS boss_hp_percent, is_likely_boss FROM boss")
def _boss(f):
    return rounded(f.boss, "boss_hp_percent")


@on_gaps("single_instance_reset")
def _resets(f):
    return f.resets


ORACLES["single_instance_reset"] = ansi.statement(
    """, inst AS (SELECT s.log_id, s.pull_id, s.npc_id, s.instance_id, min(line_number) AS first_line, first(ts_ms ORDER BY line_number, slot) AS first_ts,
   min(line_number) FILTER (died) AS death_line FROM seen s JOIN matches m ON m.log_id = s.log_id AND m.pull_id = s.pull_id
   JOIN enc_single g ON g.encounter_id = m.encounter_id LEFT JOIN npc n ON n.npc_id = s.npc_id
   WHERE counts AND lower(coalesce(n.name, s.raw_name)) = lower(g.name) GROUP BY s.log_id, s.pull_id, s.npc_id, s.instance_id)
SELECT log_id, pull_id, arg_min(first_ts, first_line) AS reset_at FROM (
 SELECT a.*, EXISTS (SELECT 1 FROM inst b WHERE b.log_id = a.log_id AND b.pull_id = a.pull_id AND b.npc_id = a.npc_id AND b.first_line < a.first_line
   AND (b.death_line IS NULL OR b.death_line > a.first_line)) AS hit FROM inst a) WHERE hit GROUP BY ALL"""
)


_OUTCOME = (
    "log_id, pull_id, pull_index, started_at, ended_at, duration_ms, end_reason, encounter_id, cleared, boss_npc_id, is_likely_boss, outcome"
)


@on_gaps("pull_outcome", f"SELECT {_OUTCOME} FROM outcomes")
def _outcome(f):
    return f.outcomes.select(*_OUTCOME.split(", "))


@on_gaps(
    "terminal_evidence",
    """SELECT o.log_id, o.pull_id, encounter_id, outcome,
 CASE WHEN outcome = 'kill' AND e.said IS NOT NULL THEN 'victory-event' WHEN outcome = 'kill' THEN CASE WHEN cleared THEN 'required-targets-dead' ELSE 'boss-death' END
  WHEN outcome = 'wipe' THEN CASE WHEN players_dead > 0 THEN 'raid-wipe' ELSE 'encounter-reset' END ELSE end_reason END AS evidence_kind,
 CASE WHEN outcome = 'kill' THEN coalesce(e.ts_ms, ended_at) ELSE ended_at END AS evidence_at
FROM outcomes o LEFT JOIN evidence e ON e.log_id = o.log_id AND e.pull_id = o.pull_id WHERE encounter_id IS NOT NULL""",
)
def _terminal(f):
    return encounters.terminal_evidence(f.outcomes, f.evidence).drop("evidence_detail")


# Deaths.

@on_gaps(
    "death_records",
    """SELECT d.log_id, d.pull_id, d.player_id, d.name, d.death_line, d.died_at, d.died_at - p.started_at AS offset_ms,
 h.ability_name AS killing_blow_ability, h.source_name AS killing_blow_source
FROM pdeaths d ASOF LEFT JOIN (SELECT * FROM t WHERE type = 'damage' AND target_kind = 'player') h
 ON h.log_id = d.log_id AND h.pull_id = d.pull_id AND h.target_id = d.player_id AND d.death_line > h.line_number
JOIN pulls p ON p.log_id = d.log_id AND p.pull_id = d.pull_id""",
)
def _death_records(f):
    return deaths.death_records(f.tagged, f.pulls, O)


_ENTRY = (
    "log_id, pull_id, player_id, death_line, died_at, line_number, ts_ms, offset_ms, kind, ability, source, amount, effective, critical, "
    "absorbed, mitigation, defensive_category, hp"
)


@on_gaps("death_audit_entries", f"SELECT {_ENTRY}, round(hp_percent, 4) AS hp_percent FROM audit")
def _audit(f):
    return rounded(deaths.audit_entries(f.tagged, f.catalog.defensives, O), "hp_percent").select(*_ENTRY.split(", "), "hp_percent")


@on_gaps(
    "death_audit_totals",
    """SELECT d.log_id, d.pull_id, d.player_id, d.death_line, d.name, d.died_at, CAST(coalesce(s.taken, 0) AS BIGINT) AS damage_taken,
 CAST(coalesce(s.healed, 0) AS BIGINT) AS healing_received, CAST(coalesce(s.largest, 0) AS BIGINT) AS largest_hit,
 s.blow.ability AS killing_blow_ability, s.blow.source AS killing_blow_source, CAST(s.blow.effective AS BIGINT) AS killing_blow_amount,
 coalesce(u.used, '') AS used, coalesce(u.active, '') AS active
FROM pdeaths d LEFT JOIN (
 SELECT log_id, pull_id, player_id, death_line, sum(effective) FILTER (kind = 'damage') AS taken, sum(effective) FILTER (kind = 'heal') AS healed,
  max(effective) FILTER (kind = 'damage') AS largest,
  arg_max({'ability': ability, 'source': source, 'effective': effective}, line_number) FILTER (kind = 'damage' AND effective > 0) AS blow
 FROM audit GROUP BY ALL) s USING (log_id, pull_id, player_id, death_line)
LEFT JOIN (
 SELECT log_id, pull_id, player_id, death_line, string_agg(ability, ',' ORDER BY ability) FILTER (used) AS used, string_agg(ability, ',' ORDER BY ability) FILTER (lastly = 'defensive') AS active
 FROM (SELECT log_id, pull_id, player_id, death_line, ability, bool_or(kind = 'defensive') AS used, arg_max(kind, line_number) AS lastly
  FROM audit WHERE kind IN ('defensive', 'defensiveEnd') GROUP BY ALL) GROUP BY ALL) u USING (log_id, pull_id, player_id, death_line)""",
)
def _audit_totals(f):
    entries = deaths.audit_entries(f.tagged, f.catalog.defensives, O)
    totals = deaths.audit_totals(entries, f.player_deaths, whole=True)
    return totals.withColumns(
        {
            "used": F.array_join(F.sort_array("defensives_used"), ","),
            "active": F.array_join(F.sort_array("defensives_active"), ","),
        }
    ).drop("defensives_used", "defensives_active")


# Effects and other as-of state.

@on_gaps(
    "effect_windows",
    """SELECT s.log_id, s.pull_id, s.effect_id, s.target_id, s.line_number AS apply_line, s.effect_name, s.source_id, s.ts_ms AS applied_at,
 (SELECT n.ts_ms FROM fx n WHERE n.log_id = s.log_id AND n.pull_id = s.pull_id AND n.effect_id = s.effect_id AND n.target_id = s.target_id AND n.w = s.w + 1 AND n.type <> 'modifyCharges') AS removed_at,
 (SELECT last(c.charges ORDER BY c.line_number) FROM fx c WHERE c.log_id = s.log_id AND c.pull_id = s.pull_id AND c.effect_id = s.effect_id AND c.target_id = s.target_id AND c.w = s.w) AS charges
FROM fx s WHERE s.type = 'applyEffect'""",
)
def _effect_windows(f):
    return effects.effect_windows(f.tagged, O)


@on_gaps(
    "charge_changes",
    """SELECT log_id, pull_id, line_number, effect_id, target_id, charges, CASE WHEN opened = 'applyEffect' THEN before END AS previous_charges FROM (
 SELECT *, first_value(type) OVER (PARTITION BY log_id, pull_id, effect_id, target_id, w ORDER BY line_number) AS opened,
  lag(charges) OVER (PARTITION BY log_id, pull_id, effect_id, target_id, w ORDER BY line_number) AS before FROM fx) WHERE type = 'modifyCharges'""",
)
def _charge_changes(f):
    return effects.charge_changes(f.tagged, O).select(*PULL, "line_number", "effect_id", "target_id", "charges", "previous_charges")


@on_gaps(
    "retargeted_casts",
    """SELECT log_id, pull_id, line_number, ts_ms, phase, ability_id, source_id, target_id,
 CASE WHEN target_id = source_id AND aim.id IS NOT NULL THEN aim.id ELSE target_id END AS resolved_target_id,
 CASE WHEN target_id = source_id AND aim.id IS NOT NULL THEN aim.npc ELSE target_npc_id END AS resolved_target_npc_id
FROM (SELECT *, last_value(CASE WHEN type = 'target' AND state = 'set' THEN {'id': target_id, 'npc': target_npc_id}
  WHEN type = 'target' THEN {'id': NULL, 'npc': NULL} END IGNORE NULLS)
  OVER (PARTITION BY log_id, pull_id, source_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS aim
 FROM t WHERE type IN ('ability', 'target') AND source_id IS NOT NULL) WHERE type = 'ability'""",
)
def _retarget(f):
    return effects.retarget_casts(f.tagged, O)


@on_gaps(
    "hp_latest",
    """SELECT log_id, pull_id, npc_id, round(last(pct ORDER BY line_number, slot), 4) AS hp_percent FROM (
 SELECT log_id, pull_id, line_number, slot, npc_id, CAST(hp AS DOUBLE) / max_hp * 100.0 AS pct FROM seen WHERE observed AND hp IS NOT NULL) GROUP BY ALL""",
)
def _hp_latest(f):
    return rounded(effects.latest_npc_health(f.tagged), "hp_percent")


_PHASES = """
 SELECT log_id, pull_id, line_number, ts_ms, max(candidate) OVER (PARTITION BY log_id, pull_id ORDER BY line_number) AS phase_order FROM (
  SELECT t.log_id, t.pull_id, t.line_number, any_value(t.ts_ms) AS ts_ms, max(CASE WHEN r.phase_order = 1
    OR CAST(t.target_hp AS DOUBLE) / t.target_max_hp * 100.0 <= r.threshold AND t.target_kind = 'npc'
    OR (txt <> '' AND (contains(txt, r.name) OR contains(txt, concat('phase ', CAST(r.phase_order AS VARCHAR)))))
    OR (t.type = 'death' AND lower(trim(t.target_name)) = r.death_name) THEN r.phase_order END) AS candidate
  FROM (SELECT *, trim(lower(concat(coalesce(ability_name, ''), ' ', coalesce(CASE WHEN type IN ('applyEffect', 'removeEffect') THEN effect_name END, '')))) AS txt FROM t) t
  JOIN matches m ON m.log_id = t.log_id AND m.pull_id = t.pull_id JOIN enc_phases r ON r.encounter_id = m.encounter_id
  GROUP BY t.log_id, t.pull_id, t.line_number)"""


@on_gaps("text_phases", f"SELECT log_id, pull_id, line_number, ts_ms, phase_order FROM ({_PHASES})")
def _text_phases(f):
    return effects.text_phases(f.tagged, f.matches, f.catalog.encounters, O)


@on_gaps(
    "phase_entries",
    f"""SELECT log_id, pull_id, phase_order, ts_ms AS started_at, lead(ts_ms) OVER (PARTITION BY log_id, pull_id ORDER BY line_number) AS ended_at, line_number
FROM (SELECT *, lag(phase_order) OVER (PARTITION BY log_id, pull_id ORDER BY line_number) AS before FROM ({_PHASES})) WHERE before IS NULL OR phase_order > before""",
)
def _phase_entries(f):
    return f.phase_entries.drop("next_line")


_PHASED = f"(SELECT t.*, h.phase_order AS segment_index FROM t JOIN ({_PHASES}) h USING (log_id, pull_id, line_number))"


@on_gaps(
    "phase_actor_metrics",
    f"""SELECT a.log_id, a.pull_id, segment_index, actor_id, CAST(sum(d) AS BIGINT) AS damage, CAST(sum(h) AS BIGINT) AS healing, CAST(sum(x) AS BIGINT) AS damage_taken,
 CAST(sum(n) AS BIGINT) AS actions, CAST(sum(k) AS BIGINT) AS interrupts, CAST(sum(f) AS BIGINT) AS deaths,
 greatest(0, last(ts_ms ORDER BY line_number, side) - first(ts_ms ORDER BY line_number, side)) AS active_ms,
 round(sum(d) / (CAST(any_value(greatest(1, coalesce(s.next_ts, p.ended_at) - s.started_at)) AS DOUBLE) / 1000.0), 4) AS dps
FROM (
 SELECT log_id, pull_id, segment_index, line_number, ts_ms, 0 AS side, source_id AS actor_id,
  CASE WHEN type = 'damage' THEN ap ELSE 0 END AS d, CASE WHEN type = 'heal' THEN ap ELSE 0 END AS h, 0 AS x,
  CASE WHEN type = 'ability' AND phase = 'activate' THEN 1 ELSE 0 END AS n, CASE WHEN type = 'ability' AND phase = 'interrupt' THEN 1 ELSE 0 END AS k, 0 AS f
 FROM {_PHASED} WHERE source_kind = 'player' AND ((type = 'damage' AND target_kind = 'npc') OR type = 'heal'
  OR (type = 'ability' AND ability_id IS NOT NULL AND (phase = 'activate' OR (phase = 'interrupt' AND ability_id IN (SELECT ability_id FROM kicks)))))
 UNION ALL
 SELECT log_id, pull_id, segment_index, line_number, ts_ms, 1, target_id, 0, 0, CASE WHEN type = 'damage' THEN ap ELSE 0 END, 0, 0, CASE WHEN type = 'death' THEN 1 ELSE 0 END
 FROM {_PHASED} WHERE target_kind = 'player' AND type IN ('damage', 'death')) a
JOIN (SELECT log_id, pull_id, phase_order AS segment_index, started_at, lead(started_at) OVER (PARTITION BY log_id, pull_id ORDER BY line_number) AS next_ts FROM (
  SELECT log_id, pull_id, phase_order, min(line_number) AS line_number, first(ts_ms ORDER BY line_number) AS started_at FROM ({_PHASES}) GROUP BY ALL)) s
 USING (log_id, pull_id, segment_index)
JOIN pulls p USING (log_id, pull_id) GROUP BY a.log_id, a.pull_id, segment_index, actor_id""",
)
def _phase_actors(f):
    found = metrics.phase_metrics(f.phased, effects.phase_bounds(f.phase_entries, f.pulls), f.catalog, whole=True)
    shown = ["damage", "healing", "damage_taken", "actions", "interrupts", "deaths", "active_ms", "dps"]
    return rounded(found.select(*PULL, "segment_index", "actor_id", *shown), "dps")


@on_gaps(
    "phase_enemy_players",
    f"""SELECT log_id, pull_id, segment_index, target_id AS instance_id, source_id AS player_id, CAST(sum(ap) AS BIGINT) AS damage, count(*) FILTER (amount > 0) AS damage_hits,
 count(*) FILTER (critical) AS critical_hits, first(ts_ms ORDER BY line_number) AS first_damage_at, last(ts_ms ORDER BY line_number) AS last_damage_at
FROM {_PHASED} WHERE type = 'damage' AND source_kind = 'player' AND target_kind = 'npc' GROUP BY ALL""",
)
def _phase_enemies(f):
    by_phase = [*PULL, "segment_index"]
    found = enemies.enemy_players(enemies.enemy_contributions(f.phased, by_phase), by_phase, whole=True)
    return found.select(*by_phase, "instance_id", "player_id", "damage", "damage_hits", "critical_hits", "first_damage_at", "last_damage_at")


@on_gaps(
    "phase_abilities",
    f"""SELECT log_id, pull_id, segment_index, ability_id, source_id AS player_id, count(*) FILTER (type = 'ability') AS casts,
 count(*) FILTER (type = 'damage' AND amount > 0) AS hits, count(*) FILTER (type = 'damage' AND amount <= 0) AS misses,
 CAST(sum(CASE WHEN type = 'damage' AND amount > 0 THEN ap ELSE 0 END) AS BIGINT) AS damage,
 count(DISTINCT CASE WHEN type = 'damage' THEN concat(target_kind, ':', target_id) END) AS targets
FROM {_PHASED} WHERE ((type = 'ability' AND phase = 'activate') OR type = 'damage') AND ability_id IS NOT NULL AND source_kind = 'player' GROUP BY ALL""",
)
def _phase_abilities(f):
    by = [*PULL, "segment_index", "ability_id", "player_id"]
    found = abilities.usage(abilities.ability_rows(f.phased, [*PULL, "segment_index"]), by, whole=True)
    return found.select(*by, "casts", "hits", "misses", "damage", "targets")


@register(
    "active_target",
    """SELECT log_id, line_number, ts_ms, CASE WHEN now - label.at <= 3600000 THEN label.name END AS active_target FROM (
 SELECT *, max(ts_ms) OVER w AS now, last_value(CASE WHEN (type = 'damage' AND source_kind = 'player' AND target_kind = 'npc' AND source_id = local_player_id)
   OR (type = 'target' AND state = 'set' AND target_kind = 'npc') THEN {'name': target_name, 'at': ts_ms} END IGNORE NULLS) OVER w AS label
 FROM ctx WINDOW w AS (PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
def _active_target(spark, sf_dir):
    return effects.active_target(segment.session_context(combat_events(spark, sf_dir), O), O, hold_ms=3_600_000)


@register(
    "event_rate",
    """SELECT log_id, line_number, ts_ms, count(*) OVER (PARTITION BY log_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS events FROM ev""",
)
def _event_rate(spark, sf_dir):
    return effects.event_rate(combat_events(spark, sf_dir), span_ms=3_600_000).drop("events_per_second")


# Roll-ups.

@on_gaps(
    "combat_timeline",
    """SELECT log_id, 'boss' AS kind, pull_id AS fight_id, encounter_id AS subject, started_at, ended_at, duration_ms, outcome FROM outcomes WHERE encounter_id IS NOT NULL
UNION ALL SELECT * FROM trash""",
)
def _timeline(f):
    return rollups.combat_timeline(f.outcomes, f.enemies, f.enemy_players).orderBy("log_id", "started_at", "ended_at", "fight_id")


@on_gaps("trash_encounters", "SELECT * FROM trash")
def _trash(f):
    return rollups.trash_encounters(f.outcomes, f.enemies, f.enemy_players)


@on_gaps(
    "operation_fights",
    """SELECT log_id, operation_id, operation_name, first_value(started_at) OVER (PARTITION BY log_id, operation_id ORDER BY enc_order, started_at, pull_index) AS group_started_at,
 enc_order, encounter_id, pull_id, pull_index, started_at, outcome FROM outcomes JOIN enc USING (encounter_id) JOIN ops USING (operation_id)""",
)
def _operation_fights(f):
    return rollups.ordered_operation_fights(rollups.operation_fights(f.outcomes, f.catalog))


_GUILD = "CAST(log_id % 3 AS VARCHAR) AS guild_id"


def of_guilds(fights: DataFrame) -> DataFrame:
    """Fights with the tenant they belong to: logs are dealt among three guilds."""
    return fights.withColumn("guild_id", (F.col("log_id") % 3).cast("string"))


@on_gaps(
    "progression",
    f"""SELECT {_GUILD}, encounter_id, count(*) AS attempts, count(*) FILTER (outcome = 'kill') AS kills, min(started_at) FILTER (outcome = 'kill') AS first_kill_at,
 round(min(remaining) FILTER (outcome <> 'kill'), 4) AS best_wipe_percent FROM fights WHERE encounter_id IS NOT NULL GROUP BY ALL""",
)
def _progression(f):
    return rounded(rollups.progression(of_guilds(f.fights), ["guild_id", "encounter_id"]), "best_wipe_percent")


@on_gaps(
    "encounter_matrix",
    f"""SELECT {_GUILD}, encounter_id, encounter_name, count(*) FILTER (outcome = 'kill') AS kills, count(*) FILTER (outcome = 'wipe') AS wipes FROM fights JOIN enc USING (encounter_id) GROUP BY ALL""",
)
def _matrix(f):
    return rollups.encounter_matrix(of_guilds(f.fights), f.catalog.encounters, ["guild_id"])


@on_gaps(
    "encounter_history",
    f"""SELECT {_GUILD}, encounter_id, count(*) AS fights, count(*) FILTER (outcome = 'kill') AS clears, count(*) FILTER (outcome = 'wipe') AS wipes,
 CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS average_duration_ms, CAST(sum(player_deaths) AS BIGINT) AS total_deaths, min(started_at) AS first_at, max(started_at) AS last_at
FROM fights WHERE encounter_id IS NOT NULL GROUP BY ALL""",
)
def _history(f):
    return rollups.encounter_history(of_guilds(f.fights), ["guild_id"])


_REPORT = """SELECT log_id, count(*) AS fight_count, count(encounter_id) AS boss_fights, count(*) FILTER (outcome = 'kill') AS kill_count, count(*) FILTER (outcome = 'wipe') AS wipe_count,
 count(*) FILTER (outcome = 'incomplete') AS incomplete_count, CAST(sum(player_deaths) AS BIGINT) AS deaths, CAST(sum(damage) AS BIGINT) AS damage,
 min(started_at) AS started_at, max(ended_at) AS ended_at FROM fights GROUP BY ALL"""


@on_gaps("report_totals", _REPORT)
def _reports(f):
    return rollups.report_totals(f.fights)


@on_gaps(
    "recent_reports",
    f"SELECT CAST(log_id AS VARCHAR) AS report_code, started_at, kill_count, fight_count FROM ({_REPORT}) WHERE log_id % 3 = 1 ORDER BY started_at DESC, report_code LIMIT 50",
)
def _recent_reports(f):
    totals = rollups.report_totals(f.fights).withColumns(
        {"guild_id": (F.col("log_id") % 3).cast("string"), "report_code": F.col("log_id").cast("string")}
    )
    return sinks.list_reports(totals, "1").select("report_code", "started_at", "kill_count", "fight_count")


@on_gaps(
    "session_counters",
    """SELECT e.log_id, e.n AS events_parsed, 0 AS unknown_lines, count(*) FILTER (encounter_id IS NOT NULL AND duration_ms >= 10000) AS boss_pulls,
 count(*) FILTER (encounter_id IS NOT NULL AND outcome = 'kill') AS boss_kills, count(*) FILTER (encounter_id IS NOT NULL AND outcome = 'wipe') AS boss_wipes,
 CAST(sum(player_deaths) AS BIGINT) AS raid_deaths,
 count(*) FILTER ((f.log_id, f.pull_id, f.local_player_id) IN (SELECT log_id, pull_id, player_id FROM pdeaths)) AS own_deaths
FROM fights f JOIN (SELECT log_id, count(*) AS n FROM ev GROUP BY ALL) e ON e.log_id = f.log_id GROUP BY e.log_id, e.n""",
)
def _counters(f):
    return rollups.session_counters(f.events, f.fights, f.player_deaths)


_MARKED = f"""SELECT *, {_GUILD}, row_number() OVER w AS attempts, CAST(sum(CASE WHEN outcome = 'kill' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS kills,
  min(CASE WHEN outcome <> 'kill' THEN remaining END) OVER (PARTITION BY log_id % 3, encounter_id ORDER BY started_at, log_id, pull_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
 FROM fights WHERE encounter_id IS NOT NULL AND outcome <> 'incomplete' AND boss_instance_id IS NOT NULL
 WINDOW w AS (PARTITION BY log_id % 3, encounter_id ORDER BY started_at, log_id, pull_index)"""


@on_gaps(
    "announcements",
    f"""SELECT * FROM (SELECT log_id, pull_id, guild_id, encounter_id, attempts, kills, round(best, 4) AS previous_best,
 CASE WHEN outcome = 'kill' THEN CASE WHEN kills = 1 THEN 'firstKill' ELSE 'kill' END
  WHEN remaining IS NOT NULL AND (best IS NULL OR remaining < best) AND remaining <= 15 THEN 'closeWipe' END AS kind FROM ({_MARKED})) WHERE kind IS NOT NULL""",
)
def _announcements(f):
    rows = rollups.announcements(of_guilds(f.fights), O, scope=["guild_id"])
    return rounded(rows, "previous_best").select(*PULL, "guild_id", "encounter_id", "attempts", "kills", "previous_best", "kind")


@on_gaps("announcement_texts")
def _announcement_texts(f):
    enc = f.catalog.list_encounters().select(F.col("id").alias("encounter_id"), F.col("name").alias("encounter_name"), "operation_name")
    announced = rollups.announcements(of_guilds(f.fights), O, scope=["guild_id"]).join(enc, "encounter_id")
    roles = rollups.composition(f.actors)
    return rollups.announcement_text(announced, roles, rollups.top_damage(f.actors), "https://reports.example")


@on_gaps(
    "meter_rows",
    """SELECT log_id, pull_id, actor_id, name, role, rank, total, deaths, round(dps, 4) AS rate, round(dps / lead_rate, 4) AS share, round(overheal_percent, 4) AS overheal_percent FROM (
 SELECT *, damage AS total, row_number() OVER (PARTITION BY log_id, pull_id ORDER BY dps DESC, name, actor_id) AS rank, max(dps) OVER (PARTITION BY log_id, pull_id) AS lead_rate FROM rated WHERE dps > 0)""",
)
def _meter(f):
    return rounded(rollups.meter_rows(f.actors, "dps"), "rate", "share", "overheal_percent")


@on_gaps(
    "meter_totals",
    "SELECT log_id, pull_id, round(sum(hps), 4) AS raid_total FROM rated WHERE hps > 0 GROUP BY ALL",
)
def _meter_totals(f):
    return rounded(rollups.meter_total(rollups.meter_rows(f.actors, "hps")), "raid_total")


@on_gaps("fight_totals", "SELECT log_id, pull_id, CAST(sum(damage) AS BIGINT) AS total_damage, CAST(sum(healing) AS BIGINT) AS total_healing, max(damage) AS max_damage FROM rated GROUP BY ALL")
def _fight_totals(f):
    return rollups.fight_totals(f.actors)


@on_gaps(
    "top_damage",
    """SELECT log_id, pull_id, string_agg(concat(CAST(rank AS VARCHAR), '. ', name, ' — ', CASE WHEN dps >= 1000000 THEN printf('%.2fm', dps / 1000000) WHEN dps >= 1000 THEN printf('%.1fk', dps / 1000) ELSE CAST(CAST(floor(dps + 0.5) AS BIGINT) AS VARCHAR) END, ' dps'), chr(10) ORDER BY rank) AS top_damage
FROM (SELECT *, row_number() OVER (PARTITION BY log_id, pull_id ORDER BY dps DESC, actor_id) AS rank FROM rated WHERE damage > 0) WHERE rank <= 3 GROUP BY ALL""",
)
def _top_damage(f):
    return rollups.top_damage(f.actors)


@on_gaps(
    "composition",
    """SELECT log_id, pull_id, count(*) FILTER (role = 'tank') AS tank, count(*) FILTER (role = 'healer') AS healer, count(*) FILTER (role = 'dps') AS dps,
 concat(CAST(count(*) FILTER (role = 'tank') AS VARCHAR), ' tank · ', CAST(count(*) FILTER (role = 'healer') AS VARCHAR), ' heal · ', CAST(count(*) FILTER (role = 'dps') AS VARCHAR), ' dps') AS composition
FROM rated GROUP BY ALL""",
)
def _composition(f):
    return rollups.composition(f.actors)


@on_gaps("fight_documents", tagged_once=True)
def _documents(f):
    life = f.enemies
    return rollups.fight_document(f.fights, f.actors.drop("duration_ms"), deaths.death_records(f.tagged, f.pulls, O), f.buckets, f.ability_usage, life)


@on_gaps("live_snapshots")
def _snapshots(f):
    return sinks.live_snapshots(rollups.live_filter(f.outcomes), f.actors, f.catalog.encounters)


# Storage.

@on_gaps(
    "storage_buckets",
    """SELECT log_id, pull_id, bucket_index, part, started_at + bucket_index * 3600000 AS bucket_started_at, started_at + (bucket_index + 1) * 3600000 AS bucket_ended_at,
 started_at + bucket_index * 3600000 + 604800000 AS expires_at, count(*) AS event_count, min(line_number) AS first_line, max(line_number) AS last_line FROM (
 SELECT b.log_id, b.pull_id, p.started_at, bucket_index, line_number, CAST((row_number() OVER (PARTITION BY b.log_id, b.pull_id, bucket_index ORDER BY line_number) - 1) // 4 AS BIGINT) AS part
 FROM bucketed b JOIN pulls p ON p.log_id = b.log_id AND p.pull_id = b.pull_id) GROUP BY ALL""",
)
def _storage(f):
    return sinks.storage_buckets(sinks.storage_rows(f.tagged, f.pulls, O))


@on_gaps(
    "unexpired_buckets",
    """SELECT log_id, pull_id, bucket_index, CAST(count(*) AS BIGINT) AS events FROM bucketed b JOIN pulls p USING (log_id, pull_id)
WHERE p.started_at + bucket_index * 3600000 + 604800000 > 1706000000000 GROUP BY ALL""",
)
def _unexpired(f):
    kept = sinks.unexpired(sinks.storage_buckets(sinks.storage_rows(f.tagged, f.pulls, O)), F.lit(1_706_000_000_000))
    return kept.groupBy(*PULL, "bucket_index").agg(F.sum("event_count").alias("events"))


@on_gaps(
    "stored_events",
    """SELECT 'g' AS guild_id, CAST(log_id AS VARCHAR) AS report_code, pull_id AS fight_id, line_number, type, bucket_index,
 CAST((row_number() OVER (PARTITION BY log_id, pull_id, bucket_index ORDER BY line_number) - 1) // 4 AS BIGINT) AS part FROM bucketed""",
)
def _stored_events(f):
    rows = staged(sinks.storage_rows(f.tagged, f.pulls, O).select(*PULL, "line_number", "type", "bucket_index", "part"), packed=True)  # sent twice
    path = new_path(f.events.sparkSession, "events")
    sinks.write_event_buckets(rows, "g", path)
    sinks.write_event_buckets(rows.filter("bucket_index % 2 = 0"), "g", path)  # sent again
    stored = f.events.sparkSession.read.schema("line_number bigint, type string, bucket_index bigint, part bigint, guild_id string, report_code string, fight_id string")
    return stored.parquet(path)


@on_gaps(
    "stored_fights",
    """SELECT 'g' AS guild_id, CAST(log_id AS VARCHAR) AS report_code, pull_id AS event_id,
 CASE WHEN pull_index % 2 = 0 THEN outcome ELSE 'pending' END AS outcome, CAST(CASE WHEN pull_index % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS updated_at
FROM outcomes WHERE encounter_id IS NOT NULL""",
)
def _stored_fights(f):
    path, known = new_path(f.events.sparkSession, "fights"), sinks.fight_documents(f.fights, "g")

    def version(number: int, outcome) -> DataFrame:
        return known.select("guild_id", "report_code", "event_id", outcome.alias("outcome"), F.lit(number).cast("bigint").alias("updated_at"), "fight_id")

    sinks.upsert_fights(version(1, F.lit("pending")), path)
    sinks.upsert_fights(version(2, F.col("outcome")).filter("fight_id % 2 = 0"), path)
    sinks.upsert_fights(version(0, F.lit("late")), path)  # an older version that arrives last changes nothing
    return f.events.sparkSession.read.schema("event_id string, outcome string, updated_at bigint, guild_id string, report_code string").parquet(path)


@on_gaps("bucket_round_trip", "SELECT CAST(NULL AS VARCHAR) AS check, CAST(NULL AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS detail WHERE false")
def _round_trip(f):
    rows = sinks.storage_rows(f.tagged, f.pulls, O)
    packed = sinks.storage_buckets(rows, ["line_number", "type"])
    return quality.bucket_round_trip(f.tagged, sinks.merge_buckets(packed), PULL)


@on_gaps("report_headers")
def _headers(f):
    return sinks.report_headers(f.fights, f.actors)


@on_gaps("pull_event_ids")
def _event_ids(f):
    boss = f.outcomes.filter(F.col("encounter_id").isNotNull()).withColumn("fight_id", F.col("pull_id"))
    return sinks.distinct_pulls(boss, "boss", F.concat(F.lit("log-"), F.col("log_id").cast("string"))).select(*PULL, "event_id")


@on_gaps("export_envelopes")
def _envelopes(f):
    file_name = F.concat(F.lit("log-"), F.col("log_id").cast("string"))
    guild = F.lit("default").alias("guild_id")
    boss = sinks.pull_envelopes(
        f.outcomes.withColumn("guild_id", guild), file_name, F.col("local_player_id"), F.col("ctx_server_id"), f.catalog.encounters
    )
    trash = rollups.trash_encounters(f.outcomes, f.enemies, f.enemy_players).withColumn("guild_id", guild)
    records = sinks.trash_envelopes(trash, file_name, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return boss.unionByName(records.withColumnRenamed("fight_id", "pull_id"))


# Schedule and signups over customers and orders.

def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS operation_id", "c_nationkey % 3 AS guild_id", "concat('Raid ', c_mktsegment) AS title",
        "CAST(dateadd(DAY, CAST(c_custkey % 60 AS INT), TIMESTAMP_NTZ '1999-01-01 00:00:00') AS TIMESTAMP_NTZ) AS scheduled_for",
        "CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 END AS group_size",
        "CASE c_custkey % 4 WHEN 0 THEN 'Story' WHEN 1 THEN 'Veteran' WHEN 2 THEN 'Master' END AS difficulty",
        "CASE WHEN c_acctbal < 0 THEN TIMESTAMP_NTZ '1998-12-31 00:00:00' END AS cancelled_at",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS operation_id", "o_orderkey % 40 AS user_id", "concat('User ', CAST(o_orderkey % 40 AS STRING)) AS display_name",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('Char ', CAST(o_orderkey % 40 AS STRING)) END AS character_name",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'tank' WHEN '2-HIGH' THEN 'healer' WHEN '3-MEDIUM' THEN 'dps' "
        "WHEN '4-NOT SPECIFIED' THEN 'bench' ELSE 'declined' END AS status",
        "o_orderdate AS responded_at", "o_orderkey AS signup_order",
    )


def _latest(spark, sf_dir):
    return roster.latest_signups(answers(spark, sf_dir), ["responded_at", "signup_order"])


@register("signup_latest", "SELECT operation_id, user_id, display_name, character_name, status, responded_at, signup_order FROM answers")
def _signup_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


@register("signup_places", "SELECT operation_id, user_id, status, place, role_limit, placement FROM placed")
def _signup_places(spark, sf_dir):
    placed = roster.place_signups(_latest(spark, sf_dir), schedule(spark, sf_dir))
    return placed.select("operation_id", "user_id", "status", "place", "role_limit", "placement")


_NEEDED = """concat_ws(', ', CASE WHEN open_tanks > 0 THEN concat(CAST(open_tanks AS VARCHAR), ' tank') END, CASE WHEN open_healers > 0 THEN concat(CAST(open_healers AS VARCHAR), ' heal') END,
 CASE WHEN open_dps > 0 THEN concat(CAST(open_dps AS VARCHAR), ' dps') END)"""


@register("roster_summary", f"SELECT *, CASE WHEN is_full OR {_NEEDED} = '' THEN 'Full' ELSE concat('Needs ', {_NEEDED}) END AS open_text FROM roster")
def _roster_summary(spark, sf_dir):
    ops = schedule(spark, sf_dir)
    return roster.roster_summary(roster.place_signups(_latest(spark, sf_dir), ops), ops)


@register(
    "roster_suggestion",
    """SELECT operation_id, user_id, status, place, CASE WHEN place <= CASE status WHEN 'tank' THEN l.tanks WHEN 'healer' THEN l.healers WHEN 'dps' THEN l.dps ELSE 0 END THEN status ELSE 'bench' END AS suggestion
FROM (SELECT *, row_number() OVER (PARTITION BY operation_id, status ORDER BY signup_order) AS place FROM answers WHERE status <> 'declined') a JOIN lim l USING (operation_id)""",
)
def _suggestion(spark, sf_dir):
    suggested = roster.suggest_core(_latest(spark, sf_dir), schedule(spark, sf_dir))
    return suggested.select("operation_id", "user_id", "status", "place", "suggestion")


@register(
    "roster_bench",
    """SELECT operation_id, user_id, status FROM (SELECT *, row_number() OVER (PARTITION BY operation_id, status ORDER BY signup_order) AS place FROM answers WHERE status <> 'declined') a JOIN lim l USING (operation_id)
WHERE place > CASE status WHEN 'tank' THEN l.tanks WHEN 'healer' THEN l.healers WHEN 'dps' THEN l.dps ELSE 0 END""",
)
def _bench(spark, sf_dir):
    latest = _latest(spark, sf_dir)
    return roster.bench_of(latest, roster.suggest_core(latest, schedule(spark, sf_dir))).select("operation_id", "user_id", "status")


_UPCOMING = "guild_id = 1 AND cancelled_at IS NULL AND scheduled_for >= TIMESTAMP '1999-01-20 00:00:00'"


@register("upcoming_operations", f"SELECT operation_id, title, scheduled_for FROM schedule WHERE {_UPCOMING} ORDER BY scheduled_for")
def _upcoming(spark, sf_dir):
    listed = roster.upcoming(schedule(spark, sf_dir), 1, F.expr("TIMESTAMP_NTZ '1999-01-20 00:00:00'"))
    return listed.select("operation_id", "title", "scheduled_for").orderBy("scheduled_for", "operation_id")


@register(
    "schedule_headline",
    f"""SELECT arg_min(title, (scheduled_for, operation_id)) AS next_title, min(scheduled_for) AS next_time, count(*) AS upcoming_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_signups
FROM (SELECT * FROM schedule WHERE {_UPCOMING}) LEFT JOIN (SELECT operation_id, count(*) AS n FROM answers GROUP BY ALL) USING (operation_id)""",
)
def _headline(spark, sf_dir):
    listed = roster.upcoming(schedule(spark, sf_dir), 1, F.expr("TIMESTAMP_NTZ '1999-01-20 00:00:00'"))
    return roster.schedule_headline(listed, _latest(spark, sf_dir))


@register(
    "calendar_totals",
    """SELECT CAST(sum(CASE WHEN cancelled_at IS NULL THEN open_tanks + open_healers + open_dps ELSE 0 END) AS BIGINT) AS open_slots, CAST(sum(signups) AS BIGINT) AS signups
FROM roster JOIN schedule USING (operation_id)""",
)
def _calendar(spark, sf_dir):
    ops = schedule(spark, sf_dir)
    summary = roster.roster_summary(roster.place_signups(_latest(spark, sf_dir), ops), ops)
    return roster.calendar_totals(summary, ops)


@register("signup_sheets")
def _sheets(spark, sf_dir):
    ops = schedule(spark, sf_dir)
    placed = roster.place_signups(_latest(spark, sf_dir), ops)
    return roster.signup_sheet(placed, ops, roster.roster_summary(placed, ops))


@register(
    "operation_versions",
    """SELECT operation_id, arg_max(title, (changed_at, n)) FILTER (title IS NOT NULL) AS title, arg_max(group_size, (changed_at, n)) FILTER (group_size IS NOT NULL) AS group_size,
 arg_max(tanks, (changed_at, n)) FILTER (tanks IS NOT NULL) AS tanks, arg_max(cancelled_at, (changed_at, n)) FILTER (cancelled_at IS NOT NULL) AS cancelled_at
FROM (SELECT *, CASE group_size WHEN 16 THEN 4 WHEN 4 THEN 1 WHEN 8 THEN 2 END AS tanks FROM (
 SELECT o_custkey AS operation_id, o_orderdate AS changed_at, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN concat('Title ', CAST(o_orderkey AS VARCHAR)) END AS title,
  CASE o_orderkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 END AS group_size, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS cancelled_at FROM orders)) GROUP BY ALL""",
)
def _versions(spark, sf_dir):
    changes = read_table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS operation_id", "o_orderdate AS changed_at", "o_orderkey AS n",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('Title ', CAST(o_orderkey AS STRING)) END AS title",
        "CASE o_orderkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 END AS group_size",
        "CAST(NULL AS struct<tanks:int,healers:int,dps:int>) AS limits", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS cancelled_at",
    )
    state = roster.operation_versions(changes, ["title", "group_size"], ["changed_at", "n"])
    return state.select("operation_id", "title", "group_size", F.col("limits.tanks").alias("tanks"), "cancelled_at")


@register(
    "operation_titles",
    """SELECT c_custkey AS request, coalesce(t.title, CASE WHEN o.operation_name IS NOT NULL THEN concat_ws(' · ', o.operation_name, e.encounter_name) END, 'Operation') AS title
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat('Raid ', c_mktsegment) END AS title, CASE c_custkey % 4 WHEN 0 THEN 'opa' WHEN 1 THEN 'opb' WHEN 2 THEN 'none' END AS op,
 CASE c_custkey % 3 WHEN 0 THEN 'e1' WHEN 1 THEN 'e3' END AS en FROM customer) t LEFT JOIN ops o ON o.operation_id = t.op LEFT JOIN enc e ON e.encounter_id = t.en""",
)
def _titles(spark, sf_dir):
    cat = sample_catalog(spark)
    requests = read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request", "CASE WHEN c_custkey % 5 = 0 THEN concat('Raid ', c_mktsegment) END AS title",
        "CASE c_custkey % 4 WHEN 0 THEN 'opa' WHEN 1 THEN 'opb' WHEN 2 THEN 'none' END AS operation_ref",
        "CASE c_custkey % 3 WHEN 0 THEN 'e1' WHEN 1 THEN 'e3' END AS encounter_ref",
    )
    return roster.operation_titles(requests, cat.operations, cat.encounters).select("request", "title")


@register(
    "default_characters",
    """SELECT a.operation_id, a.user_id, coalesce(a.character_name, f.name) AS character_name FROM answers a LEFT JOIN (
 SELECT user_id, arg_min(name, n) AS name FROM (SELECT c_custkey % 20 * 2 AS user_id, c_name AS name, c_custkey AS n FROM customer) GROUP BY ALL) f USING (user_id)""",
)
def _default_characters(spark, sf_dir):
    linked = read_table(spark, sf_dir, "customer").selectExpr(  # every customer; users of odd number have no character
        "c_custkey % 20 * 2 AS user_id", "c_name AS name", "c_custkey AS linked_order"
    )
    return roster.default_character(_latest(spark, sf_dir), linked).select("operation_id", "user_id", "character_name")


# Characters.

def seen_and_linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scanned = segment.session_context(combat_events(spark, sf_dir), O).filter(combat.player("source"))
    rows = scanned.select(
        F.col("log_id").alias("owner_id"), F.col("source_id").alias("player_id"), F.col("ctx_server_id").alias("server_id"),
        F.col("source_name").alias("name"), F.col("line_number").alias("seen_order"),
    )
    live = F.col("seen_order") % 2 == 1
    seen = accounts.seen_characters(rows.filter(~live), rows.filter(live))
    linked = read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 12 AS user_id", "CAST(o_custkey % 1500 AS STRING) AS player_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'he0' WHEN 1 THEN 'he1' END AS server_id",
    ).distinct()
    return seen, linked


@register("seen_characters", "SELECT owner_id, player_id, server_id, name FROM seen_chars")
def _seen(spark, sf_dir):
    return seen_and_linked(spark, sf_dir)[0]


@register(
    "available_characters",
    """SELECT s.* FROM seen_chars s WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.user_id = s.owner_id AND l.player_id = s.player_id AND l.server_id IS NOT DISTINCT FROM s.server_id)""",
)
def _available(spark, sf_dir):
    return accounts.available_characters(*seen_and_linked(spark, sf_dir))


_CLAIM = "SELECT owner_id AS user_id, player_id, server_id FROM seen_chars"


@register(
    "claimed_characters",
    f"""SELECT c.* FROM ({_CLAIM}) c WHERE EXISTS (SELECT 1 FROM linked l WHERE l.user_id <> c.user_id AND l.player_id = c.player_id AND l.server_id IS NOT DISTINCT FROM c.server_id)""",
)
def _claimed(spark, sf_dir):
    seen, linked = seen_and_linked(spark, sf_dir)
    return accounts.claimed_by_others(seen.select(F.col("owner_id").alias("user_id"), "player_id", "server_id"), linked)


@register(
    "proven_claims",
    """SELECT l.user_id, l.player_id, l.server_id FROM linked l WHERE EXISTS (SELECT 1 FROM seen_chars s WHERE s.owner_id = l.user_id AND s.player_id = l.player_id AND s.server_id IS NOT DISTINCT FROM l.server_id)""",
)
def _proven(spark, sf_dir):
    seen, linked = seen_and_linked(spark, sf_dir)
    return accounts.proven_claims(linked, seen)


# Catalogue maintenance over the part table and the events.

_RECORDS = """SELECT CAST(p_partkey % 300 AS VARCHAR(20)) AS npc_id, p_name AS name, CASE WHEN p_size % 9 = 0 THEN 'mechanic' ELSE 'boss' END AS role,
 p_size % 4 = 0 AS is_kill_target, p_size % 5 = 0 AS triggers_encounter, p_size % 7 = 0 AS single_instance,
 p_type AS encounter_id, p_type AS encounter_name, p_brand AS operation_name, 'part' AS source, p_partkey AS seq FROM part"""


@register(
    "catalog_merge",
    f"""SELECT npc_id, arg_min(name, seq) AS name, arg_min(role, seq) AS role, arg_min(encounter_id, seq) AS encounter_id, arg_min(operation_name, seq) AS operation_name,
 bool_or(is_kill_target) AS is_kill_target, bool_or(triggers_encounter) AS triggers_encounter, bool_or(single_instance) AS single_instance,
 (count(DISTINCT role) > 1 OR count(DISTINCT encounter_id) > 1 OR count(DISTINCT operation_name) > 1) AS ambiguous,
 (SELECT string_agg(q.name, ',' ORDER BY q.first) FROM (SELECT npc_id, name, min(seq) AS first FROM ({_RECORDS}) GROUP BY ALL) q WHERE q.npc_id = r.npc_id) AS names
FROM ({_RECORDS}) r GROUP BY npc_id""",
)
def _catalog_merge(spark, sf_dir):
    records = read_table(spark, sf_dir, "part").selectExpr(*[_spark(c) for c in _select_list(_RECORDS)])
    merged = catalogs.merge_npc_records(records)
    return merged.withColumn("names", F.array_join("names", ",")).drop("encounter_name", "source")


def _select_list(select: str) -> list[str]:
    """The expressions of a flat SELECT, split at its top-level commas."""
    body, depth, parts, current = select[len("SELECT "): select.rindex(" FROM ")], 0, [], ""
    for character in body:
        depth += (character == "(") - (character == ")")
        if character == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += character
    return [p.strip() for p in [*parts, current]]


def _spark(expression: str) -> str:
    return expression.replace("VARCHAR(20)", "STRING")


_LEARNED = """SELECT concat('9000000000', CAST(100 + p_partkey % 50 AS VARCHAR(20))) AS ability_id, p_name AS ability, p_type AS discipline, p_brand AS discipline_id, p_partkey AS seq FROM part"""


@register(
    "ability_merge",
    f"""SELECT ability_id, arg_min(ability, seq) AS ability, arg_min(discipline, seq) AS discipline, arg_min(discipline_id, seq) AS discipline_id,
 (SELECT string_agg(q.discipline, ',' ORDER BY q.first) FROM (SELECT ability_id, discipline, min(seq) AS first FROM ({_LEARNED}) GROUP BY ALL) q WHERE q.ability_id = r.ability_id) AS disciplines
FROM ({_LEARNED}) r GROUP BY ability_id""",
)
def _ability_merge(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").selectExpr(*[_spark(c) for c in _select_list(_LEARNED)])
    return catalogs.merge_discipline_abilities(rows).withColumn("disciplines", F.array_join("disciplines", ","))


_ATTACKS = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x1' ELSE concat('9000000000', CAST(100 + p_partkey % 70 AS VARCHAR(20))) END AS ability_id, p_type AS attack_type, p_brand AS damage_type, p_name AS name, p_partkey AS seq FROM part"""


@register(
    "attack_types",
    f"SELECT ability_id, arg_max(attack_type, seq) AS attack_type, arg_max(damage_type, seq) AS damage_type, arg_max(name, seq) AS name FROM ({_ATTACKS}) WHERE ability_id <> 'x1' GROUP BY ability_id",
)
def _attack_types(spark, sf_dir):
    return catalogs.load_attack_types(read_table(spark, sf_dir, "part").selectExpr(*[_spark(c) for c in _select_list(_ATTACKS)]))


@register(
    "interrupt_ids",
    r"SELECT DISTINCT ability_id FROM (SELECT unnest(regexp_extract_all(text, '\b\d{12,}\b')) AS ability_id FROM documents)",
)
def _interrupt_ids(spark, sf_dir):
    return catalogs.interrupt_ids(read_table(spark, sf_dir, "documents"), "text")


@register(
    "observed_health",
    """SELECT npc_id, max(max_hp) AS max_hp, first(name ORDER BY max_hp DESC, log_id, line_number, slot) AS name FROM (
 SELECT log_id, line_number, 0 AS slot, source_npc_id AS npc_id, source_name AS name, source_max_hp AS max_hp FROM ev
 UNION ALL SELECT log_id, line_number, 1, target_npc_id, target_name, target_max_hp FROM ev) WHERE npc_id IS NOT NULL AND max_hp > 0 GROUP BY npc_id""",
)
def _observed(spark, sf_dir):
    return catalogs.observed_health(combat_events(spark, sf_dir))


@register("quality_checks")
def _quality(spark, sf_dir):
    events, cat = combat_events(spark, sf_dir), sample_catalog(spark)
    return (
        quality.unknown_lines(events)
        .unionByName(quality.bad_ids(cat.npc_catalog, "npc_id", "catalogue ids"))
        .unionByName(quality.bad_ids(cat.observed, "npc_id", "observed ids"))
        .unionByName(quality.encounter_integrity(cat.encounters, cat.operations))
        .unionByName(quality.health_drift(events, cat.observed))
    )


# The number formats, over fight totals.

@on_gaps(
    "formatted_fights",
    """SELECT log_id, pull_id, concat(CAST(CAST(floor(duration_ms / 60000) AS BIGINT) AS VARCHAR), ':', lpad(CAST(CAST(floor(duration_ms / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS length,
 strftime(timezone('America/New_York', timezone('UTC', make_timestamp(started_at * 1000))), '%H:%M') AS clock FROM pulls""",
)
def _formatted(f):
    return f.pulls.select(*PULL, text.duration(F.col("duration_ms")).alias("length"), text.clock(F.col("started_at")).alias("clock"))


# Text lines and wire batches made from the events.

def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written back as log lines, which the parser has to read as they were."""
    events = combat_events(spark, sf_dir)

    def actor(side: str):
        health = F.concat(F.lit("|(1.0,2.0,3.0,4.0)|("), F.coalesce(F.col(f"{side}_hp").cast("string"), F.lit("?")), F.lit("/"), F.col(f"{side}_max_hp").cast("string"), F.lit(")"))
        player = F.concat(F.lit("@"), F.col(f"{side}_name"), F.lit("#"), F.col(f"{side}_id"), health)
        npc = F.concat(F.col(f"{side}_name"), F.lit(" {"), F.col(f"{side}_npc_id"), F.lit("}:"), F.col(f"{side}_id"), health)
        return F.when(F.col(f"{side}_kind") == "player", player).when(F.col(f"{side}_kind") == "npc", npc).otherwise("")

    ability = F.when(F.col("ability_id").isNotNull(), F.concat("ability_name", F.lit(" {"), "ability_id", F.lit("}"))).otherwise("")
    effect = (
        F.when(F.col("type") == "damage", "ApplyEffect {836045448945477}: Damage {836045448945501}")
        .when(F.col("type") == "heal", "ApplyEffect {836045448945477}: Heal {836045448945500}")
        .when(F.col("type") == "applyEffect", F.concat(F.lit("ApplyEffect {836045448945477}: E {"), "effect_id", F.lit("}")))
        .when(F.col("type") == "removeEffect", F.concat(F.lit("RemoveEffect {836045448945478}: E {"), "effect_id", F.lit("}")))
        .when(F.col("type") == "death", "Event {836045448945472}: Death {836045448945493}")
        .when(F.col("type") == "ability", F.when(F.col("phase") == "activate", "Event {836045448945472}: A {836045448945479}").otherwise("Event {836045448945472}: I {836045448945482}"))
        .when(F.col("type") == "combatState", F.when(F.col("state") == "enter", "Event {836045448945472}: In {836045448945489}").otherwise("Event {836045448945472}: Out {836045448945490}"))
        .otherwise("not an effect")
    )
    crit = F.when(F.col("critical"), "*").otherwise("")
    landed = F.when(F.col("effective").isNotNull(), F.concat(F.lit(" ~"), F.col("effective").cast("string"))).otherwise("")
    avoided = F.when(F.col("mitigation").isNotNull(), F.concat(F.lit(" -"), "mitigation")).otherwise("")
    value = F.when(F.col("amount").isNotNull(), F.concat(F.lit(" ("), F.col("amount").cast("string"), crit, landed, avoided, F.lit(")"))).otherwise("")
    clock = F.date_format(F.timestamp_millis("ts_ms"), "HH:mm:ss.SSS")
    raw = F.concat(F.lit("["), clock, F.lit("] ["), actor("source"), F.lit("] ["), actor("target"), F.lit("] ["), ability, F.lit("] ["), effect, F.lit("]"), value)
    return events.select(
        F.concat(F.lit("log-"), F.col("log_id").cast("string")).alias("log_id"), F.lit("combat_2024-01-01_00_00_00.txt").alias("file_name"), "line_number", raw.alias("raw"),
    )


@register(
    "parse_lines",
    """SELECT concat('log-', CAST(log_id AS VARCHAR)) AS log_id, line_number,
 CASE WHEN type IN ('damage', 'heal', 'applyEffect', 'removeEffect', 'death', 'ability', 'combatState') THEN type ELSE 'unknown' END AS type,
 source_name, source_hp, CASE WHEN target_kind = 'npc' THEN target_npc_id END AS target_npc_id, ability_id,
 CAST(amount AS DOUBLE) AS amount, CAST(effective AS DOUBLE) AS effective, mitigation FROM ev""",
)
def _parse_lines(spark, sf_dir):
    events = parse.parse_lines(event_lines(spark, sf_dir), O)
    return events.select(
        "log_id", F.col("lineNumber").alias("line_number"), "type", F.col("source.name").alias("source_name"), F.col("source.hp").alias("source_hp"),
        F.col("target.npcId").alias("target_npc_id"), F.col("ability.id").alias("ability_id"), F.col("value.amount").alias("amount"),
        F.col("value.effective").alias("effective"), F.col("value.mitigation").alias("mitigation"),
    )


@register(
    "line_clock",
    """SELECT concat('log-', CAST(log_id AS VARCHAR)) AS log_id, line_number, CAST(1704067200000 + 86400000 * coalesce(sum(CASE WHEN before - tod > 43200000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY log_id ORDER BY line_number), 0) + tod AS BIGINT) AS timestamp
FROM (SELECT *, lag(tod) OVER (PARTITION BY log_id ORDER BY line_number) AS before FROM (SELECT log_id, line_number, ts_ms % 86400000 AS tod FROM ev))""",
)
def _line_clock(spark, sf_dir):
    lines = parse.with_slots(event_lines(spark, sf_dir))
    return parse.clock_times(lines, O).select("log_id", "line_number", "timestamp")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON batches of fifty lines per log, some of them damaged on purpose."""
    events = combat_events(spark, sf_dir)
    actor = F.when(
        F.col("source_kind") == "player",
        F.struct(F.lit("player").alias("kind"), F.col("source_name").alias("name"), F.col("source_id").alias("playerId"), F.col("source_hp").alias("hp"), F.col("source_max_hp").alias("maxHp")),
    )
    value = F.when(
        F.col("amount").isNotNull(),
        F.struct(F.lit("magnitude").alias("kind"), F.col("amount").cast("double").alias("amount"), "critical", F.col("damage_type").alias("damageType"), F.lit(False).alias("reflected")),
    )
    kept = events.filter(F.col("type").isin("damage", "heal", "death", "combatState"))
    event = F.struct(
        F.when(F.col("line_number") % 401 == 0, F.lit(-1)).otherwise(F.col("ts_ms")).alias("timestamp"), F.col("line_number").alias("lineNumber"),
        F.when(F.col("line_number") % 307 == 0, "nonsense").otherwise(F.col("type")).alias("type"), actor.alias("source"), value.alias("value"), "state",
        F.when(F.col("type") == "death", False).alias("revived"),
    )
    sequence = F.floor(F.col("line_number") / 50).cast("bigint")
    grouped = kept.groupBy("log_id", sequence.alias("sequence")).agg(F.array_sort(F.collect_list(F.struct("line_number", event.alias("e")))).getField("e").alias("events"))
    session = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("log_id").cast("string"), 12, "0"))
    return grouped.select("log_id", "sequence", F.to_json(F.struct(session.alias("sessionId"), "sequence", "events")).alias("value"))


@register(
    "wire_checks",
    """SELECT log_id, line_number // 50 AS sequence,
 CASE arg_min(fault, line_number) FILTER (fault IS NOT NULL) WHEN 1 THEN 'unknown event type' WHEN 2 THEN 'bad timestamp or line number' END AS reason FROM (
 SELECT *, CASE WHEN line_number % 307 = 0 THEN 1 WHEN line_number % 401 = 0 THEN 2 END AS fault FROM ev WHERE type IN ('damage', 'heal', 'death', 'combatState')) GROUP BY ALL""",
)
def _wire(spark, sf_dir):
    return wire.check_batches(wire.read_batches(batches(spark, sf_dir))).select("log_id", "sequence", "reason")


# Full segmentation.

@register(
    "pulls_full",
    f"SELECT log_id, start_line, started_at, ended_at, duration_ms, end_reason, {', '.join(CONTEXT)}, pull_index, pull_id FROM full_pulls",
    full=True,
)
def _pulls_full(spark, sf_dir):
    return full_fights(spark, sf_dir).pulls.drop("close_line")


@register(
    "fights_full",
    f"""SELECT {', '.join('o.' + c for c in _OUTCOME.split(', '))}, CAST(coalesce(k.n, 0) AS BIGINT) AS player_deaths, f.damage, f.remaining AS boss_remaining_percent
FROM outcomes o JOIN fights f USING (log_id, pull_id)
LEFT JOIN (SELECT log_id, pull_id, count(*) AS n FROM t WHERE type = 'death' AND target_kind = 'player' GROUP BY ALL) k USING (log_id, pull_id)""",
    full=True,
)
def _fights_full(spark, sf_dir):
    f = full_fights(spark, sf_dir)
    return f.fights.select(*_OUTCOME.split(", "), "player_deaths", "damage", "boss_remaining_percent")


@register(
    "actor_rates_full", "SELECT log_id, pull_id, actor_id, role, " + ", ".join(f"round({c}, 4) AS {c}" for c in RATES) + " FROM rated", full=True,
)
def _actors_full(spark, sf_dir):
    return rounded(full_fights(spark, sf_dir).actors.select(*PULL, "actor_id", "role", *RATES), *RATES)


# Streams over the event table, run over what is available.

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    # A glob, because a file source takes a directory or a pattern and the table may be either.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")
    return project_combat(raw)


@register("stream_pulls")
def _stream_pulls(spark, sf_dir):
    stream = live.live_pulls(event_stream(spark, sf_dir), sample_catalog(spark), O, F.col("log_id"), quiet_timers=False)
    return live.run_available(stream)


@register(
    "stream_windows",
    """SELECT log_id, CAST(ts_ms // 3600000 * 3600000 AS BIGINT) AS window_start_ms,
 CAST(sum(CASE WHEN type = 'damage' AND source_kind = 'player' AND target_kind = 'npc' THEN coalesce(effective, amount) ELSE 0 END) AS BIGINT) AS damage,
 CAST(sum(CASE WHEN type = 'heal' AND source_kind = 'player' THEN coalesce(effective, amount) ELSE 0 END) AS BIGINT) AS healing,
 CAST(sum(CASE WHEN type = 'damage' AND target_kind = 'player' THEN coalesce(effective, amount) ELSE 0 END) AS BIGINT) AS damage_taken, count(*) AS events
FROM ev WHERE type IN ('damage', 'heal') GROUP BY ALL""",
)
def _stream_windows(spark, sf_dir):
    stream = live.tumbling_metrics(live.timed(event_stream(spark, sf_dir)), "1 hour", "1 hour")
    return live.run_available(stream, "complete")


@register("stream_status", "SELECT log_id, count(*) AS events_received, max(ts_ms) AS last_seen_at FROM ev GROUP BY log_id")
def _stream_status(spark, sf_dir):
    return live.run_available(live.stream_status(event_stream(spark, sf_dir)), "complete")


@register("stream_dedup", "SELECT DISTINCT log_id AS session_id, line_number // 50 AS sequence FROM ev")
def _stream_dedup(spark, sf_dir):
    sent = live.timed(event_stream(spark, sf_dir)).select(
        F.col("log_id").alias("session_id"), F.floor(F.col("line_number") / 50).cast("bigint").alias("sequence"), F.col("event_time").alias("arrived_at")
    )
    return live.run_available(live.dedup_batches(sent, "30 days")).select("session_id", "sequence")


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the place at which they arrive: every seventh one is held up."""
    held_up = F.col("line_number") + F.when(F.col("line_number") % 7 == 0, 900).otherwise(0)
    return combat_events(spark, sf_dir).select(F.col("log_id").alias("session_id"), "line_number", held_up.alias("arrival"), "ts_ms")


def thirds(df: DataFrame, column: str) -> list[DataFrame]:
    """The rows in three parts, in order of ``column``."""
    low, high = df.select(F.percentile_approx(column, [0.33, 0.67]).alias("q")).first()["q"] or (0, 0)
    at = F.col(column)
    return [df.where(at <= low), df.where((at > low) & (at <= high)), df.where(at > high)]


@register(
    "stream_late",
    """SELECT CAST(log_id AS VARCHAR) AS session_id, line_number, arrival, ts_ms, peak - ts_ms AS behind_ms FROM (
 SELECT *, max(ts_ms) OVER (PARTITION BY log_id ORDER BY arrival, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM (
  SELECT log_id, line_number, ts_ms, line_number + CASE WHEN line_number % 7 = 0 THEN 900 ELSE 0 END AS arrival FROM ev)) WHERE ts_ms < peak - 1800000""",
)
def _stream_late(spark, sf_dir):
    told = publish.landed(thirds(staged(arriving(spark, sf_dir), packed=True), "arrival"), lambda s: arrivals.split_late(s, 1_800_000))
    return told.where("late").drop("late")


@register("stream_announcements", f"""SELECT * FROM (SELECT log_id, pull_id, guild_id, encounter_id, attempts, kills, round(best, 4) AS previous_best,
 CASE WHEN outcome = 'kill' THEN CASE WHEN kills = 1 THEN 'firstKill' ELSE 'kill' END
  WHEN remaining IS NOT NULL AND (best IS NULL OR remaining < best) AND remaining <= 15 THEN 'closeWipe' END AS kind FROM ({_MARKED})) WHERE kind IS NOT NULL""")
def _stream_announcements(spark, sf_dir):
    fights = staged(of_guilds(gap_fights(spark, sf_dir).fights).select("guild_id", "encounter_id", "boss_instance_id", *announcer.FIGHT))
    return rounded(publish.landed(thirds(fights, "started_at"), lambda s: announcer.live_announcements(s, O)), "previous_best")


# Encounter mechanics.

@on_gaps("encounter_runtime")
def _runtime(f):
    return f.mechanics.where("record NOT IN ('level', 'stage')")


@on_gaps("phase_segments")
def _phase_segments(f):
    return mechanics.phase_segments(f.mechanics, f.pulls)


@on_gaps(
    "definition_match",
    """SELECT log_id, pull_id, definition_id, matched_ids FROM (
 SELECT *, row_number() OVER (PARTITION BY log_id, pull_id ORDER BY matched_ids DESC, touched, definition_id) AS rn FROM (
  SELECT log_id, pull_id, CASE WHEN npc_id = '0' THEN 'd1' ELSE 'd2' END AS definition_id, count(DISTINCT npc_id) AS matched_ids, min(first_line) AS touched
  FROM engaged WHERE npc_id IN ('0', '1', '2') GROUP BY ALL)) WHERE rn = 1""",
)
def _definition_match(f):
    return encounters.match_definitions(f.engaged, f.catalog.encounter_defs)


@on_gaps(
    "challenge_totals",
    """SELECT log_id, pull_id, challenge_id, metric, CAST(value AS BIGINT) AS value, event_count, duration_ms,
 CASE WHEN duration_ms > 0 THEN round(value / (duration_ms / 1000), 4) END AS per_second FROM chal_totals""",
    tagged_once=True,
)
def _challenge_totals(f):
    kept = f.challenges.totals.withColumn("value", F.col("value").cast("bigint"))
    return rounded(kept.select(*PULL, "challenge_id", "metric", "value", "event_count", "duration_ms", "per_second"), "per_second")


@on_gaps(
    "challenge_players",
    """SELECT p.log_id, p.pull_id, p.challenge_id, player_id, player_name, CAST(p.value AS BIGINT) AS value,
 CASE WHEN t.value > 0 THEN round(p.value / t.value * 100, 4) ELSE 0 END AS percent,
 CASE WHEN duration_ms > 0 THEN round(p.value / (duration_ms / 1000), 4) END AS per_second
FROM chal_players p JOIN chal_totals t USING (log_id, pull_id, challenge_id)""",
    tagged_once=True,
)
def _challenge_players(f):
    return rounded(f.challenges.players.withColumn("value", F.col("value").cast("bigint")), "percent", "per_second")


@register("victory_hits", "SELECT log_id, line_number, list_sort(list(DISTINCT definition_id)) AS victory_of FROM triggered GROUP BY ALL")
def _victory_hits(spark, sf_dir):
    events = segment.session_context(combat_events(spark, sf_dir), O)
    return victories.victory_hits(events, sample_catalog(spark).encounter_defs)


@on_gaps("runtime_wins", "SELECT log_id, pull_id FROM def_won")
def _runtime_wins(f):
    return f.runtime_wins.select(*PULL)


# Metrics by the phases of definitions.

@on_gaps(
    "definition_phase_actors",
    """SELECT log_id, pull_id, segment_index, actor_id, CAST(sum(d) AS BIGINT) AS damage, CAST(sum(h) AS BIGINT) AS healing, CAST(sum(x) AS BIGINT) AS damage_taken,
 CAST(sum(n) AS BIGINT) AS actions, CAST(sum(k) AS BIGINT) AS interrupts, CAST(sum(f) AS BIGINT) AS deaths FROM (
 SELECT log_id, pull_id, segment_index, source_id AS actor_id, CASE WHEN type = 'damage' THEN ap ELSE 0 END AS d, CASE WHEN type = 'heal' THEN ap ELSE 0 END AS h, 0 AS x,
  CASE WHEN type = 'ability' AND phase = 'activate' THEN 1 ELSE 0 END AS n, CASE WHEN type = 'ability' AND phase = 'interrupt' THEN 1 ELSE 0 END AS k, 0 AS f
 FROM def_phased WHERE source_kind = 'player' AND ((type = 'damage' AND target_kind = 'npc') OR type = 'heal'
  OR (type = 'ability' AND ability_id IS NOT NULL AND (phase = 'activate' OR (phase = 'interrupt' AND ability_id IN (SELECT ability_id FROM kicks)))))
 UNION ALL SELECT log_id, pull_id, segment_index, target_id, 0, 0, CASE WHEN type = 'damage' THEN ap ELSE 0 END, 0, 0, CASE WHEN type = 'death' THEN 1 ELSE 0 END
 FROM def_phased WHERE target_kind = 'player' AND type IN ('damage', 'death')) GROUP BY ALL""",
)
def _definition_phase_actors(f):
    by_phase = [*PULL, "segment_index"]
    flagged = metrics.with_ability_flags(f.definition_phased, f.catalog.off_gcd, f.catalog.interrupts)
    found = metrics.totals(metrics.contributions(flagged, by_phase), by_phase, whole=True)
    return found.select(*by_phase, "actor_id", "damage", "healing", "damage_taken", "actions", "interrupts", "deaths")


@on_gaps(
    "definition_phase_enemies",
    """SELECT log_id, pull_id, segment_index, target_id AS instance_id, source_id AS player_id, CAST(sum(ap) AS BIGINT) AS damage, count(*) FILTER (amount > 0) AS damage_hits
FROM def_phased WHERE type = 'damage' AND source_kind = 'player' AND target_kind = 'npc' GROUP BY ALL""",
)
def _definition_phase_enemies(f):
    by_phase = [*PULL, "segment_index"]
    found = enemies.enemy_players(enemies.enemy_contributions(f.definition_phased, by_phase), by_phase, whole=True)
    return found.select(*by_phase, "instance_id", "player_id", "damage", "damage_hits")


@on_gaps(
    "definition_phase_abilities",
    """SELECT log_id, pull_id, segment_index, ability_id, source_id AS player_id, count(*) FILTER (type = 'ability') AS casts,
 CAST(sum(CASE WHEN type = 'damage' AND amount > 0 THEN ap ELSE 0 END) AS BIGINT) AS damage
FROM def_phased WHERE ((type = 'ability' AND phase = 'activate') OR type = 'damage') AND ability_id IS NOT NULL AND source_kind = 'player' GROUP BY ALL""",
)
def _definition_phase_abilities(f):
    by = [*PULL, "segment_index", "ability_id", "player_id"]
    found = abilities.usage(abilities.ability_rows(f.definition_phased, [*PULL, "segment_index"]), by, whole=True)
    return found.select(*by, "casts", "damage")


@on_gaps(
    "definition_phases",
    """SELECT log_id, pull_id, segment_index, CASE WHEN definition_id = 'd2' AND (from_line < 0 OR line_number >= from_line) THEN 'all' WHEN segment_index = 0 THEN 'open' ELSE 'burn' END AS phase_id, count(*) AS events
FROM def_phased GROUP BY ALL""",
)
def _definition_phases(f):
    named = mechanics.phase_entries(f.mechanics).select(*PULL, F.col("phase_order").alias("segment_index"), "phase_id")
    return f.definition_phased.groupBy(*PULL, "segment_index").agg(F.count("*").alias("events")).join(named, [*PULL, "segment_index"])
