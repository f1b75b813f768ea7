"""Projection of a generic event table onto the flat combat schema.

The star-schema test data holds no combat logs, so its ``events`` table is read
as one: users are players (fifteen of them share a log), the property ``k``
picks the NPC, ability and effect, and the value is the amount in cents.  The
same text runs in Spark and in any ANSI engine; only the two expressions in
``SPARK_DIALECT`` differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraylens.options import Options

SPARK_DIALECT = {
    "ts": "unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000",
    "k": "get_json_object(props, '$.k')",
}

#: Thresholds that suit the event density of the test table.
SCALED_OPTIONS = Options(
    idle_ms=7_200_000,
    exit_grace_ms=2_400_000,
    boss_cleanup_ms=3_600_000,
    min_duration_ms=3_600_000,
    reopen_guard_ms=600_000,
    bucket_ms=3_600_000,
    audit_window_ms=21_600_000,
    storage_bucket_ms=3_600_000,
    storage_part_events=4,
    retention_days=7,
)


def _side(side: str) -> str:
    return f"""
 CASE {side}_kind WHEN 'player' THEN pid WHEN 'npc' THEN inst END AS {side}_id,
 CASE {side}_kind WHEN 'player' THEN concat('Player ', pid)
   WHEN 'npc' THEN CASE nid WHEN '9' THEN 'Vault Core' WHEN '10' THEN 'Drone Swarm' ELSE concat('Npc ', nid) END
 END AS {side}_name,
 CASE WHEN {side}_kind = 'npc' THEN nid END AS {side}_npc_id,
 CASE {side}_kind WHEN 'player' THEN CASE WHEN k % 9 <> 0 THEN CAST((100 - k) * 20 AS BIGINT) END
   WHEN 'npc' THEN CAST((k % 12 + 1) * 10000 * (100 - k) AS BIGINT) END AS {side}_hp,
 CASE {side}_kind WHEN 'player' THEN CAST(100000 + (user_id % 15) * 10000 AS BIGINT)
   WHEN 'npc' THEN CAST((k % 12 + 1) * 1000000 AS BIGINT) END AS {side}_max_hp,"""


def combat_sql(dialect: dict[str, str], source: str = "events") -> str:
    """SELECT that reads ``source`` as a flat combat-event table."""
    return f"""
SELECT log_id, line_number, ts_ms, type, phase, state,
 source_kind,{_side("source")}
 target_kind,{_side("target")}
 CASE WHEN type IN ('damage', 'heal', 'ability') THEN aid END AS ability_id,
 CASE WHEN type IN ('damage', 'heal', 'ability') THEN
   CASE WHEN aid IN ('2', '7', '12', '17') THEN 'Core Terminal' ELSE concat('Ability ', aid) END END AS ability_name,
 CASE WHEN type IN ('applyEffect', 'removeEffect', 'modifyCharges') THEN fid END AS effect_id,
 CASE WHEN type IN ('applyEffect', 'removeEffect', 'modifyCharges') THEN
   CASE fid WHEN '3' THEN ' Iron SKIN ' ELSE concat('Effect ', fid) END END AS effect_name,
 CAST(NULL AS VARCHAR(20)) AS category_name,
 CASE WHEN type IN ('damage', 'heal') THEN CASE WHEN k % 13 = 0 THEN 0 ELSE cents END END AS amount,
 CASE WHEN type IN ('damage', 'heal') THEN
   CASE WHEN k % 13 = 0 THEN 0 WHEN k % 7 = 0 THEN NULL ELSE cents - cents % (k + 1) END END AS effective,
 type IN ('damage', 'heal') AND k % 5 = 0 AS critical,
 CASE WHEN type = 'damage' THEN
   CASE k % 4 WHEN 0 THEN 'kinetic' WHEN 1 THEN 'energy' WHEN 2 THEN 'internal' ELSE 'elemental' END
 END AS damage_type,
 CASE WHEN type = 'damage' THEN CASE WHEN k % 13 = 0 THEN 'dodge' WHEN k % 11 = 0 THEN 'shield' END END AS mitigation,
 CASE WHEN type = 'damage' AND k % 11 = 0 THEN CAST(floor(cents / 4.0) AS BIGINT) END AS absorbed,
 CASE WHEN type = 'modifyCharges' OR (type = 'applyEffect' AND k % 3 = 0) THEN CAST(k % 8 AS BIGINT) END AS charges,
 CASE WHEN type = 'damage' THEN CAST(k - 50 AS BIGINT) END AS threat,
 CASE WHEN type = 'areaEntered' THEN concat('z', CAST(k % 3 AS VARCHAR(20))) END AS zone_id,
 CASE WHEN type = 'areaEntered' THEN concat('Zone ', CAST(k % 3 AS VARCHAR(20))) END AS zone_name,
 CASE WHEN type = 'areaEntered' AND k % 3 <> 0 THEN concat('he', CAST(k % 2 AS VARCHAR(20))) END AS server_id,
 CASE WHEN type = 'areaEntered' THEN CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 END END AS group_size,
 CASE WHEN type = 'areaEntered' THEN
   CASE k % 4 WHEN 0 THEN 'Story' WHEN 1 THEN 'Veteran' WHEN 2 THEN 'Master' END END AS difficulty,
 CASE WHEN type = 'disciplineChanged' AND k <> 9 THEN 'Vanguard' END AS advanced_class,
 CASE WHEN type = 'disciplineChanged' THEN
   CASE k WHEN 6 THEN 'Defense' WHEN 7 THEN 'Seer' WHEN 8 THEN 'Tactics' ELSE 'Corruption' END END AS discipline,
 CASE WHEN type = 'disciplineChanged' THEN
   CASE k WHEN 6 THEN 'tank' WHEN 7 THEN 'healer' WHEN 8 THEN 'dps' ELSE 'healer' END END AS role
FROM (
 SELECT *,
  CASE WHEN type = 'ability' THEN CASE WHEN k % 10 = 0 THEN 'interrupt' ELSE 'activate' END END AS phase,
  CASE WHEN type = 'combatState' THEN CASE WHEN k % 2 = 0 THEN 'enter' ELSE 'exit' END
   WHEN type = 'target' THEN CASE WHEN k % 4 < 3 THEN 'set' ELSE 'cleared' END END AS state,
  CASE WHEN type = 'damage' AND k % 4 = 3 THEN 'npc' WHEN type = 'death' THEN NULL ELSE 'player' END AS source_kind,
  CASE WHEN type = 'damage' THEN CASE WHEN k % 4 <> 3 THEN 'npc' ELSE 'player' END
   WHEN type = 'death' THEN CASE WHEN k % 3 <> 0 THEN 'npc' ELSE 'player' END
   WHEN type = 'target' THEN CASE WHEN k % 4 < 3 THEN 'npc' END
   WHEN type = 'ability' THEN CASE WHEN k % 10 BETWEEN 2 AND 4 THEN 'player' ELSE 'npc' END
   WHEN type IN ('areaEntered', 'disciplineChanged', 'combatState') THEN NULL
   ELSE 'player' END AS target_kind
 FROM (
  SELECT *,
   CASE event_type WHEN 'purchase' THEN 'damage' WHEN 'view' THEN 'heal'
    WHEN 'click' THEN CASE WHEN k % 10 = 1 THEN 'target' ELSE 'ability' END
    WHEN 'signup' THEN CASE WHEN k % 10 = 9 THEN 'modifyCharges' WHEN k % 2 = 0 THEN 'applyEffect' ELSE 'removeEffect' END
    ELSE CASE WHEN k < 6 THEN 'areaEntered' WHEN k < 10 THEN 'disciplineChanged'
     WHEN k < 40 THEN 'combatState' ELSE 'death' END END AS type
  FROM (
   SELECT CAST(floor(user_id / 15.0) AS BIGINT) AS log_id, event_id + 1 AS line_number, {dialect["ts"]} AS ts_ms,
    user_id, event_type, k, CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(user_id AS VARCHAR(20)) AS pid, CAST(k % 12 AS VARCHAR(20)) AS nid,
    CAST((k % 12) * 10 + CAST(floor(event_id / 500.0) AS BIGINT) % 2 AS VARCHAR(20)) AS inst,
    CAST(k % 20 AS VARCHAR(20)) AS aid, CAST(k % 6 AS VARCHAR(20)) AS fid
   FROM (SELECT *, CAST({dialect["k"]} AS INT) AS k FROM {source}) e0
  ) e1
 ) e2
) e3"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_combat(events: DataFrame) -> DataFrame:
    """Generic events as flat combat events (positions are absent from the table)."""
    spark = events.sparkSession
    flat = spark.sql(combat_sql(SPARK_DIALECT, "{src}"), src=events)
    empty = "CAST(NULL AS struct<x:double,y:double,z:double,facing:double>)"
    return flat.selectExpr("*", "false AS reflected", f"{empty} AS source_pos", f"{empty} AS target_pos")


def combat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_combat(read_table(spark, sf_dir, "events"))
