"""Naming the encounter of a pull, its boss, and how the attempt ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import combat, fixed
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.options import Options


def npc_names(npcs: DataFrame, npc_catalog: DataFrame, id_column: str = "npc_id", name_column: str = "name") -> DataFrame:
    """Canonical NPC name by id, else the logged one, with where it came from."""
    known = npc_catalog.select(F.col("npc_id").alias(id_column), F.col("name").alias("__catalog"))
    joined = npcs.join(known, id_column, "left")
    return joined.withColumns(
        {
            "canonical_name": F.coalesce("__catalog", name_column),
            "name_source": F.when(F.col("__catalog").isNotNull(), "catalog").otherwise("log"),
        }
    ).drop("__catalog")


def pull_facts(tagged: DataFrame) -> DataFrame:
    """Who was engaged, died, took part or showed health in each pull, from one pass over the events.

    One row per pull, fact, entity and logged name; as many rows as a pull has
    distinct entities, whatever its number of events.
    """
    killed = (F.col("type") == "death") & F.col("target_kind").isNotNull()
    cast = (F.col("type") == "ability") & (F.col("phase") == "activate") & F.col("ability_id").isNotNull()
    took_part = combat.player("source") & (combat.raid_damage() | (F.col("type") == "heal") | cast)

    def fact(condition: Column, kind: str, side: str, damage: Column | None = None) -> Column:
        entity = F.when(F.col(f"{side}_kind") == "npc", F.col(f"{side}_npc_id")).otherwise(F.col(f"{side}_id"))
        return F.when(
            condition,
            F.struct(
                F.lit(kind).alias("fact"), F.col(f"{side}_kind").alias("kind"), entity.alias("id"),
                F.col(f"{side}_name").alias("name"), F.col(f"{side}_hp").alias("hp"), F.col(f"{side}_max_hp").alias("max_hp"),
                F.lit(0 if side == "source" else 1).alias("slot"),
                (F.lit(0) if damage is None else damage).cast("double").alias("damage"),
            ),
        )

    dealt = F.when(combat.raid_damage(), combat.applied()).otherwise(F.lit(0))
    facts = F.explode(
        F.array(
            fact(combat.raid_damage(), "engaged", "target"),
            fact(killed, "dead", "target"),
            fact(took_part, "part", "source", dealt),
            fact(F.col("source_max_hp") > 0, "health", "source"),
            fact(F.col("target_max_hp") > 0, "health", "target"),
        )
    )
    rows = tagged.select(*PULL, "line_number", "ts_ms", facts.alias("f")).filter(F.col("f").isNotNull())
    flat = rows.select(*PULL, "line_number", "ts_ms", "f.*")
    order = F.struct("line_number", "slot")
    return flat.groupBy(*PULL, "fact", "kind", "id", "name").agg(
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.count(F.lit(1)).alias("times"),
        F.max("max_hp").alias("max_hp"), F.max_by(F.struct("hp"), order).alias("last"), F.max(order).alias("last_order"),
        F.max(F.struct("max_hp", -F.col("line_number"), -F.col("slot"))).alias("peak_order"), F.sum("damage").alias("damage"),
    )


def engaged_npcs(facts: DataFrame, npc_catalog: DataFrame) -> DataFrame:
    """NPC classes the raid damaged in each pull, with the line that first did so."""
    hits = facts.filter(F.col("fact") == "engaged").select(
        *PULL, F.col("id").alias("npc_id"), F.col("name").alias("raw_name"), "first_line"
    )
    named = npc_names(hits, npc_catalog, name_column="raw_name")
    return named.withColumn("name", combat.normalise(F.col("canonical_name"))).drop("name_source")


def dead_npcs(facts: DataFrame, npc_catalog: DataFrame) -> DataFrame:
    """NPC classes that died in each pull."""
    deaths = facts.filter((F.col("fact") == "dead") & (F.col("kind") == "npc")).select(
        *PULL, F.col("id").alias("npc_id"), F.col("name").alias("raw_name"), "first_line", "last_line"
    )
    return npc_names(deaths, npc_catalog, name_column="raw_name").drop("name_source")


def participants(facts: DataFrame) -> DataFrame:
    """Players who damaged an NPC, healed, or activated an ability."""
    return facts.filter(F.col("fact") == "part").select(*PULL, F.col("id").alias("player_id")).distinct()


def dead_players(facts: DataFrame) -> DataFrame:
    """Players who died in each pull and how often."""
    died = facts.filter((F.col("fact") == "dead") & (F.col("kind") == "player"))
    return died.groupBy(*PULL, F.col("id").alias("player_id")).agg(F.sum("times").alias("deaths"))


def encounter_names(encounters: DataFrame) -> DataFrame:
    return encounters.select(
        F.col("id").alias("encounter_id"), "catalog_order", "operation_id", F.explode("boss_names").alias("name")
    )


def encounter_ids(encounters: DataFrame, observed: DataFrame) -> DataFrame:
    """NPC ids that confirm an encounter: curated boss ids and observed ids."""
    curated = encounters.select(F.col("id").alias("encounter_id"), F.explode("boss_npc_ids").alias("npc_id"))
    return curated.unionByName(observed.select("encounter_id", "npc_id")).distinct()


def match_encounters(engaged: DataFrame, pulls: DataFrame, catalog, steps: bool = False) -> DataFrame:
    """Best encounter of each pull: two points per boss name present, 6 or 4 for the zone, 8 for an id.

    With ``steps`` the match is given for every line at which a new NPC was
    engaged, as it stood at that line; otherwise once per pull.  Work per pull is
    bounded by the catalogue, since only catalogued names and ids take part.
    """
    names = encounter_names(catalog.encounters).select("encounter_id", "name")
    ids = encounter_ids(catalog.encounters, catalog.observed)
    by_name = engaged.join(names, "name").select(
        *PULL, "encounter_id", F.concat(F.lit("n:"), "name").alias("evidence"), F.lit(2).alias("points"), "first_line"
    )
    by_id = engaged.join(ids, "npc_id").select(
        *PULL, "encounter_id", F.lit("id").alias("evidence"), F.lit(8).alias("points"), "first_line"
    )
    facts = (
        by_name.unionByName(by_id)
        .groupBy(*PULL, "encounter_id", "evidence")
        .agg(F.max("points").alias("points"), F.min("first_line").alias("first_line"))
    )
    order = catalog.encounters.select(F.col("id").alias("encounter_id"), "catalog_order", "operation_id")
    ops = catalog.operations.select(F.col("id").alias("operation_id"), "zone_ids", "zone_names")
    zones = pulls.select(*PULL, "ctx_zone_id", "ctx_zone_name")
    keys = [*PULL]
    if steps:
        marks = facts.select(*PULL, F.col("first_line").alias("at_line")).distinct()
        facts = facts.join(marks, PULL).filter(F.col("first_line") <= F.col("at_line"))
        keys = [*PULL, "at_line"]
    scored = facts.groupBy(*keys, "encounter_id").agg(
        F.sum("points").alias("points"), F.sum(F.when(F.col("evidence") != "id", 1).otherwise(0)).alias("matched_bosses")
    )
    zone_points = (
        F.when(F.array_contains("zone_ids", F.col("ctx_zone_id")), 6)
        .when(F.array_contains("zone_names", combat.normalise(F.col("ctx_zone_name"))), 4)
        .otherwise(0)
    )
    full = (
        scored.join(order, "encounter_id").join(ops, "operation_id", "left").join(zones, PULL)
        .withColumn("score", F.col("points") + zone_points)
    )
    picked = F.max_by(
        F.struct("encounter_id", "matched_bosses", "score"), F.struct("score", -F.col("catalog_order"))
    )
    best = full.groupBy(*keys).agg(picked.alias("b"))
    return best.select(
        *keys, "b.encounter_id", F.col("b.matched_bosses").cast("bigint").alias("matched_bosses"),
        F.col("b.score").cast("bigint").alias("score"),
    )


def match_definitions(engaged: DataFrame, encounter_defs: DataFrame, steps: bool = False) -> DataFrame:
    """Executable definition with most engaged boss ids; a tie goes to the first one touched, then to the smaller id."""
    bosses = encounter_defs.select(F.col("id").alias("definition_id"), F.explode("boss_npc_ids").alias("npc_id")).distinct()
    per_npc = engaged.groupBy(*PULL, "npc_id").agg(F.min("first_line").alias("first_line"))
    facts = per_npc.join(bosses, "npc_id").select(*PULL, "definition_id", "npc_id", "first_line")
    keys = [*PULL]
    if steps:
        marks = facts.select(*PULL, F.col("first_line").alias("at_line")).distinct()
        facts = facts.join(marks, PULL).filter(F.col("first_line") <= F.col("at_line"))
        keys = [*PULL, "at_line"]
    counts = facts.groupBy(*keys, "definition_id").agg(
        F.count(F.lit(1)).alias("matched"), F.min("first_line").alias("touched")
    )
    return counts.groupBy(*keys).agg(
        F.min_by(F.struct("definition_id", "matched"), F.struct(-F.col("matched"), "touched", "definition_id")).alias("b")
    ).select(*keys, "b.definition_id", F.col("b.matched").alias("matched_ids"))


def entity_roles(enemies: DataFrame, matches: DataFrame, catalog) -> DataFrame:
    """Role of each enemy inside the matched encounter: boss, mechanic or unknown.

    Ids decide first (boss ids, add ids, the NPC catalogue), then names: a boss
    name of the match present in the pull, an add name equal to or part of the name.
    """
    enc = catalog.encounters.select(
        F.col("id").alias("encounter_id"), "boss_names", "adds", "boss_npc_ids", "add_npc_ids"
    )
    roles = catalog.npc_catalog.select("npc_id", F.col("role").alias("__catalog_role"))
    joined = enemies.join(matches.select(*PULL, "encounter_id"), PULL).join(enc, "encounter_id").join(roles, "npc_id", "left")
    name = combat.normalise(F.col("name"))
    is_add = F.exists("adds", lambda a: F.contains(name, combat.normalise(a)))
    role = (
        F.when(F.array_contains("boss_npc_ids", F.col("npc_id")), "boss")
        .when(F.array_contains("add_npc_ids", F.col("npc_id")), "mechanic")
        .when(F.col("__catalog_role").isNotNull(), F.col("__catalog_role"))
        .when(F.exists("boss_names", lambda b: combat.normalise(b) == name), "boss")
        .when(is_add, "mechanic")
        .otherwise("unknown")
    )
    return joined.select(*enemies.columns, "encounter_id", role.alias("role"))


def catalog_roles(enemies: DataFrame, catalog) -> DataFrame:
    """Role of each enemy against the whole catalogue; on a name, mechanic beats boss."""
    roles = catalog.npc_catalog.select("npc_id", F.col("role").alias("__catalog_role"))
    boss_ids = catalog.encounters.select(F.explode("boss_npc_ids").alias("npc_id")).distinct().withColumn("__boss_id", F.lit(True))
    add_ids = catalog.encounters.select(F.explode("add_npc_ids").alias("npc_id")).distinct().withColumn("__add_id", F.lit(True))
    boss_names = (
        catalog.encounters.select(F.explode("boss_names").alias("__n")).select(combat.normalise(F.col("__n")).alias("__name"))
        .distinct().withColumn("__boss_name", F.lit(True))
    )
    adds = catalog.encounters.select(F.explode("adds").alias("__a")).select(combat.normalise(F.col("__a")).alias("__add")).distinct()
    names = enemies.select(combat.normalise(F.col("name")).alias("__name")).distinct()
    # A name that holds an add's name holds its first three characters: an equality on those, then the full test.
    name = F.col("__name")
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.array(*[name.substr(i, F.lit(n)) for n in (1, 2, 3)])))
    openings = names.select("__name", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), starts))).alias("__key"))
    add_names = (
        openings.join(adds.withColumn("__key", F.substring("__add", 1, 3)), "__key").filter(F.contains(name, F.col("__add")))
        .select("__name").distinct().withColumn("__add_name", F.lit(True))
    )
    joined = (
        enemies.withColumn("__name", combat.normalise(F.col("name")))
        .join(roles, "npc_id", "left").join(boss_ids, "npc_id", "left").join(add_ids, "npc_id", "left")
        .join(boss_names, "__name", "left").join(add_names, "__name", "left")
    )
    role = (
        F.when(F.col("__catalog_role").isNotNull(), F.col("__catalog_role"))
        .when(F.col("__boss_id"), "boss").when(F.col("__add_id"), "mechanic")
        .when(F.col("__add_name"), "mechanic").when(F.col("__boss_name"), "boss")
        .otherwise("unknown")
    )
    return joined.select(*enemies.columns, role.alias("role"))


def boss_of_pull(facts: DataFrame, engaged: DataFrame, matches: DataFrame, options: Options) -> DataFrame:
    """Largest engaged NPC by max health; the first one engaged wins a tie.

    It counts as a likely boss when the pull matched an encounter, or when its
    health is a multiple of the healthiest player's (an absolute floor when no
    player health was seen).
    """

    health = facts.filter(F.col("fact") == "health").groupBy(
        *PULL, F.when(F.col("kind") == "npc", F.col("id")).alias("npc_id")
    ).agg(
        F.max("max_hp").alias("max_hp"),
        F.max_by("last", "last_order").alias("last"),
        F.max_by("name", "peak_order").alias("seen_name"),
    )
    peak = health.filter(F.col("npc_id").isNull()).select(*PULL, F.col("max_hp").alias("peak_player_hp"))
    first = engaged.groupBy(*PULL, "npc_id").agg(
        F.min("first_line").alias("first_line"), F.min_by("canonical_name", "first_line").alias("canonical_name"),
        F.bool_or(F.col("canonical_name") != F.col("raw_name")).alias("renamed"),
    )
    candidates = first.join(health.filter(F.col("npc_id").isNotNull()), [*PULL, "npc_id"])
    best = candidates.groupBy(*PULL).agg(
        F.max_by(
            F.struct(
                "npc_id", "max_hp", F.col("last.hp").alias("hp"),
                F.when(F.col("renamed"), F.col("canonical_name")).otherwise(F.col("seen_name")).alias("name"),
            ),
            F.struct("max_hp", -F.col("first_line")),
        ).alias("b")
    )
    floor = F.coalesce(F.col("peak_player_hp") * options.boss_health_multiple, F.lit(options.boss_absolute_floor))
    known = matches.select(*PULL, F.lit(True).alias("__known"))
    joined = best.join(peak, PULL, "left").join(known, PULL, "left")
    return joined.select(
        *PULL, F.col("b.npc_id").alias("boss_npc_id"), F.col("b.name").alias("boss_name"),
        F.col("b.max_hp").alias("boss_max_hp"), F.col("b.hp").alias("boss_hp"),
        combat.hp_percent(F.col("b.hp"), F.col("b.max_hp")).alias("boss_hp_percent"),
        (F.col("__known").isNotNull() | (F.col("b.max_hp") >= floor)).alias("is_likely_boss"),
    )


def encounter_cleared(matches: DataFrame, dead: DataFrame, evidence: DataFrame, catalog) -> DataFrame:
    """Whether the matched encounter was beaten in each pull.

    All required names dead, or any boss name when none is required; a lone
    required boss also counts by id; explicit victory evidence always counts.
    """
    enc = catalog.encounters.select(
        F.col("id").alias("encounter_id"), "victory_requires", "boss_npc_ids",
        F.when(F.size("victory_requires") > 0, F.col("victory_requires")).otherwise(F.col("boss_names")).alias("wanted"),
    )
    names = F.explode(F.array(combat.normalise(F.col("raw_name")), combat.normalise(F.col("canonical_name"))))
    sets = dead.select(*PULL, "npc_id", names.alias("name")).groupBy(*PULL).agg(
        F.collect_set("name").alias("dead_names"), F.collect_set("npc_id").alias("dead_ids")
    )
    found = evidence.select(*PULL, F.lit(True).alias("__evidence"))
    joined = matches.join(enc, "encounter_id").join(sets, PULL, "left").join(found, PULL, "left")
    empty = F.array().cast("array<string>")
    dead_names, dead_ids = F.coalesce("dead_names", empty), F.coalesce("dead_ids", empty)
    down = F.size(F.array_intersect("wanted", dead_names))
    size = F.size(F.array_distinct("wanted"))
    by_id = (F.size("wanted") == 1) & F.arrays_overlap("boss_npc_ids", dead_ids) & (down == 0)
    by_name = F.when(F.size("victory_requires") > 0, down == size).otherwise(down > 0)
    cleared = F.col("__evidence").isNotNull() | F.coalesce(by_id, F.lit(False)) | by_name
    return joined.select(*PULL, "encounter_id", cleared.alias("cleared"))


def victory_evidence(tagged: DataFrame, steps: DataFrame, encounters: DataFrame, options: Options) -> DataFrame:
    """First event whose text proves a victory that is not a kill.

    ``steps`` is the running match (``match_encounters(..., steps=True)``); an
    event is judged by the encounter known before it.
    """
    text = F.lower(F.concat_ws(" ", *combat.spoken()))
    names = F.concat_ws(" / ", *combat.spoken())
    any_marker = "|".join(fixed.VICTORY_MARKERS)
    said = tagged.filter(text.rlike(any_marker)).select(
        *PULL, "line_number", "ts_ms", text.alias("text"), names.alias("said"),
        combat.player_id("source").alias("actor_id"), "target_npc_id", F.lit(None).cast("string").alias("encounter_id"),
    )
    known = steps.select(
        *PULL, F.col("at_line").alias("line_number"), F.lit(None).cast("bigint").alias("ts_ms"),
        *[F.lit(None).cast("string").alias(c) for c in ("text", "said", "actor_id", "target_npc_id")], "encounter_id",
    )
    scanned = scan.running(
        said.unionByName(known), PULL, ["line_number"], scan.line_block(options.block_lines),
        {"bound": scan.last(F.col("encounter_id"), inclusive=False)},
    ).filter(F.col("text").isNotNull() & F.col("bound").isNotNull())
    victory = encounters.select(F.col("id").alias("bound"), F.lower("victory_event").alias("victory"))
    textual = victory.filter(~F.col("victory").rlike(fixed.BOSS_DEFEAT_TEXT))
    agrees = F.exists(
        F.array(*[F.lit(m) for m in fixed.VICTORY_MARKERS]),
        lambda m: F.contains(F.col("victory"), m) & F.contains(F.col("text"), m),
    )
    first = scanned.join(textual, "bound").filter(agrees).groupBy(*PULL).agg(
        F.min_by(F.struct("ts_ms", "said", "actor_id", "target_npc_id", "line_number"), "line_number").alias("e")
    )
    return first.select(*PULL, "e.*")


def single_instance_resets(seen: DataFrame, matches: DataFrame, catalog, options: Options) -> DataFrame:
    """Pulls in which a new instance of a single-instance boss appeared while another was alive."""
    order = F.struct("line_number", "slot")
    instances = seen.groupBy(*PULL, "npc_id", "instance_id").agg(
        F.min("line_number").alias("first_line"), F.min_by("ts_ms", order).alias("first_ts"),
        F.min_by("raw_name", order).alias("raw_name"),
        F.min(F.when(F.col("died"), F.col("line_number"))).alias("death_line"),
    )
    named = npc_names(instances, catalog.npc_catalog, name_column="raw_name")
    enc = catalog.encounters.select(F.col("id").alias("encounter_id"), F.explode("single_instance_boss_names").alias("__single"))
    watched = (
        named.join(matches.select(*PULL, "encounter_id"), PULL).join(enc, "encounter_id")
        .filter(F.lower("canonical_name") == F.lower("__single"))
        .select(*PULL, "npc_id", "instance_id", "first_line", "first_ts", "death_line").distinct()
    )
    # Births add one living instance, deaths take one away; a birth onto a living one is a reset.
    changes = watched.select(
        *PULL, "npc_id", "first_ts",
        F.explode(
            F.array(
                F.struct(F.col("first_line").alias("line_number"), F.lit(0).alias("step"), F.lit(1).alias("alive")),
                F.struct(F.col("death_line").alias("line_number"), F.lit(1).alias("step"), F.lit(-1).alias("alive")),
            )
        ).alias("c"),
    ).filter(F.col("c.line_number").isNotNull()).select(*PULL, "npc_id", "first_ts", "c.*")
    alive = scan.running(
        changes, [*PULL, "npc_id"], ["line_number", "step"], scan.line_block(options.block_lines),
        {"before": scan.total(F.col("alive"), inclusive=False)},
    )
    resets = alive.filter((F.col("alive") == 1) & (F.col("before") > 0))
    return resets.groupBy(*PULL).agg(F.min_by("first_ts", "line_number").alias("reset_at"))


def pull_outcomes(
    pulls: DataFrame, matches: DataFrame, cleared: DataFrame, boss: DataFrame, dead: DataFrame,
    player_deaths: DataFrame, took_part: DataFrame, resets: DataFrame | None = None,
) -> DataFrame:
    """Kill, wipe, reset or incomplete for every pull.

    ``player_deaths`` and ``took_part`` are (log, pull, player); ``resets`` only
    takes part under the strict reset rule.
    """
    died = player_deaths.select(*PULL, "player_id").distinct()
    others = took_part.join(pulls.select(*PULL, "local_player_id"), PULL).filter(
        F.col("local_player_id").isNull() | (F.col("player_id") != F.col("local_player_id"))
    )
    wiped = (
        others.join(died.withColumn("__died", F.lit(1)), [*PULL, "player_id"], "left")
        .groupBy(*PULL).agg((F.count(F.lit(1)) == F.count("__died")).alias("raid_wiped"))
    )
    any_death = died.groupBy(*PULL).agg(F.count(F.lit(1)).alias("players_dead"))
    dead_count = dead.groupBy(*PULL).agg(F.countDistinct("npc_id").alias("npcs_dead"))
    boss_dead = boss.join(
        dead.select(*PULL, F.col("npc_id").alias("boss_npc_id")).distinct(), [*PULL, "boss_npc_id"], "left_semi"
    ).select(*PULL, F.lit(True).alias("boss_dead"))
    joined = pulls
    for part in (matches.select(*PULL, "encounter_id"), cleared.select(*PULL, "cleared"), boss, wiped, any_death, dead_count, boss_dead):
        joined = joined.join(part, PULL, "left")
    if resets is not None:
        joined = joined.join(resets, PULL, "left")
    known = F.col("encounter_id").isNotNull()
    is_reset = F.col("reset_at").isNotNull() if resets is not None else F.lit(False)
    outcome = (
        F.when(known & F.col("cleared"), "kill")
        .when(~known & F.coalesce("boss_dead", F.lit(False)), "kill")
        .when(is_reset, "reset")
        .when(F.coalesce("raid_wiped", F.lit(False)), "wipe")
        .when(
            known | F.coalesce("is_likely_boss", F.lit(False)),
            F.when(F.col("end_reason") == "sustained-silence", "wipe").otherwise("incomplete"),
        )
        .when(F.coalesce("npcs_dead", F.lit(0)) > 0, "kill")
        .when(F.coalesce("players_dead", F.lit(0)) > 0, "wipe")
        .otherwise("incomplete")
    )
    return joined.withColumn("outcome", outcome).withColumn("cleared", F.coalesce("cleared", F.lit(False))).drop(
        "raid_wiped", "boss_dead"
    )


def terminal_evidence(outcomes: DataFrame, evidence: DataFrame, runtime_victory: DataFrame | None = None) -> DataFrame:
    """Why a boss attempt is said to have ended the way it did."""
    seen = evidence.select(*PULL, F.struct("ts_ms", "said").alias("__text"))
    joined = outcomes.filter(F.col("encounter_id").isNotNull()).join(seen, PULL, "left")
    triggered = F.lit(None).cast("struct<ts_ms:bigint,detail:string>")
    if runtime_victory is not None:
        joined = joined.join(runtime_victory.select(*PULL, F.struct("ts_ms", "detail").alias("__trigger")), PULL, "left")
        triggered = F.col("__trigger")
    said, deaths = F.col("__text"), F.coalesce("players_dead", F.lit(0)) > 0
    kill, reset, wipe = (F.col("outcome") == o for o in ("kill", "reset", "wipe"))
    kind = (
        F.when(kill & (said.isNotNull() | triggered.isNotNull()), "victory-event")
        .when(kill, F.when(F.col("cleared"), "required-targets-dead").otherwise("boss-death"))
        .when(reset, "encounter-reset")
        .when(wipe, F.when(deaths, "raid-wipe").otherwise("encounter-reset"))
        .otherwise(F.col("end_reason"))
    )
    # Wording of the evidence.
    detail = (
        F.when(kill & said.isNotNull(), F.concat(F.lit("Encounter victory evidence observed: "), said["said"], F.lit(".")))
        .when(kill & triggered.isNotNull(), triggered["detail"])
        .when(kill & F.col("cleared"), "All required encounter targets were defeated.")
        .when(kill, "A boss entity was defeated.")
        .when(reset, "A single-instance boss reset was detected; the attempt restarted rather than concluding in a kill or wipe.")
        .when(wipe & deaths, "Player deaths ended the boss attempt.")
        .when(wipe, "The boss attempt ended without a victory.")
        .when(F.col("end_reason") == "sustained-silence", "The boss attempt ended after sustained hostile silence without a victory event.")
        .otherwise("The combat stream ended before a terminal encounter result was observed.")
    )
    at = F.when(kill, F.coalesce(said["ts_ms"], triggered["ts_ms"], F.col("ended_at"))).otherwise(F.col("ended_at"))
    return joined.select(*PULL, "encounter_id", "outcome", kind.alias("evidence_kind"), at.alias("evidence_at"), detail.alias("evidence_detail"))


def all_engaged_dead(engaged: DataFrame, dead: DataFrame) -> DataFrame:
    """Pulls in which every engaged NPC class also died."""
    gone = dead.select(*PULL, "npc_id").distinct().withColumn("__dead", F.lit(1))
    classes = engaged.select(*PULL, "npc_id").distinct().join(gone, [*PULL, "npc_id"], "left")
    return classes.groupBy(*PULL).agg(
        F.count(F.lit(1)).alias("engaged"), F.count("__dead").alias("dead"),
        (F.count(F.lit(1)) == F.count("__dead")).alias("all_dead"),
    )


def first_boss_entity(enemies_with_role: DataFrame) -> DataFrame:
    """The boss entity a pull met first; progression measures wipes by it."""
    bosses = enemies_with_role.filter(F.col("role") == "boss")
    picked = F.min_by(F.struct("instance_id", "max_hp", "final_hp"), F.struct("first_line", "first_slot"))
    rows = bosses.groupBy(*PULL).agg(picked.alias("b"))
    return rows.select(
        *PULL, F.col("b.instance_id").alias("boss_instance_id"),
        F.col("b.max_hp").alias("boss_entity_max_hp"), F.col("b.final_hp").alias("boss_entity_final_hp"),
        combat.hp_percent(F.col("b.final_hp"), F.col("b.max_hp")).alias("boss_remaining_percent"),
    )
