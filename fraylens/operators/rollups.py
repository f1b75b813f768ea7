"""Roll-ups of fights: timelines, progression, reports, meters and announcements.

A fight is one pull with its match, outcome and headline numbers.  Ordered
roll-ups scan by start time in blocks of an hour, so an encounter or report
that holds most fights still spreads over its hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraylens.functions import text
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.options import Options

HOUR_MS = 3_600_000


def hour_block(column: str = "started_at") -> Column:
    return F.floor(F.col(column) / HOUR_MS).cast("bigint")


def combat_timeline(pulls: DataFrame, enemies: DataFrame, damaged: DataFrame) -> DataFrame:
    """Boss fights, and one row per damaged enemy for every other pull.

    ``damaged`` lists the (pull, instance) pairs some player hit.  Callers order
    by start then end.
    """
    boss = pulls.filter(F.col("encounter_id").isNotNull()).select(
        "log_id", F.lit("boss").alias("kind"), F.col("pull_id").alias("fight_id"), F.col("encounter_id").alias("subject"),
        "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration_ms"), "outcome",
    )
    return boss.unionByName(trash_encounters(pulls, enemies, damaged))


def trash_encounters(pulls: DataFrame, enemies: DataFrame, damaged: DataFrame) -> DataFrame:
    """Each enemy the raid damaged in an unmatched pull, with its own bounds and outcome."""
    trash = pulls.filter(F.col("encounter_id").isNull()).select(
        *PULL, F.col("ended_at").alias("__end"), F.col("outcome").alias("__outcome")
    )
    hit = enemies.join(damaged.select(*PULL, "instance_id").distinct(), [*PULL, "instance_id"], "left_semi")
    start = F.coalesce("engaged_at", "first_seen_at")
    end = F.coalesce("died_at", "__end")
    return hit.join(trash, PULL).select(
        "log_id", F.lit("trash").alias("kind"), F.concat_ws(":", "pull_id", "instance_id").alias("fight_id"),
        F.col("name").alias("subject"), start.alias("started_at"), end.alias("ended_at"),
        F.greatest(F.lit(0), end - start).alias("duration_ms"),
        F.when(F.col("died_at").isNull(), F.col("__outcome")).otherwise("kill").alias("outcome"),
    )


def operation_fights(pulls: DataFrame, catalog) -> DataFrame:
    """Matched fights in their operation's canonical order; groups order by first listed start, then name.

    The group order is that of the fight each operation lists first.
    """
    enc = catalog.encounters.select(F.col("id").alias("encounter_id"), "operation_id", "enc_order")
    ops = catalog.operations.select(F.col("id").alias("operation_id"), F.col("name").alias("operation_name"))
    fights = pulls.join(enc, "encounter_id").join(ops, "operation_id")
    leading = F.struct("enc_order", "started_at", "pull_index")
    groups = fights.groupBy("log_id", "operation_id").agg(F.min_by("started_at", leading).alias("group_started_at"))
    return fights.join(groups, ["log_id", "operation_id"]).select(
        "log_id", "operation_id", "operation_name", "group_started_at", "enc_order", "encounter_id",
        "pull_id", "pull_index", "started_at", "outcome",
    )


def ordered_operation_fights(fights: DataFrame) -> DataFrame:
    return fights.orderBy("log_id", "group_started_at", "operation_name", "enc_order", "started_at", "pull_index")


def progression(fights: DataFrame, keys: list[str] = ["encounter_id"]) -> DataFrame:
    """Attempts, kills, first kill and lowest boss health on a failed attempt, per encounter.

    Every outcome is an attempt.  Expects ``boss_remaining_percent`` of the boss
    entity met first.
    """
    kill = F.col("outcome") == "kill"
    return fights.filter(F.col("encounter_id").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(kill).alias("kills"),
        F.min(F.when(kill, F.col("started_at"))).alias("first_kill_at"),
        F.min(F.when(~kill, F.col("boss_remaining_percent"))).alias("best_wipe_percent"),
    )


def encounter_matrix(fights: DataFrame, encounters: DataFrame, scope: list[str] = []) -> DataFrame:
    """Kills and wipes per encounter; ``scope`` names the columns of a tenant, whose fights count apart."""
    names = encounters.select(F.col("id").alias("encounter_id"), F.col("name").alias("encounter_name"))
    counts = fights.filter(F.col("encounter_id").isNotNull()).groupBy(*scope, "encounter_id").agg(
        F.count_if(F.col("outcome") == "kill").alias("kills"), F.count_if(F.col("outcome") == "wipe").alias("wipes")
    )
    return counts.join(names, "encounter_id").orderBy(*scope, F.desc("kills"), "encounter_name")


def encounter_history(fights: DataFrame, scope: list[str] = []) -> DataFrame:
    """Clears, wipes, rounded average length and deaths per encounter, and tenant if ``scope`` names one."""
    return fights.filter(F.col("encounter_id").isNotNull()).groupBy(*scope, "encounter_id").agg(
        F.count(F.lit(1)).alias("fights"),
        F.count_if(F.col("outcome") == "kill").alias("clears"),
        F.count_if(F.col("outcome") == "wipe").alias("wipes"),
        F.floor(F.avg("duration_ms") + 0.5).cast("bigint").alias("average_duration_ms"),
        F.sum("player_deaths").alias("total_deaths"),
        F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"),
    )


def report_totals(fights: DataFrame, keys: list[str] = ["log_id"]) -> DataFrame:
    """Headline numbers of every report; fights are its matched pulls."""
    matched = F.col("encounter_id").isNotNull()
    return fights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fight_count"),
        F.count_if(matched).alias("boss_fights"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in ("kill", "wipe", "incomplete")],
        F.sum("player_deaths").alias("deaths"),
        F.sum("damage").alias("damage"),
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
    )


def reports_with_kill(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("kill_count") > 0)


def session_counters(events: DataFrame, fights: DataFrame, deaths: DataFrame, min_pull_ms: int = 10_000) -> DataFrame:
    """Running totals of each log: events, unknown lines, boss pulls, kills, wipes and deaths."""
    lines = events.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("events_parsed"), F.count_if(F.col("type") == "unknown").alias("unknown_lines")
    )
    boss = F.col("encounter_id").isNotNull()
    pulls = fights.groupBy("log_id").agg(
        F.count_if(boss & (F.col("duration_ms") >= min_pull_ms)).alias("boss_pulls"),
        F.count_if(boss & (F.col("outcome") == "kill")).alias("boss_kills"),
        F.count_if(boss & (F.col("outcome") == "wipe")).alias("boss_wipes"),
        F.sum("player_deaths").alias("raid_deaths"),
    )
    local = fights.select(*PULL, "local_player_id")
    own = (
        deaths.join(local, PULL).filter(F.col("player_id") == F.col("local_player_id"))
        .groupBy("log_id").agg(F.countDistinct("pull_id").alias("own_deaths"))
    )
    joined = lines.join(pulls, "log_id", "left").join(own, "log_id", "left")
    return joined.na.fill(0, ["boss_pulls", "boss_kills", "boss_wipes", "raid_deaths", "own_deaths"])


def fight_totals(actors: DataFrame, keys: list[str] = PULL) -> DataFrame:
    return actors.groupBy(*keys).agg(
        F.sum("damage").alias("total_damage"), F.sum("healing").alias("total_healing"), F.max("damage").alias("max_damage")
    )


def meter_rows(actors: DataFrame, metric: str, keys: list[str] = PULL) -> DataFrame:
    """Actors of one pull ranked by a rate (``dps``, ``hps`` or ``dtps``), with their share of the leader.

    Actors without a contribution are dropped.  A window here holds the raid of
    one pull.
    """
    total_of = {"dps": "damage", "hps": "healing", "dtps": "damage_taken"}[metric]
    by_rate = Window.partitionBy(*keys).orderBy(F.desc("rate"), "name", "actor_id")
    rows = actors.filter(F.col(metric) > 0).select(
        *keys, "actor_id", "name", "role", F.col(metric).alias("rate"), F.col(total_of).alias("total"), "overheal_percent", "deaths"
    )
    return rows.withColumn("rank", F.row_number().over(by_rate)).withColumn(
        "share", F.col("rate") / F.first("rate").over(by_rate.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )


def meter_total(rows: DataFrame, keys: list[str] = PULL) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("rate").alias("raid_total"))


def top_damage(actors: DataFrame, count: int = 3, keys: list[str] = PULL) -> DataFrame:
    """Best damage dealers of each pull and the line an announcement prints."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("dps"), "actor_id")
    rows = actors.filter(F.col("damage") > 0).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= count)
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("name"), F.lit(" — "), text.compact(F.col("dps"), True), F.lit(" dps")
    )
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).getField("line")
    return rows.groupBy(*keys).agg(F.array_join(listed, "\n").alias("top_damage"))


def composition(roles: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """Members per role of each pull."""
    counts = roles.groupBy(*keys).agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("tank", "healer", "dps")])
    line = F.format_string("%d tank · %d heal · %d dps", "tank", "healer", "dps")
    return counts.withColumn("composition", line)


def announcements(
    fights: DataFrame, options: Options, seed: DataFrame | None = None, scope: list[str] = [], bosses_only: bool = True
) -> DataFrame:
    """Fights worth announcing: every kill, and wipes that beat the best attempt and end close.

    Incomplete fights do not exist here.  ``seed`` (scope, encounter_id,
    attempts, kills, best_wipe_percent) carries the history before the table.
    """
    group = [*scope, "encounter_id"]
    rows = fights.filter(F.col("encounter_id").isNotNull() & (F.col("outcome") != "incomplete"))
    if bosses_only:
        rows = rows.filter(F.col("boss_instance_id").isNotNull())
    kill = F.col("outcome") == "kill"
    order = ["started_at", "log_id", "pull_index"]
    scanned = scan.running(
        rows, group, order, hour_block(),
        {
            "attempts": scan.total(F.lit(1).cast("bigint")),
            "kills": scan.total(F.when(kill, 1).otherwise(0).cast("bigint")),
            "previous_best": scan.lowest(F.when(~kill, F.col("boss_remaining_percent")), inclusive=False),
        },
    )
    if seed is not None:
        past = seed.select(
            *group, F.col("attempts").alias("__attempts"), F.col("kills").alias("__kills"), F.col("best_wipe_percent").alias("__best")
        )
        scanned = scanned.join(past, group, "left").withColumns(
            {
                "attempts": F.col("attempts") + F.coalesce("__attempts", F.lit(0)),
                "kills": F.col("kills") + F.coalesce("__kills", F.lit(0)),
                "previous_best": F.least("previous_best", "__best"),
            }
        ).drop("__attempts", "__kills", "__best")
    remaining = F.col("boss_remaining_percent")
    improved = remaining.isNotNull() & (F.col("previous_best").isNull() | (remaining < F.col("previous_best")))
    kind = (
        F.when(kill, F.when(F.col("kills") == 1, "firstKill").otherwise("kill"))
        .when(improved & (remaining <= options.close_wipe_percent), "closeWipe")
    )
    return scanned.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def announcement_text(announced: DataFrame, composition_rows: DataFrame, top_rows: DataFrame, web_url: str, report_column: str = "log_id") -> DataFrame:
    """Title, description, fields and timestamp of each announcement.

    Expects encounter and operation names, difficulty and group size on ``announced``.
    """
    # Wording of an announcement.
    first, close = F.col("kind") == "firstKill", F.col("kind") == "closeWipe"
    name = F.col("encounter_name")
    title = (
        F.when(first, F.concat(F.lit("First kill: "), name))
        .when(close, F.concat(F.lit("So close: "), name))
        .otherwise(F.concat(name, F.lit(" defeated")))
    )
    plural = F.when(F.col("attempts") == 1, "").otherwise("s")
    description = F.when(
        first, F.concat(F.lit("Down for the first time after "), F.col("attempts").cast("string"), F.lit(" attempt"), plural, F.lit("."))
    ).when(close, "A new best attempt — the next one is the one.")

    def field(label: str, value: Column, inline: bool = True) -> Column:
        return F.struct(F.lit(label).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))

    mode = text.mode(F.col("ctx_difficulty"), F.col("ctx_group_size"))
    fields = F.array_compact(
        F.array(
            field("Operation", F.col("operation_name")),
            field("Mode", F.when(mode == "", "Unknown").otherwise(mode)),
            field("Duration", text.duration(F.col("duration_ms"))),
            F.when(close, field("Boss remaining", text.percent(F.col("boss_remaining_percent")))),
            F.when(close & F.col("previous_best").isNotNull(), field("Previous best", text.percent(F.col("previous_best")))),
            field("Attempt", F.col("attempts").cast("string")),
            field("Deaths", F.col("player_deaths").cast("string")),
            field("Composition", F.coalesce("composition", F.lit("0 tank · 0 heal · 0 dps"))),
            field("Top damage", F.coalesce("top_damage", F.lit(text.DASH)), False),
        )
    )
    colour = F.when(first, 0xD4AF37).when(close, 0xF87171).otherwise(0x4ADE80)
    joined = announced.join(composition_rows.select(*PULL, "composition"), PULL, "left").join(top_rows, PULL, "left")
    url = F.concat(
        F.lit(web_url), F.lit("/reports/"), F.col(report_column).cast("string"), F.lit("/fights/"), F.col("pull_index").cast("string")
    )
    return joined.select(
        *PULL, "encounter_id", "kind", title.alias("title"), url.alias("url"), description.alias("description"),
        colour.alias("color"), fields.alias("fields"),
        F.concat(F.lit("fight "), F.col("pull_index").cast("string")).alias("footer"),
        text.iso_instant(F.col("ended_at")).alias("timestamp"),
    )


def recent(fights: DataFrame, count: int = 50) -> DataFrame:
    """The latest fights, newest first."""
    return fights.orderBy(F.desc("started_at"), F.desc("pull_id")).limit(count)


def live_filter(fights: DataFrame) -> DataFrame:
    """Pulls a live view shows: the encounter is known and the boss is likely one."""
    return fights.filter(F.col("encounter_id").isNotNull() & F.col("is_likely_boss"))


def fight_document(fights: DataFrame, actors: DataFrame, deaths: DataFrame, buckets: DataFrame, abilities: DataFrame, enemies: DataFrame) -> DataFrame:
    """One nested document per matched pull, joined from the normalized tables.

    Every list is bounded by its pull: a raid's players, enemies, abilities,
    deaths and ten-second slices.
    """

    def nest(rows: DataFrame, name: str, order: list[Column | str]) -> DataFrame:
        inner = [c for c in rows.columns if c not in PULL]
        packed = F.struct(*[F.expr(o) if isinstance(o, str) else o for o in order], F.struct(*inner).alias("value"))
        return rows.groupBy(*PULL).agg(F.array_sort(F.collect_list(packed)).getField("value").alias(name))

    document = fights.filter(F.col("encounter_id").isNotNull())
    parts = [
        (actors, "players", [(-F.col("damage")).alias("o1"), F.col("actor_id").alias("o2")]),
        (deaths, "deaths", [F.col("death_line").alias("o1")]),
        (buckets, "buckets", [F.col("bucket_index").alias("o1"), F.coalesce("player_id", F.lit("")).alias("o2")]),
        (abilities, "abilities", [(-F.col("damage")).alias("o1"), F.col("ability_id").alias("o2")]),
        (enemies, "enemies", [F.col("first_line").alias("o1"), F.col("first_slot").alias("o2")]),
    ]
    for rows, name, order in parts:
        document = document.join(nest(rows, name, order), PULL, "left")
    return document
