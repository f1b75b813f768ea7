"""Tables the analysis writes and reads back, and the records it exports.

Everything is keyed, so a repeated write replaces what it wrote before.  Paths
are partitioned by tenant and report; every read names its tenant.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.functions import text
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.operators.staging import staged
from fraylens.options import Options
from fraylens.sources.catalog import latest_per_key

REPORT = ["guild_id", "report_code"]
FIGHT_KEY = [*REPORT, "event_id"]
BUCKET_KEY = [*REPORT, "fight_id", "bucket_index", "part"]
DAY_MS = 86_400_000


def storage_rows(tagged: DataFrame, pulls: DataFrame, options: Options) -> DataFrame:
    """Events with their storage bucket, part and position.

    Buckets count from the pull's start; a bucket of more than
    ``storage_part_events`` events rolls into further parts, in line order.
    """
    starts = pulls.select(*PULL, F.col("started_at").alias("__start"))
    index = F.greatest(F.lit(0), F.floor((F.col("ts_ms") - F.col("__start")) / options.storage_bucket_ms)).cast("bigint")
    indexed = tagged.join(starts, PULL).withColumn("bucket_index", index)
    counted = scan.running(
        indexed, [*PULL, "bucket_index"], ["line_number"], scan.line_block(options.block_lines),
        {"__n": scan.total(F.lit(1).cast("bigint"))},
    )
    size = options.storage_part_events
    started = F.col("__start") + F.col("bucket_index") * options.storage_bucket_ms
    expires = F.lit(None).cast("bigint") if options.retention_days is None else started + options.retention_days * DAY_MS
    return counted.withColumns(
        {
            "part": F.floor((F.col("__n") - 1) / size).cast("bigint"),
            "position": ((F.col("__n") - 1) % size).cast("bigint"),
            "bucket_started_at": started,
            "bucket_ended_at": started + options.storage_bucket_ms,
            "expires_at": expires,
        }
    ).drop("__n", "__start")


def storage_buckets(rows: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """One row per bucket part; with ``payload`` it holds its events, at most one part's worth."""
    keys = [*PULL, "bucket_index", "part", "bucket_started_at", "bucket_ended_at", "expires_at"]
    aggregates = [F.count(F.lit(1)).alias("event_count"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line")]
    if payload is not None:
        listed = F.array_sort(F.collect_list(F.struct("position", F.struct(*payload).alias("e"))))
        aggregates.append(listed.getField("e").alias("events"))
    return rows.groupBy(*keys).agg(*aggregates)


def merge_buckets(buckets: DataFrame) -> DataFrame:
    """Bucket parts back to events, positioned by bucket, part and place."""
    exploded = buckets.select(*PULL, "bucket_index", "part", F.posexplode("events").alias("position", "e"))
    return exploded.select(*PULL, "bucket_index", "part", "position", "e.*")


def unexpired(buckets: DataFrame, as_of_ms: Column) -> DataFrame:
    return buckets.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of_ms))


def fight_documents(fights: DataFrame, guild_id: str) -> DataFrame:
    """Stored form of matched fights: dates instead of epoch milliseconds, keyed by tenant and report."""
    return fights.filter(F.col("encounter_id").isNotNull()).withColumns(
        {
            "guild_id": F.lit(guild_id),
            "report_code": F.col("log_id").cast("string"),
            "event_id": F.col("pull_id"),
            "fight_id": F.col("pull_index"),
            "started_at": F.timestamp_millis("started_at"),
            "ended_at": F.timestamp_millis("ended_at"),
        }
    )


def _stored_beside(new: DataFrame, path: str) -> DataFrame | None:
    """What is stored in the reports that ``new`` touches; None before the first write."""
    try:
        stored = new.sparkSession.read.schema(new.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.join(new.select(*REPORT).distinct(), REPORT, "left_semi")


def _replace_reports(rows: DataFrame, path: str, spread: list[str], order: list[str]) -> None:
    """Rewrites the (guild, report) partitions that ``rows`` names and no others.

    ``rows`` are written already: the rewrite must not read the files that it replaces.
    Ranges of the report and ``spread`` keep a report together, so there are no more
    files than reports and tasks, and one huge report is written by many tasks.
    """
    laid = rows.repartitionByRange(*REPORT, *spread).sortWithinPartitions(*REPORT, *order)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*REPORT).parquet(path)


def upsert_fights(new: DataFrame, path: str, version: str = "updated_at") -> None:
    """Writes fights so that each key keeps its newest version, however often and in whatever order it is sent."""
    new = staged(new)
    stored = _stored_beside(new, path)
    merged = new if stored is None else stored.unionByName(new)
    _replace_reports(staged(latest_per_key(merged, FIGHT_KEY, [F.col(version)]), packed=True), path, [], ["event_id"])


def write_event_buckets(rows: DataFrame, guild_id: str, path: str) -> None:
    """Raw events of fights; a bucket part that is sent again replaces the one before it.

    Files are laid out by tenant and report and sorted by fight, so that a read of
    one fight skips the rest by its statistics.
    """
    keys = {"guild_id": F.lit(guild_id), "report_code": F.col("log_id").cast("string"), "fight_id": F.col("pull_id")}
    new = staged(rows.withColumns(keys))
    stored = _stored_beside(new, path)
    if stored is not None:
        kept = stored.join(new.select(*BUCKET_KEY).distinct(), BUCKET_KEY, "left_anti")
        new = staged(kept.unionByName(new), packed=True)
    # The bucket is part of the range: one huge fight is written by many tasks.
    _replace_reports(new, path, ["fight_id", "bucket_index"], ["fight_id", "bucket_index", "part", "line_number"])


def read_fight_events(spark: SparkSession, path: str, guild_id: str, report_code: str, fight_id: str) -> DataFrame:
    """Events of one fight in stored order; partition filters keep the scan to its files."""
    stored = spark.read.option("basePath", path).parquet(path)
    one = stored.filter(
        (F.col("guild_id") == guild_id) & (F.col("report_code") == report_code) & (F.col("fight_id") == fight_id)
    )
    return one.orderBy("bucket_index", "part", "line_number")


def report_headers(fights: DataFrame, actors: DataFrame, keys: list[str] = ["log_id"]) -> DataFrame:
    """End, zone, difficulty and size of a report from its latest fight, and its distinct roster."""
    header = fights.groupBy(*keys).agg(
        F.max_by(F.struct("ended_at", "ctx_zone_name", "ctx_difficulty", "ctx_group_size"), F.struct("started_at", "pull_index")).alias("h")
    )
    member = F.struct(F.col("actor_id").alias("player_id"), "name", "combat_style", "discipline", "role")
    roster = actors.select(*keys, member.alias("m")).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("roster"))
    return header.join(roster, keys, "left").select(*keys, "h.*", "roster")


def read_report(fights: DataFrame, reports: DataFrame, guild_id: str, code: str) -> DataFrame:
    """One report with its fights ordered by start, then event id."""
    mine = fights.filter((F.col("guild_id") == guild_id) & (F.col("report_code") == code))
    one = reports.filter((F.col("guild_id") == guild_id) & (F.col("report_code") == code))
    value = F.struct(*[c for c in fights.columns if c not in ("guild_id", "report_code")])
    nested = mine.groupBy("guild_id", "report_code").agg(
        F.array_sort(F.collect_list(F.struct("started_at", "event_id", value.alias("fight")))).getField("fight").alias("fights")
    )
    return one.join(nested, ["guild_id", "report_code"], "left")


def list_reports(reports: DataFrame, guild_id: str, limit: int = 50) -> DataFrame:
    """Newest reports of a guild; the headline counts come from an aggregate, fights stay unread."""
    mine = reports.filter(F.col("guild_id") == guild_id)
    return mine.orderBy(F.desc("started_at"), "report_code").limit(limit)


def pull_event_id(kind: str, log_file: Column) -> Column:
    """Deterministic identity of a finished pull: a hash over what makes it the same pull."""
    identity = F.struct(
        F.lit(kind).alias("kind"), F.col("fight_id").alias("id"), F.col("started_at").alias("startedAt"),
        F.col("ended_at").alias("endedAt"), log_file.alias("logFileName"),
    )
    return F.sha2(F.to_json(identity, {"ignoreNullFields": "false"}), 256)


def distinct_pulls(pulls: DataFrame, kind: str, log_file: Column) -> DataFrame:
    """Pulls with their identity, each identity once."""
    return pulls.withColumn("event_id", pull_event_id(kind, log_file)).dropDuplicates(["event_id"])


def _envelope(event: Column, version: str) -> Column:
    return F.to_json(
        F.struct(
            F.lit("progression-event").alias("schema"), F.lit(version).alias("version"), F.col("guild_id").alias("guildId"),
            F.lit("guild").alias("visibility"), event.alias("event"),
        )
    )


def _export_id(identity: Column, log_file: Column) -> Column:
    body = F.struct(
        F.lit("3.0").alias("version"), identity.alias("id"), log_file.alias("logFileName"),
        F.col("started_at").alias("startedAt"), F.col("ended_at").alias("endedAt"),
    )
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def pull_envelopes(fights: DataFrame, log_file: Column, character: Column, server: Column, names: DataFrame, details: Column | None = None) -> DataFrame:
    """Versioned JSON record of every matched pull; ``names`` maps encounter ids to names."""
    known = names.select(F.col("id").alias("encounter_id"), F.col("name").alias("__name"))
    rows = fights.filter(F.col("encounter_id").isNotNull()).join(known, "encounter_id")
    event = F.struct(
        _export_id(F.col("pull_id"), log_file).alias("eventId"),
        log_file.alias("sessionId"), log_file.alias("logFileId"),
        F.col("pull_id").alias("pullId"), F.col("pull_index").alias("pullIndex"),
        text.iso_instant(F.col("started_at")).alias("startedAt"), text.iso_instant(F.col("ended_at")).alias("endedAt"),
        F.col("encounter_id").alias("encounterId"), F.col("__name").alias("encounterName"), "outcome",
        character.alias("characterName"), server.alias("serverId"), log_file.alias("logFileName"),
        F.col("ctx_difficulty").alias("difficulty"), text.iso_instant(F.col("ended_at")).alias("occurredAt"),
        *([] if details is None else [details.alias("details")]),
    )
    return rows.select("guild_id", "log_id", "pull_id", _export_id(F.col("pull_id"), log_file).alias("event_id"), _envelope(event, "3.0").alias("envelope"))


def trash_envelopes(trash: DataFrame, log_file: Column, character: Column, server: Column) -> DataFrame:
    """Versioned JSON record of every damaged enemy outside a matched pull."""
    identity = _export_id(F.col("fight_id"), log_file)
    instance = F.element_at(F.split("fight_id", ":"), -1)
    event = F.struct(
        identity.alias("eventId"), log_file.alias("sessionId"), log_file.alias("logFileId"),
        F.col("fight_id").alias("pullId"),
        text.iso_instant(F.col("started_at")).alias("startedAt"), text.iso_instant(F.col("ended_at")).alias("endedAt"),
        F.concat(F.lit("trash:"), instance).alias("encounterId"), F.col("subject").alias("encounterName"), "outcome",
        character.alias("characterName"), server.alias("serverId"), log_file.alias("logFileName"),
        text.iso_instant(F.col("ended_at")).alias("occurredAt"),
        F.struct("fight_id", "started_at", "ended_at", "duration_ms", "subject", "outcome").alias("details"),
    )
    return trash.select("guild_id", "log_id", "fight_id", identity.alias("event_id"), _envelope(event, "3.0").alias("envelope"))


def character_envelopes(identities: DataFrame) -> DataFrame:
    """Versioned JSON record of the character a log belongs to."""
    event = F.struct(
        F.lit("character-detection").alias("encounterId"), F.lit("Character Detection").alias("encounterName"),
        F.lit("active").alias("outcome"), F.col("name").alias("characterName"), F.col("server_id").alias("serverId"),
        "discipline", text.iso_instant(F.col("occurred_at")).alias("occurredAt"),
    )
    return identities.select("guild_id", "log_id", _envelope(event, "2.0").alias("envelope"))


def live_snapshots(outcomes: DataFrame, actors: DataFrame, encounters: DataFrame) -> DataFrame:
    """Live view of each pull: whole rates per actor, and a boss row even when only the encounter is known."""
    names = encounters.select(F.col("id").alias("encounter_id"), F.col("name").alias("encounter_name"))
    known = outcomes.join(names, "encounter_id", "left")
    boss = F.when(
        F.col("boss_npc_id").isNotNull(),
        F.struct(
            F.col("boss_name").alias("name"), F.col("boss_hp").alias("hp"), F.col("boss_max_hp").alias("maxHp"),
            F.col("boss_hp_percent").alias("hpPercent"), F.col("is_likely_boss").alias("isLikelyBoss"),
        ),
    ).when(
        F.col("encounter_id").isNotNull(),
        F.struct(
            F.col("encounter_name").alias("name"), F.lit(None).cast("bigint").alias("hp"), F.lit(10_000_000).cast("bigint").alias("maxHp"),
            F.lit(None).cast("double").alias("hpPercent"), F.lit(True).alias("isLikelyBoss"),
        ),
    )
    whole = {c: F.floor(F.col(c) + 0.5).cast("bigint").alias(c) for c in ("dps", "hps", "dtps", "overheal_percent")}
    actor = F.struct("actor_id", "name", "role", "discipline", "combat_style", *whole.values(), "damage", "healing", "damage_taken", "deaths")
    raid = actors.groupBy(*PULL).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("damage")).alias("o"), F.col("actor_id").alias("p"), actor.alias("a")))).getField("a").alias("actors")
    )
    return known.join(raid, PULL, "left").select(
        *PULL, F.col("duration_ms").alias("elapsed_ms"), F.col("ctx_zone_name").alias("zone"), F.col("ctx_difficulty").alias("difficulty"),
        boss.alias("boss"), "encounter_id", "encounter_name", "actors",
    )
