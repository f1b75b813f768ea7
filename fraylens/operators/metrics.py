"""Actor metrics: totals, rates, type maps and time series.

Every variant (whole pull, phase, time bucket) aggregates the same contribution
rows, so adding a key is all it takes.  Contributions are exploded before the
shuffle and combined map-side; a pull or player of any size is one hash entry
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import combat
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.options import Options

ACTOR_SUMS = [
    "damage", "healing", "overhealing", "damage_taken", "absorbed", "actions", "on_gcd_actions", "off_gcd_actions",
    "interrupts", "damage_hits", "healing_events", "healing_critical_hits", "incoming_attacks", "incoming_hits",
    "defenses", "shielded_hits", "critical_hits", "critical_damage", "mitigated_damage", "overkill", "threat", "deaths",
]


def with_ability_flags(events: DataFrame, off_gcd: DataFrame, interrupts: DataFrame) -> DataFrame:
    """Adds whether an ability is off the global cooldown and whether it interrupts."""
    off = off_gcd.select("ability_id").distinct().withColumn("is_off_gcd", F.lit(True))
    kick = interrupts.select("ability_id").distinct().withColumn("is_interrupt", F.lit(True))
    joined = events.join(off, "ability_id", "left").join(kick, "ability_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_off_gcd", "is_interrupt")})


def contributions(events: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """What every player adds to every total: one row per event and side that counts.

    Expects ``with_ability_flags``.  Side 0 is the source, side 1 the target.  A
    hit on a player counts for the target whoever dealt it; damage dealt counts
    only from players to NPCs.
    """
    source, target = F.col("side") == 0, F.col("side") == 1
    of = {t: F.col("type") == t for t in ("damage", "heal", "ability", "death")}
    dealt = source & of["damage"] & (F.col("target_kind") == "npc")
    taken = target & of["damage"]
    healed = source & of["heal"]
    is_cast = source & of["ability"] & F.col("ability_id").isNotNull()
    acted = is_cast & (F.col("phase") == "activate")
    kicked = is_cast & (F.col("phase") == "interrupt") & F.col("is_interrupt")
    died = target & of["death"]
    applied, lost = F.col("applied"), F.col("lost")
    landed = F.col("amount") > 0
    measures = {
        "damage": (dealt, applied),
        "healing": (healed, applied),
        "overhealing": (healed, lost),
        "damage_taken": (taken, applied),
        "absorbed": (taken, F.col("absorbed")),
        "actions": (acted, None),
        "on_gcd_actions": (acted & ~F.col("is_off_gcd"), None),
        "off_gcd_actions": (acted & F.col("is_off_gcd"), None),
        "interrupts": (kicked, None),
        "damage_hits": (dealt & landed, None),
        "healing_events": (healed, None),
        "healing_critical_hits": (healed & F.col("critical"), None),
        "incoming_attacks": (taken, None),
        "incoming_hits": (taken & landed, None),
        "defenses": (taken & (F.col("amount") == 0) & F.col("mitigation").isNotNull(), None),
        "shielded_hits": (taken & (F.col("mitigation") == "shield"), None),
        "critical_hits": (dealt & F.col("critical"), None),
        "critical_damage": (dealt & F.col("critical"), applied),
        "mitigated_damage": (dealt | taken, lost),
        "overkill": (dealt, combat.overkill()),
        "threat": (dealt, F.col("threat")),
        "deaths": (died, None),
    }

    def measure(name: str) -> Column:
        condition, value = measures[name]
        amount = F.lit(1.0) if value is None else F.coalesce(value, F.lit(0)).cast("double")
        return F.when(condition, amount).otherwise(F.lit(0.0)).alias(name)

    hit = dealt | taken
    sided = (
        events.filter(combat.is_type("damage", "heal", "ability", "death"))
        .withColumns({"applied": combat.applied(), "lost": combat.mitigated()})
        .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .filter(F.when(F.col("side") == 0, F.col("source_kind")).otherwise(F.col("target_kind")) == "player")
    )
    counted = sided.filter(dealt | taken | healed | acted | kicked | died)
    return counted.select(
        *keys, "line_number", "ts_ms", "side",
        F.when(source, F.col("source_id")).otherwise(F.col("target_id")).alias("actor_id"),
        F.when(source, F.col("source_name")).otherwise(F.col("target_name")).alias("name"),
        F.when(hit, F.col("damage_type")).alias("damage_type"),
        F.when(hit, F.col("mitigation")).alias("mitigation"),
        F.when(hit, applied).otherwise(F.lit(0)).cast("double").alias("type_amount"),
        *[measure(name) for name in ACTOR_SUMS],
    )


def totals(rows: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """Contribution rows summed per actor; ``whole`` casts the sums to integers."""
    cast = "bigint" if whole else "double"
    first = F.struct("line_number", "side")
    return rows.groupBy(*keys, "actor_id").agg(
        F.min_by("name", first).alias("name"),
        *[F.sum(c).cast(cast).alias(c) for c in ACTOR_SUMS],
        F.min_by("ts_ms", first).alias("first_action_at"),
        F.max_by("ts_ms", first).alias("last_action_at"),
        F.min("line_number").alias("first_line"),
    )


def type_totals(rows: DataFrame, keys: list[str], kind: str, whole: bool = False) -> DataFrame:
    """Long form of the per-type maps; dealt and received amounts share one entry.

    ``kind`` is ``damage_type`` (applied amounts) or ``mitigation`` (lost amounts).
    """
    amount = F.col("type_amount") if kind == "damage_type" else F.col("mitigated_damage")
    cast = "bigint" if whole else "double"
    grouped = rows.filter(F.col(kind).isNotNull() & (amount != 0)).groupBy(*keys, "actor_id", kind)
    return grouped.agg(F.sum(amount).cast(cast).alias("amount"))


def type_map(long_form: DataFrame, keys: list[str], kind: str, name: str) -> DataFrame:
    """Map view of ``type_totals``; a map has at most one entry per known type."""
    entries = F.map_from_entries(F.collect_list(F.struct(kind, "amount")))
    return long_form.groupBy(*keys, "actor_id").agg(entries.alias(name))


def fallback_role(role: Column, healing: Column, taken: Column, damage: Column) -> Column:
    """Role guessed from the totals when the roster declares none."""
    return (
        F.when(role.isNotNull(), role)
        .when((healing > 10_000) & (healing > damage * 0.5), F.lit("healer"))
        .when((taken > 50_000) & (taken > damage * 0.8), F.lit("tank"))
        .otherwise(F.lit("dps"))
    )


def rates(actor_totals: DataFrame, duration_ms: Column) -> DataFrame:
    """Per-second rates and percentages; every empty denominator reads 0."""
    c, secs = F.col, combat.seconds(duration_ms)
    return actor_totals.withColumns(
        {
            "dps": c("damage") / secs,
            "hps": c("healing") / secs,
            "dtps": c("damage_taken") / secs,
            "apm": c("actions") / secs * 60.0,
            "overheal_percent": combat.ratio(c("overhealing"), c("healing") + c("overhealing"), 100.0),
            "damage_crit_percent": combat.ratio(c("critical_hits"), c("damage_hits"), 100.0),
            "healing_crit_percent": combat.ratio(c("healing_critical_hits"), c("healing_events"), 100.0),
            "defense_percent": combat.ratio(c("defenses"), c("incoming_attacks"), 100.0),
            "shield_percent": combat.ratio(c("shielded_hits"), c("incoming_hits"), 100.0),
        }
    )


def discipline_as_of(events: DataFrame, first_seen: DataFrame, disciplines: DataFrame, options: Options) -> DataFrame:
    """Roster entry in force when each actor first appears in its pull.

    ``first_seen`` is (log, pull, actor_id, first_line).  The declaration that
    counts is the last one of the player on or before that line, anywhere in the log.
    """
    declared = events.filter((F.col("type") == "disciplineChanged") & combat.player("source")).select(
        "log_id", F.lit(None).cast("string").alias("pull_id"), F.col("source_id").alias("actor_id"), "line_number",
        F.struct("advanced_class", "discipline", "role").alias("entry"),
    )
    asked = first_seen.select(
        "log_id", "pull_id", "actor_id", F.col("first_line").alias("line_number"),
        F.lit(None).cast(declared.schema["entry"].dataType).alias("entry"),
    )
    scanned = scan.running(
        declared.unionByName(asked), ["log_id", "actor_id"], ["line_number"],
        scan.line_block(options.block_lines), {"known": scan.last(F.col("entry"))},
    )
    styles = disciplines.select(F.col("discipline").alias("__d"), "combat_style")
    found = scanned.filter(F.col("pull_id").isNotNull()).select(
        "log_id", "pull_id", "actor_id",
        F.col("known.discipline").alias("discipline"),
        F.col("known.role").alias("role"),
        F.col("known.advanced_class").alias("__class"),
    )
    joined = found.join(styles, F.trim("discipline") == F.col("__d"), "left")
    return joined.select(
        "log_id", "pull_id", "actor_id", "discipline", "role", F.coalesce("__class", "combat_style").alias("combat_style")
    )


def actor_metrics(
    events: DataFrame, tagged: DataFrame, pulls: DataFrame, catalog, options: Options, whole: bool = False
) -> DataFrame:
    """Totals, roster data and rates of every actor of every pull."""
    rows = contributions(with_ability_flags(tagged, catalog.off_gcd, catalog.interrupts))
    actors = totals(rows, PULL, whole)
    roster = discipline_as_of(events, actors.select(*PULL, "actor_id", "first_line"), catalog.disciplines, options)
    joined = actors.join(roster, [*PULL, "actor_id"], "left").join(pulls.select(*PULL, "duration_ms"), PULL)
    role = fallback_role(F.col("role"), F.col("healing"), F.col("damage_taken"), F.col("damage"))
    return rates(joined.withColumn("role", role), F.col("duration_ms"))


def phase_metrics(tagged: DataFrame, segments: DataFrame, catalog, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    """Totals and rates of every actor in every phase segment.

    ``tagged`` carries ``segment_index``; ``segments`` gives each segment's bounds.
    """
    by_segment = [*keys, "segment_index"]
    rows = contributions(with_ability_flags(tagged, catalog.off_gcd, catalog.interrupts), by_segment)
    joined = totals(rows, by_segment, whole).join(segments.select(*by_segment, "started_at", "ended_at"), by_segment)
    length = F.greatest(F.col("ended_at") - F.col("started_at"), F.lit(1))
    active = F.greatest(F.col("last_action_at") - F.col("first_action_at"), F.lit(0))
    return rates(joined.withColumn("active_ms", active), length)


def metric_buckets(tagged: DataFrame, pulls: DataFrame, options: Options, keys: list[str] = PULL, whole: bool = False) -> DataFrame:
    """Damage, healing and damage taken per player and time bucket of a pull.

    Bucket 0 always exists (with a null player when nobody acted in it); times
    before the pull fall into bucket 0.
    """
    starts = pulls.select(*keys, F.col("started_at").alias("__start"))
    index = F.greatest(F.lit(0), F.floor((F.col("ts_ms") - F.col("__start")) / options.bucket_ms)).cast("bigint")
    source_side = combat.raid_damage() | ((F.col("type") == "heal") & combat.player("source"))
    amount = combat.applied()

    def share(condition: Column) -> Column:
        return F.when(condition, amount).otherwise(F.lit(0))

    sides = F.array(
        F.when(
            source_side,
            F.struct(
                F.col("source_id").alias("player_id"), share(combat.raid_damage()).alias("damage"),
                share(F.col("type") == "heal").alias("healing"), (amount * 0).alias("damage_taken"),
            ),
        ),
        F.when(
            (F.col("type") == "damage") & combat.player("target"),
            F.struct(
                F.col("target_id").alias("player_id"), (amount * 0).alias("damage"),
                (amount * 0).alias("healing"), amount.alias("damage_taken"),
            ),
        ),
    )
    rows = (
        tagged.filter(combat.is_type("damage", "heal"))
        .join(starts, keys)
        .select(*keys, index.alias("bucket_index"), F.explode(sides).alias("c"))
        .filter(F.col("c").isNotNull())
        .select(*keys, "bucket_index", "c.*")
    )
    cast = "bigint" if whole else "double"
    sums = rows.groupBy(*keys, "bucket_index", "player_id").agg(
        *[F.sum(c).cast(cast).alias(c) for c in ("damage", "healing", "damage_taken")]
    )
    touched = combat.is_type("damage") | ((F.col("type") == "heal") & combat.player("source"))
    opened = tagged.filter(touched).join(starts, keys).select(*keys, index.alias("bucket_index"))
    present = pulls.select(*keys, F.lit(0).cast("bigint").alias("bucket_index")).unionByName(opened).distinct()
    return present.join(sums, [*keys, "bucket_index"], "left")


def bucket_maps(buckets: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """Map view of the series: one row per bucket, one map entry per player of the raid."""

    def as_map(column: str) -> Column:
        pair = F.when(F.col(column) != 0, F.struct("player_id", column))
        return F.map_from_entries(F.collect_list(pair)).alias(column)

    return buckets.groupBy(*keys, "bucket_index").agg(*[as_map(c) for c in ("damage", "healing", "damage_taken")])


def interrupt_list(tagged: DataFrame, interrupts: DataFrame, npc_catalog: DataFrame) -> DataFrame:
    """Interrupts in event order with the canonical name of what was interrupted."""
    names = npc_catalog.select(F.col("npc_id").alias("target_npc_id"), F.col("name").alias("__name"))
    kicks = tagged.filter((F.col("type") == "ability") & (F.col("phase") == "interrupt")).join(
        interrupts.select("ability_id").distinct(), "ability_id", "left_semi"
    )
    return kicks.join(names, "target_npc_id", "left").select(
        *PULL, "line_number", "ts_ms", "ability_id", "ability_name",
        combat.player_id("source").alias("source_id"),
        F.when(combat.player("source"), F.col("source_name")).alias("source_name"),
        "target_npc_id",
        F.when(combat.npc("target"), F.coalesce("__name", "target_name")).alias("target_name"),
    )


def session_roster(events: DataFrame, options: Options) -> DataFrame:
    """Every player a log ever shows, described by the latest discipline change.

    A later declaration also renews name and server; without one, the entry is
    the first sighting with the server known at that line.
    """
    players = F.explode(
        F.array(*[F.when(combat.player(s), F.struct(F.col(f"{s}_id").alias("player_id"), F.col(f"{s}_name").alias("name"), F.lit(i).alias("slot"))) for i, s in enumerate(("source", "target"))])
    ).alias("p")
    scanned = scan.running(
        events, ["log_id"], ["line_number"], scan.line_block(options.block_lines),
        {"server": scan.last(F.when(F.col("type") == "areaEntered", F.col("server_id")), inclusive=False)},
    )
    declares = (F.col("type") == "disciplineChanged") & (F.col("p.slot") == 0)
    rows = scanned.select("log_id", "line_number", "type", "server", "advanced_class", "discipline", "role", players)
    rows = rows.filter(F.col("p").isNotNull())
    entry = F.struct("server", F.col("p.name").alias("name"), "advanced_class", "discipline", "role")
    first = F.struct("line_number", "p.slot")
    grouped = rows.groupBy("log_id", F.col("p.player_id").alias("player_id")).agg(
        F.max_by(entry, F.when(declares, F.col("line_number"))).alias("declared"),
        F.min_by(F.struct("server", F.col("p.name").alias("name")), first).alias("seen"),
    )
    return grouped.select(
        "log_id", "player_id",
        F.when(F.col("declared").isNotNull(), F.col("declared.server")).otherwise(F.col("seen.server")).alias("server_id"),
        F.coalesce("declared.name", "seen.name").alias("name"),
        "declared.advanced_class", "declared.discipline", "declared.role",
    )
