"""Effect windows and other as-of state of a pull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraylens.functions import combat
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.options import Options


def effect_windows(tagged: DataFrame, options: Options, keys: list[str] = PULL) -> DataFrame:
    """From each application of an effect on a target to its removal or re-application.

    ``charges`` is the last count known inside the window; a window nobody ends
    has a null ``removed_at``.
    """
    effects = tagged.filter(
        combat.is_type("applyEffect", "removeEffect", "modifyCharges") & F.col("target_kind").isNotNull()
    ).select(
        *keys, "line_number", "ts_ms", "type", "effect_id", "effect_name", "charges", "target_id", "source_id",
    )
    group = [*keys, "effect_id", "target_id"]
    line = F.col("line_number")
    opens = F.when(F.col("type") == "applyEffect", line).when(F.col("type") == "removeEffect", F.lit(0))
    scanned = scan.running(
        effects, group, ["line_number"], scan.line_block(options.block_lines), {"open": scan.last(opens, inclusive=False)}
    )
    is_apply, is_change = F.col("type") == "applyEffect", F.col("type") == "modifyCharges"
    inside = F.coalesce(F.col("open") > 0, F.lit(False))
    parts = F.explode(
        F.array(
            F.when(is_apply, F.struct(line.alias("window"), F.lit("start").alias("part"))),
            F.when(inside, F.struct(F.col("open").alias("window"), F.when(is_change, "charges").otherwise("end").alias("part"))),
        )
    ).alias("p")
    rows = scanned.select("*", parts).filter(F.col("p").isNotNull())
    start, end = F.col("p.part") == "start", F.col("p.part") == "end"

    def at_start(column: str) -> Column:
        return F.max(F.when(start, F.col(column))).alias(column)

    return rows.groupBy(*group, F.col("p.window").alias("apply_line")).agg(
        at_start("effect_name"), at_start("source_id"),
        F.max(F.when(start, F.col("ts_ms"))).alias("applied_at"),
        F.max(F.when(end, F.col("ts_ms"))).alias("removed_at"),
        F.max_by(F.struct("charges"), F.when(~end, line)).getField("charges").alias("charges"),
    )


def charge_changes(tagged: DataFrame, options: Options, keys: list[str] = PULL) -> DataFrame:
    """Charge changes with the count before, known only while the effect is active."""
    effects = tagged.filter(
        combat.is_type("applyEffect", "removeEffect", "modifyCharges") & F.col("target_kind").isNotNull()
    )
    switch = F.when(F.col("type") == "applyEffect", True).when(F.col("type") == "removeEffect", False)
    known = F.when(F.col("type") != "removeEffect", F.struct("charges"))
    scanned = scan.running(
        effects, [*keys, "effect_id", "target_id"], ["line_number"], scan.line_block(options.block_lines),
        {"active": scan.last(switch, inclusive=False), "known": scan.last(known, inclusive=False)},
    ).filter(F.col("type") == "modifyCharges")
    previous = F.when(F.coalesce("active", F.lit(False)), F.col("known.charges"))
    return scanned.withColumn("previous_charges", previous).drop("active", "known")


def retarget_casts(tagged: DataFrame, options: Options, keys: list[str] = PULL) -> DataFrame:
    """Self-targeted ability events with the caster's current target, when one is set and was seen."""
    by_caster = tagged.filter(F.col("source_id").isNotNull() & combat.is_type("ability", "target"))
    aim = F.when(
        F.col("type") == "target",
        F.struct(
            F.when((F.col("state") == "set") & F.col("target_id").isNotNull(), F.col("target_id")).alias("id"),
            F.when(F.col("state") == "set", F.col("target_npc_id")).alias("npc_id"),
            F.when(F.col("state") == "set", F.col("target_name")).alias("name"),
            F.when(F.col("state") == "set", F.col("target_kind")).alias("kind"),
        ),
    )
    aim = F.when((F.col("state") == "cleared") | F.col("target_id").isNotNull(), aim)
    scanned = scan.running(
        by_caster, [*keys, "source_id"], ["line_number"], scan.line_block(options.block_lines), {"aim": scan.last(aim)}
    )
    to_self = (F.col("type") == "ability") & (F.col("target_id") == F.col("source_id"))
    moved = to_self & F.col("aim.id").isNotNull()
    return scanned.filter(F.col("type") == "ability").select(
        *keys, "line_number", "ts_ms", "phase", "ability_id", "source_id", "target_id",
        F.when(moved, F.col("aim.id")).otherwise(F.col("target_id")).alias("resolved_target_id"),
        F.when(moved, F.col("aim.npc_id")).otherwise(F.col("target_npc_id")).alias("resolved_target_npc_id"),
    )


def latest_npc_health(tagged: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """Latest health percentage of every NPC class; the target slot is later than the source slot."""
    sides = F.array(
        *[
            F.when(
                combat.npc(s) & (F.col(f"{s}_max_hp") > 0) & F.col(f"{s}_hp").isNotNull(),
                F.struct(
                    F.col(f"{s}_npc_id").alias("npc_id"), F.lit(i).alias("slot"),
                    combat.hp_percent(F.col(f"{s}_hp"), F.col(f"{s}_max_hp")).alias("hp_percent"),
                ),
            )
            for i, s in enumerate(("source", "target"))
        ]
    )
    rows = tagged.select(*keys, "line_number", F.explode(sides).alias("h")).filter(F.col("h").isNotNull())
    return rows.groupBy(*keys, F.col("h.npc_id").alias("npc_id")).agg(
        F.max_by("h.hp_percent", F.struct("line_number", "h.slot")).alias("hp_percent")
    )


def latest_positions(tagged: DataFrame, keys: list[str] = PULL) -> DataFrame:
    """Latest known position of every entity."""
    sides = F.array(
        *[
            F.when(
                F.col(f"{s}_pos").isNotNull(),
                F.struct(F.col(f"{s}_id").alias("entity_id"), F.lit(i).alias("slot"), F.col(f"{s}_pos").alias("position")),
            )
            for i, s in enumerate(("source", "target"))
        ]
    )
    rows = tagged.select(*keys, "line_number", F.explode(sides).alias("p")).filter(F.col("p").isNotNull())
    return rows.groupBy(*keys, F.col("p.entity_id").alias("entity_id")).agg(
        F.max_by("p.position", F.struct("line_number", "p.slot")).alias("position")
    )


def phase_candidates(tagged: DataFrame, matches: DataFrame, encounters: DataFrame) -> DataFrame:
    """Highest phase order that every event reaches, in pulls whose phases are described by text only.

    A phase is reached when an NPC's health falls to the highest percentage its
    trigger names, when its name (or "phase N") appears in the ability or effect,
    or when the NPC its death trigger names has died; the first phase is reached by every event.
    """
    phase = F.explode("phases").alias("ph")
    rules = encounters.select(F.col("id").alias("encounter_id"), phase).select(
        "encounter_id",
        F.col("ph.phase_order").alias("phase_order"),
        combat.normalise(F.col("ph.name")).alias("phase_name"),
        combat.normalise(F.col("ph.deathTrigger")).alias("death_name"),
        F.array_max(
            F.transform(
                F.regexp_extract_all(F.col("ph.trigger"), F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda v: v.cast("double")
            )
        ).alias("threshold"),
    )
    text = combat.normalise(F.concat(F.coalesce("ability_name", F.lit("")), F.lit(" "), F.coalesce(combat.spoken()[1], F.lit(""))))
    hp = F.when(combat.npc("target"), combat.hp_percent(F.col("target_hp"), F.col("target_max_hp")))
    died = F.when(F.col("type") == "death", combat.normalise(F.col("target_name")))
    marks = tagged.select(*PULL, "line_number", "ts_ms", text.alias("text"), hp.alias("hp"), died.alias("died"))
    joined = marks.join(matches.select(*PULL, "encounter_id"), PULL)
    table = rules.groupBy("encounter_id").agg(
        F.collect_list(F.struct("phase_order", "phase_name", "death_name", "threshold")).alias("rules"),
        F.min("phase_order").alias("first_order"),
    )

    def reached(r: Column) -> Column:
        by_health = F.coalesce(F.col("hp") <= r["threshold"], F.lit(False))
        by_text = (F.col("text") != "") & (
            F.contains(F.col("text"), r["phase_name"])
            | F.contains(F.col("text"), F.concat(F.lit("phase "), r["phase_order"].cast("string")))
        )
        by_death = F.coalesce(F.col("died") == r["death_name"], F.lit(False))
        return by_health | by_text | by_death

    order = F.array_max(F.transform(F.filter("rules", reached), lambda r: r["phase_order"]))
    return joined.join(table, "encounter_id").select(
        *PULL, "line_number", "ts_ms", F.greatest("first_order", order).alias("phase_order")
    )


def text_phases(tagged: DataFrame, matches: DataFrame, encounters: DataFrame, options: Options) -> DataFrame:
    """Phase order in force at every event: the highest reached so far, as orders never go back."""
    reached = phase_candidates(tagged, matches, encounters).withColumnRenamed("phase_order", "candidate")
    scanned = scan.running(
        reached, PULL, ["line_number"], scan.line_block(options.block_lines), {"phase_order": scan.highest(F.col("candidate"))}
    )
    return scanned.select(*PULL, "line_number", "ts_ms", "phase_order")


def phase_entries(phases: DataFrame) -> DataFrame:
    """Lines at which a pull moves on to a higher phase, with the end of each phase.

    Takes ``phase_candidates`` or ``text_phases``.  One aggregation keeps the first
    line of every order; the windows see no more rows of a pull than it has phases.
    """
    firsts = phases.groupBy(*PULL, "phase_order").agg(
        F.min("line_number").alias("line_number"), F.min_by("ts_ms", "line_number").alias("started_at")
    )
    by_line = Window.partitionBy(*PULL).orderBy("line_number")
    before = F.max("phase_order").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    entries = firsts.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("phase_order") > F.col("__before")))
    return entries.select(
        *PULL, "phase_order", "started_at", F.lead("started_at").over(by_line).alias("ended_at"), "line_number",
        F.lead("line_number").over(by_line).alias("next_line"),
    )


def phase_tagged(tagged: DataFrame, entries: DataFrame) -> DataFrame:
    """Events with the phase they belong to; the event that causes a change belongs to the new phase.

    The join is an equality on the pull and meets at most as many rows as the
    pull has phases; pulls without phases drop out.
    """
    spans = entries.select(*PULL, F.col("phase_order").alias("segment_index"), F.col("line_number").alias("__from"), F.col("next_line").alias("__to"))
    inside = (F.col("line_number") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("line_number") < F.col("__to")))
    return tagged.join(spans, PULL).filter(inside).drop("__from", "__to")


def phase_bounds(entries: DataFrame, pulls: DataFrame) -> DataFrame:
    """Phase segments with their bounds; the last one ends with its pull."""
    ends = pulls.select(*PULL, F.col("ended_at").alias("__end"))
    return entries.join(ends, PULL).select(
        *PULL, F.col("phase_order").alias("segment_index"), "started_at", F.coalesce("ended_at", "__end").alias("ended_at")
    )


def active_target(events: DataFrame, options: Options, hold_ms: int = 10_000) -> DataFrame:
    """The NPC on the local player's display at every event: the last one hit or targeted.

    The label fades ``hold_ms`` after it was set, measured on the latest time seen.
    Expects ``session_context`` columns.
    """
    local = F.col("source_id") == F.col("local_player_id")
    hit = combat.raid_damage() & F.coalesce(local, F.lit(False))
    aimed = (F.col("type") == "target") & (F.col("state") == "set") & combat.npc("target")
    label = F.when(hit | aimed, F.struct(F.col("target_name").alias("name"), F.col("ts_ms").alias("at")))
    scanned = scan.running(
        events, ["log_id"], ["line_number"], scan.line_block(options.block_lines),
        {"label": scan.last(label), "now": scan.highest(F.col("ts_ms"))},
    )
    fresh = F.col("now") - F.col("label.at") <= hold_ms
    return scanned.select("log_id", "line_number", "ts_ms", F.when(fresh, F.col("label.name")).alias("active_target"))


def event_rate(events: DataFrame, span_ms: int = 5_000) -> DataFrame:
    """Events of the log in the trailing span, per second, at every event.

    Each event is also handed to the next bin as history, so no task holds more
    than two spans of one log.
    """
    bins = F.explode(F.array(F.lit(0), F.lit(1))).alias("__later")
    spread = events.select("log_id", "line_number", "ts_ms", bins).withColumn(
        "__bin", F.floor(F.col("ts_ms") / span_ms) + F.col("__later")
    )
    trailing = Window.partitionBy("log_id", "__bin").orderBy("ts_ms").rangeBetween(-span_ms, 0)
    counted = spread.withColumn("events", F.count(F.lit(1)).over(trailing)).filter(F.col("__later") == 0)
    per_second = F.round(F.col("events") / (span_ms / 1000.0)).cast("bigint")
    return counted.select("log_id", "line_number", "ts_ms", "events", per_second.alias("events_per_second"))
