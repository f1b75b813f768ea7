"""Player deaths: killing blows and the audit of the seconds before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.functions import combat
from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.options import Options

DEATH = [*PULL, "player_id", "death_line"]


def player_deaths(tagged: DataFrame) -> DataFrame:
    """Deaths of players in event order; NPC deaths are ignored."""
    return tagged.filter((F.col("type") == "death") & combat.player("target")).select(
        *PULL, F.col("target_id").alias("player_id"), F.col("target_name").alias("name"),
        F.col("line_number").alias("death_line"), F.col("ts_ms").alias("died_at"),
    )


def death_records(tagged: DataFrame, pulls: DataFrame, options: Options) -> DataFrame:
    """Deaths with the last hit taken before them, fully avoided hits included."""
    suffered = tagged.filter(combat.is_type("damage", "death") & combat.player("target")).select(
        *PULL, F.col("target_id").alias("player_id"), F.col("target_name").alias("name"), "line_number", "ts_ms", "type",
        F.when(
            F.col("type") == "damage", F.struct(F.col("ability_name").alias("ability"), F.col("source_name").alias("source"))
        ).alias("hit"),
    )
    scanned = scan.running(
        suffered, [*PULL, "player_id"], ["line_number"], scan.line_block(options.block_lines),
        {"blow": scan.last(F.col("hit"), inclusive=False)},
    )
    return scanned.filter(F.col("type") == "death").join(pulls.select(*PULL, "started_at"), PULL).select(
        *PULL, "player_id", "name", F.col("line_number").alias("death_line"), F.col("ts_ms").alias("died_at"),
        (F.col("ts_ms") - F.col("started_at")).alias("offset_ms"),
        F.col("blow.ability").alias("killing_blow_ability"), F.col("blow.source").alias("killing_blow_source"),
    )


def with_defensives(effects: DataFrame, defensives: DataFrame) -> DataFrame:
    """Matches effects to defensives by id, then by trimmed lower-case name; others drop out."""
    by_id = defensives.filter(F.col("effect_id").isNotNull()).select(
        "effect_id", F.struct("name", "category").alias("__by_id")
    )
    by_name = defensives.select(F.lower("name").alias("__key"), F.struct("name", "category").alias("__by_name"))
    keyed = effects.withColumn("__key", combat.normalise(F.col("effect_name")))
    joined = keyed.join(by_id, "effect_id", "left").join(by_name, "__key", "left")
    found = F.coalesce("__by_id", "__by_name")
    return (
        joined.withColumns({"defensive": found["name"], "defensive_category": found["category"]})
        .filter(F.col("defensive").isNotNull()).drop("__by_id", "__by_name", "__key")
    )


def audit_entries(tagged: DataFrame, defensives: DataFrame, options: Options) -> DataFrame:
    """Everything that happened to each dead player in the window before the death.

    Damage and heals on the victim, defensives on or by the victim.  Both sides
    carry a time bin as wide as the window, so the interval join is an equality
    on (pull, player, bin) and a hot player spreads over its bins.
    """
    width = options.audit_window_ms
    deaths = player_deaths(tagged)
    reach = F.sequence(
        F.floor((F.col("died_at") - width) / width).cast("bigint"), F.floor(F.col("died_at") / width).cast("bigint")
    )
    windows = deaths.withColumn("__bin", F.explode(reach))
    here = [*PULL, "line_number", "ts_ms", "type", "ability_name", "source_name", "amount", "critical", "absorbed", "mitigation"]
    applied = combat.applied().alias("effective_amount")
    state = [F.col("target_hp").alias("hp"), combat.hp_percent(F.col("target_hp"), F.col("target_max_hp")).alias("hp_percent")]
    blank = F.lit(None).cast("string")
    on_victim = tagged.filter(combat.is_type("damage", "heal") & combat.player("target")).select(
        *here, applied, *state, blank.alias("defensive"), blank.alias("defensive_category"), F.col("target_id").alias("player_id"),
    )
    effects = with_defensives(
        tagged.filter(combat.is_type("applyEffect", "removeEffect") & (combat.player("target") | combat.player("source"))),
        defensives,
    )
    roles = F.array_distinct(F.array_compact(F.array(combat.player_id("target"), combat.player_id("source"))))
    used = effects.select("*", F.explode(roles).alias("player_id"))
    lands = combat.player("target") & (F.col("target_id") == F.col("player_id"))
    used = used.select(
        *here, applied, *[F.when(lands, c).alias(n) for c, n in zip(state, ("hp", "hp_percent"))],
        "defensive", "defensive_category", "player_id",
    )
    binned = on_victim.unionByName(used).withColumn("__bin", F.floor(F.col("ts_ms") / width).cast("bigint"))
    inside = F.col("ts_ms").between(F.col("died_at") - width, F.col("died_at"))
    joined = binned.join(windows.select(*DEATH, "died_at", "__bin"), [*PULL, "player_id", "__bin"]).filter(inside)
    is_effect = F.col("defensive").isNotNull()
    kind = (
        F.when(F.col("type") == "applyEffect", "defensive").when(F.col("type") == "removeEffect", "defensiveEnd").otherwise(F.col("type"))
    )

    def only_hits(column: str, blank_value) -> F.Column:
        return F.when(is_effect, F.lit(blank_value)).otherwise(F.col(column))

    damage_only = F.col("type") == "damage"
    return joined.select(
        *DEATH, "died_at", "line_number", "ts_ms", (F.col("died_at") - F.col("ts_ms")).alias("offset_ms"),
        kind.alias("kind"),
        F.when(is_effect, F.col("defensive")).otherwise(F.col("ability_name")).alias("ability"),
        F.col("source_name").alias("source"),
        only_hits("amount", 0).alias("amount"), only_hits("effective_amount", 0).alias("effective"),
        F.when(is_effect, F.lit(False)).otherwise(F.col("critical")).alias("critical"),
        F.when(damage_only, F.col("absorbed")).alias("absorbed"),
        F.when(damage_only, F.col("mitigation")).alias("mitigation"),
        "defensive_category", "hp", "hp_percent",
    )


def audit_totals(entries: DataFrame, deaths: DataFrame, whole: bool = False) -> DataFrame:
    """Totals of each audit; a death with an empty window keeps its row.

    Here the killing blow is the last hit that really took health.  A defensive
    is still active when its latest change in the window was an application.
    """
    cast = "bigint" if whole else "double"
    damage, heal = F.col("kind") == "damage", F.col("kind") == "heal"
    hit = damage & (F.col("effective") > 0)
    sums = entries.groupBy(*DEATH).agg(
        F.sum(F.when(damage, F.col("effective"))).cast(cast).alias("damage_taken"),
        F.sum(F.when(heal, F.col("effective"))).cast(cast).alias("healing_received"),
        F.max(F.when(damage, F.col("effective"))).cast(cast).alias("largest_hit"),
        F.max_by(F.struct("ability", "source", "effective"), F.when(hit, F.col("line_number"))).alias("blow"),
    )
    changes = entries.filter(F.col("kind").isin("defensive", "defensiveEnd"))
    per_name = changes.groupBy(*DEATH, F.col("ability").alias("defensive")).agg(
        F.max_by("kind", "line_number").alias("last_kind"),
        F.min(F.when(F.col("kind") == "defensive", F.col("line_number"))).alias("first_use"),
        F.max(F.when(F.col("kind") == "defensive", F.col("line_number"))).alias("last_use"),
    )
    listed = per_name.filter(F.col("first_use").isNotNull()).groupBy(*DEATH).agg(
        F.array_sort(F.collect_list(F.struct("first_use", "defensive"))).getField("defensive").alias("defensives_used"),
        F.array_sort(
            F.collect_list(F.when(F.col("last_kind") == "defensive", F.struct("last_use", "defensive")))
        ).getField("defensive").alias("defensives_active"),
    )
    none = F.array().cast("array<string>")
    joined = deaths.select(*DEATH, "name", "died_at").join(sums, DEATH, "left").join(listed, DEATH, "left")
    zero = F.lit(0).cast(cast)
    return joined.select(
        *DEATH, "name", "died_at",
        *[F.coalesce(c, zero).alias(c) for c in ("damage_taken", "healing_received", "largest_hit")],
        F.col("blow.ability").alias("killing_blow_ability"), F.col("blow.source").alias("killing_blow_source"),
        F.col("blow.effective").cast(cast).alias("killing_blow_amount"),
        F.coalesce("defensives_used", none).alias("defensives_used"),
        F.coalesce("defensives_active", none).alias("defensives_active"),
    )


def audit_timeline(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Entries closed by the death row itself, ordered by time then kind."""
    end = totals.select(
        *DEATH, "died_at", F.col("death_line").alias("line_number"), F.col("died_at").alias("ts_ms"),
        F.lit(0).cast("bigint").alias("offset_ms"), F.lit("death").alias("kind"),
        F.col("killing_blow_ability").alias("ability"), F.col("killing_blow_source").alias("source"),
        F.lit(False).alias("critical"), F.lit(0).cast("bigint").alias("hp"), F.lit(0.0).alias("hp_percent"),
    )
    kinds = dict(entries.dtypes)
    for column in entries.columns:
        if column not in end.columns:
            value = F.lit(0) if column in ("amount", "effective") else F.lit(None)
            end = end.withColumn(column, value.cast(kinds[column]))
    return entries.unionByName(end.select(*entries.columns)).orderBy(*DEATH, "ts_ms", F.lower("kind"), "line_number")
