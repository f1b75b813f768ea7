"""Game catalogue: small dimension tables supplied by the user as JSON or CSV.

The tables are joined without forced hints, so the optimizer broadcasts them
while they are below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles them
beyond it.  Batch segmentation meets them by joins alone; only the live fold and
the mechanics of definitions bring an index to the driver, after its row count has been checked.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType

from fraylens.functions import fixed

SCHEMAS = {
    "operations": (
        "id string, name string, location string, zone_ids array<string>, zone_names array<string>, "
        "is_lair boolean, difficulties array<string>, group_sizes array<int>"
    ),
    "encounters": (
        "id string, name string, operation_id string, enc_order int, catalog_order int, boss_names array<string>, "
        "victory_requires array<string>, adds array<string>, boss_npc_ids array<string>, add_npc_ids array<string>, "
        "single_instance_boss_names array<string>, victory_event string, "
        "phases array<struct<id:string,phase_order:int,name:string,style:string,trigger:string,deathTrigger:string>>"
    ),
    "npc_catalog": (
        "npc_id string, name string, names array<string>, role string, is_kill_target boolean, "
        "triggers_encounter boolean, single_instance boolean, encounter_id string, encounter_name string, "
        "operation_name string, source string, ambiguous boolean"
    ),
    "observed": (
        "encounter_id string, name string, npc_id string, zone_id string, difficulty string, group_size int, max_hp bigint"
    ),
    "abilities": "ability_id string, name string, attack_type string, damage_type string",
    "off_gcd": "ability_id string",
    "interrupts": "ability_id string",
    "discipline_abilities": (
        "ability_id string, ability string, discipline string, disciplines array<string>, discipline_id string"
    ),
    "disciplines": "discipline string, role string, combat_style string",
    "defensives": "name string, effect_id string, category string",
    "encounter_defs": "id string, name string, boss_npc_ids array<string>, definition_json string",
}

#: Rows of a catalogue the driver may hold; the published one has 138 encounters.
MAX_INDEX_ROWS = 20_000


def _named(value, kind: DataType):
    """Positional rows as named ones, all the way down."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _named(v, f.dataType) for f, v in zip(kind.fields, value)}
    if isinstance(kind, ArrayType):
        return [_named(v, kind.elementType) for v in value]
    return value


def small_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A local relation, whose known size lets the optimizer broadcast it."""
    schema = StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([_named(r, schema) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


@dataclass(frozen=True)
class Catalog:
    operations: DataFrame
    encounters: DataFrame
    npc_catalog: DataFrame
    observed: DataFrame
    abilities: DataFrame
    off_gcd: DataFrame
    interrupts: DataFrame
    discipline_abilities: DataFrame
    disciplines: DataFrame
    defensives: DataFrame
    encounter_defs: DataFrame

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: dict[str, list]) -> Catalog:
        """Catalogue from in-memory rows; disciplines and defensives default to the fixed tables."""
        filled = {"disciplines": fixed.table(fixed.DISCIPLINES), "defensives": fixed.table(fixed.DEFENSIVES), **rows}
        return cls(**{f.name: small_table(spark, filled.get(f.name, []), SCHEMAS[f.name]) for f in fields(cls)})

    @classmethod
    def read(cls, spark: SparkSession, directory: str, names: set[str]) -> Catalog:
        """Catalogue from ``<directory>/<name>.json`` (one object per line) for the given tables."""
        base = cls.from_rows(spark, {})
        loaded = {n: spark.read.schema(SCHEMAS[n]).json(f"{directory}/{n}.json") for n in names}
        return cls(**{f.name: loaded.get(f.name, getattr(base, f.name)) for f in fields(cls)})

    def list_encounters(self) -> DataFrame:
        """Encounters with their operation, in catalogue order."""
        ops = self.operations.select(
            F.col("id").alias("operation_id"), F.col("name").alias("operation_name"), "is_lair", "zone_ids", "zone_names"
        )
        return self.encounters.join(ops, "operation_id", "left")

    def matching(self) -> DataFrame:
        """Matching data of every encounter."""
        observed = self.observed.groupBy(F.col("encounter_id").alias("id")).agg(
            F.collect_set("npc_id").alias("observed_ids")
        )
        return self.list_encounters().join(observed, "id", "left").select(
            "id", "catalog_order", "boss_names", "victory_requires", "boss_npc_ids", "observed_ids",
            "zone_ids", "zone_names", "victory_event",
        )

    def matching_keys(self) -> DataFrame:
        """(kind, key, id): the boss names and NPC ids that lead to an encounter or a definition.

        Kinds are ``name`` and ``npc`` for encounters, ``victim`` for names that only
        their victory asks for, and ``defined`` for the bosses of definitions.
        """
        listed = {
            "name": F.col("boss_names"), "victim": F.col("victory_requires"),
            "npc": F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("boss_npc_ids", "observed_ids")]),
        }

        def paired(kind: str, keys: Column) -> Column:
            pairs = F.transform(keys, lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key")))
            return F.coalesce(pairs, F.array().cast("array<struct<kind:string,key:string>>"))

        pairs = F.concat(*[paired(kind, keys) for kind, keys in listed.items()])
        encounters = self.matching().select("id", F.explode(pairs).alias("pair")).select("pair.*", "id")
        bosses = self.encounter_defs.select(F.lit("defined").alias("kind"), F.explode("boss_npc_ids").alias("key"), "id")
        return encounters.unionByName(bosses).filter(F.col("key").isNotNull()).distinct()

    def text_markers(self) -> list[str]:
        """Marker words that some encounter accepts as textual victory evidence: one row of an aggregate."""
        victory = F.lower("victory_event")
        textual = ~F.coalesce(victory.rlike(fixed.BOSS_DEFEAT_TEXT), F.lit(False))
        uses = [F.bool_or(textual & F.contains(victory, F.lit(m))).alias(m) for m in fixed.VICTORY_MARKERS]
        row = self.encounters.agg(*uses).first()
        return [m for m in fixed.VICTORY_MARKERS if row[m]]

    def encounter_index(self) -> list[dict]:
        """Matching data of every encounter for the live fold, size-checked before it reaches the driver."""
        rows = self.matching().limit(MAX_INDEX_ROWS + 1).collect()
        if len(rows) > MAX_INDEX_ROWS:
            raise ValueError(f"encounter catalogue exceeds {MAX_INDEX_ROWS} rows")
        return sorted((r.asDict() for r in rows), key=lambda r: r["catalog_order"])

    def definition_index(self) -> list[dict]:
        """Executable definitions by id, size-checked like the encounters."""
        rows = self.encounter_defs.limit(MAX_INDEX_ROWS + 1).collect()
        if len(rows) > MAX_INDEX_ROWS:
            raise ValueError(f"definition catalogue exceeds {MAX_INDEX_ROWS} rows")
        return [{**json.loads(r["definition_json"]), "id": r["id"], "bossNpcIds": r["boss_npc_ids"]} for r in sorted(rows, key=lambda r: r["id"])]


def supports_difficulty(operations: DataFrame, difficulty: str) -> DataFrame:
    """Operations that offer a difficulty."""
    return operations.filter(F.array_contains("difficulties", difficulty))


def merge_npc_records(records: DataFrame) -> DataFrame:
    """One catalogue row per NPC id from ordered importer records (``seq``).

    The first record wins, names are united in first-seen order, flags are OR-ed,
    and ``ambiguous`` marks ids whose later records disagree with the first.
    """
    kept = ["name", "role", "encounter_id", "encounter_name", "operation_name", "source"]
    names = records.groupBy("npc_id", "name").agg(F.min("seq").alias("seq"))
    united = names.groupBy("npc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "name"))).getField("name").alias("names")
    )

    def varies(column: str):
        """Whether any record differs from the others, a null counting as a value of its own."""
        return (F.min(column) != F.max(column)) | ((F.count(column) > 0) & (F.count(column) < F.count(F.lit(1))))

    merged = records.groupBy("npc_id").agg(
        F.min_by(F.struct(*kept), F.col("seq")).alias("first"),
        F.bool_or("is_kill_target").alias("is_kill_target"),
        F.bool_or("triggers_encounter").alias("triggers_encounter"),
        F.bool_or("single_instance").alias("single_instance"),
        F.coalesce(varies("role") | varies("encounter_id") | varies("operation_name"), F.lit(False)).alias("ambiguous"),
    )
    return merged.join(united, "npc_id").select(
        "npc_id", *[F.col(f"first.{c}").alias(c) for c in kept],
        "names", "is_kill_target", "triggers_encounter", "single_instance", "ambiguous",
    )


def merge_discipline_abilities(rows: DataFrame) -> DataFrame:
    """Ability to disciplines: the first row names the ability, every discipline is listed once."""
    valid = rows.filter(F.col("ability_id").rlike(r"^\d{12,}$") & F.col("discipline").isNotNull())
    listed = valid.groupBy("ability_id", "discipline").agg(
        F.min("seq").alias("seq"), F.min_by("ability", "seq").alias("ability"),
        F.min_by("discipline_id", "seq").alias("discipline_id"),
    )
    return listed.groupBy("ability_id").agg(
        F.min_by("ability", "seq").alias("ability"),
        F.min_by("discipline", "seq").alias("discipline"),
        F.array_sort(F.collect_list(F.struct("seq", "discipline"))).getField("discipline").alias("disciplines"),
        F.min_by("discipline_id", "seq").alias("discipline_id"),
    )


def read_attack_types(spark: SparkSession, path: str) -> DataFrame:
    """Attack-type CSV (``id,attack,damage,name``); the name may itself hold commas."""
    lines = spark.read.text(path)
    cells = F.split(F.col("value"), ",", 4)
    return load_attack_types(
        lines.select(
            F.monotonically_increasing_id().alias("seq"),
            cells[0].alias("ability_id"), cells[1].alias("attack_type"), cells[2].alias("damage_type"),
            F.regexp_replace(cells[3], '^"|"$', "").alias("name"),
        )
    )


def load_attack_types(rows: DataFrame) -> DataFrame:
    """Rows with a numeric id and both types; the last row of an id wins."""
    valid = rows.filter(
        F.col("ability_id").rlike(r"^\d{12,}$")
        & (F.col("attack_type") != "") & (F.col("damage_type") != "")
    )
    latest = valid.groupBy("ability_id").agg(
        F.max_by(F.struct("attack_type", "damage_type", "name"), F.col("seq")).alias("row")
    )
    return latest.select("ability_id", "row.attack_type", "row.damage_type", "row.name")


def interrupt_ids(text: DataFrame, column: str = "value") -> DataFrame:
    """Distinct tokens of twelve or more digits."""
    tokens = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"\b\d{12,}\b"), F.lit(0)))
    return text.select(tokens.alias("ability_id")).distinct()


def off_gcd_ids(document: DataFrame, column: str = "value") -> DataFrame:
    """Keys of a JSON object that look like ability ids."""
    keys = F.explode(F.json_object_keys(F.col(column)))
    return document.select(keys.alias("ability_id")).filter(F.col("ability_id").rlike(r"^\d{12,}$")).distinct()


def observed_health(events: DataFrame) -> DataFrame:
    """Largest max health per NPC class over a corpus and the name it was first seen under."""
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.col(f"{s}_npc_id").alias("npc_id"), F.col(f"{s}_name").alias("name"),
                    F.col(f"{s}_max_hp").alias("max_hp"), F.lit(i).alias("slot"),
                )
                for i, s in enumerate(("source", "target"))
            ]
        )
    ).alias("seen")
    seen = events.select("log_id", "line_number", sides).select("log_id", "line_number", "seen.*")
    seen = seen.filter(F.col("npc_id").isNotNull() & (F.col("max_hp") > 0))
    earliest = F.struct("max_hp", -F.col("log_id").cast("bigint"), -F.col("line_number"), -F.col("slot"))
    return seen.groupBy("npc_id").agg(F.max("max_hp").alias("max_hp"), F.max_by("name", earliest).alias("name"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Newest row per key as one aggregate, so a hot key is combined map-side."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


