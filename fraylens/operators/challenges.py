"""Challenges of encounter definitions: ten metrics under scopes, by filters, interval tables and aggregates.

A challenge counts an amount while all its conditions hold. Conditions on an event
itself (its actors, ability, effect) are array predicates on the event. Conditions on
the state of the pull (phase, counter, boss health) hold from one line to another:
every change of such a state is a row, a flip of a condition is a step of +1 or -1,
and the challenge is in scope where the running sum of its steps reaches the number
of its conditions. Scopes meet events by equality on (pull, challenge, line bin), and
their union of intervals is the active time.

Definitions stay a table: they are read with ``from_json`` and met by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.operators import scan
from fraylens.operators.segment import PULL
from fraylens.operators.staging import staged

#: Lines of a bin in which scopes and events meet.
BIN_LINES = 4096
_BLOCK_LINES = 4096
KEY = [*PULL, "challenge_id"]

_DEFINITION = (
    "struct<entityNpcIds:map<string,array<string>>,challenges:array<struct<id:string,name:string,metric:string,enabled:boolean,"
    "difficulties:array<string>,conditions:array<map<string,string>>>>>"
)
#: Metrics that an event of a kind can feed.
METRICS = {
    "damage": ["damage", "damage_taken", "damage_absorbed"],
    "heal": ["healing", "effective_healing", "healing_taken"],
    "activate": ["ability_count"],
    "interrupt": ["interrupt_count"],
    "applyEffect": ["effect_count", "effect_stacks"],
    "modifyCharges": ["effect_stacks"],
    "removeEffect": ["effect_stacks"],
}
_PLAYERS = ["any_player", "any_player_or_companion"]
_OTHERS = ["other_players", "other_player"]


def _list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def challenge_table(encounter_defs: DataFrame) -> DataFrame:
    """One row an enabled challenge: its conditions, which of them are scopes, and whether it tracks a player target."""
    read = encounter_defs.select(
        F.col("id").alias("definition_id"), "boss_npc_ids", F.from_json("definition_json", _DEFINITION).alias("d")
    ).select("definition_id", "boss_npc_ids", F.col("d.entityNpcIds").alias("entities"), F.explode("d.challenges").alias("c"))
    conditions = F.coalesce("c.conditions", F.array().cast("array<map<string,string>>"))
    of = lambda *kinds: F.filter(conditions, lambda c: F.coalesce(c["type"], F.lit("")).isin(*kinds))
    tracked = [*_PLAYERS, "local_player", *_OTHERS]
    return read.where("c.enabled").select(
        "definition_id", "boss_npc_ids", "entities", F.col("c.id").alias("challenge_id"), F.col("c.name").alias("name"), "c.metric",
        F.coalesce("c.difficulties", F.array().cast("array<string>")).alias("difficulties"),
        F.filter(conditions, lambda c: ~F.coalesce(c["type"], F.lit("")).isin("phase", "counter", "boss_hp_range")).alias("static"),
        of("phase", "counter", "boss_hp_range").alias("scopes"),
        F.size(of("phase")).alias("n_phase"), F.size(of("counter", "boss_hp_range")).alias("n_timed"),
        F.exists(of("target"), lambda c: F.coalesce(c["match"].isin(*tracked), F.lit(False))).alias("tracks_target"),
    )


def bound_challenges(pulls: DataFrame, bindings: DataFrame, tagged: DataFrame, encounter_defs: DataFrame) -> DataFrame:
    """Challenges of the definition that a pull ends with; they start anew after ``from_line``, where it took over."""
    order = Window.partitionBy(*PULL).orderBy("at_line")
    changes = bindings.withColumn("before", F.lag("definition_id").over(order)).where("before IS NULL OR before <> definition_id")
    taken = F.when(F.col("before").isNull(), F.lit(-1)).otherwise(F.col("at_line")).cast("bigint")
    last = changes.groupBy(*PULL).agg(F.max_by(F.struct("definition_id", taken.alias("from_line")), "at_line").alias("b")).select(*PULL, "b.*")
    seen = tagged.select(*PULL, "line_number", "ts_ms").join(last, PULL).where("line_number > from_line")
    starts = seen.groupBy(*PULL).agg(F.min_by("ts_ms", "line_number").alias("began_at"))  # states count from the first event they are looked at
    bound = pulls.select(*PULL, "started_at", "ended_at", "ctx_difficulty", "local_player_id").join(last, PULL).join(starts, PULL, "left")
    suits = (F.size("difficulties") == 0) | F.coalesce(F.array_contains("difficulties", F.col("ctx_difficulty")), F.lit(False))
    found = bound.join(challenge_table(encounter_defs), "definition_id").where(suits)
    return found.drop("difficulties", "ctx_difficulty")


def compared(left: Column, how: Column, right: Column) -> Column:
    tests = {"eq": left == right, "ne": left != right, "lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}
    return F.coalesce(F.create_map(*[x for name, test in tests.items() for x in (F.lit(name), test)])[F.coalesce(how, F.lit("eq"))], F.lit(False))


def _flips(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows at which ``holds`` changes along the lines; it does not hold before the first one."""
    seen = scan.running(rows, keys, ["line_number"], scan.line_block(_BLOCK_LINES), {"before": scan.last(F.col("holds"), inclusive=False)})
    return seen.where(F.col("holds") != F.coalesce("before", F.lit(False))).drop("before")


def _condition_flips(bound: DataFrame, levels: DataFrame, tagged: DataFrame) -> DataFrame:
    """(pull, challenge, ordinal, timed, line_number, ts_ms, holds) at every flip of a scope condition."""
    each = bound.select(*KEY, "boss_npc_ids", F.posexplode("scopes").alias("ordinal", "c"))
    key = [*KEY, "ordinal"]
    none = F.lit(0).cast("bigint")

    wanted = each.where(F.col("c")["type"].isin("phase", "counter")).select(*key, "c", (F.col("c")["type"] == "counter").alias("timed"), F.coalesce(F.col("c")["counter_id"], F.lit("")).alias("level"))
    first = wanted.select(*key, "c", "timed", none.alias("line_number"), F.lit(None).cast("bigint").alias("ts_ms"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("phase_id"), F.lit(-1).alias("at"))
    met = wanted.join(levels, [*PULL, "level"]).select(*key, "c", "timed", "line_number", "ts_ms", "value", "phase_id", "at")
    stepped = first.unionByName(met).groupBy(*key, "timed", "line_number").agg(F.max_by(F.struct("c", "ts_ms", "value", "phase_id"), "at").alias("s"))
    in_phase = F.coalesce(F.array_contains(_list(F.col("s.c")["phase_ids"]), F.col("s.phase_id")), F.lit(False))
    counted = compared(F.col("s.value"), F.col("s.c")["operator"], F.col("s.c")["value"].cast("double"))
    stepped = stepped.select(*key, "timed", "line_number", "s.ts_ms", F.when(F.col("timed"), counted).otherwise(in_phase).alias("holds"))

    ranges = each.where(F.col("c")["type"] == "boss_hp_range")
    named = F.col("c")["npc_id"]
    ranges = ranges.select(*key, "c", F.explode(F.array_distinct(F.when(named.isNotNull(), F.array(named)).otherwise(F.col("boss_npc_ids")))).alias("npc_id"))
    full = lambda s: F.when(F.col(f"{s}_kind").eqNullSafe("npc") & F.col(f"{s}_hp").isNotNull() & (F.col(f"{s}_max_hp") > 0), F.struct(
        F.col(f"{s}_npc_id").alias("npc_id"), (F.col(f"{s}_hp") / F.col(f"{s}_max_hp") * 100).alias("percent")))
    # of two actors of one class the target is seen last
    shown = F.when(F.col("source_npc_id").eqNullSafe(F.col("target_npc_id")) & full("target").isNotNull(), F.array(full("target"))).otherwise(F.array(full("source"), full("target")))
    health = tagged.select(*PULL, "line_number", "ts_ms", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("h")).select(*PULL, "line_number", "ts_ms", "h.*")
    low, high = F.col("c")["min_hp"].cast("double"), F.col("c")["max_hp"].cast("double")
    inside = (low.isNull() | (F.col("percent") >= low)) & (high.isNull() | (F.col("percent") <= high))
    per_npc = _flips(ranges.join(health, [*PULL, "npc_id"]).select(*key, "npc_id", "line_number", "ts_ms", inside.alias("holds")), [*key, "npc_id"])
    moved = per_npc.groupBy(*key, "line_number").agg(F.max("ts_ms").alias("ts_ms"), F.sum(F.when(F.col("holds"), 1).otherwise(-1)).alias("step"))
    any_npc = scan.running(moved, key, ["line_number"], scan.line_block(_BLOCK_LINES), {"n": scan.total(F.col("step"))})
    in_range = any_npc.select(*key, F.lit(True).alias("timed"), "line_number", "ts_ms", (F.col("n") > 0).alias("holds"))
    return _flips(stepped.unionByName(in_range), [*key, "timed"])


def scopes(bound: DataFrame, levels: DataFrame, tagged: DataFrame) -> DataFrame:
    """Line intervals [line_number, until) with the states ``all_hold`` and ``timed_hold`` and the times at both ends.

    ``levels`` is (pull, level, line_number, ts_ms, value, phase_id, at): counters
    by name and the phase under the empty name, as they stand after a line.
    """
    flips = _condition_flips(bound, levels, tagged)
    step = F.when(F.col("holds"), 1).otherwise(-1)
    moved = flips.groupBy(*KEY, "line_number").agg(
        F.max("ts_ms").alias("ts_ms"), F.sum(step).alias("all_step"), F.sum(F.when(F.col("timed"), step).otherwise(0)).alias("timed_step")
    )
    order = (KEY, ["line_number"], scan.line_block(_BLOCK_LINES))
    summed = scan.running(moved, *order, {"n_all": scan.total(F.col("all_step")), "n_held": scan.total(F.col("timed_step"))})
    following = F.struct("line_number", "ts_ms")
    linked = scan.running(summed, *order, {"next": scan.last(following, inclusive=False)}, descending=True)
    held = linked.join(bound.select(*KEY, "n_phase", "n_timed", "from_line", "began_at", "ended_at"), KEY)
    own = F.col("line_number") > F.col("from_line")  # what was so when the definition took over counts from its first event
    return held.select(
        *KEY, F.greatest("line_number", F.col("from_line") + 1).alias("line_number"), F.col("next.line_number").alias("until"),
        F.when(own & (F.col("line_number") > 0), F.col("ts_ms")).otherwise(F.col("began_at")).alias("from_ms"),
        F.coalesce("next.ts_ms", "ended_at").alias("to_ms"),
        (F.col("n_all") == F.col("n_phase") + F.col("n_timed")).alias("all_hold"), (F.col("n_held") == F.col("n_timed")).alias("timed_hold"),
    ).where(F.col("until").isNull() | (F.col("until") > F.col("line_number")))


def _actor_fits(match: Column, side: str) -> Column:
    kind, id_, npc, local = (F.col(c) for c in (f"{side}_kind", f"{side}_id", f"{side}_npc_id", "local_player_id"))
    player, boss = kind == "player", F.coalesce(F.array_contains("boss_npc_ids", npc), F.lit(False))
    chosen = _list(F.get_json_object(match, "$.selector"))
    named = lambda s: (npc == s) | (F.lower(F.col(f"{side}_name")) == F.lower(s)) | F.coalesce(F.array_contains(F.element_at("entities", s), npc), F.lit(False))
    test = (
        F.when(match.isin(*_PLAYERS), player)
        .when(match == "local_player", player & (id_ == local))
        .when(match.isin(*_OTHERS), player & ~id_.eqNullSafe(local))
        .when(match == "any_except_local", ~id_.eqNullSafe(local))
        .when(match.isin("boss", "any_boss"), (kind == "npc") & boss)
        .when(match == "any_add", (kind == "npc") & ~boss)
        .when(match.isin("npc", "any_npc"), kind == "npc")
        .when(match == "current_target", id_.eqNullSafe(F.col("aim")))
        .when(match.startswith("{"), (kind == "npc") & F.coalesce(F.exists(chosen, named), F.lit(False)))
        .otherwise(F.lit(True))
    )
    return match.isNull() | (match == "any") | (kind.isNotNull() & F.coalesce(test, F.lit(False)))


def _event_fits(c: Column) -> Column:
    listed = lambda ids, id_: F.coalesce(F.array_contains(_list(c[ids]), F.col(id_)), F.lit(False))
    return (
        F.when(c["type"] == "source", _actor_fits(c["match"], "source"))
        .when(c["type"] == "target", _actor_fits(c["match"], "target"))
        .when(c["type"] == "ability", listed("ability_ids", "ability_id"))
        .when(c["type"] == "effect", listed("effect_ids", "effect_id"))
        .otherwise(F.lit(False))
    )


def with_aims(tagged: DataFrame, pulls: DataFrame) -> DataFrame:
    """Events with ``aim``: whom the local player has targeted, as of this line."""
    known = tagged.join(pulls.select(*PULL, "local_player_id"), PULL)
    own = (F.col("type") == "target") & F.col("source_id").eqNullSafe(F.col("local_player_id"))
    aimed = F.when(own & ((F.col("state") == "cleared") | F.col("target_id").isNotNull()), F.struct(F.when(F.col("state") == "set", F.col("target_id")).alias("id")))
    seen = scan.running(known, PULL, ["line_number"], scan.line_block(_BLOCK_LINES), {"__aim": scan.last(aimed)})
    return seen.withColumn("aim", F.col("__aim.id")).drop("__aim")


def observed(aimed: DataFrame, bound: DataFrame, intervals: DataFrame, reach: DataFrame) -> DataFrame:
    """Events that a challenge counts: player, name, amount, and for stacks whether the effect went; ``reach`` holds the last line of a pull."""
    kind = F.when(F.col("type") == "ability", F.col("phase")).otherwise(F.col("type"))
    feeds = F.create_map(*[x for k, v in METRICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    columns = [
        *PULL, "line_number", "type", "source_kind", "source_id", "source_name", "source_npc_id", "target_kind", "target_id", "target_name", "target_npc_id",
        "ability_id", "effect_id", "amount", "effective", "absorbed", "charges", "aim",
    ]
    rows = aimed.select(*columns, F.explode(feeds[kind]).alias("metric"))
    met = rows.join(bound, [*PULL, "metric"]).where((F.col("line_number") > F.col("from_line")) & F.forall("static", _event_fits))
    # taken is from the target, the rest from the source, unless the challenge tracks a player that is aimed at
    counts = F.col("metric").isin("ability_count", "effect_count", "effect_stacks")
    side = F.when(F.col("metric").isin("damage_taken", "healing_taken") | (counts & F.col("tracks_target")), F.lit("target")).otherwise(F.lit("source"))
    player = lambda c: F.when(side == "target", F.when(F.col("target_kind") == "player", F.col(f"target_{c}"))).otherwise(F.when(F.col("source_kind") == "player", F.col(f"source_{c}")))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    amount = (
        F.when(F.col("metric").isin("damage", "damage_taken", "healing"), zero("amount"))
        .when(F.col("metric") == "damage_absorbed", zero("absorbed"))
        .when(F.col("metric").isin("effective_healing", "healing_taken"), F.coalesce(F.col("effective").cast("double"), zero("amount")))
        .when(F.col("metric") != "effect_stacks", F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.when(F.col("type") == "applyEffect", F.coalesce(F.col("charges").cast("double"), F.lit(1.0))).otherwise(zero("charges"))))
    )
    found = met.select(*KEY, "metric", "line_number", player("id").alias("player_id"), player("name").alias("player_name"), amount.alias("amount"), (F.col("type") == "removeEffect").alias("gone"), (F.size("scopes") > 0).alias("scoped"))
    found = found.where("player_id IS NOT NULL AND (amount <> 0 OR metric = 'effect_stacks')")
    last = F.coalesce(F.col("until") - 1, F.col("line_number") + 10**9)
    bin_ = lambda c: F.floor(c / BIN_LINES).cast("bigint")
    open_ = intervals.where("all_hold").join(reach, PULL).withColumn("__last", F.least(last, "__end")).where("__last >= line_number")
    open_ = open_.select(*KEY, F.col("line_number").alias("__from"), "__last", F.explode(F.sequence(bin_(F.col("line_number")), bin_(F.col("__last")))).alias("__bin"))
    inside = found.where("scoped").withColumn("__bin", bin_(F.col("line_number"))).join(open_, [*KEY, "__bin"]).where("line_number BETWEEN __from AND __last")
    return found.where("NOT scoped").unionByName(inside.select(*found.columns))


def challenge_players(rows: DataFrame) -> DataFrame:
    """(challenge, player): name, value and event_count; a stack counts once, by its height, when it goes or at the end."""
    first = F.min_by("player_name", "line_number").alias("player_name")
    plain = rows.where("metric <> 'effect_stacks'").groupBy(*KEY, "player_id").agg(first, F.sum("amount").alias("value"), F.count("*").alias("event_count"))
    keys = [*KEY, "player_id"]
    stacked = rows.where("metric = 'effect_stacks'")
    cut = scan.running(stacked, keys, ["line_number"], scan.line_block(_BLOCK_LINES), {"stack": scan.total(F.col("gone").cast("bigint"), inclusive=False)})
    height = F.max(F.when(~F.col("gone"), F.col("amount")))
    stacks = cut.groupBy(*keys, F.coalesce("stack", F.lit(0)).alias("stack")).agg(first, F.min("line_number").alias("line_number"), height.alias("height"), F.bool_or("gone").alias("gone"))
    counted = F.col("height").isNotNull() & ((F.col("height") > 0) | ~F.col("gone"))
    grown = stacks.groupBy(*keys).agg(first, F.sum(F.coalesce("height", F.lit(0.0))).alias("value"), F.sum(counted.cast("bigint")).alias("event_count"))
    return plain.unionByName(grown)


def active_times(bound: DataFrame, intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """duration_ms of every challenge: of its phases, else of its timed scope, else of the pull."""
    wanted = bound.where("n_phase > 0").select(*KEY, F.explode(F.array_distinct(F.flatten(F.transform(F.filter("scopes", lambda c: c["type"] == "phase"), lambda c: _list(c["phase_ids"]))))).alias("phase_id"))
    length = lambda a, b: F.greatest(F.lit(0).cast("bigint"), F.col(b) - F.col(a))
    phased = wanted.join(segments.select(*PULL, "phase_id", "started_at", "ended_at"), [*PULL, "phase_id"]).groupBy(*KEY).agg(F.sum(length("started_at", "ended_at")).alias("phased"))
    # one stretch a run of intervals in which the timed conditions hold
    held = intervals.withColumn("holds", F.col("timed_hold"))
    edge = scan.running(held, KEY, ["line_number"], scan.line_block(_BLOCK_LINES), {"before": scan.last(F.col("holds"), inclusive=False)})
    edge = edge.where("holds").withColumn("starts", (~F.coalesce("before", F.lit(False))).cast("bigint"))
    runs = scan.running(edge, KEY, ["line_number"], scan.line_block(_BLOCK_LINES), {"run": scan.total(F.col("starts"))})
    stretches = runs.groupBy(*KEY, "run").agg(F.min_by("from_ms", "line_number").alias("from_ms"), F.max_by("to_ms", "line_number").alias("to_ms"))
    timed = stretches.groupBy(*KEY).agg(F.sum(length("from_ms", "to_ms")).alias("timed"))
    joined = bound.join(phased, KEY, "left").join(timed, KEY, "left")
    none = F.lit(0).cast("bigint")
    duration = F.when(F.col("n_phase") > 0, F.coalesce("phased", none)).when(F.col("n_timed") > 0, F.coalesce("timed", none)).otherwise(length("started_at", "ended_at"))
    return joined.select(*KEY, "name", "metric", duration.alias("duration_ms"))


class Challenges:
    """``totals`` and ``players`` of the challenges of every pull."""

    def __init__(self, tagged: DataFrame, pulls: DataFrame, bindings: DataFrame, records: DataFrame, segments: DataFrame, encounter_defs: DataFrame):
        bound = staged(bound_challenges(pulls, bindings, tagged, encounter_defs))
        levels = records.where("record IN ('level', 'stage')").select(
            *PULL, F.when(F.col("record") == "level", F.col("id")).otherwise(F.lit("")).alias("level"), "line_number", F.col("started_at").alias("ts_ms"),
            F.coalesce("value", F.lit(0.0)).alias("value"), F.col("detail").alias("phase_id"), F.col("ordinal").cast("int").alias("at"),
        )
        intervals = staged(scopes(bound, levels, tagged))
        self.times = active_times(bound, intervals, segments)
        reach = tagged.groupBy(*PULL).agg(F.max("line_number").alias("__end"))
        concerned = tagged.join(bound.select(*PULL).distinct(), PULL, "left_semi")
        self.rows = staged(challenge_players(observed(with_aims(concerned, pulls), bound, intervals, reach)))

    @property
    def totals(self) -> DataFrame:
        sums = self.rows.groupBy(*KEY).agg(F.sum("value").alias("value"), F.sum("event_count").alias("event_count"))
        found = self.times.join(sums, KEY, "left").na.fill(0, ["value", "event_count"])
        return found.withColumn("per_second", F.when(F.col("duration_ms") > 0, F.col("value") / (F.col("duration_ms") / 1000)))

    @property
    def players(self) -> DataFrame:
        totals = self.totals.select(*KEY, "duration_ms", F.col("value").alias("total"))
        found = self.rows.join(totals, KEY)
        return found.select(
            *KEY, "player_id", "player_name", "value",
            F.when(F.col("total") > 0, F.col("value") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("percent"),
            F.when(F.col("duration_ms") > 0, F.col("value") / (F.col("duration_ms") / 1000)).alias("per_second"),
        )
