"""Cutting every log into pulls (fight attempts).

``gap_sessions`` is the plain silence rule.  ``segment_pulls`` is the full rule,
in which the silence that ends a pull depends on combat exits and on whether the
encounter is already beaten.  That part needs a fold; to keep it small at any
log size, runs of events in which only the clock can move are first collapsed
to one row by ordinary aggregation, and silences that end every pull split a
log into chunks folded apart from each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import combat
from fraylens.operators import scan
from fraylens.operators.pullfold import EncounterMatcher, PullFold, Step
from fraylens.operators.staging import staged
from fraylens.options import Options
from fraylens.sources.catalog import Catalog

PULL = ["log_id", "pull_id"]

#: Lines per bin of the interval join that tags events with their pull.
TAG_BIN_LINES = 4_096


def gap_sessions(events: DataFrame, options: Options) -> DataFrame:
    """One row per gap-only session.

    One scan finds the rows that start a session; end, last line and count of a
    session are running values of the row that starts the next one, since a start
    is later than everything before it.
    """
    prior = {
        "prior": scan.highest(F.col("ts_ms"), inclusive=False),
        "prior_line": scan.last(F.col("line_number"), inclusive=False),
        "prior_count": scan.total(F.lit(1).cast("bigint"), inclusive=False),
    }
    order = (["log_id"], ["line_number"], scan.line_block(options.block_lines))
    scanned = scan.running(events.select("log_id", "line_number", "ts_ms"), *order, prior)
    begins = F.col("prior").isNull() | (F.col("ts_ms") - F.col("prior") >= options.idle_ms)
    starts = staged(scanned.filter(begins))
    numbered = scan.running(starts, *order, {"pull_index": scan.total(F.lit(1).cast("bigint"))})
    tail = F.struct(F.col("prior").alias("ts"), F.col("prior_line").alias("line"), F.col("prior_count").alias("count"))
    linked = scan.running(numbered, *order, {"next": scan.last(tail, inclusive=False)}, descending=True)
    whole = F.struct(F.max("ts_ms").alias("ts"), F.max("line_number").alias("line"), F.count(F.lit(1)).alias("count"))
    logs = events.groupBy("log_id").agg(whole.alias("__whole"))
    end = F.coalesce("next", "__whole")
    return linked.join(logs, "log_id").select(
        "log_id", F.concat_ws("-", "ts_ms", "pull_index").alias("pull_id"), "pull_index", F.col("ts_ms").alias("started_at"),
        end["ts"].alias("ended_at"), F.col("line_number").alias("start_line"), end["line"].alias("last_line"),
        (end["count"] - F.col("prior_count")).alias("event_count"), (end["ts"] - F.col("ts_ms")).alias("duration_ms"),
    )


def session_context(events: DataFrame, options: Options) -> DataFrame:
    """Zone, difficulty, group size, server and local player in force at every event.

    The last area entry replaces zone, difficulty and group size even with nulls;
    a missing server keeps the previous one; the local player is the first player
    seen as the source of an area entry or combat state.
    """
    inputs = events.select("*", *[value.alias(name) for name, value in _context_inputs().items()])
    scanned = scan.running(inputs, ["log_id"], ["line_number"], scan.line_block(options.block_lines), _context_specs())
    return scanned.select(*events.columns, *_context_columns())


def _context_inputs() -> dict[str, Column]:
    """What an event says about the context, null where it says nothing."""
    area = F.col("type") == "areaEntered"
    declares = combat.is_type("areaEntered", "combatState") & combat.player("source")
    return {
        "zone_in": F.when(area, F.struct("zone_id", "zone_name", "difficulty", "group_size")),
        "server_in": F.when(area, F.col("server_id")),
        "local_in": F.when(declares, F.col("source_id")),
    }


def _context_specs() -> dict[str, scan.Running]:
    return {
        "__zone": scan.last(F.col("zone_in")), "__server": scan.last(F.col("server_in")), "__local": scan.first(F.col("local_in")),
    }


def _context_columns() -> list[Column]:
    zone = F.col("__zone")
    parts = [zone["zone_id"], zone["zone_name"], zone["difficulty"], zone["group_size"], F.col("__server"), F.col("__local")]
    return [part.alias(name) for part, name in zip(parts, CONTEXT)]


CONTEXT = ["ctx_zone_id", "ctx_zone_name", "ctx_difficulty", "ctx_group_size", "ctx_server_id", "local_player_id"]


def _known_targets(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """(NPC ids with their catalogue name and whether they concern an encounter, names that do)."""
    keys = catalog.matching_keys()
    names = keys.filter(F.col("kind").isin("name", "victim")).select(F.col("key").alias("__name")).distinct()
    ids = keys.filter(F.col("kind").isin("npc", "defined")).select(F.col("key").alias("target_npc_id")).distinct()
    listed = catalog.npc_catalog.select(F.col("npc_id").alias("target_npc_id"), F.col("name").alias("__catalog_name"))
    both = listed.join(ids.withColumn("__by_id", F.lit(True)), "target_npc_id", "full_outer")
    named = both.join(names.withColumn("__by_name", F.lit(True)), combat.normalise(F.col("__catalog_name")) == F.col("__name"), "left")
    known = F.coalesce("__by_id", "__by_name", F.lit(False)).alias("__known_id")
    return named.select("target_npc_id", "__catalog_name", known), names


def _flags(events: DataFrame, catalog: Catalog, victory_hits: DataFrame | None) -> DataFrame:
    """Narrow events with everything the segmentation rule looks at."""
    npcs, names = _known_targets(catalog)
    raw = combat.normalise(F.col("target_name"))
    named = events.filter(F.col("type") != "disciplineChanged").join(npcs, "target_npc_id", "left")
    named = named.join(names, raw == F.col("__name"), "left")
    canonical = combat.normalise(F.coalesce("__catalog_name", "target_name"))
    known = F.coalesce("__known_id", F.lit(False)) | F.col("__name").isNotNull()
    text = F.lower(F.concat_ws(" ", *combat.spoken()))
    markers = catalog.text_markers()
    marked = text.rlike("|".join(markers)) if markers else F.lit(False)
    flags = named.select(
        "log_id", "line_number", "ts_ms",
        combat.is_clock().alias("is_clock"),
        combat.is_activity().alias("is_activity"),
        combat.is_state("enter").alias("is_enter"),
        combat.is_state("exit").alias("is_exit"),
        (F.col("type") == "areaEntered").alias("is_area"),
        F.when(
            combat.raid_damage() & known, F.struct(F.col("target_npc_id").alias("npc_id"), canonical.alias("name"))
        ).alias("engaged"),
        F.when(
            (F.col("type") == "death") & combat.npc("target") & known,
            F.struct(
                F.col("target_npc_id").alias("npc_id"), F.col("target_name").alias("raw"),
                F.coalesce("__catalog_name", "target_name").alias("name"),
            ),
        ).alias("died"),
        F.when(marked, text).alias("text"),
        F.coalesce(combat.raid_damage() & (combat.applied() > 0), F.lit(False)).alias("hit"),
        *[value.alias(name) for name, value in _context_inputs().items()],
    )
    if victory_hits is None:
        return flags.withColumn("victory_of", F.lit(None).cast("array<string>"))
    return flags.join(victory_hits, ["log_id", "line_number"], "left")


def decision_steps(flags: DataFrame, options: Options) -> DataFrame:
    """Flagged events collapsed to the steps the fold has to see, keyed by (log, chunk).

    Within a stretch of non-decreasing times whose clock never rests as long as
    the shortest threshold, no pull can expire.  Once such a stretch has run for
    longer than any threshold plus the reopen guard, the events between two
    special ones matter only through their first activity, last clock time and
    engaged bosses, so they become one row.  A chunk starts where an event comes
    later than any silence after everything before it, and no later event steps
    back into the reopen guard; every pull is closed there.
    """
    block = scan.line_block(options.block_lines)
    order = (["log_id"], ["line_number"], block)
    ts = F.col("ts_ms")
    ticking = F.col("is_clock") | F.col("is_enter")
    timed = ~(F.col("is_exit") | F.col("is_area"))
    first = scan.running(
        flags, *order,
        {
            "prev_ts": scan.last(F.when(timed, ts), inclusive=False),
            "prev_clock": scan.last(F.when(F.col("is_clock"), ts), inclusive=False),
            "peak": scan.highest(F.when(ticking, ts), inclusive=False),
            "after_area": scan.last(F.col("is_area"), inclusive=False),
            **_context_specs(),
        },
    )
    # Every scan reads its input twice, so the narrow result of the first is written before the next two.
    kept = [c for c in first.columns if c not in ("zone_in", "server_in", "local_in", "__zone", "__server", "__local")]
    first = staged(first.select(*kept, *_context_columns()), packed=True)
    first = scan.running(first, *order, {"floor": scan.lowest(F.when(ticking, ts))}, descending=True)
    silent = (ts - F.col("peak") >= options.longest_silence_ms) & (
        F.col("floor") - F.col("peak") >= options.reopen_guard_ms
    )
    breaks_chunk = ticking & (F.col("peak").isNull() | silent)
    breaks_stretch = timed & (
        F.col("prev_ts").isNull()
        | F.coalesce("after_area", F.lit(False))
        | (ts < F.col("prev_ts"))
        | F.col("prev_clock").isNull()
        | (ts - F.col("prev_clock") >= options.shortest_silence_ms)
    )
    special = ~timed | F.col("is_enter") | F.col("died").isNotNull() | F.col("text").isNotNull()
    special = special | F.col("victory_of").isNotNull()
    marked = first.withColumn("special", special)
    second = scan.running(
        marked, *order,
        {
            "chunk": scan.last(F.when(breaks_chunk, F.col("line_number"))),
            "stretch": scan.last(
                F.when(
                    breaks_stretch,
                    F.struct(F.col("line_number").alias("line"), F.greatest(F.col("peak"), ts).alias("base")),
                )
            ),
            "specials": scan.total(F.col("special").cast("bigint")),
        },
    )
    settle_ms = options.longest_silence_ms + options.reopen_guard_ms
    single = F.col("special") | F.col("stretch").isNull() | (ts < F.col("stretch.base") + settle_ms)
    line = F.col("line_number")
    keyed = second.select(
        "*",
        F.coalesce("chunk", F.lit(0)).alias("chunk_line"),
        F.when(single, line).otherwise(F.col("stretch.line")).alias("unit"),
        F.when(single, F.lit(-1)).otherwise(F.col("specials")).alias("unit_part"),
    )
    return keyed.groupBy("log_id", "chunk_line", "unit", "unit_part").agg(
        F.min("line_number").alias("line"),
        F.min_by("ts_ms", "line_number").alias("ts"),
        F.bool_or("is_area").alias("area"),
        F.bool_or("is_enter").alias("enter"),
        F.bool_or("is_exit").alias("exit"),
        F.min_by(F.struct("line_number", "ts_ms"), F.when(F.col("is_activity"), line)).alias("act"),
        F.max_by("ts_ms", F.when(F.col("is_clock"), line)).alias("clock_ts"),
        F.collect_set("engaged").alias("engaged"),
        F.max("died").alias("died"),
        F.max("text").alias("text"),
        F.max("victory_of").alias("victory_of"),
        F.bool_or("hit").alias("hit"),
        *[F.max_by(c, "line_number").alias(c) for c in CONTEXT],
    )


#: Line of the row that brings a chunk its candidates; it sorts before every step.
CANDIDATES_LINE = -1


def _candidates(steps: DataFrame, catalog: Catalog) -> DataFrame:
    """One row a chunk: the encounters and definitions that its engaged bosses lead to, as JSON.

    An encounter that no engaged name or id leads to has no score, so the others
    decide a match alone. What a chunk gets grows with the bosses it meets, not
    with the catalogue.
    """
    pair = F.explode("engaged").alias("pair")
    engaged = steps.select("log_id", "chunk_line", pair).distinct()
    sides = F.explode(F.array(
        F.struct(F.lit("name").alias("kind"), F.col("pair.name").alias("key")),
        F.struct(F.lit("npc").alias("kind"), F.col("pair.npc_id").alias("key")),
        F.struct(F.lit("defined").alias("kind"), F.col("pair.npc_id").alias("key")),
    )).alias("side")
    touched = engaged.select("log_id", "chunk_line", sides).select("log_id", "chunk_line", "side.*").distinct()
    met = touched.join(catalog.matching_keys(), ["kind", "key"])
    met = met.select("log_id", "chunk_line", (F.col("kind") == "defined").alias("defined"), "id").distinct()

    def written(*columns: str):
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row")

    encounters = catalog.matching()
    encounters = encounters.select(F.lit(False).alias("defined"), "id", F.col("catalog_order").alias("place"), written(*encounters.columns))
    definitions = catalog.encounter_defs.withColumn("bossNpcIds", F.col("boss_npc_ids"))
    definitions = definitions.select(F.lit(True).alias("defined"), "id", F.lit(0).alias("place"), written("id", "bossNpcIds"))
    rows = met.join(encounters.unionByName(definitions), ["defined", "id"])

    def ordered(which):
        return F.array_sort(F.collect_list(F.when(which, F.struct("place", "id", "row")))).getField("row")

    packed = rows.groupBy("log_id", "chunk_line").agg(ordered(~F.col("defined")).alias("encounters"), ordered(F.col("defined")).alias("definitions"))
    return packed.select("log_id", "chunk_line", F.lit(CANDIDATES_LINE).cast("bigint").alias("line"), F.to_json(F.struct("encounters", "definitions")).alias("candidates"))


def _matcher(candidates: str) -> EncounterMatcher:
    found = json.loads(candidates)
    return EncounterMatcher(*[[json.loads(row) for row in found[part]] for part in ("encounters", "definitions")])


_FOLD_SCHEMA = (
    "log_id {log_type}, chunk_line bigint, entry_bit int, start_line bigint, started_at bigint, ended_at bigint, "
    "close_line bigint, end_reason string, hit boolean, ctx_zone_id string, ctx_zone_name string, "
    "ctx_difficulty string, ctx_group_size int, ctx_server_id string, local_player_id string, final_0 int, final_1 int"
)


def _none(value):
    return None if value is None or value is pd.NaT or value != value else value


def _step(row) -> Step:
    context = tuple(_none(getattr(row, c)) for c in CONTEXT)
    died = row.died
    return Step(
        line=row.line,
        ts=row.ts,
        area=row.area,
        enter=row.enter,
        exit=row.exit,
        run=row.unit_part >= 0,
        activity=None if row.act is None else (row.act["line_number"], row.act["ts_ms"]),
        clock_ts=None if _none(row.clock_ts) is None else int(row.clock_ts),
        engaged=[(e["npc_id"], e["name"]) for e in row.engaged],
        died=None if died is None else (died["npc_id"], died["raw"], died["name"]),
        text=_none(row.text),
        victory_of=[] if row.victory_of is None else list(row.victory_of),
        hit=row.hit,
        context=context,
        zone=(context[0], context[1]),
    )


class _ChunkFold:
    """Folds one chunk, under both values of the exit flag it may inherit when that matters."""

    def __init__(self, matcher: EncounterMatcher, options: Options):
        self._folds = {0: PullFold(matcher, options, False), 1: PullFold(matcher, options, True)}
        self._undecided = True
        self.rows: list[tuple] = []

    def _emit(self, bit: int, closed) -> None:
        if closed is not None:
            tag = bit if len(self._folds) == 2 else -1
            self.rows.append((tag, closed))

    def push(self, step: Step) -> None:
        if self._undecided and len(self._folds) == 2:
            if step.enter:
                self._undecided = False
            elif step.area or step.exit or step.activity is not None:
                del self._folds[1]
        for bit, fold in self._folds.items():
            self._emit(bit, fold.push(step))

    def finish(self) -> tuple[int, int]:
        for bit, fold in self._folds.items():
            was_open = fold.open is not None
            self._emit(bit, fold.end(None))
            if was_open:
                fold.exit_pending = False
        bits = [int(f.exit_pending) for f in self._folds.values()]
        if len(bits) == 2:
            return bits[0], bits[1]
        return bits[0], bits[0]


def _fold_partitions(options: Options):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, out = None, None, []

        def flush() -> None:
            final_0, final_1 = chunk.finish()
            for bit, c in chunk.rows:
                out.append((*key, bit, c.start_line, c.started_at, c.ended_at, c.close_line, c.reason, c.hit, *c.context, None, None))
            out.append((*key, -1, None, None, None, None, None, None, *[None] * len(CONTEXT), final_0, final_1))

        def frame() -> pd.DataFrame:
            columns = [part.split()[0] for part in _FOLD_SCHEMA.split(", ")]
            made = pd.DataFrame(out, columns=columns)
            whole = ["chunk_line", "start_line", "started_at", "ended_at", "close_line", "ctx_group_size", "final_0", "final_1"]
            return made.astype({c: "Int64" for c in whole} | {"hit": "boolean"})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.log_id, row.chunk_line) != key:
                    if key is not None:
                        flush()
                    matcher = _matcher(row.candidates) if row.line == CANDIDATES_LINE else EncounterMatcher([])
                    key, chunk = (row.log_id, row.chunk_line), _ChunkFold(matcher, options)
                if row.line != CANDIDATES_LINE:
                    chunk.push(_step(row))
            if len(out) >= 10_000:
                yield frame()
                out.clear()
        if key is not None:
            flush()
        if out:
            yield frame()

    return run


def _entry_bits(chunks: DataFrame, options: Options) -> DataFrame:
    """The exit flag every chunk inherits.

    A chunk maps the flag by (final_0, final_1): equal values fix it, (0, 1)
    passes it on and (1, 0) flips it, so the inherited flag is the last fixed
    value before the chunk, flipped once per flip since.
    """
    block = scan.line_block(options.block_lines, "chunk_line")
    flips = F.when(F.col("final_0") > F.col("final_1"), F.lit(1)).otherwise(F.lit(0))
    counted = scan.running(chunks, ["log_id"], ["chunk_line"], block, {"flips": scan.total(flips)})
    fixed_here = F.when(F.col("final_0") == F.col("final_1"), F.struct("final_0", "flips"))
    carried = scan.running(
        counted, ["log_id"], ["chunk_line"], block,
        {
            "fixed_before": scan.last(fixed_here, inclusive=False),
            "flips_before": scan.total(flips, inclusive=False),
        },
    )
    start = F.coalesce(F.col("fixed_before.final_0"), F.lit(0))
    since = F.col("flips_before") - F.coalesce(F.col("fixed_before.flips"), F.lit(0))
    return carried.select("log_id", "chunk_line", ((start + since) % 2).cast("int").alias("inherited"))


def pull_candidates(events: DataFrame, catalog: Catalog, options: Options, victory_hits: DataFrame | None = None) -> DataFrame:
    """Every pull the state machine closes, before trivial ones are discarded."""
    steps = staged(decision_steps(_flags(events, catalog, victory_hits), options), packed=True)
    log_type = dict(events.dtypes)["log_id"]
    folded = staged(
        steps.unionByName(_candidates(steps, catalog), allowMissingColumns=True).repartition("log_id", "chunk_line")
        .sortWithinPartitions("log_id", "chunk_line", "line")
        .mapInPandas(_fold_partitions(options), _FOLD_SCHEMA.format(log_type=log_type))
    )
    chunks = folded.filter("final_0 IS NOT NULL").select("log_id", "chunk_line", "final_0", "final_1")
    bits = _entry_bits(chunks, options)
    following = scan.running(
        chunks, ["log_id"], ["chunk_line"], scan.line_block(options.block_lines, "chunk_line"),
        {"next_chunk": scan.last(F.col("chunk_line"), inclusive=False)}, descending=True,
    ).select("log_id", "chunk_line", "next_chunk")
    pulls = (
        folded.filter("start_line IS NOT NULL")
        .join(bits, ["log_id", "chunk_line"])
        .join(following, ["log_id", "chunk_line"])
        .filter("entry_bit = -1 OR entry_bit = inherited")
    )
    final_reason = F.when(F.col("next_chunk").isNotNull(), "sustained-silence").otherwise("stream-ended")
    return pulls.select(
        "log_id", "start_line",
        F.coalesce("close_line", "next_chunk").alias("close_line"),
        "started_at", "ended_at",
        (F.col("ended_at") - F.col("started_at")).alias("duration_ms"),
        F.coalesce("end_reason", final_reason).alias("end_reason"),
        "hit", *CONTEXT,
    )


def keep_meaningful(candidates: DataFrame, options: Options) -> DataFrame:
    """Drops stray ticks and numbers what remains, so ``pull_index`` counts kept pulls."""
    kept = candidates.filter((F.col("duration_ms") >= options.min_duration_ms) & F.col("hit"))
    numbered = scan.running(
        kept, ["log_id"], ["start_line"], scan.line_block(options.block_lines, "start_line"),
        {"pull_index": scan.total(F.lit(1).cast("bigint"))},
    )
    return numbered.drop("hit").withColumn("pull_id", F.concat_ws("-", "started_at", "pull_index"))


def segment_pulls(events: DataFrame, catalog: Catalog, options: Options, victory_hits: DataFrame | None = None) -> DataFrame:
    """Kept pulls of every log, one row each, materialised for the steps that follow."""
    kept = keep_meaningful(pull_candidates(events, catalog, options, victory_hits), options)
    bounds = events.groupBy("log_id").agg((F.max("line_number") + 1).alias("__end"))
    bounded = kept.join(bounds, "log_id").withColumn("close_line", F.coalesce("close_line", "__end"))
    return staged(bounded.drop("__end"))


def gap_pulls(events: DataFrame, options: Options) -> DataFrame:
    """Gap-only sessions in the shape of pulls, with the context of their first event.

    One scan finds the session starts; the small table of starts then gives
    index and end, since the highest time before a start is the end of the
    session before it.
    """
    inputs = events.select("log_id", "line_number", "ts_ms", *[v.alias(n) for n, v in _context_inputs().items()])
    specs = {**_context_specs(), "prior": scan.highest(F.col("ts_ms"), inclusive=False)}
    scanned = scan.running(inputs, ["log_id"], ["line_number"], scan.line_block(options.block_lines), specs)
    begins = F.col("prior").isNull() | (F.col("ts_ms") - F.col("prior") >= options.idle_ms)
    starts = staged(scanned.filter(begins).select("log_id", "line_number", "ts_ms", "prior", *_context_columns()))
    order = (["log_id"], ["line_number"], scan.line_block(options.block_lines))
    numbered = scan.running(starts, *order, {"pull_index": scan.total(F.lit(1).cast("bigint"))})
    following = F.struct(F.col("line_number").alias("line"), F.col("prior").alias("ended"))
    linked = scan.running(numbered, *order, {"next": scan.last(following, inclusive=False)}, descending=True)
    tails = events.groupBy("log_id").agg(F.max("ts_ms").alias("__ts"), F.max("line_number").alias("__line"))
    ended = F.coalesce("next.ended", "__ts")
    pulls = linked.join(tails, "log_id").select(
        "log_id", F.concat_ws("-", "ts_ms", "pull_index").alias("pull_id"), "pull_index", F.col("ts_ms").alias("started_at"),
        ended.alias("ended_at"), F.col("line_number").alias("start_line"), F.coalesce("next.line", F.col("__line") + 1).alias("close_line"),
        (ended - F.col("ts_ms")).alias("duration_ms"),
        F.when(F.col("next").isNotNull(), "sustained-silence").otherwise("stream-ended").alias("end_reason"), *CONTEXT,
    )
    return staged(pulls)


def tag_pulls(events: DataFrame, pulls: DataFrame, *carry: str) -> DataFrame:
    """Events with the pull they belong to; events outside every pull are dropped.

    The pulls of a log are disjoint line intervals, so each is listed once per
    line bin it covers and the join is an equality on (log, bin). The size of that
    list cannot be told from the table of pulls, so the join never broadcasts it.
    """
    last_line = F.col("close_line") - 1
    bins = pulls.select("log_id", "pull_id", "start_line", last_line.alias("__last"), *carry).withColumn(
        "__bin",
        F.explode(
            F.sequence(
                F.floor(F.col("start_line") / TAG_BIN_LINES).cast("bigint"),
                F.floor(F.col("__last") / TAG_BIN_LINES).cast("bigint"),
            )
        ),
    )
    members = events.filter(~F.col("type").isin("areaEntered", "disciplineChanged"))
    binned = members.withColumn("__bin", scan.line_block(TAG_BIN_LINES))
    inside = F.col("line_number").between(F.col("start_line"), F.col("__last"))
    return binned.join(bins.hint("merge"), ["log_id", "__bin"]).filter(inside).drop("__bin", "start_line", "__last")
