"""Live analysis of event streams with event-time state.

Streams carry the flat event schema plus a session key.  Each session's state
is one open pull: the segmentation fold and running totals per actor, never the
events themselves; raw events go straight to their table.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fraylens.functions import combat
from fraylens.operators import victories
from fraylens.operators.pullfold import Closed, EncounterMatcher, PullFold, Step
from fraylens.operators.staging import shared_folder
from fraylens.options import Options
from fraylens.sources.catalog import Catalog

LIVE_SCHEMA = (
    "session_id string, kind string, start_line bigint, started_at bigint, ended_at bigint, elapsed_ms bigint, end_reason string, "
    "hit boolean, encounter_id string, cleared boolean, actor_id string, name string, damage double, healing double, damage_taken double, deaths bigint, "
    "dps double, hps double, dtps double"
)
_COLUMNS = [part.split()[0] for part in LIVE_SCHEMA.split(", ")]

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class _Session:
    fold: PullFold
    context: list = field(default_factory=lambda: [None] * 6)
    actors: dict = field(default_factory=dict)
    last_event: int = 0
    last_batch: int = 0  # processing time


class LiveSessions(StatefulProcessor):
    """Closes pulls as silence falls and reports every open one after each micro-batch.

    Rows of a session are taken in line order within a micro-batch; the trigger
    bounds how many there are.  Two processing-time timers watch a quiet session, on
    the log's own clock moved on by the quiet time: one closes the pull after the silence
    that ends it as things stand, the other drops the session after ``reap_ms``.
    Zone, server and local player outlive a pull, not the session.
    """

    def __init__(self, encounters: list[dict], options: Options, quiet_timers: bool, reap_ms: int = 300_000, definitions: list[dict] | None = None):
        self._encounters, self._options, self._definitions = encounters, options, definitions or []
        self._quiet_timers, self._reap_ms = quiet_timers, reap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("session", "blob binary")
        self._matcher = EncounterMatcher(self._encounters, self._definitions)

    def _load(self) -> _Session:
        if not self._state.exists():
            return _Session(PullFold(self._matcher, self._options))
        session = pickle.loads(self._state.get()[0])
        session.fold._matcher = self._matcher
        return session

    def _save(self, session: _Session) -> None:
        session.fold._matcher = None
        self._state.update((pickle.dumps(session),))
        session.fold._matcher = self._matcher

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, out = self._load(), []
        batch = pd.concat(list(rows)).sort_values(["line_number", "hit"], na_position="first")
        held, hits = None, []  # an event's row comes first, then a row a definition whose trigger it meets
        for row in batch.itertuples(index=False):
            if _none(row.hit) is not None:
                hits.append(row.hit)
                continue
            if held is not None:
                self._event(key[0], session, held, hits, out)
            held, hits = row, []
        if held is not None:
            self._event(key[0], session, held, hits, out)
        out += self._snapshot(key[0], session, session.last_event)
        if self._quiet_timers:
            session.last_batch = timerValues.getCurrentProcessingTimeInMs()
            self._schedule(session, session.last_batch)
        self._save(session)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, out, at = self._load(), [], expiredTimerInfo.getExpiryTimeInMs()
        closed = session.fold.expire(None, session.last_event + at - session.last_batch)
        self._close(key[0], session, closed, out)
        if at - session.last_batch >= self._reap_ms:
            self._state.clear()
        else:
            self._save(session)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _schedule(self, session: _Session, now: int) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        silence = session.fold.silence_left(session.last_event)
        if silence is not None and silence < self._reap_ms:
            self._handle.registerTimer(now + max(1, silence))
        self._handle.registerTimer(now + self._reap_ms)

    def _event(self, session_id: str, session: _Session, row, hits: list[str], out: list) -> None:
        if row.type == "disciplineChanged":
            return
        if row.type in ("areaEntered", "combatState") and session.context[5] is None and row.source_kind == "player":
            session.context[5] = row.source_id
        if row.type == "areaEntered":
            session.context[:4] = [_none(row.zone_id), _none(row.zone_name), _none(row.difficulty), _none(row.group_size)]
            session.context[4] = _none(row.server_id) or session.context[4]
        is_hit = row.type == "damage" and row.source_kind == "player" and row.target_kind == "npc"
        applied = _none(row.applied)
        step = Step(
            line=row.line_number, ts=row.ts_ms, area=row.type == "areaEntered", enter=row.is_enter, exit=row.is_exit,
            activity=(row.line_number, row.ts_ms) if row.is_activity else None, clock_ts=row.ts_ms if row.is_clock else None,
            engaged=[(row.target_npc_id, row.canonical)] if is_hit else [],
            died=(row.target_npc_id, row.target_name, row.canonical) if row.type == "death" and row.target_kind == "npc" else None,
            text=row.text or None, victory_of=hits, hit=is_hit and (applied or 0) > 0, context=tuple(session.context), zone=tuple(session.context[:2]),
        )
        was_open = session.fold.open
        self._close(session_id, session, session.fold.push(step), out)
        if session.fold.open is not None:
            if session.fold.open is not was_open:
                session.actors = {}
            self._count(session, row, is_hit, applied or 0.0)
        session.last_event = max(session.last_event, row.ts_ms)

    @staticmethod
    def _count(session: _Session, row, is_hit: bool, applied: float) -> None:
        def actor(side: str) -> dict:
            key = getattr(row, f"{side}_id")
            return session.actors.setdefault(
                key, {"name": getattr(row, f"{side}_name"), "damage": 0.0, "healing": 0.0, "damage_taken": 0.0, "deaths": 0}
            )

        if is_hit:
            actor("source")["damage"] += applied
        if row.type == "heal" and row.source_kind == "player":
            actor("source")["healing"] += applied
        if row.type == "damage" and row.target_kind == "player":
            actor("target")["damage_taken"] += applied
        if row.type == "death" and row.target_kind == "player":
            actor("target")["deaths"] += 1
        if row.type == "ability" and row.is_activity:
            actor("source")

    def _rows(self, session_id: str, kind: str, session: _Session, pull: Closed, until: int, match, cleared: bool) -> list:
        elapsed = max(0, until - pull.started_at)
        seconds = max(elapsed, 1) / 1000
        head = [
            session_id, kind, pull.start_line, pull.started_at, pull.ended_at, elapsed, pull.reason, pull.hit, match and match["id"], cleared
        ]
        return [
            (*head, key, a["name"], a["damage"], a["healing"], a["damage_taken"], a["deaths"],
             a["damage"] / seconds, a["healing"] / seconds, a["damage_taken"] / seconds)
            for key, a in session.actors.items()
        ]

    def _close(self, session_id: str, session: _Session, closed: Closed | None, out: list) -> None:
        if closed is None:
            return
        options, match = self._options, session.fold._match
        kept = closed.ended_at - closed.started_at >= options.min_duration_ms and closed.hit
        if kept:
            out += self._rows(session_id, "pull", session, closed, closed.ended_at, match, session.fold.victory())
        session.actors = {}

    def _snapshot(self, session_id: str, session: _Session, now: int) -> list:
        fold = session.fold
        if fold.open is None or fold._match is None:
            return []
        return self._rows(session_id, "snapshot", session, fold.open, now, fold._match, fold.victory())


def _none(value):
    return None if value is None or value != value else value


def _prepared(events: DataFrame, catalog: Catalog, session: Column) -> DataFrame:
    names = catalog.npc_catalog.select(F.col("npc_id").alias("target_npc_id"), F.col("name").alias("__name"))
    # who the local player is cannot be told without state, so triggers on them are not met here
    met = victories.with_hits(events.withColumn("local_player_id", F.lit(None).cast("string")), catalog.encounter_defs)
    joined = met.join(names, "target_npc_id", "left")
    return joined.select(
        "hit",
        session.cast("string").alias("session_id"), "line_number", "ts_ms", "type", "source_kind", "source_id", "source_name",
        "target_kind", "target_id", "target_name", "target_npc_id", "zone_id", "zone_name", "difficulty", "group_size", "server_id",
        combat.applied().cast("double").alias("applied"), combat.is_clock().alias("is_clock"), combat.is_activity().alias("is_activity"),
        combat.is_state("enter").alias("is_enter"), combat.is_state("exit").alias("is_exit"),
        combat.normalise(F.coalesce("__name", "target_name")).alias("canonical"),
        F.lower(F.concat_ws(" ", *combat.spoken())).alias("text"),
    )


def live_pulls(
    events: DataFrame, catalog: Catalog, options: Options, session: Column, quiet_timers: bool = True
) -> DataFrame:
    """Closed pulls (``kind = 'pull'``) and snapshots of open boss pulls, one row per actor.

    ``quiet_timers`` closes pulls and drops sessions nothing follows.  A bounded
    run (``availableNow``) has to do without, since it would wait for its timers.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor = LiveSessions(catalog.encounter_index(), options, quiet_timers, definitions=catalog.definition_index())
    return _prepared(events, catalog, session).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=LIVE_SCHEMA, outputMode="Append",
        timeMode="ProcessingTime" if quiet_timers else "None",
    )


def latest_snapshots(live: DataFrame) -> DataFrame:
    """Newest snapshot per session from rows the live job has written."""
    shown = live.filter(F.col("kind") == "snapshot")
    newest = shown.groupBy("session_id").agg(F.max(F.struct("started_at", "elapsed_ms")).alias("n"))
    return shown.join(newest, "session_id").filter((F.col("started_at") == F.col("n.started_at")) & (F.col("elapsed_ms") == F.col("n.elapsed_ms"))).drop("n")


def dedup_batches(batches: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each (session, sequence) once, however often a client resends it; needs an ``arrived_at`` timestamp."""
    return batches.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["session_id", "sequence"])


def tumbling_metrics(events: DataFrame, length: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Damage, healing and damage taken per session and fixed time window; needs ``event_time``."""
    hurt = (F.col("type") == "damage") & combat.player("target")

    def summed(condition: Column) -> Column:
        return F.sum(F.when(condition, combat.applied()).otherwise(F.lit(0)))

    window = F.window("event_time", length)
    grouped = events.withWatermark("event_time", delay).filter(combat.is_type("damage", "heal")).groupBy("log_id", window)
    sums = grouped.agg(
        summed(combat.raid_damage()).alias("damage"), summed((F.col("type") == "heal") & combat.player("source")).alias("healing"),
        summed(hurt).alias("damage_taken"), F.count(F.lit(1)).alias("events"),
    )
    return sums.select("log_id", F.unix_millis("window.start").alias("window_start_ms"), "damage", "healing", "damage_taken", "events")


def gap_windows(events: DataFrame, gap: str, delay: str = "10 seconds") -> DataFrame:
    """Plain silence sessions over a stream."""
    grouped = events.withWatermark("event_time", delay).groupBy("log_id", F.session_window("event_time", gap))
    counted = grouped.agg(F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("started_at"), F.max("ts_ms").alias("ended_at"))
    return counted.select("log_id", "started_at", "ended_at", "events")


def stream_status(events: DataFrame) -> DataFrame:
    """Events received and last sight of every session (update mode)."""
    return events.groupBy("log_id").agg(F.count(F.lit(1)).alias("events_received"), F.max("ts_ms").alias("last_seen_at"))


def timed(events: DataFrame) -> DataFrame:
    """Adds the event-time column the windows and watermarks use."""
    return events.withColumn("event_time", F.timestamp_millis("ts_ms"))


#: State partitions a core of a run over what is there, and their least number.
CORE_STATES, LEAST_STATES = 4, 32


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Streams started inside deal their state over a few partitions a core, never more than the session asks for.

    The partitions of a state are not merged as those of a batch are, and each costs a store and
    a Python worker's start in every micro-batch. Only for runs whose checkpoint ends with them.
    """
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(asked), max(CORE_STATES * spark.sparkContext.defaultParallelism, LEAST_STATES)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there and reads back what it wrote.

    The sink is a table in the shared folder; complete and update results keep
    only the rows of their last version through ``foreachBatch``.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    with bounded(spark):
        if mode == "append":
            query = writer.outputMode("append").format("parquet").start(f"{base}/table")
        else:
            query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/table")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
