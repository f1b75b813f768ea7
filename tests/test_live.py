import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fraylens.operators.staging import new_path
from fraylens.options import Options
from fraylens.plans.registry import QUERIES
from fraylens.streaming import announcer, arrivals, publish
from fraylens.streaming.live import CORE_STATES, LEAST_STATES, LiveSessions, bounded, run_available, stream_status

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
def test_stream_closes_the_pulls_of_the_batch(spark):
    streamed = QUERIES["stream_pulls"](spark, SF).filter("kind = 'pull'").select("session_id", "start_line", "ended_at").distinct()
    batch = QUERIES["pulls_full"](spark, SF).select(
        F.col("log_id").cast("string").alias("session_id"), "start_line", "ended_at", "end_reason"
    )
    live = {tuple(r) for r in streamed.collect()}
    rows = batch.collect()
    # What only the end of the log closes is still open in the stream.
    assert live <= {(r.session_id, r.start_line, r.ended_at) for r in rows}
    assert {(r.session_id, r.start_line, r.ended_at) for r in rows if r.end_reason == "sustained-silence"} <= live


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.value, self.timers = Value(), []

    def getValueState(self, *_):
        return self.value

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def row(line, ts, type_="damage", hit=None, **more):
    base = {
        "hit": hit, "line_number": line, "ts_ms": ts, "type": type_, "source_kind": "player", "source_id": "p1", "source_name": "Ada", "target_kind": "npc", "target_id": "n1",
        "target_name": "Crab", "target_npc_id": "77", "zone_id": None, "zone_name": None, "difficulty": None, "group_size": None, "server_id": None, "applied": 10.0,
        "is_clock": type_ == "damage", "is_activity": type_ == "damage", "is_enter": False, "is_exit": False, "canonical": "crab", "text": "",
    }
    return base | more


ENCOUNTER = {
    "id": "e", "catalog_order": 1, "boss_names": ["crab"], "victory_requires": [], "boss_npc_ids": ["77"], "observed_ids": [], "zone_ids": [], "zone_names": [], "victory_event": "Boss defeated",
}


def live(rows, definitions=()):
    processor, handle = LiveSessions([ENCOUNTER], Options(), True, definitions=list(definitions)), Handle()
    processor.init(handle)
    out = list(processor.handleInputRows(("s",), iter([pd.DataFrame(rows)]), Now(1_000_000)))[0]
    return processor, handle, out


@pytest.mark.parametrize(
    ("rows", "silence"),
    [
        ([row(1, 5_000), row(2, 12_000)], 8_000),
        ([row(1, 5_000), row(2, 12_000), row(3, 12_100, "combatState", is_exit=True)], 2_500 - 100),
        ([row(1, 5_000), row(2, 12_000), row(3, 12_000, hit="d")], 3_000),  # the trigger of the bound definition was met at line 3
    ],
)
def test_a_quiet_pull_closes_after_its_own_silence(rows, silence):
    plain = [r for r in rows if r["hit"] is None] + [row(3, 12_000)] if any(r["hit"] for r in rows) else rows
    processor, handle, shown = live(plain + [r for r in rows if r["hit"] is not None], [{"id": "d", "bossNpcIds": ["77"]}])
    assert set(shown["kind"]) == {"snapshot"}
    assert sorted(handle.timers) == [1_000_000 + silence, 1_300_000]
    early = list(processor.handleExpiredTimer(("s",), None, Now(1_000_000 + silence - 1)))[0]
    assert early.empty
    closed = list(processor.handleExpiredTimer(("s",), None, Now(1_000_000 + silence)))[0]
    assert list(closed["kind"]) == ["pull"] and list(closed["ended_at"]) == [12_000] and handle.value.exists()
    assert list(processor.handleExpiredTimer(("s",), None, Now(1_300_000)))[0].empty and not handle.value.exists()


def test_the_zone_outlives_a_closed_pull():
    area = row(1, 1_000, "areaEntered", zone_id="z", zone_name="Reef", target_kind=None, target_npc_id=None)
    processor, handle, _ = live([area, row(2, 5_000), row(3, 12_000)])
    list(processor.handleExpiredTimer(("s",), None, Now(1_000_000 + 8_000)))
    assert processor._load().context[:2] == ["z", "Reef"] and processor._load().fold.last_closed == 12_000


def test_late_rows_and_the_rest_are_all_rows(spark):
    rows = [("a", i, i, 1_000 * i - (9_000 if i % 5 == 0 else 0)) for i in range(1, 60)] + [("b", i, i, 50) for i in range(3)]
    df = spark.createDataFrame(rows, "session_id string, line_number long, arrival long, ts_ms long")
    parts = [df.where("arrival < 20"), df.where("arrival BETWEEN 20 AND 33"), df.where("arrival > 33")]
    got = {(r.session_id, r.line_number): (r.behind_ms, r.late) for r in publish.landed(parts, lambda s: arrivals.split_late(s, 3_000)).collect()}
    assert len(got) == len(rows)
    for session, line, _, ts in rows:
        peak = max((t for s, n, _, t in rows if s == session and n < line), default=ts)
        assert got[session, line] == (max(0, peak - ts), peak - ts > 3_000)


def test_announcements_and_a_batch_that_is_written_again(spark):
    fights = [("g", "e", i, 1, i, f"p{i}", o, left, "boss") for i, (o, left) in enumerate([("wipe", 40.0), ("wipe", 12.0), ("wipe", 13.0), ("kill", None), ("incomplete", 1.0), ("wipe", 3.0), ("kill", None)])]
    df = spark.createDataFrame(fights, "guild_id string, encounter_id string, started_at long, log_id long, pull_index long, pull_id string, outcome string, boss_remaining_percent double, boss_instance_id string")
    base, calls = new_path(spark, "announced"), []

    def run(fail):
        stream = announcer.live_announcements(spark.readStream.schema(df.schema).parquet(f"{base}/in"), Options())

        def hook(rows, number):
            calls.append((number, sorted(r.pull_id for r in rows.collect())))
            if fail:
                raise ValueError("stopped after the write")

        return publish.publish(stream, f"{base}/table", f"{base}/checkpoint", hooks=[hook]), stream.schema

    for part, fail in [(df.where("started_at < 3"), False), (df.where("started_at >= 3"), True), (None, False)]:
        if part is not None:
            part.write.mode("append").parquet(f"{base}/in")
            time.sleep(0.01)
        query, schema = run(fail)
        try:
            query.awaitTermination()
        except Exception:
            assert fail
    got = sorted(tuple(r) for r in publish.published(spark, f"{base}/table", schema).select("pull_id", "attempts", "kills", "previous_best", "kind").collect())
    assert got == [("p1", 2, 0, 40.0, "closeWipe"), ("p3", 4, 1, 12.0, "firstKill"), ("p5", 5, 1, 12.0, "closeWipe"), ("p6", 6, 2, 3.0, "kill")]
    assert [c for c in calls if c[0] == 1] == [(1, ["p3", "p5", "p6"])] * 2  # at least once, with the same keys


def test_pull_hooks_see_a_pull_once_a_call(spark):
    rows = spark.createDataFrame([("s", "pull", 1, "a"), ("s", "pull", 1, "b"), ("s", "snapshot", 9, "a")], "session_id string, kind string, start_line long, actor_id string")
    seen = []
    hook = publish.pull_hook(lambda df, n: seen.append(("start", n, [r.start_line for r in df.collect()])), lambda df, n: seen.append(("end", n, [r.start_line for r in df.collect()])))
    hook(rows, 4)
    assert seen == [("start", 4, [9]), ("end", 4, [1])]


def test_bounded_runs_deal_their_state_over_few_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    states = str(max(CORE_STATES * spark.sparkContext.defaultParallelism, LEAST_STATES))
    try:
        for asked, given in (("2000", states), ("3", "3")):
            spark.conf.set("spark.sql.shuffle.partitions", asked)
            with bounded(spark):
                assert spark.conf.get("spark.sql.shuffle.partitions") == given
            assert spark.conf.get("spark.sql.shuffle.partitions") == asked
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        source = new_path(spark, "source")
        spark.range(4).selectExpr("id % 2 AS log_id", "id AS ts_ms").write.parquet(source)
        stream = spark.readStream.schema("log_id bigint, ts_ms bigint").parquet(source)
        assert {tuple(r) for r in run_available(stream_status(stream), "complete").collect()} == {(0, 2, 2), (1, 2, 3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
