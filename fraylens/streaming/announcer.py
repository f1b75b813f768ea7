"""Live announcements: first kills, kills and close wipes as fights close.

The state of an encounter in a guild is three numbers: attempts, kills and the best
wipe. Fights of a micro-batch are taken in the order they began; the stream must
deliver batches in that order too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fraylens.options import Options
from fraylens.streaming.live import PROVIDER

FIGHT = ["started_at", "log_id", "pull_index", "pull_id", "outcome", "boss_remaining_percent"]
_OUT = "guild_id {guild}, encounter_id string, log_id {log}, pull_id string, attempts bigint, kills bigint, previous_best double, kind string"


class Announcer(StatefulProcessor):
    def __init__(self, close_wipe_percent: float):
        self._close = close_wipe_percent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("progress", "attempts bigint, kills bigint, best double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, kills, best = self._state.get() if self._state.exists() else (0, 0, None)
        fights, out = pd.concat(list(rows)).sort_values(["started_at", "log_id", "pull_index"]), []
        for f in fights.itertuples(index=False):
            attempts += 1
            left = None if pd.isna(f.boss_remaining_percent) else float(f.boss_remaining_percent)
            if f.outcome == "kill":
                kills += 1
                out.append((*key, f.log_id, f.pull_id, attempts, kills, best, "firstKill" if kills == 1 else "kill"))
            elif left is not None and (best is None or left < best):
                if left <= self._close:
                    out.append((*key, f.log_id, f.pull_id, attempts, kills, best, "closeWipe"))
                best = left
        self._state.update((attempts, kills, best))
        columns = ["guild_id", "encounter_id", "log_id", "pull_id", "attempts", "kills", "previous_best", "kind"]
        yield pd.DataFrame(out, columns=columns).astype({"previous_best": "float64"})


def live_announcements(fights: DataFrame, options: Options) -> DataFrame:
    """Announcements of a stream of closed fights (``guild_id``, ``encounter_id`` and the columns of ``FIGHT``)."""
    fights.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    known = fights.where("encounter_id IS NOT NULL AND outcome <> 'incomplete' AND boss_instance_id IS NOT NULL")
    types = dict(fights.dtypes)
    return known.select("guild_id", "encounter_id", *FIGHT).groupBy("guild_id", "encounter_id").transformWithStateInPandas(
        statefulProcessor=Announcer(options.close_wipe_percent), outputStructType=_OUT.format(guild=types["guild_id"], log=types["log_id"]), outputMode="Append", timeMode="None"
    )
