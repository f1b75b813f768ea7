"""Late rows: a watermark that can be seen.

Windows drop what comes later than their watermark. ``split_late`` makes the same
decision for every row of a session, in order of arrival: a row is late if its time
lies more than ``delay_ms`` behind the highest time that arrived before it. Late rows
get a table of their own, with how far they were behind; both tables hold all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fraylens.streaming.live import PROVIDER

SCHEMA = "session_id string, line_number bigint, arrival bigint, ts_ms bigint, behind_ms bigint, late boolean"


class LateSplit(StatefulProcessor):
    """Holds one number a session, the highest time so far; expired with ``ttl_ms``."""

    def __init__(self, delay_ms: int, ttl_ms: int | None = None):
        self._delay_ms, self._ttl_ms = delay_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._peak = handle.getValueState("peak", "ts_ms bigint", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["arrival", "line_number"])
        times = batch["ts_ms"].to_numpy(np.int64)
        before = self._peak.get()[0] if self._peak.exists() else np.iinfo(np.int64).min // 2
        peaks = np.maximum.accumulate(np.concatenate([[before], times]))
        self._peak.update((int(peaks[-1]),))
        behind = np.maximum(0, peaks[:-1] - times)
        yield pd.DataFrame(
            {"session_id": key[0], "line_number": batch["line_number"], "arrival": batch["arrival"], "ts_ms": times, "behind_ms": behind, "late": behind > self._delay_ms}
        )


def split_late(events: DataFrame, delay_ms: int) -> DataFrame:
    """Rows of a stream (session_id, line_number, arrival, ts_ms) told late or on time."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = events.select(F.col("session_id").cast("string").alias("session_id"), "line_number", "arrival", "ts_ms")
    return keyed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=LateSplit(delay_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="None"
    )
