"""Exactly-once tables of stream results, hooks for pulls, and runs over batches as they land.

A micro-batch is written under its own number, so a batch that is replayed after a
stop replaces what it left behind and nothing is published twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fraylens.operators.staging import new_path
from fraylens.streaming.live import bounded

Hook = Callable[[DataFrame, int], None]


def publish(
    stream: DataFrame, table: str, checkpoint: str, sessions: DataFrame | None = None, hooks: Iterable[Hook] = (), available: bool = True
) -> StreamingQuery:
    """Starts the stream into ``table`` (one folder a micro-batch).

    ``sessions`` (session_id, owner_id, report_code, log_file) is joined to the rows. Every
    hook is called with the rows of a batch after they are written, at least once; the
    rows' own keys tell a repeated call.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if sessions is None else batch.join(sessions, "session_id", "left")
        path = f"{table}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        if hooks:
            written = batch.sparkSession.read.schema(rows.schema).parquet(path)
            for hook in hooks:
                hook(written, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available else writer).start()


def published(spark: SparkSession, table: str, schema) -> DataFrame:
    """Rows of a published table; the number of their batch is left out."""
    return spark.read.schema(schema).parquet(f"{table}/batch=*")


def pull_hook(on_start: Hook | None = None, on_end: Hook | None = None) -> Hook:
    """A hook that hands pulls on by key (session_id, start_line): ``on_start`` those seen open, ``on_end`` those closed."""

    def call(rows: DataFrame, number: int) -> None:
        for kind, hook in (("snapshot", on_start), ("pull", on_end)):
            if hook is not None:
                hook(rows.where(F.col("kind") == kind).dropDuplicates(["session_id", "start_line"]), number)

    return call


def landed(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Lets ``parts`` land one after another and runs the stream ``build`` makes over each, in one checkpoint; returns what it published."""
    spark, base = parts[0].sparkSession, new_path(parts[0].sparkSession, "landed")
    stream = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(parts[0].schema).parquet(f"{base}/in"))
        with bounded(spark):
            query = publish(stream, f"{base}/table", f"{base}/checkpoint", **options)
        query.awaitTermination()
    return published(spark, f"{base}/table", stream.schema)
