"""Materialising a result that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; local mode, which is one machine, gets a new one when unset."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fraylens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Values as they are: neither packed nor replaced by numbers of a dictionary.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def staged(df: DataFrame, packed: bool = False, joined: bool = False) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    A written table cuts the lineage, survives the loss of executors and prunes
    columns like any scan. The optimizer takes the size of the files for the size
    of the rows when it decides what to broadcast, so values are stored plainly;
    ``packed`` saves the disk for tables as long as the events, which no join
    takes as they are. ``joined`` is for packed tables that joins do take: beside
    one row of no columns the optimizer counts four times the size of the files.
    """
    spark = df.sparkSession
    path = new_path(spark, "staged")
    df.write.options(**({} if packed else PLAIN)).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    return rows.crossJoin(spark.range(1).toDF("__one")).select(*df.columns) if joined else rows
