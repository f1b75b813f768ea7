"""Log files as a table of lines.

A log is read whole per file, because its encoding is decided for the whole
file and its line numbers count from its first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "log_id string, file_name string, line_number bigint, raw string"

# Fixed value: how the game names its logs.
FILE_NAME = r"(?i)^combat_(\d{4})-(\d{2})-(\d{2})_(\d{2})_(\d{2})_(\d{2})(?:_(\d+))?\.txt$"


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[\\/]", "")


def is_log_name(name: Column) -> Column:
    return name.rlike(FILE_NAME)


def log_date(file_name: Column) -> Column:
    """Calendar date in a log's file name, null when the name is not a log's."""
    name = base_name(file_name)
    parts = [F.regexp_extract(name, FILE_NAME, i) for i in (1, 2, 3)]
    return F.when(is_log_name(name), F.concat_ws("-", *parts).cast("date"))


def started_at(file_name: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds of the instant in a log's file name."""
    name = base_name(file_name)
    part = [F.regexp_extract(name, FILE_NAME, i) for i in range(1, 7)]
    local = F.concat(F.concat_ws("-", *part[:3]), F.lit(" "), F.concat_ws(":", *part[3:]))
    utc = F.to_utc_timestamp(F.try_to_timestamp(local), F.lit(zone))
    return F.when(is_log_name(name), F.unix_millis(utc))


def list_logs(spark: SparkSession, directory: str) -> DataFrame:
    """Log files of a directory with their modification times and contents (read only when used)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "combat_*.txt").load(directory)
    named = found.withColumn("file_name", base_name(F.col("path")))
    return named.filter(is_log_name(F.col("file_name")))


def newest_log(logs: DataFrame) -> DataFrame:
    """The log modified last, which need not be the last by name."""
    return logs.orderBy(F.desc("modificationTime"), F.desc("file_name")).limit(1)


def decode(content: Column) -> Column:
    """File text: UTF-8, or Latin-1 for the whole file when any of it is not UTF-8; without a byte-order mark."""
    as_text = content.cast("string")
    clean = F.is_valid_utf8(as_text) & ~F.contains(F.try_validate_utf8(as_text), F.lit("�"))
    text = F.when(F.coalesce(clean, F.lit(False)), as_text).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^(\ufeff|ï»¿)", "")


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\s\u00a0\ufeff]")


def split_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of whole-file texts (``log_id``, ``file_name``, ``text``); blank lines count but drop out."""
    lines = files.select("log_id", "file_name", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    numbered = lines.select("log_id", "file_name", (F.col("pos") + 1).cast("bigint").alias("line_number"), "raw")
    return numbered.filter(~is_blank(F.col("raw")))


def read_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Every line of every log of a directory."""
    files = list_logs(spark, directory).select(F.col("file_name").alias("log_id"), "file_name", decode(F.col("content")).alias("text"))
    return split_lines(files)


def stream_lines(spark: SparkSession, directory: str, max_files: int = 50) -> DataFrame:
    """Closed chunks of live logs as they land; the session is the file they arrive in.

    A rotated log is a new file and so a new session, read from its top.
    """
    chunks = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "combat_*.txt").option("maxFilesPerTrigger", max_files).load(directory)
    )
    named = chunks.withColumn("file_name", base_name(F.col("path")))
    return split_lines(named.select(F.col("file_name").alias("log_id"), "file_name", decode(F.col("content")).alias("text")))
