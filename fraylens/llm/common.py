"""Small helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraylens.operators.staging import staged

__all__ = ["documents", "encoded", "read", "sha256_hex", "staged", "with_columns_in_arrow"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def encoded(text: Column) -> Column:
    """UTF-8 bytes of a text, none for a null one."""
    return F.coalesce(text, F.lit("")).cast("binary")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def with_columns_in_arrow(df: DataFrame, source: Column, added: T.StructType, compute, under: str = "added") -> DataFrame:
    """``df`` with one more struct column, computed batch by batch from the bytes of ``source``.

    ``compute(values)`` takes a list of bytes and returns one list per field of
    ``added``. The other columns pass through untouched under positional names,
    so neither clashing nor repeated names matter.
    """
    names = df.columns
    plain = df.select(source.alias("source"), F.struct("*").alias("row"))
    schema = T.StructType([T.StructField("row", plain.schema["row"].dataType), T.StructField("added", added)])
    fields = [f.name for f in added.fields]

    def run(batches):
        for batch in batches:
            kinds = [_arrow(f.dataType) for f in added.fields]
            columns = compute(batch.column(0).to_pylist())
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.StructArray.from_arrays(arrays, fields)], ["row", "added"])

    out = plain.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(n).alias(n) for n in names], F.col("added").alias(under))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}
    return plain[type(kind)]
