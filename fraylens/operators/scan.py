"""Running values over ordered groups of any size.

A plain window sorts a whole group in one task, so one oversized log would pin
one executor.  ``running`` cuts every group into blocks of its order key, folds
each block to one summary row (map-side combined), carries the summaries over
the blocks, and scans inside the blocks.  The largest unit any task sorts is one
block, or the list of one group's block summaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running value: ``last``/``first`` non-null, ``sum``, ``max`` or ``min`` of ``value``."""

    kind: str
    value: Column
    inclusive: bool = True


def last(value: Column, inclusive: bool = True) -> Running:
    return Running("last", value, inclusive)


def first(value: Column, inclusive: bool = True) -> Running:
    return Running("first", value, inclusive)


def total(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def lowest(value: Column, inclusive: bool = True) -> Running:
    return Running("min", value, inclusive)


def line_block(block_lines: int, column: str = "line_number") -> Column:
    """Block of a line number: line numbers are unique per log, which bounds the block."""
    return F.floor(F.col(column) / F.lit(block_lines)).cast("bigint")


def _summary(spec: Running, order: Column, descending: bool) -> Column:
    if spec.kind in ("last", "first"):
        at = F.when(spec.value.isNotNull(), order)
        pick_latest = (spec.kind == "last") != descending
        return (F.max_by if pick_latest else F.min_by)(spec.value, at)
    return {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](spec.value)


def _over(kind: str, value: Column, window) -> Column:
    if kind in ("last", "first"):
        return getattr(F, kind)(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "first":
        return F.coalesce(carried, local)
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return {"max": F.greatest, "min": F.least}[kind](carried, local)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    specs: dict[str, Running],
    descending: bool = False,
) -> DataFrame:
    """Adds one column per spec, scanning each group of ``keys`` in ``order``.

    ``block`` must not decrease along ``order`` and must bound the rows of one
    (group, block).  Keys must not be null.
    """
    direction = F.desc if descending else F.asc
    blocked = df.withColumn(_BLOCK, block)
    order_struct = F.struct(*order)
    summaries = blocked.groupBy(*keys, _BLOCK).agg(
        *[_summary(spec, order_struct, descending).alias(f"__sum_{name}") for name, spec in specs.items()]
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(direction(_BLOCK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = summaries.select(
        *keys,
        _BLOCK,
        *[
            _over(spec.kind, F.col(f"__sum_{name}"), across).alias(f"__carry_{name}")
            for name, spec in specs.items()
        ],
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*[direction(c) for c in order])
    joined = blocked.join(carries, [*keys, _BLOCK], "left")
    columns = {}
    for name, spec in specs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        columns[name] = _combine(spec.kind, F.col(f"__carry_{name}"), _over(spec.kind, spec.value, frame))
    return joined.select(*df.columns, *[c.alias(n) for n, c in columns.items()])
