"""Prefix trie of conversations by depth-band rollup.

A node is a distinct sequence of first turns. Its key is the running XOR of the
hashes of (position, turn) in two 64-bit lanes, so keys come from block sums and
no task walks a whole conversation. Nodes are cut into *bands* of ``BAND``
depths. A node's amounts go to its ancestors of the same band only (at most
``BAND`` of them); the completed totals of the bands' roots then go to the
ancestors in the band above. Band roots form a trie of a ``BAND``-th of the depth,
which is rolled up in the same way, so D depths take log D / log BAND rounds.

No step orders a conversation in one task: turns are sorted by range, positions
follow from the sizes of the sorted parts, and members of a node are hashed from
strings of at most ``CHUNK`` ids each.

Defined cases: rows go by turn, role, text, nulls first; null roles and texts are
empty; rows without a conv_id are no conversation; repeated rows are turns of their
own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.common import staged

__all__ = ["nodes", "rebuilt"]

BAND = 8
#: Ids of conversations that are written into one string.
CHUNK = 4096
_KEY = ["depth", "x", "y"]


def _floored(c: Column | str, by: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(by)).cast("long")


def _positions(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, k, a, b, size, own, took): the turns in order, hashed, with how many turns a conversation takes from another; (conv_id, took, length)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    said = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    ordered = said.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    hashed = ordered.select(
        "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("long").alias("size"),
        F.monotonically_increasing_id().alias("place"),  # follows the order over all parts
    )
    turns = staged(hashed.withColumn("part", F.shiftright("place", 33).cast("int")))

    runs = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("own"))
    bases = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.withColumn("base", F.expr("conv_id - conv_id % 100")).join(bases, "base", "left")
    convs = staged(convs.withColumn("took", F.least("own", F.coalesce("n_base", F.lit(0)))))
    held = runs.join(convs.select("conv_id", "own", "took"), "conv_id")
    placed = turns.join(held, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") - F.col("first") + F.col("before") + 1).alias("k"), "a", "b", "size", "own", "took"
    )
    length = F.col("took") + F.greatest(F.col("n") - F.col("own"), F.lit(0))
    return staged(placed), convs.select("conv_id", "base", "took", length.alias("length"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, a, b, size) of every turn of the rebuilt conversations, and (conv_id, length)."""
    turns, convs = _positions(conversations)
    own = turns.where("k > own").select("conv_id", (F.col("k") - F.col("own") + F.col("took")).alias("depth"), "a", "b", "size")
    shared = turns.where("conv_id % 100 = 0 and k <= 5").select(F.col("conv_id").alias("base"), F.col("k").alias("depth"), "a", "b", "size")
    taken = convs.where("took > 0").select("conv_id", "base", "took").join(shared, "base").where("depth <= took").select("conv_id", "depth", "a", "b", "size")
    return own.unionByName(taken), convs.select("conv_id", "length")


def _bands(rows: DataFrame) -> DataFrame:
    """(conv_id, band, keys, up): the keys (i, x, y) of a band of a conversation, and those of the band above."""
    bands = rows.groupBy("conv_id", _floored("i", BAND).alias("band")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("keys"))
    return _with_up(staged(bands))


def _with_up(bands: DataFrame) -> DataFrame:
    above = bands.select("conv_id", (F.col("band") + 1).alias("band"), F.col("keys").alias("up"))
    return bands.join(above, ["conv_id", "band"], "left")


def _keyed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """As ``_bands``, with ``sizes``, from hashed turns: keys are running XORs, carried from band to band."""
    hashed = turns.select(
        "conv_id", "depth", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", F.lit(2), "depth", "a").alias("y"), "size"
    )
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), none.alias("x"), none.alias("y"), none.alias("size"))
    bands = staged(
        hashed.unionByName(roots).groupBy("conv_id", _floored("depth", BAND).alias("band")).agg(
            F.sort_array(F.collect_list(F.struct("depth", "x", "y", "size"))).alias("own"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
        )
    )
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = bands.select("conv_id", "band", *[F.coalesce(F.bit_xor(c).over(before), none).alias(f"before_{c}") for c in "xy"])
    xor = lambda c, upto: F.aggregate(F.slice("own", F.lit(1), upto), F.col(f"before_{c}"), lambda z, t: z.bitwiseXOR(t[c]))
    keys = F.transform("own", lambda t, at: F.struct(t["depth"].alias("i"), xor("x", at + 1).alias("x"), xor("y", at + 1).alias("y")))
    keyed = bands.join(carried, ["conv_id", "band"]).select("conv_id", "band", keys.alias("keys"), F.col("own.size").alias("sizes"))
    return _with_up(staged(keyed))


def _summed(rows: DataFrame, over: str, step: int) -> DataFrame:
    """Leaves and saved tokens of ``rows``, added up over the keys in their column ``over``."""
    each = rows.select(F.explode(over).alias("to"), "leaves", "saved")
    return each.groupBy((F.col("to.i") * step).alias("depth"), F.col("to.x").alias("x"), F.col("to.y").alias("y")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _attached(nodes: DataFrame, bands: DataFrame, step: int) -> DataFrame:
    """``nodes`` with the keys of their ancestors in their band, themselves included, and for a band's root those of the band above."""
    i = _floored("depth", step)
    found = nodes.withColumn("i", i).withColumn("band", _floored("i", BAND)).join(bands.withColumnRenamed("conv_id", "least"), ["least", "band"])
    inside = F.slice("keys", F.lit(1), (F.col("i") - F.col("band") * BAND + 1).cast("int"))
    return found.select(*nodes.columns, "i", inside.alias("inside"), F.when(F.col("i") % BAND == 0, F.col("up")).alias("up"))


def _rolled_up(amounts: DataFrame, bands: DataFrame, deepest: int) -> DataFrame:
    """Subtree sums of ``leaves`` and ``saved`` of every node; ``amounts`` also has ``least`` and the level's ``inside`` and ``up``."""
    step, levels = 1, []
    while True:
        inside = staged(_summed(amounts, "inside", step))
        levels.append((step, amounts, inside))
        if deepest // step < BAND:
            break
        step *= BAND
        roots = bands.select("conv_id", F.explode("keys").alias("key")).where(F.col("key.i") % BAND == 0)
        bands = _bands(roots.select("conv_id", (F.col("key.i") / BAND).cast("long").alias("i"), "key.x", "key.y"))
        tops = amounts.where(F.col("i") % BAND == 0).select(*_KEY, "least").join(inside, _KEY)
        amounts = staged(_attached(tops, bands, step))
    full = levels.pop()[2]
    for step, amounts, inside in reversed(levels):
        roots = amounts.where(F.col("up").isNotNull()).select(*_KEY, "up").join(full, _KEY)
        full = staged(inside.unionByName(_summed(roots, "up", step)).groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    return full


def _ends(bands: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node, where any does."""
    last = convs.select("conv_id", "length", _floored("length", BAND).alias("band"))
    key = F.element_at("keys", (F.col("length") - F.col("band") * BAND + 1).cast("int"))
    at = bands.join(last, ["conv_id", "band"]).select(F.col("length").alias("depth"), key["x"].alias("x"), key["y"].alias("y"), "conv_id")
    chunks = at.groupBy(*_KEY, _floored("conv_id", CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    written = chunks.select(*_KEY, "chunk", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if row[:3] == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = row[:3], hashlib.sha256()
                digest.update(row[4].encode())
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if key is not None:
            yield _rows([*out, (*key, digest.hexdigest())])

    return written.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [*_KEY, "ends_sha256"])


def nodes(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations)
    bands = staged(_keyed(turns, convs))
    each = bands.select("conv_id", F.explode(F.arrays_zip("keys", "sizes")).alias("t")).select(
        "conv_id", F.col("t.keys.i").alias("depth"), F.col("t.keys.x").alias("x"), F.col("t.keys.y").alias("y"), F.col("t.sizes").alias("size")
    )
    found = each.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), F.min("size").alias("size"))
    met = _attached(found, bands.drop("sizes"), 1)
    parent = F.when(F.size("inside") > 1, F.element_at("inside", -2)).otherwise(F.element_at("up", -1))
    met = staged(met.withColumn("parent", F.when(F.col("depth") > 0, parent)))

    kids = met.where("depth > 0").groupBy(F.col("parent.i").alias("depth"), F.col("parent.x").alias("x"), F.col("parent.y").alias("y")).agg(F.count("*").alias("n_children"))
    grown = met.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("size")
    amounts = staged(grown.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", saved))
    deepest = amounts.agg(F.max("depth")).first()[0] or 0
    full = _rolled_up(amounts.select(*_KEY, "least", "i", "inside", "up", "leaves", "saved"), bands.select("conv_id", "keys"), deepest)

    parents = met.select(F.col("depth").alias("pd"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("least").alias("parent_conv_id"))
    mine = amounts.select(*_KEY, "least", "n_convs", "n_children", F.col("parent.i").alias("pd"), F.col("parent.x").alias("px"), F.col("parent.y").alias("py"))
    out = mine.join(full, _KEY).join(_ends(bands, convs), _KEY, "left").join(parents, ["pd", "px", "py"], "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
