"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its
three-word shingles. Two fingerprints link at ``radius`` or fewer differing bits.

Covering masks: every bit position gets a non-zero vector of ``radius + 1`` bits;
for each non-zero ``v`` the table ``v`` looks only at the positions whose vector
has odd product with ``v``. ``radius`` differing positions span at most ``radius``
dimensions, so some ``v`` is orthogonal to all of them and its table sees none of
the differences: every pair within the radius collides in some table, whatever
the bits. A bucket larger than ``bucket`` fingerprints is split by a further set
of masks over the bits that it does not fix yet. That loses no pair either, and
ends, because a bucket with b free bits holds at most 2^b fingerprints.

Inside a bucket only a spanning star of each linked set is emitted. Components
come from alternating large-star and small-star rounds over written tables.

Defined cases: a null or wordless text has fingerprint 0 and links like any
other; under three words the whole sequence is the one shingle; equal rows share
a component; null ids never name a component unless it has no other id.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraylens.llm.common import encoded, staged, with_columns_in_arrow

BITS, RADIUS, SEED = 64, 3, 42
FINGERPRINT_TYPE = T.StructType([T.StructField("fingerprint", T.LongType())])


def _majority(hashes: np.ndarray) -> int:
    """Signed 64-bit majority of unsigned hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return _majority(np.array([hashed(joined, SEED)], np.uint64))
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:-width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return _majority(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)), np.uint64, len(stops)))


def fingerprints(docs: DataFrame, under: str = "simhash") -> DataFrame:
    """``docs`` with a struct column that holds the fingerprint as a signed long."""
    return with_columns_in_arrow(docs, encoded(F.col("text")), FINGERPRINT_TYPE, lambda texts: [[fingerprint(t) for t in texts]], under)


def covering_masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """2^(radius+1) - 1 signed 64-bit masks; another ``level`` deals the vectors out anew."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    random.Random(1000 + level).shuffle(vectors)
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(root, member) for every value that links, through others, to a smaller one."""
    left, out = np.unique(values), []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left.view(np.uint64) ^ np.array(queue.pop(), np.int64).view(np.uint64)) <= radius
            found, left = left[near], left[~near]
            out += [(int(root), int(x)) for x in found]
            queue.extend(found)
    return out


def _links(radius: int):
    def run(batches):
        for batch in batches:
            pairs = {p for values in batch.column(0) for p in _stars(np.array(values.values.to_numpy(zero_copy_only=False), np.int64), radius)}
            roots, members = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(members, pa.int64())], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = 1024) -> DataFrame:
    """Edges (a < b) over distinct fingerprints ``fp`` that connect what links within ``radius``."""
    rows = nodes.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("fixed"))
    level, out = 0, None
    while True:
        masks = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).alias("mask")) for i, m in enumerate(covering_masks(radius, level), 1)])
        rows = rows.select("fp", "path", "fixed", F.explode(masks).alias("m")).select(
            "fp", (F.col("path") * 16 + F.col("m.table")).alias("path"), F.col("fixed").bitwiseOR(F.col("m.mask")).alias("fixed")
        )
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("fixed")))
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = staged(rows.join(sizes, ["path", "key"]).select("fp", "path", "fixed", "key", "n"))
        small = shared.where(F.col("n") <= bucket).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found = small.select("fps").mapInArrow(_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        rows = shared.where(F.col("n") > bucket).select("fp", "path", "fixed")
        level += 1
        if rows.isEmpty():
            return out.distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge that is not its component's smallest node itself."""

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        joined = e.join(least, F.col("b") == F.col("k"))
        moved = joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return moved.unionByName(least.select(F.col("m").alias("a"), F.col("k").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    now = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = state(now)
    while seen[0]:
        now = staged(small(large(now)))
        at = state(now)
        if at == seen:
            break
        seen = at
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def components(docs: DataFrame, radius: int = RADIUS, bucket: int = 1024) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id and whether the row stands for its component.

    ``doc_id`` with ``text_hash`` names a row of ``docs``; rows equal in both are
    one here as there. ``stands`` holds for one (doc_id, text_hash) a component.
    """
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    rows = fingerprints(keyed).select("doc_id", "text_hash", F.col("simhash.fingerprint").alias("fp"))
    rows = staged(rows)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = staged(rows.groupBy("fp").agg(F.min(order).alias("least")))
    rooted = nodes.join(stars(links(nodes, radius, bucket)), F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of_fp = staged(rooted.join(named, "root").select(F.col("fp").alias("at"), "first"))
    joined = rows.join(of_fp, F.col("fp") == F.col("at"))
    return joined.select(
        "doc_id", "text_hash", hex16(F.col("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stands"),
    )
