"""Benchmark decontamination by Wu-Manber search over words.

Benchmark items become windows of ten words (an item of fewer words is one
window). The windows are compiled into one table a length: a *block* is a pair
of neighbouring words; ``shift`` says how far the search may jump when a pair ends
at the current place; a pair that ends a window selects that window's bucket by
its *prefix* pair, and a direct comparison of all words confirms the occurrence.

The benchmark is cut into shards of about ``SHARD`` bytes (a long item is cut into
parts), so that what is broadcast at once does not grow with it; documents stream
through the shards one after another, without a shuffle.

Defined cases: null texts have no words and hit nothing; a null item_id counts as
the empty string; rows that repeat an item_id are one item; empty tables give no
rows, or no hits; extra columns pass by; long texts are read in segments.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraylens.llm.common import encoded, staged, with_columns_in_arrow

__all__ = ["Patterns", "contaminated", "windows"]

WINDOW = 10
#: Bytes of a shard of the benchmark, words of a part of an item, and shards that documents pass in one stage.
SHARD, _PART, CHAIN = 1 << 20, 10_000, 4
_SEGMENT = 1 << 17
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def segments(text: bytes) -> Iterator[list[bytes]]:
    text = text.translate(_PLAIN)
    at = 0
    while at < len(text):
        to = at + _SEGMENT
        to = text.find(b" ", to) if to < len(text) else -1
        yield text[at : to if to >= 0 else len(text)].split()
        at = to if to >= 0 else len(text)


def windows(text: bytes) -> list[tuple[bytes, ...]]:
    words = [w for part in segments(text) for w in part]
    if len(words) <= WINDOW:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


class _Table:
    """Wu-Manber tables of windows of one length."""

    def __init__(self, size: int):
        self.size, self.shift, self.buckets = size, {}, defaultdict(lambda: defaultdict(list))

    def put(self, ids: tuple[int, ...], pattern: int) -> None:
        for end in range(1, self.size):
            pair, jump = (ids[end - 1], ids[end]), self.size - 1 - end
            if jump < self.shift.get(pair, self.size - 1):
                self.shift[pair] = jump
        self.buckets[ids[-2:]][ids[:2]].append((ids, pattern))

    def find(self, ids: list[int], first: int) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence that ends at ``first`` or later."""
        if self.size == 1:
            for at in range(first, len(ids)):
                for _, pattern in self.buckets[(ids[at],)][(ids[at],)] if (ids[at],) in self.buckets else ():
                    yield at, pattern
            return
        shift, jump, at, n = self.shift.get, self.size - 1, max(first, self.size - 1), len(ids)
        while at < n:
            by = shift((ids[at - 1], ids[at]), jump)
            if by:
                at += by
                continue
            start = at - self.size + 1
            for held, pattern in self.buckets[(ids[at - 1], ids[at])].get((ids[start], ids[start + 1]), ()):
                if all(ids[start + k] == held[k] for k in range(self.size)):
                    yield start, pattern
            at += 1


class Patterns:
    """The windows of a shard: ``rows`` holds (item, window) pairs."""

    def __init__(self, rows: list[tuple[str, tuple[bytes, ...]]]):
        self.words: dict[bytes, int] = {}
        self.tables: dict[int, _Table] = {}
        self.items: list[set[str]] = []
        known: dict[tuple, int] = {}
        for item, window in rows:
            ids = tuple(self.words.setdefault(w, len(self.words) + 1) for w in window)
            if ids not in known:
                known[ids] = len(self.items)
                self.items.append(set())
                self.tables.setdefault(len(ids), _Table(len(ids))).put(ids, known[ids])
            self.items[known[ids]].add(item)

    def search(self, text: bytes) -> tuple[int, list[int], list[int], list[str]]:
        """Number of words of a text, begins and ends of its merged hit places, and the items that occur."""
        known, base, kept, spans, items = self.words.get, 0, [], [], set()
        for words in segments(text):
            ids = kept + [known(w, 0) for w in words]
            new, begin = len(kept), base - len(kept)
            for size, table in self.tables.items():
                for start, pattern in table.find(ids, new):
                    if spans and start + begin <= spans[-1][1] and spans[-1][0] <= start + begin:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], begin + start + size))
                    else:
                        spans.append((begin + start, begin + start + size))
                    items |= self.items[pattern]
            base += len(words)
            kept = ids[max(0, len(ids) - WINDOW + 1) :]
        hit = merged(spans)
        return base, hit[::2], hit[1::2], sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_LONGS, _STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_PARTS = T.StructType([T.StructField("texts", _STRINGS), T.StructField("sizes", _LONGS)])
_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("begins", _LONGS), T.StructField("ends", _LONGS), T.StructField("items", _STRINGS)])


def _parted(texts: list[bytes]) -> tuple[list[list[str]], list[list[int]]]:
    """Texts in parts that share the words of a window less one, and what each part weighs."""
    parts = []
    for text in texts:
        words = [w for part in segments(text) for w in part]
        parts.append([b" ".join(words[i : i + _PART + WINDOW - 1]) for i in range(0, max(1, len(words) - WINDOW + 1), _PART)] if words else [])
    return [[p.decode() for p in own] for own in parts], [[len(p) for p in own] for own in parts]


def _shards(benchmark: DataFrame) -> DataFrame:
    """Rows (shard, item, text) of about ``SHARD`` bytes a shard."""
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    parts = with_columns_in_arrow(source, encoded(F.col("text")), _PARTS, _parted)
    parts = staged(parts.select("item", F.explode(F.arrays_zip(F.col("added.texts").alias("text"), F.col("added.sizes").alias("size"))).alias("part")).select("item", "part.*"))
    total = parts.agg(F.sum("size")).first()[0] or 0
    return staged(parts.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(-(-total // SHARD) or 1))))


_COMPILED: dict[str, Patterns] = {}


def _compiled(shard: str, sent: Broadcast) -> Patterns:
    """The tables of the shard that a worker used last."""
    if shard not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[shard] = Patterns([(item, w) for item, text in sent.value for w in windows(text.encode())])
    return _COMPILED[shard]


def contaminated(docs: DataFrame, benchmark: DataFrame, under: str = "leak") -> DataFrame:
    """``docs`` with one more struct: n_words, n_hit, items (sorted ids of the items that occur), spans of hit words by shard."""
    spark, names = docs.sparkSession, docs.columns
    shards = _shards(benchmark)
    numbers = [r[0] for r in shards.select("shard").distinct().orderBy("shard").collect()] or [None]
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = docs.select(
        F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"), none("long").alias("begins"), none("long").alias("ends"), none("string").alias("items")
    )
    for done, number in enumerate(numbers, 1):
        sent = spark.sparkContext.broadcast([tuple(r) for r in shards.where(F.col("shard") == number).select("item", "text").collect()])

        def search(texts: list[bytes], shard: str = uuid.uuid4().hex, sent: Broadcast = sent) -> list[list]:
            patterns = _compiled(shard, sent)
            return [list(column) for column in zip(*map(patterns.search, texts), strict=True)]

        found = with_columns_in_arrow(out, encoded(F.col("row.text")), _HITS, search)
        more = lambda c: F.concat(c, F.col("added").getField(c)).alias(c)
        out = found.select("row", "added.n_words", more("begins"), more("ends"), F.array_distinct(F.concat("items", "added.items")).alias("items"))
        if done % CHAIN == 0 and done < len(numbers):
            out = staged(out)
    spans = F.array_sort(F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")))
    start = F.struct(F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("n"))
    longer = lambda x, s: F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(x["reached"], s["begin"]))
    n_hit = F.aggregate("spans", start, lambda x, s: F.struct(F.greatest(x["reached"], s["end"]).alias("reached"), (x["n"] + longer(x, s)).alias("n")), lambda x: x["n"])
    out = out.withColumn("spans", spans)
    leak = F.struct("n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")
    return out.select(*[F.col("row").getField(n).alias(n) for n in names], leak.alias(under))
