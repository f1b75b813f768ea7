"""Finding every window that also starts earlier, without shuffling windows or documents.

Shared by the two substring operators; they differ in what a unit is (a byte, a
word) and in how equal windows are told (``Scheme.classes``).

1. Documents are packed, where they lie, into compressed blocks, stored once.
2. Every window has an anchor, the gram of the lowest hash inside it, so equal
   windows have equal anchors. A block sends its distinct anchors, hashed into
   buckets; a bucket answers each block with those that some other place has too.
   A common anchor costs a block one entry, however often it stands there.
3. A maximal run of windows with one recurring anchor is a passage. A block sends
   each distinct passage once, to the shard of its anchor. Anchors with more than
   ``hot`` places send single windows, spread by content.
4. A shard tells equal windows apart exactly, by content, and answers with the
   ranges whose windows start earlier elsewhere (smaller doc_id, then start).
5. Blocks drop the answered ranges.

Windows never cross documents. Null ids sort last. Rows of one doc_id are one
document for the order: equal places do not remove each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.llm.common import encoded, staged

BLOCK_BYTES = 4 << 20
#: Text bytes whose anchors meet in a bucket, and whose passages meet in a shard.
BUCKET_BYTES, SHARD_BYTES = 96 << 20, 8 << 20
HOT = 50_000
_NO_ID = (1 << 63) - 1
_CHUNK = 1 << 16
_PLACE = np.uint64((1 << 17) - 1)


@dataclass
class Units:
    """A block's texts as units: ``data`` holds unit i at [begins[i], ends[i]), hashed to ``hashes``; document d has [bounds[d], bounds[d + 1])."""

    data: bytes
    begins: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


@dataclass(frozen=True)
class Scheme:
    """``width`` units to a window, ``gram`` to an anchor; ``width - gram + 1`` is a power of two.

    ``classes(contents, sizes, times)`` numbers the windows of distinct passages,
    one after another: equal numbers for equal windows. ``drop(data, begins, ends,
    removed)`` is what is left of a document.
    """

    width: int
    gram: int
    units: Callable[[list[bytes]], Units]
    classes: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
    drop: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], bytes]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_ODD = 0xD6E8FEB86659FD93
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of an odd number and of its inverse modulo 2^64.
POWERS, INVERSE = _powers(_ODD, _CHUNK + 4096), _powers(pow(_ODD, -1, 1 << 64), _CHUNK + 4096)


def anchors(units: Units, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor value, first and last window start of every run of windows that share an anchor place."""
    h, span = units.hashes, width - gram + 1
    stop = np.repeat(units.bounds[1:], np.diff(units.bounds))  # of the document that a unit stands in
    out = []
    for at in range(0, len(h) - width + 1, _CHUNK):
        part = h[at : at + _CHUNK + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * POWERS[: len(part)], out=sums[1:])
        value = mixed((sums[gram:] - sums[:-gram]) * INVERSE[: len(part) - gram + 1])
        low = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64)
        step = 1
        while step < span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        place = (low & _PLACE).astype(np.int64)
        valid = np.arange(at, at + len(place)) + width <= stop[at : at + len(place)]
        turn = np.flatnonzero(np.diff(np.where(valid, place, -1), prepend=-1) != 0)
        last = np.append(turn[1:], len(place)) - 1
        turn, last = turn[valid[turn]], last[valid[turn]]
        out.append((value[place[turn]], turn + at, last + at))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, sizes and the compressed texts, documents of a block in the order of their ids."""

    def row(block, held):
        held.sort(key=lambda x: _NO_ID if x[0] is None else x[0])
        ids, texts = zip(*held, strict=True)
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        columns = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "data"])

    def run(batches):
        block, held, total = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, text))
                total += len(text)
                if total >= size:
                    yield row(block, held)
                    block, held, total = block + 1, [], 0
        if held:
            yield row(block, held)

    rows = docs.select(F.col("doc_id").cast("long"), encoded(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "block long, ids array<long>, sizes array<long>, data binary")


def _texts(sizes: list[int], data: bytes) -> list[bytes]:
    plain = zstandard.ZstdDecompressor().decompress(data, max_output_size=sum(sizes) + 1)
    cuts = np.cumsum([0, *sizes]).tolist()
    return [plain[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _packed_counts(times: np.ndarray) -> bytes:
    """A byte a count; counts from 255 follow in full, in their order."""
    return np.minimum(times, 255).astype(np.uint8).tobytes() + times[times >= 255].astype(np.uint32).tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.uint32)
    return out


def _sent_anchors(scheme: Scheme, buckets: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                value = anchors(scheme.units(_texts(r["sizes"], r["data"])), scheme.width, scheme.gram)[0]
                value, times = np.unique(value, return_counts=True)
                bucket = (value >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                rows = [(b, r["block"], value[order[i:j]].tobytes(), _packed_counts(times[order[i:j]])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "anchors", "times"])

    return run


def _recurring(hot: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, np.uint64) for x in part["anchors"]]
        cuts = np.cumsum([0, *map(len, each)])
        value = np.concatenate(each)
        order = np.argsort(value, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(value[order]) != 0))
        times = np.concatenate([_counts(x, len(own)) for x, own in zip(part["times"], each, strict=True)])
        total = np.add.reduceat(times[order], starts)
        of = np.empty(len(value), np.int64)
        of[order] = np.repeat(total, np.diff(np.append(starts, len(value))))
        rows = []
        for block, i, j in zip(part["block"], cuts[:-1], cuts[1:], strict=True):
            own, n = value[i:j], of[i:j]
            rows.append((block, own[(n > 1) & (n <= hot)].tobytes(), own[n > hot].tobytes()))
        return pd.DataFrame(rows, columns=["block", "common", "hot"])

    return run


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    among = np.sort(among)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


_PASSAGES = "shard int, block long, anchors array<long>, ids array<long>, starts array<long>, places array<long>, windows array<int>, sizes array<int>, content binary, cut_at array<long>, cut_size array<long>"


def _sent_passages(scheme: Scheme, shards: int):
    """A row for each shard: the block's distinct passages, and ranges that an equal passage of the block precedes."""
    names = ["anchors", "ids", "starts", "places", "windows", "sizes", "content", "cut_at", "cut_size"]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                units = scheme.units(_texts(r["sizes"], r["data"]))
                value, first, last = anchors(units, scheme.width, scheme.gram)
                hot = _member(value, np.frombuffer(b"".join(r["hot"]), np.uint64))
                some = np.flatnonzero(hot | _member(value, np.frombuffer(b"".join(r["common"]), np.uint64)))
                doc = np.searchsorted(units.bounds, first[some], side="right") - 1
                ids = [_NO_ID if x is None else x for x in r["ids"]]
                out: dict[int, list[list]] = {}
                seen: dict[tuple, tuple] = {}
                begins, ends, data, width = units.begins, units.ends, units.data, scheme.width
                low, high = begins[first[some]].tolist(), ends[last[some] + width - 1].tolist()
                for at, d, a, b, g, e, i, j in zip(some.tolist(), doc.tolist(), low, high, value[some].view(np.int64).tolist(), last[some].tolist(), first[some].tolist(), hot[some].tolist(), strict=True):
                    parts = [(data[a:b], i, e - i + 1)] if not j else [(data[begins[s] : ends[s + width - 1]], s, 1) for s in range(i, e + 1)]
                    for text, s, n in parts:
                        shard = (g >> 3) % shards if not j else _spread(text) % shards
                        lists = out.get(shard) or out.setdefault(shard, [[] for _ in names])
                        place = (ids[d], s - int(units.bounds[d]))
                        before = seen.setdefault((g, text), place)
                        if before < place:
                            lists[7].append(s)
                            lists[8].append(n + width - 1)
                        else:
                            for k, v in enumerate((g, *place, s, n, len(text), text)):
                                lists[k].append(v)
                pack = zstandard.ZstdCompressor(level=3).compress
                rows = [(shard, r["block"], *lists[:6], pack(b"".join(lists[6])), *lists[7:]) for shard, lists in out.items()]
                if rows:
                    long = pa.list_(pa.int64())
                    kinds = [pa.int32(), pa.int64(), long, long, long, long, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), long, long]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "block", *names])

    return run


def _spread(text: bytes) -> int:
    import zlib

    return zlib.crc32(text)


def _earlier(ids: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at a smaller (id, start)."""
    order = np.lexsort((starts, ids, classes))
    c, i, s = classes[order], ids[order], starts[order]
    head = np.append(True, c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))
    out = np.empty(len(c), bool)
    out[order] = (i != i[first]) | (s != s[first])
    return out


def _answered(scheme: Scheme, batch_bytes: int = 1 << 20):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        flat = lambda name, kind=np.int64: np.concatenate([np.asarray(x, kind) for x in part[name]])
        n = [len(x) for x in part["anchors"]]
        g, ids, starts, places, windows, sizes = map(flat, ("anchors", "ids", "starts", "places", "windows", "sizes"))
        row = np.repeat(np.arange(len(part)), n)
        unpack = zstandard.ZstdDecompressor().decompress
        content, cuts = b"".join([unpack(x) for x in part["content"]]), np.cumsum(np.append(0, sizes))
        cut_at, cut_size = [list(x) for x in part["cut_at"]], [list(x) for x in part["cut_size"]]
        order = np.argsort(g, kind="stable")
        volume = np.cumsum(sizes[order])
        at = 0
        while at < len(order):  # a batch ends between two anchors
            to = int(np.searchsorted(volume, (volume[at - 1] if at else 0) + batch_bytes, side="right"))
            to = max(to, at + 1)
            to = int(np.searchsorted(g[order], g[order[to - 1]], side="right"))
            own = order[at:to]
            at = to
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(content[cuts[k] : cuts[k + 1]], len(number)) for k in own.tolist()])
            times = np.bincount(which)
            if len(number) == len(own) == 1:
                continue
            held = np.zeros(len(number), np.int64)
            held[which] = windows[own]
            classes = scheme.classes(list(number), held, times)
            base = np.cumsum(held) - held
            entry = np.repeat(np.arange(len(own)), windows[own])
            nth = np.arange(len(entry)) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
            late = _earlier(ids[own][entry], starts[own][entry] + nth, classes[base[which][entry] + nth])
            hit = np.flatnonzero(late)
            if not len(hit):
                continue
            begin = hit[np.append(True, (np.diff(hit) > 1) | (np.diff(entry[hit]) > 0))]
            end = hit[np.append((np.diff(hit) > 1) | (np.diff(entry[hit]) > 0), True)]
            for k, a, b in zip(own[entry[begin]].tolist(), nth[begin].tolist(), nth[end].tolist(), strict=True):
                cut_at[row[k]].append(int(places[k]) + a)
                cut_size[row[k]].append(b - a + scheme.width)
        return pd.DataFrame({"block": part["block"], "cut_at": cut_at, "cut_size": cut_size})

    return run


def _dropped(scheme: Scheme):
    import hashlib

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                units = scheme.units(_texts(r["sizes"], r["data"]))
                step = np.zeros(len(units.hashes) + 1, np.int32)
                for at, size in zip(r["cut_at"] or (), r["cut_size"] or (), strict=True):
                    at, size = np.asarray(at, np.int64), np.asarray(size, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + size, -1)
                gone = np.cumsum(step[:-1]) > 0
                rows = []
                for doc, a, b in zip(r["ids"], units.bounds[:-1].tolist(), units.bounds[1:].tolist(), strict=True):
                    out = gone[a:b]
                    n = int(out.sum())
                    spans = int((np.diff(out.astype(np.int8), prepend=0) > 0).sum()) if n else 0
                    left = scheme.drop(units.data, units.begins[a:b], units.ends[a:b], out)
                    rows.append((doc, b - a, n, spans, hashlib.sha256(left).hexdigest(), left))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def removed(docs: DataFrame, scheme: Scheme, hot: int = HOT, block_bytes: int = BLOCK_BYTES, kept: bool = True) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row of ``docs``."""
    stored = staged(blocks(docs, block_bytes))
    size = stored.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, shards = max(spread, -(-size // BUCKET_BYTES)), max(spread, -(-size // SHARD_BYTES))
    sent = stored.mapInArrow(_sent_anchors(scheme, buckets), "bucket int, block long, anchors binary, times binary")
    common = sent.groupBy("bucket").applyInPandas(_recurring(hot), "block long, common binary, hot binary")
    asked = common.groupBy("block").agg(F.collect_list("common").alias("common"), F.collect_list("hot").alias("hot"))
    passages = stored.join(asked, "block").select("block", "ids", "sizes", "data", "common", "hot").mapInArrow(_sent_passages(scheme, shards), _PASSAGES)
    answers = passages.groupBy("shard").applyInPandas(_answered(scheme), "block long, cut_at array<long>, cut_size array<long>")
    ranges = answers.where(F.size("cut_at") > 0).groupBy("block").agg(F.collect_list("cut_at").alias("cut_at"), F.collect_list("cut_size").alias("cut_size"))
    whole = stored.join(ranges, "block", "left").select("ids", "sizes", "data", "cut_at", "cut_size")
    out = whole.mapInArrow(_dropped(scheme), "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if kept else out.drop("kept")
