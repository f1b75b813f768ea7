"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token pieces of at most ``capacity``. Only their lengths reach
the driver, as a histogram of at most ``capacity`` entries. A configuration is a
multiset of lengths that fits a sequence; the program uses as few configurations
as cover the histogram. Multiplicative weights keep a price per length, which
grows while the length lags behind the others; the pricing problem, the best
configuration at these prices, is a knapsack solved by dynamic programming over
the capacity. Each priced configuration gets a share of what its scarcest length
still allows, rounded down to whole sequences, until every length is used up.

Pieces find their places without meeting in one task: a piece's rank within its
length, from counts by hash bucket and row numbers inside buckets, falls into one
of the ranges that the program gave to its length.

Defined cases: a null text is one token, the end id 0; repeated rows are pieces of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.common import encoded, staged

CAPACITY = 2048
END_ID = 0
#: Pieces that a hash bucket of one length holds on average at most, were all of one length.
BUCKET_ROWS = 200_000
#: Words of the younger and of the older generation that a worker remembers, each.
_WORDS_KEPT = 450_000
#: New words that are encoded as one text.
_LEARNT = 2_000
#: Text whose words are looked up at once.
_TEXT_BYTES = 8_000_000
#: ASCII punctuation.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _WordIds(dict):
    """Little-endian ids of white-space separated words. No token spans white space, so words are looked up apart."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        # Whether an id closes a word; unknown where some letter has no id that does.
        vocab, suffix = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = None
        if suffix and all(c + suffix in vocab for c in ByteLevel.alphabet()):
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def of(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. Arrow cuts the texts and counts their words; Python sees a word of a batch once."""
        if len(self) > _WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        cut = pc.ascii_split_whitespace(texts.view(pa.string()))
        coded = cut.flatten().dictionary_encode()
        words = _folded(coded.dictionary.cast(pa.binary())).to_numpy(zero_copy_only=False).tolist()
        self._know({w for w in words if w not in self})
        known = pa.array(map(self.__getitem__, words), pa.large_binary(), size=len(words))
        found = known.take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
        ends = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in itertools.pairwise(ends)]

    def _know(self, words: set[bytes]) -> None:
        """Adds new words. Letters with ASCII punctuation behind them are encoded apart: no token spans the two."""
        parted, whole = [], set()
        for w in words:
            if w in self.older:
                self[w] = self.older[w]
                continue
            core = w.rstrip(_MARKS)
            if len(core) < len(w) and core.decode("utf-8", "replace").lower().isalpha():
                parted.append((w, core, w[len(core) :]))
                whole |= {core, w[len(core) :]}
            else:
                whole.add(w)
        for w in [w for w in whole if w in self.older]:
            self[w] = self.older[w]
        new = [(w, w.decode("utf-8", "replace")) for w in whole if w not in self]
        letters = [x for x in new if x[1].isalpha()]
        for at in range(0, len(letters), _LEARNT):
            self._learn_letters(letters[at : at + _LEARNT])
        self._learn([x for x in new if not x[1].isalpha()])
        for w, core, marks in parted:
            self[w] = self[core] + self[marks]

    def _learn_letters(self, words: list[tuple[bytes, str]]) -> None:
        """Encodes new words of letters as one text. Each ends in an id that closes a word; if all hold just one, these ids tell them apart."""
        if self.closes is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([text for _, text in words])], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(cuts) == len(words):
                self._cut(words, ids, cuts)
                return
        self._learn(words)

    def _learn(self, words: list[tuple[bytes, str]]) -> None:
        """Encodes new words as texts of many; where a token begins tells its word."""
        for at in range(0, len(words), _LEARNT):
            some = words[at : at + _LEARNT]
            found = self.tokenizer.encode(" ".join([text for _, text in some]), add_special_tokens=False)
            begins = np.array([a for a, _ in found.offsets], np.int64)
            ends = np.cumsum([len(text) + 1 for _, text in some])
            self._cut(some, np.array(found.ids, "<u4"), np.searchsorted(begins, ends, side="left").tolist())

    def _cut(self, words: list[tuple[bytes, str]], ids: np.ndarray, cuts: list[int]) -> None:
        data, last = ids.tobytes(), 0
        for (word, _), cut in zip(words, cuts, strict=True):
            self[word] = data[4 * last : 4 * cut]
            last = cut


def _folded(words: pa.Array) -> pa.Array:
    """Words without ASCII capitals, where these are lost to the vocabulary anyway.

    They are not in what could be a special token, nor before a combining mark (lead
    byte 0xCC or 0xCD): the vocabulary composes letters and marks before it
    lower-cases, and some marks compose with the small letter alone.
    """
    kept = [pc.match_substring(words, mark) for mark in (b"<|", b"\xcc", b"\xcd")]
    return pc.if_else(pc.or_(pc.or_(kept[0], kept[1]), kept[2]), words, pc.ascii_lower(words.view(pa.string())).view(pa.binary()))


#: Texts in which the parts that are looked up apart meet.
_PROBES = ["Alpha beta, gamma; delta.\nb3a. don't: x_y! (ok). z.) ", "Ünder über! x_1 (y) 3.14\tA\n b", "e\u0301 J\u030c ja?"]


def _checked(words: _WordIds) -> _WordIds:
    """Refuses a vocabulary whose tokens span words, or letters and the marks behind them, or keep ASCII capitals apart."""
    for text in _PROBES:
        whole = np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if words.of(pa.array([text.encode()]))[0] != whole:
            raise ValueError("this vocabulary does not encode words apart from each other and without regard to ASCII case")
    return words


_TOKENIZERS: dict[str, _WordIds] = {}


def _few(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Places and counts of runs of texts, of about ``_TEXT_BYTES`` or one text each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TEXT_BYTES, "right")) - at)
        yield at, n
        at += n


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        words = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, _checked(_WordIds(tokenizer)))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, n in _few(texts):  # their words are in memory at once
                rows = []
                for doc, got in zip(ids[at : at + n], words.of(texts.slice(at, n)), strict=True):
                    data = got + end
                    size = len(data) // 4
                    rows += [
                        (doc, i, s, min(capacity, size - s), zlib.crc32(data[4 * s : 4 * (s + capacity)])) for i, s in enumerate(range(0, size, capacity))
                    ]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), encoded(F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


@dataclass(frozen=True)
class Packing:
    """``configurations``: (sequences, {length: copies}); every length of the histogram is placed exactly."""

    configurations: list[tuple[int, dict[int, int]]]

    def sequences(self) -> int:
        return sum(n for n, _ in self.configurations)

    def ranges(self) -> tuple[np.ndarray, ...]:
        """Sorted arrays: length << 40 | first rank, copies, first sequence, offset; a row for each configuration and length."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for n, config in self.configurations:
            offset = 0
            for length, copies in sorted(config.items(), reverse=True):
                rows.append((length << 40 | used.get(length, 0), copies, sequence, offset))
                used[length] = used.get(length, 0) + n * copies
                offset += length * copies
            sequence += n
        return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def _priced(lengths: np.ndarray, prices: np.ndarray, capacity: int, within: float, most: int) -> list[dict[int, int]]:
    """The most valuable multisets (index -> copies) of ``lengths`` (ascending) that fit, best first.

    One table of the knapsack serves all: each multiset fixes a first length and
    takes the best rest. Those worth less than ``1 - within`` of the best are left out.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        worth = best[c - lengths[: fits[c]]] + prices[: fits[c]]
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], choice[c] = worth[i], i
        else:
            best[c] = best[c - 1]
    worth = best[capacity - lengths] + prices
    firsts = np.argsort(-worth, kind="stable")[:most]
    out = []
    for first in firsts[worth[firsts] >= worth.max() * (1 - within)].tolist():
        config, c = {first: 1}, capacity - int(lengths[first])
        while c > 0:
            i = int(choice[c])
            if i < 0:
                c -= 1
            else:
                config[i] = config.get(i, 0) + 1
                c -= int(lengths[i])
        out.append(config)
    return out


def _topped_up(config: dict[int, int], lengths: np.ndarray, left: np.ndarray, capacity: int) -> None:
    """Fills what too few copies have left open with the longest pieces that fit; the knapsack knows no such bounds."""
    space = capacity - sum(int(lengths[i]) * n for i, n in config.items())
    i = int(np.searchsorted(lengths, space, side="right")) - 1
    while i >= 0 and space >= lengths[0]:
        more = min(space // int(lengths[i]), int(left[i]) - config.get(i, 0))
        if more > 0:
            config[i] = config.get(i, 0) + more
            space -= more * int(lengths[i])
        i = min(i - 1, int(np.searchsorted(lengths, space, side="right")) - 1)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rate: float = 0.4, share: float = 0.5, within: float = 5e-4, most: int = 48) -> Packing:
    """Configurations that place every piece of the histogram.

    ``rate``: how strongly the price of a length reacts to its lag. ``share``: of
    what a configuration could still take, how much it gets at once. ``within``
    and ``most``: which configurations of one pricing are used beside the best.
    """
    lengths = np.array(sorted(n for n in histogram if n > 0), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    left, whole = demand.copy(), float((lengths * demand).sum())
    taken: dict[tuple, int] = {}
    while left.any():
        open_ = np.flatnonzero(left)
        done = 1 - float((lengths * left).sum()) / whole
        lag = done - (1 - left[open_] / demand[open_])
        # Longer pieces are harder to place late, so they carry a little more than their volume.
        prices = (lengths[open_] / capacity) ** 1.02 * np.exp(rate * lag)
        for priced in _priced(lengths[open_], prices, capacity, within, most):
            config = {int(open_[i]): n for i, n in priced.items() if left[open_[i]]}
            if len(config) < len(priced):
                continue  # another configuration of this pricing has used a length up
            config = {i: min(n, int(left[i])) for i, n in config.items()}
            _topped_up(config, lengths, left, capacity)
            room = min(int(left[i]) // n for i, n in config.items())
            times = max(1, int(share * room)) if room > 4 else room
            for i, n in config.items():
                left[i] -= n * times
            key = tuple(sorted((int(lengths[i]), n) for i, n in config.items()))
            taken[key] = taken.get(key, 0) + times
    return Packing([(n, dict(key)) for key, n in taken.items()])


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Best-fit decreasing over the histogram: pieces of a length go to the sequences with the least room that suffices, many at once."""
    groups: dict[int, list[tuple[tuple, int]]] = {capacity: []}  # by room: configurations and their sequences

    def put(room: int, config: tuple, n: int) -> None:
        if n:
            groups.setdefault(room, []).append((config, n))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left = histogram[length]
        for room in sorted(r for r in groups if length <= r < capacity):
            if not left:
                break
            for config, n in groups.pop(room):
                each = room // length
                full = min(n, left // each)
                rest = left - full * each if full < n else 0
                put(room - each * length, (*config, (length, each)), full)
                put(room - rest * length, (*config, (length, rest)) if rest else config, min(1, rest))
                put(room, config, n - full - min(1, rest))
                left -= full * each + rest
        each = capacity // length
        put(capacity - each * length, ((length, each),), left // each)
        rest = left % each
        put(capacity - rest * length, ((length, rest),), min(1, rest))
    return Packing([(n, dict(config)) for found in groups.values() for config, n in found])


def fewest(histogram: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """The program's packing, or that of best-fit decreasing where it takes fewer sequences."""
    return min(solve(histogram, capacity), best_fit_decreasing(histogram, capacity), key=lambda p: sum(n for n, _ in p.configurations))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    parts = staged(pieces(docs, tokenizer, capacity))
    n = parts.count()
    buckets = max(8, -(-n // BUCKET_ROWS))
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = staged(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    first, copies, sequence, offset = fewest(histogram, capacity).ranges()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            key = length << 40 | batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, key, side="right") - 1
            nth = key - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * length)],
                [*names, "sequence_id", "offset"],
            )

    return ranked.select(*names, F.col("rank").cast("long")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
