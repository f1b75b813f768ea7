"""Phrase collocations by HAT-trie counting.

A first pass counts words. A phrase occurs at most as often as each of its words,
so a word below the threshold ends the phrases around it, and single words need no
trie. In the second pass every word occurrence starts a path: its phrase of up to
five words, cut at the piece's end and at rare words. A task streams its texts into a
trie of word ids (``HatTrie``): a shallow trie whose leaves are hash containers from
the rest of a path to its count; a container that grows beyond ``BURST`` paths
bursts into containers of next words. When the trie is full, whole subtrees leave it
as sorted runs, one per prefix partition, and each prefix partition merges its runs
(``merged``).

A partition is the hash of a path's first two words. A two-word prefix that alone
outgrows a partition's usual share of a spill (``DEEP`` paths) is dealt by its third
word, and if need be its fourth; a marked total tells the merging task of the prefix,
which then passes on sums below the threshold too, and a last aggregate adds them. So
nothing is lost whatever a spill dealt.

The ids of the ``KNOWN`` most frequent words are broadcast: a bound that does not
grow. Were there more words at the threshold, those beyond travel spelled out in the
runs, and no word is taken for rare.

Defined cases: a null text has no words; a null lang is ``und``; tables without
rows give none; other columns are not read; repeated rows count each time; a text
of any length is read in segments, so only its words in flight are in memory.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.common import encoded, staged
from fraylens.llm.repeats import mixed

__all__ = ["collocations", "phrase_counts"]

LONGEST = 5
#: Paths of a container before it bursts, of a trie before subtrees are spilled, and of a prefix before it is dealt by its next word.
BURST, FULL, DEEP = 1 << 14, 1_000_000, 1 << 15
#: Containers of an empty trie.
_RANGES = 16
#: Words whose ids are broadcast, and words that a task counts before it passes them on.
KNOWN, _COUNTED = 1 << 18, 400_000
#: Word ids of a trie take 16 bits; 0 ends a path.
_IDS = 1 << 16
#: Bytes of text that are split at a time, and that a prefix partition stands for.
_SEGMENT, _SHARE = 1 << 17, 16 << 20
_BREAK = b"\xff"  # no UTF-8 text holds it
_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + bytes(range(65, 91)), _BREAK * 10 + b" " + bytes(range(97, 123)))
_RUN = "lang string, level int, part int, run binary"


def segments(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with a break after every piece, some at a time."""
    text = text.translate(_PLAIN)
    at = 0
    while at < len(text):
        to = at + _SEGMENT
        if to < len(text):
            ends = [e for e in (text.find(b" ", to), text.find(_BREAK, to)) if e >= 0]
            to = min(ends, default=len(text))
        yield text[at:to].replace(_BREAK, b" \xff ").split()
        at = to
    yield [_BREAK]


class _Words(dict):
    """16-bit ids of words by first use, 0 for rare ones; raises ``OverflowError`` when there are no more.

    ``known`` has the ids for all tasks; with ``complete`` any other word is rare.
    """

    def __init__(self, known: dict[bytes, int], complete: bool):
        super().__init__({_BREAK: 0})
        self.known, self.complete = known, complete
        self.shared, self.other = [0], []  # ids for all tasks; words without one count from KNOWN on

    def __missing__(self, word: bytes) -> int:
        shared = self.known.get(word)
        if shared is None:
            if self.complete:
                return 0
            self.other.append(word)
            shared = KNOWN + len(self.other)
        if len(self.shared) == _IDS:
            raise OverflowError
        self[word] = found = len(self.shared)
        self.shared.append(shared)
        return found


class Container:
    """Hash table by open addressing from paths, (first word, packed rest), to counts; whole batches are put at once."""

    def __init__(self, room: int = 1 << 10):
        self.first, self.rest, self.count, self.used = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.int64), 0

    def put(self, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> None:
        if 2 * (self.used + len(first)) > len(self.first):
            held = self.paths()
            self.__init__(1 << int(4 * (self.used + len(first))).bit_length())
            self.put(*held)
        last = np.uint64(len(self.first) - 1)
        slot = (mixed(first * np.uint64(0x9E3779B97F4A7C15) ^ rest) & last).astype(np.int64)
        todo = np.arange(len(first))
        while len(todo):
            at, f, r = slot[todo], first[todo], rest[todo]
            free = self.first[at] == 0
            self.first[at[free]], self.rest[at[free]] = f[free], r[free]  # of several that claim a slot the last one stays
            met = (self.first[at] == f) & (self.rest[at] == r)
            np.add.at(self.count, at[met], count[todo[met]])
            todo = todo[~met]
            slot[todo] = (slot[todo] + 1) & int(last)
        self.used = int(np.count_nonzero(self.first))

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = self.first != 0
        return self.first[held], self.rest[held], self.count[held]


class HatTrie:
    """Counts paths of one language; ``spill`` gives sorted runs by prefix partition.

    Containers first hold all paths of a range of first words. One that outgrows
    ``BURST`` hands its frequent first words a container each; such a one, when it
    outgrows ``BURST`` in turn, does so for its frequent second words.
    """

    def __init__(self, lang: str, parts: int, known: dict[bytes, int], complete: bool = True):
        self.lang, self.parts, self.left, self.known, self.complete = lang, parts, [], known, complete
        self._clear()

    def _clear(self) -> None:
        self.words = _Words(self.known, self.complete)
        self.containers = [Container() for _ in range(_RANGES)]
        self.level = [0] * _RANGES
        self.of_word = np.arange(_IDS) * _RANGES // _IDS
        self.pairs, self.of_pair = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @property
    def size(self) -> int:
        return sum(c.used for c in self.containers)

    def add(self, words: list[bytes]) -> list[dict]:
        """Takes the next words of the stream; returns the runs it had to spill."""
        stream = self.left + words
        out = []
        try:
            ids = list(map(self.words.__getitem__, stream))
        except OverflowError:
            out = self.spill(0)
            self._clear()
            if len(stream) >= _IDS // 2:
                half = len(words) // 2
                return out + self.add(words[:half]) + self.add(words[half:])
            ids = list(map(self.words.__getitem__, stream))
        self.left = stream[max(0, len(stream) - LONGEST + 1) :]
        if len(stream) >= LONGEST:
            self._insert(np.array(ids, np.uint64))
        return out + self.spill(FULL // 2) if self.size > FULL else out

    def _insert(self, ids: np.ndarray) -> None:
        n = len(ids) - LONGEST + 1
        cols = [ids[k : k + n] for k in range(LONGEST)]
        for k in range(1, LONGEST):
            cols[k] = np.where(cols[k - 1] == 0, np.uint64(0), cols[k])
        live = cols[1] != 0
        first, second, third, fourth, fifth = (c[live] for c in cols)
        rest = (second << np.uint64(48)) | (third << np.uint64(32)) | (fourth << np.uint64(16)) | fifth
        self._put(first, rest, np.ones(len(first), np.int64))

    def _put(self, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> None:
        node = self.of_word[first.astype(np.int64)]
        if len(self.pairs):
            pair = (first << np.uint64(16)) | (rest >> np.uint64(48))
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            node = np.where(self.pairs[at] == pair, self.of_pair[at], node)
        by = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[by], prepend=-1))
        for own in np.split(by, cuts[1:]):
            if len(own):
                to = int(node[own[0]])
                self.containers[to].put(first[own], rest[own], count[own])
                if self.containers[to].used > BURST and self.level[to] < 2:
                    self._burst(to)

    def _burst(self, at: int) -> None:
        first, rest, count = self.containers[at].paths()
        by = first if self.level[at] == 0 else rest >> np.uint64(48)
        found, sizes = np.unique(by, return_counts=True)
        often = found[(sizes > BURST // 64) & (found != 0)]
        if not len(often):
            self.level[at] = 2  # nothing to hand over
            return
        new = len(self.containers) + np.arange(len(often))
        self.containers += [Container() for _ in often]
        if self.level[at] == 0:
            self.of_word[often.astype(np.int64)] = new
            self.level += [1] * len(often)
        else:
            pairs = np.append(self.pairs, (first[0] << np.uint64(16)) | often)
            order = np.argsort(pairs)
            self.pairs, self.of_pair = pairs[order], np.append(self.of_pair, new)[order]
            self.level += [2] * len(often)
        self.containers[at] = Container()
        self._put(first, rest, count)

    def spill(self, keep: int) -> list[dict]:
        """Runs of the largest subtrees, until at most ``keep`` paths are left."""
        left, taken = self.size, []
        for at in sorted(range(len(self.containers)), key=lambda k: self.containers[k].used, reverse=True):
            if left <= keep or not self.containers[at].used:
                break
            left -= self.containers[at].used
            taken.append(self.containers[at].paths())
            self.containers[at] = Container()
        if not taken:
            return []
        first, rest, count = (np.concatenate(c) for c in zip(*taken, strict=True))
        return self._runs([first] + [(rest >> np.uint64(s)) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)], count)

    def _runs(self, cols: list[np.ndarray], count: np.ndarray) -> list[dict]:
        shared = np.array(self.words.shared, np.int64)
        own = np.argsort(np.array(self.words.other, object)) if self.words.other else np.zeros(0, np.int64)  # words spelled out go by their order
        rank = np.empty(len(own), np.int64)
        rank[own] = np.arange(1, len(own) + 1)
        others = [self.words.other[i] for i in own]
        spelled = shared > KNOWN
        shared[spelled] = KNOWN + rank[shared[spelled] - KNOWN - 1]
        hashes = mixed(shared.astype(np.uint64))
        hashes[spelled] = [zlib.crc32(others[i]) for i in shared[spelled] - KNOWN - 1]
        part = mixed(hashes[cols[0].astype(np.int64)]) + hashes[cols[1].astype(np.int64)]
        cols = [shared[c.astype(np.int64)] for c in cols]
        bits = int(shared.max()).bit_length()
        keys = [(cols[0] << bits | cols[1]).astype(np.int64), cols[2] << bits | cols[3], cols[4]]
        by = np.lexsort(keys[::-1])
        cols, count, part = [c[by] for c in cols], count[by], part[by]
        out, inside = [], np.ones(len(count), bool)
        for level in (2, 3):
            starts = np.flatnonzero(np.logical_or.reduce([np.diff(c, prepend=-1) != 0 for c in cols[:level]]))
            sizes = np.diff(starts, append=len(count))
            large = inside[starts] & (sizes > DEEP) & (cols[level - 1][starts] != 0)
            deep = np.repeat(large, sizes)
            total = -np.add.reduceat(count, starts)[large]  # marked
            out += self._level(level, [c[starts][large] * (k < level) for k, c in enumerate(cols)], total, part[starts][large], others)
            here = inside & ~deep
            out += self._level(level, [c[here] for c in cols], count[here], part[here], others)
            inside = deep & (cols[level] != 0)
            part = mixed(part) + hashes_of(cols[level], others)
        return out + self._level(4, [c[inside] for c in cols], count[inside], part[inside], others)

    def _level(self, level: int, cols: list[np.ndarray], count: np.ndarray, part: np.ndarray, others: list[bytes]) -> list[dict]:
        if not len(count):
            return []
        part = (mixed(part) % np.uint64(self.parts)).astype(np.int64)
        by = np.argsort(part.astype(np.uint16) if self.parts < _IDS else part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1))
        return [
            {"lang": self.lang, "level": level, "part": int(part[at[0]]), "run": packed([c[at] for c in cols], count[at], others)} for at in np.split(by, cuts[1:])
        ]


def hashes_of(ids: np.ndarray, others: list[bytes]) -> np.ndarray:
    """Hashes of words by their ids for all tasks, or by their spelling."""
    out = mixed(ids.astype(np.uint64))
    spelled = ids > KNOWN
    if spelled.any():
        out[spelled] = np.array([zlib.crc32(w) for w in others], np.uint64)[ids[spelled] - KNOWN - 1]
    return out


def packed(cols: list[np.ndarray], count: np.ndarray, others: list[bytes]) -> bytes:
    """A sorted run: the words it spells out, its columns of ids, the counts."""
    words = b""
    if others:
        used, at = np.unique(np.concatenate([c[c > KNOWN] for c in cols]), return_inverse=True)
        words, done = b"\n".join(others[i - KNOWN - 1] for i in used), 0
        cols = [c.copy() for c in cols]
        for c in cols:
            n = int((c > KNOWN).sum())
            c[c > KNOWN] = KNOWN + 1 + at[done : done + n]
            done += n
    body = [np.array([len(words), len(count)], "<i8").tobytes(), words, *(c.astype("<u4").tobytes() for c in cols), count.astype("<i8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpacked(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(run)
    size, n = np.frombuffer(body, "<i8", 2).tolist()
    words = body[16 : 16 + size].split(b"\n") if size else []
    ids = np.frombuffer(body, "<u4", LONGEST * n, 16 + size).reshape(LONGEST, n).astype(np.int64)
    return words, ids, np.frombuffer(body, "<i8", n, 16 + size + 4 * LONGEST * n)


def merged(runs: list[bytes], level: int, least: int, names: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Phrases of a prefix partition and their counts: those of at least ``least``, and every one below a marked prefix.

    ``names`` are the known words of the language, by id.
    """
    held = [unpacked(r) for r in runs]
    spelled = sorted({w for words, _, _ in held for w in words})
    if spelled:
        own = {w: KNOWN + 1 + i for i, w in enumerate(spelled)}
        for words, ids, _ in held:
            if words:
                ids[ids > KNOWN] = np.array([own[w] for w in words])[ids[ids > KNOWN] - KNOWN - 1]
    cols = np.concatenate([ids for _, ids, _ in held], axis=1)
    count = np.concatenate([c for _, _, c in held])
    del held
    bits = int(cols.max()).bit_length()
    fits, keys = 63 // bits, []
    for at in range(0, LONGEST, fits):  # as many words as one sort key holds
        key = np.zeros(cols.shape[1], np.int64)
        for c in cols[at : at + fits]:
            key = (key << bits) | c
        keys.append(key)
    by = np.lexsort(keys[::-1])
    cols, count = cols[:, by], count[by]
    marked, count = count < 0, np.abs(count)
    phrases, sums = [], []
    new = np.zeros(len(count), bool)
    open_below = np.full(len(count), level > 2)
    for depth in range(1, LONGEST + 1):
        new |= np.diff(cols[depth - 1], prepend=-1) != 0
        if depth < level:
            continue
        starts = np.flatnonzero(new)
        if depth == level == 2 and marked.any():
            open_below = np.repeat(np.logical_or.reduceat(marked, starts), np.diff(starts, append=len(count)))
        total = np.add.reduceat(count, starts)
        shown = (cols[depth - 1][starts] != 0) & ((total >= least) | open_below[starts])
        for row in cols[:depth, starts[shown]].T.tolist():
            phrases.append(b" ".join([names[i - 1] if i <= KNOWN else spelled[i - KNOWN - 1] for i in row]))
        sums += total[shown].tolist()
    return phrases, sums


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), encoded(F.col("text")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of every word, and one row a lang with a null phrase: its word occurrences."""

    def counted(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        total = Counter()

        def rows():
            columns = ([], [], [])
            for lang, words in found.items():
                columns[0].extend([lang] * len(words))
                columns[1].extend(w.decode() for w in words)
                columns[2].extend(words.values())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _WORD_KINDS, strict=True)], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in segments(text.as_py()):
                    words = [w for w in words if w != _BREAK]
                    total[lang] += len(words)
                    found[lang].update(words)
                if len(found[lang]) > _COUNTED:
                    yield rows()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((list(total), [None] * len(total), list(total.values())), _WORD_KINDS, strict=True)], ["lang", "phrase", "f"])

    return _texts(docs).mapInArrow(counted, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


_WORD_KINDS = [pa.string(), pa.string(), pa.int64()]


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, words, phrase, f of every phrase of one to five words with f >= ``least``, and one row a lang with words 0: its word occurrences."""
    source, spark = _texts(docs), docs.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = max(8, -(-source.rdd.getNumPartitions() * size // _SHARE))
    single = staged(word_counts(docs).where(F.col("phrase").isNull() | (F.col("f") >= least)))
    first = single.where("phrase IS NOT NULL").orderBy(F.desc("f"), "lang", "phrase").limit(KNOWN + 1).collect()
    complete, names = len(first) <= KNOWN, defaultdict(list)
    for row in first[:KNOWN]:
        names[row["lang"]].append(row["phrase"].encode())
    sent = spark.sparkContext.broadcast(dict(names))  # at most KNOWN words

    def runs(batches):
        known = {lang: {w: i for i, w in enumerate(words, 1)} for lang, words in sent.value.items()}
        tries: dict[str, HatTrie] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                langs, texts = batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist()
                waiting = defaultdict(list)
                for lang, text in zip(langs, texts, strict=True):
                    trie = tries.get(lang) or tries.setdefault(lang, HatTrie(lang, parts, known.get(lang, {}), complete))
                    for words in segments(text):
                        waiting[lang] += words
                        if len(waiting[lang]) >= 1 << 15:
                            yield from _batches(trie.add(waiting.pop(lang)))
                for lang, words in waiting.items():
                    yield from _batches(tries[lang].add(words))
                while sum(t.size for t in tries.values()) > FULL:
                    yield from _batches(max(tries.values(), key=lambda t: t.size).spill(0))
        for trie in tries.values():
            yield from _batches(trie.add([_BREAK] * LONGEST))
            yield from _batches(trie.spill(0))

    def merge(key, rows):
        lang, level, _ = (k.as_py() for k in key)
        phrases, sums = merged(rows["run"].to_pylist(), level, least, sent.value.get(lang, []))
        columns = {"lang": [lang] * len(sums), "words": [p.count(b" ") + 1 for p in phrases], "phrase": [p.decode() for p in phrases], "f": sums}
        return pa.Table.from_pydict(columns, pa.schema({"lang": pa.string(), "words": pa.int32(), "phrase": pa.string(), "f": pa.int64()}))

    spilled = source.mapInArrow(runs, _RUN)
    long = spilled.groupBy("lang", "level", "part").applyInArrow(merge, "lang string, words int, phrase string, f long")
    long = long.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = F.when(F.col("phrase").isNull(), 0).otherwise(1)
    return long.unionByName(single.select("lang", words.alias("words"), "phrase", "f"))


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    kinds = {"lang": pa.string(), "level": pa.int32(), "part": pa.int32(), "run": pa.binary()}
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_pylist(rows[at : at + 256], pa.schema(kinds))


def _joined(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, F.lit(size) if isinstance(size, int) else size), " ")


def collocations(docs: DataFrame, least: int = 100, shown: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``shown`` phrases of two to five words.

    ``a``, ``l``, ``r`` and ``n`` count the phrase, its two parts at the cut of lowest
    score, and all words; the score is floor(1000 a n / (l r)), computed in decimals.
    A phrase within a longer one that occurs at least as often is left out.
    """
    counts = staged(phrase_counts(docs, least))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words > 0").select("lang", "phrase", "f")
    long = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))

    inside = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(parts, i, k), ' '))))")
    covered = long.where("words > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    candidates = long.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))

    cuts = candidates.select("lang", "phrase", "words", "parts", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(F.col("parts"), 1, F.col("k")).alias("left"), _joined(F.col("parts"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    met = met.withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("below", wide("l") * wide("r"))
    scored = met.withColumn("score", F.expr("top div below"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # first within 64 parts of a language, so that no task orders all phrases of one
    near = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= shown)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= shown)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
