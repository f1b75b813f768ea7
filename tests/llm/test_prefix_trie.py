"""The prefix trie against a plain trie of rebuilt conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fraylens.llm import prefix_trie


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [t[1:] for t in sorted(own)] for c, own in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(said.get(c - c % 100, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, who in members.items()
    )


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 206, 207, 1001]:  # 200 and 1000 are absent
        for t in range(rng.choice([1, 2, 3, 8, 9, 20])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "Grüße \U0001f600", "x" * (t + 1)])))
    rows += [(300, t, "user", f"turn {t % 7}") for t in range(530)]  # deeper than three levels of bands
    rows += [(301, t, "user", f"turn {t % 7}" if t != 300 else "other") for t in range(525)]
    rows += [(302, None, None, None), (302, None, "user", "b"), (302, 5, "user", None), (302, 5, "user", "tie"), (302, 5, "a", "tie"), (302, 5, "user", "tie")]
    rows += [(None, 1, "user", "nobody"), (303, 0, "us", "era"), (304, 0, "use", "ra"), rows[0]]
    rng.shuffle(rows)
    return rows


def test_nodes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("x", F.lit(1))
    got = Counter(tuple(r) for r in prefix_trie.nodes(df.repartition(7)).collect())
    assert got == plain(rows)
    assert max(r[1] for r in got) > 512 and any(r[7] != hashlib.sha256(b"").hexdigest() for r in got if r[1] == 0)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(df).count() == 0
