"""Collocations and decontamination against plain versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fraylens.llm import collocations, decontamination
from tests.llm.corpus import DOCUMENTS, documents, words

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows():
    return documents() + [(900, "Mixed CASE. mixed case; mixed\tcase\x85 x " * 40, None, "s", 1), (901, "a b c d e f g, " * 30, "en", "s", 1), (902, " ".join(f"p q r s{i % 90} t" for i in range(900)), "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    return df.withColumn("phrase", F.lit("x")).withColumn("row", F.lit(1)).withColumn("leak", F.lit(2)).withColumn("level", F.lit(3))


def plain_collocations(rows, least, shown=2000):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r[1] or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    inside = defaultdict(int)
    for (lang, p), c in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inside[lang, p[i : i + size]] = max(inside[lang, p[i : i + size]], c)
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if inside[lang, p] < a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:shown], 1)}


def plain_phrases(rows):
    found = Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r[1] or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                found.update((r[2] if r[2] is not None else "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return found


def test_collocations(docs, rows):
    got = {tuple(r) for r in collocations.collocations(docs, 5).collect()}
    assert got == plain_collocations(rows, 5) and len(got) > 50
    assert collocations.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("known", [1 << 18, 40])
def test_trie_that_spills_and_bursts_often(rows, monkeypatch, known):
    """With few known words the others are spelled out, and none is rare."""
    for name, value in [("FULL", 400), ("DEEP", 20), ("BURST", 64), ("KNOWN", known)]:
        monkeypatch.setattr(collocations, name, value)
    least, expected = 3, plain_phrases(rows)
    names = defaultdict(list)
    for (lang, w), n in sorted(expected.items(), key=lambda x: (-x[1], x[0])):
        if n >= least and " " not in w and len(names[lang]) < known:
            names[lang].append(w.encode())
    tries, runs = {}, []
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        trie = tries.get(lang) or tries.setdefault(lang, collocations.HatTrie(lang, 7, {w: i for i, w in enumerate(names[lang], 1)}, known > 1000))
        for part in collocations.segments((r[1] or "").encode()):
            runs += trie.add(part)
    for trie in tries.values():
        runs += trie.add([b"\xff"] * 5) + trie.spill(0)
    groups, found = defaultdict(list), Counter()
    for run in runs:
        groups[run["lang"], run["level"], run["part"]].append(run["run"])
    assert {k[1] for k in groups} == {2, 3, 4}
    for (lang, level, _), own in groups.items():
        for phrase, n in zip(*collocations.merged(own, level, least, names[lang]), strict=True):
            found[lang, phrase.decode()] += n
    assert {k: c for k, c in found.items() if c >= least} == {k: c for k, c in expected.items() if c >= least and " " in k[1]}


def test_phrases_beyond_the_known_words(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "KNOWN", 30)
    got = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs, 4).where("words > 0").collect()}
    assert got == {k: c for k, c in plain_phrases(rows).items() if c >= 4}


def test_collocations_keep_the_first_of_each_language(docs, rows):
    got = {tuple(r) for r in collocations.collocations(docs, 4, 7).collect()}
    assert got == plain_collocations(rows, 4, 7)


def test_a_vocabulary_beyond_16_bits_spills():
    trie, runs = collocations.HatTrie("x", 3, {}, complete=False), []
    for at in range(0, 150_000, 30_000):
        runs += trie.add([b"w%d" % (i // 2) for i in range(at, at + 30_000)])
    runs += trie.add([b"%d" % i for i in range(70_000)] + [b"\xff"] * 5) + trie.spill(0)
    found = Counter()
    for part in range(3):
        for phrase, n in zip(*collocations.merged([r["run"] for r in runs if (r["level"], r["part"]) == (2, part)], 2, 1, []), strict=True):
            found[phrase] += n
    pairs = {p: n for p, n in found.items() if p.count(b" ") == 1}
    assert len(pairs) == 75_000 + 74_999 + 70_000 and set(pairs.values()) == {1} and pairs[b"w7 w7"] == pairs[b"w74999 0"] == 1


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, met = set(), set()
    for item, body in items:
        v = WORD.findall((body or "").translate(LOWER))
        size = min(10, len(v))
        wanted = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                met.add("" if item is None else str(item))
    return len(w), len(hit), sorted(met), bool(hit)


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_contaminated_documents(spark, docs, rows, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD", shard)
    monkeypatch.setattr(decontamination, "_PART", 20 if shard == 300 else 10_000)
    passage = words(2, 60)
    items = [
        (1, " ".join(passage[10:30])), (2, "One, TWO"), (2, "one two"), (3, ""), (4, None), (None, " ".join(passage[12:24])), (5, "a"), (6, " ".join(words(3, 6000, 5000)[2000:2300])),
        (7, "dup-line dup line"), (8, "never seen words here"), (10, "ſ k"), (11, " ".join(words(1, 300)[:9])), (12, "a a a a a a a a a a"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit(1))
    plain = docs.drop("leak")
    got = decontamination.contaminated(plain, benchmark).select("doc_id", "leak.n_words", "leak.n_hit", "leak.items").collect()
    expected = Counter((r[0], *map(str, plain_hits(r[1], items)[:3])) for r in rows)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got) == expected
    assert sum(r["n_hit"] > 0 for r in got) > 10
    empty = decontamination.contaminated(plain, benchmark.limit(0)).select("leak.n_hit", "leak.n_words").collect()
    assert all(r[0] == 0 for r in empty) and sum(r[1] for r in empty) == sum(r["n_words"] for r in got)
    assert decontamination.contaminated(plain.limit(0), benchmark).count() == 0
    if shard > 300:  # a clashing name stays beside the new one
        assert decontamination.contaminated(docs, benchmark).columns == [*docs.columns, "leak"]


def test_search_over_segments(monkeypatch):
    monkeypatch.setattr(decontamination, "_SEGMENT", 64)
    body = words(40, 400, 30)
    patterns = decontamination.Patterns([("x", w) for w in decontamination.windows(" ".join(body[100:140]).encode())] + [("y", (b"word1",)), ("z", (b"word2", b"word3"))])
    n, begins, ends, items = patterns.search(" ".join(body).encode())
    expected = plain_hits(" ".join(body), [("x", " ".join(body[100:140])), ("y", "word1"), ("z", "word2 word3")])
    assert (n, sum(ends) - sum(begins), items) == expected[:3]
