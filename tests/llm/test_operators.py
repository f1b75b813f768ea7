"""Every operator against a plain version over hand-made documents."""

from __future__ import annotations

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from fraylens.llm import chat, licenses, mixing, packing, phrases, quality, repeats, secret_scans, simhash, suffixes, topk
from fraylens.llm.license_texts import TEXTS
from fraylens.llm.queries import tokenizer_path
from tests.llm.corpus import DOCUMENTS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    # columns whose names the operators use themselves
    return df.withColumn("fingerprint", F.lit("x")).withColumn("stats", F.lit(1)).withColumn("block", F.lit(2)).withColumn("row", F.lit(3))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def as_set(found) -> Counter:
    return Counter(tuple(r) for r in found)


def test_quality_statistics(docs, rows, none):
    def plain(text):
        w = WORD.findall(text or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    got = quality.statistics(docs, "q").select("doc_id", *[F.col("q").getField(n) for n in quality.STATS[:5]]).collect()
    assert as_set(got) == Counter((r[0], *plain(r[1])) for r in rows)
    assert quality.statistics(none).count() == 0


def test_quality_rules_learn_and_keep_clean(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], 0 if "###" in (r[1] or "") else 1, 0) for r in rows if r[0] is not None and r[0] >= 100] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(docs, labels, precision=0.9, least=3)
    assert rules.rules and "reject if" in str(rules)
    got = quality.judged(docs, rules, "q").select("doc_id", "text", "q.base_failed", "q.kept").collect()
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= 100 and not r["base_failed"]:
            assert r["kept"] == ("###" not in r["text"]), r["doc_id"]
        w = WORD.findall(r["text"] or "")
        assert not (len(w) < 50 and r["kept"])
    assert quality.learn(docs, labels.where("quality = 1")).rules == []
    assert quality.judged(docs, quality.DecisionList(), "q").columns[: len(docs.columns)] == docs.columns


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_components(docs, rows, none):
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(prints)
    least = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        least[root].append(r[0])
    expected = Counter((r[0], f"{p:016x}", min((x for x in least[c] if x is not None), default=None)) for r, p, c in zip(rows, prints, roots, strict=True))
    got = simhash.components(docs)
    assert as_set(got.select("doc_id", "fingerprint", "component_id").collect()) == expected
    assert got.where("stands").select("doc_id", "text_hash").distinct().count() == len(set(roots))
    assert simhash.components(none).count() == 0


def test_covering_masks_lose_no_pair():
    rng = np.random.default_rng(1)
    for level in range(3):
        masks = simhash.covering_masks(3, level)
        for _ in range(3000):
            flips = 0
            for b in rng.choice(64, 3, replace=False):
                flips |= 1 << int(b)
            assert any(m & (1 << 64) - 1 & flips == 0 for m in masks)


def test_simhash_splits_large_buckets(spark):
    rng = np.random.default_rng(2)
    values = {0}
    for _ in range(700):  # one cloud in which everything shares buckets, and strays
        x = 0
        for b in rng.choice(24, rng.integers(0, 6), replace=False):
            x |= 1 << int(b)
        values.add(x)
    values = sorted(values | {int(x) for x in rng.integers(1 << 40, 1 << 62, 100)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    found = dict(simhash.stars(simhash.links(nodes, bucket=16)).collect())
    roots = plain_components(values)
    assert {v: found.get(v, v) for v in values} == {v: values[r] for v, r in zip(values, roots, strict=True)}


def plain_removed(rows, units, width):
    first = {}
    split = [units(r[1]) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, u in zip(rows, split, strict=True):
        for s in range(len(u) - width + 1):
            place = (key(r), s)
            w = tuple(u[s : s + width])
            first[w] = min(first.get(w, place), place)
    out = []
    for r, u in zip(rows, split, strict=True):
        gone = [False] * len(u)
        for s in range(len(u) - width + 1):
            if first[tuple(u[s : s + width])] < (key(r), s):
                gone[s : s + width] = [True] * width
        out.append((r[0], u, gone))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_phrase_dedup(docs, rows, none, hot):
    expected = Counter()
    for doc, u, gone in plain_removed(rows, lambda t: WORD.findall(t or ""), 20):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        expected[doc, len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = phrases.deduplicated(docs, hot=hot, block_bytes=9_000)
    assert as_set(got.select("doc_id", "n_units", "n_removed", "kept_sha256").collect()) == expected
    assert phrases.deduplicated(none).count() == 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(docs, rows, none, hot):
    expected = Counter()
    for doc, u, gone in plain_removed(rows, lambda t: (t or "").encode(), 100):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected[doc, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.deduplicated(docs, hot=hot, block_bytes=20_000)
    assert as_set(got.select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256").collect()) == expected
    assert suffixes.deduplicated(none).count() == 0


@pytest.mark.parametrize("scheme", [phrases.SCHEME, suffixes.SCHEME])
def test_hot_anchors_are_told_by_true_totals(scheme):
    rng = np.random.default_rng(4)
    line = "the same cell of every table row , long enough for an anchor of its own in both of the schemes and for more than one hundred bytes of text"
    text = " ".join(f"{line} {rng.integers(1 << 40)}" for _ in range(400)).encode()
    sent = pa.RecordBatch.from_pylist([{"block": b, "ids": [b], "sizes": [len(text)], "data": zstandard.compress(text)} for b in range(2)])
    part = pd.concat([b.to_pandas() for b in repeats._sent_anchors(scheme, 1)(iter([sent]))])
    for hot, expected in [(799, True), (800, False)]:  # two blocks of 400
        found = repeats._recurring(hot)(part)
        assert [len(x) > 0 for x in found["hot"]] == [expected] * 2
        assert all(len(x) for x in found["common"]) or expected


def test_bucket_refinement_tells_windows_apart():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 99, 4000).astype(np.uint8))
    number = suffixes.refined(data, 12)
    seen = {}
    for i in range(len(data) - 12 + 1):
        assert seen.setdefault(data[i : i + 12], number[i]) == number[i]
    assert len(set(seen.values())) == len(seen)


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] \\l \\b< [ ] \\"
    rows = [
        (1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "end"),
        (2, 0, "user", "only"), (3, 0, "assistant", "é\U0001f600"), (3, 0, "assistant", "é\U0001f600"), (None, None, None, None), (4, 1, "a]ss", "x"), (4, 0, "assistant", "</s>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    shown = chat.examples(df)
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is not None, t or 0), r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    assert got.keys() == groups.keys()
    total = {r["conv_id"]: r["n"] for r in shown.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), total[c])
    one = shown.where("conv_id = 1 AND example = 1").first()
    assert one["formatted"].count("</s>") == 3 and not one["last"]
    assert shown.where("conv_id = 1").count() == 3
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_chat_spreads_a_long_conversation(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(1001)] + [(c, 0, "assistant", "x") for c in range(2, 40)]
    rows += [(50, i, "assistant", f"a{i}") for i in range(chat.PART)] + [(51, i, "assistant", f"a{i}") for i in range(chat.PART + 1)]
    shown = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert shown.where("conv_id = 1").select(F.spark_partition_id()).distinct().count() > 3
    got = {(r["conv_id"], r["example"]): r for r in shown.collect()}
    groups = defaultdict(list)
    for c, _, r, x in rows:
        groups[c].append((r, x))
    expected = set()
    for c, turns in groups.items():
        ends = [i for i in range(1, len(turns) + 1) if turns[i - 1][0] == "assistant" or i == len(turns)]
        for k, i in enumerate(ends, 1):
            r = got[c, k]
            expected.add((c, k))
            assert r["formatted"] == "".join(f"<s>[{role}]{text}</s>" for role, text in turns[:i]) and r["last"] == (i == len(turns))
            assert r["formatted"][r["loss_start"] : r["loss_end"]] == (turns[i - 1][1] if turns[i - 1][0] == "assistant" else "")
    assert got.keys() == expected and shown.count() == len(expected)


def plain_secrets(text):
    text = text or ""
    out = []
    for rank, (kind, pattern, group, least) in enumerate([
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    ]):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans_and_ledger(docs, rows, none):
    found, ledger = secret_scans.scan(docs)
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    got = as_set(found.select("path", secret_scans.written(base)).collect())
    assert got == Counter((r[0], ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_secrets(r[1]))) for r in rows)
    assert sum("hex:" in k[1] for k in got) >= 1 and sum("assign:" in k[1] for k in got) >= 2
    assert ledger.count() == len({r[1] or "" for r in rows})
    again, fresh = secret_scans.scan(docs, ledger)
    assert fresh.count() == 0
    assert as_set(again.select("path", secret_scans.written(base)).collect()) == got
    _, newer = secret_scans.scan(docs, ledger, version=2)
    assert newer.count() == ledger.count()
    masked = docs.select("text").join(found.where(F.size("found") > 0), secret_scans.sha256_hex(F.col("text")) == F.col("blob")).select(
        secret_scans.redacted(F.col("text"), F.col("found")).alias("clean"))
    assert masked.count() and all("f4fddc" not in r["clean"] and "longenough1" not in r["clean"] for r in masked.collect())
    assert secret_scans.scan(none)[0].count() == 0


def test_secret_scan_of_many_matches(spark):
    """A long list of digests: every span and the masked text, in time that grows with the list."""
    for n in (1, 5, 17, 30_000):
        text = "".join(f"é{i}\U0001f511 {hashlib.sha256(str(i).encode()).hexdigest()[: 31 + i % 3]}\n" for i in range(n)) + "token: https://a:b@c password=12345678"
        spans = F.col("found")
        scanned = spark.createDataFrame([(text,)], "text string").withColumn("found", secret_scans.found_in(F.col("text")))
        row = scanned.select("found", secret_scans.redacted(F.col("text"), spans).alias("clean")).collect()[0]
        got = [(s["start"], s["stop"], s["kind"]) for s in row["found"]]
        wanted = [
            (m.start(), m.end(), r.kind, k) for k, r in enumerate(secret_scans.RULES)
            for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least
        ]
        wanted.sort(key=lambda w: (w[0], w[3]))
        assert got == [w[:3] for w in wanted]
        clean, at = [], 0
        for begin, end, _, _ in wanted:
            if begin >= at:
                clean += [text[at:begin], "[secret]"]
            at = max(at, end)
        assert row["clean"] == "".join(clean) + text[at:]


def test_secret_scan_of_very_long_runs(spark):
    run, login = "abcdef0123" * 60_000, " https://u:p@h eyJ" + "eyJ" * 200_000
    df = spark.createDataFrame([(1, "g" * 600_000 + login), (2, run + login)], "doc_id long, text string")
    got = {r["path"]: [(s["kind"], s["start"], s["stop"]) for s in r["found"]] for r in secret_scans.scan(df)[0].collect()}
    at = ("url_login", 600_001, 600_013)
    assert got == {1: [at], 2: [("hex", 0, 600_000), at]}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (rng.random(8) > 0.4)]) for i in range(300)]
    rows += [(300, rows[7][1]), (301, None), (302, []), (303, [1.0, None]), (304, [math.nan] * 8), (305, [math.inf] * 8), (None, [1.0] * 8), (350, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)[:5]
        expected |= {(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)}
    for block, queries in ((64, 3), (4096, 512)):
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block, queries).collect()} == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id in (50, 51)"), F.col("vec_id") % 50 == 0).count() == 1


def test_licenses(spark, none):
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\nDo as you like; keep this Licence."
    known = spark.createDataFrame([("X", mit), ("Y", mit), ("Z", "Released under the MIT License."), ("E", " ")], "license_id string, text string")
    rows = [(1, mit.upper().replace("2020 SOMEBODY", "1999 A, B")), (2, "text\nReleased under the MIT licence!\n  RELEASED under the MIT License\nmore"), (3, None), (4, ""), (4, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = as_set(licenses.scan(df, known).select("doc_id", "license_ids", "n_notices", "notice_ids").collect())
    assert got == Counter([(1, "X,Y", 0, ""), (2, "", 2, "Z"), (3, "", 0, ""), (4, "", 0, ""), (4, "", 0, ""), (None, "", 0, "")])
    assert licenses.scan(none, known).count() == 0


def test_license_layout(spark):
    body = next(text for name, text in licenses.KNOWN if name == "ISC").split("\n")
    clause = "(c) You must retain all copyright notices; copyright 1996 treaties are not affected by the copyright license or the copyright owner."
    known = spark.createDataFrame([("ISC", "\n".join(body)), ("T", clause)], "license_id string, text string")
    heads = ["Copyright (c) 2020, A. All rights reserved.\n", "# (C) 1999 A\n# Copyright \u00a9 B\n", "\u00a9 A\n", "Copyright [yyyy] [name]\nAll rights\nreserved\n", "Copyright: 2001-2004 A, all rights\nreserved.\n", ""]
    layouts = [(head, [textwrap.fill(p, w) for p in body]) for w in range(20, 130) for head in heads]
    rows = [(i, f"ISC License\n\n{head}\n" + "\n\n".join(paragraphs)) for i, (head, paragraphs) in enumerate(layouts)]
    rows += [(-w, textwrap.fill(clause.replace("copyright 1996", "copyright; 1996"), w)) for w in range(20, 160)]
    titled = known.unionByName(known.where("license_id = 'ISC'").withColumn("text", F.concat(F.lit("ISC License\n"), "text")))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), titled).groupBy("license_ids").count().collect()
    assert as_set(got) == Counter([("ISC", len(layouts)), ("T", 140)])


def test_whole_licenses_of_the_table(spark):
    heads = {"MIT": "MIT License\n\nCopyright (c) 2020 A", "BSD-2-Clause": "Copyright 2020 A. All rights reserved.", "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved."}
    rows, expected = [], {}
    for name, text in TEXTS.items():
        paragraphs = re.split(r"\n[ \t]*\n", text)
        gnu = name.startswith(("GPL", "LGPL", "GFDL"))
        for width in (None, 60, 72, 100):
            if width and gnu:
                continue  # their statement and the sentence after it share a paragraph
            body = text if width is None else "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
            expected[len(rows)] = f"{name}-only,{name}-or-later" if gnu else name.split(" ")[0]
            rows.append((len(rows), f"{heads.get(name, '')}\n\n{body}"))
    bullets = TEXTS["BSD-3-Clause"].replace("1. ", " * ").replace("2. ", " * ").replace("3. ", " * ")
    apache = TEXTS["Apache-2.0"].split("   APPENDIX")[0].replace("http:", "https:")
    for name, text in [("BSD-3-Clause", bullets), ("Apache-2.0", apache), ("", TEXTS["MIT"].replace("sell", "lend"))]:
        expected[len(rows)] = name
        rows.append((len(rows), text))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark))
    assert {r["doc_id"]: r["license_ids"] for r in got.collect()} == expected


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    capacity = 256
    expected = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            expected[r[0], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.packed(docs, tokenizer_path(), capacity).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= 1.05 * -(-sum(r["length"] for r in got) // capacity) + 1
    assert packing.packed(none, tokenizer_path()).count() == 0


def test_packing_program_fills_sequences():
    rng = np.random.default_rng(5)
    histogram = Counter(int(x) for x in np.clip(rng.lognormal(6, 0.8, 20_000), 1, 2048))
    out = packing.solve(histogram)
    placed = Counter()
    for n, config in out.configurations:
        assert sum(k * v for k, v in config.items()) <= 2048
        for k, v in config.items():
            placed[k] += n * v
    assert placed == histogram
    assert out.sequences() <= 1.01 * sum(k * v for k, v in histogram.items()) / 2048


def plain_mixed(rows, mix):
    """(row, leaf, epoch) for every use of a row."""
    leaf = lambda r: (
        "d-" if not re.search(r"[0-9]$", r[3] or "") else f"d{int(re.search('([0-9]+)$', r[3])[1]) % 4}", r[2] or "", r[3] or "")
    available = Counter()
    for r in rows:
        available[leaf(r)] += n_tokens(r)
    available = +available

    def share(budget, children):  # plain water filling, one child at a time
        out, open_, left = {}, dict(children), budget
        while open_:
            level = left / sum(w for _, w in open_.values())
            full = {k for k, (cap, w) in open_.items() if cap <= w * level}
            if not full:
                return out | {k: math.floor(w * level) for k, (_, w) in open_.items()}
            for k in full:
                out[k] = open_.pop(k)[0]
                left -= out[k]
        return out

    below = lambda prefix: sum(v for k, v in available.items() if k[: len(prefix)] == prefix) * mix.epochs
    plan = {}
    total = math.floor(sum(available.values()) * mix.share)
    for d, b in share(total, {d: (below((d,)), mix.domains.get(d, 1)) for d in {k[0] for k in available}}).items():
        for g, bb in share(b, {g: (below((d, g)), mix.languages.get(g, 1)) for g in {k[1] for k in available if k[0] == d}}).items():
            plan |= {(d, g, s): x for s, x in share(bb, {k[2]: (available[k] * mix.epochs, 1) for k in available if k[:2] == (d, g)}).items()}
    out = []
    for k, budget in plan.items():
        whole, rest = divmod(budget, available[k])
        own = sorted((r for r in rows if leaf(r) == k), key=lambda r: (hashlib.md5(f"{mix.seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), n_tokens(r)))
        at = 0
        for r in own:
            out += [(r, k, e) for e in range(whole + (at < rest))]
            at += n_tokens(r)
    return out


def n_tokens(row):
    return len(WORD.findall(row[1] or ""))


def test_mixing_budgets_and_prefixes(docs, rows, none):
    mix = mixing.Mix(domains={"d0": 3}, languages={"en": 2}, share=0.7, epochs=2)
    got = mixing.mixed(docs, mix)
    assert set(got.select("row.*").columns) == set(docs.columns)
    expected = Counter((r[0], *k, e, n_tokens(r)) for r, k, e in plain_mixed(rows, mix))
    assert as_set(got.select("row.doc_id", "mix_.*").collect()) == expected
    assert mixing.mixed(none, mix).count() == 0


def test_packing_ids_of_marks_behind_capitals(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(8)
    marks = ["\u030c", "\u0331", "\u0308", "\u030a", "\u0301", "", "", "é", "ß", ".", "<|", "Ä"]
    texts = ["".join(f"{c}{m}" for c, m in [("J", marks[0]), ("H", marks[1]), ("T", marks[2]), ("W", marks[3]), ("Y", marks[3])])]
    texts += ["".join(rng.choice(list("JHTWYabz A  "), 1)[0] + rng.choice(marks, 1)[0] for _ in range(12)) for _ in range(1500)]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    found = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert found[i] == (len(ids), zlib.crc32(ids.tobytes())), text


def test_packing_is_never_behind_best_fit_decreasing():
    def plain(pieces):
        rooms = []
        for n in sorted(pieces, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((packing.CAPACITY if fit is None else fit) - n)
        return len(rooms)

    rng = np.random.default_rng(4)
    histograms = [
        Counter(rng.integers(1, 2049, 1500).tolist()), Counter(rng.choice([600, 700, 900, 1100, 1300], 1500).tolist()),
        Counter((rng.choice([1024, 683, 512], 1200) + rng.integers(-30, 31, 1200)).tolist()), Counter(rng.geometric(0.01, 3000).clip(1, 2048).tolist()), Counter([2048] * 5 + [1] * 7),
    ]
    for histogram in histograms:
        simple = packing.best_fit_decreasing(histogram)
        for made in (simple, packing.fewest(histogram)):
            placed = Counter()
            for n, config in made.configurations:
                assert sum(k * c for k, c in config.items()) <= packing.CAPACITY
                placed.update({k: n * c for k, c in config.items()})
            assert placed == histogram
        assert sum(n for n, _ in simple.configurations) == plain(histogram.elements())
        assert sum(n for n, _ in packing.fewest(histogram).configurations) <= plain(histogram.elements())
