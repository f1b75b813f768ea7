"""The whole pipeline against plain versions of its stages."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fraylens.llm import quality, secret_scans
from fraylens.llm.queries import tokenizer_path
from tests.llm.corpus import DOCUMENTS, documents
from tests.llm.test_operators import WORD, plain_components, plain_fingerprint, plain_mixed

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(documents(), DOCUMENTS).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if "###" in (r[1] or "") else 1, 0) for r in documents() if r[0] is not None and r[0] >= 100]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/none/labels.parquet")
    return path


def plain_quality(rows, rules):
    def kept(text):
        w = WORD.findall(text or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        chars = max(sum(map(len, w)), 1)
        found = lambda pattern: len(re.findall(pattern, text or "")) / chars
        value = {
            "words": len(w), "word_length": sum(map(len, w)) / max(len(w), 1), "symbols": found(r"[#*$%&|<>]"), "upper": found("[A-Z]"),
            "digits": found("[0-9]"), "marks": found("[!?]"), "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
            "repeated_words": len(repeated) / max(len(w), 1), "distinct_words": len(set(w)) / max(len(w), 1), "line_words": len(w) / max(len(lines), 1),
        }
        met = any(all(value[t.name] > t.threshold if t.above else value[t.name] <= t.threshold for t in rule) for rule in rules.rules)
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and not met

    return [r for r in rows if kept(r[1])]


def plain_near_dedup(rows):
    roots = plain_components([plain_fingerprint(r[1]) for r in rows])
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [rows[min((i for i in range(len(rows)) if roots[i] == c), key=order)] for c in sorted(set(roots))]


def plain_masked(rows):
    out = []
    for doc, text, lang, source, n in rows:
        spans = sorted(m.span() for r in secret_scans.RULES for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least)
        at, parts = 0, []
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], "[secret]"]
            at = max(at, b)
        masked = "".join(parts) + text[at:] if spans else text
        out.append((doc, masked, lang, source, len(masked) if spans else n))
    return out


def test_stages_and_the_whole_run(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = documents()
    plain = [lambda x: plain_quality(x, rules), plain_near_dedup, plain_masked, lambda x: [r for r, _, _ in plain_mixed(x, corpus_pipeline.MIX)]]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain, strict=False):
        own = stage(spark, spark.createDataFrame(documents(), DOCUMENTS).repartition(3), folder)  # judged on its own input, every case in it
        assert own.columns == docs.columns
        assert Counter(map(tuple, own.collect())) == Counter(expected(documents())), name
        rows = expected(rows)
    assert rows
    tok, pieces = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            pieces[r[0], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()) == pieces


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
