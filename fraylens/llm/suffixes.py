"""Suffix-array dedup of bytes by bucket-pointer refinement.

The suffixes that begin a window of a recurring passage are put into buckets by
their first 8 bytes. A bucket is refined by sorting its suffixes on the bucket
numbers of later offsets, 8, 16, 32 bytes on; each round's numbers serve the
next, so the depth doubles until whole windows are told apart. Suffixes alone in
their bucket are settled and not sorted again. ``repeats`` brings together the
passages that can hold equal windows.

A null text is empty; the other cases are those of ``repeats``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fraylens.llm.repeats import BYTE_HASH, HOT, Scheme, Units, removed

WIDTH, GRAM, FIRST = 100, 37, 8


def _units(texts: list[bytes]) -> Units:
    data = b"".join(texts)
    at = np.arange(len(data) + 1)
    return Units(data, at[:-1], at[1:], BYTE_HASH[np.frombuffer(data, np.uint8)], np.cumsum([0, *map(len, texts)]))


def _initial(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at every place, as one number; zeros beyond the end."""
    out = np.zeros(len(data) + FIRST, np.uint64)
    out[: len(data)] = data
    for half in (1, 2, 4):
        out[: len(data)] = (out[: len(data)] << np.uint64(8 * half)) | out[half : len(data) + half]
    return out[: len(data)].copy()


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers in the order of the keys, and which buckets hold more than one."""
    order = np.argsort(keys, kind="stable")
    head = np.append(True, np.diff(keys[order]) != 0)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(head) - 1
    return out, np.bincount(out) > 1


def refined(data: bytes, width: int) -> np.ndarray:
    """A number per place: equal for places that the same ``width`` bytes follow (places less far from the end: any)."""
    raw = np.frombuffer(data, np.uint8)
    bucket, shared = _numbered(_initial(raw))
    depth, n = FIRST, len(raw)
    while depth < width:
        step = min(depth, width - depth)  # the next number covers [0, depth) and [step, step + depth)
        active = np.flatnonzero(shared[bucket])
        later = bucket[np.minimum(active + step, n - 1)]
        sub, again = _numbered(bucket[active] * np.int64(n + 1) + later)
        fresh = bucket.copy()
        fresh[active] = sub + n + 1  # apart from settled numbers
        at = np.unique(fresh, return_inverse=True)[1]
        held = np.zeros(at.max() + 1, bool)
        held[at[active]] = again[sub]
        bucket, shared, depth = at, held, depth + step
    return bucket


def _classes(contents: list[bytes], windows: np.ndarray, times: np.ndarray, width: int = WIDTH) -> np.ndarray:
    bucket = refined(b"".join(contents), width)
    begins = np.cumsum([0, *map(len, contents)])[:-1]
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return bucket[np.repeat(begins, windows) + nth]


def _drop(data: bytes, begins: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    if not len(begins):
        return b""
    own = data[begins[0] : ends[-1]]
    return np.frombuffer(own, np.uint8)[~gone].tobytes() if gone.any() else own


SCHEME = Scheme(WIDTH, GRAM, _units, _classes, _drop)


def deduplicated(docs: DataFrame, hot: int = HOT, kept: bool = True, **sizes) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    return removed(docs, SCHEME, hot, kept=kept, **sizes)
