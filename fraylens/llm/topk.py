"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become blocks of postings: for every term (component) the places and
weights of the block's vectors that hold it. A block of sparse query rows meets
every block of postings once: term by term the query weights scatter the weighted
postings into dense score arrays, a partition selection keeps each query's best
k of the block, and the blocks' winners are merged. Nothing is pruned, so the
result is exact. Blocks have fixed sizes, so a task holds one score array of
``QUERY_BLOCK`` x ``BLOCK`` whatever the size of the table.

Defined cases: a vector that is null, empty, or holds a null or non-finite
component takes no part, and neither does a null id; vectors of different
lengths multiply over the terms that both have; a query's own rows are those
with its vec_id; ties go to the smaller vec_id; scores must fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.common import staged

BLOCK, QUERY_BLOCK = 4096, 512
#: Query blocks are copied to at most so many groups of posting blocks.
GROUPS = 64
SCALE = 256


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the integer components floor(256 x) of the rows that take part."""
    v = F.col(embedding)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    terms = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole).select(
        F.col(vec_id).cast("long").alias("vec_id"), terms.alias("terms")
    )


def _blocks(size: int):
    """Packs a partition's vectors into rows of at most ``size``: ids, lengths and all components in a row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(ids, terms):
            return pd.DataFrame([{"ids": ids, "lengths": [len(t) for t in terms], "terms": np.concatenate(terms)}])

        ids, terms = [], []
        for part in batches:
            ids.extend(part["vec_id"].tolist())
            terms.extend(part["terms"].tolist())
            while len(ids) >= size:
                yield row(ids[:size], terms[:size])
                ids, terms = ids[size:], terms[size:]
        if ids:
            yield row(ids, terms)

    return pack


_BLOCK_TYPE = "ids array<long>, lengths array<int>, terms array<long>"


def _postings(lengths: np.ndarray, terms: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term -> (rows, weights), zero weights left out."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(term, kind="stable")
    order = order[terms[order] != 0]
    cuts = np.flatnonzero(np.diff(term[order])) + 1
    return {int(term[part[0]]): (row[part], terms[part]) for part in np.split(order, cuts) if len(part)}


def _accumulated(queries: dict, postings: dict, n_queries: int, n_rows: int) -> np.ndarray:
    scores = np.zeros((n_queries, n_rows), np.int64)
    for term, (q, weight) in queries.items():
        if term not in postings:
            continue
        at, posted = postings[term]
        if len(at) == n_rows:  # every row has the term: the scatter is a plain addition
            for i, w in zip(q.tolist(), weight.tolist(), strict=True):
                scores[i] += w * posted
        else:
            for i, w in zip(q.tolist(), weight.tolist(), strict=True):
                scores[i, at] += w * posted
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, without ``own``."""
    open_ = np.flatnonzero(ids != own)
    if len(open_) > k:
        floor = np.partition(scores[open_], len(open_) - k)[len(open_) - k]
        open_ = open_[scores[open_] >= floor]
    return open_[np.lexsort((ids[open_], -scores[open_]))[:k]]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors of each row that ``queries`` selects."""
    rows = staged(quantised(vectors))
    asked = rows.where(queries)
    deal, deal_asked = (max(1, -(-part.count() // size)) for part, size in ((rows, block), (asked, query_block)))
    groups = min(deal, GROUPS)
    packed = asked.repartition(deal_asked).mapInPandas(_blocks(query_block), _BLOCK_TYPE)
    packed = staged(packed.select(F.struct("ids", "lengths", "terms").alias("asked"), F.spark_partition_id().alias("query_block")))
    last = packed.agg(F.max("query_block")).first()[0]
    each = F.array().cast("array<int>") if last is None else F.sequence(F.lit(0), F.lit(last))
    # A block of postings goes once to every query block, under a group of its own so that pairs spread over many tasks.
    blocks = rows.repartition(deal).mapInPandas(_blocks(block), _BLOCK_TYPE).withColumn("place", F.pmod(F.spark_partition_id(), F.lit(groups)))
    sent = blocks.select("ids", "lengths", "terms", "place", F.explode(each).alias("query_block"))
    met = packed.select("asked", "query_block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("place"))
    # The optimizer takes the copies of the query blocks for one (an explode keeps its estimate), so the join never broadcasts them.
    return _merged(sent.join(met.hint("merge"), ["query_block", "place"]), k)


def _merged(pairs: DataFrame, k: int) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples(index=False):
                ids = np.asarray(r.ids, np.int64)
                own = np.asarray(r.asked["ids"], np.int64)
                found = _accumulated(
                    _postings(np.asarray(r.asked["lengths"]), np.asarray(r.asked["terms"], np.int64)),
                    _postings(np.asarray(r.lengths), np.asarray(r.terms, np.int64)), len(own), len(ids),
                )
                best = [_best(found[i], ids, own[i], k) for i in range(len(own))]
                yield pd.DataFrame({
                    "query_id": np.repeat(own, [len(b) for b in best]),
                    "vec_id": np.concatenate([ids[b] for b in best]),
                    "score": np.concatenate([found[i, b] for i, b in enumerate(best)]),
                })

    found = pairs.select("ids", "lengths", "terms", "asked").mapInPandas(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
