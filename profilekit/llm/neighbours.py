"""Approximate nearest neighbours by collision counting over sorted projections.

Vectors are dealt into blocks of bounded size. A block projects its vectors on
fixed random directions and sorts each projection. For a query, a window around
its own projection opens in every sorted array and widens in steps of factor
``widening`` (virtual rehashing: level R merges R buckets); a vector's count
is the number of windows that hold it. Vectors whose count reaches the
collision threshold are verified by their exact inner product. A query stops
when it has verified enough candidates or the windows cover the block; the best
of all blocks are merged.

Inner products become distances by one more coordinate: with ``top`` the largest
norm, a vector gets ``sqrt(top^2 - norm^2)`` and a query 0.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profilekit.runtime import cut_lineage, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a block and queries of a group (about).
BLOCK, QUERIES = 8192, 1024
#: Random directions, share of them that must collide, first window (in standard deviations) and its growth.
PROJECTIONS, COLLISIONS, FIRST, WIDENING = 96, 0.65, 0.4, 1.25
#: Places of a sorted array at which windows may end: a window reaches out to the next.
PLACES = 128
#: A query is done in a block once this many distinct candidates for each neighbour asked for are verified.
ENOUGH = 32
SEED = 7


def usable(vector: Column) -> Column:
    """Not null, of finite components, and not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def directions(size: int, n: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, n))


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each distinct row, and the distinct row that each row is."""
    raw = np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1])[:, 0]
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    return first, inverse


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, top: float) -> list[tuple[int, int, float]]:
    """The ``k`` best rows of a block for each query, by exact inner product, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    first, inverse = distinct_rows(x)
    # Copies of a vector stand or fall together: of each, the k + 1 smallest ids can matter (a query is no answer to itself).
    grouped = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[grouped], np.arange(len(first) + 1))
    rows = x[first]
    extra = np.sqrt(np.maximum(top * top - (rows * rows).sum(axis=1), 0.0))
    axes = directions(x.shape[1] + 1, PROJECTIONS)
    projected = np.column_stack([rows, extra]) @ axes
    asked = np.column_stack([q, np.zeros(len(q))]) @ axes
    by = np.argsort(projected, axis=0)
    line = np.take_along_axis(projected, by, axis=0)
    spread = max(float(projected.std()), 1e-12)
    need, enough, n = math.ceil(COLLISIONS * PROJECTIONS), ENOUGH * k, len(first)
    # Bitmaps of what lies before each of a few places in a sorted array: a window is the difference of two.
    places = np.linspace(0, n, PLACES + 1).astype(int)
    before = np.empty((PROJECTIONS, PLACES + 1, (n + 7) // 8), np.uint8)
    rank = np.empty(n, int)
    for j in range(PROJECTIONS):
        rank[by[:, j]] = np.arange(n)
        before[j] = np.packbits(rank < places[:, None], axis=1)
    every = np.arange(PROJECTIONS)
    live, counts, half = np.arange(len(q)), np.zeros((len(q), n), np.uint8), FIRST * spread
    while len(live):
        edge = lambda shift, side: np.stack([np.searchsorted(line[:, j], asked[live, j] + shift, side) for j in every], axis=1)
        low = np.searchsorted(places, edge(-half, "left"), "right") - 1
        high = np.searchsorted(places, edge(half, "right"), "left")
        for i, query in enumerate(live):
            inside = before[every, high[i]] ^ before[every, low[i]]
            counts[query] = np.unpackbits(inside, axis=1, count=n).sum(axis=0, dtype=np.uint8)
        passed = (counts[live] >= need).sum(axis=1)
        covered = ((places[low] == 0) & (places[high] == n)).all(axis=1)
        live = live[(passed < enough) & ~covered]
        half *= WIDENING
    out: list[tuple[int, int, float]] = []
    for i in range(len(q)):
        candidates = np.flatnonzero(counts[i] >= need)
        scores = (rows[candidates] * q[i]).sum(axis=1)
        if len(candidates) > k + 1:
            cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            candidates, scores = candidates[scores >= cut], scores[scores >= cut]
        best = []
        for c, score in zip(candidates, scores, strict=True):
            copies = ids[grouped[bounds[c] : bounds[c + 1]]]
            best += [(-score, int(v)) for v in copies[copies != query_ids[i]][: k + 1]]
        out += [(int(query_ids[i]), v, -score) for score, v in sorted(best)[:k]]
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` nearest found for each row that ``queries`` selects.

    Vectors that are null, zero or not finite, and rows with a null id, take no
    part. Of repeated ids each row counts. Vectors of unlike length raise an error.
    Queries and blocks meet in groups of bounded size; nothing is broadcast.
    """
    v = F.col(quoted(embedding)).cast("array<double>")
    rows = vectors.where(F.col(quoted(vec_id)).isNotNull() & usable(v)).select(F.col(quoted(vec_id)).alias("vec_id"), v.alias("v"), queries.alias("asks"))
    rows = cut_lineage(rows)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, asked, top = rows.agg(F.count("*"), F.count_if("asks"), F.max(norm)).first()
    blocks, groups = max(1, math.ceil(n / block)), max(1, math.ceil((asked or 0) / QUERIES))
    dealt = lambda many, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    data = rows.select("vec_id", "v", dealt(blocks, 1).alias("block"), every(groups).alias("query_group"))
    wanted = rows.where("asks").select("vec_id", "v", dealt(groups, 2).alias("query_group"), every(blocks).alias("block"))

    def search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(data):
            stack = lambda f: np.array(f["v"].tolist(), np.float64)
            found = search_block(data["vec_id"].to_numpy(), stack(data), queries["vec_id"].to_numpy(), stack(queries), k, float(top))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["query_group", "block"]
    found = wanted.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
