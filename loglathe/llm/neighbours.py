"""Approximate nearest neighbours by counting collisions on single projections.

Every vector of unit length is projected on ``projections`` random lines; per line a block of
vectors is a sorted array. A query opens a window around its own projection in every array and
widens all of them level by level (virtual rehashing: no table is built anew for a wider bucket).
Each vector that falls into a window collides once; those with at least ``threshold`` collisions
are verified by their exact distance. A query stops when it has verified ``k`` vectors within the
distance of its level, or when the windows cover everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Collide:
    """``threshold`` is a share of the projections. ``start`` and ``growth``: distances between unit
    vectors at the first level and from one level to the next. ``reach``: half a window's width as a
    multiple of the level's distance. Blocks bound what a task holds, not what is searched."""

    projections: int = 24
    threshold: float = 0.66
    start: float = 0.3
    growth: float = 1.6
    reach: float = 1.2
    block: int = 8192
    queries: int = 4096


def usable(vector: str) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(v, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that no square over- or underflows; exact, and without effect
    on a cosine."""
    _, power = np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))
    half = power // 2  # in two steps, as the factor itself may be out of range
    return np.ldexp(np.ldexp(vectors, -half), half - power)


def cosines(vectors: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosine of each row with a row of ``other`` (or with its only row), for scaled vectors. Rows are
    summed one by one in the same way, so that equal vectors have equal cosines."""
    norm = lambda x: np.sqrt((x * x).sum(1))
    return (vectors * other).sum(1) / (norm(vectors) * norm(other))


def search_block(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, rule: Collide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine): the verified vectors of one block that are nearest to each query."""
    base, queries = scaled(base), scaled(queries)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    asked = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    unit32, asked32 = unit.astype(np.float32), asked.astype(np.float32)
    lines = np.random.default_rng(55).normal(size=(base.shape[1], rule.projections))
    shadow, own = unit @ lines, asked @ lines
    order = np.argsort(shadow, 0, kind="stable")
    arrays = np.ascontiguousarray(np.take_along_axis(shadow, order, 0).T)
    order = np.ascontiguousarray(order.T.astype(np.int32))
    need, n = int(np.ceil(rule.threshold * rule.projections)), len(ids)
    found_by: list[np.ndarray] = []
    for q in range(len(queries)):
        count, similar = np.zeros(n, np.uint8), np.full(n, -np.inf)
        middle = [int(np.searchsorted(line, x)) for line, x in zip(arrays, own[q])]
        low, high, radius, done = middle, list(middle), rule.start, False
        while not done:
            whole = radius > 2.0
            half = np.inf if whole else rule.reach * radius
            wider = [line.searchsorted([x - half, x + half]).tolist() for line, x in zip(arrays, own[q])]
            for line, (a, b), x, y in zip(order, wider, low, high):
                # only what the wider window adds on either side
                count[line[a:x]] += 1
                count[line[y:b]] += 1
            low, high = (list(w) for w in zip(*wider))
            new = np.flatnonzero((count >= need) & (similar == -np.inf))
            similar[new] = unit32[new] @ asked32[q]
            similar[new[ids[new] == query_ids[q]]] = -2
            done = whole or np.count_nonzero(similar >= 1 - radius**2 / 2) >= k
            radius *= rule.growth
        found = np.flatnonzero(similar > -2)
        if len(found) > k:
            # near the border all stay in, until exact values and ids decide
            close = similar[found]
            found = found[close >= np.partition(close, -k)[-k] - 1e-5]
        found_by.append(found)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(len(queries)):
        found = found_by[q]
        exact = cosines(base[found], queries[q : q + 1])
        best = np.lexsort((ids[found], -exact))[:k]
        rows.append((np.full(len(best), query_ids[q]), ids[found[best]], exact[best]))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(none, *rows))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, rule: Collide = Collide(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` vectors for every query, nearest by cosine first.

    All rows are indexed, in blocks by hash of the id; every block of queries meets every block of
    vectors, so a task holds one of each. Vectors that are not usable take part on neither side; of
    rows that repeat an id the first in component order counts; only vectors of one length are
    compared; ties go to the smaller id; with fewer than ``k`` candidates all are found.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    own = own.where(F.col("id").isNotNull() & usable("v"))
    own = own.groupBy("id").agg(F.min(F.struct("v", "q")).alias("x")).select("id", "x.v", "x.q")
    n, asked = own.agg(F.count("*"), F.count_if(F.col("q"))).first()
    blocks, groups = max(1, -(-n // rule.block)), max(1, -(-(asked or 0) // rule.queries))
    place = lambda many, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    base = own.select("id", "v", F.size("v").alias("d"), place(blocks, 1).alias("b"), every(groups).alias("g"))
    queries = own.where("q").select("id", "v", F.size("v").alias("d"), place(groups, 2).alias("g"), every(blocks).alias("b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "vec_id": none, "score": pa.array([], pa.float64())})
        take = lambda t: (t.column("id").to_numpy(), np.stack(t.column("v").combine_chunks().to_numpy(zero_copy_only=False)))
        q, v, score = search_block(*take(left), *take(right), k, rule)
        return pa.table({"query_id": q, "vec_id": v, "score": score})

    keys = ("d", "b", "g")
    found = base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
