"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Vectors lie in blocks; a block keeps, for each dimension, its vectors sorted by that component. A query walks the
lists of its dimensions from their better ends (sorted access), scores every vector it meets in full (random access),
and stops once the bound, the score of a vector made of the components reached so far, is below its k-th score. Query
blocks meet candidate blocks in a grid of groups of bounded size; each group gives at most k rows per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fichero.llm.common import prepared

#: Vectors in a block of candidates and of queries; the first depth of the walk.
CANDIDATES, QUERIES, DEPTH = 8192, 1024, 16
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows with an id and a vector whose components are all finite numbers."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def walk(block: np.ndarray, order: np.ndarray, query: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions met and their scores, a superset of the ``wanted`` best with all their ties. ``order[d]`` sorts column d.

    The k-th score of the vectors met so far tells how deep the walk must still go at most, for it can only rise: the
    first depth whose bound lies below it. The walk goes there at once. Where the lists down to that depth are longer
    than the block, all of the block is scored.
    """
    size = len(block)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    if not len(up) and not len(down):
        return np.arange(size), np.zeros(size)
    depths = np.unique(np.minimum(size, DEPTH * 2 ** np.arange(size.bit_length() + 1)))
    bounds = block[order[up][:, size - depths], up[:, None]].T @ query[up] + block[order[down][:, depths - 1], down[:, None]].T @ query[down]
    depth, done, met = int(depths[0]), 0, np.zeros(size, bool)
    scores = np.full(size, -np.inf)
    while True:
        if depth * (len(up) + len(down)) >= 2 * size:
            scores, met[:] = block @ query, True
        else:
            fresh = np.zeros(size, bool)
            fresh[order[up, size - depth : size - done]] = True
            fresh[order[down, done:depth]] = True
            at = np.flatnonzero(fresh & ~met)
            scores[at], met[at] = block[at] @ query, True
        least = np.partition(scores, size - wanted)[size - wanted]
        enough = int(depths[(bounds < least) | (depths == size)][0])
        if enough <= depth or met.all():
            break
        done, depth = depth, enough
    at = np.flatnonzero(met & (scores >= least))
    return at, scores[at]


def _best(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        groups = {}
        for length, rows in candidates.groupby(candidates["v"].map(len)):
            ids = rows["id"].to_numpy()
            block = np.floor(64 * np.stack(rows["v"].to_numpy())) if length else np.zeros((len(rows), 0))
            first = np.argsort(ids, kind="stable")
            block, ids = np.ascontiguousarray(block[first]), ids[first]
            largest = np.abs(block).max() if length else 0.0
            groups[length] = block, ids, np.ascontiguousarray(np.argsort(block, axis=0, kind="stable").T), largest
        for row, own, v in zip(queries["row"], queries["id"], queries["v"]):
            if len(v) not in groups:
                continue
            block, ids, order, largest = groups[len(v)]
            query = np.floor(64 * np.asarray(v, np.float64))
            same = np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left")
            if not len(v) or largest * np.abs(query).max() * len(v) < 2**53:
                at, scores = walk(block, order, query, min(len(ids), k + same))
                best = at[np.lexsort((ids[at], -scores))]
                best = best[ids[best] != own][:k]
                values = (block[best] @ query).astype(np.int64)
            else:  # components too large for doubles: whole numbers of any size, kept within a long
                q = [int(x) for x in query]
                exact = [max(_FIRST, min(_LAST, sum(int(a) * b for a, b in zip(r, q)))) for r in block]
                best = np.array(sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-exact[i], ids[i]))[:k], np.int64)
                values = np.array([exact[i] for i in best], np.int64)
            out.append((np.full(len(best), row), np.full(len(best), own), ids[best], values))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), columns)))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` best among ``vectors`` (all, if fewer).

    Components x become floor(64 x); the score is the integer inner product, ties go to the smaller id. Rows with the
    query's own id are left out. Rows without an id, and vectors that are null or hold null or non-finite components,
    take no part; vectors of another length score nothing with a query. A query row that occurs twice is answered
    twice. Scores beyond 64 bits are held at the ends of the long range. Empty tables give an empty table.
    """
    spark = prepared(vectors.sparkSession)
    pool = clean(vectors, id_col, vec_col)
    asked = clean(queries, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())
    across = max(1, math.ceil(pool.count() / CANDIDATES))
    down = max(1, math.ceil(asked.count() / QUERIES))
    left = pool.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(across))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1)).cast("array<long>")))
    right = asked.withColumn("j", F.pmod(F.xxhash64("id", "row"), F.lit(down))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<long>")))
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_best(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
