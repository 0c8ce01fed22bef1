"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Best, matrix, modal_size, on_grid, only, query_rows

#: Candidates whose dense score arrays are held at once, and queries that share them.
CHUNK, GROUP = 4096, 32


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); Python integers where 64 bits could overflow."""
    scaled = np.floor(values * scale)
    return scaled.astype(np.int64) if not scaled.size or np.abs(scaled).max() < 2.0**62 else np.vectorize(int, otypes=[object])(np.where(np.isfinite(scaled), scaled, np.sign(values) * 1e308))


def accumulate(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Scores (a row for each query): for each term the weighted postings are added to the dense arrays."""
    scores = np.zeros((len(queries), len(docs)), queries.dtype if queries.dtype == docs.dtype else object)
    for term in range(docs.shape[1]):
        users = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(docs[:, term])
        if not len(users) or not len(postings):
            continue
        weights = docs[postings, term]
        if len(users) == len(queries) and len(postings) == len(docs):
            scores += queries[:, term][:, None] * weights[None, :]
        else:
            scores[np.ix_(users, postings)] += queries[users, term][:, None] * weights[None, :]
    return scores


def inner_product_topk(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, scale: float = 1024.0, block: int = 4096, part: int = 1 << 16) -> DataFrame:
    """Each query's k candidates of the highest integer inner product: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`; candidates are all rows but the
    query's own id. Blocks of about `block` queries meet parts of about `part` candidates, each cell once (see on_grid); every
    candidate is scored; a cell keeps k for each query and the kept ones of all cells are merged. Ties go to the smaller id.
    Fewer candidates: all of them. Null ids and vectors, those with null or non-finite components and those not of the commonest
    length take no part; a repeated id counts once (its highest score as a candidate, its smallest vector as a query). An empty
    table gives no rows. A score beyond a long is cut to the nearest long in the result, after ranking.
    """
    rows = only(df, id_col, vec_col).where(F.col(id_col).isNotNull())
    size = modal_size(rows, vec_col)
    if not size:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def search(asked: pa.Table, given: pa.Table) -> dict | None:
        (ids, values), (own, docs) = (usable(t, size) for t in (asked, given))
        if not len(ids) or not len(own):
            return None
        wanted = quantised(values, scale)
        best = Best(len(ids), k, object if wanted.dtype == object else np.int64, _WORST)
        for lo in range(0, len(own), CHUNK):
            piece, piece_ids = quantised(docs[lo : lo + CHUNK], scale), own[lo : lo + CHUNK]
            left = wanted
            # products that might not fit in 64 bits are made of Python integers
            if object in (piece.dtype, left.dtype) or float(np.abs(piece).max(initial=0)) * float(np.abs(left).max(initial=0)) * size >= 2.0**62:
                piece, left = piece.astype(object), left.astype(object)
                best.keys = best.keys.astype(object)
            kept_keys, kept_ids = [], []
            for first in range(0, len(left), GROUP):
                scores = accumulate(left[first : first + GROUP], piece)
                scores[ids[first : first + GROUP, None] == piece_ids[None, :]] = _WORST if scores.dtype == object else -_WORST
                keys = -scores
                take = _least(keys, piece_ids, k)
                kept_keys.append(np.take_along_axis(keys, take, 1))
                kept_ids.append(piece_ids[take])
            width = max(x.shape[1] for x in kept_keys)
            keys = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=_WORST) for x in kept_keys])
            got = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1])), mode="edge") for x in kept_ids])
            best.add(keys, got, got == ids[:, None])
        out = best.rows(ids)
        return out | {"key": np.array([min(max(int(x), -_WORST), _WORST) for x in out["key"]], np.int64)}

    queries = query_rows(rows, id_col, vec_col, size, every)
    candidates = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    found = on_grid(queries, candidates, search, "query_id long, vec_id long, key long", block, part)
    window = Window.partitionBy("query_id").orderBy("key", "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("key").alias("key"))
    return merged.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", (-F.col("key")).alias("score"))


def usable(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the usable rows of (id, vector)."""
    at, values = matrix(table.column("vector").combine_chunks(), size)
    return table.column("id").to_numpy()[at], values


#: A key that no score has: keys are negated scores of less than 2**63.
_WORST = 2**63 - 1


def _least(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's candidates that can be among its k best of distinct ids: all up to the k-th smallest key, ties and repeats included."""
    n = keys.shape[1]
    width = min(n, 4 * k)
    if n <= width:
        return np.broadcast_to(np.arange(n), keys.shape).copy()
    if keys.dtype == object:
        return np.stack([np.lexsort((ids, row)) for row in keys])
    take = np.argpartition(keys, width - 1, axis=1)[:, :width]
    edge = np.take_along_axis(keys, take, 1).max(axis=1)
    # a row is settled if at least k distinct ids lie strictly below the cut; else it is sorted whole
    settled = np.array([len(np.unique(ids[t][keys[i][t] < edge[i]])) >= k for i, t in enumerate(take)])
    if settled.all():
        return take
    return np.stack([np.lexsort((ids, row)) for row in keys])
