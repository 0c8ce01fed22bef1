"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Best, in_arrow, materialize, matrix, modal_size, on_grid, only, query_rows

#: Candidates scored against a group of queries at once.
CHUNK, GROUP = 4096, 32


def train(sample: np.ndarray, books: int, words: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Full-dimensional codebooks (books, words, dimension): each by k-means on what the ones before leave over."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32)
    out = np.zeros((books, words, sample.shape[1]), np.float32)
    for b in range(books):
        centres = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1)[None, :] - 2 * left @ centres.T).argmin(1)
            counts = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(counts)
            sums = np.add.reduceat(left[order], np.concatenate([[0], np.cumsum(counts)[:-1]])[filled], axis=0)
            centres[filled] = sums / counts[filled, None]
            empty = np.flatnonzero(counts == 0)
            centres[empty] = left[rng.choice(len(left), len(empty))]
        out[b] = centres
        left = left - centres[((centres**2).sum(1)[None, :] - 2 * left @ centres.T).argmin(1)]
    return out


def encode(vectors: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte for each codebook) by beam search, and the squared norms of what they stand for."""
    n, words = len(vectors), books.shape[1]
    left, codes = vectors.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        width = min(beam, flat.shape[1])
        keep = np.argpartition(flat, width - 1, axis=1)[:, :width]
        way, word = keep // words, keep % words
        left = np.take_along_axis(left, way[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, way[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    best = (left**2).sum(2).argmin(1)
    codes = codes[np.arange(n), best]
    stands = sum(book[codes[:, b].astype(np.int64)] for b, book in enumerate(books))
    return codes, (stands**2).sum(1).astype(np.float32)


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", books: int = 16, words: int = 256, beam: int = 4, sample: int = 16384) -> tuple[DataFrame, np.ndarray | None, int]:
    """The index of every usable row (id, vector, codes, norm), written to the shared folder; the codebooks; the vectors' size.

    Codebooks are fitted on at most `sample` rows, those of the smallest hash; 16 books of 256 words of 64 floats are 1 MB,
    whatever the table's size. All rows are encoded.
    """
    rows = only(df, id_col, vec_col).where(F.col(id_col).isNotNull())
    size = modal_size(rows, vec_col)
    usable = rows.where(F.size(vec_col) == size) if size else rows.limit(0)
    taken = usable.orderBy(F.xxhash64(id_col), id_col, vec_col).limit(sample).toArrow().combine_chunks().to_batches()
    parts = [v for v in (_useful(b.column(1), size)[1] for b in taken) if len(v)] if size else []
    if not parts:
        return rows.limit(0), None, size
    codebooks = train(np.concatenate(parts), books, words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at, values = _useful(batch.column(1), size)
            for lo in range(0, len(at), CHUNK):
                part = values[lo : lo + CHUNK]
                codes, norms = encode(part, codebooks, beam)
                yield {"id": batch.column(0).take(pa.array(at[lo : lo + CHUNK])), "vector": list(part), "codes": [c.tobytes() for c in codes], "norm": norms}

    return materialize(in_arrow(rows, index, "id long, vector array<double>, codes binary, norm float")), codebooks, size


def _useful(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, values = matrix(column, size)
    some = (values != 0).any(axis=1)
    return at[some], values[some]


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, shortlist: int = 256, block: int = 4096, part: int = 1 << 16, books: int = 16, words: int = 256, beam: int = 4, sample: int = 16384) -> DataFrame:
    """Each query's k nearest found by Euclidean distance: query_id, rank (from 1), vec_id, score (the exact distance).

    Additive quantisation: rows are encoded by beam search over full-dimensional residual codebooks. Blocks of about `block` queries
    meet parts of about `part` rows, each cell once (see on_grid): rows are scored from lookup tables of query times codeword and
    the stored norms, the `shortlist` best for each query in each chunk of 4096 rows are reranked exactly on the original vectors,
    and the k best of all cells are merged. What is reranked holds the `shortlist` best of all rows, however they are dealt, and
    grows with the rows, so recall does not fall as tables grow.

    Queries are rows whose id is divisible by `every`; candidates are all rows but the query's own id. Ties go to the smaller id;
    fewer candidates than k: all of them. Null ids and vectors, zero vectors, those with null or non-finite components and those
    not of the commonest length take no part. A repeated id counts once. An empty table gives no rows.
    """
    index, codebooks, size = build_index(df, id_col, vec_col, books, words, beam, sample)
    if codebooks is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def search(asked: pa.Table, given: pa.Table) -> dict | None:
        at, values = _useful(asked.column("vector").combine_chunks(), size)
        ids = asked.column("id").to_numpy()[at]
        if not len(ids):
            return None
        own = given.column("id").to_numpy()
        vectors = given.column("vector").combine_chunks().flatten().to_numpy().reshape(len(own), size)
        codes = np.frombuffer(b"".join(given.column("codes").to_pylist()), np.uint8).reshape(len(own), -1).astype(np.int64)
        norms = given.column("norm").to_numpy()
        best = Best(len(ids), k, np.float64, np.inf)
        for lo in range(0, len(own), CHUNK):
            piece = slice(lo, lo + CHUNK)
            n = len(own[piece])
            keys, got = [], []
            for first in range(0, len(ids), GROUP):
                q = slice(first, first + GROUP)
                tables = np.einsum("qd,bwd->qbw", values[q].astype(np.float32), codebooks)
                dots = np.zeros((len(ids[q]), n), np.float32)
                for b in range(codes.shape[1]):
                    dots += tables[:, b][:, codes[piece, b]]
                rough = norms[piece][None, :] - 2 * dots
                rough[ids[q, None] == own[piece][None, :]] = np.inf
                take = np.argpartition(rough, shortlist - 1, axis=1)[:, :shortlist] if n > shortlist else np.broadcast_to(np.arange(n), rough.shape)
                if n > shortlist:
                    edge = np.take_along_axis(rough, take, 1).max(axis=1)
                    for row in np.flatnonzero((rough <= edge[:, None]).sum(axis=1) > shortlist):
                        take[row] = np.lexsort((own[piece], rough[row]))[:shortlist]  # of those alike at the edge, the smaller ids
                exact = np.stack([np.sqrt(((vectors[piece][t] - v) ** 2).sum(axis=1)) for t, v in zip(take, values[q], strict=True)])
                keep = np.lexsort((own[piece][take], exact), axis=1)[:, : 4 * k]
                keys.append(np.take_along_axis(exact, keep, 1))
                got.append(own[piece][np.take_along_axis(take, keep, 1)])
            keys, got = np.concatenate(keys), np.concatenate(got)
            best.add(keys, got, got == ids[:, None])
        return best.rows(ids)

    queries = query_rows(only(df, id_col, vec_col).where(F.col(id_col).isNotNull()), id_col, vec_col, size, every)
    found = on_grid(queries, index, search, "query_id long, vec_id long, key double", block, part)
    window = Window.partitionBy("query_id").orderBy("key", "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("key").alias("key"))
    return merged.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("key").alias("score"))
