"""Compression of vectors: each part of a vector becomes the number of the nearest entry of that part's codebook, exactly, in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import in_arrow, matrix, materialize, modal_size, only

#: Vectors that are compared at once, and pairs of a vector and an entry that are evaluated at once.
CHUNK, PAIRS = 4096, 1 << 17
#: Squares of integers below 2**28 and their sums stay far within float32's range; beyond that everything is evaluated in integers.
SCREENED = 2**28
_LONG = 2**63 - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as Python integers where 64 bits are too few."""
    if not values.size or np.abs(values).max() < 2.0**62 / scale:
        return np.floor(values * scale).astype(np.int64)
    # beyond 2**53 a double is an integer
    flat = [int(np.floor(x * scale)) if abs(x) < 2.0**53 else int(x) * scale for x in values.ravel().tolist()]
    return np.array([*flat, None], object)[:-1].reshape(values.shape)


def distances(x: np.ndarray, book: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (x[row], book[entry])."""
    out = np.zeros(len(rows), x.dtype)
    for lo in range(0, len(rows), PAIRS):
        apart = x[rows[lo : lo + PAIRS]] - book[entries[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = (apart * apart).sum(axis=1)
    return out


def overlapping(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to each row, by one float32 matrix product and a bound of its rounding error.

    |c|² - 2 x·c orders entries as the distance does. With u = 2**-24, the product of d terms of rounded inputs, added in any order, is off by at most
    g = (d+4)u / (1 - (d+4)u) times |x||c| (Cauchy-Schwarz); sums in double precision add 2**-50 of their terms.
    """
    terms = (x.shape[1] + 4) * 2.0**-24
    g = terms / (1 - terms)
    dots = (x.astype(np.float32) @ book.T.astype(np.float32)).astype(np.float64)
    squares = (book * book).sum(axis=1).astype(np.float64)
    lengths = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)[None, :]
    score = squares[None, :] - 2 * dots
    off = (2 * g * lengths + 2.0**-50 * (squares[None, :] + 2 * np.abs(dots))) * (1 + 2.0**-40)
    return score - off <= (score + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the smaller one, and its exact squared distance: float32 screens, integers decide."""
    most = max([abs(int(x.max())), abs(int(x.min())), abs(int(book.max())), abs(int(book.min()))]) if x.size and book.size else 0
    exact = x.dtype == object or book.dtype == object or 4 * most * most * max(1, x.shape[1]) >= 2**62
    if exact:
        x, book = x.astype(object), book.astype(object)
    choice, best = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for lo in range(0, len(x), CHUNK):
        some = x[lo : lo + CHUNK]
        near = overlapping(some, book) if most < SCREENED and not exact else np.ones((len(some), len(book)), bool)
        rows, entries = np.nonzero(near)  # by row, then by entry
        found = distances(some, book, rows, entries)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(found, starts)
        first = np.flatnonzero(found == np.repeat(least, np.diff(np.append(starts, len(rows)))))
        first = first[np.diff(rows[first], prepend=-1) > 0]
        choice[lo : lo + CHUNK], best[lo : lo + CHUNK] = entries[first], least
    return choice, best


def cut(values: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(values, parts, axis=1)


def refined(rows: DataFrame, vec_col: str, size: int, scale: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and each entry that was used becomes the floored mean of its parts. Tasks add up, only a row for each entry reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, values = matrix(batch.column(0), size)
            for p, (x, book) in enumerate(zip(cut(integers(values, scale), len(books)), books)):
                if not len(x):
                    continue
                choice, _ = nearest(x, book)
                order = np.argsort(choice, kind="stable")
                used, starts, n = np.unique(choice[order], return_index=True, return_counts=True)
                totals[p][used] += np.add.reduceat(x[order], starts, axis=0).astype(object)
                counts[p][used] += n
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield {"part": np.full(len(used), p), "entry": used, "n": n[used], "sums": [[str(v) for v in totals[p][e]] for e in used]}

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        columns = zip(*frame["sums"], strict=True)
        return pd.DataFrame({"part": [key[0]], "entry": [key[1]], "n": [frame["n"].sum()], "sums": [[str(sum(map(int, c))) for c in columns]]})

    schema = "part int, entry int, n long, sums array<string>"  # sums are spelt out: they may pass any number type
    found = in_arrow(rows.select(vec_col), sums, schema).groupBy("part", "entry").applyInPandas(added, schema).collect()
    fresh = [b.astype(object) for b in books]
    for r in found:
        fresh[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return [_narrow(b) for b in fresh]


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64) if all(abs(v) < 2**62 for v in values.ravel()) else values.astype(object)


def usable(vec_col: str, size: int) -> Column:
    """Vectors of that size without null and non-finite components."""
    vector = F.col(vec_col)
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def total_by_group(df: DataFrame, group: str, value: str, name: str, share: int = 1000) -> DataFrame:
    """df with the sum of value over the rows of its group (nulls are one group), cut to the greatest long.

    A group with over one in `share` rows is broadcast: there are fewer than `share` of those. The others meet in a join in which no key is hot.
    """
    n = df.count()
    sums = materialize(df.groupBy(group).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("__sum"), F.count("*").alias("__n")).select(F.col(group).alias("__group"), F.least("__sum", F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias(name), "__n"))
    hot = F.col("__n") * share > n
    same = F.col(group).eqNullSafe(F.col("__group"))
    met = df.join(F.broadcast(sums.where(hot)), same, "left")
    common = met.where("__n is not null").select(*df.columns, name)
    rare = met.where("__n is null").select(*df.columns).join(sums.where(~hot).hint("merge"), same).select(*df.columns, name)
    return common.unionAll(rare)


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """id, code (two hex digits for each part), error (squared distances to the chosen entries, summed over parts), label_error (error summed over rows of that label, nulls together), codebooks_sha256.

    Components become floor(scale * x); vectors are cut into equal consecutive parts. Each position's codebook starts as that part of the `entries` smallest ids; `rounds` times
    every part goes to its nearest entry (squared Euclidean distance, ties to the smaller index) and each used entry becomes the componentwise floored mean of
    its parts; then parts are assigned a last time. A float32 matrix product with a bound of its error screens the entries; all that can be nearest are evaluated
    in 64-bit integers, or in Python's where those could overflow. codebooks_sha256 is that of all entries' components in decimal, comma-joined, by part, entry and place.

    Codebooks (parts * entries entries) are what the driver holds and tasks are sent; sums are added up in the tasks. Rows whose vector is null, has null or non-finite
    components, or is not of the commonest length take no part. A null id counts behind all others; rows that repeat an id each count, those with the smaller vector first. Fewer rows
    than `entries`: as many entries. An empty table gives no rows. Other columns are ignored. error and label_error are cut to the greatest long. A length that `parts` does not divide is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell 256 entries apart")
    rows = only(df, id_col, vec_col, label_col).where(F.col(vec_col).isNotNull())
    size = modal_size(rows, vec_col)
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(usable(vec_col, size))
    seeds = rows.orderBy(F.asc_nulls_last(id_col), vec_col).limit(entries).collect()
    ids = rows.schema[id_col]
    kind = T.StructType([ids, rows.schema[label_col], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not seeds or not size:
        return df.sparkSession.createDataFrame([], kind.add("label_error", "long").add("codebooks_sha256", "string")).drop(label_col)
    books = cut(integers(np.array([r[vec_col] for r in seeds], np.float64), scale), parts)
    for _ in range(rounds):
        books = refined(rows, vec_col, size, scale, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at, values = matrix(batch.column(vec_col), size)
            found = [nearest(x, book) for x, book in zip(cut(integers(values, scale), parts), books)]
            codes = np.stack([choice for choice, _ in found], axis=1).astype(np.uint8)
            errors = sum(best.astype(object) for _, best in found)
            kept = pa.array(at)
            yield {id_col: batch.column(id_col).take(kept), label_col: batch.column(label_col).take(kept), "code": [bytes(c).hex() for c in codes], "error": [min(int(e), _LONG) for e in errors]}

    spelt = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    assigned = materialize(in_arrow(rows, coded, kind))
    return total_by_group(assigned, label_col, "error", "label_error").select(id_col, "code", "error", "label_error", F.lit(spelt).alias("codebooks_sha256"))
