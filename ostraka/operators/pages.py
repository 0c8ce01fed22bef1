"""Pages of results: rows are ranked by few columns, the rest is read for one page only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def hydrate(narrow: DataFrame, wide: DataFrame, key: str, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of wide for the page of narrow that `order` gives: rank (from 1, over all of narrow), key, narrow's other columns, then wide's.

    Only narrow is sorted, as a top-k; the page (at most `limit` rows) is broadcast and wide is read behind a join with it, so that its large columns never
    reach the sort. key tells rows of narrow apart and breaks ties; rows of wide that repeat a key are all returned; a key that wide lacks has no row. A page beyond the end is empty.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a page has one row at least and begins at 0 or later")
    ids = narrow.orderBy(*order, F.col(key)).offset(offset).limit(limit)
    # the page is small by its limit: one window over it gives the ranks
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, F.col(key))) + F.lit(offset)
    page = ids.withColumn("rank", rank)
    rest = [c for c in wide.columns if c not in (*narrow.columns, "rank")]
    found = wide.select(key, *rest).join(F.broadcast(page), key)
    return found.select("rank", key, *[c for c in narrow.columns if c != key], *rest)


def total(narrow: DataFrame) -> DataFrame:
    """One row: how many rows there are to page through."""
    return narrow.agg(F.count("*").alias("total"))
