"""Searches through the manuscripts of chapters, mapped back to the chapters' lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def windows_that_match(lines: Column, patterns: Sequence[str]) -> Column:
    """array<int>: places where consecutive lines match the patterns one by one; an array of null or too few lines has none."""
    n = len(patterns)
    starts = F.when(F.size(lines) >= n, F.sequence(F.lit(0), F.size(lines) - n)).otherwise(F.array().cast("array<int>"))
    fits = lambda i: reduce(and_, [F.coalesce(F.get(lines, i + k).rlike(p), F.lit(False)) for k, p in enumerate(patterns)])
    return F.filter(starts, fits)


def sign_matches(chapters: DataFrame, patterns: Sequence[str], id_col: str = "id", manuscripts: str = "manuscripts", signs: str = "signs", lines: str = "lines") -> DataFrame:
    """id, manuscripts, positions of the chapters in which some manuscript's signs match: windows of as many lines as there are patterns, each line matching its own.

    chapters: manuscripts array<struct<id>>, signs array<array<string>> (the lines of each manuscript, in the same order), lines array<struct<variants: array<struct<manuscripts:
    array<struct<manuscriptId>>>>>>. manuscripts: the ids of those that match, in order; positions: array<struct<line, variant>> of the chapter's lines and variants that any of them has, in
    order. All is told from a chapter's own row: nothing is shuffled. Nulls match nothing; chapters without a match are left out.
    """
    if not patterns:
        raise ValueError("a search needs one pattern at least")
    pairs = F.arrays_zip(F.transform(manuscripts, lambda m: m["id"]).alias("id"), F.col(signs).alias("signs"))
    hit = F.filter(pairs, lambda p: p["id"].isNotNull() & (F.size(windows_that_match(p["signs"], patterns)) > 0))
    found = chapters.select(F.col(id_col).alias("id"), F.col(lines).alias("lines"), F.array_sort(F.array_distinct(F.transform(hit, lambda p: p["id"]))).alias("manuscripts")).where(F.size("manuscripts") > 0)
    own = lambda variant: F.exists(F.coalesce(variant["manuscripts"], F.array()), lambda m: F.array_contains("manuscripts", m["manuscriptId"]))
    at = lambda line, i: F.filter(F.transform(line["variants"], lambda v, k: F.struct(i.alias("line"), k.alias("variant"), own(v).alias("own"))), lambda x: x["own"])
    positions = F.transform(F.flatten(F.filter(F.transform("lines", at), lambda x: x.isNotNull())), lambda x: F.struct(x["line"].alias("line"), x["variant"].alias("variant")))
    return found.select("id", "manuscripts", F.coalesce(positions, F.array().cast("array<struct<line:int,variant:int>>")).alias("positions"))


# Lines that a dictionary shows of each genre and in all.
EACH_GENRE, IN_ALL = 10, 40


def _bears(words: Column, lemma: str) -> Column:
    """Whether a word of an array (struct<uniqueLemma: array>) has the lemma."""
    return F.coalesce(F.exists(words, lambda w: F.array_contains(w["uniqueLemma"], lemma)), F.lit(False))


def lines_with_lemma(chapters: DataFrame, lemma: str, genre: str | None = None, id_col: str = "id", each: int = EACH_GENRE, total: int = IN_ALL) -> DataFrame:
    """id, genre, line_index, line of the chapters' lines in which a reconstruction or a manuscript has the lemma; of a line's manuscripts those that have it stay.

    chapters: id, genre, lines array<struct<variants: array<struct<reconstruction: array<struct<uniqueLemma>>, manuscripts: array<struct<line: array<struct<uniqueLemma>>>>>>>>. The first
    `each` lines of a genre by id and place, and of those the first `total`. Genres are told one by one before they are put together, so no task has more than one genre's first lines.
    """
    kept = chapters.where(F.col("genre") == genre) if genre else chapters
    own = lambda variant: F.filter(F.coalesce(variant["manuscripts"], F.array()), lambda m: _bears(m["line"], lemma))
    has = lambda line: F.exists(F.coalesce(line["variants"], F.array()), lambda v: _bears(v["reconstruction"], lemma) | (F.size(own(v)) > 0))
    found = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("line_index"), line.alias("line"))), lambda x: has(x["line"]))
    rows = kept.select(F.col(id_col).alias("id"), "genre", F.explode(found).alias("x")).select("id", "genre", "x.line_index", "x.line")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("genre").orderBy("id", "line_index"))).where(F.col("__n") <= each).drop("__n")
    shown = first.orderBy("id", "line_index").limit(total)
    return shown.withColumn("line", F.col("line").withField("variants", F.transform(F.col("line.variants"), lambda v: v.withField("manuscripts", own(v)))))
