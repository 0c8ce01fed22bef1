"""Search over nested documents: words in all, any, one line or in a row; patterns over lines of signs; both together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import sign_query
from ..functions.text import in_a_row, once, positions, strings


def _result(docs: DataFrame, id_col: str, matching: Column) -> DataFrame:
    found = docs.select(F.col(id_col), once(matching).alias("matching_lines"))
    return found.where(F.size("matching_lines") > 0).withColumn("match_count", F.size("matching_lines"))


def and_lines(lines: Column, words: Sequence[str]) -> Column:
    """array<int>: the lines that hold any of the words, if the document holds all; else null."""
    wanted = strings(words)
    return F.when(F.size(F.array_except(wanted, F.flatten(lines))) == 0, positions(lines, lambda line: F.arrays_overlap(line, wanted)))


def lemma_and(docs: DataFrame, words: Sequence[str], lines: str = "lines", id_col: str = "doc_id") -> DataFrame:
    """Documents that hold all words anywhere, with the lines that hold any."""
    return _result(docs, id_col, and_lines(F.col(lines), words))


def lemma_or(docs: DataFrame, words: Sequence[str], lines: str = "lines", id_col: str = "doc_id") -> DataFrame:
    """Documents and lines that hold any of the words."""
    return _result(docs, id_col, positions(F.col(lines), lambda line: F.arrays_overlap(line, strings(words))))


def lemma_line(docs: DataFrame, words: Sequence[str], lines: str = "lines", id_col: str = "doc_id") -> DataFrame:
    """Lines that hold all words."""
    return _result(docs, id_col, positions(F.col(lines), lambda line: F.size(F.array_except(strings(words), line)) == 0))


def lemma_phrase(docs: DataFrame, words: Sequence[str], lines: str = "lines", id_col: str = "doc_id") -> DataFrame:
    """Lines that hold the words in a row, each named once. One word alone is lemma_and. Words have no line breaks in them."""
    if len(words) < 2:
        return lemma_and(docs, words, lines, id_col)
    return _result(docs, id_col, positions(F.col(lines), lambda line: in_a_row(line, words)))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def sign_lines(lines: Column, query: str) -> tuple[Column, int]:
    """array<int>: where windows of as many consecutive lines as the query has begin, each line matching its pattern; and how many lines."""
    patterns = sign_query(query)
    first = positions(lines, lambda line: line.rlike(patterns[0]))
    if len(patterns) > 1:
        first = F.filter(first, lambda i: _all([F.coalesce(F.get(lines, i + k).rlike(p), F.lit(False)) for k, p in enumerate(patterns) if k]))
    return first, len(patterns)


def signs(docs: DataFrame, query: str, lines: str = "sign_lines", id_col: str = "doc_id") -> DataFrame:
    """Sign search. For a query of one line, the matching lines; for more, the lines of every window in turn, repeats kept, and match_count counts windows."""
    starts, n = sign_lines(F.col(lines), query)
    found = _result(docs, id_col, starts)
    windows = F.flatten(F.transform("matching_lines", lambda i: F.sequence(i, i + n - 1)))
    return found if n == 1 else found.withColumn("matching_lines", windows)


def both(docs: DataFrame, words: Sequence[str], query: str, lines: str = "lines", signs: str = "sign_lines", id_col: str = "doc_id") -> DataFrame:
    """Documents that hold all words and match the sign query, with the union of their lines (not necessarily a common one), in one pass."""
    starts, n = sign_lines(F.col(signs), query)
    hits = F.struct(and_lines(F.col(lines), words).alias("words"), F.flatten(F.transform(starts, lambda i: F.sequence(i, i + n - 1))).alias("signs"))
    found = docs.select(id_col, once(hits).alias("hits")).where((F.size("hits.words") > 0) & (F.size("hits.signs") > 0))
    union = F.array_sort(F.array_union("hits.words", "hits.signs"))
    return found.select(id_col, union.alias("matching_lines"), F.size(union).alias("match_count"))


def everything(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """No matcher: all documents, no lines."""
    return docs.select(id_col, F.array().cast("array<int>").alias("matching_lines"), F.lit(0).alias("match_count"))


#: The word searches by their names.
LEMMA_MODES = {"and": lemma_and, "or": lemma_or, "line": lemma_line, "phrase": lemma_phrase}


def find(docs: DataFrame, words: Sequence[str] = (), mode: str = "and", query: str = "", lines: str = "lines", signs_col: str = "sign_lines", id_col: str = "doc_id") -> DataFrame:
    """Documents by words, by signs, by both or, without either, all of them: id, matching_lines, match_count.

    By both: documents that either search finds, with the union of their lines. An unknown mode is an error, whether there are words or not, and so is a mode other than `and` without any.
    """
    if mode not in LEMMA_MODES:
        raise ValueError(f"no search is called {mode}: {', '.join(LEMMA_MODES)}")
    if not words and mode != "and":
        raise ValueError(f"{mode} needs words")
    if not words:
        return signs(docs, query, signs_col, id_col) if query.strip() else everything(docs, id_col)
    if not query.strip():
        return LEMMA_MODES[mode](docs, words, lines, id_col)
    if mode == "and":
        return both(docs, words, query, lines, signs_col, id_col)
    a = LEMMA_MODES[mode](docs, words, lines, id_col).select(id_col, F.col("matching_lines").alias("a"))
    b = signs(docs, query, signs_col, id_col).select(id_col, F.col("matching_lines").alias("b"))
    union = F.array_sort(F.array_union("a", "b"))
    return a.join(b, id_col).select(id_col, union.alias("matching_lines"), F.size(union).alias("match_count"))


def page(found: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, count: str = "exact") -> tuple[DataFrame, DataFrame | None]:
    """A page in the given total order, and the totals over all hits: exact counts, or for "none" nothing, or for "page" whether more rows follow."""
    ordered = found.orderBy(*order)
    if count == "page":
        ahead = ordered.offset(offset).limit(limit + 1)
        return ordered.offset(offset).limit(limit), ahead.agg((F.count("*") > limit).alias("has_next"))
    totals = found.agg(F.count("*").alias("item_count"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("match_count_total"))
    return ordered.offset(offset).limit(limit), totals if count == "exact" else None


# Texts with manuscripts: rows of (chapter key, line, variant, words), the flattened shape of nested chapters


def corpus_lemma(rows: DataFrame, words: Sequence[str], mode: str, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Chapters by words of their lines' variants: mode and, or, line or phrase.

    rows: keys, line_index, variant_index, words (array). A phrase is treated as line, as the searched system does; strict finds it in a row.
    Matches are distinct (line, variant) pairs.
    """
    wanted = strings(words)
    if mode == "and":
        rows = rows.where(F.arrays_overlap("words", wanted))  # only what holds a word is counted
        vocabulary = rows.select(*keys, F.explode("words").alias("w")).where(F.col("w").isin(list(words))).groupBy(*keys).agg(F.count_distinct("w").alias("n"))
        rows = rows.join(vocabulary.where(F.col("n") == len(set(words))).drop("n"), list(keys), "left_semi")
    if mode in ("and", "or"):
        test = F.arrays_overlap("words", wanted)
    elif strict and mode == "phrase":
        test = in_a_row(F.col("words"), words)
    else:
        test = F.size(F.array_except(wanted, F.col("words"))) == 0
    return rows.where(test).select(*keys, "line_index", "variant_index").distinct()


def corpus_result(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chapters with how many (line, variant) pairs match, most first."""
    return matches.groupBy(*keys).agg(F.count("*").alias("match_count")).orderBy(F.desc("match_count"), *keys)
