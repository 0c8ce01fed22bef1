"""Documents as lines of tokens, kept nested so that matching needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def sign_lines(text: Column) -> Column:
    """array<string>: lower-cased lines."""
    return F.split(F.lower(text), "\n")


def holds(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands anywhere in the text, be it within another word: a cheap test before the text is cut."""
    low, test = F.lower(text), F.lit(False)
    for word in words:
        test = test | F.contains(low, F.lit(word))
    return test


def line_tokens(line: Column) -> Column:
    """array<string>: the runs of letters of a line, lower-cased."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}]+"), lambda t: t != "")


def token_lines(text: Column, words: Sequence[str] = ()) -> Column:
    """array<array<string>>: the tokens of each line; with words, lines that none of them stands in are left empty."""
    cut = (lambda line: F.when(holds(line, words), line_tokens(line)).otherwise(strings([]))) if words else line_tokens
    return F.transform(F.split(text, "\n"), cut)


def once(value: Column) -> Column:
    """The value, in a form that a later filter on it doesn't compute a second time: the filter stays above the generator."""
    return F.explode(F.array(value))


def replaced(value: Column, held: Sequence[str], pattern: str, by: str) -> Column:
    """The value with a pattern replaced, if it holds any of some strings, one of which all that fits the pattern has: most values then cost no matching."""

    def one(t: Column) -> Column:
        test = F.lit(False)
        for x in held:
            test = test | F.contains(t, F.lit(x))
        return F.when(test, F.regexp_replace(t, pattern, by)).otherwise(t)

    return F.get(F.transform(F.array(value), one), F.lit(0))  # worked out once, then read from the array


def in_a_row(items: Column, words: Sequence[str]) -> Column:
    """Whether the words stand in a row among the items; neither have line breaks in them."""
    return F.contains(F.concat(F.lit("\n"), F.array_join(items, "\n"), F.lit("\n")), F.lit("\n" + "\n".join(words) + "\n"))


def positions(items: Column, wanted: Callable[[Column], Column]) -> Column:
    """array<int>: 0-based positions of the items that are wanted, in order."""
    return F.filter(F.transform(items, lambda x, i: F.when(wanted(x), i)), lambda i: i.isNotNull())


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_index, line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_index", "line"))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_index, token_index, token: one row for each token, in reading order."""
    nested = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(token_lines(F.col(text_col))).alias("line_index", "words"))
    return nested.select("doc_id", "line_index", F.posexplode("words").alias("token_index", "token"))


def ngrams(items: Column, n: int) -> Column:
    """All runs of n consecutive items; none if there are fewer."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, n))


def has_lines(lines: Column) -> Column:
    """Whether an array has an item; null has none."""
    return F.coalesce(F.size(lines) > 0, F.lit(False))
