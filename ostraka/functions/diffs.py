"""Differences of two versions of a document's entries, and the likeness of two strings; both by difflib, a document or pair at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from difflib import SequenceMatcher, ndiff

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructType

_INT = IntegerType()
_PLAN = ArrayType(StructType().add("old", _INT).add("new", _INT).add("kept", BooleanType()))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """The share of characters in matching blocks, 0 to 1; null if either is null or empty. Equal strings are not compared."""
    usable = (F.length(a) > 0) & (F.length(b) > 0)
    differ = usable & (a != b)
    # the function runs for every row, so rows that need no comparison reach it as nulls
    return F.when(usable & (a == b), 1.0).when(differ, _ratio(F.when(differ, a), F.when(differ, b)))


def _changes(a: list, b: list) -> list[tuple[int | None, int | None, str]]:
    """Each entry of a difference in order: its place in a, its place in b, kept, removed or added."""
    i = j = 0
    out = []
    for line in ndiff(a, b):
        mark = line[0]
        if mark == "?":
            continue
        out.append((i if mark != "+" else None, j if mark != "-" else None, mark))
        i, j = i + (mark != "+"), j + (mark != "-")
    return out


def _row_by_row(one: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one of each row; null if any value is. Only one row at a time is held as Python objects, however many a batch has."""
    parts = [pa.array([], kind)]
    for i in range(len(columns[0])):
        row = [c[i].as_py() for c in columns]
        parts.append(pa.array([None if any(v is None for v in row) else one(*row)], kind))
    return pa.concat_arrays(parts)


def _places(old: list, new: list, is_word: list) -> list[int | None]:
    found: list[int | None] = []
    waiting: deque[int] = deque()
    for _, at, mark in _changes(old, new):
        if mark == "+":
            if waiting:
                found[waiting.popleft()] = at if is_word[at] else None
            continue
        if mark == "-":
            waiting.append(len(found))
        else:
            waiting.clear()
        found.append(at if mark == " " else None)
    return found


@F.arrow_udf(ArrayType(_INT))
def _map(old: pa.Array, new: pa.Array, words: pa.Array) -> pa.Array:
    return _row_by_row(_places, pa.list_(pa.int32()), old, new, words)


def token_map(old: Column, new: Column, is_word: Column) -> Column:
    """array<int>: for each old token its place among the new ones, or null.

    old, new: array<string>; is_word: array<boolean> for the new ones. A removed token takes the place of the added token that follows it, in turn, if
    that one is a word. A null array gives null.
    """
    return _map(old, new, is_word)


def _planned(old: list, new: list) -> list[dict]:
    found, removed = [], deque()
    for before, after, mark in _changes(old, new):
        if mark == "-":
            removed.append(before)
        elif mark == "+":
            found.append({"old": removed.popleft() if removed else None, "new": after, "kept": False})
        else:
            found.append({"old": before, "new": after, "kept": True})
    return found


@F.arrow_udf(_PLAN)
def _pairs(old: pa.Array, new: pa.Array) -> pa.Array:
    return _row_by_row(_planned, pa.list_(pa.struct([("old", pa.int32()), ("new", pa.int32()), ("kept", pa.bool_())])), old, new)


def merged(old: Column, new: Column, key: Callable[[Column], Column], merge: Callable[[Column, Column], Column] = lambda _, b: b) -> Column:
    """The new entries, each as the old one (with its annotations) where its key is unchanged; an added one is merged with the removed one before it, in turn.

    old, new: arrays of one type; key: an entry's text; merge: of a removed and an added entry, by default the added one.
    """
    plan = _pairs(F.transform(old, key), F.transform(new, key))
    at = lambda items, i: F.get(items, i)
    return F.transform(plan, lambda p: F.when(p["kept"], at(old, p["old"])).when(p["old"].isNull(), at(new, p["new"])).otherwise(merge(at(old, p["old"]), at(new, p["new"]))))
