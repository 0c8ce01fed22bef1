"""Predicates as Column builders."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import page_number
from ..functions.sortkeys import plain
from ..functions.text import strings


def visible(scopes: Column, allowed: Sequence[str] = (), only_missing: bool = False) -> Column:
    """Row-level security: no scopes, none in the list, or one that is allowed. only_missing: the stricter notion of public."""
    if only_missing:
        return scopes.isNull()
    open_to_all = scopes.isNull() | (F.size(scopes) == 0)
    return open_to_all | F.arrays_overlap(scopes, strings(allowed)) if allowed else open_to_all


def number_is(number: str, prefix: Column, digits: Column, suffix: Column) -> Column:
    """A number of two or three parts; `*` stands for any part, and without a suffix after a wildcard any suffix fits."""
    parts = number.split(".")
    head, body, tail = (parts[0], parts[1], "") if len(parts) == 2 else (parts[0], ".".join(parts[1:-1]), parts[-1])
    test = F.lit(True)
    for want, column in ((head, prefix), (body, digits), (tail, suffix)):
        if want != "*" and not (column is suffix and not want and "*" in (head, body)):
            test = test & (column == want)
    return test


def genre_has(categories: Column, path: str) -> Column:
    """All parts of a colon-separated path stand somewhere in the genres' categories, not necessarily in one."""
    return F.size(F.array_except(strings(path.split(":")), F.flatten(categories))) == 0


def genre_at(categories: Column, path: str) -> Column:
    """For each place, some genre has that part of the path there."""

    def some(i: int, part: str) -> Column:
        return F.exists(categories, lambda c: F.coalesce(F.get(c, F.lit(i)) == part, F.lit(False)))

    out = F.lit(True)
    for i, part in enumerate(path.split(":")):
        out = out & some(i, part)
    return out


def within_site(df: DataFrame, site_col: str, places: DataFrame, wanted: str) -> DataFrame:
    """Rows of a place or of its children, by name, else by upper-cased id, else literally. places: id, name, parent."""
    hit = places.where((F.col("name") == wanted) | (F.col("id") == wanted.upper())).select(F.col("name").alias("site"))
    children = places.join(hit.select(F.col("site").alias("parent")), "parent", "left_semi").select(F.col("name").alias("site"))
    names = hit.unionAll(children).unionAll(df.sparkSession.createDataFrame([(wanted,)], "site string")).distinct()
    return df.join(names, df[site_col] == names["site"], "left_semi")


def cites(references: Column, bib_id: str, pages: str | None = None) -> Column:
    """One reference has both the id and the page, which no digit adjoins."""
    return F.exists(references, lambda r: (r["id"] == bib_id) & (F.coalesce(r["pages"].rlike(page_number(pages)), F.lit(False)) if pages else F.lit(True)))


def year_range(year: Column, digits: str) -> Column:
    """A year given by its first digits: 19 is from 1900 up to 2000."""
    step = 10 ** max(0, 4 - len(digits))
    low = int(digits) * step
    return (year >= low) & (year < low + step)


def near(latitude: Column, longitude: Column, at: tuple[float, float], radius_km: float) -> Column:
    """In the box around a point: 111 km are a degree, less by the cosine of the latitude for longitudes."""
    north = radius_km / 111
    east = radius_km / (111 * (abs(math.cos(math.radians(at[0]))) or 1e-9))
    return latitude.between(at[0] - north, at[0] + north) & longitude.between(at[1] - east, at[1] + east)


def starts_with(parts: Column, query: str) -> Column:
    """Parts joined by spaces start with the query, case and accents apart."""
    return plain(F.concat(F.array_join(parts, " "), F.lit(" "))).startswith(plain(F.lit(query)))


def equal(df: DataFrame, field: str, value: str) -> Column:
    """The field is the value or, where it is an array, holds it."""
    return F.array_contains(field, value) if dict(df.dtypes)[field].startswith("array") else F.col(field) == value


def reaches(items: Column, n: int) -> Column:
    """There is an item at place n (from 0); false for null."""
    return F.coalesce(F.size(items) > n, F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def exactly(arrays: Column, values: Sequence[str]) -> Column:
    """One of the arrays is just these values, in this order."""
    return F.coalesce(F.exists(arrays, lambda x: x == strings(values)), F.lit(False))


def covers(have: Column, need: Column) -> Column:
    """Nothing of need is missing from have."""
    return F.size(F.array_except(need, have)) == 0


def splits(spark, phrase: str, most: int = 10_000) -> DataFrame:
    """(text, number): each way to cut a phrase in two at white space, distinct."""
    words = phrase.split()
    if len(words) > most:
        raise ValueError("too many candidates")
    pairs = sorted({(" ".join(words[:i]), " ".join(words[i:])) for i in range(1, len(words))})
    return spark.createDataFrame(pairs, "text string, number string")


def live(deprecated: Column) -> Column:
    """Records that nobody has marked as out of use."""
    return ~F.coalesce(deprecated, F.lit(False))
