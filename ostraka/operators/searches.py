"""Searches with a user's input over tables of records: things by name, dossiers, bibliography, signs, annotations, names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ostraka.functions import patterns, sortkeys
from ostraka.operators import detector, filters

# Characters of a query that count, words of a suggestion, rows of a result; how far signs are neighbours.
LONGEST_QUERY, SNIPPET_WORDS, FEW, REACH = 256, 7, 10, 5
#: What follows a match on a name is a match on a term, and last no match at all.
TERMS, NO_MATCH = 3, 6


def _holds(text: Column, query: str) -> Column:
    """Whether a text holds the query, case apart."""
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


# Things by name


def match_rank(text: Column, pattern: str) -> Column:
    """0 for a text that is the pattern, 1 for one that begins with it, 2 for one that holds it; else null."""
    bare = pattern.removeprefix("(?i)")
    return F.when(text.rlike(f"(?i)^(?:{bare})$"), 0).when(text.rlike(f"(?i)^(?:{bare})"), 1).when(text.rlike(f"(?i){bare}"), 2)


def relevance(query: str, name: Column, terms: Column) -> Column:
    """0 to 2 as match_rank() of the name, else 3 to 5 of the best term, else 6. Letters of a class stand for one another; quotation marks don't count."""
    pattern = patterns.collated(query.replace('"', ""))
    best = F.array_min(F.filter(F.transform(terms, lambda t: match_rank(t, pattern)), lambda r: r.isNotNull()))
    return F.coalesce(match_rank(name, pattern), TERMS + best, F.lit(NO_MATCH))


def richness(lists: Sequence[Column], single: Sequence[Column] = ()) -> Column:
    """Items in all of lists, and one for each of single that has any."""
    items = [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)) for x in lists]
    return reduce(add, items + [F.when(F.coalesce(F.size(x), F.lit(0)) > 0, 1).otherwise(0) for x in single], F.lit(0))


def by_relevance(df: DataFrame, query: str, name: str, terms: str, lists: Sequence[str] = (), single: Sequence[str] = ()) -> DataFrame:
    """Rows whose name or a term matches, with rank and richness, best first: by rank, richer ones first, then by name, case apart. An empty query finds nothing."""
    if not query.strip('" '):
        return df.limit(0).withColumns({"rank": F.lit(0), "richness": F.lit(0)})
    empty = F.coalesce(F.col(terms), F.array().cast("array<string>"))
    ranked = df.withColumns({"rank": relevance(query, F.col(name), empty), "richness": richness([F.col(c) for c in lists], [F.col(c) for c in single])})
    return ranked.where(F.col("rank") < NO_MATCH).orderBy("rank", F.desc("richness"), F.lower(name), name)


# Dossiers


def dossiers(df: DataFrame, query: str, id_col: str = "id", description: str = "description", limit: int = FEW, **equal: str | None) -> DataFrame:
    """The first `limit` rows by id whose id or description holds the query, case apart (its first LONGEST_QUERY characters, taken as they are), and whose other columns have the given values; None is any. An empty query finds nothing."""
    if not query:
        return df.limit(0)
    text = query[:LONGEST_QUERY]
    given = [filters.equal(df, name, value) for name, value in equal.items() if value]
    return df.where(reduce(and_, given, _holds(F.col(id_col), text) | _holds(F.col(description), text))).orderBy(id_col).limit(limit)


def suggestions(df: DataFrame, query: str, id_col: str = "id", description: str = "description", limit: int = FEW) -> DataFrame:
    """id and the description's first words of the rows that dossiers() finds; an empty query finds all."""
    found = dossiers(df, query, id_col, description, limit) if query else df.orderBy(id_col).limit(limit)
    words = F.filter(F.split(F.coalesce(F.col(description), F.lit("")), r"\s+"), lambda w: w != "")
    return found.select(F.col(id_col).alias("id"), F.array_join(F.slice(words, 1, SNIPPET_WORDS), " ").alias("snippet"))


def of_fragments(df: DataFrame, fragments: DataFrame, members: str, id_col: str = "id", **equal: str | None) -> DataFrame:
    """Rows that a fragment with the given values names in its array `members`; without any value all rows."""
    given = [filters.equal(fragments, name, value) for name, value in equal.items() if value]
    if not given:
        return df
    named = fragments.where(reduce(and_, given)).select(F.explode(members).alias(id_col))
    return df.join(named, id_col, "left_semi")


# Bibliography


def parsed(query: str) -> dict[str, tuple]:
    """What a free query may mean: author, year and title; a short title with a number. A reading that does not fit is left out."""
    found: dict[str, tuple] = {}
    if m := re.fullmatch(r"(\D+?)(?: (\d{1,4})(?: (.*))?)?", query, re.DOTALL):
        found["author"] = (m[1], int(m[2]) if m[2] else None, m[3])
    if m := re.fullmatch(r"(\S+)(?: (\d*))?", query):
        found["container"] = found["series"] = (m[1], m[2])
    return found


def bibliography(df: DataFrame, query: str) -> DataFrame:
    """Records that a free query finds, each once, with all columns: by first author, year and the title's beginning; by short title of the container and number of the collection; by short title and volume.

    df: author (array<struct<family>>), year, title, container_title_short, collection_number, title_short, volume, and maybe deprecated: such records are left out. Texts are the same without case and accents; a
    year of under four digits stands for all it begins.
    """
    same = lambda column, text: sortkeys.plain(F.col(column)) == sortkeys.plain(F.lit(text))
    meant, tests = parsed(query), []
    if "author" in meant:
        author, year, title = meant["author"]
        test = sortkeys.plain(F.get("author", F.lit(0))["family"]) == sortkeys.plain(F.lit(author))
        if year is not None:
            test = test & F.array_contains(detector.years(F.lit(year)), F.col("year"))
        if title:
            test = test & (sortkeys.plain(F.left("title", F.lit(len(title)))) == sortkeys.plain(F.lit(title)))
        tests.append(test)
    for kind, short, number in (("container", "container_title_short", "collection_number"), ("series", "title_short", "volume")):
        if kind in meant:
            name, n = meant[kind]
            tests.append(same(short, name) & same(number, n) if n else same(short, name))
    if not tests:
        return df.limit(0)
    any_of = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    return df.where(any_of & filters.live(F.col("deprecated")) if "deprecated" in df.columns else any_of)


# Signs: name, values (array<struct<value, subIndex>>), lists (array<struct<name, number>>), logograms (array<struct<wordId: array>>), sortKeys (map<string, array<int>>), unicode


def signs_by_name(signs: DataFrame, query: str) -> DataFrame:
    return signs.where(_holds(F.col("name"), query))


def has_reading(reading: str, index: int | None) -> Column:
    return F.coalesce(F.exists("values", lambda v: (v["value"] == reading) & v["subIndex"].eqNullSafe(F.lit(index).cast("int"))), F.lit(False))


def signs_by_reading(signs: DataFrame, reading: str, index: int | None) -> DataFrame:
    """Signs with a reading of that index; None is ₓ."""
    return signs.where(has_reading(reading, index))


def signs_by_list(signs: DataFrame, name: str, number: str) -> DataFrame:
    return signs.where(F.exists("lists", lambda r: (r["name"] == name) & (r["number"] == number)))


def signs_by_word(signs: DataFrame, word: str) -> DataFrame:
    """Signs that a word is written with."""
    return signs.where(F.exists("logograms", lambda r: F.array_contains(r["wordId"], word)))


def homophones(signs: DataFrame, reading: str) -> DataFrame:
    """Signs with that reading, by its least index there (index: null for ₓ, which comes last), then by name."""
    mine = F.filter("values", lambda v: v["value"] == reading)
    found = signs.where(F.exists("values", lambda v: v["value"] == reading))
    return found.withColumn("index", F.array_min(F.transform(mine, lambda v: v["subIndex"].cast("int")))).orderBy(F.asc_nulls_last("index"), "name")


def composites(signs: DataFrame, reading: str, index: int | None) -> DataFrame:
    """Signs in whose name a sign with that reading stands, alone or between operators and brackets.

    Each name is cut into its runs of parts, and these are looked up; names are short, so a name has a few runs.
    """
    cut = F.regexp_extract_all("name", F.lit(r"([.+×&%@x|()]|[^.+×&%@x|()]+)"), F.lit(1))
    mark = lambda p: p.rlike(r"^[.+×&%@x|()]$")
    pieces = signs.select("name", cut.alias("p")).where(F.size("p") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | mark(F.element_at("p", i - 1)))
    ends = lambda i: F.filter(F.sequence(i, F.size("p")), lambda j: (j == F.size("p")) | mark(F.element_at("p", F.least(j + 1, F.size("p")))))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: F.array_join(F.slice("p", i, j - i + 1), ""))))
    within = pieces.select("name", F.explode(F.array_distinct(runs)).alias("run"))
    asked = signs_by_reading(signs, reading, index).select(F.regexp_replace("name", r"^\|+|\|+$", "").alias("run")).distinct()
    return signs.join(within.join(asked, "run").select("name").distinct(), "name", "left_semi")


def neighbours(signs: DataFrame, name: str, era: str, reach: int = REACH) -> DataFrame:
    """key, place, name, unicode, number: for each key that a sign has in an era's order, the signs whose keys there lie within reach, in order; number is the sign's in the list MZL."""
    keys = lambda df: df.select("name", "unicode", "lists", F.explode(F.try_element_at("sortKeys", F.lit(era))).alias("sort_key"))
    own = keys(signs.where(F.col("name") == name)).select(F.col("sort_key").alias("key"), F.explode(F.sequence(F.col("sort_key") - reach, F.col("sort_key") + reach)).alias("sort_key"))
    number = F.get(F.filter("lists", lambda r: r["name"] == "MZL"), F.lit(0))["number"]
    found = own.join(keys(signs), "sort_key")
    place = F.row_number().over(Window.partitionBy("key").orderBy("sort_key", "name")) - 1
    return found.select("key", place.alias("place"), "name", "unicode", number.alias("number"))


# Annotations and names


def annotations_of_sign(annotations: DataFrame, fragments: DataFrame, sign: str, centroids_only: bool = False, unclustered: bool = False, cluster: str | None = None, period: str | None = None) -> DataFrame:
    """fragment, annotations, script, site: for each fragment that has the sign (or one whose name holds it, case apart) its annotations of exactly that sign, of which none may be left.

    annotations: fragment, annotations array<struct<signName, clusterId, isCentroid>> (isCentroid null: not clustered); fragments: fragment, script, period, site; without a row there an annotation has no place.
    centroids_only: those in the middle of a cluster, with unclustered those of no cluster too.
    """
    test = lambda a: a["signName"] == sign
    if centroids_only:
        middle = lambda a: F.coalesce(a["isCentroid"], F.lit(unclustered))
    coarse = F.exists("annotations", lambda a: _holds(a["signName"], sign))

    def kept(a: Column) -> Column:
        found = test(a)
        if centroids_only:
            found = found & middle(a)
        return found & (a["clusterId"] == cluster) if cluster else found

    places = fragments.where(F.col("period") == period) if period else fragments
    chosen = annotations.where(coarse).select("fragment", F.filter("annotations", lambda a: F.coalesce(kept(a), F.lit(False))).alias("annotations"))
    return chosen.join(places.select("fragment", "script", "site"), "fragment")


def names(df: DataFrame, query: str, columns: Sequence[Column], least: int = 3) -> DataFrame:
    """The distinct non-empty names in any of the columns that match the query (letters of a class for one another, case apart), in order; a query of under `least` characters finds nothing."""
    each = df.select(F.explode(F.array(*columns)).alias("name")).where("name <> ''")
    if len(query) < least:
        return each.limit(0)
    return each.where(F.col("name").rlike(patterns.collated(query))).distinct().orderBy("name")


def selected_lines(chapters: DataFrame, wanted: dict[int, Sequence[int]], id_col: str = "id", lines: str = "lines") -> DataFrame:
    """id and the chapters' lines at the wanted places, each with its wanted variants only (`index`: its place); lines and variants that are not there are left out, and with nothing wanted all stay."""
    indexed = F.transform(lines, lambda line, i: F.struct(i.alias("index"), line.alias("line")))
    if not wanted:
        return chapters.select(F.col(id_col).alias("id"), indexed.alias("lines"))
    chosen = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(int(k)), F.array(*[F.lit(int(i)) for i in v]).cast("array<int>"))])
    kept = F.filter(indexed, lambda x: F.array_contains(F.map_keys(chosen), x["index"]))
    some = F.transform(kept, lambda x: F.struct(x["index"].alias("index"), x["line"].withField("variants", F.filter(x["line"]["variants"], lambda _, k: F.array_contains(F.try_element_at(chosen, x["index"]), k))).alias("line")))
    return chapters.select(F.col(id_col).alias("id"), some.alias("lines"))
