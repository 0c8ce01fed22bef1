"""Sort keys, letter classes, clusters, lookups and names, each against its stated rule."""

import re

import pytest
from pyspark.sql import functions as F

from ostraka.functions import names, patterns, sortkeys
from ostraka.operators import duplicates, lookups


def test_museum_numbers_sort_by_every_prefix(spark):
    order = ["K", "Sm", "DT", "Rm", "Rm-II", "1881", "1903", "BM", "IM", "ISACM-A", "HS", "CBS", "UM", "N", "NBC", "YBC", "A", "NI", "k"]
    rows = [(p, n, s) for p in order for n, s in (("9", ""), ("10", "2"), ("10", "10"), ("10", ""), ("99999999999", ""), ("x", ""))]
    df = spark.createDataFrame(rows[::-1], "prefix string, number string, suffix string")
    found = [tuple(r) for r in df.orderBy(sortkeys.museum_key(*map(F.col, df.columns))).collect()]
    assert found == rows


def test_every_letter_stands_for_its_class():
    for group in patterns.LETTER_CLASSES:
        for c in group:
            first = next(g for g in patterns.LETTER_CLASSES if c in g)
            pattern = re.compile(patterns.collated(c))
            assert all(pattern.fullmatch(x) for x in first) and pattern.fullmatch("|") is None
    assert re.fullmatch(patterns.collated("bu?*"), "BUxyz") and not re.fullmatch(patterns.collated("bu?"), "bu")
    assert re.fullmatch(patterns.collated('"a.b"'), "a.b") and not re.fullmatch(patterns.collated('"a.b"'), "axb")


def test_clusters_of_names(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "z")], "a string, b string")
    found = {r["id"]: r["cluster"] for r in duplicates.clusters(edges).collect()}
    assert len(found) == 64 and {found[f"n{i:03d}"] for i in range(61)} == {"n000"} and found["z"] == found["x"] == "x"


def test_lookups(spark):
    dim = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    rows = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert sorted((r["k"] or 0, r["d"]["v"] if r["d"] else "") for r in lookups.attach(rows, dim, "k", "d").collect()) == [(0, ""), (1, "a"), (1, "a"), (3, "")]
    nested = spark.createDataFrame([(None, [(1,), (9,)]), (7, []), (8, None)], "id int, refs array<struct<k:int>>")
    found = {r["id"]: r["refs"] for r in lookups.regroup(nested, ["id"], "refs", dim.where("v <> 'b'"), "k", "k", "doc").collect()}
    assert set(found) == {None, 7, 8} and [x["doc"] and x["doc"]["v"] for x in found[None]] == ["a", None]
    assert lookups.one(dim, F.col("k") == 1).collect()[0]["v"] == "a" and lookups.exists(dim, F.col("k") == 2) and not lookups.exists(dim, F.col("k") == 5)
    with pytest.raises(LookupError):
        lookups.one(dim, F.col("k") == 5)


def test_outcome(spark):
    rows = [(1, "not_duplicate", 0.6, 0.9), (2, "not_duplicate", 0.7, 0.4), (3, "insufficient_data", 0.1, 0.2), (3, "possible_duplicate", 0.05, 0.1), (4, "likely_duplicate", 0.9, 0.8), (4, "not_duplicate", 0.95, 0.1)]
    df = spark.createDataFrame(rows, "id int, decision string, score double, completeness double")
    found = sorted(map(tuple, duplicates.outcome(df, "id", F.lit(0.5)).collect()))
    assert found == [(1, "no_duplicate", 0.0, 0.5), (2, "no_duplicate", 0.7, 0.4), (3, "possible_duplicate", 0.1, 0.2), (4, "likely_duplicate", 0.95, 0.8)]


def test_names(spark):
    df = spark.createDataFrame([("K", "1", "A"), ("K", "1", ""), ("K", "1", None), (None, "1", "A")], "p string, n string, s string")
    assert [r[0] for r in df.select(names.file_name(F.col("p"), F.col("n"), F.col("s"))).collect()] == ["K.1.A.jpg", "K.1.jpg", "K.1.jpg", None]
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(names.doi(F.lit("doi:10.1234/AB.c"))) == "10.1234/ab.c" and one(names.doi(F.lit("none"))) is None
    assert one(names.digits(F.lit("0-306-40615-x"))) == "030640615X" and one(names.digits(F.lit("-"))) is None
    assert one(names.title_words(F.lit("The Tale of the Tale, und Ende"))) == ["tale", "ende"]
    assert one(names.family_and_initials(F.lit("Smith "), F.lit("Jane-Ann B."))) == "smith|jab" and one(names.family_and_initials(F.lit("Li"), F.lit(None))) == "li|"
    assert tuple(one(names.dated(F.lit("[<12>?]")))) == ("12", True, True, True) and tuple(one(names.dated(F.lit("5")))) == ("5", False, False, False)
