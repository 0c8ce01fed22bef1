"""Searches with a user's input: worked cases."""

import pytest
from pyspark.sql import functions as F

from ostraka.operators import searches

THINGS = "id string, relatedTerms array<string>, type array<string>, references array<string>, reallexikon array<string>"


def things(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], THINGS)


def found(df, query):
    return [r.id for r in searches.by_relevance(df, query, "id", "relatedTerms", ["relatedTerms", "type", "references"], ["reallexikon"]).collect()]


def test_relevance(spark):
    assert found(things(spark, ("Amêl-Marduk",), ("Marduk A. I. Philologisch",), ("Marduk",), ("Enlil", ["Ellil"])), "Marduk") == ["Marduk", "Marduk A. I. Philologisch", "Amêl-Marduk"]
    assert found(things(spark, ("Esagil", ["Marduk"]), ("Dûr-Marduk",)), '"Marduk"') == ["Dûr-Marduk", "Esagil"]
    assert found(things(spark, ("Equ", ["Reitpferd"]), ("Equs", ["Pferdchen"]), ("Equus", ["x", "Pferd"])), "Pferd") == ["Equus", "Equs", "Equ"]
    assert found(things(spark, ("Marduk-zakir",), ("Marduk-apla",)), "marduk") == ["Marduk-apla", "Marduk-zakir"]
    assert found(things(spark, ("Marduk-A",), ("Marduk-B", None, ["d"], ["x", "y"], ["1", "2"])), "Marduk") == ["Marduk-B", "Marduk-A"]
    assert found(things(spark, ("Amêl-Marduk", None, ["d"], ["x", "y", "z"]), ("Marduk",), ("Mardūk",)), "Marduk") == ["Marduk", "Mardūk", "Amêl-Marduk"]
    assert found(things(spark, (None, None), ("", [])), "Marduk") == [] and found(things(spark, ("Marduk",)), '""') == []


def test_dossiers(spark):
    df = spark.createDataFrame([("D1", "Letters of (some) KING", "Ur", ["OB"]), ("D2", None, "Ur", None), ("king", "one two three four five six seven eight nine", None, ["NA"])], "id string, description string, provenance string, period array<string>")
    assert [r.id for r in searches.dossiers(df, "King").collect()] == ["D1", "king"] and [r.id for r in searches.dossiers(df, "(some)").collect()] == ["D1"]
    assert [r.id for r in searches.dossiers(df, "king", provenance="Ur", period="OB").collect()] == ["D1"] and searches.dossiers(df, "").count() == 0 and [r.id for r in searches.dossiers(df, "d", limit=1).collect()] == ["D1"]
    assert [tuple(r) for r in searches.suggestions(df, "ONE TWO").collect()] == [("king", "one two three four five six seven")] and searches.suggestions(df, "").count() == 3
    fragments = spark.createDataFrame([(["D2"], "Ur", "LIT"), (["D1", "king"], "Uruk", None), (None, "Ur", "LIT")], "dossiers array<string>, provenance string, genre string")
    assert [r.id for r in searches.of_fragments(df, fragments, "dossiers", provenance="Ur", genre="LIT").collect()] == ["D2"] and searches.of_fragments(df, fragments, "dossiers").count() == 3


def test_bibliography(spark):
    kind = "id int, author array<struct<family:string>>, year int, title string, container_title_short string, collection_number string, title_short string, volume string, deprecated boolean"
    rows = [(1, [("Bäcker",)], 2003, "The Epic", None, None, None, None, None), (2, [("Baecker",)], 2003, "The Epic", None, None, None, None, None), (3, None, 1950, "x", "RN", "7", "RN", None, False), (4, None, None, None, None, None, "rn", "7", None), (5, [("backer",)], 1957, "Other", None, None, None, None, None), (6, [("Backer",)], 2003, "The Epic", None, None, None, None, True)]
    df = spark.createDataFrame(rows, kind)
    ids = lambda q: sorted(r.id for r in searches.bibliography(df, q).collect())
    assert ids("Backer") == [1, 5] and ids("Backer 2003") == [1] and ids("Backer 195") == [5] and ids("Backer 2003 the ep") == [1] and ids("Backer 2003 epic") == []
    assert ids("RN") == [3, 4] and ids("RN 7") == [3, 4] and ids("RN 8") == [] and ids("") == [] and ids("12 34 56") == []
    assert searches.parsed("van der Meer 1999 On x 2") == {"author": ("van der Meer", 1999, "On x 2")}


def test_signs(spark):
    kind = "name string, values array<struct<value:string,subIndex:int>>, lists array<struct<name:string,number:string>>, logograms array<struct<wordId:array<string>>>, sortKeys map<string,array<int>>, unicode array<int>"
    rows = [
        ("KU", [("ku", 1), ("tuš", 1)], [("ABZ", "536")], [(["w I"],)], {"neo": [5, 40]}, [1]),
        ("BA", [("ba", 1), ("ku", 4)], None, None, {"neo": [9]}, [2]),
        ("|KU.BA|", [("x", 1), ("ku", None)], [("MZL", "8")], None, {"neo": [11], "old": [1]}, [3]),
        ("|(KU×BA).ŠU|", None, None, None, None, None),
        ("KUR", [("kur", 1)], None, None, {"neo": [38]}, [4]),
        ("|AŠ.KUR|", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    ids = lambda d: [r.name for r in d.collect()]
    assert sorted(ids(searches.signs_by_name(df, "ku"))) == ["KU", "KUR", "|(KU×BA).ŠU|", "|AŠ.KUR|", "|KU.BA|"]
    assert ids(searches.signs_by_reading(df, "ku", 1)) == ["KU"] and ids(searches.signs_by_reading(df, "ku", None)) == ["|KU.BA|"] and ids(searches.signs_by_list(df, "ABZ", "536")) == ["KU"] and ids(searches.signs_by_word(df, "w I")) == ["KU"]
    assert ids(searches.homophones(df, "ku")) == ["KU", "BA", "|KU.BA|"]
    assert sorted(ids(searches.composites(df, "ku", 1))) == ["KU", "|(KU×BA).ŠU|", "|KU.BA|"] and sorted(ids(searches.composites(df, "kur", 1))) == ["KUR", "|AŠ.KUR|"] and ids(searches.composites(df, "x", 1)) == ["|KU.BA|"]
    near = searches.neighbours(df, "KU", "neo").orderBy("key", "place").collect()
    assert [(r.key, r.place, r.name, r.number) for r in near] == [(5, 0, "KU", None), (5, 1, "BA", None), (40, 0, "KUR", None), (40, 1, "KU", None)] and searches.neighbours(df, "KU", "other").count() == 0


def test_annotations(spark):
    kind = "fragment string, annotations array<struct<signName:string,clusterId:string,isCentroid:boolean>>"
    df = spark.createDataFrame([("K.1", [("KU", "a", True), ("KU", "a", False), ("BA", None, None)]), ("K.2", [("KU", None, None)]), ("K.3", [("|KU.BA|", "a", True)]), ("K.4", [("BA", None, None)]), ("K.5", [("KU", "b", True)])], kind)
    places = spark.createDataFrame([("K.1", "s", "NA", "Ur"), ("K.2", "s", "NB", None), ("K.3", None, "NA", None)], "fragment string, script string, period string, site string")
    got = lambda **o: {r.fragment: len(r.annotations) for r in searches.annotations_of_sign(df, places, "KU", **o).collect()}
    assert got() == {"K.1": 2, "K.2": 1, "K.3": 0} and got(centroids_only=True) == {"K.1": 1, "K.2": 0, "K.3": 0} and got(centroids_only=True, unclustered=True) == {"K.1": 1, "K.2": 1, "K.3": 0}
    assert got(cluster="a") == {"K.1": 2, "K.2": 0, "K.3": 0} and got(period="NB") == {"K.2": 1}


def test_names_and_lines(spark):
    df = spark.createDataFrame([("Ṭābi", "Marduk"), ("tabi", None), ("", "tab")], "a string, b string")
    assert [r.name for r in searches.names(df, "tab", [F.col("a"), F.col("b")]).collect()] == ["tab", "tabi", "Ṭābi"] and searches.names(df, "ta", [F.col("a")]).count() == 0
    chapters = spark.createDataFrame([(1, [("1", [("a",), ("b",)]), ("2", [("c",)]), ("3", [("d",)])])], "id int, lines array<struct<number:string,variants:array<struct<t:string>>>>")
    got = lambda wanted: [(x["index"], [v.t for v in x.line.variants]) for x in searches.selected_lines(chapters, wanted).first().lines]
    assert got({0: [1], 2: [0, 5], 9: [0]}) == [(0, ["b"]), (2, ["d"])] and got({}) == [(0, ["a", "b"]), (1, ["c"]), (2, ["d"])] and got({1: []}) == [(1, [])]


@pytest.mark.parametrize("query,best", [("ḫattusa", 0), ("Hattuša", 0), ("attus", 2), ("x", 6)])
def test_letters_of_a_class(spark, query, best):
    df = spark.createDataFrame([("Ḥattusa",)], "n string")
    assert df.select(searches.relevance(query, F.col("n"), F.array().cast("array<string>"))).first()[0] == best
