"""Dictionary order, nested changes, pages and manuscripts: worked cases."""

import pytest
from pyspark.sql import functions as F

from ostraka.functions import sortkeys, text
from ostraka.operators import changes, filters, manuscripts, matchers, pages

#: Words in the order of a dictionary.
WORDS = ["Abālu II", "abālu I", "akalu I", "akālu I", "akalūtu I", "Bītu I", "bītu I", "part1 part2 I", "part1 part2 II", "part1 part2 III", "part1 part2 IV", "part1 part2 V", "part1 part2 VI", "part1 part2 IX", "ṣābū I", "Šarru II", "šarru I", "zāru I"]


def test_dictionary_order(spark):
    df = spark.createDataFrame([(w,) for w in reversed(WORDS)], "w string")
    assert [r.w for r in df.orderBy(sortkeys.akkadian_key(F.col("w"))).collect()] == WORDS
    odd = spark.createDataFrame([(w,) for w in ("abalu IIV", "abalu", "", " I", None, "ab a", "aba")], "w string")
    keys = {r.w: r.k for r in odd.select("w", sortkeys.akkadian_key(F.col("w")).alias("k")).collect()}
    assert keys["abalu"][-1] == 0 and len(keys["abalu IIV"]) == 19 and keys[""] == [0] and keys[" I"] == [1] and keys[None] is None and keys["ab a"] < keys["aba"]


def test_nested_changes(spark):
    kind = "id int, a string, s struct<x:int,y:array<struct<n:int>>>, m map<string,int>"
    old = spark.createDataFrame([(1, "foo", (1, [(1,), (2,), (3,)]), {"k": 1, "l": 2}), (2, None, None, None), (3, "x", None, None), (None, "n", None, None)], kind)
    new = spark.createDataFrame([(1, "baz", (1, [(1,), (5,)]), {"l": 3, "z": None}), (2, "new", (None, []), {}), (4, "y", None, None), (None, "n", None, None)], kind)
    found = sorted((str(r.id), r.kind, r.path, r.before, r.after) for r in changes.nested_difference(old, new, "id").collect())
    assert [f for f in found if f[0] == "1"] == [("1", "change", "a", "foo", "baz"), ("1", "change", "m.l", "2", "3"), ("1", "change", "s.y.1.n", "2", "5"), ("1", "remove", "m.k", "1", None), ("1", "remove", "s.y.2", '{"n":3}', None)]
    assert [f for f in found if f[0] == "2"] == [("2", "add", "a", None, "new"), ("2", "add", "m", None, "{}"), ("2", "add", "s", None, '{"y":[]}')]
    assert [(f[0], f[1], f[2]) for f in found if f[0] not in "12"] == [("3", "remove", ""), ("4", "add", ""), ("None", "add", ""), ("None", "remove", "")]
    assert changes.nested_difference(old.where("id is not null"), old.where("id is not null"), "id").count() == 0 and changes.nested_difference(old.limit(0), new.limit(0), "id").count() == 0


def test_pages(spark):
    wide = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(20)] + [(3, "again", 0)], "id int, text string, rank int")
    narrow = spark.range(20).selectExpr("cast(id as int) as id", "cast(id % 4 as int) as score")
    found = pages.hydrate(narrow, wide, "id", [F.desc("score")], 3, 4).orderBy("rank", "text").collect()
    assert [(r.rank, r.id, r.score, r.text) for r in found] == [(5, 19, 3, "text 19"), (6, 2, 2, "text 2"), (7, 6, 2, "text 6")]
    assert [r.text for r in pages.hydrate(narrow, wide, "id", [F.desc("score")], 1).orderBy("text").collect()] == ["again", "text 3"]
    assert pages.hydrate(narrow, wide, "id", [F.desc("score")], 5, 100).count() == 0 and pages.hydrate(narrow.limit(0), wide, "id", [F.col("score")], 5).count() == 0 and pages.total(narrow).first()[0] == 20
    with pytest.raises(ValueError):
        pages.hydrate(narrow, wide, "id", [], 0)


def test_pages_read_the_wide_columns_behind_the_join(spark, tmp_path):
    spark.range(50).selectExpr("id", "repeat('x', 100) as text", "id % 7 as n").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = pages.hydrate(docs.select("id", "n"), docs.select("id", "text"), "id", [F.desc("n")], 5)._jdf.queryExecution().executedPlan().toString()
    ranked = plan[plan.index("TakeOrdered") :]
    assert "BroadcastHashJoin" in plan and "text" not in ranked


def test_manuscript_windows(spark):
    kind = "id int, manuscripts array<struct<id:int>>, signs array<array<string>>, lines array<struct<variants:array<struct<manuscripts:array<struct<manuscriptId:int>>>>>>"
    line = lambda *variants: ([([(m,) for m in v],) for v in variants],)
    chapters = [
        (1, [(7,), (8,)], [["KU NU", "BA", "KU"], ["BA"]], [line([7], [8]), line([8]), line([8, 7])]),
        (2, [(7,)], [["BA", "KU NU"]], [line([7])]),
        (3, [(7,), (9,)], [None, ["KU", "x BA"]], [line([9]), (None,)]),
        (4, None, None, None),
        (5, [(7,)], [["KU", "BA"]], None),
    ]
    df = spark.createDataFrame(chapters, kind)
    found = {r.id: (r.manuscripts, [tuple(p) for p in r.positions]) for r in manuscripts.sign_matches(df, ["KU", "BA"]).collect()}
    assert found == {1: ([7], [(0, 0), (2, 0)]), 3: ([9], [(0, 0)]), 5: ([7], [])}
    assert manuscripts.sign_matches(df, ["KU"] * 9).count() == 0 and manuscripts.sign_matches(df.limit(0), ["KU"]).count() == 0
    with pytest.raises(ValueError):
        manuscripts.sign_matches(df, [])


def test_lines_with_a_lemma(spark):
    kind = "id int, genre string, lines array<struct<variants:array<struct<reconstruction:array<struct<uniqueLemma:array<string>>>,manuscripts:array<struct<id:int,line:array<struct<uniqueLemma:array<string>>>>>>>>>"
    w = lambda *lemmas: [([x],) for x in lemmas]
    chapters = [(i, g, [([(w("a"), [(1, w("a", "b")), (2, w("c")), (3, None)])],), ([(w("b"), None)],), ([(None, [(1, w("a"))])],), (None,)]) for i, g in ((1, "L"), (2, "L"), (3, "D"), (4, None))] + [(5, "L", None)]
    df = spark.createDataFrame(chapters, kind)
    found = manuscripts.lines_with_lemma(df, "a", each=3).orderBy("id", "line_index").collect()
    assert [(r.id, r.line_index, [m.id for m in r.line.variants[0].manuscripts]) for r in found] == [(1, 0, [1]), (1, 2, [1]), (2, 0, [1]), (3, 0, [1]), (3, 2, [1]), (4, 0, [1]), (4, 2, [1])]
    assert [(r.id, r.line_index) for r in manuscripts.lines_with_lemma(df, "b", genre="L", total=2).orderBy("id", "line_index").collect()] == [(1, 0), (1, 1)] and manuscripts.lines_with_lemma(df, "z").count() == 0


def test_one_search_for_all(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["b"]], ["ku nu", "ba"]), (2, [["b"]], ["ku"]), (3, [["c"]], ["nu"])], "doc_id int, lines array<array<string>>, sign_lines array<string>")
    got = lambda **o: {r.doc_id: r.matching_lines for r in matchers.find(df, **o).collect()}
    assert got() == {1: [], 2: [], 3: []} and got(words=["b"], mode="or") == {1: [0, 1], 2: [0]} and got(query="nu") == {1: [0], 3: [0]}
    assert got(words=["b"], mode="or", query="ba") == {1: [0, 1]} and got(words=["a", "b"], query="ba") == {1: [0, 1]} and got(words=["a", "b"], mode="line", query="ba") == {1: [0, 1]}
    for wrong in ({"mode": "xor", "words": ["a"]}, {"mode": "phrase"}):
        with pytest.raises(ValueError):
            matchers.find(df, **wrong)


def test_small_filters(spark):
    df = spark.createDataFrame([(True, ["a", "b", "c"]), (False, []), (None, None)], "d boolean, l array<string>")
    assert [r[0] for r in df.select(filters.live(F.col("d"))).collect()] == [False, True, True]
    assert [tuple(r) for r in df.select(text.has_lines(F.col("l")), text.ngrams(F.col("l"), 2)).collect()] == [(True, [["a", "b"], ["b", "c"]]), (False, []), (False, [])]
    rows = spark.createDataFrame([(1, 5), (2, None), (None, 7)], "k int, v int")
    assert sorted(map(tuple, changes.delete(rows, rows.where("k = 1"), ["k"]).collect()), key=str) == sorted([(2, None), (None, 7)], key=str)
    assert sorted(map(tuple, changes.update_many(rows, F.col("v") > 5, {"v": F.lit(0)}).collect()), key=str) == sorted([(1, 5), (2, None), (None, 0)], key=str)
