"""Imports, glossaries, reports and write-backs on small files."""

import json

import pytest
from pyspark.sql import functions as F

from ostraka.functions import linevec
from ostraka.operators import changes
from ostraka.sources import stores


def test_import_is_checked(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"_id": "X.1", "text": "a"}))
    (tmp_path / "many.json").write_text(json.dumps([{"_id": "X.2", "text": "b"}, {"_id": "X.2", "text": "c"}, {"_id": "bad", "text": "d"}, {"text": "e"}, {"_id": "X.3"}, {"_id": "X.4", "text": "f"}]))
    (tmp_path / "broken.json").write_text("{nothing")
    rows = stores.read_json(spark, [str(tmp_path / f"{n}.json") for n in ("one", "many", "broken")], "_id string, text string")
    found = stores.check_import(rows, spark.createDataFrame([("X.4",)], "_id string"), needed=["text"]).collect()
    assert sorted((r["_id"] or "", r["problem"] or "") for r in found) == sorted(
        [("X.1", ""), ("X.2", "repeated id"), ("X.2", "repeated id"), ("bad", "bad id"), ("", "no id"), ("X.3", "missing text"), ("X.4", "stored already"), ("", "corrupt")]
    )


def test_glossary(spark, tmp_path):
    (tmp_path / "a.glo").write_text("@entry abu [father] N\n@form a-bu $abu\n@form a-bi $abi\n@sense N father, head\n@end entry\n@entry broken\n@end entry\nstray line\n@entry ahu [] N\n@end entry\n@entry lost [never closed] N\n@form x $x\n")
    (tmp_path / "b.txt").write_text("@entry no [no] N\n@end entry")
    rows = stores.read_glossaries(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    assert (rows[0]["lemma"], rows[0]["guideword"], rows[0]["pos"]) == ("abu", "father", "N")
    assert [tuple(f) for f in rows[0]["forms"]] == [("a-bu", "abu"), ("a-bi", "abi")]
    assert [tuple(s) for s in rows[0]["senses"]] == [("N", "father, head")]


@pytest.mark.parametrize("kind", ["csv", "tsv", "json"])
def test_report_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,b"), (2, "c\td")], "n long, t string")
    stores.write_report(df, str(tmp_path / kind), kind)
    reader = spark.read.schema("n long, t string")
    again = reader.json(str(tmp_path / kind)) if kind == "json" else reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(str(tmp_path / kind))
    assert sorted(map(tuple, again.collect())) == [(1, "a,b"), (2, "c\td")]


def test_append_and_file_number(spark, tmp_path):
    df = spark.createDataFrame([("X.1.jpg",), ("X.2.jpeg",), ("X.3.png",), (None,)], "f string").select(stores.number_of_file(F.col("f")).alias("f"))
    stores.append(df, str(tmp_path / "t"))
    stores.append(df.limit(0), str(tmp_path / "t"))
    assert sorted(r[0] or "" for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["", "X.1", "X.2", "X.3.png"]


def test_null_field_is_written_back(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string"), spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted(map(tuple, changes.set_field(old, new, "k", "v").collect()), key=str) == [(1, None), (2, "b"), (None, "c")]


def test_line_vectors(spark):
    line = "array<struct<kind:string,number:int,last:int,marked:boolean>>"
    rows = [
        ([("text", 1, 1, False), ("text", 2, 4, False), ("ruling", 2, 0, False), ("text", 1, 1, False), ("end", 0, 0, False)], ["011113", "015"]),
        ([("text", 1, 1, True), ("ruling", 3, 0, False)], ["14"]),
        ([("other", 0, 0, False), ("text", 1, 1, False)], ["1"]),
        ([("other", 0, 0, False)], []),
        ([], []),
        (None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"i int, lines {line}")
    assert [r[1] for r in sorted(df.select("i", linevec.vectors(F.col("lines"))).collect())] == [r[1] for r in rows]


def test_overlap(spark):
    cases = [("", "", 0, 0), ("11", "", 0, 0), ("0112", "1123", 3, 5), ("112", "0112115", 3, 5), ("25", "14", 0, 0), ("111", "111", 3, 3)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string")
    found = sorted(df.select("i", linevec.overlap(F.col("a"), F.col("b")).alias("o"), linevec.overlap(F.col("b"), F.col("a")).alias("p")).collect())
    assert [(r["o"]["score"], r["o"]["weighted"]) for r in found] == [c[2:] for c in cases]
    assert [(r["p"]["score"], r["p"]["weighted"]) for r in found] == [c[2:] for c in cases]


def test_markdown_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", None), (2, "", "x")], "id int, `a.b` string, c string").coalesce(1)
    stores.write_report(df, str(tmp_path / "md"), "markdown")
    lines = [x for p in sorted((tmp_path / "md").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["| id | a.b | c |", "|-|-|-|", "| 1 | a\\|b c |  |", "| 2 |  | x |"]


def test_signs_read_from_pictures(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"filename": "K.1.jpg", "ocredSigns": "KU"}, {"filename": "K.A.B.2.a.jpeg", "ocredSigns": "BA\\nNU"}, {"filename": null}, {"filename": "noise.png.x.y"}, {"filename": "nonsense"}, {"filename": "K.1.jpg", "ocredSigns": "LAST"}, {"filename": "Z.9", "ocredSigns": "X"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text("no json", encoding="utf-8")
    entries = stores.read_ocred_signs(spark, str(tmp_path))
    fragments = spark.createDataFrame([("K", "1", None, "old", 7), ("K.A.B", "2", "a", None, 8), ("K", "3", "", "kept", 9)], "prefix string, number string, suffix string, ocredSigns string, n int")
    updated, told = stores.update_ocred_signs(fragments, entries)
    assert sorted((r.n, r.ocredSigns, r.suffix) for r in updated.collect()) == [(7, "LAST", None), (8, "BA\nNU", "a"), (9, "kept", "")]
    assert [(r.number, r.error) for r in told.orderBy("place").collect()] == [("K.1", None), ("K.A.B.2.a", None), ("unknown", "Missing filename"), ("noise.png.x.y", "Fragment not found"), ("nonsense", "Invalid museum number: nonsense"), ("K.1", None), ("Z.9", "Fragment not found")]
    assert stores.update_ocred_signs(fragments, entries.limit(0))[0].count() == 3
