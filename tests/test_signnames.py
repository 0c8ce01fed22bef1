"""Names and code points of signs: worked lines."""

from ostraka.operators import signnames, transliterations as tr
from pyspark.sql import functions as F

#: A sign list (name, readings, list numbers, code points).
SIGNS = [
    ("P₂", [(":", 1)], [("ABZ", "377n1")], [74865]), ("KU", [("ku", 1)], [("KWU", "869")], [74154]), ("NU", [("nu", 1)], [("ABZ", "075")], [74337]), ("IGI", [("ši", 1), ("igi", 1)], [("HZL", "288"), ("ABZ", "207a/207b X")], [74054]),
    ("DIŠ", [("ana", 1), ("1", 1), ("diš", 1)], [], [73849]), ("UD", [("ud", 1), ("u", 4), ("tu", 2)], [], [74515]), ("MI", [("mi", 1), ("gi", 6)], [], [74282]), ("KI", [("ki", 1)], [], [74144]), ("DU", [("du", 1)], [], [73850]),
    ("U", [("u", 1), ("10", 1)], [("ABZ", "411")], [74507]), ("|U.U|", [("20", 1)], [("ABZ", "471")], [74649]), ("BA", [("ba", 1), ("ku", 1)], [], [73792]), ("MA", [("ma", 1)], [], [74272]), ("TI", [("ti", 1)], [], [74494]), ("MU", [("mu", 1)], [], [74284]),
    ("TA", [("ta", 1)], [], [74475]), ("ŠU", [("šu", 1)], [], [74455]), ("BU", [("bu", 1), ("gid", 2)], [], [73805]), ("|(4×ZA)×KUR|", [("geštae", 1)], [("ABZ", "531+588")], [74591]), ("|(AŠ&AŠ@180)×U|", [], [], [74499]),
    ("|A.EDIN.LAL|", [("ummu", 3)], [], [73728, 73876, 74226]), ("|HU.HI|", [("mat", 3)], [("ABZ", "081")], [74039, 74029]), ("AŠ", [("ana", 3)], [("ABZ", "001")], [73784]), ("EDIN", [("bil", None), ("bir", 4)], [("ABZ", "168")], [73876]),
    ("|ŠU₂.3×AN|", [("kunga", 1)], [], [74457]), ("BUR₂", [("bul", 1)], [("ABZ", "11")], [74215]), ("HU", [("u", 18)], [("ABZ", "78")], [74039]), ("|URU×URUDA|", [("bansur", 1)], [("ABZ", "41")], [74574]),
]
#: Lines and the names of their signs.
LINES = [
    ("|BI×(IS.IS)|", ["|BI×(IS.IS)|"]),
    ("ku gid₂ nu ši", ["KU", "BU", "ABZ075", "ABZ207a\\u002F207b\\u0020X"]),
    ("|(4×ZA)×KUR| |(AŠ&AŠ@180)×U| NU |GA₂#*+BAD!?| |GA₂#*.BAD!?|", ["ABZ531+588", "|(AŠ&AŠ@180)×U|", "ABZ075", "|GA₂+BAD|", "GA₂", "BAD"]),
    ("ummu₃ |IGI.KU| mat₃ kunga", ["A", "ABZ168", "LAL", "ABZ207a\\u002F207b\\u0020X", "KU", "ABZ78", "HI", "ŠU₂", "3×AN"]),
    ("unknwn x X", ["?", "X", "X"]),
    ("1(AŠ) 1 2 10 20 30 256", ["ABZ001", "DIŠ", "2", "ABZ411", "ABZ411", "ABZ411", "30", "256"]),
    ("| :", ["ABZ377n1"]),
    (":/ku šu/|BI×IS|-ummu₃/|IGI.KU|/mat₃", ["ABZ377n1/KU", "ŠU/|BI×IS|", "|A.EDIN.LAL|/|IGI.KU|/ABZ081"]),
    ("ku-[nu ši]", ["KU", "ABZ075", "ABZ207a\\u002F207b\\u0020X"]),
    ("< : ši>-ku", ["KU"]),
    ("ku-<<nu ši 1 |KU+KU| nu/ši nu(KU) x X ... : >>", ["KU"]),
    ("ku-<nu ši 1 |KU+KU| nu/ši nu(KU) x X ... : >", ["KU"]),
    ("ku-<(nu ši 1 |KU+KU| nu/ši nu(KU) x X ... : )>", ["KU"]),
    ("°nu : ši\\ku°", ["KU"]),
    ("ku-°|NU+NU|-1-nu-x-X-...-nu/ši\\ku°-ku", ["KU", "KU", "KU"]),
    ("<{ši>-ku} {ku-<ši}>", ["KU", "KU"]),
    ("<{+ši>-ku} {+ku-<ši}>", ["KU", "KU"]),
    ("<{{ši>-ku}} {{ku-<ši}}>", ["KU", "KU"]),
    ("{(ku)}", ["KU"]),
    ("%grc xX...ΑαΒβ", None),
    ("|BUL.U₁₈|", ["ABZ11", "ABZ78"]),
    ("|AMAR₂.AMAR₂|", ["AMAR₂", "AMAR₂"]),
    ("bilₓ", ["ABZ168"]),
]


def signs(spark):
    kind = "n int, name string, values array<struct<value:string,subIndex:int>>, lists array<struct<name:string,number:string>>, unicode array<int>"
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SIGNS)], kind)


def test_names(spark):
    docs = spark.createDataFrame([(i, f"1. {line}") for i, (line, _) in enumerate(LINES)], "doc_id int, text string")
    found = {r.doc_id: r.names for r in signnames.sign_names(tr.tokens(tr.lines(docs)), signs(spark), F.col("n")).collect()}
    assert [(line, found.get(i)) for i, (line, _) in enumerate(LINES)] == LINES


def test_code_points(spark):
    docs = spark.createDataFrame([(1, "1. ši š[i nape"), (2, "1. {ku} ši-nu ..."), (None, "1. x"), (4, None)], "doc_id int, text string")
    found = {r.doc_id: [(p.value, p.unicode) for p in r.points] for r in signnames.code_points(tr.tokens(tr.lines(docs)), signs(spark), F.col("n")).collect()}
    assert found == {1: [("ši", [74054]), ("", [9999]), ("š", None), ("", [9999]), ("nape", None)], 2: [("ku", [74154]), ("", [9999]), ("ši", [74054]), ("nu", [74337]), ("", [9999])]}


def test_empty_list_and_text(spark):
    docs = spark.createDataFrame([(1, "1. ku 2 x |KU.NU|")], "doc_id int, text string")
    tokens = tr.tokens(tr.lines(docs))
    assert signnames.sign_names(tokens, signs(spark).limit(0)).collect()[0].names == ["?", "2", "X", "KU", "NU"]
    assert signnames.sign_names(tokens.limit(0), signs(spark)).count() == 0


def test_code_points_read_tokens_once(spark):
    signs_ = spark.createDataFrame([("KU", [("ku", 1)], [], [74])], "name string, values array<struct<value:string,subIndex:int>>, lists array<struct<name:string,number:string>>, unicode array<int>")
    tokens = tr.tokens(tr.lines(spark.createDataFrame([(1, "1. ku ku |"), (2, "1. ku"), (3, "1. | jo")], "doc_id int, text string")))
    found = signnames.code_points(tokens, signs_)
    points = {r.doc_id: [None if p.unicode is None else p.unicode[0] for p in r.points] for r in found.collect()}
    # a space behind each word but the last token; a line without words has none
    assert points == {1: [74, 9999, 74, 9999], 2: [74]}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
