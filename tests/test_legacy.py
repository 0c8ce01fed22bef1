"""The older style of transliterations: worked lines, folders of files."""

from ostraka.functions import legacy
from ostraka.operators import transliterations as tr
from pyspark.sql import functions as F

#: Lines of the older style and of the present one.
LINES = [
    ("", ""), ("@face a", "@face a"), ("@obverse", "@obverse"), ("$ obverse broken", "$ obverse broken"), ("$ rest broken", "$ rest of side broken"), ("$ ((rest of column broken))", "$ rest of column broken"),
    ("$ (((rest of column broken)))", "$ rest of column broken"), ("$ (ca. 4 lines blank)", "$ (ca. 4 lines blank)"), ("$ (((ca. 4 lines blank)))", "$ (ca. 4 lines blank)"), ("$ ruling", "$ single ruling"), ("$ ruling?", "$ single ruling?"),
    ("$ seal impression", "$ (seal impression)"), ("$ seal impression broken", "$ (seal impression broken)"), ("# note: some note", "#note: some note"), ("# some note", "#note: some note"), ("# note: @akk{a-bu-um}", "#note: @akk{a-bu-um}"),
    ("1. kur    \t  \t kur", "1. kur kur"), ("1. kur\tkur\r", "1. kur kur"), ("1. x[x]x ⸢x⸣[x]⸢x⸣ ⌈x⌉[x]⌈x⌉", "1. x [x] x x# [x] x# x# [x] x#"), ("1. [kur]? [kur]! [kur]?! [kur]!?", "1. [kur?] [kur!] [kur?!] [kur!?]"),
    ("1. [kur]₃ [x x a]₃ a[₃ x x]", "1. [ku]r₃ [x x] a₃# a₃# [x x]"), ("1. ⸢kur⸣? ⌈kur⌉! ⸢kur⸣?! ⌈kur⌉!?", "1. kur?# kur!# kur?!# kur!?#"), ("1. ⸢GE₆⸣[...]⸢GE₆ 24⸣", "1. GE₆# [...] GE₆# 24#"),
    ("1. ($$) kur ($anything12 345!@$)", "1. ($___$) kur ($___$)"), ("1. ($traces$) a ($some traces$) ba ($ some more traces $)", "1. ... a ... ba ..."), ("1. a–a a--a", "1. a-a a-a"), ("1. sza ca s,a t,a ḫa ja ŋa g̃a 'a", "1. ša ša ṣa ṭa ha ga ga ga ʾa"),
    ("1. SZA CA S,A T,A ḪA JA ŊA G̃A", "1. ŠA ŠA ṢA ṬA HA GA GA GA"), ("1. {f}DUB.SAR", "1. {munus}DUB.SAR"), ("1. 1/2 1/3 1/4 1/5 1/6 2/3 5/6", "1. ½ ⅓ ¼ ⅕ ⅙ ⅔ ⅚"), ("1. _a-a_", "1. A.A"), ("1. {GISZ}GIGIR", "1. {giš}GIGIR"), ("1. {I}EN-šu-nu", "1. {m}EN-šu-nu"),
    ("1′. A", "1'. A"), ("1’. A", "1'. A"), ("1ʾ. A", "1'. A"), ("1′′. A", "A+1'. A"), ("1’’’. A", "B+1'. A"), ("1ʾʾʾʾ. A", "C+1'. A"), ("1. 4(BÁN)? 4(BÁN)! 4(BÁN)?!", "1. 4?(BAN₂) 4!(BAN₂) 4?!(BAN₂)"), ("1. ⸢4?(BÁN)⸣", "1. 4?#(BAN₂#)"),
    ("1. [KÁ]⸢.SIKIL.⸣LA ⸢KÁ⸣[.SIKIL.]LA", "1. [KA₂].SIKIL#.LA KA₂#.[SIKIL].LA"), ("1. LU2~v", "1. LU₂@v"), ("1. u2~v", "1. u₂@v"), ("1. 2~v", "1. 2@v"), ("1. $BAD.$É $ME", "1. BAD.E₂ ME"), ("1. ⸢16?! 15! 12⸣ 17", "1. 16?!# 15!# 12# 17"),
    ("1. {d}INANA--<É>.AN.NA", "1. {d}INANA-<E₂>.AN.NA"), ("1. ŠÚ ù ŠÚ<(šumma)> |ŠÚ+ŠÚ|", "1. ŠU₂ u₃ ŠU₂<(šumma)> |ŠU₂+ŠU₂|"), ("1. ŠU2 u3 ŠU2<(šumma)> |ŠU2+ŠU2|", "1. ŠU₂ u₃ ŠU₂<(šumma)> |ŠU₂+ŠU₂|"), ("1. [*] * *-*", "1. [DIŠ] DIŠ DIŠ-DIŠ"), ("1. <:>", "1. < : >"),
    ("1. [*] ⸢AN⸣.GE₆ GAR-ma U₄ ŠÚ{+up} * AN.GE₆ GAR-ma {d}IŠKUR KA-šú ŠUB{+di} * AN.GE₆", "1. [DIŠ] AN#.GE₆ GAR-ma U₄ ŠU₂{+up} DIŠ AN.GE₆ GAR-ma {d}IŠKUR KA-šu₂ ŠUB{+di} DIŠ AN.GE₆"),
    ("8. KAR <:> e-ṭe-ri :* KAR : e-ke-mu : LUGAL ina di-bi-ri : LUGAL ina ud-da-a-ta", "8. KAR < : > e-ṭe-ri :* KAR : e-ke-mu : LUGAL ina di-bi-ri : LUGAL ina ud-da-a-ta"),
    ("14. [...] x (x) še-e-hu $BAD $É $ME : ina GAŠAN-ia₅ {d}SUEN {d}INANA--<É>.AN.NA", "14. [...] x (x) še-e-hu BAD E₂ ME : ina GAŠAN-ia₅ {d}SUEN {d}INANA-<E₂>.AN.NA"),
    ("5'. [...] x [...] x-šu₂? : kal : nap-ha-ri : $WA-wa-ru : ia-ar₂-ru", "5'. [...] x [...] x-šu₂? : kal : nap-ha-ri : WA-wa-ru : ia-ar₂-ru"),
    ("57. {MULₓ(ÁB)}GU.LA KI* ŠÈG ⸢KI*⸣ {kur}NIM.MA{ki} iš-kar* ÀM.GAL É.GAL : ANŠE.KUR.RA-MEŠ", "57. {mulₓ(AB₂)}GU.LA KI* ŠEG₃ KI*# {kur}NIM.MA{ki} iš-kar* AM₃.GAL E₂.GAL : ANŠE.KUR.RA-MEŠ"),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LINES)], "i int, old string")
    found = {r.i: r.line for r in tr.rewritten(df, "old", "line").collect()}
    wrong = [(a, b, found[i]) for i, (a, b) in enumerate(LINES) if found[i] != b]
    assert wrong == []


def test_rewritten_lines_are_read(spark):
    df = spark.createDataFrame([(1, "\n".join(b for _, b in LINES if b))], "doc_id int, text string")
    assert [(r.problem, r.value) for r in tr.problems(tr.lines(df)).collect()] == []


def test_columns_are_counted_and_files_read(spark, tmp_path):
    (tmp_path / "K 1.atf").write_text("@obverse\n@column\n1. LU2\n@column\n@reverse\n@column\n2. 'a\nwhat\n", encoding="utf-8")
    (tmp_path / "b.x.atf").write_text("@column\n1. jojo ku", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("1. ku", encoding="utf-8")
    docs = tr.read_folder(spark, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == ["K 1", "b"]
    found = {(r.doc_id, r.line_index): r.line for r in tr.modern(docs).collect()}
    assert [found["K 1", i] for i in range(8)] == ["@obverse", "@column 1", "1. LU₂", "@column 2", "@reverse", "@column 1", "2. ʾa", "what"] and found["b", 0] == "@column 1"
    typed, told = tr.imported(docs)
    assert {(r.doc_id, r.line_index, r.type) for r in typed.where("type in ('ColumnAtLine', 'TextLine')").collect()} == {("K 1", 1, "ColumnAtLine"), ("K 1", 2, "TextLine"), ("K 1", 3, "ColumnAtLine"), ("K 1", 5, "ColumnAtLine"), ("K 1", 6, "TextLine"), ("b", 0, "ColumnAtLine"), ("b", 1, "TextLine")}
    assert {(r.doc_id, r.line_index, r.problem, r.value) for r in told.collect()} == {("K 1", 7, "Invalid line", "what"), ("b", 1, "Invalid token", "gogo")}


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (None, "@column\n@column"), (2, ""), (3, "1. _a _b-c_ {A(B)c} ⸢ku")], "doc_id int, text string")
    found = {(r.doc_id, r.line_index): r.line for r in tr.modern(df).collect()}
    assert found == {(None, 0): "@column 1", (None, 1): "@column 2", (2, 0): "", (3, 0): "1. A b-š_ {a(B)š} ku#"}
    assert tr.modern(df.limit(0)).count() == 0


def test_columns_are_counted_without_rewriting_a_second_time(spark):
    df = spark.createDataFrame([(1, "@tablet\n@column\n1. _ku2_ [ba?]\n @column\n@reverse\n@column"), (2, "1. ku")], "doc_id int, text string")
    found = tr.modern(df)
    assert [r.line for r in found.where("doc_id = 1").orderBy("line_index").collect()] == ["@tablet", "@column 1", "1. KU₂ [ba?]", "@column 2", "@reverse", "@column 1"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("traces") > 0 and plan.count("RepartitionByExpression") + plan.count("Repartition 4") == 1


def test_pieces_that_stay(spark):
    texts = ["ku2 ba á-ti3 Lú", "%sux2 šá₂ x4 12 1a2", "a2b3 ì% %", "", "ʾ2ā"]
    found = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(legacy.indexed(F.col("t"))).collect()]
    assert found == ["ku₂ ba a₂-ti₃ Lu₂", "%sux2 ša₂₂ x₄ 12 1a₂", "a₂b₃ i₃% %", "", "ʾ₂ā"]
