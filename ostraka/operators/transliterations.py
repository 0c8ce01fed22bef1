"""Transliterations as tables: lines with what they are, tokens of text lines with language, enclosures and signs, and what is wrong with either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ostraka.functions import atf, legacy
from ostraka.functions.text import once, replaced
from ostraka.operators.tables import written

_BIT = {name: 1 << i for i, (name, _, _) in enumerate(atf.ENCLOSURES)}
_OPEN = tuple(a for _, a, _ in atf.ENCLOSURES if a)
_SIGN_NAME = rf"(?<=[\p{{L}}\p{{N}}{atf.FLAGS}])\((?:{atf.COMPOUND}|{atf.one_of(f'[{atf.READING_LETTERS}{atf.LOGOGRAM_LETTERS}0-9₀-₉ₓ@~{atf.FLAGS}]+')})\)"
#: Tokens whose brackets enclose nothing.
_NO_ENCLOSURES = ("($___$)", "(||)", "(|)")


def _dealt(rows: DataFrame) -> DataFrame:
    """Lines dealt over all tasks: reading one costs far more than moving it, and a file of few row groups would keep few cores busy."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_index, line, type and the fields of each line of a transliteration (see atf.LINE_FIELDS), with the parts of its number.

    A null text has no lines, an empty one an empty line; a line that fits no kind is Invalid; other columns are ignored.
    """
    cut = _dealt(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\r?\n")).alias("line_index", "line")))
    # a filter on the type would else be worked out once more, and before the lines are dealt
    typed = cut.select("*", once(atf.line_type(F.col("line"))).alias("type"))
    fields = {name: atf.line_field(F.col("line"), F.col("type"), name) for name in atf.LINE_FIELDS}
    return typed.withColumns(fields).withColumn("numbers", atf.number_parts(F.col("number")))


def spaced(text: Column) -> Column:
    """A text line's content with one space between tokens: none around joiners, one around glosses on the document and between dividers and their brackets."""
    letter = rf"\p{{L}}0-9₀-₉ₓ{atf.FLAGS}"
    divider = f"(?:{atf.DIVIDER}|ø)"
    for marks, pattern, by in (
        ("-,", r" *([-,]) *", "$1"),
        ("+", r" *(?<!\{)\+ *", "+"),
        (".", r"(?<=\S) +\.(?!\.)", "."),
        (".", r"(?<![.:])\. +(?=\S)", "."),
        (":;", r" +([:;])(?=[\p{L}0-9\[<(|{])", "$1"),
        (":;", rf"(?<=[{letter}\])>}}|])([:;]) +", "$1"),
        # a parenthesis that closes the name of a sign in a gloss is none that closes a gloss on the document
        ("()", rf"(\{{\(|\)\}}(?<![{letter}]\([^(){{}} ]{{1,40}}\)\}}))", " $1 "),
        (":;/ø", rf"(?<![^ ])({atf.OPENING}++)(?={divider}{atf.CLOSING}*+(?![^ ]))", "$1 "),
        (":;/ø", rf"(?<![^ ])({divider})({atf.CLOSING}++)(?![^ ])", "$1 $2"),
    ):
        text = replaced(text, marks, pattern, by)
    return text


def cut_tokens(content: Column) -> Column:
    """array<string>: the tokens of a text line's content; runs of brackets that stand alone are one token each, an erasure is one with its spaces."""
    cut = F.regexp_extract_all(spaced(content), F.lit(r"(?:[^ °]++|°[^°\\]*\\[^°\\]*°|°)++"), F.lit(0))
    brackets = f"^(?:{atf.ENCLOSURE})++$"
    return F.flatten(F.transform(cut, lambda t: F.when(t.rlike(brackets), F.regexp_extract_all(t, F.lit(atf.ENCLOSURE), F.lit(0))).otherwise(F.array(t))))


def _shifts(tokens: Column) -> Column:
    """array<struct<place, token>>: the shifts among the tokens."""
    return F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("place"), t.alias("token"))), lambda x: x["token"].rlike("^%[a-zA-Z0-9]+$"))


def _items(tokens: Column, shifts: Column) -> Column:
    """array<struct<token, shift, brackets>>: each token with the last shift before it and its enclosures in order."""

    def item(t: Column, i: Column) -> Column:
        before = F.filter(shifts, lambda x: x["place"] < i)
        shift = F.get(before, F.size(before) - 1)["token"]
        one_by_one = F.regexp_extract_all(t, F.lit(r"([<>()\[\]])"), F.lit(1))
        usual = F.regexp_extract_all(F.regexp_replace(t, _SIGN_NAME, ""), F.lit(atf.ENCLOSURE), F.lit(0))
        brackets = F.when(t.isin(*_NO_ENCLOSURES), F.array().cast("array<string>")).when(atf.normalized_of(shift), one_by_one).otherwise(usual)
        return F.struct(t.alias("token"), shift.alias("shift"), brackets.alias("brackets"))

    return F.transform(tokens, item)


def _enclosed(items: Column) -> Column:
    """struct (state struct<mask, bad>, masks): which enclosures are open at the end and before each token (as bits, two hex digits a token: a text grows faster than an array), and whether one was opened or closed where it may not."""
    state = F.struct(F.lit(0).alias("mask"), F.lit(False).alias("bad"))

    def bracket(s: Column, b: Column, normalized: Column) -> Column:
        mask = s["mask"]
        broken = mask.bitwiseAND(_BIT["BROKEN_AWAY"]) != 0
        bit = F.when(b.isin("(", ")"), F.when(broken, _BIT["PERHAPS_BROKEN_AWAY"]).otherwise(_BIT["PERHAPS"])).when(b.isin("<", ">") & normalized, _BIT["EMENDATION"])
        for name, a, z in atf.ENCLOSURES:
            if a and name != "PERHAPS_BROKEN_AWAY":
                bit = bit.when(b.isin(a, z), _BIT[name])
        barred = F.lit(0)
        for name, b_ in _BIT.items():
            barred = F.when(bit == b_, sum(_BIT[x] for x in {name, *atf.NOT_WITHIN.get(name, ())})).otherwise(barred)
        opens = b.isin(*_OPEN)
        needed = (bit == _BIT["BROKEN_AWAY"]) & (mask.bitwiseAND(_BIT["PERHAPS_BROKEN_AWAY"]) != 0)
        wrong = F.when(opens, mask.bitwiseAND(barred) != 0).otherwise((mask.bitwiseAND(bit) == 0) | needed)
        return F.struct(F.when(opens, mask.bitwiseOR(bit)).otherwise(mask.bitwiseAND(F.bitwise_not(bit))).alias("mask"), (s["bad"] | wrong).alias("bad"))

    def step(acc: Column, t: Column) -> Column:
        after = F.aggregate(t["brackets"], acc["state"], lambda s, b: bracket(s, b, atf.normalized_of(t["shift"])))
        return F.struct(after.alias("state"), F.concat(acc["masks"], F.lpad(F.hex(acc["state"]["mask"]), 2, "0")).alias("masks"))

    return F.aggregate(items, F.struct(state.alias("state"), F.lit("").alias("masks")), step)


def _cut(typed: DataFrame) -> DataFrame:
    """Text lines with their tokens, what is open before each, and whether their enclosures are sound. Each step's result is fixed (text.once) before the next reads it for every token."""
    cut = typed.where("type = 'TextLine'").select("doc_id", "line_index", "line", once(cut_tokens(F.col("text"))).alias("tokens"))
    cut = cut.select("*", once(_shifts(F.col("tokens"))).alias("shifts"))
    cut = cut.select("doc_id", "line_index", "line", once(_items(F.col("tokens"), F.col("shifts"))).alias("items"))
    cut = cut.select("*", once(_enclosed(F.col("items"))).alias("e"))
    masks = F.transform(F.regexp_extract_all("e.masks", F.lit(".."), F.lit(0)), lambda m: F.conv(m, 16, 10).cast("int"))
    return cut.select("doc_id", "line_index", "line", "items", masks.alias("masks"), (~F.col("e.state.bad") & (F.col("e.state.mask") == 0)).alias("sound"))


def tokens(typed: DataFrame) -> DataFrame:
    """doc_id, line_index, token_index, value, type, clean, language, normalized, enclosures, lemmatizable, alignable, parts: the tokens of the text lines of lines().

    enclosures: what is open before the token. parts: the signs, glosses, joiners and brackets of words and lone determinatives. A token that is none of the grammar's is Invalid.
    Words of more than atf.LONGEST_WORD characters are Invalid, too.
    """
    shift, value = F.col("shift"), F.col("value")
    rows = _cut(typed).select("doc_id", "line_index", F.posexplode(F.arrays_zip("items", "masks")).alias("token_index", "x"))
    rows = rows.select("doc_id", "line_index", "token_index", F.col("x.items.token").alias("value"), F.col("x.items.shift").alias("shift"), F.col("x.masks").alias("mask"))
    rows = rows.withColumn("type", atf.token_type(value, shift))
    word = F.col("type").isin("Word", "LoneDeterminative", "AkkadianWord", "GreekWord")
    language = F.when(word | shift.isNotNull(), F.when(shift.isNull(), "AKKADIAN").otherwise(atf.language_of(shift)))
    unclear = F.lit(False)
    for mark in ("/", "x", "X", "..."):
        unclear = unclear | F.contains(value, F.lit(mark))
    has_lemma = F.col("type").isin("Word", "AkkadianWord", "GreekWord") & F.col("language").isin(*atf.LEMMATIZABLE) & ~unclear
    names = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(bit) != 0, name) for name, bit in _BIT.items()]), lambda n: n.isNotNull())
    rows = rows.withColumn("language", F.when(word, language)).withColumns({"clean": F.when(word, atf.clean(value)).otherwise(value), "normalized": atf.normalized_of(shift), "enclosures": names, "lemmatizable": F.coalesce(has_lemma, F.lit(False)), "parts": F.when(F.col("type").isin("Word", "LoneDeterminative"), atf.parts(value))})
    return rows.select("doc_id", "line_index", "token_index", "value", "type", "clean", "language", "normalized", "enclosures", "lemmatizable", F.col("lemmatizable").alias("alignable"), "parts")


def problems(typed: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, line_index, problem, value: lines of no kind, marks given twice, enclosures that don't match, tokens of no kind. found: the tokens, if there are any already."""
    told = lambda df, problem, value: df.select("doc_id", "line_index", F.lit(problem).alias("problem"), F.col(value).alias("value"))
    marks = F.split(F.col("status"), "")
    twice = F.col("type").endswith("AtLine") & (F.size(marks) != F.size(F.array_distinct(marks)))
    of_lines = typed.select("doc_id", "line_index", F.when(F.col("type") == "Invalid", "Invalid line").when(twice, "Duplicate status").alias("problem"), F.when(F.col("type") == "Invalid", F.col("line")).otherwise(F.col("status")).alias("value"))
    out = of_lines.where(F.col("problem").isNotNull())
    cut = _cut(typed)
    if found is not None:
        return out.unionByName(told(cut.where(~F.col("sound")), "Invalid enclosures", "line")).unionByName(told(found.where("type = 'Invalid'"), "Invalid token", "value"))
    # what is wrong with a line's enclosures is told in front of its tokens, so that lines are cut once
    line = F.struct(F.col("line").alias("value"), F.lit(None).cast("string").alias("shift"), F.lit("Invalid enclosures").alias("problem"))
    words = F.transform("items", lambda x: F.struct(x["token"].alias("value"), x["shift"].alias("shift"), F.lit("Invalid token").alias("problem")))
    told_of = F.concat(F.when(F.col("sound"), F.slice(F.array(line), 1, 0)).otherwise(F.array(line)), words)
    rows = cut.select("doc_id", "line_index", F.explode(told_of).alias("x")).select("doc_id", "line_index", "x.problem", "x.value", "x.shift")
    wrong = (F.col("problem") == "Invalid enclosures") | (atf.token_type(F.col("value"), F.col("shift")) == "Invalid")
    return out.unionByName(rows.where(wrong).select("doc_id", "line_index", "problem", "value"))


# The older style


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, "[\t ]+", " "), r"^[ \r]+|[ \r]+$", "")


def rewritten(df: DataFrame, old: str, new: str) -> DataFrame:
    """df with the lines of the older style in `old` rewritten in `new`. Each step's result is fixed before the next reads it, since most steps read it more than once."""
    rows = df.select("*", once(_trimmed(F.col(old))).alias("__line"))
    text = lambda i: F.nullif(F.regexp_extract("__line", legacy.TEXT_LINE, i), F.lit(""))
    rows = rows.withColumns({"__number": legacy.number(text(1)), "__text": text(2)})
    for step in legacy.STEPS:
        rows = rows.select(*[c for c in rows.columns if c != "__text"], once(F.when(F.col("__text").isNotNull(), step(F.col("__text")))).alias("__text"))
    line = F.when(F.col("__text").isNotNull(), F.concat("__number", F.lit(". "), "__text")).otherwise(legacy.other_line(F.col("__line")))
    return rows.select(*df.columns, line.alias(new))


def modern(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_index, old, line: each line of texts in the older style as it was and in the present grammar (see legacy).

    Columns without a number are counted, from 1 on each face or object of a text. A null text has no lines; null ids are texts of their own kind: their lines are counted together.
    """
    cut = lambda df: df.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line_index", "old"))
    rows = rewritten(_dealt(cut(docs)), "old", "line")
    # no line with a text becomes one that begins so, and those that do stay as they are: they are found without rewriting anything
    at = _dealt(cut(docs.where(F.contains(F.col(f"`{text_col}`"), F.lit("@"))))).select("doc_id", "line_index", once(_trimmed(F.col("old"))).alias("line"))
    bare = F.col("line") == "@column"
    marks = at.where(F.startswith("line", F.lit("@"))).select("doc_id", "line_index", bare.alias("bare"), once(bare | atf.line_type(F.col("line")).isin("SurfaceAtLine", "ObjectAtLine")).alias("counts")).where("counts")
    so_far = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    sides = marks.withColumn("side", F.sum(F.when(F.col("bare"), 0).otherwise(1)).over(so_far))
    counted = sides.where("bare").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("line_index"))).select(F.col("doc_id").alias("__d"), F.col("line_index").alias("__i"), "n")
    found = rows.join(written(counted), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("line_index") == F.col("__i")), "left")
    return found.select("doc_id", "line_index", "old", F.when(F.col("n").isNotNull(), F.concat(F.lit("@column "), F.col("n").cast("string"))).otherwise(F.col("line")).alias("line"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.atf") -> DataFrame:
    """doc_id (the file's name up to its first point), path, text of each file of a folder that fits the pattern."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.regexp_extract(F.url_decode("path"), r"([^/.]+)[^/]*$", 1).alias("doc_id"), "path", "text")


def imported(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts of the older style as typed lines (see lines) and the problems that are left (see problems); line numbers are those of the file."""
    again = modern(docs, id_col, text_col)
    texts = again.withColumn("key", F.struct("doc_id", "line_index")).select("key", "line")
    typed = lines(texts, "key", "line").withColumnRenamed("doc_id", "key").drop("line_index")
    typed = typed.select(F.col("key.doc_id").alias("doc_id"), F.col("key.line_index").alias("line_index"), *[c for c in typed.columns if c != "key"])
    return typed, problems(typed)
