"""Signs of transliterations: readings, logograms, numbers and compounds against a sign list, as names or as code points, in the order of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ostraka.functions import atf, text
from ostraka.operators.tables import written

#: A sign that can't be told and one that the list doesn't have; the list whose numbers stand for names; what stands between words as a code point.
UNCLEAR, MISSING, LIST, SPACE = "X", "?", "ABZ", 9999
_SKIPPED = ("REMOVAL", "ACCIDENTAL_OMISSION", "INTENTIONAL_OMISSION")
_SPACE_PART = 2**31 - 1
_LOOKUP = "struct<value:string,index:int,name:string,otherwise:string,deep:boolean>"


def splittable(name: Column) -> Column:
    """Whether a compound is a row of signs: it has a dot and no parentheses."""
    return F.contains(name, F.lit(".")) & ~name.rlike("[()]")


def standard(signs: DataFrame) -> DataFrame:
    """name, standard, unicode of each sign: its first number of LIST, or its name; slashes and spaces are escaped. Of rows that repeat a name the least counts."""
    number = F.get(F.filter("lists", lambda r: r["name"] == LIST), F.lit(0))
    shown = F.coalesce(F.concat(number["name"], number["number"]), F.col("name"))
    escaped = F.replace(F.replace(shown, F.lit("/"), F.lit("\\u002F")), F.lit(" "), F.lit("\\u0020"))
    return signs.groupBy("name").agg(F.min(F.struct(escaped.alias("standard"), "unicode")).alias("s")).select("name", "s.standard", "s.unicode")


def values(signs: DataFrame, order: Column | None = None) -> DataFrame:
    """value, index, name: the sign of each reading; of several the first by `order`, by default by name. Index null is ₓ."""
    long = signs.select("name", (F.col("name") if order is None else order).alias("o"), F.explode("values").alias("v"))
    return long.groupBy(F.col("v.value").alias("value"), F.col("v.subIndex").cast("int").alias("index")).agg(F.min(F.struct("o", "name")).alias("f")).select("value", "index", F.col("f.name").alias("name"))


def _lookup(value: Column, index: Column, name: Column, otherwise: Column, deep: Column) -> Column:
    """What to look for: a reading with its index, failing that a name, failing that a text."""
    return F.struct(value.cast("string").alias("value"), index.cast("int").alias("index"), name.cast("string").alias("name"), otherwise.alias("otherwise"), deep.alias("deep"))


def _compound(name: Column, deep: Column) -> Column:
    """array of lookups of a compound without flags: its parts if it is a row of signs and deep, else the whole."""
    reading = lambda p: F.lower(p).rlike(atf.whole(atf.READING))
    bare = lambda p: F.regexp_extract(F.lower(p), f"^([{atf.READING_LETTERS}]+)", 1)
    part = lambda p: _lookup(F.when(reading(p), bare(p)), F.when(reading(p), atf.sub_index(F.lower(p))), p, p, F.lit(True))
    rows = F.transform(F.split(F.replace(name, F.lit("|"), F.lit("")), r"\."), part)
    whole = F.array(_lookup(F.lit(None), F.lit(None), name, name, deep))
    return F.when(deep & splittable(name), rows).otherwise(whole)


def unflagged(text: Column) -> Column:
    return F.regexp_replace(text, f"[{atf.FLAGS}]", "")


def _sign_lookups(piece: Column, deep: Column) -> Column:
    """array of lookups of one sign (see atf.sign_parts); none for what is no sign."""
    kind, name, sign = piece["type"], piece["name"], piece["sign"]
    one = lambda *of: F.array(_lookup(*of, deep))
    none = F.lit(None)
    given = F.when(F.startswith(sign, F.lit("|")), _compound(unflagged(sign), deep)).otherwise(one(none, none, unflagged(sign), unflagged(sign)))
    return (
        F.when(kind.isin("UnclearSign", "UnidentifiedSign"), one(none, none, none, F.lit(UNCLEAR)))
        .when(kind == "CompoundGrapheme", _compound(unflagged(piece["value"]), deep))
        .when(sign.isNotNull(), given)
        .when(kind.isin("Reading", "Logogram"), one(F.lower(name), piece["index"], none, F.lit(MISSING)))
        .when(kind == "Number", one(F.lower(name), F.lit(1), none, name))
        .otherwise(F.array().cast(f"array<{_LOOKUP}>"))
    )


def _divider(text: Column, deep: Column) -> Column:
    mark = F.regexp_extract(text, f"^({atf._DIVIDER_MARK})", 1)
    return F.array(_lookup(mark, F.lit(1), F.lit(None), F.lit(MISSING), deep))


def _alternatives(value: Column) -> Column:
    """array of arrays of lookups: each choice of a variant, not split any further."""
    choices = F.regexp_extract_all(value, F.lit(rf"({atf.COMPOUND}|[^/]+)"), F.lit(1))
    no = F.lit(False)
    told = F.transform(choices, lambda c: F.struct(c.alias("c"), atf.sign_parts(c, atf.piece_type(c)).alias("s")))
    return F.transform(told, lambda x: F.when(x["c"].rlike(atf.whole(atf.DIVIDER)), _divider(x["c"], no)).otherwise(_sign_lookups(x["s"], no)))


def _wanted(tokens: DataFrame) -> DataFrame:
    """doc_id, line_index, token_index, part, choice, place and a lookup for each sign that counts: what is removed, omitted or erased does not."""
    value, yes = F.col("value"), F.lit(True)
    over = F.regexp_extract(value, r"\\(.*)°[^°\\]*$", 1)
    shown = F.when(F.col("type") == "Erasure", over).otherwise(value)
    taken = tokens.where(F.col("type").isin("Word", "LoneDeterminative", "Erasure", "Divider", "DividerVariant"))
    taken = taken.withColumn("pieces", F.when(F.col("type").isin("Divider", "DividerVariant"), F.array(value)).otherwise(atf.pieces(shown)))
    before = lambda i: F.slice("pieces", 1, i)
    count = lambda items, *of: F.size(F.filter(items, lambda p: p.isin(*of)))

    def hidden(i: Column) -> Column:
        out = F.lit(False)
        for name, a, z in atf.ENCLOSURES:
            if name in _SKIPPED:
                out = out | (F.array_contains("enclosures", name).cast("int") + count(before(i), a) - count(before(i), z) > 0)
        marks = count(before(i), "°")
        return out | ((marks % 2 == 1) & (2 * count(before(i), "\\") < marks + 1))

    left = F.filter(F.transform("pieces", lambda p, i: F.struct(i.alias("part"), p.alias("piece"), hidden(i).alias("hidden"))), lambda x: ~x["hidden"])
    parts = taken.select("doc_id", "line_index", "token_index", "type", F.explode(left).alias("p")).select("doc_id", "line_index", "token_index", "type", "p.part", "p.piece")
    parts = parts.select("*", text.once(atf.piece_type(F.col("piece"))).alias("kind"))
    parts = parts.select("*", text.once(atf.sign_parts(F.col("piece"), F.col("kind"))).alias("sign"))
    variant = (F.col("type") == "DividerVariant") | (F.col("kind") == "Variant")
    lookups = F.when(variant, _alternatives(F.col("piece"))).when(F.col("type") == "Divider", F.array(_divider(F.col("piece"), yes))).otherwise(F.array(_sign_lookups(F.col("sign"), yes)))
    chosen = parts.withColumn("variant", variant).select("doc_id", "line_index", "token_index", "part", "variant", F.posexplode(lookups).alias("choice", "l"))
    return chosen.select("doc_id", "line_index", "token_index", "part", "variant", "choice", F.posexplode("l").alias("place", "l")).select("doc_id", "line_index", "token_index", "part", "variant", "choice", "place", "l.*")


def expansions(signs: DataFrame, order: Column | None = None, rounds: int = 10) -> DataFrame:
    """name, names: the standard names that a sign comes to when rows of signs are split, and their parts again. A sign that comes back to itself is an error."""
    known, read = standard(signs).select("name", "standard"), values(signs, order)
    now = known.select(F.col("name").alias("root"), F.array(F.lit(0)).alias("at"), F.col("name").alias("node"), F.lit(None).cast("string").alias("text"))
    done = now.limit(0)
    for _ in range(rounds):
        open_ = now.where(F.col("text").isNull())
        done = done.unionByName(now.where(F.col("text").isNotNull()))
        leaf = open_.where(~splittable(F.col("node"))).join(known, F.col("node") == F.col("name"), "left").select("root", "at", "node", F.coalesce("standard", "node").alias("text"))
        done = done.unionByName(leaf)
        split = open_.where(splittable(F.col("node")))
        if not split.head(1):
            break
        parts = split.select("root", "at", F.posexplode(_compound(F.col("node"), F.lit(True))).alias("i", "l")).select("root", F.concat("at", F.array("i")).alias("at"), "l.*")
        same = (F.col("l.value") == F.col("r.value")) & F.col("l.index").eqNullSafe(F.col("r.index"))
        met = parts.alias("l").join(read.alias("r"), same, "left").select("root", "at", F.col("r.name").alias("found"), F.col("l.name").alias("part"))
        named = met.join(known.withColumnRenamed("name", "k"), F.col("part") == F.col("k"), "left")
        now = named.select("root", "at", F.coalesce("found", "part").alias("node"), F.when(F.col("found").isNull(), F.coalesce("standard", "part")).alias("text"))
    else:
        raise ValueError("a sign of the list is a row of signs that holds itself")
    return done.groupBy(F.col("root").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("names"))


def sign_names(tokens: DataFrame, signs: DataFrame, order: Column | None = None) -> DataFrame:
    """doc_id, line_index, names: the standard names of the signs of each line of transliterations.tokens(), in order; lines without signs are left out.

    signs: name, values (array<struct<value, subIndex>>), lists (array<struct<name, number>>), unicode. A reading that the list lacks is '?', an unclear sign X, a number or
    compound that it lacks stands for itself; compounds that are rows of signs are split; variants are joined by slashes, unsplit. Null ids are lines of their own table.
    """
    signs = written(signs)
    known = written(standard(signs).join(expansions(signs, order), "name").select(F.col("name").alias("k"), "standard", "names"))
    read = written(values(signs, order).select(F.col("value").alias("v"), F.col("index").alias("i"), F.col("name").alias("found")))
    wanted = _wanted(tokens).join(read, (F.col("value") == F.col("v")) & F.col("index").eqNullSafe(F.col("i")), "left")
    met = wanted.withColumn("key", F.coalesce("found", "name")).join(known, F.col("key") == F.col("k"), "left")
    # a sign met by its reading is split further, one met by its name stands for itself
    by_reading = F.when(F.col("deep"), F.col("names")).otherwise(F.array("standard"))
    by_name = F.array(F.when(F.col("deep") & splittable(F.col("name")), F.col("name")).otherwise(F.col("standard")))
    texts = F.when(F.col("found").isNotNull(), by_reading).when(F.col("standard").isNotNull(), by_name).otherwise(F.array("otherwise"))
    item = F.struct("token_index", "part", "choice", "place", "variant", texts.alias("texts"))
    lines = met.groupBy("doc_id", "line_index").agg(F.array_sort(F.collect_list(item)).alias("x"))
    # choices of one variant follow each other: each but the first is joined to what stands before
    start = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.when(x["place"] == 0, F.lit("/")).otherwise(""), F.array_join(x["texts"], ""))))
        return F.when(x["variant"] & ((x["choice"] > 0) | (x["place"] > 0)), joined).otherwise(F.concat(out, x["texts"]))

    return lines.select("doc_id", "line_index", F.aggregate("x", start, step).alias("names"))


def code_points(tokens: DataFrame, signs: DataFrame, order: Column | None = None) -> DataFrame:
    """doc_id, line_index, points: array<struct<token_index, part, value, index, unicode>> of the named signs of each line in order, with SPACE between tokens; unicode is null where the list has no such sign.

    A sign is looked for by the first run of its name (before a bracket within it) and its index.
    """
    piece = F.transform(atf.pieces(F.col("value")), lambda p, i: F.struct(i.alias("part"), p.alias("piece"), atf.piece_type(p).alias("kind")))
    signed = F.filter(piece, lambda x: x["kind"].isin("Reading", "Logogram", "Number"))
    space = F.struct(F.lit(_SPACE_PART).alias("part"), F.lit("").alias("piece"), F.lit("").alias("kind"))
    # every token leaves a row, since the last one of a line, be it a word or not, has no space behind it
    shown = F.when(F.col("type").isin("Word", "LoneDeterminative"), F.concat(signed, F.array(space)))
    rows = tokens.select("doc_id", "line_index", "token_index", F.explode_outer(shown).alias("x"))
    run = F.regexp_extract("x.piece", rf"^([{atf.READING_LETTERS}]+|[{atf.LOGOGRAM_LETTERS}]+|\d+|[{atf.FRACTIONS}])", 1)
    index = F.when(F.col("x.kind").isin("Number", ""), 1).otherwise(atf.sub_index(F.regexp_replace(F.regexp_replace("x.piece", r"\(.*\)>?$|<\(.*$", ""), r"[\[\]]", "")))
    asked = rows.select("doc_id", "line_index", "token_index", F.col("x.part").alias("part"), run.alias("value"), index.alias("index"))
    signs = written(signs)
    read = written(values(signs, order).join(standard(signs), "name").select(F.col("value").alias("v"), F.col("index").alias("i"), "unicode"))
    met = asked.join(read, (F.col("value") == F.col("v")) & F.col("index").eqNullSafe(F.col("i")), "left")
    is_space = F.col("part") == _SPACE_PART
    points = F.struct("token_index", "part", "value", "index", F.when(is_space, F.array(F.lit(SPACE))).otherwise(F.col("unicode")).alias("unicode"))
    lines = met.groupBy("doc_id", "line_index").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), points))).alias("x"), F.max("token_index").alias("last"))
    kept = F.filter("x", lambda p: (p["part"] != _SPACE_PART) | (p["token_index"] < F.col("last")))
    return lines.select("doc_id", "line_index", text.once(kept).alias("points")).where(F.size("points") > 0)
