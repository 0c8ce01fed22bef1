"""Files in and out: JSON imports, glossaries, sign readings, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A number as prefix.number or prefix.number.suffix.
NUMBER = r"^[^.\s]+\.[^.\s]+(\.[^.\s]+)?$"


def read_json(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType) -> DataFrame:
    """One row for each object of the files, each an object or an array of them; what is no JSON is a row in `_corrupt`.

    Files are read by the executors; each is one record, since an object may go over lines.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_corrupt", T.StringType())
    return spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").schema(fields).json(list(paths))


def check_import(rows: DataFrame, stored: DataFrame, id_col: str = "_id", needed: Sequence[str] = ()) -> DataFrame:
    """rows with a column problem: corrupt, no id, bad id, repeated id, stored already, missing <column>; null for good rows."""
    problem = F.when(F.col("_corrupt").isNotNull(), "corrupt") if "_corrupt" in rows.columns else F.when(F.lit(False), "")
    times = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__times"))
    known = stored.select(F.col(id_col).alias("__stored")).distinct()
    joined = rows.join(times, F.col(id_col) == F.col("__id"), "left").join(known, F.col(id_col) == F.col("__stored"), "left")
    problem = problem.when(F.col(id_col).isNull(), "no id").when(~F.col(id_col).rlike(NUMBER), "bad id")
    problem = problem.when(F.col("__times") > 1, "repeated id").when(F.col("__stored").isNotNull(), "stored already")
    for name in needed:
        problem = problem.when(F.col(name).isNull(), f"missing {name}")
    return joined.withColumn("problem", problem).drop("__id", "__times", "__stored")


def glossary_entries(text: Column) -> Column:
    """array of (lemma, guideword, pos, forms, senses) of a glossary file's text.

    The file is read by its lines: a line `@entry` opens an entry, `@end entry` closes it, and between them each line starts with its
    tag. An entry that is never closed, or whose first line is not `@entry word [meaning] class`, is left out; so are lines between entries.
    """
    def word(line: Column, place: int) -> Column:
        return F.coalesce(F.get(F.split(F.trim(line), r"\s+"), F.lit(place)), F.lit(""))

    def rest(line: Column, skip: int) -> Column:
        words = F.split(F.trim(line), r"\s+")
        return F.array_join(F.slice(words, skip + 1, F.size(words)), " ")

    def tagged(lines: Column, tag: str) -> Column:
        return F.filter(lines, lambda x: word(x, 0) == tag)

    def read(lines: Column) -> Column:
        opening = F.get(lines, F.lit(0))
        before, behind = F.substring_index(opening, "[", 1), F.substring_index(opening, "]", -1)
        inner = F.substring_index(F.substring_index(opening, "[", -1), "]", 1)
        form = lambda x: F.struct(F.trim(F.substring_index(rest(x, 1), "$", 1)).alias("transliteration"), word(F.substring_index(x, "$", -1), 0).alias("transcription"))
        sense = lambda x: F.struct(word(x, 1).alias("pos"), rest(x, 2).alias("guideword"))
        return F.struct(
            word(before, 1).alias("lemma"), F.trim(inner).alias("guideword"), word(behind, 0).alias("pos"),
            F.transform(F.filter(tagged(lines, "@form"), lambda x: F.contains(x, F.lit("$"))), form).alias("forms"),
            F.transform(F.filter(tagged(lines, "@sense"), lambda x: word(x, 2) != ""), sense).alias("senses"),
        )

    cut = F.split(text, r"(?m)^@entry(?=\s)")
    parts = F.slice(cut, 2, F.size(cut))
    closed = F.filter(parts, lambda p: p.rlike(r"(?m)^@end entry"))
    lines = F.transform(F.filter(closed, lambda p: F.get(F.split(p, "\n"), F.lit(0)).rlike(r"\[.*\]")), lambda p: F.split(F.concat(F.lit("@entry"), F.get(F.split(p, r"(?m)^@end entry"), F.lit(0))), "\n"))
    return F.filter(F.transform(lines, read), lambda e: (e["lemma"] != "") & (e["guideword"] != "") & (e["pos"] != ""))


def read_glossaries(spark: SparkSession, folder: str) -> DataFrame:
    """path and the columns of an entry for each entry of the folder's .glo files."""
    files = spark.read.option("pathGlobFilter", "*.glo").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.explode(glossary_entries(F.col("value"))).alias("entry")).select("path", "entry.*")


def number_of_file(name: Column) -> Column:
    """A picture's file name without .jpg or .jpeg."""
    return F.regexp_replace(name, r"\.jpe?g$", "")


def museum_number(text: Column) -> Column:
    """struct (prefix, number, suffix) of a museum number as it is written: a prefix, which may have points, a number and maybe a suffix; null if it is none. A missing suffix is empty."""
    pattern = r"^(.+?)\.([^.]+)(?:\.([^.]+))?$"
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i).alias(name) for i, name in ((1, "prefix"), (2, "number"), (3, "suffix"))]))


def read_ocred_signs(spark: SparkSession, path: str) -> DataFrame:
    """path, place, filename, signs: the entries of JSON files that hold an array of (filename, ocredSigns) each, in their order. A file that is no such array has no entries; signs that are missing are empty."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<struct<filename:string,ocredSigns:string>>").alias("items"))
    return files.select("path", F.posexplode("items").alias("place", "e")).select("path", "place", F.col("e.filename").alias("filename"), F.coalesce("e.ocredSigns", F.lit("")).alias("signs"))


def update_ocred_signs(fragments: DataFrame, entries: DataFrame, column: str = "ocredSigns") -> tuple[DataFrame, DataFrame]:
    """fragments (prefix, number, suffix, `column` and more) with the signs of entries (path, place, filename, signs) in the place of theirs; and for each entry path, place, number and its error, null if it was taken.

    A file's name without .jpg or .jpeg is the number. Of entries for one fragment the last by path and place counts. A null suffix is an empty one.
    """
    given = entries.withColumn("written", F.nullif(number_of_file(F.col("filename")), F.lit(""))).withColumn("key", museum_number(F.col("written")))
    keys = [F.col("prefix").alias("__p"), F.col("number").alias("__n"), F.coalesce("suffix", F.lit("")).alias("__s")]
    last = given.where("key is not null").groupBy("key").agg(F.max_by("signs", F.struct("path", "place")).alias("__signs")).select("key.*", "__signs").select(*keys, "__signs")
    same = (F.col("prefix") == F.col("__p")) & (F.col("number") == F.col("__n")) & (F.coalesce("suffix", F.lit("")) == F.col("__s"))
    updated = fragments.join(last, same, "left").withColumn(column, F.coalesce("__signs", column)).select(*fragments.columns)
    known = fragments.select(*keys).distinct().withColumn("__known", F.lit(True))
    met = given.join(known, (F.col("key.prefix") == F.col("__p")) & (F.col("key.number") == F.col("__n")) & (F.col("key.suffix") == F.col("__s")), "left")
    error = F.when(F.coalesce("filename", F.lit("")) == "", "Missing filename").when(F.col("key").isNull(), F.concat(F.lit("Invalid museum number: "), F.coalesce("written", F.lit("")))).when(F.col("__known").isNull(), "Fragment not found")
    return updated, met.select("path", "place", F.coalesce("written", F.lit("unknown")).alias("number"), error.alias("error"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """A table's lines in Markdown, one column `value`: head and rule first. Bars are escaped, line breaks become spaces, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c), r"\R", " ")
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "-|" * len(df.columns),)], "value string").coalesce(1)
    return head.unionAll(df.select(row([F.replace(cell(c), F.lit("|"), F.lit("\\|")) for c in df.columns])))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Part files of a report: csv, tsv, json or markdown (its head is in the first part)."""
    writer = df.write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    elif kind == "markdown":
        markdown_rows(df).write.mode("overwrite").text(path)
    else:
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table; rows need no order."""
    df.write.mode("append").parquet(path)
