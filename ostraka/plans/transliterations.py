"""Documents read as transliterations: their lines become text, state, column and note lines, their words are set in brackets, glosses and joiners by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostraka.operators import signnames, transliterations

from .base import query, read


def written(spark, sf_dir):
    """doc_id and a transliteration: of each line the runs of a-z, decorated by their place; every tenth line from the sixth on is something else."""
    plain = lambda line: F.regexp_extract_all(F.lower(line), F.lit("([a-z]+)"), F.lit(1))
    dressed = lambda w, j: F.when(j % 6 == 1, F.concat(F.lit("["), w, F.lit("]"))).when(j % 6 == 2, F.concat(F.lit("{d}"), w)).when(j % 6 == 3, F.concat(w, F.lit("#?"))).when(j % 6 == 4, F.concat(w, F.lit("-"), w)).when(j % 6 == 5, F.concat(F.lit("<<"), w, F.lit(">>"))).otherwise(w)

    def line(text, i):
        words, number = plain(text), (i + 1).cast("string")
        joined = F.array_join(words, " ")
        return (
            F.when(F.size(words) == 0, F.lit(""))
            .when(i % 10 == 6, joined)
            .when(i % 10 == 7, F.concat(F.lit("$ "), number, F.lit(" lines blank")))
            .when(i % 10 == 8, F.concat(F.lit("@column "), number))
            .when(i % 10 == 9, F.concat(F.lit("#note: "), joined))
            .otherwise(F.concat(number, F.lit(". "), F.array_join(F.transform(words, dressed), " ")))
        )

    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_LINES = """
    D AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), L AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM D), W AS (SELECT doc_id, i, regexp_extract_all(lower(line), '[a-z]+') AS w FROM L),
    T AS (SELECT doc_id, i, unnest(range(len(w))) AS j, unnest(w) AS w, len(w) AS n FROM W WHERE i % 10 < 6),
    K AS (SELECT *, w = 'x' OR regexp_full_match(w, '[abdefghiklmnpqrstuwyz]+') AS ok FROM T)"""


@query(f"WITH {_LINES} SELECT doc_id, CASE WHEN len(w) = 0 THEN 'EmptyLine' ELSE ['Invalid', 'StateDollarLine', 'ColumnAtLine', 'NoteLine', 'TextLine'][CASE WHEN i % 10 < 6 THEN 5 ELSE i % 10 - 5 END] END AS type, count(*) AS n FROM W GROUP BY ALL")
def transliterated_lines(spark, sf_dir):
    """How many lines of each kind a document has."""
    return transliterations.lines(written(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES} SELECT doc_id, CAST(i AS INTEGER) AS line_index, count(*) FILTER (ok) AS words, count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok AND w <> 'x') AS lemmatizable,
    CAST(sum(CASE WHEN NOT ok THEN 0 ELSE CAST(j % 6 = 2 AS INTEGER) + CAST(w <> 'x' AS INTEGER) * CASE WHEN j % 6 = 4 THEN 2 ELSE 1 END END) AS BIGINT) AS readings FROM K GROUP BY ALL""")
def transliterated_words(spark, sf_dir):
    """Words, what is no word, words with lemmas and readings of each text line."""
    found = transliterations.tokens(transliterations.lines(written(spark, sf_dir)))
    readings = F.size(F.filter("parts", lambda p: p["type"] == "Reading"))
    return found.groupBy("doc_id", "line_index").agg(
        F.count(F.when(F.col("type") == "Word", 1)).alias("words"),
        F.count(F.when(F.col("type") == "Invalid", 1)).alias("invalid"),
        F.count(F.when(F.col("lemmatizable"), 1)).alias("lemmatizable"),
        F.sum(F.when(F.col("parts").isNotNull(), readings).otherwise(0)).alias("readings"),
    )


@query(f"WITH {_LINES} SELECT doc_id, CAST(i AS INTEGER) AS line_index, 'Invalid token' AS problem, CASE j % 6 WHEN 1 THEN '[' || w || ']' WHEN 2 THEN '{{d}}' || w WHEN 3 THEN w || '#?' WHEN 4 THEN w || '-' || w WHEN 5 THEN '<<' || w || '>>' ELSE w END AS value FROM K WHERE NOT ok UNION ALL SELECT doc_id, CAST(i AS INTEGER), 'Invalid line', array_to_string(w, ' ') FROM W WHERE i % 10 = 6 AND len(w) > 0")
def transliteration_problems(spark, sf_dir):
    """What is wrong, as rows."""
    return transliterations.problems(transliterations.lines(written(spark, sf_dir)))


def _signs(spark, sf_dir):
    """A sign list out of the documents' words of two and three letters; those of three have a number."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).where("length(w) between 2 and 3").distinct()
    numbers = F.when(F.length("w") == 3, F.array(F.struct(F.lit("ABZ").alias("name"), F.concat(F.lit("3"), F.left("w", F.lit(1))).alias("number")))).otherwise(F.array().cast("array<struct<name:string,number:string>>"))
    return words.select(F.upper("w").alias("name"), F.array(F.struct(F.col("w").alias("value"), F.lit(1).alias("subIndex"))).alias("values"), numbers.alias("lists"), F.array(F.ascii("w")).alias("unicode"))


_NAME = "CASE WHEN w = 'x' THEN 'X' WHEN len(w) = 2 THEN upper(w) WHEN len(w) = 3 THEN 'ABZ3' || w[1] ELSE '?' END"


@query(f"""WITH {_LINES}, N AS (SELECT doc_id, i, j, CASE WHEN j % 6 = 2 THEN '? ' ELSE '' END || {_NAME} || CASE WHEN j % 6 = 4 THEN ' ' || {_NAME} ELSE '' END AS name FROM K WHERE ok AND j % 6 <> 5)
    SELECT doc_id, CAST(i AS INTEGER) AS line_index, string_agg(name, ' ' ORDER BY j) AS names FROM N GROUP BY ALL""")
def line_sign_names(spark, sf_dir):
    """The standard names of the signs of each line; what is removed does not count."""
    tokens = transliterations.tokens(transliterations.lines(written(spark, sf_dir)))
    return signnames.sign_names(tokens, _signs(spark, sf_dir)).select("doc_id", "line_index", F.array_join("names", " ").alias("names"))


_POINT = "CASE WHEN w = 'x' THEN '' WHEN len(w) IN (2, 3) THEN ' ' || ord(w) ELSE ' -' END"


@query(f"""WITH {_LINES}, N AS (SELECT doc_id, i, j, CASE WHEN j % 6 = 2 THEN ' -' ELSE '' END || {_POINT} || CASE WHEN j % 6 = 4 THEN {_POINT} ELSE '' END || CASE WHEN j + 1 < n THEN ' 9999' ELSE '' END AS point FROM K WHERE ok)
    SELECT doc_id, CAST(i AS INTEGER) AS line_index, trim(string_agg(point, '' ORDER BY j)) AS points FROM N GROUP BY ALL HAVING points <> ''""")
def line_code_points(spark, sf_dir):
    """The code points of each line's signs, a mark between words, and a stroke where the list has none."""
    tokens = transliterations.tokens(transliterations.lines(written(spark, sf_dir)))
    shown = F.transform("points", lambda p: F.coalesce(F.get(p["unicode"], F.lit(0)).cast("string"), F.lit("-")))
    return signnames.code_points(tokens, _signs(spark, sf_dir)).select("doc_id", "line_index", F.array_join(shown, " ").alias("points"))


def _old_style(spark, sf_dir):
    """Documents in an older style: words in capitals between underscores, in half brackets, with marks behind brackets, in braces, with digits; every fourth line has two primes."""
    words = lambda line: F.regexp_extract_all(F.lower(line), F.lit("([a-np-uwyz]+)"), F.lit(1))
    dressed = lambda w, j: F.when(j % 6 == 0, F.concat(F.lit("_"), w, F.lit("-"), w, F.lit("_"))).when(j % 6 == 1, F.concat(F.lit("⸢"), w, F.lit("⸣"))).when(j % 6 == 2, F.concat(F.lit("["), w, F.lit("]?"))).when(j % 6 == 3, F.concat(F.lit("{"), F.upper(w), F.lit("}"))).when(j % 6 == 4, F.concat(w, F.lit("2"))).otherwise(w)
    line = lambda text, i: F.when(F.size(words(text)) == 0, F.lit("# a note")).otherwise(F.concat((i + 1).cast("string"), F.when(i % 4 == 0, "′′").otherwise(""), F.lit(". "), F.array_join(F.transform(words(text), dressed), " \t")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("""WITH D AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), L AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM D),
    W AS (SELECT doc_id, i, regexp_extract_all(lower(line), '[a-np-uwyz]+') AS w FROM L),
    F AS (SELECT doc_id, i, list_transform(w, lambda x, j: {w: x, f: replace(replace(replace(x, 'sz', 'š'), 'c', 'š'), 'j', 'g'), j: (j - 1) % 6}) AS f FROM W)
    SELECT doc_id, CAST(i AS INTEGER) AS line_index, CASE WHEN len(f) = 0 THEN '#note: a note' ELSE CASE WHEN i % 4 = 0 THEN 'A+' || (i + 1) || '''' ELSE CAST(i + 1 AS VARCHAR) END || '. ' || array_to_string(list_transform(f, lambda x: CASE x.j WHEN 0 THEN upper(x.f) || '.' || upper(x.f)
        WHEN 1 THEN x.f || '#' WHEN 2 THEN '[' || x.f || '?]' WHEN 3 THEN CASE WHEN x.w = 'i' THEN '{m}' ELSE '{' || x.f || '}' END WHEN 4 THEN x.f || '₂' ELSE x.f END), ' ') END AS line FROM F""")
def modern_lines(spark, sf_dir):
    """Lines of the older style in the present grammar."""
    return transliterations.modern(_old_style(spark, sf_dir)).select("doc_id", "line_index", "line")
