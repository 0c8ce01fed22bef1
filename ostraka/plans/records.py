"""Queries of nested records: change logs, pages, chapters with manuscripts, small filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, detector, filters, manuscripts, pages
from .base import query, read


def _states(spark, sf_dir):
    """Parts as nested records, and what an edit made of them: a name, a list of words, a map of numbers, some rows gone and some new."""
    part = read(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    words = F.split("p_name", " ")
    fields = lambda name, tags, prices: [key.alias("id"), F.struct(F.col("p_brand").alias("brand"), name.alias("name")).alias("head"), tags.alias("tags"), prices.alias("sizes")]
    prices = lambda *items: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in items]), F.array(*[v for _, v in items]))
    old = part.where(key % 10 != 9).select(*fields(F.col("p_name"), words, prices(("a", size), ("b", size + 1))))
    name = F.when(key % 3 == 0, F.upper("p_name")).when(key % 3 == 1, F.col("p_name"))
    tags = F.when(key % 4 == 0, F.concat(words, F.array(F.col("p_type")))).when(key % 4 == 1, F.slice(words, 1, 1)).when(key % 4 == 2, F.reverse(words)).otherwise(words)
    sizes = F.when(key % 5 == 0, prices(("a", size), ("c", size))).otherwise(prices(("a", size + F.when(key % 2 == 0, 1).otherwise(0)), ("b", size + 1)))
    return old, part.where(key % 10 != 8).select(*fields(name, tags, sizes))


@query("""WITH P AS (SELECT p_partkey AS id, p_size AS z, p_name, p_type, string_split(p_name, ' ') AS w, p_partkey AS k FROM part), B AS (SELECT * FROM P WHERE k % 10 < 8)
    SELECT id, 'add' AS kind, '' AS path, NULL AS before, NULL AS after FROM P WHERE k % 10 = 9 UNION ALL SELECT id, 'remove', '', NULL, NULL FROM P WHERE k % 10 = 8
    UNION ALL SELECT id, 'change', 'head.name', p_name, upper(p_name) FROM B WHERE k % 3 = 0 UNION ALL SELECT id, 'remove', 'head.name', p_name, NULL FROM B WHERE k % 3 = 2
    UNION ALL SELECT id, 'add', 'tags.2', NULL, p_type FROM B WHERE k % 4 = 0 UNION ALL SELECT id, 'remove', 'tags.1', w[2], NULL FROM B WHERE k % 4 = 1
    UNION ALL SELECT id, 'change', 'tags.0', w[1], w[2] FROM B WHERE k % 4 = 2 UNION ALL SELECT id, 'change', 'tags.1', w[2], w[1] FROM B WHERE k % 4 = 2
    UNION ALL SELECT id, 'remove', 'sizes.b', CAST(z + 1 AS VARCHAR), NULL FROM B WHERE k % 5 = 0 UNION ALL SELECT id, 'add', 'sizes.c', NULL, CAST(z AS VARCHAR) FROM B WHERE k % 5 = 0
    UNION ALL SELECT id, 'change', 'sizes.a', CAST(z AS VARCHAR), CAST(z + 1 AS VARCHAR) FROM B WHERE k % 5 <> 0 AND k % 2 = 0""")
def nested_change_log(spark, sf_dir):
    """What an edit changed, through structs, lists and maps; whole rows without their content."""
    whole = F.col("path") == ""
    found = changes.nested_difference(*_states(spark, sf_dir), "id")
    return found.withColumns({side: F.when(~whole, F.col(side)) for side in ("before", "after")})


@query("SELECT CAST(rank AS INTEGER) AS rank, d.doc_id, CAST(n AS INTEGER) AS n, n_chars, md5(text) AS digest FROM (SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS n FROM documents) WHERE n > 0) r JOIN documents d ON d.doc_id = r.doc_id WHERE rank BETWEEN 21 AND 50")
def page_of_matches(spark, sf_dir):
    """The second page of thirty documents by their number of matches, with the texts of those alone."""
    docs = read(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("(the)"), F.lit(1))).alias("n")).where("n > 0")
    found = pages.hydrate(narrow, docs.select("doc_id", "n_chars", "text"), "doc_id", [F.desc("n")], 30, 20)
    return found.select("rank", "doc_id", "n", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


_WINDOW = ("\\bthe\\b", "\\ba\\b")


def _chapters(spark, sf_dir):
    """Documents as chapters: every third line stands in a manuscript's signs, each line has a variant of its own manuscript and every second one of the next."""
    lines = F.split(F.lower("text"), "\n")
    member = lambda n: F.struct(F.array(F.struct(n.cast("int").alias("manuscriptId"))).alias("manuscripts"))
    thirds = lambda m: F.filter(lines, lambda _, i: i % 3 == m)
    signs = [thirds(m) for m in range(3)]
    listed = F.transform(lines, lambda l, i: F.struct(F.when(i % 2 == 0, F.array(member(i % 3), member((i + 1) % 3))).otherwise(F.array(member(i % 3))).alias("variants")))
    ids = F.array(*[F.struct(F.lit(m).alias("id")) for m in range(3)])
    return read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), ids.alias("manuscripts"), F.array(*signs).alias("signs"), listed.alias("lines"))


@query(f"""WITH D AS (SELECT doc_id, string_split(lower(text), chr(10)) AS l FROM documents WHERE text IS NOT NULL), L AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM D),
    M AS (SELECT doc_id, i % 3 AS m, line, lead(line) OVER (PARTITION BY doc_id, i % 3 ORDER BY i) AS next FROM L), H AS (SELECT DISTINCT doc_id, m FROM M WHERE regexp_matches(line, '{_WINDOW[0]}') AND regexp_matches(next, '{_WINDOW[1]}')),
    V AS (SELECT doc_id, i, 0 AS v, i % 3 AS m FROM L UNION ALL SELECT doc_id, i, 1, (i + 1) % 3 FROM L WHERE i % 2 = 0)
    SELECT doc_id AS id, string_agg(DISTINCT m, ',' ORDER BY m) AS manuscripts, string_agg(DISTINCT i || ':' || v, ',') AS positions, count(DISTINCT i || ':' || v) AS n FROM V JOIN H USING (doc_id, m) GROUP BY doc_id""".replace("string_agg(DISTINCT i || ':' || v, ',') AS positions, ", "CAST(sum(i * 10 + v) AS BIGINT) AS position_sum, "))
def manuscript_sign_windows(spark, sf_dir):
    """Chapters with two lines in a row of one manuscript that match, and the lines and variants that those manuscripts have."""
    found = manuscripts.sign_matches(_chapters(spark, sf_dir), _WINDOW)
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda n, p: n + p["line"] * 10 + p["variant"])
    return found.select("id", F.array_join(F.col("manuscripts").cast("array<string>"), ",").alias("manuscripts"), places.alias("position_sum"), F.size("positions").cast("long").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal < 0 END, false)")
def live_records(spark, sf_dir):
    """Records not out of use; most say nothing about it."""
    marked = read(spark, sf_dir, "customer").withColumn("deprecated", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") < 0))
    return marked.where(filters.live(F.col("deprecated"))).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 40)) > 0")
def with_long_lines(spark, sf_dir):
    """Documents that have a line of over forty characters."""
    long = F.filter(F.split("text", "\n"), lambda l: F.length(l) > 40)
    return read(spark, sf_dir, "documents").where(text.has_lines(long)).select("doc_id")


@query("WITH L AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), G AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || '|' || l[i + 1] || '|' || l[i + 2])) AS g FROM L WHERE len(l) >= 3) SELECT doc_id, count(*) AS n, md5(min(g)) AS least FROM G GROUP BY doc_id")
def line_ngrams(spark, sf_dir):
    """How many runs of three lines each document has, and the least of them."""
    runs = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.ngrams(F.split("text", "\n"), 3)).alias("g"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.min(F.array_join("g", "|")).cast("binary")).alias("least"))


@query("""SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def delete_and_update(spark, sf_dir):
    """Parts without those of some orders, and the large ones set to 0."""
    gone = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    left = changes.delete(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), gone, ["p_partkey"])
    return changes.update_many(left, F.col("p_size") > 25, {"p_size": F.lit(0)})


@query("""WITH L AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
    M AS (SELECT doc_id, lang, i, list_contains(string_split(line, ' '), 'the') AS here, list_contains(string_split(lower(line), ' '), 'the') AS there FROM L),
    R AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) AS n FROM M WHERE here OR there)
    SELECT doc_id AS id, lang AS genre, CAST(i AS INTEGER) AS line_index, CAST(there AS INTEGER) AS manuscripts FROM R WHERE n <= 10 ORDER BY doc_id, i LIMIT 40""")
def lines_of_a_lemma(spark, sf_dir):
    """Lines whose reconstruction or manuscript has a word, ten of each language; how many manuscripts stay."""
    words = lambda text: F.transform(F.split(text, " "), lambda w: F.struct(F.array(w).alias("uniqueLemma")))
    variant = lambda t: F.array(F.struct(words(t).alias("reconstruction"), F.array(F.struct(words(F.lower(t)).alias("line")), F.struct(words(F.lit("x")).alias("line"))).alias("manuscripts")))
    listed = F.transform(F.split("text", "\n"), lambda t: F.struct(variant(t).alias("variants")))
    chapters = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("genre"), listed.alias("lines"))
    found = manuscripts.lines_with_lemma(chapters, "the")
    return found.select("id", "genre", "line_index", F.size(F.col("line.variants")[0]["manuscripts"]).alias("manuscripts"))


@query("""WITH P AS (SELECT p_partkey AS id, 'D' || p_size AS candidate, CASE WHEN p_size % 3 = 0 THEN 'not looked at' WHEN p_size % 3 = 1 THEN ' short ' END AS reason, CASE p_partkey % 4 WHEN 0 THEN ['D' || p_size] WHEN 1 THEN [] WHEN 2 THEN ['E1'] ELSE ['F' || p_size] END AS reviewed FROM part)
    SELECT id, CASE WHEN reason IS NULL THEN 'override.reason must be a non-empty string.' WHEN reason = ' short ' THEN 'override.reason must contain at least 10 meaningful characters.' WHEN len(reviewed) = 0 THEN 'override.reviewedCandidateIds must be a non-empty array of strings.'
        WHEN reviewed[1] = 'E1' THEN 'override.reviewedCandidateIds must match the current duplicate candidates returned by the server-side rerun.' WHEN reviewed[1] LIKE 'F%' THEN 'override.reviewedCandidateIds must include at least one current blocking duplicate candidate.' END AS problem FROM P""")
def override_problems(spark, sf_dir):
    """Why each override does not hold: a candidate that blocks and one that does not, reviews of either, of neither and of none."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    reason = F.when(F.col("p_size") % 3 == 0, "not looked at").when(F.col("p_size") % 3 == 1, " short ")
    candidate = lambda letter, decision: F.struct(F.concat(F.lit(letter), size).alias("id"), F.lit(decision).alias("decision"))
    found = F.array(candidate("D", "possible_duplicate"), candidate("F", "no_duplicate"))
    reviewed = F.when(key % 4 == 0, F.array(F.concat(F.lit("D"), size))).when(key % 4 == 1, F.array().cast("array<string>")).when(key % 4 == 2, F.array(F.lit("E1"))).otherwise(F.array(F.concat(F.lit("F"), size)))
    return read(spark, sf_dir, "part").select(key.alias("id"), detector.override_problem(reason, reviewed, found).alias("problem"))
