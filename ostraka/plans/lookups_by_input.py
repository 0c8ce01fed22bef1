"""Queries of the searches with a user's input, over parts, customers and events read as nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import searches
from .base import query, read


def _things(spark, sf_dir):
    """Parts as things: every fifth name has a long vowel; related terms, types and references of varying number."""
    key = F.col("p_partkey")
    name = F.when(key % 5 == 0, F.translate("p_name", "i", "ī")).otherwise(F.col("p_name"))
    terms = F.when(key % 3 == 0, F.array(F.concat(F.lit("old "), F.col("p_type")), F.concat(F.lit("ring of "), F.col("p_brand")))).when(key % 3 == 1, F.array(F.lit("Ring")))
    references = F.slice(F.array(*[F.lit(str(i)) for i in range(4)]), 1, (key % 4).cast("int"))
    return read(spark, sf_dir, "part").select(F.concat(name, F.lit(" "), F.lpad(key.cast("string"), 6, "0")).alias("id"), terms.alias("terms"), references.alias("references"), F.when(key % 7 == 0, F.array(F.lit("a"), F.lit("b"))).alias("lexicon"))


@query("""WITH T AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN translate(p_name, 'i', 'ī') ELSE p_name END || ' ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS id, p_name, p_partkey AS k, p_brand FROM part),
    R AS (SELECT id, CASE WHEN p_name LIKE 'ring%' THEN 1 WHEN p_name LIKE '%ring%' THEN 2 WHEN k % 3 = 0 THEN 4 WHEN k % 3 = 1 THEN 3 ELSE 6 END AS rank, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END + k % 4 + CAST(k % 7 = 0 AS INTEGER) AS richness FROM T)
    SELECT id, rank, CAST(richness AS INTEGER) AS richness, row_number() OVER (ORDER BY rank, richness DESC, lower(id), id) AS place FROM R WHERE rank < 6""")
def things_by_relevance(spark, sf_dir):
    """Names and terms that match, best first; the place is told by the same order."""
    from ..operators import windows

    found = searches.by_relevance(_things(spark, sf_dir), "ring", "id", "terms", ["terms", "references"], ["lexicon"])
    key = F.struct("rank", (-F.col("richness")).alias("r"), F.lower("id").alias("l"), "id")
    return windows.placed(found.select("id", "rank", "richness"), key, "place")


def _signs(spark, sf_dir):
    """Parts as signs: simple ones by the first word and size, compounds of two, readings, list numbers and places in an order."""
    key, size = F.col("p_partkey"), F.col("p_size")
    word = F.upper(F.get(F.split("p_name", " "), F.lit(0)))
    other = F.upper(F.get(F.split("p_name", " "), F.lit(1)))
    number = key.cast("string")
    name = F.when(key % 4 == 0, F.concat(F.lit("|"), word, F.lit("."), other, F.lit("×"), number, F.lit("|"))).when(key % 4 == 1, F.concat(F.lit("|("), other, F.lit("+"), number, F.lit(")&"), word, F.lit("|"))).when(key < 64, F.when(key % 8 == 2, word).otherwise(other)).otherwise(F.concat(word, number))
    values = F.array(F.struct(F.lower(word).alias("value"), F.when(size % 5 != 0, size % 5).alias("subIndex")), F.struct(F.lower(other).alias("value"), (size % 3 + 1).alias("subIndex")))
    lists = F.when(key % 2 == 0, F.array(F.struct(F.lit("MZL").alias("name"), number.alias("number")))).otherwise(F.array().cast("array<struct<name:string,number:string>>"))
    keys = F.create_map(F.lit("neo"), F.array(key * 3))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), values.alias("values"), lists.alias("lists"), keys.alias("sortKeys"), F.array(key.cast("int")).alias("unicode"))


_SIGNS = """
    P AS (SELECT p_partkey AS k, p_size AS z, upper(string_split(p_name, ' ')[1]) AS a, upper(string_split(p_name, ' ')[2]) AS b FROM part),
    S AS (SELECT *, CASE WHEN k % 4 = 0 THEN '|' || a || '.' || b || '×' || k || '|' WHEN k % 4 = 1 THEN '|(' || b || '+' || k || ')&' || a || '|' WHEN k < 64 THEN CASE WHEN k % 8 = 2 THEN a ELSE b END ELSE a || k END AS name,
        [{v: lower(a), i: CASE WHEN z % 5 <> 0 THEN z % 5 END}, {v: lower(b), i: z % 3 + 1}] AS v FROM P)"""


@query(f"""WITH {_SIGNS}, Q AS (SELECT DISTINCT trim(name, '|') AS q FROM S WHERE (lower(a) = 'hot' AND z % 5 = 1) OR (lower(b) = 'ring' AND z % 3 + 1 = 1))
    SELECT DISTINCT name FROM S WHERE len(list_filter((SELECT list(q) FROM Q), lambda q: regexp_matches(name, '(^|[.+×&%@x|()])' || regexp_escape(q) || '($|[.+×&%@x|()])'))) > 0""")
def composite_signs(spark, sf_dir):
    """Signs made of those with either of two readings."""
    signs = _signs(spark, sf_dir)
    return searches.composites(signs, "hot", 1).select("name").union(searches.composites(signs, "ring", 1).select("name")).distinct()


@query(f"WITH {_SIGNS} SELECT name, CAST(min(CASE WHEN x.v = 'ring' THEN x.i END) AS INTEGER) AS index FROM (SELECT k, name, unnest(v) AS x FROM S) GROUP BY k, name HAVING bool_or(x.v = 'ring')")
def sign_homophones(spark, sf_dir):
    """Signs with a reading, whatever its index."""
    return searches.homophones(_signs(spark, sf_dir), "ring").select("name", "index")


@query(f"WITH {_SIGNS}, K AS (SELECT k * 3 AS key FROM S WHERE name IN (SELECT name FROM S WHERE k = 50)) SELECT CAST(key AS BIGINT) AS key, CAST(row_number() OVER (PARTITION BY key ORDER BY k, name) - 1 AS INTEGER) AS place, name, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS number FROM K JOIN S ON abs(k * 3 - key) <= 5")
def neighbouring_signs(spark, sf_dir):
    """The signs next to each place of one sign in an order."""
    signs = _signs(spark, sf_dir)
    name = signs.where("p_partkey = 50").first()["name"]
    return searches.neighbours(signs, name, "neo").select("key", "place", "name", "number")


@query("""WITH B AS (SELECT p_partkey AS id, p_brand AS family, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1950 + p_size END AS year, p_name AS title, p_type AS short, CAST(p_size AS VARCHAR) AS number, coalesce(p_partkey % 10 = 0, false) AS deprecated FROM part)
    SELECT id, 'a' AS asked FROM B WHERE family = 'Brand#7' AND year BETWEEN 1980 AND 1989 AND title LIKE 'small%' AND NOT deprecated UNION ALL SELECT id, 'b' FROM B WHERE lower(short) = 'promo' AND number = '12' AND NOT deprecated""")
def free_bibliography(spark, sf_dir):
    """Two free queries: an author with a cut year and a title's beginning, a short title with a number."""
    key = F.col("p_partkey")
    # a digit in a name would end it: brands are spelt with letters
    author = F.array(F.struct(F.translate("p_brand", "0123456789#", "abcdefghij ").alias("family")))
    records = read(spark, sf_dir, "part").select(key.alias("id"), author.alias("author"), F.when(key % 4 != 0, F.col("p_size") + 1950).alias("year"), F.col("p_name").alias("title"), F.col("p_type").alias("container_title_short"), F.col("p_size").cast("string").alias("collection_number"), F.lit(None).cast("string").alias("title_short"), F.lit(None).cast("string").alias("volume"), F.when(key % 10 == 0, True).alias("deprecated"))
    first, second = searches.bibliography(records, "BRAND h 198 SMALL"), searches.bibliography(records, "Promo 12")
    return first.select("id", F.lit("a").alias("asked")).unionByName(second.select("id", F.lit("b").alias("asked")))


@query("""WITH F AS (SELECT user_id, event_type AS sign, CAST(event_id % 7 AS VARCHAR) AS cluster, CASE WHEN event_id % 3 = 0 THEN value > 1 END AS middle FROM events)
    SELECT c_custkey AS fragment, c_mktsegment AS script, count(*) FILTER (sign = 'click' AND coalesce(middle, true) AND cluster = '3') AS n FROM F JOIN customer ON c_custkey = user_id GROUP BY ALL HAVING bool_or(contains(lower(sign), 'click'))""")
def sign_annotations(spark, sf_dir):
    """Annotations of one sign in one cluster: centroids and those of no cluster, by fragment."""
    mark = F.struct(F.col("event_type").alias("signName"), (F.col("event_id") % 7).cast("string").alias("clusterId"), F.when(F.col("event_id") % 3 == 0, F.col("value") > 1).alias("isCentroid"))
    marks = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fragment")).agg(F.collect_list(mark).alias("annotations"))
    places = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fragment"), F.col("c_mktsegment").alias("script"), F.lit("NA").alias("period"), F.lit(None).cast("string").alias("site"))
    found = searches.annotations_of_sign(marks, places, "click", centroids_only=True, unclustered=True, cluster="3")
    return found.select("fragment", "script", F.size("annotations").cast("long").alias("n"))


@query("SELECT c_custkey AS id, c_name AS description FROM customer WHERE (contains(lower(CAST(c_custkey AS VARCHAR)), '11') OR contains(lower(c_name), '11')) AND c_mktsegment = 'BUILDING' ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 10")
def dossiers_by_text(spark, sf_dir):
    """The first ten dossiers that hold a text and have a value."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("description"), F.col("c_mktsegment").alias("provenance"))
    return searches.dossiers(rows, "11", provenance="BUILDING").select(F.col("id").cast("long").alias("id"), "description")


@query("SELECT doc_id AS id, string_agg(i || ':' || l[i + 1], '|' ORDER BY i) AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest([1, 3]) AS i FROM documents) WHERE i < len(l) GROUP BY doc_id")
def selected_chapter_lines(spark, sf_dir):
    """Two lines of each document, one variant of each; documents without any are left out."""
    listed = F.transform(F.split("text", "\n"), lambda t: F.struct(F.array(F.struct(F.lit("").alias("t")), F.struct(t.alias("t"))).alias("variants")))
    chapters = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), listed.alias("lines"))
    found = searches.selected_lines(chapters, {1: [1], 3: [1, 7]}).where(F.size("lines") > 0)
    return found.select("id", F.array_join(F.transform("lines", lambda x: F.concat(x["index"].cast("string"), F.lit(":"), F.get(x["line"]["variants"], F.lit(0))["t"])), "|").alias("lines"))
