"""Queries of catalogues: point reads, filters on nested fields, projections, searches in signs, bibliography, dossiers and places, their orders and unions; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import names, sortkeys, text
from ..operators import changes, duplicates, filters, lookups, searches, windows
from .base import query, read

# Point reads


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 7")
def find_one(spark, sf_dir):
    """An error if there is none."""
    return lookups.one(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("p_partkey") == 7)


@query("SELECT page_id, regexp_extract(url, '([^/?#]+)(\\?[^/]*)?$', 1) AS file_name FROM pages WHERE regexp_extract(url, '([^/?#]+)(\\?[^/]*)?$', 1) IN (SELECT regexp_extract(url, '([^/?#]+)(\\?[^/]*)?$', 1) FROM pages WHERE page_id IN (1, 5, 8))")
def file_by_name(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]+)(\?[^/]*)?$", 1).alias("file_name"))
    return pages.join(pages.where(F.col("page_id").isin(1, 5, 8)).select("file_name").distinct(), "file_name", "left_semi").select("page_id", "file_name")


@query("SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_name, s_suppkey) AS INTEGER) AS sort_key FROM supplier")
def sort_keys_merged(spark, sf_dir):
    """Sort keys made apart and merged back."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").withColumn("sort_key", F.lit(None).cast("int"))
    keys = windows.placed(rows.select("s_suppkey", "s_name"), F.struct("s_name", "s_suppkey"), "sort_key").select("s_suppkey", F.col("sort_key").cast("int").alias("sort_key"))
    return changes.set_field(rows, keys, "s_suppkey", "sort_key")


# Filters on nested fields: a document's language and source stand for script, museum and project

_LN = "string_split(text, chr(10))"


def _docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.withColumn("script", F.struct(F.col("lang").alias("period"), F.col("source").alias("modifier"))).withColumn("projects", F.array("lang", "source")).withColumn("lines", text.sign_lines(F.col("text")))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def script_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where((F.col("script.period") == "en") & (F.col("script.modifier") == "src1")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE 'src2' IN (lang, source) AND lang = 'fr'")
def any_field(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.where(filters.equal(docs, "projects", "src2") & filters.equal(docs, "lang", "fr")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE len({_LN}) > 3 AND NOT len({_LN}) > 10")
def positional(spark, sf_dir):
    lines = F.col("lines")
    return _docs(spark, sf_dir).where(filters.reaches(lines, 3) & ~filters.reaches(lines, 10)).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'small')")
def title_prefix(spark, sf_dir):
    return read(spark, sf_dir, "part").where(filters.starts_with(F.array("p_name"), "SMALL")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE regexp_extract_all(p_name, '[aeiou]') IN (['a', 'i'], ['e', 'i']) OR regexp_extract_all(lower(p_type), '[aeiou]') IN (['a', 'i'], ['e', 'i'])")
def vowel_class(spark, sf_dir):
    vowels = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([aeiou])"))
    both = F.array(vowels(F.col("p_name")), vowels(F.col("p_type")))
    return read(spark, sf_dir, "part").where(filters.exactly(both, ["a", "i"]) | filters.exactly(both, ["e", "i"])).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE coalesce(nullif(lang, 'es'), '') = '' OR len(text) = 0")
def blank_notes(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(filters.blank(F.nullif(F.col("lang"), F.lit("es"))) | filters.blank(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def none_of(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(~F.col("source").isin("src1", "src2")).select("doc_id")


# Projections


@query("SELECT doc_id, md5(lower(coalesce(string_split(text, chr(10))[1], '-') || '|' || coalesce(string_split(text, chr(10))[3], '-'))) AS digest FROM documents")
def lines_picked(spark, sf_dir):
    picked = F.transform(F.array(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get("lines", i), F.lit("-")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(picked, "|")).alias("digest"))


@query("SELECT conv_id, string_agg(turn, ',' ORDER BY turn) AS kept FROM conversations WHERE list_contains(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'), 'the') GROUP BY conv_id")
def nested_kept(spark, sf_dir):
    """Of each group's nested items those whose words hold the lemma."""
    words = F.split(F.lower("text"), "[^a-zà-ÿ]+")
    groups = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", words.alias("words")))).alias("items"))
    kept = F.filter("items", lambda x: F.array_contains(x["words"], "the"))
    return groups.where(F.size(kept) > 0).select("conv_id", F.array_join(F.transform(kept, lambda x: x["turn"].cast("string")), ",").alias("kept"))


@query("SELECT p_partkey, p_brand, p_size * 2 AS p_size, 'part' AS kind FROM part")
def merged_objects(spark, sf_dir):
    """A nested object with a field replaced and one added, then put in the row's place."""
    doc = F.struct("p_partkey", "p_brand", "p_size").withField("p_size", F.col("p_size") * 2).withField("kind", F.lit("part"))
    return read(spark, sf_dir, "part").select(doc.alias("s")).select("s.*")


@query(f"SELECT doc_id, CAST(len(list_slice({_LN}, 1, 3)) AS INTEGER) AS n, md5(array_to_string(list_slice({_LN}, 1, 3), '|')) AS digest FROM documents")
def sliced(spark, sf_dir):
    first = F.slice(F.split("text", "\n"), 1, 3)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(first).alias("n"), F.md5(F.array_join(first, "|")).alias("digest"))


@query("SELECT doc_id, lang || '.' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.' || source END || '.jpg' AS file_name FROM documents")
def file_names(spark, sf_dir):
    suffix = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", names.file_name(F.col("lang"), F.col("doc_id").cast("string"), suffix).alias("file_name"))


# Joins


@query("SELECT DISTINCT user_id FROM events WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id % 500 = 3)")
def composite_members(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    groups = events.groupBy("user_id").agg(F.collect_set(F.struct("user_id", "event_type")).alias("members"))
    return lookups.among(groups, events.where("event_id % 500 = 3"), "members", ["user_id", "event_type"]).select("user_id")


@query("SELECT doc_id, line_index, page_id, quality FROM (SELECT doc_id, unnest(generate_series(0, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT))) AS line_index FROM documents) JOIN pages ON page_id = doc_id LEFT JOIN labels USING (doc_id)")
def cropped_annotations(spark, sf_dir):
    """Each line stands for a sign's annotation: one without an image goes, a date may be missing."""
    marks = text.lines(read(spark, sf_dir, "documents")).select("doc_id", F.col("line_index").cast("long").alias("line_index"))
    images = read(spark, sf_dir, "pages").select("page_id")
    return marks.join(images, F.col("page_id") == F.col("doc_id")).join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "line_index", "page_id", "quality")


@query("SELECT l_orderkey, string_agg(coalesce(s_name, 'missing'), ',' ORDER BY l_linenumber, l_suppkey) AS sources FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON s_suppkey = l_suppkey GROUP BY l_orderkey")
def references_injected(spark, sf_dir):
    """Nested references with their records; what is missing is told."""
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("refs"))
    known = read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select("s_suppkey", "s_name")
    found = lookups.regroup(orders, ["l_orderkey"], "refs", known, "l_suppkey", "s_suppkey", "record")
    return found.select("l_orderkey", F.array_join(F.transform("refs", lambda r: F.coalesce(r["record"]["s_name"], F.lit("missing"))), ",").alias("sources"))


@query("""SELECT p_partkey, coalesce((SELECT min(b.p_partkey) FROM part b WHERE b.p_name = a.p_name AND b.p_type = a.p_type AND b.p_size > 40),
    (SELECT min(b.p_partkey) FROM part b WHERE b.p_name = a.p_name AND b.p_size > 30), (SELECT min(b.p_partkey) FROM part b WHERE b.p_brand = a.p_brand)) AS found FROM part a""")
def glossary_cascade(spark, sf_dir):
    """The strictest match first: name and type, then the name, then the brand."""
    part = read(spark, sf_dir, "part")
    value = [(part.where("p_size > 40"), [("p_name", "p_name"), ("p_type", "p_type")], "p_partkey"), (part.where("p_size > 30"), [("p_name", "p_name")], "p_partkey"), (part, [("p_brand", "p_brand")], "p_partkey")]
    return lookups.cascade(part.select("p_partkey", "p_name", "p_type", "p_brand"), value, "found").select("p_partkey", "found")


# Aggregates of duplicate detection


@query("""WITH S AS (SELECT p_brand, unnest(['price', 'size', 'name']) AS signal, unnest([CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END, CAST(p_size AS DOUBLE), CAST(length(p_name) AS DOUBLE)]) AS value FROM part)
    SELECT p_brand, signal, round(avg(value), 4) AS mean FROM S WHERE value IS NOT NULL GROUP BY ALL""")
def signal_means(spark, sf_dir):
    price = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice"))
    signals = F.create_map(F.lit("price"), price, F.lit("size"), F.col("p_size").cast("double"), F.lit("name"), F.length("p_name").cast("double"))
    return duplicates.mean_signals(read(spark, sf_dir, "part").select("p_brand", signals.alias("signals")), "p_brand", "signals")


@query(f"SELECT lang, CAST(sum(len({_LN})) AS BIGINT) AS n FROM documents GROUP BY lang")
def array_total(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.size("lines")).alias("n"))


@query("""WITH P AS (SELECT o_custkey, (o_orderkey % 1000) / 1000.0 AS score, CASE WHEN o_orderkey % 97 = 0 THEN 1 WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 3 ELSE 4 END AS g, (o_orderkey % 10) / 10.0 AS c FROM orders),
    T AS (SELECT o_custkey, min(g) FILTER (g < 4 OR score >= 0.7) AS g, max(score) FILTER (g < 4 OR score >= 0.7) AS s, max(c) FILTER (g < 4 OR score >= 0.7) AS c FROM P GROUP BY o_custkey)
    SELECT o_custkey, CASE g WHEN 1 THEN 'likely_duplicate' WHEN 2 THEN 'possible_duplicate' WHEN 3 THEN 'insufficient_data' ELSE 'no_duplicate' END AS decision, CAST(coalesce(s, 0) AS DOUBLE) AS highest_score, CAST(coalesce(c, 0.5) AS DOUBLE) AS completeness FROM T""")
def duplicate_outcome(spark, sf_dir):
    key = F.col("o_orderkey")
    decision = F.when(key % 97 == 0, "likely_duplicate").when(key % 11 == 0, "possible_duplicate").when(key % 7 == 0, "insufficient_data").otherwise("not_duplicate")
    pairs = read(spark, sf_dir, "orders").select("o_custkey", decision.alias("decision"), ((key % 1000) / 1000).alias("score"), ((key % 10) / 10).alias("completeness"))
    return duplicates.outcome(pairs, "o_custkey", F.lit(0.5))


@query("""WITH K AS (SELECT p_partkey AS id, 'type_size' AS kind, p_type || '|' || p_size AS key FROM part UNION ALL SELECT DISTINCT p_partkey, 'size_word', p_size || '|' || unnest(string_split(p_name, ' ')) FROM part),
    S AS (SELECT kind, key FROM K GROUP BY ALL HAVING count(*) >= 2) SELECT kind, key, id FROM K JOIN S USING (kind, key)""")
def dup_blocks_whole(spark, sf_dir):
    """Blocks by container and by each title word; none is left out for its size."""
    size = F.col("p_size").cast("string")
    keys = {"type_size": F.concat_ws("|", "p_type", size), "size_word": F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: F.concat_ws("|", size, w))}
    return duplicates.blocks(read(spark, sf_dir, "part"), "p_partkey", keys, most=None).select("kind", "key", "id")


# Windows


@query("""SELECT conv_id, turn, coalesce(lag(turn) OVER w, last_value(turn) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous,
    coalesce(lead(turn) OVER w, first_value(turn) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def folio_ring(spark, sf_dir):
    return windows.ring(read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "turn")


@query("SELECT doc_id, unnest(generate_series(first, first + 2)) AS line FROM (SELECT doc_id, doc_id % 5 AS first FROM documents)")
def line_ranges(spark, sf_dir):
    first = F.col("doc_id") % 5
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(first, first + 2)).alias("line"))


# Orders


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END, CASE doc_id % 3 WHEN 0 THEN 'BM' WHEN 1 THEN 'K' ELSE 'Q' END <> 'K', CASE doc_id % 3 WHEN 0 THEN 0 ELSE 1 END, doc_id) AS place FROM documents")
def script_then_number(spark, sf_dir):
    script = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).when(F.col("lang") == "es", 3).otherwise(4)
    prefix = F.when(F.col("doc_id") % 3 == 0, "BM").when(F.col("doc_id") % 3 == 1, "K").otherwise("Q")
    key = F.struct(script.alias("script"), sortkeys.museum_key(prefix, F.col("doc_id").cast("string"), F.lit("")).alias("number"))
    return windows.placed(read(spark, sf_dir, "documents").select("doc_id", "lang"), key, "place").select("doc_id", "place")


@query("SELECT p_name, row_number() OVER (ORDER BY list_transform(regexp_extract_all(p_name, '.'), lambda c: CASE WHEN instr('-''abdeghḫiklmnpqrsṣštṭuwyz', c) = 0 THEN 1000 ELSE instr('-''abdeghḫiklmnpqrsṣštṭuwyz', c) END), p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def alphabet_sort(spark, sf_dir):
    words = read(spark, sf_dir, "part").select("p_name").distinct()
    return windows.placed(words, F.struct(sortkeys.alphabet_key(F.col("p_name")).alias("k"), "p_name"), "place")


_NUMERALS = ("", " I", " II", " IV", " IX", " X", " IIII")


@query(f"""WITH W AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(w[1]) || w[2:] ELSE w END || CASE WHEN p_partkey % 4 = 0 THEN ' ring' ELSE '' END AS word, {list(_NUMERALS)}[p_partkey % {len(_NUMERALS)} + 1] AS numeral
        FROM (SELECT p_partkey, translate(string_split(p_name, ' ')[2], CASE p_partkey % 5 WHEN 0 THEN 'iu' WHEN 1 THEN 'a' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'īū' WHEN 1 THEN 'â' ELSE '' END) AS w FROM part)),
    K AS (SELECT p_partkey, word || numeral AS word, CASE WHEN numeral = ' IIII' THEN word || numeral ELSE word END AS plain, CASE numeral WHEN ' I' THEN 1 WHEN ' II' THEN 2 WHEN ' IV' THEN 4 WHEN ' IX' THEN 9 WHEN ' X' THEN 10 ELSE 0 END AS number FROM W),
    L AS (SELECT p_partkey, word, plain, number, list_transform(regexp_extract_all(translate(plain, 'īūâÂ', 'iuaA'), '.'), lambda c: CASE WHEN c = ' ' THEN -1 WHEN instr('-''abdeghḫiklmnpqrsṣštṭuwyz', lower(c)) = 0 THEN 10000 ELSE 2 * instr('-''abdeghḫiklmnpqrsṣštṭuwyz', lower(c)) - CASE WHEN lower(c) = c THEN 1 ELSE 2 END END) AS letters,
        list_transform(regexp_extract_all(plain, '.'), lambda c: CASE WHEN c IN ('ī', 'ū') THEN 1 WHEN c IN ('â', 'Â') THEN 2 ELSE 0 END) AS signs FROM K)
    SELECT p_partkey, word, row_number() OVER (ORDER BY letters || signs || [number], p_partkey) AS place FROM L""")
def akkadian_sort(spark, sf_dir):
    """Words with capitals, long vowels, a second word and closing numbers, in the order of a dictionary."""
    key = F.col("p_partkey")
    noun = F.get(F.split("p_name", " "), F.lit(1))
    long = F.when(key % 5 == 0, F.translate(noun, "iu", "īū")).when(key % 5 == 1, F.translate(noun, "a", "â")).otherwise(noun)
    word = F.concat(F.when(key % 3 == 0, F.concat(F.upper(F.left(long, F.lit(1))), F.substr(long, F.lit(2)))).otherwise(long), F.when(key % 4 == 0, " ring").otherwise(""))
    numeral = F.get(F.array(*map(F.lit, _NUMERALS)), (key % len(_NUMERALS)).cast("int"))
    words = read(spark, sf_dir, "part").select("p_partkey", F.concat(word, numeral).alias("word"))
    return windows.placed(words, F.struct(sortkeys.akkadian_key(F.col("word")).alias("k"), "p_partkey"), "place").select("p_partkey", "word", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_brand), p_size, lower(p_name), p_partkey) AS place FROM part")
def bibliography_sort(spark, sf_dir):
    """By first author, year and title, case and accents apart."""
    key = F.struct(sortkeys.plain(F.col("p_brand")).alias("a"), F.col("p_size").alias("y"), sortkeys.plain(F.col("p_name")).alias("t"), "p_partkey")
    return windows.placed(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name"), key, "place").select("p_partkey", "place")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey % 5 <> 0, lower(n_name), n_nationkey) AS place FROM nation")
def provenance_order(spark, sf_dir):
    """Parents first, then children, each by name without half rings, quotes, accents and case."""
    name = sortkeys.plain(F.translate("n_name", "ʻʾʿ‘’", ""))
    key = F.struct((F.col("n_nationkey") % 5 != 0).alias("child"), name.alias("n"), "n_nationkey")
    return windows.placed(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), key, "place").select("n_nationkey", "place")


@query(None)
def random_one(spark, sf_dir):
    """One row, at random."""
    return read(spark, sf_dir, "part").orderBy(F.rand()).limit(1).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 60")
def stable_page(spark, sf_dir):
    return read(spark, sf_dir, "part").orderBy("p_partkey").offset(60).limit(30).select("p_partkey", "p_name")


@query("SELECT name, row_number() OVER (ORDER BY CAST(substr(name, 3) AS BIGINT)) AS place FROM (SELECT DISTINCT 'K.' || p_partkey AS name FROM part)")
def numeric_collation(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("K."), F.col("p_partkey").cast("string")).alias("name")).distinct()
    return windows.placed(rows, sortkeys.natural_key(F.col("name")), "place")


# Unions


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    each = [docs.groupBy(F.lit(name).alias("facet"), F.col(name).alias("value")).agg(F.count("*").alias("n")) for name in ("lang", "source")]
    return each[0].unionByName(each[1])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def set_operations(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").where("l_quantity > 49")
    every = read(spark, sf_dir, "supplier").select("s_suppkey")
    return every.intersect(items.select("l_suppkey")).exceptAll(items.where("l_returnflag = 'R'").select("l_suppkey").distinct())


# Searches


@query("SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM documents) WHERE regexp_matches(name, '(?i)[tṭτTṬΤ][hḫḥHḪḤʕʾʿ][eēêéèEĒÊÉÈ]') AND name <> '' ORDER BY name")
def colophon_names(spark, sf_dir):
    """Names that hold the three letters, from all places of each document."""
    each = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("name"))
    return searches.names(each, "the", [F.col("name")])


@query("""WITH S AS (SELECT p_partkey AS sign, unnest(string_split(p_name, ' ')) AS value, unnest([1, 2]) AS sub FROM part)
    SELECT a.sign, a.value, CAST(a.sub AS INTEGER) AS sub, count(DISTINCT b.sign) AS homophones FROM S a JOIN S b ON b.value = a.value AND b.sign <> a.sign WHERE a.value = 'ring' AND a.sub = 2 GROUP BY ALL""")
def sign_search(spark, sf_dir):
    """Signs with a reading and index, and how many others share the reading."""
    signs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sign"), F.posexplode(F.slice(F.split("p_name", " "), 1, 2)).alias("sub", "value")).withColumn("sub", F.col("sub") + 1)
    mine = signs.where("value = 'ring' and sub = 2")
    count = signs.where("value = 'ring'").groupBy("value").agg(F.count_distinct("sign").alias("n"))
    return mine.join(count, "value").select("sign", "value", "sub", (F.col("n") - 1).alias("homophones")).where("homophones > 0")


@query(f"SELECT doc_id, lang, string_agg(i, ',' ORDER BY i) AS kept FROM (SELECT doc_id, lang, unnest({_LN}) AS line, unnest(generate_series(0, len({_LN}) - 1)) AS i FROM documents) WHERE starts_with(lower(line), 'the ') GROUP BY ALL")
def annotations_by_sign(spark, sf_dir):
    """Documents that may hold the sign are found first; of their annotations those that are the sign stay."""
    docs = _docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the ")))
    kept = text.positions(F.col("lines"), lambda x: x.startswith("the "))
    return docs.where(F.size(kept) > 0).select("doc_id", "lang", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)1\\.?0') AND c_nationkey = 3 ORDER BY c_custkey LIMIT 50")
def dossier_search(spark, sf_dir):
    """Input is cut to 256 characters and escaped, then sought in names under a filter."""
    sought = "(?i)" + r"1\.?0"[:256]
    return read(spark, sf_dir, "customer").where(F.col("c_name").rlike(sought) & (F.col("c_nationkey") == 3)).orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small ring' THEN 0 WHEN starts_with(lower(p_name), 'small') THEN 1 WHEN contains(lower(p_name), 'ring') THEN 2 END AS rank FROM part WHERE lower(p_name) = 'small ring' OR starts_with(lower(p_name), 'small') OR contains(lower(p_name), 'ring')")
def realia_search(spark, sf_dir):
    """Quotation marks are taken off; a whole match, then a start, then any place."""
    whole, *_ = [w for w in ('"small ring"'.strip('"“”'),)]
    first, last = whole.split()
    low = F.lower("p_name")
    rank = F.when(low == whole, 0).when(low.startswith(first), 1).when(low.contains(last), 2)
    return read(spark, sf_dir, "part").withColumn("rank", rank).where("rank is not null").select("p_partkey", "p_name", "rank")


@query("""SELECT id, min(kind) AS kind FROM (SELECT p_partkey AS id, 0 AS kind FROM part WHERE lower(p_brand) = 'brand#2' AND p_size >= 10 AND p_size < 20
    UNION ALL SELECT p_partkey, 1 FROM part WHERE starts_with(p_name, 'small') UNION ALL SELECT p_partkey, 2 FROM part WHERE contains(lower(p_type), 'eco') AND p_size = 11) GROUP BY id""")
def bibliography_search(spark, sf_dir):
    """Author, year and title; title alone; container and number: of three searches each record's first."""
    part = read(spark, sf_dir, "part")
    found = [part.where((F.lower("p_brand") == "brand#2") & (F.col("p_size") >= 10) & (F.col("p_size") < 20)), part.where(F.col("p_name").startswith("small")), part.where(F.contains(F.lower("p_type"), F.lit("eco")) & (F.col("p_size") == 11))]
    each = [x.select(F.col("p_partkey").alias("id"), F.lit(k).alias("kind")) for k, x in enumerate(found)]
    return each[0].unionAll(each[1]).unionAll(each[2]).groupBy("id").agg(F.min("kind").alias("kind"))


@query("SELECT doc_id, len(text) AS n FROM documents WHERE regexp_matches(text, '\\S') AND source <> 'src3'")
def sign_dump(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S") & (F.col("source") != "src3")).select("doc_id", F.char_length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter({_LN}, lambda x, i: i - 1 IN (0, 2)), '|')) AS digest FROM documents")
def chapter_lines(spark, sf_dir):
    """A chapter's display with a selection of its lines."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: i.isin(0, 2))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(kept, "|")).alias("digest"))


# Names, identifiers, dates


#: DOIs, ISBNs and ISSNs as people write them, good and bad, by the remainder of a key.
_DOIS = ("https://doi.org/10.{}/X", "DOI: 10.{}/x y", "doi:http://dx.doi.org/10.{}/X", "<>", "pending", "10.{}")
_BOOK_NUMBERS = ("978-{}", "0 306 4{}x", "1-{}", "n/a")


def _written(forms, number):
    """The form whose place is the number's remainder, with the number in its gap."""
    cases = None
    for i, form in enumerate(forms):
        before, gap, after = form.partition("{}")
        text = F.concat(F.lit(before), number.cast("string"), F.lit(after)) if gap else F.lit(before)
        cases = F.when(number % len(forms) == i, text) if cases is None else cases.when(number % len(forms) == i, text)
    return cases


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 2) THEN '10.' || p_partkey || '/x' END AS doi,
        CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey BETWEEN 1000000 AND 9999999 THEN '978' || p_partkey END WHEN 1 THEN CASE WHEN p_partkey BETWEEN 1000 AND 9999 THEN '03064' || p_partkey || 'X' END END AS isbn,
        CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey BETWEEN 10000 AND 99999 THEN '978' || p_partkey END WHEN 1 THEN CASE WHEN p_partkey BETWEEN 10 AND 99 THEN '03064' || p_partkey || 'X' END WHEN 2 THEN CASE WHEN p_partkey BETWEEN 1000000 AND 9999999 THEN '1' || p_partkey END END AS issn FROM part""")
def identifiers(spark, sf_dir):
    key = F.col("p_partkey")
    book = _written(_BOOK_NUMBERS, key)
    return read(spark, sf_dir, "part").select("p_partkey", names.doi(F.concat(F.lit(" "), _written(_DOIS, key), F.lit(" "))).alias("doi"), names.isbn(book).alias("isbn"), names.issn(book).alias("issn"))


@query("SELECT p_partkey, string_split(lower(p_name), ' ')[1] || '|' || left(lower(string_split(p_name, ' ')[2]), 1) || 'j' AS name, array_to_string(list_distinct([lower(p_type)]), ' ') AS words FROM part")
def name_keys(spark, sf_dir):
    two = F.split("p_name", " ")
    given = F.concat(F.get(two, F.lit(1)), F.lit(" J."))
    return read(spark, sf_dir, "part").select("p_partkey", names.family_and_initials(F.get(two, F.lit(0)), given).alias("name"), F.array_join(names.title_words(F.concat(F.lit("The "), "p_type", F.lit(" of the "), "p_type")), " ").alias("words"))


#: Titles with numbers at their end or within, and the stem and number that each has; a number of two is put in the gap.
_TITLES = (("texts from ur part {}", "texts from ur", 2), ("royal archives band ii of {}", "royal archives", 2), ("old letters second part fourth", "old letters second", 4), ("archiv fur x heft iv teil {}", "archiv fur x heft iv", 2), ("neue tafeln iiii", "neue tafeln", 4), ("neue tafeln {}", "neue tafeln", 2), ("tafeln {}", None, None), ("partial {}", None, None), ("texts from ur second", None, None))


@query(f"SELECT p_partkey, CASE p_size % {len(_TITLES)} {' '.join(f"WHEN {i} THEN '{stem}'" for i, (_, stem, _) in enumerate(_TITLES) if stem)} END AS stem, CASE p_size % {len(_TITLES)} {' '.join(f'WHEN {i} THEN {n}' for i, (_, _, n) in enumerate(_TITLES) if n)} END AS part FROM part")
def series_parts(spark, sf_dir):
    title = F.get(F.array(*[F.lit(t.format(2)) for t, _, _ in _TITLES]), F.col("p_size") % len(_TITLES))
    return read(spark, sf_dir, "part").select("p_partkey", names.series_part(title).alias("s")).select("p_partkey", F.col("s.stem").alias("stem"), F.col("s.number").alias("part"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS value, o_orderkey % 2 = 0 AS broken, o_orderkey % 3 = 0 AS uncertain, o_orderkey % 5 = 0 AS emended FROM orders")
def damaged_dates(spark, sf_dir):
    key = F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    raw = F.concat(F.when(key % 2 == 0, "[").otherwise(""), F.when(key % 5 == 0, "<").otherwise(""), year, F.when(key % 3 == 0, "?").otherwise(""), F.when(key % 5 == 0, ">").otherwise(""), F.when(key % 2 == 0, "]").otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", names.dated(raw).alias("d")).select("o_orderkey", "d.*")


@query("SELECT event_id, CAST(ts AS DATE) = DATE '2024-01-01' AS that_day, ts + INTERVAL 600 SECOND > TIMESTAMP '2024-01-01 12:00:00' AS alive FROM events")
def dates_and_ages(spark, sf_dir):
    """A day parsed from its ISO form, and whether what was made is still in its time to live."""
    day = F.to_date(F.date_format("ts", "yyyy-MM-dd"))
    return read(spark, sf_dir, "events").select("event_id", (day == F.to_date(F.lit("2024-01-01"))).alias("that_day"), (F.col("ts") + F.expr("INTERVAL 600 SECOND") > F.to_timestamp(F.lit("2024-01-01 12:00:00"))).alias("alive"))


@query("SELECT p_partkey, p_name || '#' || p_size AS plain, CAST(p_size AS VARCHAR) AS digits FROM part")
def flags_stripped(spark, sf_dir):
    marked = F.concat(F.lit("*"), "p_name", F.lit("^?!"))
    low = F.translate(F.col("p_size").cast("string"), "0123456789", "₀₁₂₃₄₅₆₇₈₉")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(names.unmarked(marked), F.lit("#"), F.col("p_size").cast("string")).alias("plain"), names.from_subscript(low).alias("digits"))


@query("SELECT source, count(*) AS lines, min(doc_id) AS first, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels FROM documents GROUP BY source")
def extant_lines(spark, sf_dir):
    """For each witness how many lines it has, and under which labels."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("lines"), F.min("doc_id").alias("first"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("labels"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id = 5)")
def same_chapter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    mine = docs.join(docs.where("doc_id = 5").select("source"), "source", "left_semi")
    return mine.select("doc_id", "lang", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("n"))
