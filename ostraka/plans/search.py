"""Queries of the search operators over documents, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import patterns, text
from ..operators import filters, matchers
from .base import lines_text, query, read

_L = """L AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_index FROM documents)"""
_T = _L + r""",
     T AS (SELECT * FROM (SELECT doc_id, line_index, unnest(regexp_split_to_array(lower(line), '[^\p{L}]+')) AS token,
             unnest(generate_series(1, len(regexp_split_to_array(lower(line), '[^\p{L}]+')))) AS pos FROM L) WHERE token <> '')"""
_OUT = "SELECT doc_id, CAST(count(*) AS INTEGER) AS match_count, string_agg(CAST(line_index AS VARCHAR), ',' ORDER BY line_index) AS matching_lines FROM M GROUP BY doc_id"


def _docs(spark: SparkSession, sf_dir: str, words: Sequence[str] = (), signs: bool = False) -> DataFrame:
    """Documents as token lines, if they hold one of the words at all, or as sign lines, or as both; each is computed once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    if words:
        docs = docs.where(text.holds(F.col("text"), words)).select("*", text.once(text.token_lines(F.col("text"), words)).alias("lines"))
    if signs:
        docs = docs.select("*", text.once(text.sign_lines(F.col("text"))).alias("sign_lines"))
    return docs.drop("text")


@query(f"""WITH {_T}, D AS (SELECT doc_id FROM T WHERE token IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT token) = 2),
     M AS (SELECT DISTINCT doc_id, line_index FROM T JOIN D USING (doc_id) WHERE token IN ('the', 'and')) {_OUT}""")
def lemma_and(spark, sf_dir):
    return lines_text(matchers.lemma_and(_docs(spark, sf_dir, ["the", "and"]), ["the", "and"]))


@query(f"WITH {_T}, M AS (SELECT DISTINCT doc_id, line_index FROM T WHERE token IN ('tion', 'und', 'que')) {_OUT}")
def lemma_or(spark, sf_dir):
    return lines_text(matchers.lemma_or(_docs(spark, sf_dir, ["tion", "und", "que"]), ["tion", "und", "que"]))


@query(f"WITH {_T}, M AS (SELECT doc_id, line_index FROM T WHERE token IN ('the', 'of') GROUP BY doc_id, line_index HAVING count(DISTINCT token) = 2) {_OUT}")
def lemma_line(spark, sf_dir):
    return lines_text(matchers.lemma_line(_docs(spark, sf_dir, ["the", "of"]), ["the", "of"]))


@query(f"""WITH {_T}, M AS (SELECT DISTINCT a.doc_id, a.line_index FROM T a JOIN T b ON b.doc_id = a.doc_id AND b.line_index = a.line_index AND b.pos = a.pos + 1
     WHERE a.token = 'of' AND b.token = 'the') {_OUT}""")
def lemma_phrase(spark, sf_dir):
    return lines_text(matchers.lemma_phrase(_docs(spark, sf_dir, ["of", "the"]), ["of", "the"]))


@query(rf"WITH {_L}, M AS (SELECT doc_id, line_index FROM L WHERE regexp_matches(lower(line), '(^|[|\s])(\S+/)*of the($|[\s/])')) {_OUT}")
def sign_single(spark, sf_dir):
    return lines_text(matchers.signs(_docs(spark, sf_dir, signs=True), "of the"))


@query(rf"""WITH {_L}, P AS (SELECT doc_id, line_index, regexp_matches(lower(line), '(^|[|\s])(\S+/)*the($|[\s/])') AS a,
        regexp_matches(lower(line), '(^|[|\s])(\S+/)*of($|[\s/])') AS b FROM L),
     S AS (SELECT x.doc_id, x.line_index AS i FROM P x JOIN P y ON y.doc_id = x.doc_id AND y.line_index = x.line_index + 1 WHERE x.a AND y.b)
     SELECT doc_id, CAST(count(*) AS INTEGER) AS match_count, string_agg(i || ',' || (i + 1), ',' ORDER BY i) AS matching_lines FROM S GROUP BY doc_id""")
def sign_multi(spark, sf_dir):
    return lines_text(matchers.signs(_docs(spark, sf_dir, signs=True), "the\nof"))


@query(rf"""WITH {_T}, A AS (SELECT DISTINCT doc_id, line_index FROM T WHERE token = 'is'),
     B AS (SELECT doc_id, line_index FROM L WHERE regexp_matches(lower(line), '(^|[|\s])(\S+/)*in \S+ of($|[\s/])')),
     M AS (SELECT * FROM (SELECT * FROM A UNION SELECT * FROM B) WHERE doc_id IN (SELECT doc_id FROM A) AND doc_id IN (SELECT doc_id FROM B)) {_OUT}""")
def lemma_and_sign(spark, sf_dir):
    return lines_text(matchers.both(_docs(spark, sf_dir, ["is"], signs=True), ["is"], "in ? of"))


@query("SELECT doc_id, 0 AS match_count, '' AS matching_lines FROM documents")
def no_matcher(spark, sf_dir):
    return lines_text(matchers.everything(_docs(spark, sf_dir)))


@query(f"WITH {_T}, M AS (SELECT DISTINCT doc_id, line_index FROM T WHERE token = 'the') SELECT * FROM ({_OUT}) ORDER BY match_count DESC, doc_id LIMIT 30 OFFSET 30")
def search_page(spark, sf_dir):
    first, _ = matchers.page(matchers.lemma_or(_docs(spark, sf_dir, ["the"]), ["the"]), [F.desc("match_count"), F.col("doc_id")], 30, 30)
    return lines_text(first)


@query(f"WITH {_T}, M AS (SELECT DISTINCT doc_id, line_index FROM T WHERE token = 'the') SELECT count(DISTINCT doc_id) AS item_count, count(*) AS match_count_total FROM M")
def search_totals(spark, sf_dir):
    return matchers.page(matchers.lemma_or(_docs(spark, sf_dir, ["the"]), ["the"]), [F.col("doc_id")], 30)[1]


def _chapters(spark: SparkSession, sf_dir: str, words: Sequence[str]) -> DataFrame:
    """Lines of documents as chapters (one for each source and language), if they hold one of the words: line index is the document, variant the line."""
    docs = read(spark, sf_dir, "documents").where(text.holds(F.col("text"), words))
    lines = docs.select("source", "lang", F.col("doc_id").alias("line_index"), F.posexplode(F.split("text", "\n")).alias("variant_index", "line")).where(text.holds(F.col("line"), words))
    return lines.select("source", "lang", "line_index", "variant_index", text.once(text.line_tokens(F.col("line"))).alias("words"))


_C = _T + ", W AS (SELECT source, lang, T.doc_id AS line_index, T.line_index AS variant_index, token, pos FROM T JOIN documents USING (doc_id))"
_SUM = "SELECT source, lang, count(*) AS match_count FROM M GROUP BY source, lang"


@query(f"""WITH {_C}, K AS (SELECT source, lang FROM W WHERE token IN ('der', 'und') GROUP BY source, lang HAVING count(DISTINCT token) = 2),
     M AS (SELECT DISTINCT source, lang, line_index, variant_index FROM W JOIN K USING (source, lang) WHERE token IN ('der', 'und')) {_SUM}""")
def corpus_lemma_and(spark, sf_dir):
    keys = ["source", "lang"]
    return matchers.corpus_result(matchers.corpus_lemma(_chapters(spark, sf_dir, ["der", "und"]), ["der", "und"], "and", keys), keys)


@query(f"WITH {_C}, M AS (SELECT DISTINCT source, lang, line_index, variant_index FROM W WHERE token IN ('la', 'der')) {_SUM}")
def corpus_lemma_or(spark, sf_dir):
    keys = ["source", "lang"]
    return matchers.corpus_result(matchers.corpus_lemma(_chapters(spark, sf_dir, ["la", "der"]), ["la", "der"], "or", keys), keys)


@query(f"""WITH {_C}, M AS (SELECT source, lang, line_index, variant_index FROM W WHERE token IN ('la', 'de') GROUP BY ALL HAVING count(DISTINCT token) = 2) {_SUM}""")
def corpus_lemma_phrase(spark, sf_dir):
    keys = ["source", "lang"]
    return matchers.corpus_result(matchers.corpus_lemma(_chapters(spark, sf_dir, ["la", "de"]), ["la", "de"], "phrase", keys), keys)


@query(f"""WITH {_C}, M AS (SELECT DISTINCT a.source, a.lang, a.line_index, a.variant_index FROM W a JOIN W b
     ON b.line_index = a.line_index AND b.variant_index = a.variant_index AND b.pos = a.pos + 1 WHERE a.token = 'de' AND b.token = 'la') {_SUM}""")
def corpus_lemma_phrase_strict(spark, sf_dir):
    keys = ["source", "lang"]
    return matchers.corpus_result(matchers.corpus_lemma(_chapters(spark, sf_dir, ["de", "la"]), ["de", "la"], "phrase", keys, strict=True), keys)


@query(rf"""WITH {_L}, M AS (SELECT source, lang, doc_id AS line_index, line_index AS variant_index FROM L JOIN documents USING (doc_id)
     WHERE regexp_matches(lower(line), '(^|[|\s])(\S+/)*das($|[\s/])')) {_SUM}""")
def corpus_sign_single(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("line_index"), F.posexplode(text.sign_lines(F.col("text"))).alias("variant_index", "line"))
    hits = rows.where(F.col("line").rlike(patterns.sign_line("das"))).select("source", "lang", "line_index", "variant_index")
    return matchers.corpus_result(hits, ["source", "lang"])


@query(rf"""WITH {_C}, A AS (SELECT DISTINCT source, lang, line_index, variant_index FROM W WHERE token = 'das'),
     B AS (SELECT source, lang, doc_id AS line_index, line_index AS variant_index FROM L JOIN documents USING (doc_id) WHERE regexp_matches(lower(line), '(^|[|\s])(\S+/)*von($|[\s/])')),
     M AS (SELECT * FROM (SELECT * FROM A UNION SELECT * FROM B) x WHERE (source, lang) IN (SELECT (source, lang) FROM A) AND (source, lang) IN (SELECT (source, lang) FROM B)) {_SUM}""")
def corpus_both(spark, sf_dir):
    keys = ["source", "lang"]
    lemma = matchers.corpus_lemma(_chapters(spark, sf_dir, ["das"]), ["das"], "and", keys)
    rows = read(spark, sf_dir, "documents").select(*keys, F.col("doc_id").alias("line_index"), F.posexplode(text.sign_lines(F.col("text"))).alias("variant_index", "line"))
    sign = rows.where(F.col("line").rlike(patterns.sign_line("von"))).drop("line")
    union = lemma.unionByName(sign).distinct()
    return matchers.corpus_result(union.join(lemma.select(*keys).distinct(), keys, "left_semi").join(sign.select(*keys).distinct(), keys, "left_semi"), keys)


@query(f"WITH {_L} SELECT doc_id, line_index FROM L WHERE regexp_matches(line, '(?i)[sšṣśσSŠṢŚΣ][hḫḥHḪḤʕʾʿ][aāâáàäαAĀÂÁÀÄΑ][tṭτTṬΤ]\\S*[rřρRŘΡ][eēêéèEĒÊÉÈ]')")
def collated_lines(spark, sf_dir):
    return text.lines(read(spark, sf_dir, "documents")).where(F.col("line").rlike(patterns.collated("shat*re"))).select("doc_id", "line_index")


# Filters: a document's source is its scope, genre path and site, by rule


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR source = 'src3'")
def filter_scope(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scopes = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("source"))
    return docs.where(filters.visible(scopes, ["src3"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src7' OR (source = 'src5' AND doc_id = 5)")
def filter_number(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    parts = (F.col("source"), F.col("doc_id").cast("string"), F.lit(""))
    return docs.where(filters.number_is("src7.*", *parts) | filters.number_is("src5.5", *parts)).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_type = 'LARGE' AND list_contains(string_split(p_name, ' '), 'gizmo')")
def filter_genre_path(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.where(filters.genre_has(F.array(F.array("p_type"), F.split("p_name", " ")), "LARGE:gizmo")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE string_split(p_name, ' ')[1] = 'old' AND string_split(p_name, ' ')[2] = 'anvil'")
def filter_genre_position(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.where(filters.genre_at(F.array(F.array("p_type"), F.split("p_name", " ")), "old:anvil")).select("p_partkey")


@query("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' OR n_name = 'EUROPE'")
def filter_hierarchy(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")).unionAll(
        nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("N"), "n_nationkey"), "n_name", "r_name")
    )
    customer = read(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return filters.within_site(customer, "n_name", places, "EUROPE").select("c_custkey")


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey % 50 = 7 AND CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) = '16'""")
def filter_reference(spark, sf_dir):
    refs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("b"), F.col("l_partkey") % 50).alias("id"), F.col("l_quantity").cast("int").cast("string").alias("pages"))).alias("refs"))
    return refs.where(filters.cites(F.col("refs"), "b7", "16")).select("l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1990 AND year(o_orderdate) < 2000")
def year_range(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(filters.year_range(F.year("o_orderdate"), "199")).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey * 3.0 BETWEEN 36.0 - 2000 / 111.0 AND 36.0 + 2000 / 111.0 AND s_acctbal / 100 BETWEEN 40.0 - 2000 / (111 * cos(radians(36.0))) AND 40.0 + 2000 / (111 * cos(radians(36.0)))")
def bounding_box(spark, sf_dir):
    return read(spark, sf_dir, "supplier").where(filters.near(F.col("s_nationkey") * 3.0, F.col("s_acctbal") / 100, (36.0, 40.0), 2000)).select("s_suppkey")


@query("SELECT doc_id FROM documents WHERE starts_with(strip_accents(lower(text)), 'ere')")
def prefix_collated(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(filters.starts_with(F.array("text"), "Ère")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_name IN (SELECT string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] FROM part WHERE p_partkey = 10)")
def split_candidates(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    phrase = part.where("p_partkey = 10").first()["p_name"]
    halves = part.select("p_partkey", F.get(F.split("p_name", " "), F.lit(0)).alias("text"), F.get(F.split("p_name", " "), F.lit(1)).alias("number"))
    # as many pairs as the phrase has words
    return halves.join(F.broadcast(filters.splits(spark, phrase)), ["text", "number"], "left_semi").select("p_partkey")


@query("SELECT item_id FROM benchmark WHERE length(text) > 0 AND item_id % 4 <> 1")
def covers_all(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.array((F.col("item_id") % 4).cast("string")).alias("need"))
    return rows.where(filters.covers(text.strings(["0", "2", "3"]), F.col("need"))).select("item_id")
