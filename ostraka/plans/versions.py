"""Queries of alignment, of two versions of a text, and of listings and manuscripts; SQL where it can say them, else tests/test_alignment.py has the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs, text
from ..operators import alignment, lookups
from .base import query, read


@query(None)
def align_scores(spark, sf_dir):
    """Benchmark passages of any length as fragments, turns of conversations as manuscripts."""
    signs = F.lower("text").alias("signs")
    return alignment.align(read(spark, sf_dir, "benchmark").select("item_id", signs), read(spark, sf_dir, "conversations").select("conv_id", "turn", signs), "item_id", ["conv_id", "turn"], max_lines=None, min_score=30)


@query(None)
def align_report(spark, sf_dir):
    """The same pairs traced: score, percentages, and where in the passage the alignment begins and ends."""
    signs = F.lower("text").alias("signs")
    found = alignment.align(read(spark, sf_dir, "benchmark").select("item_id", signs), read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", signs), "item_id", ["conv_id", "turn", "role"], max_lines=None, min_score=30, traced=True)
    return found.select("fragment", "conv_id", "turn", "role", "score", "identity", "similarity", "begins", "ends", F.size("alignment").alias("columns"))


def _versions(spark, sf_dir):
    """Words of a turn, and what an edit made of them: every fifth word is another, every seventh is gone, and one is added."""
    old = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", old.alias("old"))
    edit = F.filter(F.transform("old", lambda w, i: F.when(i % 7 == 6, F.lit(None)).when(i % 5 == 4, F.concat(w, F.lit("-e"))).otherwise(w)), lambda w: w.isNotNull())
    return turns.withColumn("new", F.concat(edit, text.strings(["|"])))


@query(None)
def version_map(spark, sf_dir):
    """For each old word its place among the new ones."""
    mapped = diffs.token_map(F.col("old"), F.col("new"), F.transform("new", lambda w: w != "|"))
    return _versions(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(mapped, lambda i: i.cast("string")), ",", "-").alias("places"))


@query(None)
def version_merge(spark, sf_dir):
    """The new words with the notes of the old ones, an edited word with those of the word that it stands for."""
    noted = lambda words, note: F.transform(words, lambda w, i: F.struct(w.alias("word"), note(i).alias("note")))
    old = noted(F.col("old"), lambda i: i.cast("string"))
    new = noted(F.col("new"), lambda _: F.lit(None).cast("string"))
    keep_note = lambda a, b: F.struct(b["word"].alias("word"), a["note"].alias("note"))
    merged = _versions(spark, sf_dir).select("conv_id", "turn", text.once(diffs.merged(old, new, lambda e: e["word"], keep_note)).alias("m"))
    return merged.select("conv_id", "turn", F.array_join("m.word", " ").alias("words"), F.array_join("m.note", ",", "-").alias("notes"))


@query(None)
def name_ratio(spark, sf_dir):
    """How alike the two words of a part's name are."""
    words = F.split("p_name", " ")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(diffs.ratio(F.get(words, F.lit(0)), F.get(words, F.lit(1))), 6).alias("ratio"))


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '\\S') AND lang <> 'xx'")
def text_dump(spark, sf_dir):
    """What has signs at all, without one category."""
    return read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S") & (F.col("lang") != "xx")).select("doc_id", "lang")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE len(string_split(text, chr(10))) > 0")
def transliterated(spark, sf_dir):
    """Documents with lines, by id: a sort over ranges of ids, no limit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.where(F.size("lines") > 0).select("doc_id", F.size("lines").cast("long").alias("n_lines")).orderBy("doc_id")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, p_brand, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def manuscripts_joined(spark, sf_dir):
    """An order's items as a chapter's manuscripts, taken out of the nested row, each with its two records."""
    nested = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("items"))
    flat = nested.select("l_orderkey", F.inline("items"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    found = lookups.attach(lookups.attach(flat, part, ["l_partkey"], "part"), supplier, ["l_suppkey"], "supplier")
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", "part.p_brand", "supplier.s_name")
