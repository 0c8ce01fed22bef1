"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, html, packing, phrases, pieces, quality, sharding, simhash, spans, suffix, topk, urls, vectorcodes
from .common import small_batches, table

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_text", "p_meta", "score", "keep")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 8192)
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 8192)
    return topk.inner_product_topk(table(spark, sf_dir, "embeddings"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spans.remove_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.check(table(spark, sf_dir, "documents"), model)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 8192)
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_exact_topk": op7_exact_topk,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_html_main_text": op9_html_main_text,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_sharding": op13_sharding,
}

#: The table of the usual CRC-32, from its polynomial.
_CRC = "CAST([" + ", ".join(str(reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(8), byte)) for byte in range(256)) + "] AS UINTEGER[])"

#: The four rounds and the last assignment of op12, one after the other.
_ROUNDS = "".join(
    f"""
             a{k} AS MATERIALIZED (SELECT row, p, min({{d: d, e: e}}) AS m FROM (SELECT row, x.p, e, sum((x.w - b.w) * (x.w - b.w)) AS d FROM x JOIN b{k} b ON b.p = x.p AND b.i = x.i GROUP BY ALL) GROUP BY ALL),"""
    + (
        f"""
             b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, CASE WHEN n IS NULL THEN b.w ELSE (s - (s % n + n) % n) // n END AS w FROM b{k} b
                   LEFT JOIN (SELECT a.p, a.m.e AS e, i, sum(w) AS s, count(*) AS n FROM a{k} a JOIN x ON x.row = a.row AND x.p = a.p GROUP BY ALL) t ON t.p = b.p AND t.e = b.e AND t.i = b.i),"""
        if k < 4
        else ""
    )
    for k in range(5)
)

ORACLE_SQL: dict[str, str] = {
    "op7_exact_topk": """
        WITH u AS (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE vec_id IS NOT NULL),
             v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM u
                   WHERE vec_id NOT IN (SELECT vec_id FROM u WHERE x IS NULL OR NOT isfinite(x))),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
                   FROM v q JOIN v c ON c.i = q.i AND q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_phrase_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]') AS pieces FROM documents WHERE text IS NOT NULL),
             u AS (SELECT lang, unnest(pieces) AS piece FROM p),
             w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM u),
             g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
             f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
             t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
             h AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k > 1),
             c AS (SELECT h.lang, h.k, h.phrase, a, l.f AS l, r.f AS r, h.c, (2000000 * a::HUGEINT) // (l.f + r.f) AS score FROM h
                   JOIN f l ON l.lang = h.lang AND l.phrase = array_to_string(w[1 : h.c], ' ') JOIN f r ON r.lang = h.lang AND r.phrase = array_to_string(w[h.c + 1 :], ' ')),
             s AS (SELECT lang, k, phrase, a, min({score: score, c: c, l: l, r: r}) AS m FROM c GROUP BY lang, k, phrase, a),
             i AS (SELECT DISTINCT lang, f, array_to_string(w[b : b + m - 1], ' ') AS phrase FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest([2, 3]) AS m FROM f WHERE k > 2), (SELECT unnest([1, 2, 3]) AS b) WHERE m < k AND b + m - 1 <= k),
             x AS (SELECT lang, phrase, max(f) AS f FROM i GROUP BY ALL),
             o AS (SELECT s.lang, s.phrase, a, m.l AS l, m.r AS r, m.score AS score, row_number() OVER (PARTITION BY s.lang ORDER BY m.score DESC, a DESC, s.phrase) AS rank
                   FROM s LEFT JOIN x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.f IS NULL OR 100 * x.f::HUGEINT < 80 * a::HUGEINT)
        SELECT o.lang, rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""",
    "op12_vector_codes": f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             x AS MATERIALIZED (SELECT row, (j * 4) // len(w) AS p, j % (len(w) // 4) AS i, w[j + 1] AS w FROM (SELECT row, w, unnest(range(len(w))) AS j FROM v)),
             b0 AS MATERIALIZED (SELECT p, row AS e, i, CAST(w AS HUGEINT) AS w FROM x WHERE row < 256),{_ROUNDS}
             c AS (SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY row),
             h AS (SELECT sha256(string_agg(CAST(w AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c ON c.row = v.row, h""",
    "op13_sharding": f"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS UINTEGER)) AS bytes FROM documents),
             t AS (SELECT i, doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes), lambda c, x: xor(c >> 8, {_CRC}[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM d),
             l AS (SELECT i, s, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 13) AS BIGINT) * 32 - s AS lot FROM d, range(17) r(s)),
             w AS (SELECT i, CAST(arg_max(s, lot) FILTER (s < 16) AS INTEGER) AS shard, CAST(arg_max(s, lot) AS INTEGER) AS grown_shard FROM l GROUP BY i)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM t JOIN w ON w.i = t.i""",
}
