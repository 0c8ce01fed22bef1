"""Substring deduplication by sliding sentence spans."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_block, in_arrow, materialize, release

_END = re.compile(r"[.!?]+[\"'”»)\]]*\s+|\n\s*")


#: Words of a sentence above which it is cut; the fewest words of such a piece; one in so many places, by the hash of the two words before it, is fit for a cut.
LONG, PIECE, ONE_IN = 40, 8, 8

_WORD = re.compile(r"\S+")


def sentences(text: str) -> list[str]:
    """The text in pieces that end after a sentence's end or a line's, white space after it included; joined they are the text.

    A sentence of more than LONG words is cut like by commas, into pieces of at least PIECE words, where the hash of two words
    says so; so a passage is cut alike wherever it stands.
    """
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 2 * LONG:
            at = [m.span() for m in _WORD.finditer(text, a, b)]
            if len(at) > LONG:
                last = 0
                for k in range(PIECE, len(at) - PIECE + 1):
                    if k - last >= PIECE and zlib.crc32(" ".join(text[x:y] for x, y in at[k - 2 : k]).encode("utf-8", "surrogatepass")) % ONE_IN == 0:
                        cuts.append(at[k][0])
                        last = k
    cuts = sorted(cuts)
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def runs(parts: list[str], min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first, count, digest): from each sentence on, and up to each, the fewest consecutive sentences, two at least, that hold `min_words` words.

    They stand for every run of two sentences and `min_words` words or more: if such a run is repeated, so are those of its
    fewest runs that lie within it, and each of its sentences lies in one of them (the one from its first sentence on, or the one up to that sentence).
    """
    words = [p.split() for p in parts]
    own = [i for i, w in enumerate(words) if w]
    plain = [" ".join(words[i]) for i in own]
    counts = [len(words[i]) for i in own]
    found: dict[tuple[int, int], None] = {}
    end = held = 0
    for i in range(len(own)):
        while end < len(own) and (end - i < 2 or held < min_words):
            held += counts[end]
            end += 1
        if end - i >= 2 and held >= min_words:
            found[i, end] = None
        held -= counts[i]
    for k in range(1, len(own)):
        first, held = k, counts[k]
        while first and (first == k or held < min_words):
            first -= 1
            held += counts[first]
        if held >= min_words:
            found[first, k + 1] = None
    for i, end in found:
        yield own[i], own[end - 1] + 1 - own[i], xxhash.xxh3_128_digest("\n".join(plain[i:end]))


def place(doc_id: object, text_hash: int, at: int) -> tuple:
    """What places are ordered by; null ids come first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, text_hash, at)


def spans_of_blocks(columns: list[str], text_at: int, id_at: int, min_words: int, block_bytes: int):
    """Rows (columns, text_hash) as they are, with the number of their block, and behind each block a row for each span in it: its first and its last place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = TaskContext.get().partitionId() << 32
        held, found = 0, {}
        nulls = lambda n: {c: pa.nulls(n) for c in ("h1", "h2", "first_id", "first_hash", "first_at", "last_id", "last_hash", "last_at")}

        def flush() -> Iterator[dict]:
            digests = list(found)
            for lo in range(0, len(digests), 1 << 14):
                some = digests[lo : lo + (1 << 14)]
                halves = np.frombuffer(b"".join(some), "<i8").reshape(-1, 2)
                ends = {f"{end}_{name}": [found[d][e][i] for d in some] for e, end in enumerate(("first", "last")) for i, name in enumerate(("id", "hash", "at"))}
                yield {c: pa.nulls(len(some)) for c in columns} | {"text_hash": pa.nulls(len(some)), "block": np.full(len(some), block), "h1": halves[:, 0], "h2": halves[:, 1]} | ends

        for batch in batches:
            start = 0
            ids, hashes, texts = batch.column(id_at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(text_at).to_pylist()
            for i, text in enumerate(texts):
                for first, _, digest in runs(sentences(text or ""), min_words):
                    here = (ids[i], hashes[i], first)
                    known = found.get(digest)
                    if known is None:
                        found[digest] = (here, here)
                    elif place(*here) < place(*known[0]):
                        found[digest] = (here, known[1])
                    elif place(*here) > place(*known[1]):
                        found[digest] = (known[0], here)
                held += len(text or "")
                if held >= block_bytes or i == len(texts) - 1:
                    rows = batch.slice(start, i + 1 - start)
                    yield {c: rows.column(j) for j, c in enumerate(columns)} | {"text_hash": rows.column(len(columns)), "block": np.full(rows.num_rows, block)} | nulls(rows.num_rows)
                    start = i + 1
                if held >= block_bytes:
                    yield from flush()
                    held, found = 0, {}
                    block += 1
        yield from flush()

    return run


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, block_bytes: int = 1 << 24) -> DataFrame:
    """docs with the text left over, and two more columns: n_sentences, n_removed.

    A span is a run of two or more consecutive sentences that hold `min_words` words (white space counts as one space); runs()
    gives the spans that stand for all. They are hashed to 128 bits and joined globally; the first of equal ones, in order of id,
    hash of the text and place, stays, and each sentence that any other one covers is removed, in the same document too. The rest stays as it is;
    a text without removed sentences is unchanged. Null texts stay null, empty ones and those of one sentence or fewer words have no
    span; null ids come first; rows that repeat both id and text are one document and keep or lose the same sentences. An empty
    table gives no rows.

    Documents are dealt into blocks of about `block_bytes`, as they are read. A block tells each of its spans once, with its first and last place, so a
    span that very many documents share has a row for each block, not for each document. Spans that have two places anywhere go back to the blocks that
    hold more than the first of them, and there the texts are cut again.
    """
    spark = docs.sparkSession
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    kind = docs.schema[id_col].dataType
    place_kind = [("id", kind), ("hash", T.LongType()), ("at", T.IntegerType())]
    fields = [T.StructField(c, f.dataType) for c, f in zip(columns, docs.schema.fields, strict=True)]
    spans = [T.StructField(n, T.LongType()) for n in ("text_hash", "block", "h1", "h2")] + [T.StructField(f"{end}_{n}", k) for end in ("first", "last") for n, k in place_kind]
    text_at, id_at = names.index(text_col), names.index(id_col)
    given = docs.toDF(*columns).withColumn("text_hash", F.xxhash64(columns[text_at]))
    blocks = materialize(in_arrow(given, spans_of_blocks(columns, text_at, id_at, min_words, block_bytes), T.StructType([*fields, *spans])))

    told = blocks.where("h1 is not null").select("block", "h1", "h2", *[F.struct(*[F.col(f"{end}_{n}").alias(n) for n, _ in place_kind]).alias(end) for end in ("first", "last")])
    # half the hash says which spans can occur twice; only those are looked at again
    twice = told.groupBy("h1").agg(F.count("*").alias("times"), F.max(~F.col("first").eqNullSafe(F.col("last"))).alias("within")).where("times >= 2 or within")
    alike = materialize(told.join(materialize(twice.select("h1")).hint("merge"), "h1", "left_semi"))
    ends = alike.groupBy("h1", "h2").agg(F.min("first").alias("__first"), F.max("last").alias("__last")).where(~F.col("__first").eqNullSafe(F.col("__last")))
    back = materialize(alike.join(materialize(ends.select("h1", "h2", "__first")).hint("merge"), ["h1", "h2"]).where(~F.col("last").eqNullSafe(F.col("__first"))).select("block", "h1", "h2", F.col("__first.id").alias("id"), F.col("__first.hash").alias("hash"), F.col("__first.at").alias("at")))
    release(spark, alike)

    def strip(rows: pa.Table, gone: pa.Table) -> dict:
        halves = np.stack([gone.column(c).to_numpy() for c in ("h1", "h2")], axis=1).astype("<i8")
        stays = dict(zip((r.tobytes() for r in halves), zip(*[gone.column(c).to_pylist() for c in ("id", "hash", "at")]), strict=True)) if len(halves) else {}
        texts, totals, removed = [], [], []
        for doc_id, text_hash, text in zip(*[rows.column(c).to_pylist() for c in (columns[id_at], "text_hash", columns[text_at])], strict=True):
            parts = sentences(text or "")
            drop = np.zeros(len(parts), bool)
            for a, n, digest in runs(parts, min_words) if stays else ():
                if stays.get(digest, (doc_id, text_hash, a)) != (doc_id, text_hash, a):
                    drop[a : a + n] = True
            texts.append("".join(p for p, d in zip(parts, drop.tolist(), strict=True) if not d) if drop.any() else text)
            totals.append(len(parts))
            removed.append(int(drop.sum()))
        return {c: rows.column(c) for c in columns} | {columns[text_at]: texts, "n_sentences": totals, "n_removed": removed}

    schema = T.StructType([*fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    found = by_block(blocks.where("h1 is null").select(*columns, "text_hash", "block"), back, strip, schema)
    left = [i for i, n in enumerate(names) if n not in ("n_sentences", "n_removed")]
    return found.select(*[F.col(columns[i]).alias(names[i]) for i in left], "n_sentences", "n_removed")
