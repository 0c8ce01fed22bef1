"""Repeated byte strings, found by two-stage suffix sorting of the texts around repeated anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, materialize, only, release

#: Bytes of the grams that anchors are chosen among, windows looked at together, bytes of texts sorted together.
GRAM, CHUNK, BLOCK = 40, 1 << 18, 1 << 19
#: Contexts of one anchor that are sorted together; the windows of more are compared by 128-bit hashes instead.
CROWD = 4096

_RNG = np.random.default_rng(11)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS:
        top = CHUNK + (1 << 14)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(top, _STEP, np.uint64), dtype=np.uint64)])
            _POWERS["down"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(top, pow(_STEP, -1, 1 << 64), np.uint64), dtype=np.uint64)])
    return _POWERS["up"][:n], _POWERS["down"][:n]


def anchored(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of `length` bytes that share an anchor: (first window of the chunk, anchors' hashes, starts, counts).

    A window's anchor is the gram in it of the smallest hash, the leftmost of equals; so equal windows have equal anchors at
    equal places, wherever they stand. Grams are at most half a window, else nearly every window would be a run of its own.
    """
    gram = min(GRAM, max(1, length // 2))
    span = length - gram + 1
    for first in range(0, len(data) - length + 1, CHUNK):
        part = data[first : first + CHUNK + length - 1]
        up, down = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[part] * up[: len(part)], dtype=np.uint64)])
            h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        mask = np.uint64((1 << 19) - 1)
        keys = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(keys) // span)
        padded = np.full(rows * span, ~np.uint64(0))
        padded[: len(keys)] = keys
        padded = padded.reshape(rows, span)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        at = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & mask).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        yield first, h[at[starts]].view(np.int64), starts, np.diff(np.concatenate([starts, [windows]]))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes in order of their first `depth` bytes at least, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly; the others are induced by one scan over the buckets of first
    bytes, each bucket with an array operation for each run of equal bytes.
    """
    n = len(text)
    rising, same = np.zeros(n, bool), np.zeros(n, bool)
    rising[:-1], same[:-1] = text[:-1] < text[1:], text[:-1] == text[1:]
    settled = np.where(same, n - 1, np.arange(n))
    smaller = rising[np.minimum.accumulate(settled[::-1])[::-1]]
    data = text.tobytes()
    direct = np.flatnonzero(smaller).tolist()
    slices = [data[p : p + depth] for p in direct]
    direct = np.array(direct, np.int64)[sorted(range(len(direct)), key=slices.__getitem__)] if direct else np.zeros(0, np.int64)
    del slices
    cuts = np.searchsorted(text[direct], np.arange(257))
    queued: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        queued[text[-1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        level, bucket = (np.concatenate(queued[c]) if queued[c] else np.zeros(0, np.int64)), []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == c]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        queued[c] = []
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        order.append(whole)
        before = whole[whole > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        turn = np.argsort(byte, kind="stable")
        before, byte = before[turn], byte[turn]
        edges = np.flatnonzero(np.diff(byte)) + 1
        for group in np.split(before, edges) if len(before) else ():
            queued[text[group[0]]].append(group)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def repeated(pieces: list[bytes], spread: list[tuple[int, int, int]], length: int, apart: bool = False) -> list[np.ndarray]:
    """For each piece: which of its windows of `length` bytes stand elsewhere in the pieces too, or in a piece given more than once.

    spread: how often each piece occurs, and the least and greatest of its owners. apart: only windows of two owners count.
    """
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    offsets = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    starts = np.zeros(len(text), bool)
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    starts[np.arange(len(text)) - offsets[piece_of] < windows[piece_of]] = True
    order = suffix_order(text, length)
    order = order[starts[order]]
    # adjacent common prefixes of at least `length`, eight bytes at a time
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(text) + 1]
    alike = np.arange(len(order) - 1)
    for back in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        alike = alike[words[order[alike] + back] == words[order[alike + 1] + back]]
    if length < 8:
        alike = np.array([i for i in alike if bytes(text[order[i] : order[i] + length]) == bytes(text[order[i + 1] : order[i + 1] + length])], np.int64)
    found = np.zeros(len(text), bool)
    if apart and len(order):
        fresh = np.ones(len(order), bool)
        fresh[alike + 1] = False
        first = np.flatnonzero(fresh)
        low, high = (np.array([x[k] for x in spread], np.int64)[piece_of[order]] for k in (1, 2))
        found[order] = np.repeat(np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first), np.diff([*first, len(order)]))
    elif len(order):
        found[order[alike]] = found[order[alike + 1]] = True
        found |= np.array([x[0] >= 2 for x in spread])[piece_of] & starts
    return [found[o : o + w] for o, w in zip(offsets, windows, strict=True)]


def ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, crowd: int = CROWD, apart: bool = False) -> DataFrame:
    """(doc_id, text_hash, spans): for each text with any, byte ranges [start, end) of strings of `length` bytes that start elsewhere too.

    1. A scan cuts each text's windows into runs that share an anchor, about one for each 80 bytes; only anchors that occur at
       least twice can hold repeated windows. 2. Runs of equal bytes (a context) are counted and kept once; a context that
       occurs twice is repeated as a whole. 3. Contexts whose anchor has several are fetched as bytes, dealt by anchor, and
       sorted in blocks by two-stage suffix sorting; windows with a common prefix of `length` with a neighbour are repeated.
       Anchors with over `crowd` contexts are split instead: their windows are grouped by 128-bit hashes, so no group is ever
       gathered. 4. Each occurrence takes the ranges of its context. With `apart`, only strings that stand in two different texts or ids count.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    texts = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys, ctx, row, at, counts = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if len(text) < length:
                    continue
                for first, anchors, starts, n in anchored(np.frombuffer(text, np.uint8), length):
                    starts = starts + first
                    keys.append(anchors)
                    at.append(starts)
                    counts.append(n)
                    row.append(np.full(len(n), i))
                    ctx += [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(starts.tolist(), (starts + n + length - 1).tolist(), strict=True)]
            if keys:
                rows = pa.array(np.concatenate(row))
                yield {"anchor": np.concatenate(keys), "ctx": np.array(ctx, np.uint64).view(np.int64), "doc_id": batch.column(0).take(rows), "text_hash": batch.column(1).take(rows), "start": np.concatenate(at), "n": np.concatenate(counts)}

    runs = in_arrow(texts, cut, f"anchor long, ctx long, doc_id {kind}, text_hash long, start int, n int")
    runs = materialize(runs)
    # what a join looks up is written first: a very common anchor is then split over many tasks by Spark's handling of skewed joins
    often = materialize(runs.groupBy("anchor").count().where("count >= 2").select("anchor"))
    kept = materialize(runs.join(often.hint("merge"), "anchor", "left_semi"))
    release(spark, runs, often)
    owner = F.xxhash64("doc_id", "text_hash")
    twice_over = "low <> high" if apart else "times >= 2"
    contexts = materialize(kept.groupBy("anchor", "ctx").agg(F.count("*").alias("times"), F.min(owner).alias("low"), F.max(owner).alias("high"), F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("rep")))
    crowds = materialize(contexts.groupBy("anchor").agg(F.count("*").alias("crowd")).where("crowd >= 2"))
    mixed = contexts.join(crowds.hint("merge"), "anchor").select("anchor", "ctx", "times", "low", "high", "crowd", "rep.*")
    wanted = mixed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "ctx", "times", "low", "high", "crowd", "start", "n")).alias("items"))
    wanted = materialize(wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "items"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for text, items in zip(batch.column(0), batch.column(1), strict=True):
                text, items = text.as_py(), items.values
                start, n = items.field("start").to_numpy(), items.field("n").to_numpy()
                pieces = [text[s : s + k + length - 1] for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield {name: items.field(name) for name in ("anchor", "ctx", "times", "low", "high", "crowd")} | {"piece": pieces}

    pieces = in_arrow(texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).select("text", "items"), fetch, "anchor long, ctx long, times long, low long, high long, crowd long, piece binary")
    pieces = materialize(pieces)
    release(spark, wanted, crowds)

    def marked(rows: list[tuple]) -> dict:
        out: dict = {"anchor": [], "ctx": [], "lo": [], "hi": []}
        for (anchor, ctx, *_), mask in zip(rows, repeated([r[-1] for r in rows], [r[2:5] for r in rows], length, apart), strict=True):
            for lo, hi in zip(*ranges(mask), strict=True):
                for name, x in (("anchor", anchor), ("ctx", ctx), ("lo", lo), ("hi", hi)):
                    out[name].append(x)
        return out

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield marked(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield marked(held)

    few = pieces.where(F.col("crowd") <= crowd).drop("crowd")
    by_sort = in_arrow(few.repartition("anchor").sortWithinPartitions("anchor"), sort, "anchor long, ctx long, lo int, hi int")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for anchor, ctx, times, low, high, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(piece) - length + 1
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(n)), "<i8").reshape(n, 2)
                yield {"anchor": np.full(n, anchor), "ctx": np.full(n, ctx), "times": np.full(n, times), "low": np.full(n, low), "high": np.full(n, high), "at": np.arange(n), "h1": digests[:, 0], "h2": digests[:, 1]}

    many = in_arrow(pieces.where(F.col("crowd") > crowd).drop("crowd"), hashes, "anchor long, ctx long, times long, low long, high long, at int, h1 long, h2 long")
    twice = many.groupBy("h1", "h2").agg(F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high")).where(twice_over).select("h1", "h2")
    by_hash = many.join(materialize(twice).hint("merge"), ["h1", "h2"]).select("anchor", "ctx", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    whole = contexts.where(twice_over).select("anchor", "ctx", F.lit(0).alias("lo"), F.col("rep.n").alias("hi"))
    parts = materialize(whole.unionAll(by_sort).unionAll(by_hash).groupBy("anchor", "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("parts")))
    release(spark, pieces, contexts)
    spans = kept.join(parts.hint("merge"), ["anchor", "ctx"]).select("doc_id", "text_hash", "start", F.explode("parts").alias("p"))
    spans = spans.select("doc_id", "text_hash", F.struct((F.col("start") + F.col("p.lo")).alias("start"), (F.col("start") + F.col("p.hi") + (length - 1)).alias("end")).alias("span"))
    found = materialize(spans.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")))
    release(spark, kept, parts)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, crowd: int = CROWD) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, spans (maximal removed runs [start, end) of bytes), kept (the other bytes).

    Removes each byte covered by a string of `length` bytes that also starts anywhere else, same document included; overlaps
    count, and strings are judged on the input. Texts are UTF-8 bytes; a null text is empty, and one shorter than `length` stays
    whole. Null and repeated ids are carried; a repeated row is another document, so its text repeats. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    found = repeated_spans(docs, id_col, text_col, length, crowd).select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    texts = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    release(docs.sparkSession)
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                sizes.append(len(text))
                runs: list[list[int]] = []
                if own.is_valid:
                    values = own.values
                    start, end = values.field("start").to_numpy(), values.field("end").to_numpy()
                    for i in np.argsort(start, kind="stable").tolist():
                        if runs and start[i] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], int(end[i]))
                        else:
                            runs.append([int(start[i]), int(end[i])])
                spans.append([{"start": a, "end": b} for a, b in runs])
                last, left = 0, []
                for a, b in runs:
                    left.append(text[last:a])
                    last = b
                kept.append(b"".join([*left, text[last:]]))
            yield {"doc_id": batch.column(0), "n_bytes": sizes, "spans": spans, "kept": kept}

    return in_arrow(joined, strip, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
