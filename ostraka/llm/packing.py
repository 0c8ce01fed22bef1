"""Best-fit packing of tokenised documents: a linear grouping scheme over the histogram of lengths."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Memory, in_arrow, materialize, only

#: Texts whose new words are encoded together, and words in one string.
TOGETHER, STRUNG = 32, 16

_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
#: Texts of only these characters are cut into words here; any others go to the tokenizer whole.
_PLAIN = re.compile(f"[\\t\\n\\r -~{_LETTERS}¡-©«-±´¶-¸»¿×÷]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: A number sign, and so a word by itself, that no plain text has.
_BETWEEN = "²"


class Words:
    """A tokenizer that remembers the ids (little-endian 32-bit bytes) of words and of what stands between white space; byte-pair merges never cross words, so a text's ids are those of its words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.between,) = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.words, self.chunks = Memory(self.strung), Memory(self.parted)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def strung(self, words: list[str]) -> list[bytes]:
        """The ids of plain words, many of which are strung together for one call."""
        out = []
        strings = [f" {_BETWEEN} ".join([*words[lo : lo + STRUNG], ""]) for lo in range(0, len(words), STRUNG)]
        for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False):
            ids, at = np.array(e.ids, "<u4"), 0
            raw = ids.tobytes()
            for end in (4 * np.flatnonzero(ids == self.between)).tolist():
                out.append(raw[at:end])
                at = end + 4
        return out

    def parted(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without white space: those of their words."""
        cut = list(map(_WORD.findall, chunks))
        known = self.words.of(set().union(*cut)).__getitem__
        return [b"".join(map(known, words)) for words in cut]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the tokenizer gives them for the whole text."""
        cut: list[list[str] | None] = []
        for text in texts:
            odd = not _PLAIN.fullmatch(text) or "İ" in text or any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", text)
            cut.append(None if odd else text.lower().split())
        known = self.chunks.of(set().union(*(c for c in cut if c is not None))).__getitem__
        return [self.whole([text])[0] if c is None else b"".join(map(known, c)) for text, c in zip(texts, cut, strict=True)]


_OPEN: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One per worker and file."""
    if path not in _OPEN:
        _OPEN[path] = Words(path)
    return _OPEN[path]


# The plan, made from the counts of lengths alone: at most `capacity` numbers, however many documents there are


def richest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that items of these sizes and prices can be worth in a bin, and how many of each: an unbounded knapsack, a size at a time."""
    worth, chosen = np.zeros(capacity + 1), []
    for size, price in zip(sizes.tolist(), prices.tolist(), strict=True):
        best, times = worth.copy(), np.zeros(capacity + 1, np.int16)
        for m in range(1, capacity // size + 1) if price > 0 else ():
            with_m = worth[: capacity + 1 - m * size] + m * price
            up = with_m > best[m * size :] + 1e-12
            best[m * size :][up], times[m * size :][up] = with_m[up], m
        worth = best
        chosen.append(times)
    column, room = np.zeros(len(sizes)), capacity
    for k in range(len(sizes) - 1, -1, -1):
        column[k] = chosen[k][room]
        room -= int(column[k]) * int(sizes[k])
    return float(worth[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(how many of each size in a bin, bins) of the linear relaxation, by column generation: a knapsack prices new configurations."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        amounts, prices = np.linalg.solve(basis, demand), np.linalg.solve(basis.T, np.ones(k))
        worth, column = richest(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column)
        steps = np.where(way > 1e-9, amounts / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(steps.argmin())] = column
    return [(basis[:, i].astype(int), amounts[i]) for i in range(k) if amounts[i] > 1e-9]


def plan(counts: np.ndarray, capacity: int, groups: int = 24, smalls: Sequence[int] = (16, 8, 5, 4, 3, 2)) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, how many such bins) for counts[length] documents of each length.

    What counts as small is the capacity over one of `smalls`; the scheme is run with each and the plan of fewest bins stands, since
    rounding up pays only as far as small documents fill what it leaves.
    """
    if not counts[:capacity].any():
        return grouped(counts, capacity, groups, 0)
    return min((grouped(counts, capacity, groups, capacity // s) for s in smalls), key=lambda bins: sum(n for _, n in bins))


def grouped(counts: np.ndarray, capacity: int, groups: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    """The linear grouping scheme.

    Lengths over `small` are rounded up within groups of equal cardinality; few-size configurations are optimised for the
    rounded lengths and used whole bins at a time; actual lengths, longest first, take the places of their group. What is left
    over and the small lengths are then put, longest first, where they fit best.
    """
    left = counts.astype(np.int64).copy()
    bins: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    free: dict[int, list[list]] = {}
    levels: list[int] = []

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if n:
            if room not in free:
                free[room] = []
                insort(levels, room)
            free[room].append([pattern, n])

    total = int(left[small + 1 :].sum())
    if total:
        share, classes, own, held = -(-total // groups), [], [], 0
        for length in np.flatnonzero(left)[::-1].tolist():
            n = int(left[length]) if length > small else 0
            while n:
                take = min(n, share - held)
                own.append([length, take])
                held, n = held + take, n - take
                if held == share:
                    classes.append(own)
                    own, held = [], 0
        classes += [own] if own else []
        same: dict[int, list[list[int]]] = {}
        for own in classes:
            same.setdefault(own[0][0], []).extend(own)
        sizes = np.array(list(same))
        queues = list(same.values())
        for config, amount in configurations(sizes, np.array([float(sum(n for _, n in q)) for q in queues]), capacity):
            whole = int(amount + 1e-6)
            places = [k for k in range(len(sizes)) for _ in range(config[k])]
            while whole and places:
                heads, asked = [], {}
                for k in places:
                    asked[k] = asked.get(k, 0) + 1
                ready = [k for k in asked if queues[k]]
                if len(ready) < len(asked):
                    break
                # as many equal bins as the first length of each group allows
                n = min(whole, *(queues[k][0][1] // asked[k] for k in asked))
                if n:
                    heads = [queues[k][0][0] for k in places]
                    for k in asked:
                        queues[k][0][1] -= n * asked[k]
                else:  # one bin across the end of a length
                    n = 1
                    if any(sum(c for _, c in queues[k]) < asked[k] for k in asked):
                        break
                    for k in places:
                        while not queues[k][0][1]:
                            queues[k].pop(0)
                        heads.append(queues[k][0][0])
                        queues[k][0][1] -= 1
                for k in asked:
                    while queues[k] and not queues[k][0][1]:
                        queues[k].pop(0)
                for length in heads:
                    left[length] -= n
                put(tuple(heads), capacity - sum(heads), n)
                whole -= n
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(levels, length)
            if at == len(levels):
                each = capacity // length
                put((length,) * each, capacity - each * length, n // each)
                if n % each:
                    put((length,) * (n % each), capacity - n % each * length, 1)
                break
            room = levels[at]
            pattern, there = free[room].pop()
            if not free[room]:
                del free[room], levels[at]
            each = room // length
            full = min(there, n // each)
            if full:
                put(pattern + (length,) * each, room - each * length, full)
                n -= full * each
                there -= full
            if there and n and n < each:
                put(pattern + (length,) * n, room - n * length, 1)
                n, there = 0, there - 1
            put(pattern, room, there)
    return bins + [(pattern, n) for runs in free.values() for pattern, n in runs]


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the documents of each length go: those of ranks [first, next) take `offset` in sequences sequence, sequence + 1, ..."""
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int]] = []
    sequence = 0
    for pattern, n in bins:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "sequence", "offset"))}


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words, end = words_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(ids + end for lo in range(0, batch.num_rows, TOGETHER) for ids in words.ids([t or "" for t in batch.column(1).slice(lo, TOGETHER).to_pylist()])):
                for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return in_arrow(only(docs, id_col, text_col), run, f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", groups: int = 24) -> DataFrame:
    """A row for each piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset (gapless from 0).

    A document's ids are the tokenizer's and then `end_id`; only documents of more than `capacity` ids are cut. A null or empty
    text is the one id `end_id`. Null and repeated ids are carried, each row a document of its own; an empty table gives no rows.

    The driver sees only how many pieces there are of each length, at most `capacity` numbers, and plans bins as runs of equal
    patterns; pieces are numbered within their length (in salted parts, so that a common length is not one task's) and look up
    their place in the plan, whose size follows the lengths and not the rows.
    """
    pieces = materialize(tokenise(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    at = places(plan(counts, capacity, groups))
    keys = (at["length"] << 44) | at["first"]
    salts = max(16, int(counts.sum()) // 100_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    earlier = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(earlier, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(5).to_numpy()
            slot = np.searchsorted(keys, (batch.column(3).to_numpy() << 44) | rank, "right") - 1
            yield {n: batch.column(i) for i, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": at["sequence"][slot] + rank - at["first"][slot], "offset": at["offset"][slot]}

    return in_arrow(ranked, place, f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
