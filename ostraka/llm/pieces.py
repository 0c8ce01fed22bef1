"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Memory, in_arrow, only

SPACE = "▁"
#: Longest unit, in bytes, that is encoded along with others.
TOGETHER = 48
#: Log score of a character without a piece, below the least score; it is then written as byte pieces.
PENALTY = 10.0


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a double-array trie: from state s, byte c leads to t = base[s] + c + 1 if check[t] == s; value[t] is the index of the key that ends there, else -1."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    work, lowest, top = [(0, 0, len(order), 0)], 1, 1
    while work:
        state, lo, hi, depth = work.pop()
        children: list[tuple[int, int, int]] = []
        while lo < hi and len(keys[order[lo]]) == depth:
            value[state] = order[lo]
            lo += 1
        while lo < hi:
            c, first = keys[order[lo]][depth], lo
            while lo < hi and keys[order[lo]][depth] == c:
                lo += 1
            children.append((c, first, lo))
        if not children:
            continue
        offsets = np.array([c for c, _, _ in children]) + 1
        # a lone child takes the lowest free cell; several look near the end, where most are free
        while check[lowest] >= 0:
            lowest += 1
        at = lowest - int(offsets[0]) if len(offsets) == 1 else max(0, top - 1024)
        if len(offsets) > 1 or at < 0:
            at = max(at, 0)
            starts = np.arange(at, top + 1)
            fits = (check[starts[:, None] + offsets] < 0).all(axis=1)
            at = int(starts[fits.argmax()])
        base[state] = at
        check[at + offsets] = state
        work += [(at + c + 1, first, last, depth + 1) for c, first, last in children]
        top = max(top, at + int(offsets[-1]) + 1)
        if top + 600 > size:
            base, check, value = (np.concatenate([x, np.full(size, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            size *= 2
    room = np.full(258, -1, np.int32)
    return np.concatenate([base, np.zeros(258, np.int32)]), np.concatenate([check, room]), np.concatenate([value, room])


class Vocabulary:
    """Pieces with log scores, byte pieces and the trie.

    The public file at hand is one of merges: its pieces are ranked, not scored. For such a file a piece of rank r is given the score
    -log(r + 1), which is no trained unigram score.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        texts, scores = [model.id_to_piece(i) for i in plain], np.array([model.get_score(i) for i in plain])
        if set(np.round(scores[scores > -1e8])) == set(scores[scores > -1e8]):
            # unscored pieces of white space rank last
            scores = -np.log1p(np.where(scores > -1e8, -scores, len(scores)))
        self._set(texts, scores.tolist(), plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    @classmethod
    def of(cls, pieces: Iterable[tuple[str, float]]) -> Vocabulary:
        """From (piece, log score) pairs: ids 0 to 255 are the byte pieces."""
        self, pieces = cls.__new__(cls), list(pieces)
        self._set([p for p, _ in pieces], [s for _, s in pieces], list(range(256, 256 + len(pieces))), list(range(256)), 256 + len(pieces))
        return self

    def _set(self, texts: list[str], scores: list[float], ids: list[int], byte_ids: list[int], n: int) -> None:
        self.keys = [t.encode() for t in texts]
        self.base, self.check, self.value = double_array(self.keys)
        self.scores, self.ids = np.array(scores), np.array(ids, np.int32)
        self.bytes = np.array(byte_ids, np.int32)
        self.id_of, self.byte_of = list(ids), list(byte_ids)
        self.unknown = min(scores) - PENALTY
        self.longest = max(map(len, self.keys))
        self.out = [b""] * n
        for i, text in zip(ids, texts, strict=True):
            self.out[i] = text.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.out[i] = bytes([b])
        # where no piece goes on from other text into a space, or over a line's end, every path has a cut
        spaces = all(SPACE not in t.lstrip(SPACE) for t in texts)
        line = "\n" if all("\n" not in t for t in texts) else ""
        self.unit = re.compile((f"{line}|" if line else "") + f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if spaces else r"(?s).+")

    def best_one(self, unit: bytes) -> list[int]:
        """Piece numbers of the best path, -1 for a character without a piece (then its bytes). Of equal paths the one whose last piece is longer, and so on."""
        n, base, check, value, scores = len(unit), self.base, self.check, self.value, self.scores
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -math.inf:
                continue
            state, char = 0, i + 1
            while char < n and unit[char] & 0xC0 == 0x80:
                char += 1
            known = False
            for j in range(i, min(n, i + self.longest)):
                to = int(base[state]) + unit[j] + 1
                if check[to] != state:
                    break
                state = to
                if (v := int(value[state])) >= 0:
                    known = known or j + 1 == char
                    if best[i] + scores[v] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + scores[v], (i, v)
            if not known and best[i] + self.unknown > best[char]:
                best[char], back[char] = best[i] + self.unknown, (i, -1)
        out, at = [], n
        while at:
            i, v = back[at]
            out += [v] if v >= 0 else [-1 - b for b in reversed(unit[i:at])]
            at = i
        return out[::-1]

    def best_many(self, units: list[bytes]) -> list[list[int]]:
        """best_one for many short units at once: the trie is walked from each place in all of them together."""
        lengths = np.array([len(u) for u in units])
        width = int(lengths.max(initial=0))
        text = np.zeros((len(units), width + 1), np.int32)
        for k, u in enumerate(units):
            text[k, : len(u)] = np.frombuffer(u, np.uint8)
        follows = (text & 0xC0) == 0x80
        best = np.full((len(units), width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((len(units), width + 1), np.int32), np.full((len(units), width + 1), -1, np.int32)
        for i in range(width):
            at = np.flatnonzero((best[:, i] > -np.inf) & (lengths > i))
            if not len(at):
                continue
            char = np.full(len(units), i + 1)
            for k in range(1, 4):
                if i + k < width:
                    char[at] += (char[at] == i + k) & follows[at, i + k] & (lengths[at] > i + k)
            known, state, here = np.zeros(len(units), bool), np.zeros(len(at), np.int64), at
            for j in range(i, min(width, i + self.longest)):
                to = self.base[state] + text[here, j] + 1
                ok = (self.check[to] == state) & (lengths[here] > j)
                here, state = here[ok], to[ok].astype(np.int64)
                if not len(here):
                    break
                value = self.value[state]
                ends = value >= 0
                own, v = here[ends], value[ends]
                known[own] |= char[own] == j + 1
                score = best[own, i] + self.scores[v]
                up = score > best[own, j + 1]
                best[own[up], j + 1], start[own[up], j + 1], piece[own[up], j + 1] = score[up], i, v[up]
            lost = at[~known[at]]
            score = best[lost, i] + self.unknown
            up = score > best[lost, char[lost]]
            best[lost[up], char[lost[up]]] = score[up]
            start[lost[up], char[lost[up]]], piece[lost[up], char[lost[up]]] = i, -1
        out = []
        for u, n, s, p in zip(units, lengths.tolist(), start.tolist(), piece.tolist(), strict=True):
            path: list[int] = []
            while n:
                path += [p[n]] if p[n] >= 0 else [-1 - b for b in reversed(u[s[n] : n])]
                n = s[n]
            out.append(path[::-1])
        return out

    def written(self, path: list[int]) -> bytes:
        """Ids of a path as little-endian 32-bit bytes."""
        return struct.pack(f"<{len(path)}i", *[self.id_of[p] if p >= 0 else self.byte_of[-1 - p] for p in path])

    def units(self, text: str) -> list[str]:
        """The text in parts that are encoded alone: marked by a space in front; a literal space mark stands alone, as 2 marks never do elsewhere."""
        out: list[str] = []
        for k, part in enumerate((" " + text).split(SPACE)):
            if k:
                out.append("")
            out += self.unit.findall(part.replace(" ", SPACE))
        return out

    def answers(self, units: list[str]) -> list[bytes]:
        """Ids of each unit; short ones are worked on together, in order of length. An empty unit is a literal space mark, as bytes."""
        coded = [u.encode() for u in units]
        out = [b""] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(coded[i]))
        short = [i for i in order if 0 < len(coded[i]) <= TOGETHER]
        for lo in range(0, len(short), 8192):
            group = short[lo : lo + 8192]
            for i, path in zip(group, self.best_many([coded[i] for i in group]), strict=True):
                out[i] = self.written(path)
        for i in order:
            if not coded[i]:
                out[i] = self.written([-1 - b for b in SPACE.encode()])
            elif len(coded[i]) > TOGETHER:
                out[i] = self.written(self.best_one(coded[i]))
        return out

    def encode(self, texts: list[str], memory: Memory) -> list[bytes]:
        """Ids of each text as bytes. memory: units met so far."""
        cut = [self.units(t) if t else [] for t in texts]
        known = memory.of(set().union(*cut)).__getitem__
        return [b"".join(map(known, units)) for units in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces are bytes, the mark is a space, and the space put in front goes."""
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")[1:]


#: By model: units that a worker has met.
_KNOWN: dict[str, Memory] = {}


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row: the best-scored pieces, characters without one as bytes.

    Spaces become marks and one is put in front of a text; all other characters stay as they are, so decode() gives the text
    back exactly; a literal mark is written as bytes. Null and empty texts have no ids; ids of rows are carried, null or
    repeated; an empty table gives no rows. The trie is built once and sent out; its size is the vocabulary's. A worker remembers a bounded number of words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary, known = sent.value, _KNOWN.setdefault(model, Memory(sent.value.answers))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = vocabulary.encode([t or "" for t in part.column(1).to_pylist()], known)
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield {"doc_id": part.column(0), "ids": ids}

    return in_arrow(only(docs, id_col, text_col), run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """rows with one more column, text: what encode() was given. Null ids give a null text."""
    names = rows.columns
    at = names.index(ids_col)
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary = sent.value
        for batch in batches:
            column = batch.column(at)
            yield {n: batch.column(i) for i, n in enumerate(names)} | {"text": [vocabulary.decode(x.values.to_pylist()) if x.is_valid else None for x in column]}

    return in_arrow(rows, run, T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("text", T.StringType())]))


def check(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() with n_tokens, and whether decode() gives the text back (exact; null texts count as empty)."""
    texts = only(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary, known = sent.value, _KNOWN.setdefault(model, Memory(sent.value.answers))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                given = [t or "" for t in part.column(1).to_pylist()]
                found = [np.frombuffer(x, "<i4") for x in vocabulary.encode(given, known)]
                yield {"doc_id": part.column(0), "ids": found, "n_tokens": [len(x) for x in found], "exact": [vocabulary.decode(x.tolist()) == t for x, t in zip(found, given, strict=True)]}

    return in_arrow(texts, run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, n_tokens long, exact boolean")
