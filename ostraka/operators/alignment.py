"""Global alignment of sequences of signs: a bounded set of fragments against every manuscript, scored with affine gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The scores of two signs, of a gap's first sign and of each further one; the marks of a line break, an unclear sign and variants.
MATCH, MISMATCH, SIMILAR = 16, -5, 7
BREAK_MATCH, BREAK_MISMATCH = 6, -10
UNCLEAR_MATCH, UNCLEAR_MISMATCH = 3, -3
GAP_START, GAP_EXTENSION, GAP_EXTENSION_BREAK = -5, -1, -10
LINE_BREAK, UNCLEAR, VARIANT = "#", "X", "/"
# Signs that are often taken for one another.
SIMILAR_SIGNS = (
    ("ABZ545", "ABZ354"), ("ABZ545", "ABZ597"), ("ABZ411", "ABZ318"), ("ABZ353", "ABZ597"), ("ABZ207", "ABZ73"), ("ABZ532", "ABZ427"), ("ABZ68", "ABZ328"), ("ABZ104", "ABZ7"),
    ("ABZ427", "ABZ61"), ("ABZ537", "ABZ55"), ("ABZ586", "ABZ84"), ("ABZ352", "ABZ138"), ("ABZ367", "ABZ449"), ("ABZ214", "ABZ371"), ("ABZ308", "ABZ142"), ("ABZ58", "ABZ73"),
    ("ABZ231", "ABZ75"), ("ABZ139", "ABZ73"), ("ABZ342", "ABZ61"), ("ABZ376", "ABZ73"), ("ABZ579", "ABZ142"), ("ABZ55", "ABZ59"), ("ABZ381", "ABZ207"), ("ABZ312", "ABZ75"),
    ("ABZ371", "ABZ5"), ("ABZ139", "ABZ207"), ("ABZ328", "ABZ86"), ("ABZ68", "ABZ86"), ("ABZ75", "ABZ70"), ("ABZ318", "ABZ142"), ("ABZ139", "ABZ58"), ("ABZ461", "ABZ536"),
)

_SIMILAR = {frozenset(pair) for pair in SIMILAR_SIGNS}
_SIMILAR_ANY = frozenset().union(*_SIMILAR)
_NEVER, _NEVER_SHORT = -(10**9), -(2**14)


@lru_cache(1 << 16)
def pair_score(a: str, b: str) -> int:
    """Two signs: a line break first, then an unclear sign, then a known pair, then the best of variants."""
    for mark, same, other in ((LINE_BREAK, BREAK_MATCH, BREAK_MISMATCH), (UNCLEAR, UNCLEAR_MATCH, UNCLEAR_MISMATCH)):
        if mark in (a, b):
            return same if a == b else other
    if frozenset((a, b)) in _SIMILAR:
        return SIMILAR
    if VARIANT in a or VARIANT in b:
        return max(pair_score(x, y) for x in a.split(VARIANT) for y in b.split(VARIANT))
    return MATCH if a == b else MISMATCH


def clear_lines(signs: Column) -> Column:
    """array<array<string>>: the signs of each line; an unclear one is left out, be it a part of a variant."""
    return F.transform(F.split(signs, "\n"), lambda line: F.filter(F.split(F.replace(line, F.lit(UNCLEAR), F.lit(" ")), r"\s+"), lambda sign: sign != ""))


def sequence(signs: Column) -> Column:
    """array<string>: the clear signs of a text, with a mark between every two lines."""
    return F.flatten(F.transform(clear_lines(signs), lambda line, i: F.when(i > 0, F.concat(F.array(F.lit(LINE_BREAK)), line)).otherwise(line)))


def has_clear_signs(signs: Column) -> Column:
    """Whether any line has a sign that is not unclear; a null text has none."""
    return F.coalesce(F.exists(clear_lines(signs), lambda line: F.size(line) > 0), F.lit(False))


def _gap_costs(signs: Sequence[str]) -> np.ndarray:
    return np.array([GAP_EXTENSION_BREAK if s == LINE_BREAK else GAP_EXTENSION for s in signs], dtype=np.int32)


def _special(sign: str) -> bool:
    return sign in (LINE_BREAK, UNCLEAR) or VARIANT in sign or sign in _SIMILAR_ANY


class Fragments:
    """Fragments as rows of sign numbers, with what a gap over each sign costs."""

    def __init__(self, fragments: Sequence[Sequence[str]]) -> None:
        self.lengths = np.array([len(f) for f in fragments], dtype=np.int64)
        self.signs = {s: i for i, s in enumerate(dict.fromkeys(x for f in fragments for x in f))}
        self.special = [s for s in self.signs if _special(s)]
        shape = (len(fragments), int(self.lengths.max(initial=0)))
        self.codes, self.gaps = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        for k, f in enumerate(fragments):
            self.codes[k, : len(f)] = [self.signs[s] for s in f]
            self.gaps[k, : len(f)] = _gap_costs(f)
        self.all_codes, self.ends = np.array([self.signs[s] for f in fragments for s in f], dtype=np.int32), np.cumsum(self.lengths)

    def bounds(self, table: np.ndarray) -> np.ndarray:
        """What no alignment of each fragment can pass: each of its signs is paired once at most, and only pairs add to a score."""
        most = np.concatenate([[0], np.cumsum(np.maximum(table.max(axis=1), 0)[self.all_codes], dtype=np.int64)])
        return most[self.ends] - most[self.ends - self.lengths]

    def table(self, other: Sequence[str]) -> np.ndarray:
        """Scores of all signs of the fragments (rows) with those of a manuscript in order; only marked and listed signs need the rules."""
        found = np.full((len(self.signs), len(other)), MISMATCH, dtype=np.int32)
        for j, sign in enumerate(other):
            if sign in self.signs:
                found[self.signs[sign], j] = MATCH
        for j, sign in enumerate(other):
            for a in self.signs if _special(sign) else self.special:
                found[self.signs[a], j] = pair_score(a, sign)
        return found


def align_all(fragments: Fragments, other: Sequence[str], least: int = 0) -> np.ndarray:
    """The score of each fragment with one manuscript; gaps at either end of either cost nothing.

    Scores under `least` may be told as 0: fragments that can't reach it are left out. All others go through the same row together. A gap opens from a pair or from a gap in the other sequence.
    """
    n, most = len(other), fragments.codes.shape[1]
    scores = np.zeros(len(fragments.lengths), dtype=np.int32)
    if not n or not most:
        return scores
    table = fragments.table(other)
    able = np.flatnonzero(fragments.bounds(table) >= least)
    if not len(able):
        return scores
    # the longest first: the first `left` rows are those of fragments that have an i-th sign
    able = able[np.argsort(-fragments.lengths[able], kind="stable")]
    lengths, codes, gaps, best = fragments.lengths[able], fragments.codes[able], fragments.gaps[able], scores[able]
    most = int(lengths.max())
    # nothing passes MATCH for each pair, nor goes below the gaps over all signs of both: short sequences go in 16 bits, at half the memory
    short = MATCH * min(n, most) - GAP_EXTENSION_BREAK * (n + most) - GAP_START < -_NEVER_SHORT
    kind, never = (np.int16, _NEVER_SHORT) if short else (np.int32, _NEVER)
    table, gaps = table.astype(kind), gaps.astype(kind)
    across = np.concatenate([[0], np.cumsum(_gap_costs(other))]).astype(kind)  # cost of extending over the first j signs
    shape = (len(best), n + 1)
    whole = (np.full(shape, never, kind), np.zeros(shape, kind), np.zeros(shape, kind), np.zeros(shape, kind), np.full(shape, never, kind), np.empty(shape, kind))
    start, reopened = kind(GAP_START), across[1:] + kind(GAP_START)
    left = np.searchsorted(-lengths, -np.arange(most + 1), side="left")
    for i in range(most):
        vertical, open_to_down, top, paired, horizontal, opens = (x[: left[i]] for x in whole)
        vertical += gaps[: left[i], i : i + 1]
        open_to_down += start
        np.maximum(vertical, open_to_down, out=vertical)
        vertical[:, 0] = never
        # the first column is a gap at the start, which costs nothing, and stays 0
        np.add(top[:, :-1], table[codes[: left[i], i]], out=paired[:, 1:])
        np.maximum(paired, vertical, out=opens)
        # a gap over signs k+1 to j: its first sign costs GAP_START, the others their extension
        np.subtract(opens[:, :-1], across[1:], out=horizontal[:, 1:])
        np.maximum.accumulate(horizontal[:, 1:], axis=1, out=horizontal[:, 1:])
        horizontal[:, 1:] += reopened
        np.maximum(opens, horizontal, out=top)
        np.maximum(paired, horizontal, out=open_to_down)
        best[: left[i]] = np.maximum(best[: left[i]], top[:, -1])
        last = slice(left[i + 1], left[i])
        best[last] = np.maximum(best[last], top[last].max(axis=1, initial=0))
    scores[able] = best
    return scores


def _rows(a: Sequence[str], b: Sequence[str], first: np.ndarray, at: int, count: int) -> np.ndarray:
    """States (paired, gap in b, gap in a) of the rows at to at + count of the programme, from the states of the row before (3 x columns)."""
    across = np.concatenate([[0], np.cumsum(_gap_costs(b))])
    out = np.empty((count + 1, 3, len(b) + 1), np.int64)
    out[0] = first
    for r in range(1, count + 1):
        sign = a[at + r - 1]
        paired, down, side = out[r - 1]
        scores = np.array([pair_score(sign, other) for other in b], np.int64)
        here = out[r]
        here[1] = np.maximum(np.maximum(paired, side) + GAP_START, down + _gap_costs([sign])[0])
        here[1, 0] = _NEVER
        here[0, 0] = 0
        here[0, 1:] = np.maximum(np.maximum(paired, down), side)[:-1] + scores
        opens = np.maximum(here[0], here[1])
        here[2, 0] = _NEVER
        here[2, 1:] = np.maximum.accumulate(opens[:-1] - across[1:]) + across[1:] + GAP_START
    return out


def trace(a: Sequence[str], b: Sequence[str]) -> tuple[int, list[tuple[int, int]]]:
    """The score of two sequences and an alignment of that score: pairs of places, -1 for a gap, from the first column that costs or counts to the last.

    Every n-th row of states is kept (n: the root of a's length), those between are made again when the way back comes to them: space grows with the root of a's
    length times that of b. Of several alignments the one that ends in a's last sign, at the smallest place in b, and pairs rather than gaps.
    """
    if not a or not b:
        return 0, []
    step = max(1, int(len(a) ** 0.5))
    start = np.full((3, len(b) + 1), _NEVER, np.int64)
    start[0] = 0
    kept, last, ends = [], start, np.zeros(len(a) + 1, np.int64)
    for at in range(0, len(a), step):
        kept.append(last)
        rows = _rows(a, b, last, at, min(step, len(a) - at))
        ends[at + 1 : at + len(rows)] = rows[1:, :, -1].max(axis=1)
        last = rows[-1].copy()
    bottom = last.max(axis=0)
    score = max(int(bottom.max()), int(ends.max()), 0)
    if score == 0:
        return 0, []
    i, j = (len(a), int(np.argmax(bottom == score))) if score in bottom else (int(np.argmax(ends == score)), len(b))
    pairs, block, rows, state = [], -1, None, None
    while i and j:
        if (i - 1) // step != block:
            block = (i - 1) // step
            rows = _rows(a, b, kept[block], block * step, min(step, len(a) - block * step))
        here, above = rows[i - block * step], rows[i - 1 - block * step]
        if state is None:
            state = int(np.argmax(here[:, j]))
        if state == 0:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
            state = int(np.argmax(above[:, j])) if i and j else None
        elif state == 1:
            pairs.append((i - 1, -1))
            opened = max(int(above[0, j]), int(above[2, j])) + GAP_START == here[1, j]
            state = (0 if above[0, j] >= above[2, j] else 2) if opened else 1
            i -= 1
        else:
            pairs.append((-1, j - 1))
            opened = max(int(here[0, j - 1]), int(here[1, j - 1])) + GAP_START == here[2, j]
            state = (0 if here[0, j - 1] >= here[1, j - 1] else 1) if opened else 2
            j -= 1
    return score, pairs[::-1]


def preserved(a: Sequence[str], b: Sequence[str], pairs: Sequence[tuple[int, int]]) -> tuple[float, float]:
    """Percentages, to two places, of the pairs without a gap that are the same sign, and of those that score above 0; 0 if there are none."""
    met = [(a[i], b[j]) for i, j in pairs if i >= 0 and j >= 0]
    share = lambda n: round(100 * n / len(met), 2) if met else 0.0
    return share(sum(x == y for x, y in met)), share(sum(pair_score(x, y) > 0 for x, y in met))


def align(fragments: DataFrame, manuscripts: DataFrame, fragment: str, manuscript: Sequence[str], signs: str = "signs", max_lines: int | None = 10, min_score: int = 100, traced: bool = False, also: Sequence[str] = (), block: int = 50_000, part: int = 20_000) -> DataFrame:
    """(fragment, `also`, manuscript columns, score) of every fragment of at most max_lines lines (None: of any number) and every manuscript that score min_score or more.

    traced: also identity and similarity (percent, see preserved), begins and ends (places of the first and last sign of the fragment's sequence that the alignment covers, from 0), and
    alignment, an array of (fragment_sign, manuscript_sign) with null for a gap. also: columns of fragments that come
    along. The fragments are the query set. Both sides are dealt into blocks of about `block` and `part` signs by their place in the scan, and each block of fragments meets
    each part of manuscripts once, in a task that holds both: neither table is gathered, and tasks do not follow the input's partitions. Within a task all fragments go through a
    manuscript together; only pairs that reach min_score are traced.

    Texts that are null, empty or without a clear sign take no part; rows that repeat give repeated results; other columns are ignored.
    """
    clear = has_clear_signs(F.col(signs))
    asked = fragments.where(clear & (F.lit(True) if max_lines is None else F.size(F.split(signs, "\n")) <= max_lines)).select(F.col(fragment).alias("fragment"), *also, sequence(F.col(signs)).alias("__s"))
    sought = manuscripts.where(clear).select(*manuscript, sequence(F.col(signs)).alias("__s"))
    total = lambda df: df.agg(F.coalesce(F.sum(F.size("__s")), F.lit(0))).first()[0]
    blocks, parts = (max(1, -(-total(df) // most)) for df, most in ((asked, block), (sought, part)))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("__block", dealt(blocks)).withColumn("__part", every(parts))
    right = sought.withColumn("__part", dealt(parts)).withColumn("__block", every(blocks))

    schema = asked.select("fragment", *also).schema
    for name in manuscript:
        schema = schema.add(manuscripts.schema[name])
    schema = schema.add("score", "long")
    if traced:
        schema = schema.add("identity", "double").add("similarity", "double").add("begins", "long").add("ends", "long").add("alignment", T.ArrayType(T.StructType().add("fragment_sign", "string").add("manuscript_sign", "string")))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        queries = [list(x) for x in a["__s"]]
        prepared, found = Fragments(queries), []
        for i, text in enumerate(list(x) for x in b["__s"]):
            scores = align_all(prepared, text, min_score)
            for k in np.flatnonzero(scores >= min_score):
                row = [a["fragment"].iloc[k], *[a[n].iloc[k] for n in also], *[b[n].iloc[i] for n in manuscript], int(scores[k])]
                if traced:
                    pairs = trace(queries[k], text)[1]
                    covered = [x for x, _ in pairs if x >= 0]
                    row += [*preserved(queries[k], text, pairs), *((covered[0], covered[-1]) if covered else (None, None)), [{"fragment_sign": queries[k][x] if x >= 0 else None, "manuscript_sign": text[y] if y >= 0 else None} for x, y in pairs]]
                found.append(row)
        return pd.DataFrame(found, columns=schema.names)

    keys = ["__block", "__part"]
    return left.repartition(blocks * parts, *keys).groupBy(*keys).cogroup(right.repartition(blocks * parts, *keys).groupBy(*keys)).applyInPandas(run, schema)
