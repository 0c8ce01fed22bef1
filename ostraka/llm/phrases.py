"""Collocations: counted phrases of frequent words, by packed keys that are sorted in ranges and counted by runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import by_block, in_arrow, in_order, materialize, only, release

#: What ends a piece, and the byte that stands for it: no UTF-8 text has it.
ENDS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TO_BREAK = bytes.maketrans(ENDS, BREAK * len(ENDS))
#: Id 0 is a break; keys hold two ids of 32 bits each.
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_MOST_IDS = 2**31 - 1


def words_and_breaks(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, with BREAK between pieces."""
    return text.lower().translate(_TO_BREAK).replace(BREAK, b" " + BREAK + b" ").split()


def encode(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """(lang, text) -> blocks of whole texts: one row with the stream of a block's own word numbers, and a row for each of its words with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, dict[bytes, int]] = {}
        stream, held, known = [], 0, 1

        def flush() -> Iterator[dict]:
            coded = np.concatenate(stream)
            counts = np.bincount(coded, minlength=known)
            yield {"block": [block], "lang": [None], "word": [None], "local": [None], "n": [None], "stream": [coded.tobytes()]}
            for lang, own in numbers.items():
                of = list(own)
                for lo in range(0, len(of), 1 << 16):
                    some = of[lo : lo + (1 << 16)]
                    local = np.fromiter(map(own.__getitem__, some), np.int64, len(some))
                    yield {"block": np.full(len(some), block), "lang": pa.array([lang]).take(pa.array(np.zeros(len(some), np.int32))), "word": some, "local": local, "n": counts[local], "stream": pa.nulls(len(some), pa.binary())}

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = numbers.setdefault(lang, {})
                words = words_and_breaks(text)
                for word in set(words).difference(own, (BREAK,)):
                    own[word] = known
                    known += 1
                own[BREAK] = 0
                stream += [np.fromiter(map(own.__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
                del own[BREAK]
                held += len(text)
                if held >= block_bytes:
                    yield from flush()
                    numbers, stream, held, known = {}, [], 0, 1
                    block += 1
        if stream:
            yield from flush()

    return run


def pairs_of(stream: np.ndarray) -> np.ndarray:
    """The packed key of each word and its follower."""
    wide = stream.astype(np.uint64)
    return wide[:-1] << _HALF | wide[1:]


def after_null(values: np.ndarray) -> pa.Array:
    """The values behind one null."""
    return pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(values, pa.int64())])


def pair_counts(streams: pa.Table, known: pa.Table) -> dict | None:
    """One block: its stream in the dictionary's ids (rare words are breaks), and the counts of its pairs of neighbours."""
    if not known.num_rows:
        return None
    local = np.frombuffer(streams.column("stream")[0].as_buffer(), np.uint32)
    ids = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
    ids[known.column("local").to_numpy()] = known.column("id").to_numpy()
    coded = ids[local]
    coded = coded[(coded > 0) | np.append(coded[1:] > 0, False)]  # one break in a row says enough
    keys, n = np.unique(pairs_of(coded)[(coded[:-1] > 0) & (coded[1:] > 0)], return_counts=True)
    block = streams.column("block")[0].as_py()
    return {"block": np.full(len(keys) + 1, block), "hi": after_null(keys.astype(np.int64)), "n": after_null(n), "stream": pa.concat_arrays([pa.array([coded.tobytes()], pa.binary()), pa.nulls(len(keys), pa.binary())])}


def longer_counts(longest: int) -> Callable[[pa.Table, pa.Table], dict | None]:
    """One block: counts of the phrases of three words and more whose neighbours are all frequent pairs."""

    def run(streams: pa.Table, frequent: pa.Table) -> dict | None:
        coded = np.frombuffer(streams.column("stream")[0].as_buffer(), np.uint32)
        if not frequent.num_rows or len(coded) < 3:
            return None
        known = np.unique(np.concatenate([np.frombuffer(m.as_buffer(), np.uint64) for m in frequent.column("members")]))
        keys = pairs_of(coded)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1).astype(np.uint64)
        good = known[at] == keys
        three = good[:-1] & good[1:]
        packed, n = np.unique((at[:-1] << _HALF | coded[2:])[three], return_counts=True)
        hi, lo, counts = known[packed >> _HALF], packed << _HALF, n
        if longest > 3:
            four = three[:-1] & good[2:]
            packed, n = np.unique((at[:-2] << _HALF | at[2:])[four], return_counts=True)
            hi, lo, counts = np.concatenate([hi, known[packed >> _HALF]]), np.concatenate([lo, known[packed & _LOW]]), np.concatenate([counts, n])
        return {"hi": hi.astype(np.int64), "lo": lo.astype(np.int64), "n": counts}

    return run


class Members:
    """Keys that are frequent, by the block that holds them; told as one row of packed keys for a block, at the latest when `most` keys are held."""

    def __init__(self, most: int = 1 << 22):
        self.most, self.keys, self.blocks, self.held = most, [], [], 0

    def add(self, keys: np.ndarray, blocks: np.ndarray) -> None:
        self.keys.append(keys)
        self.blocks.append(blocks)
        self.held += len(keys)

    def told(self, all_of_them: bool = False) -> Iterator[dict]:
        if not self.held or self.held < self.most and not all_of_them:
            return
        keys, blocks = np.concatenate(self.keys), np.concatenate(self.blocks)
        order = np.argsort(blocks, kind="stable")
        keys, blocks = keys[order], blocks[order]
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        self.keys, self.blocks, self.held = [], [], 0
        none = pa.nulls(len(starts), pa.int64())
        yield {"hi": none, "f": none, "block": blocks[starts], "members": [k.tobytes() for k in np.split(keys, starts[1:])]}


def run_lengths(keys: tuple[str, ...], least: int, in_blocks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """Sorted rows (keys, n, and with in_blocks block) -> (keys, f) of each run whose n sum up to `least` or more; with in_blocks also the packed members of each block, see Members.

    Of a run that goes on in the next batch its sum is held, and its blocks only while the sum is too small: fewer than `least` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_key, total, waiting, members = None, 0, np.zeros(0, np.int64), Members()

        def often(key_columns: list, f: list | np.ndarray) -> dict:
            more = {"block": pa.nulls(len(f), pa.int64()), "members": pa.nulls(len(f), pa.binary())} if in_blocks else {}
            return {**dict(zip(keys, key_columns, strict=True)), "f": f, **more}

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            n = batch.column("n").to_numpy()
            fresh = np.zeros(len(n), bool)
            fresh[0] = True
            for c in columns:
                fresh[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(fresh)
            sums = np.add.reduceat(n, starts)
            goes_on = open_key == tuple(int(c[0]) for c in columns)
            if goes_on:
                sums[0] += total
            elif open_key is not None and total >= least:
                yield often([[k] for k in open_key], [total])
            enough = sums >= least
            done, last = np.flatnonzero(enough[:-1]), starts[-1]
            yield often([c[starts[done]] for c in columns], sums[done])
            if in_blocks:
                block = batch.column("block").to_numpy()
                waiting = waiting if goes_on else waiting[:0]
                if enough[0]:
                    members.add(np.full(len(waiting), columns[0][0]), waiting)
                told = np.repeat(enough, np.diff(np.append(starts, len(n))))
                members.add(columns[0][told], block[told])
                before = waiting if len(starts) == 1 else waiting[:0]
                waiting = before[:0] if enough[-1] else np.append(before, block[last:])
                yield from members.told()
            open_key, total = tuple(int(c[last]) for c in columns), int(sums[-1])
        if open_key is not None and total >= least:
            yield often([[k] for k in open_key], [total])
        yield from members.told(all_of_them=True)

    return run


# Keys as columns: hi holds the first two ids, lo the third and fourth; 0 where a phrase is shorter


def ids_of(hi: Column, lo: Column) -> Column:
    """array<long>: a key's ids, two to four."""
    low = F.lit(0xFFFFFFFF)
    return F.filter(F.array(F.shiftrightunsigned(hi, 32), hi.bitwiseAND(low), F.shiftrightunsigned(lo, 32), lo.bitwiseAND(low)), lambda i: i != 0)


def keyed(df: DataFrame, ids: str, hi: str, lo: str) -> DataFrame:
    """df with the array `ids` of up to four ids packed into the columns hi and lo."""
    at = lambda i: F.coalesce(F.get(ids, F.lit(i)), F.lit(0).cast("long"))
    return df.withColumns({hi: F.shiftleft(at(0), 32).bitwiseOR(at(1)), lo: F.shiftleft(at(2), 32).bitwiseOR(at(3))}).drop(ids)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, scale: int = 2_000_000, unknown: str = "und", block_bytes: int = 1 << 24) -> DataFrame:
    """The first `top` phrases of each language by score: lang, rank (from 1), phrase, a, l, r, n, score; numbers are long.

    Texts are lower-cased (A-Z only) and cut at `.,;:!?` and line ends (line feed, vertical tab, form feed, carriage return) into pieces, those at spaces and tabs into words.
    n: all word occurrences of the language. Phrases of 2 to `longest` (at most 4) words with a = f(phrase) >= least are candidates;
    cut in two after k words, with l and r the occurrences of the halves, a cut scores floor(scale * a / (l + r)). The lowest cut
    counts, ties to the smaller k. A candidate goes if its words stand in a row inside a longer one with 100 * f(longer) >= cover * a. Order: score, then a, both
    descending, then the phrase by bytes.

    Words that are frequent get dense ids; elsewhere pieces break, since no candidate holds a rare word. Texts are read once, into blocks of about `block_bytes`; each
    block counts its own pairs, pairs are dealt by ranges of their keys, sorted and counted by runs. Longer phrases are counted
    only where all neighbours are frequent pairs, by the same steps. A task holds a block, or the rows of one batch; a key has at
    most one row for each block. All counts are over all rows.

    Null texts are empty, a null language is `unknown`; repeated rows count each time; an empty table gives no rows; other columns
    are ignored. More than 2**31 - 1 frequent words are an error.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest has to be 2, 3 or 4")
    spark = df.sparkSession
    texts = only(df, lang_col, text_col).where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit(unknown)).alias("lang"), F.col(text_col).alias("text"))
    blocks = materialize(in_arrow(texts, encode(block_bytes), "block long, lang string, word binary, local long, n long, stream binary"))
    vocabulary = blocks.where("word is not null")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = in_order(frequent, "lang", "word", name="id").withColumn("id", F.col("id") + 1)
    if words.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] > _MOST_IDS:
        raise ValueError("too many frequent words for ids of 32 bits")

    known = vocabulary.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "local", "id")
    paired = materialize(by_block(blocks.where("stream is not null").select("block", "stream"), known, pair_counts, "block long, hi long, n long, stream binary"))
    two = run_counts(paired.where("hi is not null").select("hi", "n", "block"), ("hi",), least, in_blocks=True)
    streams = paired.where("stream is not null").select("block", "stream")
    more = None
    if longest > 2:
        members = two.where("block is not null").select("block", "members")
        counted = materialize(by_block(streams, members, longer_counts(longest), "hi long, lo long, n long"))
        more = run_counts(counted, ("hi", "lo"), least)
        release(spark, counted)
    release(spark, paired)

    phrases = two.where("f is not null").select("hi", F.lit(0).cast("long").alias("lo"), "f")
    if more is not None:
        phrases = phrases.unionAll(more.select("hi", "lo", "f"))
    return ranked(phrases, words, totals, longest, top, cover, scale)


def run_counts(rows: DataFrame, keys: tuple[str, ...], least: int, in_blocks: bool = False) -> DataFrame:
    """See run_lengths; rows are dealt by ranges of their keys and sorted there."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = "".join(f"{k} long, " for k in keys) + "f long" + (", block long, members binary" if in_blocks else "")
    return materialize(in_arrow(ordered, run_lengths(keys, least, in_blocks), schema))


def ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, longest: int, top: int, cover: int, scale: int) -> DataFrame:
    """Scores, covered phrases and ranks of counted phrases (hi, lo, f), as collocations() says."""
    listed = phrases.withColumn("ids", ids_of(F.col("hi"), F.col("lo")))
    size = F.size("ids")
    singles = keyed(words.select("f", F.array("id").alias("ids")), "ids", "p_hi", "p_lo")
    counts = singles.unionByName(phrases.select("f", F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"))).withColumnRenamed("f", "p_f")

    half = lambda k, side, ids: F.struct(k.alias("k"), F.lit(side).alias("side"), ids.alias("half"))
    cut = lambda k: F.array(half(k, "l", F.slice("ids", 1, k)), half(k, "r", F.slice("ids", k + 1, size)))
    halves = listed.select("hi", "lo", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), cut))).alias("p")).select("hi", "lo", "f", "p.*")
    found = keyed(halves, "half", "p_hi", "p_lo").join(counts.hint("merge"), ["p_hi", "p_lo"])
    both = found.groupBy("hi", "lo", "f", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("p_f"))).alias(s) for s in "lr"])
    score = F.expr(f"cast(cast({scale} as decimal(20,0)) * cast(f as decimal(18,0)) as decimal(38,0)) div cast(l + r as decimal(20,0))").cast("long")
    lowest = both.groupBy("hi", "lo").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("f").alias("a"))).alias("cut"))
    kept = lowest.select("hi", "lo", "cut.a", "cut.score", "cut.l", "cut.r")

    if longest > 2:
        within = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
        inside = keyed(listed.where(size > 2).select("f", F.explode(within).alias("part")), "part", "hi", "lo")
        covers = inside.groupBy("hi", "lo").agg(F.max("f").alias("cover"))
        wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
        kept = kept.join(covers.hint("merge"), ["hi", "lo"], "left").where(F.col("cover").isNull() | (wide("cover", 100) < wide("a", cover))).drop("cover")

    # what a phrase has goes along with its words and comes back with them: one join, one aggregation
    spelt = kept.select("*", F.posexplode(ids_of(F.col("hi"), F.col("lo"))).alias("at", "id")).join(words.select("id", "lang", "word").hint("merge"), "id")
    spelt = spelt.groupBy("hi", "lo", "lang", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    named = spelt.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score")

    best = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    # in two steps, so that no task sorts more than a share of a language: what is not among the first of its share is not among the first
    some = named.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", first("lang", "__share")).where(F.col("rank") <= top)
    some = some.withColumn("rank", first("lang").cast("long")).where(F.col("rank") <= top)
    return some.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
