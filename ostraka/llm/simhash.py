"""SimHash near-duplicates: fingerprints of word shingles, linked by vantage-point trees over Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, in_arrow, materialize, only, release

#: Size below which point sets are compared outright, rows of a comparison block, pairs held before they are merged.
LEAF, ROWS, HELD = 1024, 256, 1 << 18


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles (A-Z lower-cased, repeats included), some at a time.

    Fewer words than a shingle has: the whole sequence is the only one. No words: none.
    """
    parts = text.lower().split()
    if not parts:
        return
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        yield np.array([digest(joined, seed)], "<u8")
        return
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    for lo in range(0, len(starts), 1 << 15):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 15)], stops[lo : lo + (1 << 15)], strict=True)], "<u8")


def fingerprint(text: bytes, words: int = 4, tables: int = 1) -> np.ndarray:
    """64 bits for each table: each is 1 if set in over half the hashes of the shingles; 0 without words. Further tables mix the hashes anew."""
    return majority(shingle_hashes(text, words), tables)


def majority(parts: Iterable[np.ndarray], tables: int) -> np.ndarray:
    """The fingerprints of hashes that come in parts."""
    ones, n = np.zeros((tables, 64), np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for t in range(tables):
            if t:
                with np.errstate(over="ignore"):
                    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
                    hashes ^= hashes >> np.uint64(28)
            ones[t] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0] if n else np.zeros(tables, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            yield {"doc_id": batch.column(0), "fp": np.concatenate([fingerprint(t or b"", words) for t in texts.to_pylist()]).view(np.int64)}

    return in_arrow(only(docs, id_col, text_col), run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


# Vantage-point trees


def distance(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest position of each component) after adding the links a-b."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def linked(points: np.ndarray, reach: int, seed: int = 7) -> np.ndarray:
    """Component labels of points within `reach`, found by a vantage-point tree: pairs of branches are pruned by triangle bounds."""
    rng = np.random.default_rng(seed)
    labels, held, n_held = np.arange(len(points)), [], 0
    work: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    while work:
        a, b = work.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if len(a) > LEAF or b is not None and len(b) > LEAF:
            if b is not None and len(b) > len(a):
                a, b = b, a
            vantage = points[a[rng.integers(len(a))]]
            far_a = distance(points[a], vantage).astype(np.int16)
            radius = int(np.median(far_a))
            inner = far_a <= radius
            if not inner.all():
                if b is None:
                    work += [(a[inner], None), (a[~inner], None), (a[inner & (far_a > radius - reach)], a[~inner & (far_a <= radius + reach)])]
                else:
                    far_b = distance(points[b], vantage).astype(np.int16)
                    work += [(a[inner], b[far_b <= radius + reach]), (a[~inner], b[far_b > radius - reach])]
                continue
        right = a if b is None else b
        for lo in range(0, len(a), ROWS):
            rows = a[lo : lo + ROWS]
            for first in range(lo if b is None else 0, len(right), LEAF):
                others = right[first : first + LEAF]
                i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[others][None, :]) <= reach)
                p, q = rows[i], others[j]
                keep = labels[p] != labels[q]
                if keep.any():
                    held.append((p[keep], q[keep]))
                    n_held += int(keep.sum())
                    if n_held > HELD:
                        labels = merged(labels, *map(np.concatenate, zip(*held, strict=True)))
                        held, n_held = [], 0
    return merged(labels, *map(np.concatenate, zip(*held, strict=True))) if held else labels


def blocks_of(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts that `bits` bits are cut into, nearly equal ones."""
    cuts = [round(i * bits / parts) for i in range(parts + 1)]
    return [(low, high - low) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]


def block_value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < 64 else fp


def buckets(distinct: DataFrame, reach: int, shard_size: int) -> DataFrame:
    """(shard, fp, bucket): each value in reach + 1 buckets, one for each of as many blocks of its bits; a bucket of more than `shard_size` values is split again, by blocks of the
    other bits. Of two values within `reach` bits one block of each cut is the same, so they share a bucket. Small buckets share a shard."""
    shards = max(1, math.ceil(distinct.count() / shard_size))
    parts = blocks_of(64, reach + 1)
    first = F.array(*[F.struct(F.lit(j).alias("block"), block_value(F.col("fp"), *p).alias("value")) for j, p in enumerate(parts)])
    dealt = distinct.select("fp", F.explode(first).alias("k")).select("fp", "k.*")
    large = materialize(dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard_size).select("block", "value", F.lit(True).alias("large")))
    low_bits = lambda low: block_value(F.col("fp"), 0, low) if low else F.lit(0).cast("long")
    high_bits = lambda low, end: F.shiftleft(F.shiftrightunsigned("fp", end), low) if end < 64 else F.lit(0).cast("long")
    # the other bits, moved together, are cut into blocks again
    rest = F.coalesce(*[F.when(F.col("block") == j, high_bits(low, low + width).bitwiseOR(low_bits(low))) for j, (low, width) in enumerate(parts)])
    again = F.array(*[F.struct(F.lit(j + 1).alias("other"), block_value(F.col("rest"), *p).alias("within")) for j, p in enumerate(blocks_of(64 - min(w for _, w in parts), reach + 1))])
    whole = F.array(F.struct(F.lit(0).alias("other"), F.lit(0).cast("long").alias("within")))
    told = dealt.join(large.hint("merge"), ["block", "value"], "left").withColumn("rest", rest)
    found = told.select("fp", "block", "value", F.explode(F.when(F.col("large"), again).otherwise(whole)).alias("k")).select("fp", F.xxhash64("block", "value", "k.other", "k.within").alias("bucket"))
    return found.select(F.pmod("bucket", F.lit(shards * (reach + 1))).alias("shard"), "fp", "bucket")


def links(fps: DataFrame, reach: int = 4, shard_size: int = 8192) -> DataFrame:
    """Links (a, b) among the distinct values of fps.fp, enough to connect whatever lies within `reach` bits.

    Values meet in buckets() of those that agree in a block of bits, and of two blocks where very many agree in one: exact, and a task holds about `shard_size` values, whatever the
    table's size. Within a bucket a vantage-point tree finds what lies within reach: values are parted by their distance to a point, and triangle bounds
    prune pairs of branches. Only links of a spanning forest leave a bucket, never all pairs of a group.
    """
    dealt = buckets(materialize(fps.select("fp").distinct()), reach, shard_size)

    def join(group: pa.Table) -> pa.Table:
        points, bucket = group.column("fp").to_numpy().view(np.uint64), group.column("bucket").to_numpy()
        order = np.lexsort((points, bucket))
        points, bucket = points[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if len(bucket) else 0))
        a, b = [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(points)], strict=True):
            if hi - lo > 1:
                own = points[lo:hi]
                labels = linked(own, reach)
                at = np.flatnonzero(labels != np.arange(len(own)))
                a.append(own[at])
                b.append(own[labels[at]])
        none = np.zeros(0, np.uint64)
        return pa.table({"a": np.concatenate([none, *a]).view(np.int64), "b": np.concatenate([none, *b]).view(np.int64)})

    return dealt.groupBy("shard").applyInArrow(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, reach: int = 4) -> DataFrame:
    """A row for each row of docs: doc_id, fp, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ in at most `reach` bits are linked; component_id is the smallest doc_id that can be reached.
    Equal fingerprints are one class, so copies are never paired with one another: classes are linked by vantage-point trees
    (see links) and joined up by star rounds, and a row takes its class's component. Texts without words, null ones
    included, have fingerprint zero and are linked like others. A null id is carried and never the smallest unless its component has no
    other; repeated rows come out as often as they came in; an empty table gives no rows.
    """
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, id_col, text_col, words))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(fps, reach)).withColumnsRenamed({"node": "fp", "component": "root"})
    release(spark)
    member = materialize(classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written before they are joined: a component or a class of a third of all rows is then split over many tasks
    smallest = materialize(member.groupBy("root").agg(F.min("least").alias("component_id")))
    by_class = materialize(member.join(smallest.hint("merge"), "root").select(F.col("fp").alias("class_fp"), "component_id"))
    release(spark, member, smallest)
    return fps.join(by_class.hint("merge"), F.col("fp") == F.col("class_fp")).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a stated Jaccard similarity


def signature(text: bytes, words: int, tables: int, bands: int, rows: int, mixers: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a text's set of shingles: its hash; a fingerprint for each table; and for each band the hash of the least values under `rows` mixings."""
    parts = list(shingle_hashes(text, words))
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(found), 4096):
            least = np.minimum(least, ((found[lo : lo + 4096] ^ mixers[0][:, None]) * mixers[1][:, None]).min(axis=1))
    keys = [xxhash.xxh3_64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)]
    return xxhash.xxh3_64_intdigest(found.tobytes()), majority(parts, tables).view(np.int64), np.array(keys, np.uint64).view(np.int64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def confirmed(sets: list[np.ndarray], labels: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a spanning forest of the graph of all pairs of sets whose Jaccard similarity is at least `least`; sets of one label count as tied already."""
    sizes, labels, out = np.array([len(x) for x in sets]), labels.copy(), []
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    for i in range(len(sets) - 1):
        other = labels[i + 1 :] != labels[i]
        if not other.any():
            continue
        marked = np.zeros(len(words), bool)
        marked[flat[ends[i] - sizes[i] : ends[i]]] = True
        sums = np.concatenate([[0], np.cumsum(marked[flat[ends[i] :]])])
        both = np.diff(sums[np.concatenate([[0], ends[i + 1 :] - ends[i]])])
        hits = i + 1 + np.flatnonzero(other & (both >= least * (sizes[i] + sizes[i + 1 :] - both) - 1e-9))
        for j in hits.tolist():
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                out.append((i, j))
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, reach: int = 7, tables: int = 1, least: float = 0.8, bands: int = 20, rows: int = 5, block: int = 512) -> DataFrame:
    """(doc_id, text_hash, component) of every row: components of the links between texts whose shingle sets have a Jaccard similarity of `least` or more.

    Texts of equal shingle sets are one node. Candidates are nodes that share a bucket: values of one of `tables` independent
    fingerprints that vantage-point trees link within `reach` bits (see links), or the same `rows` least mixed shingle hashes in one of
    `bands` bands. At a similarity of 0.8 a pair meets in a band with probability 1 - (1 - 0.8**5)**20 = 0.9996. Within a
    bucket each pair that is not tied yet is compared by its whole shingle sets, and only pairs that pass are links; buckets of the same nodes are looked at once.
    Buckets of more than `block` nodes are dealt out in blocks; of those still in several components after that, each pair of blocks is compared, too.
    """
    spark = docs.sparkSession
    mixers = np.random.default_rng(11).integers(1, 1 << 63, (2, bands * rows), dtype=np.uint64) | np.array([[0], [1]], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [signature(t or b"", words, tables, bands, rows, mixers) for t in pc.cast(batch.column(2), pa.binary()).to_pylist()]
            node = np.array([f[0] for f in found], np.uint64).view(np.int64)
            yield {"doc_id": batch.column(0), "text_hash": batch.column(1), "node": node, "fps": [f[1] for f in found], "bands": [f[2] for f in found]}

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    found = materialize(in_arrow(texts, run, f"doc_id {dict(docs.dtypes)[id_col]}, text_hash long, node long, fps array<long>, bands array<long>"))
    nodes = materialize(found.groupBy("node").agg(F.first("fps").alias("fps"), F.first("bands").alias("bands"), F.min("text_hash").alias("text_hash")))
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    for t in range(tables):
        values = nodes.select("node", F.col("fps")[t].alias("fp"))
        ties = materialize(links(values, reach))
        # values tied to one label in a shard share its bucket, the label itself and equal values too
        named = ties.select(F.col("a").alias("fp"), F.col("b").alias("label")).unionAll(values.select("fp", F.col("fp").alias("label"))).distinct()
        buckets = buckets.unionAll(values.join(named, "fp").select(F.xxhash64(F.lit(t), "label").alias("bucket"), "node"))
        release(spark)
    buckets = materialize(buckets)
    release(spark)
    # of buckets that hold the same nodes, one
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark")).where("n >= 2")
    chosen = materialize(sizes.groupBy("n", "low", "high", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).alias("blocks")))
    members = materialize(buckets.join(chosen.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    release(spark, buckets, chosen)
    # one text of each node, taken before anything is shuffled by node
    asked = materialize(members.select("node").distinct().join(nodes.select("node", "text_hash"), "node"))
    wanted = materialize(texts.join(asked.hint("merge"), "text_hash").groupBy("node").agg(F.first("text").alias("text")))
    release(spark, nodes, asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[int, int, bytes]] = []
        last = None

        def settle() -> Iterator[dict]:
            if len(held) > 1:
                pairs = confirmed([shingle_set(t, words) for _, _, t in held], np.array([r for _, r, _ in held]), least)
                if pairs:
                    yield {"a": [held[i][0] for i, _ in pairs], "b": [held[j][0] for _, j in pairs]}

        for batch in batches:
            # rows of a group follow one another; only one group is held
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for bucket, part, node, root, text in zip(*columns[:4], pc.cast(batch.column(4), pa.binary()).to_pylist(), strict=True):
                if last != (bucket, part):
                    yield from settle()
                    held.clear()
                    last = bucket, part
                held.append((node, root, text or b""))
        yield from settle()

    def compared(groups: DataFrame) -> DataFrame:
        """Links (a, b) between the nodes of each (bucket, part)."""
        whole = groups.join(wanted.hint("merge"), "node").select("bucket", "part", "node", "root", "text")
        return materialize(in_arrow(whole.repartition("bucket", "part").sortWithinPartitions("bucket", "part"), compare, "a long, b long"))

    edges = compared(members.select("bucket", F.col("block").cast("string").alias("part"), "node", F.col("node").alias("root")))
    release(spark)
    joined = materialize(components(edges).withColumnsRenamed({"component": "root"}))
    crowded = materialize(members.where("blocks > 1").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ones = materialize(crowded.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket"))
    across = materialize(crowded.join(open_ones.hint("merge"), "bucket", "left_semi"))
    if across.head(1):
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        tiles = across.select("*", other.alias("other")).where("other <> block")
        tiles = tiles.select("bucket", F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")).alias("part"), "node", "root")
        joined = materialize(components(edges.unionAll(compared(tiles))).withColumnsRenamed({"component": "root"}))
    release(spark, members, wanted, crowded, open_ones, across)
    return found.join(joined.hint("merge"), "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, reach: int = 7, tables: int = 1, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar(): that of its smallest id (of rows that repeat that id, one). All columns stay.

    Rows of different components stay even if they share an id. Rows of null ids can't be named in a component's stead and stay.
    """
    found = similar(docs, id_col, text_col, words, reach, tables, least)
    first = found.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    chosen = first.select(F.col("kept.doc_id").alias("__kept"), F.col("kept.text_hash").alias("__hash")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn("__text", F.xxhash64(f"`{text_col}`"))
    named = hashed.join(chosen, (F.col(f"`{id_col}`") == F.col("__kept")) & (F.col("__text") == F.col("__hash")), "left_semi").dropDuplicates([id_col, "__text"]).select(*columns)
    return named.unionAll(docs.where(F.col(f"`{id_col}`").isNull()))
