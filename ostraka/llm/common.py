"""Shared helpers: tables, intermediate results in the cluster's shared folder, vectors, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """How many rows go to a Python worker at once: texts and pages are long, so few of them keep the memory of both sides small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset only a local master may go on, with a temporary one: executors elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ostraka-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it again: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.table_path = path
    return written


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Delete the tables of materialize() that nothing reads any more, and let Spark delete the shuffle files of finished steps; without a JVM collection it does so only now and then."""
    import gc

    for df in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_order(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """df with each row's place (long, from 0) in the order of keys, written to the shared folder: the place within its range of keys, after all rows of the ranges before. Only the ranges' counts reach the driver; keys have to tell rows apart, if a retried task is to number them alike."""
    spark = df.sparkSession
    ranges = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), 33)
    counts = sorted(tuple(r) for r in ranges.groupBy(part.cast("int").alias("__part")).count().collect())
    starts, total = [], 0
    for at, n in counts:
        starts.append((at, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts, "__part int, __before long"))
    return ranges.withColumn("__part", part.cast("int")).join(before, "__part").withColumn(name, F.col("__before") + F.col(name).bitwiseAND(F.lit(2**33 - 1))).drop("__part", "__before")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns an operator reads, so that extra columns never clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def in_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns."""
    target = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def by_block(left: DataFrame, right: DataFrame, function: Callable[[pa.Table, pa.Table], dict | None], schema: str | T.StructType) -> DataFrame:
    """function(rows of left, rows of right) for each value of the column block of left."""
    target = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = function(a, b) if a.num_rows else None
        return target.empty_table() if found is None else pa.table([pa.array(found[f.name], f.type) if not isinstance(found[f.name], (pa.Array, pa.ChunkedArray)) else found[f.name].cast(f.type) for f in target], schema=target)

    own = right.withColumnRenamed("block", "__block")  # both may come from one table
    return left.groupBy("block").cogroup(own.groupBy("__block")).applyInArrow(run, schema)


class Memory:
    """Answers for words met so far, in two generations of at most about `most` words and `room` bytes each: words that come again stay, the many that come once go."""

    def __init__(self, answer: Callable[[list[str]], Iterable[bytes]], most: int = 1 << 18, room: int = 1 << 25):
        self.answer, self.most, self.room = answer, most, room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def of(self, words: set[str]) -> dict[str, bytes]:
        """A dict that holds the answers for all of words; those not remembered are asked for together."""
        if len(self.young) > self.most or self.held > self.room:
            self.old, self.young, self.held = self.young, {}, 0
        fresh = []
        for word in words.difference(self.young):
            if (known := self.old.get(word)) is None:
                fresh.append(word)
            else:
                self.young[word] = known
                self.held += len(word) + len(known)
        if fresh:
            found = list(self.answer(fresh))
            self.young.update(zip(fresh, found, strict=True))
            self.held += sum(map(len, fresh)) + sum(map(len, found))
        return self.young


# Vectors


def modal_size(df: DataFrame, column: str) -> int:
    """The commonest length of the arrays in column (ties: the larger); 0 if there are none."""
    row = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return int(row["n"]) if row else 0


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors (of that size, all components finite) and their components as doubles."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(at)).flatten()
    values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
    good = np.isfinite(values).all(axis=1)
    return at[good], values[good]


def query_rows(df: DataFrame, id_col: str, vec_col: str, size: int, every: int) -> DataFrame:
    """(id, vector) of the rows whose id is divisible by `every`, written to the shared folder. Rows that repeat an id count once, with the smallest vector."""
    rows = df.where((F.col(id_col) % every == 0) & (F.size(vec_col) == size))
    return materialize(rows.groupBy(F.col(id_col).alias("id")).agg(F.min(vec_col).alias("vector")))


def on_grid(queries: DataFrame, candidates: DataFrame, search: Callable[[pa.Table, pa.Table], dict | None], schema: str, block: int, part: int) -> DataFrame:
    """search(queries, candidates) in each cell of a grid of query blocks (about `block` rows) and candidate parts (about `part` rows), all in one job.

    Rows are dealt by their place in the scan, so repeated ids and vectors spread out; a cell's two tables are what a task holds.
    Each query goes to all parts and each candidate to all blocks: that is the stated query set against all rows.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    n = candidates.count()
    parts = max(1, -(-n // part), min(spark.sparkContext.defaultParallelism, n // 2048))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("__block", dealt(blocks)).withColumn("__part", every(parts))
    right = candidates.withColumn("__part", dealt(parts)).withColumn("__block", every(blocks))
    keys, target = ["__block", "__part"], to_arrow_schema(T.StructType.fromDDL(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = search(a, b) if a.num_rows and b.num_rows else None
        return target.empty_table() if found is None else pa.table([pa.array(found[f.name], f.type) for f in target], schema=target)

    left, right = (x.repartition(blocks * parts, *keys).groupBy(*keys) for x in (left, right))
    return left.cogroup(right).applyInArrow(run, schema)


class Best:
    """Running k best candidates of each query, of distinct ids: smallest key first, ties to the smaller id."""

    def __init__(self, queries: int, k: int, dtype: type, worst: float):
        self.k, self.worst = k, worst
        self.keys = np.full((queries, 0), worst, dtype)
        self.ids = np.zeros((queries, 0), np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, barred: np.ndarray) -> None:
        """keys, ids: a row for each query; barred: candidates that don't count."""
        keys = np.concatenate([self.keys, np.where(barred, self.worst, keys)], axis=1)
        ids = np.concatenate([self.ids, ids], axis=1)
        order = np.lexsort((ids, keys), axis=1)
        keys, ids = np.take_along_axis(keys, order, 1), np.take_along_axis(ids, order, 1)
        kept_keys = np.full((len(keys), self.k), self.worst, keys.dtype)
        kept_ids = np.zeros((len(keys), self.k), np.int64)
        for i in range(len(keys)):
            _, first = np.unique(ids[i], return_index=True)
            first.sort()
            first = first[keys[i][first] != self.worst][: self.k]
            kept_keys[i, : len(first)], kept_ids[i, : len(first)] = keys[i][first], ids[i][first]
        self.keys, self.ids = kept_keys, kept_ids

    def rows(self, query_ids: np.ndarray) -> dict:
        at = np.nonzero(self.keys != self.worst)
        return {"query_id": query_ids[at[0]], "vec_id": self.ids[at], "key": self.keys[at]}


# Connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that can be reached, by alternating large-star and small-star rounds.

    Each round is two aggregations and two joins; its edges are written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        near = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
        # written before it is joined, so that Spark can split the edges of a hub over many tasks
        least = materialize(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m")))
        tied = near.join(least.hint("merge"), "a")
        if both:
            out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        out = materialize(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        release(spark, least)
        return out

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    last = mark(now)
    for _ in range(rounds):
        if not last[0]:
            break
        large = star(now, True)
        before, now = now, star(large, False)
        release(spark, before, large)
        mine = mark(now)
        if mine == last:
            break
        last = mine
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
