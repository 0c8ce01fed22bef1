"""Documents ranked by the overlap of their line vectors with one document's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import linevec


def line_vectors(lines: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """(group, run, vector) of lines that stand as rows: group, order columns, kind, number, last and marked, as in linevec.vectors.

    Running windows read a group's lines in order and keep only the last of them; a run's codes are gathered, not a group's lines.
    A null number or last opens no run and adds no code. Groups whose first run has no codes are left out, as are groups of a null key.
    """
    w = Window.partitionBy(group).orderBy(*order)
    so_far, text = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.col("kind") == "text"
    known = lines.where(F.col(group).isNotNull()).withColumn("__last", F.when(text, F.col("last").cast("long")))
    before = F.coalesce(F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    opened = known.withColumn("__opens", F.coalesce(before >= F.col("__last"), F.lit(False)).cast("int"))
    runs = opened.withColumn("run", F.sum("__opens").over(so_far)).withColumn("__fresh", (F.col("__opens") == 1) | (F.row_number().over(w) == 1))
    codes = runs.select(group, *order, "run", linevec.code(F.col("kind"), F.col("number"), F.col("__last"), F.col("marked"), F.col("__fresh")).alias("code"))
    made = codes.groupBy(group, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "code"))).alias("c")).select(group, "run", F.array_join("c.code", "").alias("vector"))
    first = F.first("vector").over(Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return made.withColumn("__first", first).where("__first <> ''").drop("__first")


def scores(long: DataFrame, id_col: str, candidate: int | str, vector: str = "vector", block: int = 256) -> DataFrame:
    """id, score, weighted of every other document that has vectors; long: a row for each vector of a document.

    Equal vectors are scored once. The candidate's distinct vectors are dealt into blocks of about `block`, and each other distinct vector meets each block in an
    equi-join, so neither side is collected or put into the plan; the scores then return by an equi-join and a maximum.
    """
    rows = long.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).distinct()
    own, others = rows.where(F.col("id") == candidate).select("vector"), rows.where(F.col("id") != candidate)
    n = max(1, -(-own.count() // block))
    blocks = own.groupBy(F.pmod(F.xxhash64("vector"), F.lit(n)).alias("block")).agg(F.collect_set("vector").alias("own"))
    asked = others.select("vector").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    pairs = asked.join(blocks, "block").select("vector", F.explode(F.transform("own", lambda m: linevec.overlap(m, F.col("vector")))).alias("o"))
    scored = pairs.groupBy("vector").agg(F.max("o.score").alias("score"), F.max("o.weighted").alias("weighted"))
    best = others.join(scored, "vector", "left").groupBy("id").agg(F.max("score").alias("score"), F.max("weighted").alias("weighted"))
    return best.na.fill(0, ["score", "weighted"])


def ranking(found: DataFrame, by: str, most: int = 15) -> DataFrame:
    """The first `most` by one of the scores; ties to the smaller id."""
    return found.orderBy(F.desc(by), "id").limit(most).select("id", F.col(by).alias("score"))
