"""Positions, neighbours and running values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import written


def ring(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """previous and next value of each row in its partition, around the ends."""
    w = Window.partitionBy(*partition).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("previous", F.coalesce(F.lag(value).over(w), F.last(value).over(whole))).withColumn("next", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], each: int, total: int, then: Sequence[Column]) -> DataFrame:
    """At most `each` rows of a group, and of those the first `total`."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).drop("__n").orderBy(*then).limit(total)


def segments(df: DataFrame, partition: Sequence[str], order: Sequence[str], number: str) -> DataFrame:
    """segment (from 0): a new one starts where the number is not above the one before."""
    w = Window.partitionBy(*partition).orderBy(*order)
    fresh = F.coalesce((F.col(number) <= F.lag(number).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__f", fresh).withColumn("segment", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def carried(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value seen so far."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def numbered(df: DataFrame, partition: Sequence[str], order: Sequence[str], taken: Column, name: str, prefix: str) -> DataFrame:
    """Ids prefix-n in order for rows that have none, from the greatest taken number on."""
    w = Window.partitionBy(*partition)
    most = F.coalesce(F.max(taken).over(w), F.lit(0))
    at = F.sum(F.when(taken.isNull(), 1).otherwise(0)).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.concat(F.lit(prefix), F.coalesce(taken, most + at).cast("string")))


def placed(df: DataFrame, key: Column, name: str) -> DataFrame:
    """The position of each row in the order of key, from 1: the place within its range of keys, after all rows of the ranges before.

    The key is worked out once, since the ranges' bounds, their rows and the places all read it. Keys and ranges are written to spark.checkpoint.dir; only the ranges' counts reach the driver.
    """
    keyed = written(df.withColumn("__key", key))
    ranges = written(keyed.repartitionByRange("__key").withColumn("__range", F.spark_partition_id()))
    counts = sorted((r["__range"], r["count"]) for r in ranges.groupBy("__range").count().collect())
    before = [(k, sum(n for _, n in counts[:i])) for i, (k, _) in enumerate(counts)]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__range int, __before long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) + F.col("__before")
    return ranges.join(starts, "__range").withColumn(name, place).drop("__range", "__before", "__key")
