"""Sharding by rendezvous hashing: each record goes to the shard that draws the best lot for its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import in_order, materialize

#: Hex digits of a hash that make a draw: as many as a double holds exactly.
DIGITS = 13


def draws(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<draw, shard>> of a record's draw at each shard: log(u) / weight, with u in (0, 1] from the MD5 of `key:shard`.

    A shard's draw depends on the key, the shard's number and its weight alone, so other shards never move it. A null key draws as the empty string; a shard of weight 0 draws nothing.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights have to be 0 or above, and one of them above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def draw(weight: Column, shard: Column) -> Column:
        lot = F.conv(F.left(F.md5(F.concat(name, F.lit(":"), shard.cast("string")).cast("binary")), F.lit(DIGITS)), 16, 10).cast("double")
        return F.struct(F.when(weight > 0, F.log((lot + 1) / F.lit(float(16**DIGITS))) / weight).alias("draw"), (-shard).alias("shard"))

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), draw)


def winner(drawn: Column, shards: int) -> Column:
    """The shard of the greatest draw among the first `shards`, ties to the smaller number."""
    return -F.array_max(F.slice(drawn, 1, shards))["shard"]


def sharded(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 16, added: float = 1.0) -> DataFrame:
    """All columns of df's key and text side as a plan of shards: key, size (bytes of the text plus 1), text_crc32, law (`key`), shard, slot (from 0, gapless in each shard), grown_shard.

    Key and weights alone decide the shard: a shard of twice the weight draws twice the records, and one more shard (of weight `added`: grown_shard) takes records only into itself.
    Slots follow the order of (key, CRC, size) in each shard. They come from one sort by ranges of (shard, key, CRC, size, row), whose counts are added up, so neither a shard nor a key
    that many rows share is gathered in a task.

    A null text has size 1 and the CRC of no bytes. Rows that repeat a key share a shard, those of a null key too, and each has a slot of its own. An empty table gives no rows; other columns are ignored.
    """
    text, n = F.col(f"`{text_col}`").cast("binary"), len(weights)
    bytes_ = F.coalesce(text, F.lit(b""))
    rows = df.select(F.col(f"`{key_col}`").alias(key_col), (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), draws(F.col(f"`{key_col}`"), [*weights, added]).alias("__draws"))
    rows = rows.select(key_col, "size", "text_crc32", winner(F.col("__draws"), n).alias("shard"), winner(F.col("__draws"), n + 1).alias("grown_shard"))
    plan = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    placed = in_order(plan, "shard", key_col, "text_crc32", "size", "__row", name="__place")
    counts = {r["shard"]: r["count"] for r in plan.groupBy("shard").count().collect()}
    before = [sum(counts.get(s, 0) for s in range(shard)) for shard in range(n)]
    slot = F.col("__place") - F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("shard"))
    return placed.select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
