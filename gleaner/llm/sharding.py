"""Rendezvous hashing: rows go to weighted shards by a stable record key.

Every (key, shard) pair has a pseudo-random number u in (0, 1); the shard with the greatest
weight / -ln(u) takes the row. A new shard only ever wins rows for itself, a lost one gives
up only its own, and a changed weight moves rows to or from that shard alone. Nothing is
shuffled to decide a shard: it is an expression of the row's own key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 52 bits of a digest fit a double exactly.
_HEX = 13
_UNIT = float(1 << 52)
# Rows of a shard are numbered in 16 ** 3 blocks of the key's digest.
_BLOCK_HEX = 3


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) fixed by the key and the shard's number."""
    digest = F.md5(F.concat_ws(":", F.lit(str(shard)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 0.5) / _UNIT


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that takes a key: an int from 0 to len(weights) - 1.

    Weights must be positive. A null key counts as the empty string. Equal scores go to the lower number.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, and one at least")
    return winner([bid(key, i, w) for i, w in enumerate(weights)])


def bid(key: Column, shard: int, weight: float = 1.0) -> Column:
    """What a shard offers for a key; `winner` compares bids."""
    u = unit(key, shard)
    return F.struct((F.lit(float(weight)) / -F.ln(u)).alias("score"), u.alias("u"), F.lit(-shard).alias("minus"))


def winner(bids: Sequence[Column]) -> Column:
    return (-(F.greatest(*bids) if len(bids) > 1 else bids[0])["minus"]).cast("int")


def numbered(rows: DataFrame, shard: str, key: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    Each shard is numbered in 4096 blocks of the key's digest, so no task sorts a whole shard. The one broadcast
    holds a count for each shard and block: 4096 x shards rows at any size of input. Rows alike in `key` and
    `order` are interchangeable. All columns are kept; the new name must be free.
    """
    if out in rows.columns:
        raise ValueError(f"column exists already: {out}")
    block = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, _BLOCK_HEX)
    # The row goes along whole, so its own names cannot meet those used here.
    kept = rows.columns
    rows = rows.select(F.struct("*").alias("_all"), *[F.col(c) for c in dict.fromkeys([shard, key, *order])], block.alias("_block"))
    counts = rows.groupBy(F.col(shard).alias("_shard"), F.col("_block").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_shard", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(shard, "_block").orderBy(key, *order)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(base), (F.col(shard) == F.col("_shard")) & (F.col("_block") == F.col("_of")))
        .select(*[F.col("_all")[c].alias(c) for c in kept], (F.col("_base") + F.col("_row") - 1).cast("long").alias(out))
    )


def assign(docs: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Add `shard`, and `grown_shard` for a second list of weights that begins with the first.

    Null keys share one shard; repeated rows stay together. An empty table gives an empty table. All columns are
    kept; the new names must be free.
    """
    if clash := ({"shard"} | ({"grown_shard"} if grown is not None else set())) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    k = F.col("_key")
    every = list(grown or weights)
    bids = [f"_bid{i}" for i in range(len(every))]
    if grown is not None and list(grown[: len(weights)]) != list(weights):
        raise ValueError("the grown shards must begin with the present ones")
    kept = docs.columns
    start = docs.select(F.struct("*").alias("_all"), F.col(key).alias("_key"))
    out = reduce(lambda d, i: d.withColumn(bids[i], bid(k, i, every[i])), range(len(every)), start)
    out = out.withColumn("shard", winner([F.col(b) for b in bids[: len(weights)]]))
    if grown is not None:
        out = out.withColumn("grown_shard", winner([F.col(b) for b in bids]))
    new = ["shard"] + (["grown_shard"] if grown is not None else [])
    return out.select(*[F.col("_all")[c].alias(c) for c in kept], *new)
