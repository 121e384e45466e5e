"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.llm.shared import bucket_count, quoted, ranked, without


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard (int) whose draw for this key is best: weight / -ln(u), u from a hash of key and shard.

    A key's draw for a shard depends on nothing else, so a new shard takes keys only into itself, a removed one gives up
    only its own, and a changed weight moves only the share that it gains or loses. Null keys are one key.
    """
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    draws = []
    for shard, weight in sorted(weights.items()):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        draws.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("draw"), F.lit(shard).alias("shard")))
    return (F.array_max(F.array(*draws)) if len(draws) > 1 else draws[0])["shard"]


def assign(df: DataFrame, key: str, weights: dict[int, float], grown: dict[int, float] | None = None) -> DataFrame:
    """Add shard, and grown_shard under the weights ``grown``; no shuffle. Columns of these names are replaced.

    Rows that repeat a key go to one shard, as do all rows without one: a key that a third of the rows have is a shard of a
    third at least. An empty table stays empty.
    """
    df = without(df, ["shard", "grown_shard"])
    out = df.withColumn("shard", rendezvous(quoted(key), weights))
    return out.withColumn("grown_shard", rendezvous(quoted(key), grown) if grown else F.lit(None).cast("int"))


def slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Add slot: the row's place in its shard, gapless from 0; a shard's rows are dealt over many tasks.

    ``rows``: about how many rows there are, from which the buckets follow. Rows alike in ``order`` get any order. A column
    named slot is replaced. An empty table stays empty.
    """
    return ranked(without(df, ["slot"]), ["shard"], order, bucket_count(df.sparkSession, rows), "slot")
