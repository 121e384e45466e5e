"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.llm.shared import quoted, stage

#: Turn numbers to a block: prefix hashes of a conversation are summed block by block, and rendered so.
BLOCK = 256


def turn_hashes(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, pos, role, text, p1, p2): the turn's place from 0, and rolling hashes of the turns up to it.

    A prefix hash is the xor of its turns' hashes, each of place, role and text, in two 64-bit lanes. Places and prefix
    hashes are made within blocks of turn numbers and then moved by what the blocks before hold, so a conversation with
    any share of all turns is no single task.
    """
    rows = df.select(quoted(conv).alias("conv"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = rows.where("conv is not null and turn is not null").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    one = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("pos", F.row_number().over(one).cast("long") - 1).join(starts, ["conv", "block"]).withColumn("pos", F.col("pos") + F.col("start"))
    placed = placed.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit("second"), "text", "role", "pos"))
    return placed.drop("start")


def prefixes(placed: DataFrame) -> DataFrame:
    """Add p1 and p2 to what ``turn_hashes`` gives."""
    running = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    base = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).cast("long").alias(f"b{k}") for k in (1, 2)])
    held = placed.select("conv", "block", "pos", *[F.bit_xor(f"h{k}").over(running).alias(f"r{k}") for k in (1, 2)]).join(base, ["conv", "block"])
    return held.select("conv", "pos", *[F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"p{k}") for k in (1, 2)])


def maximal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, kept): the stored turns, and one row (conv, n_turns, n_copies) per conversation that no other one extends.

    Of equal conversations the smallest id is kept. A conversation that equals the first turns of a longer one is dropped.
    Null roles and texts count as empty; rows without conversation or turn number are no turns; a repeated row counts
    once; turns that share a number stand in the order of role and text. An empty table stays empty.
    """
    placed = stage(turn_hashes(df, conv, turn, role, text), "turns")
    hashed = stage(prefixes(placed), "turn-prefixes")
    whole = hashed.groupBy("conv").agg(F.max("pos").alias("last"), F.max_by("p1", "pos").alias("p1"), F.max_by("p2", "pos").alias("p2"))
    kinds = whole.groupBy("last", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    # prefixes that are not their conversation's end, each once however many conversations begin so
    inner = hashed.join(whole.select("conv", "last"), "conv").where("pos < last").groupBy(F.col("pos").alias("last"), "p1", "p2").agg(F.lit(1).alias("one")).drop("one")
    kept = kinds.join(inner, ["last", "p1", "p2"], "left_anti")
    return placed, kept.select("conv", (F.col("last") + 1).alias("n_turns"), "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies, part, rendered): a kept conversation's text, in parts of ``BLOCK`` places at most.

    A conversation is its parts put together in their order: a very long one is no single value. Empty tables stay empty.
    """
    parts = placed.join(kept, "conv", "left_semi").withColumn("part", F.floor(F.col("pos") / BLOCK))
    turns = F.array_sort(F.collect_list(F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("t"))))
    texts = parts.groupBy("conv", "part").agg(F.array_join(F.transform(turns, lambda x: x["t"]), "").alias("rendered"))
    return texts.join(kept, "conv").select("conv", "n_turns", "n_copies", "part", "rendered")
