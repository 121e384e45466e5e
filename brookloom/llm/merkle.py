"""Merkle manifests of datasets: binary trees over groups of rows, with a proof for each row.

Rows are ranked within their group by one range-partitioned sort. Aligned blocks of 2^8 nodes are whole subtrees: executors
take them as Arrow buckets of many blocks to DuckDB, which builds the levels by ordered string_agg and sha256. Block roots
are the next round's nodes, so each round is a 256th of the one before, and no group is ever in one task. A row's proof is
that within its block, then those of the blocks above, joined on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from brookloom.llm.shared import bucket_count, quoted, ship, stage, unused

#: Levels of a block; rows that are handed to DuckDB at once, but for the end of a block.
LEVELS, BUCKET_ROWS = 8, 16_384
STEP = StructType([StructField("left", BooleanType()), StructField("digest", StringType())])


class Forest(NamedTuple):
    """nodes: the rows with root and proof (array of (left, digest), a level each, no digest where a run has one node);
    roots: (group, root)."""

    nodes: DataFrame
    roots: DataFrame


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """SHA-256 of a row's fields, whichever are null or empty: neighbours can't be mixed up."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def ranked(nodes: DataFrame, group: str, order: list[str], rank: str, size: str) -> DataFrame:
    """``nodes`` (stored) with their rank from 0 within the group in ascending ``order``, and the group's size.

    One range-partitioned sort over (group, order): partitions are alike in size whatever the groups' sizes. A number
    that each stored row gets breaks ties, so rows that are alike in all columns may be any share of the table.
    """
    row, at, part, low, n, base = unused(nodes, "_row", "_at", "_part", "_low", "_n", "_base")
    numbered = stage(nodes.withColumn(row, F.monotonically_increasing_id()), "merkle-rows")
    keys = [quoted(c) for c in (group, *order, row)]
    dealt = numbered.repartitionByRange(bucket_count(nodes.sparkSession, numbered.count()), *keys).sortWithinPartitions(*keys)
    # a partition's number and the row's place in it
    placed = stage(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)).drop(row), "merkle-ranks")
    marks = placed.groupBy(quoted(group), part).agg(F.min(at).alias(low), F.count(F.lit(1)).alias(n))
    own = Window.partitionBy(quoted(group))
    before = F.coalesce(F.sum(n).over(own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = stage(marks.select(quoted(group), part, low, before.alias(base), F.sum(n).over(own).alias(size)), "merkle-marks")
    return placed.join(marks, [group, part]).withColumn(rank, F.col(base) + F.col(at) - F.col(low)).drop(at, part, low, base)


class Blocks:
    """DuckDB, in memory and on one thread, over buckets of whole blocks."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})

    def proofs(self, block: np.ndarray, place: np.ndarray, top: np.ndarray, digest: pa.Array) -> pa.Table:
        """(proof, root) of nodes at ``place`` in blocks with ``top`` levels, in the order given."""
        db = self.db
        given = pa.table({"i": pa.array(np.arange(len(block))), "b": pa.array(block), "p": pa.array(place), "top": pa.array(top), "h": digest})
        db.register("given", given)
        db.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT b, p, top, h FROM given")
        for k in range(1, LEVELS + 1):
            db.execute(f"CREATE OR REPLACE TEMP TABLE l{k} AS SELECT b, p >> 1 AS p, any_value(top) AS top, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l{k - 1} WHERE top >= {k} GROUP BY b, p >> 1")
        roots = " UNION ALL ".join(f"SELECT b, h FROM l{k} WHERE top = {k}" for k in range(LEVELS + 1))
        steps = ", ".join(f"struct_pack(\"left\" := (g.p >> {k}) & 1 = 1, digest := s{k}.h)" for k in range(LEVELS))
        joins = " ".join(f"LEFT JOIN l{k} s{k} ON s{k}.b = g.b AND s{k}.p = xor(g.p >> {k}, 1)" for k in range(LEVELS))
        found = db.sql(f"WITH roots AS ({roots}) SELECT list_slice([{steps}], 1, g.top) AS proof, r.h AS root FROM given g JOIN roots r ON r.b = g.b {joins} ORDER BY g.i").to_arrow_table()
        db.unregister("given")
        return found


def block_round(nodes: DataFrame, group: str, rank: str, size: str, digest: str, proof: str, root: str) -> DataFrame:
    """``nodes`` with the proof within their block and the block's root, stored. Equal blocks never meet in one task by
    more than a bucket's rows: a block is 256 nodes."""
    ship(nodes.sparkSession)
    schema = StructType([*nodes.schema.fields, StructField(proof, ArrayType(STEP)), StructField(root, StringType())])
    at = [nodes.columns.index(c) for c in (rank, size, digest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, mask = Blocks(), (1 << LEVELS) - 1

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ranks, sizes = (rows.column(k).to_numpy() for k in at[:2])
            place = ranks & mask
            top = np.searchsorted(1 << np.arange(LEVELS), sizes).astype(np.int64)  # levels of a tree of so many nodes, LEVELS at most
            found = engine.proofs(np.cumsum(place == 0), place, top, rows.column(at[2]))
            kind = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))
            made = pa.Table.from_arrays([*rows.columns, found.column("proof").cast(kind), found.column("root").cast(pa.string())], schema.names)
            yield from made.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUCKET_ROWS:
                rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero((rows.column(at[0]).to_numpy() & mask) == 0)[-1])  # the last block may go on
                if last:
                    yield from out(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held and any(b.num_rows for b in held):
            yield from out(pa.Table.from_batches(held))

    (block,) = unused(nodes, "_block")
    dealt = nodes.withColumn(block, F.shiftright(rank, LEVELS)).repartition(quoted(group), block).sortWithinPartitions(quoted(group), rank).drop(block)
    return stage(dealt.mapInArrow(run, schema), "merkle-round")


def forest(nodes: DataFrame, group: str, order: list[str], digest: str) -> Forest:
    """A tree over each group's rows, ascending by ``order``, then ``digest``; its nodes are hashed in runs of two.

    ``nodes``: a group (text without nulls), the columns of ``order`` (nulls first) and a hex digest; other columns stay,
    root and proof are added. While a level has several nodes, each two consecutive ones, and a last single one, become
    the SHA-256 of their digests. A group of one row has it as its root and an empty proof. Repeated rows are leaves of
    their own. An empty table gives empty tables. The driver sees the largest group's size alone.
    """
    nodes = nodes.drop("root", "proof")
    rank, size = unused(nodes, "_rank", "_size")
    rounds = []
    now = ranked(nodes, group, [*order, digest], rank, size)
    while True:
        stored = block_round(now, group, rank, size, digest, "proof", "root")
        rounds.append(stored)
        if (stored.agg(F.max(size)).first()[0] or 0) <= 1 << LEVELS:
            break
        above = stored.where(F.col(rank).bitwiseAND((1 << LEVELS) - 1) == 0)
        after = F.ceil(F.col(size) / (1 << LEVELS)).cast("long")
        now = above.select(quoted(group), F.shiftright(rank, LEVELS).alias(rank), F.when(after > 1, after).otherwise(1).alias(size), F.col("root").alias(digest))
    # a round's proofs and roots go down to the rows of the one below
    up, outer, top = unused(nodes, "_up", "_outer", "_top")
    full = rounds[-1]
    for stored in reversed(rounds[:-1]):
        ends = full.select(quoted(group), F.col(rank).alias(up), F.col("proof").alias(outer), F.col("root").alias(top))
        joined = stored.withColumn(up, F.shiftright(rank, LEVELS)).join(ends, [group, up])
        full = joined.withColumn("proof", F.concat("proof", outer)).withColumn("root", F.col(top)).drop(up, outer, top)
    roots = rounds[-1].where(F.col(rank) == 0).select(quoted(group), "root")
    return Forest(full.drop(rank, size), roots)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""

    def step(below: Column, s: Column) -> Column:
        run = F.when(s["digest"].isNull(), below).when(s["left"], F.concat(s["digest"], below)).otherwise(F.concat(below, s["digest"]))
        return F.sha2(run, 256)

    return F.aggregate(proof, digest, step)


def siblings(proof: Column) -> Column:
    """A proof's digests in order, as one text."""
    return F.array_join(F.transform(proof, lambda s: s["digest"]), "")


def manifest(df: DataFrame, leaf_column: str, group: str, order: list[str]) -> DataFrame:
    """``df`` with subroot (of its group's tree), root (over all groups' subroots) and proof, from the leaf to the root.

    Groups come in ascending order of their UTF-8 bytes, null first. ``df`` has its leaves' digests in ``leaf_column``;
    what ``forest`` says of nulls, repeats and empty tables holds.
    """
    key, all_of, outer, top = unused(df, "_key", "_all", "_outer", "_top")
    own = df.drop("subroot", "root", "proof").withColumn(key, F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit("")))
    inner = forest(own, key, order, leaf_column)
    over = forest(stage(inner.roots.select(key, F.col("root").alias("subroot"), F.lit("").alias(all_of)), "subroots"), all_of, [key], "subroot")
    ends = stage(over.nodes.select(key, F.col("root").alias(top), F.col("proof").alias(outer)), "outer-proofs")
    joined = inner.nodes.withColumnRenamed("root", "subroot").join(ends, key)
    return joined.withColumn("proof", F.concat("proof", outer)).withColumn("root", F.col(top)).drop(key, outer, top)
