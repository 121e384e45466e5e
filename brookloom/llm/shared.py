"""Helpers that several operators need: staged tables, gapless ranks of hot groups, connected components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where the session names none (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        app = spark.sparkContext.applicationId
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="brookloom-")
        found = _own_dirs[app]
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once an application: its Python functions are pickled by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="brookloom-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brookloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    ship(spark)
    path = stage_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in _scratch:
        made.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Staged tables that are made inside are deleted at its end, but for those that were appended to what it gives.

    Results that read them have to be stored by then.
    """
    made: list[DataFrame] = []
    kept = list(keep)
    _scratch.append(made)
    try:
        yield kept
    finally:
        _scratch.remove(made)
        held = {df.__dict__.get("_staged_at") for df in kept}
        drop_stage(*[df for df in made if df._staged_at not in held])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "2m") -> Iterator[None]:
    """Arrow batches of ``rows`` rows and ``size`` bytes at most for what is run inside; a longer row is a batch of its own."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def drop_stage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = df.__dict__.get("_staged_at")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, rows: int, per_bucket: int = 500_000) -> int:
    """Buckets that hold ``per_bucket`` rows at most on average, and keep all tasks of a shuffle busy."""
    return max(parallelism(spark), math.ceil(rows / per_bucket))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column of that name, for columns that come and go."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, group: list[str], order: list[str], buckets: int, out: str = "rank") -> DataFrame:
    """Add a gapless rank from 0 within each group (no nulls in ``group``), for groups that may hold any share of all rows.

    Rows of a group go to hashed buckets; a bucket is numbered in one task, and the counts of the buckets before it
    (one row per group and bucket) are added. The order is by bucket, then by ``order``.
    """
    bucket, n, base, own = unused(df, "_bucket", "_n", "_base", "_within")
    held = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = held.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    within = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)).cast("long")
    return held.withColumn(own, within).join(bases, [*group, bucket]).withColumn(out, F.col(base) + F.col(own) - 1).drop(bucket, own, base)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns of the input that would clash with columns an operator adds."""
    clash = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in clash])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of undirected ``edges(a long, b long)``; the component is its smallest node.

    Alternating large-star and small-star steps: each keeps connectivity and moves edges towards the smallest node. They
    settle within the square of the logarithm of the edges, beyond which it fails.
    Only minima are aggregated, so a node with very many edges is summed before the shuffle; nothing reaches the driver
    but one checksum a round.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    for _ in range(20 + now.count().bit_length() ** 2):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lows2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows2.select("u", F.col("m").alias("v")))
        after = stage(small.where("u <> v").distinct(), name)
        mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_stage(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
