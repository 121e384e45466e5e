"""Input files as tables of fingerprints, read by the executors from any store that Spark reaches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.plans.tables import settings, tasks, written

SIDE = ".sha256"
FINGERPRINTS = "path string, hash string, mtime long, size long"
#: A task takes up some thousand small files, and a listing of many folders is some hundred tasks.
SMALL_FILES = {"spark.sql.files.openCostInBytes": "16k", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "1000"}
#: Files above LARGE bytes are hashed in ranges of RANGE bytes: SHA-256 over the ranges' SHA-256 in order.
LARGE, RANGE = 1 << 28, 1 << 26
#: Files that are named one by one in a read; a plan reads so many at most.
NAMED = 50_000


def literal(path: str) -> str:
    """A path that a reader doesn't take for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def reader(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        found = found.option("pathGlobFilter", pattern)
    df = found.load([literal(p) for p in paths])
    return df.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def listed(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """(path, mtime, size) of files, those of folders at any depth; no file is opened."""
    return reader(spark, list(paths), pattern).select("path", "mtime", "size")


def stored_tables(spark: SparkSession, root: str) -> DataFrame:
    """(output_name): folders below ``root``, by their path from it on, that hold a table that Spark has written, or tables.

    One recursive listing, whose folders executors take up once there are many; of each table its first part alone is
    seen, which Spark writes for an empty one as well, and nothing is opened.
    """
    with settings(spark, SMALL_FILES):
        found = listed(spark, root, pattern="part-00000*").select(F.expr(f"substring(path, {len(qualified(spark, root)) + 2})").alias("name"))
        steps = F.split("name", "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
        return written(found.where(F.size(steps) > 1).select(F.explode(folders).alias("output_name")).distinct(), "tables")


def side_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, said, side_mtime) of the files that have a ``<file>.sha256`` beside them in the same folder."""
    sides = reader(spark, list(paths), f"*{SIDE}")
    return sides.select(F.expr(f"left(path, length(path) - {len(SIDE)})").alias("path"), F.lower(F.trim(F.decode("content", "UTF-8"))).alias("said"), F.col("mtime").alias("side_mtime"))


def put(rows: DataFrame, folder: str) -> int:
    """Write a file a row of ``rows`` (name, text), the text as a line, and count them; names are there once.

    Files are dealt by their names to as many folders as there are tasks, so that a listing reads few folders. A task that
    runs again writes the same files.
    """
    top = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", top) if ":" in top else f"file://{top}")
        made = set()
        for batch in batches:
            for at, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at not in made:
                    system.create_dir(f"{place}/{at}", recursive=True)
                    made.add(at)
                with system.open_output_stream(f"{place}/{at}/{name}") as f:
                    f.write(f"{text}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    n = tasks(rows.sparkSession)
    by_folder = rows.select(F.pmod(F.xxhash64("name"), F.lit(n)).alias("at"), "name", F.coalesce("text", F.lit("")).alias("text")).repartition(n, "at")
    return by_folder.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def hashed_in_ranges(files: DataFrame) -> DataFrame:
    """(path, hash, mtime, size) of large files, a range a row, so that no task holds a file; read by pyarrow's file systems."""
    step = RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path) if ":" in path else f"file://{path}")
                done = hashlib.sha256()
                with system.open_input_file(name) as f:
                    f.seek(at)
                    left = step
                    while left and (block := f.read(min(left, 1 << 22))):
                        done.update(block)
                        left -= len(block)
                out.append(done.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["path", "at", "part"])

    starts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("at"))
    parts = starts.repartition("path", "at").mapInArrow(run, "path string, at long, part string")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return files.select("path", "mtime", "size").join(parts.groupBy("path").agg(F.sha2(ordered, 256).alias("hash")), "path").select("path", "hash", "mtime", "size")


def hashed(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(path, hash, mtime, size) of what ``reader`` gives; each file is read once, large ones in ranges.

    ``names`` (size): a stored listing that tells whether any is large, which takes a look at each file otherwise."""
    small = files.where(F.col("size") <= LARGE).select("path", F.sha2("content", 256).alias("hash"), "mtime", "size")
    large = files.where(F.col("size") > LARGE).select("path", "mtime", "size")
    return small if (large if names is None else names.where(F.col("size") > LARGE)).isEmpty() else small.unionByName(hashed_in_ranges(large))


def hashed_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, hash, mtime, size) of named files."""
    parts = [hashed(reader(spark, paths[i : i + NAMED])) for i in range(0, len(paths), NAMED)]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], FINGERPRINTS))


def fingerprints(spark: SparkSession, paths: list[str], history: DataFrame | None = None) -> DataFrame:
    """(path, hash, mtime, size) of files, those of folders at any depth: the SHA-256 of each file's bytes.

    Where ``history`` (path, hash, mtime, size) has the same size and modification second, its hash is taken and the file
    isn't opened: a change within that second that keeps the size goes unseen. ``<file>.sha256`` is trusted in place of
    the file's bytes, also where it is named by itself; one that is older than its file, or doesn't hold 64 hex digits,
    fails. The names of the files to open pass through the driver, which lists them in any case.
    """
    with settings(spark, SMALL_FILES):
        names, sides = written(listed(spark, *paths), "names"), None
        side = F.col("path").endswith(SIDE)
        if not names.where(side).isEmpty():
            sides = written(side_hashes(spark, *paths), "sides")
        known = with_sides(names.where(~side), sides)
        if history is None:  # all files but those with a side are opened
            others = reader(spark, paths).where(~side)
            fresh = hashed(others if sides is None else others.join(sides.select("path"), "path", "left_anti"), names)
        else:
            old = history.select("path", F.col("hash").alias("was"), "mtime", "size").dropDuplicates(["path", "mtime", "size"])
            known = written(known.join(old, ["path", "mtime", "size"], "left").select("path", F.coalesce("hash", "was").alias("hash"), "mtime", "size"), "known")
            fresh = hashed_by_name(spark, [r["path"] for r in known.where("hash is null").select("path").collect()])
        return known.where("hash is not null").unionByName(fresh)


def with_sides(names: DataFrame, sides: DataFrame | None) -> DataFrame:
    """(path, hash, mtime, size): hash as a side file says, null where there is none; a bad side fails."""
    if sides is None:
        return names.select("path", F.lit(None).cast("string").alias("hash"), "mtime", "size")
    bad = F.when(F.col("side_mtime") < F.col("mtime"), "older than its file").when(~F.col("said").rlike("^[0-9a-f]{64}$"), "not a SHA-256")
    said = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("side file "), F.col("path"), F.lit(": "), bad))).otherwise(F.col("said"))
    return names.join(sides, "path", "left").withColumn("hash", F.when(F.col("said").isNotNull(), said).cast("string")).select("path", "hash", "mtime", "size")


def within(spark: SparkSession, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(root, name, the columns of ``files``): files that are ``roots`` (root) or lie below one, by an equi-join.

    name: the path from the root on, empty for the root itself.
    """
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return files.withColumn("root", F.explode(above)).join(roots.select("root").distinct(), "root").withColumn("name", F.expr("substring(path, length(root) + 2)"))


def root_digests(found: DataFrame) -> DataFrame:
    """(root, digest) over the (name, hash) pairs of ``within``, whatever their order: a count and four wide sums.

    Sums are taken before the shuffle, so a folder of any number of files is one row a task.
    """
    one = F.sha2(F.to_json(F.struct("name", "hash")), 256)
    sums = [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return found.groupBy("root").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))


def notebook_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash): of a notebook's markdown and code cells only, so that runs and outputs don't change it."""
    schema = "cells array<struct<cell_type string, source string>>"
    text = reader(spark, [path]).select("path", F.decode("content", "UTF-8").alias("text"))
    cells = F.filter(F.from_json("text", schema)["cells"], lambda c: c["cell_type"].isin("markdown", "code"))
    body: Column = F.to_json(F.transform(cells, lambda c: F.struct(c["cell_type"].alias("t"), c["source"].alias("s"))))
    return text.select("path", F.sha2(F.coalesce(body, F.lit("")), 256).alias("hash"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as readers name it, with its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def tables_as_text(tables: dict[str, DataFrame], path: str) -> None:
    """Tab-separated dumps with headings, a folder for each named table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}" if name else path)
