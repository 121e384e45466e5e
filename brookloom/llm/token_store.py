"""Content-addressed store of token ids.

Rolling hashes cut id streams into chunks; a chunk is stored once under its SHA-256; documents are recipes of chunk
digests; manifests hold a Merkle tree over chunks, documents, parts and the store, by which a reader verifies all.

Layout below the store's path, each a Parquet dataset that Spark commits as a whole:
  data       of kind chunk: key (digest), n (ids), body (ids, little-endian, 2 bytes each if all are below 65536, else 4);
             of kind recipe: the documents as they were cut
  recipes    part, doc_id, row, n_tokens, digests, sizes: ascending by doc_id within and across parts
  manifest   part, documents, ids, root (SHA-256 over the documents' hashes in order)
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookloom.llm.shared import quoted, ship, small_batches
from brookloom.llm.tokens import encoder

#: Ids that the rolling hash sees; least, usual and most ids of a chunk.
WINDOW, LEAST, USUAL, MOST = 16, 128, 512, 2_048
PART_DOCUMENTS = 50_000
#: Digests that a task remembers, so that it sends a chunk once; copies beyond are dropped after the shuffle.
SEEN = 50_000
ROW = "kind string, key binary, doc_id long, n int, body binary, digests array<binary>, sizes array<int>"


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place, a polynomial hash of the last WINDOW ids, by doubling."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, span = np.uint64(0xD6E8FEB86659FD93), 1
    with np.errstate(over="ignore"):
        while span < WINDOW:
            h[span:] += h[:-span].copy() * base if len(h) > span else h[span:]
            base *= base
            span *= 2
    return h


def marks_of(ids: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Places after which a chunk may end, of ids of any length: ``step`` ids are hashed at a time."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(ids), step):
        low = max(0, at - WINDOW + 1)
        hashed = rolling(ids[low : at + step])[at - low :]
        found.append(np.flatnonzero((hashed >> np.uint64(40)) % np.uint64(USUAL) == 0) + at + 1)
    return np.concatenate(found)


def cuts(marks: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the document at ``start`` to ``stop`` of a stream with ``marks``.

    No mark nearer than LEAST to a chunk's start is taken, so the ends depend on the document's own ids alone.
    """
    ends, at = [], start
    while stop - at > LEAST:
        k = bisect_left(marks, at + LEAST)
        at = min(marks[k] if k < len(marks) else stop, at + MOST, stop)
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max() < 65536 else "<u4").tobytes()


def unpacked(body: bytes, n: int) -> bytes:
    return np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4").tobytes()


def chunked(df: DataFrame, key: str, ids: str, tokenizer: str | None, end_id: int | None) -> DataFrame:
    """Chunk rows (each of the first SEEN digests once a task) and one recipe row a document, in one pass of Python."""
    ship(df.sparkSession)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode if tokenizer else None
        seen: set[bytes] = set()
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            given = batch.column(1).to_pylist()
            raws = [(encode(x or "") if encode else x or b"") + end for x in given]
            raw = b"".join(raws)
            flat = np.frombuffer(raw, "<u4")
            marks = marks_of(flat).tolist()
            narrow = flat.astype("<u2").tobytes() if len(flat) and flat.max() < 65536 else None
            chunks: list[tuple[bytes, int, bytes]] = []
            recipes: list[tuple[bytes, int, list[bytes], list[int]]] = []
            at = 0
            for one in raws:
                stop, digests, sizes = at + len(one) // 4, [], []
                total = stop - at
                for to in cuts(marks, at, stop):
                    digest = hashlib.sha256(raw[4 * at : 4 * to]).digest()
                    if digest not in seen:
                        if len(seen) < SEEN:
                            seen.add(digest)
                        chunks.append((digest, to - at, packed(flat[at:to]) if narrow is None else narrow[2 * at : 2 * to]))
                    digests.append(digest)
                    sizes.append(to - at)
                    at = to
                recipes.append((f"{task}-{row}".encode(), total, digests, sizes))
                row += 1
            c, r = len(chunks), len(recipes)
            keys, sizes_of, bodies = (list(x) for x in zip(*chunks, strict=True)) if c else ([], [], [])
            names, totals, digest_lists, size_lists = (list(x) for x in zip(*recipes, strict=True)) if r else ([], [], [], [])
            columns = {
                "kind": pa.array(["chunk"] * c + ["recipe"] * r, pa.string()),
                "key": pa.array(keys + names, pa.binary()),
                "doc_id": pa.concat_arrays([pa.nulls(c, pa.int64()), batch.column(0).cast(pa.int64())]),
                "n": pa.array(sizes_of + totals, pa.int32()),
                "body": pa.array(bodies + [None] * r, pa.binary()),
                "digests": pa.array([None] * c + digest_lists, pa.list_(pa.binary())),
                "sizes": pa.array([None] * c + size_lists, pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    source = quoted(ids).cast("string" if tokenizer else "binary")
    return df.select(quoted(key).cast("long").alias("doc"), source.alias("ids")).mapInArrow(run, ROW)


def leaf() -> Column:
    """A document's node of the Merkle tree: over its id, its size and the digests of its chunks in order."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"), F.array_join(F.transform("digests", lambda d: F.hex(d)), ",")), 256)


def roots(recipes: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "row", leaf().alias("leaf"))))
    return recipes.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["leaf"]), ","), 256).alias("root"))


def write(df: DataFrame, path: str, key: str, ids: str, tokenizer: str | None = None, end_id: int | None = None) -> None:
    """Write a store of the documents of ``df``: their key (long) and ids (binary, little-endian unsigned 32-bit).

    With ``tokenizer`` (a byte-level BPE file of the tokenizers library), ``ids`` is a column of texts, encoded where they
    are cut. ``end_id``, if given, ends each document. A null id stream or text counts as empty. Repeated rows and keys
    are documents of their own; a null key comes first. An empty table gives a store without documents.
    Copies of a chunk are dropped in the task that cuts them, then by their digest after one shuffle.
    """
    spark = df.sparkSession
    rest = F.struct("kind", "doc_id", "n", "body", "digests", "sizes")
    with small_batches(spark):
        # dealt by key first: one sort of the bodies in place of one on each side of the shuffle
        rows = chunked(df, key, ids, tokenizer, end_id).repartition("key").groupBy("key").agg(F.first(rest).alias("rest"))
        rows.select("key", "rest.*").write.option("compression", "zstd").parquet(f"{path}/data")
    stored = spark.read.schema(ROW).parquet(f"{path}/data").where("kind = 'recipe'")
    recipes = stored.select("doc_id", F.decode("key", "UTF-8").alias("row"), F.col("n").cast("long").alias("n_tokens"), "digests", "sizes")
    parts = max(1, math.ceil(recipes.count() / PART_DOCUMENTS))
    dealt = recipes.repartitionByRange(parts, "doc_id", "row").withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("doc_id", "row").write.option("compression", "zstd").parquet(f"{path}/recipes")
    roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def store_root(spark: SparkSession, path: str) -> str:
    """SHA-256 over the parts' roots in order: one value for the store; parts hold PART_DOCUMENTS documents or so."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "root")))
    return spark.read.parquet(f"{path}/manifest").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["root"]), ","), 256)).first()[0]


def verified_chunks(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(digest, n, crc[, ids]): every stored chunk, read whole; fails if one's ids don't have its digest."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bodies = (c.to_pylist() for c in batch.columns)
            raws = [unpacked(b, n) for b, n in zip(bodies, sizes, strict=True)]
            if any(hashlib.sha256(x).digest() != digest for digest, x in zip(keys, raws, strict=True)):
                raise ValueError("a chunk's ids don't have its digest")
            made = [batch.column(0), batch.column(1), pa.array(map(zlib.crc32, raws), pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(raws, pa.binary())] if ids else [])], ["digest", "n", "crc", "ids"][: 3 + ids])

    chunks = spark.read.schema(ROW).parquet(f"{path}/data").where("kind = 'chunk'").select("key", "n", "body")
    return chunks.mapInArrow(run, "digest binary, n int, crc long" + ", ids binary" * ids)


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes; fails where a part's documents don't have the root that the manifest names."""
    recipes = spark.read.parquet(f"{path}/recipes")
    found = roots(recipes).select("part", F.col("root").alias("now"))
    wrong = spark.read.parquet(f"{path}/manifest").join(found, "part", "full").where("not (root <=> now)")
    if not wrong.isEmpty():
        raise ValueError("a part's documents don't have the manifest's root")
    return recipes


def started(recipes: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before, within parts and by sums of parts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    bases = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))  # a row a part
    within = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return recipes.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def shift_tables() -> np.ndarray:
    """[k, byte, value]: what 2 ** k zero bytes after a text make of its CRC-32, byte by byte of the CRC."""
    # one zero bit: shift right, feed back the polynomial
    power = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint64)

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where((v >> np.uint64(bit)) & np.uint64(1), m[bit], np.uint64(0))
        return out

    for _ in range(3):
        power = apply(power, power)
    tables = []
    for _ in range(44):
        tables.append([apply(power, np.arange(256, dtype=np.uint64) << np.uint64(8 * b)) for b in range(4)])
        power = apply(power, power)
    return np.array(tables, np.uint64)


def crc_shifted(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 values moved by so many bytes that follow: xor of all chunks' moved values is their document's value."""
    v = crc.astype(np.uint64)
    for k in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        pick = ((zeros >> k) & 1).astype(bool)
        x = v[pick]
        v[pick] = tables[k, 0][(x & np.uint64(255)).astype(int)] ^ tables[k, 1][((x >> np.uint64(8)) & np.uint64(255)).astype(int)] ^ tables[k, 2][((x >> np.uint64(16)) & np.uint64(255)).astype(int)] ^ tables[k, 3][(x >> np.uint64(24)).astype(int)]
    return v.astype(np.int64)


def placed(recipes: DataFrame) -> DataFrame:
    """(part, row, digest, size, after): a row per chunk of each document, with the ids of the document that follow it."""
    inner = Window.partitionBy("part", "row")
    steps = recipes.select("part", "row", "n_tokens", F.posexplode(F.arrays_zip("digests", "sizes")).alias("pos", "s"))
    done = F.sum("s.sizes").over(inner.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("part", "row", F.col("s.digests").alias("digest"), F.col("s.sizes").alias("size"), (F.col("n_tokens") - done).alias("after"))


def digests_of(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: all chunks read and verified.

    A document's CRC is put together from those of its chunks, so no document's ids are shuffled; a chunk that very many
    documents share is one row that they join, a skewed join that Spark splits.
    """
    tables = shift_tables()

    def run(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shifted(crc.to_numpy(), after.to_numpy(), tables))

    run.__annotations__ = {"crc": pd.Series, "after": pd.Series, "return": pd.Series}
    moved = F.pandas_udf(run, "long")
    recipes = verified_recipes(spark, path)
    chunks = verified_chunks(spark, path)
    found = placed(recipes).join(chunks, "digest", "left")
    sound = F.when(F.col("n") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("long"))
    values = found.select("part", "row", moved(sound, F.col("after") * 4).alias("v")).groupBy("part", "row").agg(F.bit_xor("v").alias("ids_crc32"))
    docs = started(recipes.select("part", "row", "doc_id", "n_tokens"))
    return docs.join(values, ["part", "row"], "left").select("doc_id", "start", "n_tokens", F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): every document's id stream, put together from verified chunks."""
    recipes = verified_recipes(spark, path)
    found = placed(recipes).join(verified_chunks(spark, path, ids=True).select("digest", "ids"), "digest")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), "ids")))
    streams = found.groupBy("part", "row").agg(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), "").alias("hex"))
    return recipes.select("part", "row", "doc_id", "n_tokens").join(streams, ["part", "row"], "left").select("doc_id", "n_tokens", F.unhex(F.coalesce("hex", F.lit(""))).alias("ids"))
