"""Vector code compression: product quantization in whole numbers, so that codes are the same on any machine.

A vector's parts are coded by the nearest entries of their codebooks, learned in rounds that pass over a stored table: a
task sums the parts of each entry, Spark adds the tasks' sums up, and the driver sees the sums alone, whose number is that
of the codebooks' components. The nearest entry is screened by one single-precision matrix product; each product's
rounding error is bounded, and entries whose intervals overlap the best one's are compared again in 64-bit integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brookloom.llm.shared import quoted, ship, without

#: Lengths of vectors in one table, beyond which it fails: each has codebooks of its own.
MOST_LENGTHS = 64
#: Rows that are multiplied at once.
TILE = 8_192
#: Codebooks by vector length: [part, entry, place within the part].
Books = dict[int, np.ndarray]


def whole_numbers(df: DataFrame, vector: str, scale: int = 4096) -> DataFrame:
    """``df`` without the rows whose vector is null or holds null or non-finite components, and with components
    floor(scale * x) as 32-bit integers. Other columns, repeated rows and the vectors' lengths stay as they are."""
    v = quoted(vector)
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    low, high = -(2**31), 2**31 - 1  # ``checked`` refuses these ends
    floors = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(high)), F.lit(low)).cast("int"))
    return df.where(F.coalesce(good, F.lit(False))).withColumn(vector, floors)


def checked(x: np.ndarray) -> np.ndarray:
    """The rows, if any sum of squared differences of two such rows fits into 64 bits."""
    most = math.isqrt((2**63 - 1) // max(1, x.shape[1])) // 2
    if x.size and max(int(x.max()), -int(x.min())) > most:
        raise ValueError(f"components of {x.shape[1]} beyond {most} in size: squared distances wouldn't fit into 64 bits")
    return x


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of integers, the index of the entry at the least squared distance, the lowest of several.

    The distance less the row's own square is |entry|^2 - 2 row . entry. The product is taken in single precision, whose
    error, whatever the order of its sum and with the rounding of its terms, is at most g |row| |entry| with
    g = m u / (1 - m u), m = components + 4, u = 2^-24. Where only one entry's interval reaches the least upper end it is
    the nearest; all others that reach it are compared exactly.
    """
    n = x.shape[1]
    squares = (book.astype(np.int64) ** 2).sum(axis=1).astype(np.float64)
    products = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    score = squares - 2 * products
    mu = (n + 4) * 2.0**-24
    if mu < 0.5:
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)
        width = 2 * mu / (1 - mu) * lengths * (1 + 1e-6)
        width += 2.0**-49 * (squares + 2 * np.abs(products) + width)  # of the double-precision steps
    else:
        width = np.full(score.shape, np.inf)
    rival = score - width <= (score + width).min(axis=1, keepdims=True)
    best = rival.argmax(axis=1)
    odd = np.flatnonzero(rival.sum(axis=1) > 1)
    if len(odd):
        row, entry = np.nonzero(rival[odd])
        exact = np.full((len(odd), len(book)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[odd[row]].astype(np.int64) - book[entry]) ** 2).sum(axis=1)
        best[odd] = exact.argmin(axis=1)
    return best


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a list column, for each length and tile: which rows they are, and their components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        for at in range(0, len(rows), TILE):
            own = rows[at : at + TILE]
            places = (ends[own] - n)[:, None] + np.arange(n)
            yield own, checked(flat[places].astype(np.int64))


def parted(m: np.ndarray, parts: int) -> np.ndarray:
    return m.reshape(len(m), parts, m.shape[1] // parts)


def first_entries(stored: DataFrame, key: str, vector: str, parts: int, entries: int) -> Books:
    """Of each length, the parts of the vectors with the smallest keys: nulls last, equal keys by their components."""
    lengths = [r[0] for r in stored.select(F.size(quoted(vector)).alias("n")).where(F.col("n") % parts == 0).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    books = {}
    for n in lengths:
        rows = stored.where(F.size(quoted(vector)) == n).orderBy(quoted(key).asc_nulls_last(), quoted(vector)).select(quoted(vector)).limit(entries).collect()
        books[n] = np.ascontiguousarray(parted(checked(np.array([r[0] for r in rows], np.int64).reshape(len(rows), n)), parts).transpose(1, 0, 2))
    return books


def sums(stored: DataFrame, vector: str, books: Books) -> DataFrame:
    """(length, slot, value): of each entry the number of parts nearest to it, then their sums, one slot after the other."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in vectors_of(batch.column(0)):
                n = m.shape[1]
                if n in books:
                    parts, entries, width = books[n].shape
                    own = held.setdefault(n, np.zeros((parts, entries, 1 + width), np.int64))
                    for p, x in enumerate(parted(m, parts).transpose(1, 0, 2)):
                        one = np.zeros((len(x), entries))
                        one[np.arange(len(x)), nearest(x, books[n][p])] = 1
                        own[p, :, 0] += one.sum(axis=0).astype(np.int64)
                        own[p, :, 1:] += (one.T @ x).astype(np.int64)  # whole numbers below 2^53: a tile's sums are exact
        for n, own in held.items():
            flat = own.ravel()
            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(flat), n, np.int32)), "slot": pa.array(np.arange(len(flat))), "value": pa.array(flat)})

    made = stored.select(quoted(vector)).mapInArrow(run, "length int, slot long, value long")
    return made.groupBy("length", "slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))


def learn(stored: DataFrame, key: str, vector: str, parts: int = 8, entries: int = 16, rounds: int = 6) -> Books:
    """Codebooks by vector length from a stored table of ``whole_numbers``.

    They start as the parts of the vectors with the smallest keys (``first_entries``; of fewer vectors than entries, as
    many as there are). In each round every part goes to its nearest entry, and each entry becomes the componentwise
    floor of its parts' mean; unused entries stay. Lengths that don't divide by ``parts`` have no codebooks; more than 64
    lengths, or components whose squared distances don't fit into 64 bits, fail. An empty table has none.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    books = first_entries(stored, key, vector, parts, entries)
    for _ in range(rounds if books else 0):
        found = {n: np.zeros((b.shape[0], b.shape[1], 1 + b.shape[2]), object) for n, b in books.items()}
        for r in sums(stored, vector, books).collect():  # as many rows as the codebooks have components, and their counts
            found[r["length"]].reshape(-1)[r["slot"]] = int(r["value"])
        for n, own in found.items():
            used = own[:, :, 0] > 0
            books[n][used] = (own[used][:, 1:] // own[used][:, :1]).astype(np.int64)
    return books


def digest(book: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(stored: DataFrame, vector: str, books: Books) -> DataFrame:
    """``stored`` without its vectors and with code (two hex digits a part), error (squared distance to the coded vector)
    and codebooks_sha256; nulls where there is no codebook of the vector's length. Columns of these names are replaced."""
    ship(stored.sparkSession)
    made = ["code", "error", "codebooks_sha256"]
    kept = without(stored, made)
    fields = [f for f in kept.schema.fields if f.name != vector]
    schema = StructType([*fields, StructField("code", StringType()), StructField("error", LongType()), StructField("codebooks_sha256", StringType())])
    named = {n: digest(b) for n, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, digests = ([None] * batch.num_rows for _ in made)
            for rows, m in vectors_of(batch.column(batch.num_columns - 1)):
                n = m.shape[1]
                if n not in books:
                    continue
                parts = books[n].shape[0]
                found = np.zeros((len(m), parts), np.uint8)
                error = np.zeros(len(m), np.int64)
                for p, x in enumerate(parted(m, parts).transpose(1, 0, 2)):
                    found[:, p] = best = nearest(x, books[n][p])
                    error += ((x - books[n][p][best]) ** 2).sum(axis=1)
                text = found.tobytes().hex()
                for k, (row, e) in enumerate(zip(rows.tolist(), error.tolist(), strict=True)):
                    codes[row], errors[row], digests[row] = text[2 * parts * k : 2 * parts * (k + 1)], e, named[n]
            columns = [*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.select(*[quoted(f.name) for f in fields], quoted(vector)).mapInArrow(run, schema)


def decoded(code: str, book: np.ndarray) -> list[int]:
    """The whole numbers that a code stands for."""
    return [c for p, e in enumerate(bytes.fromhex(code)) for c in book[p][e].tolist()]
