"""Packing token sequences into training sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from brookloom.llm.shared import bucket_count, quoted, ranked, ship, unused, without
from brookloom.llm.tokens import encoder

PIECE = [StructField(name, LongType()) for name in ("start", "length", "doc_tokens", "ids_crc32")]


def cut_texts(df: DataFrame, text: str, path: str, capacity: int, end_id: int | None = None, ids: bool = True, encoding: Callable = encoder) -> DataFrame:
    """One row per piece of ``capacity`` ids at most: the input's other columns, start, length, doc_tokens, ids_crc32, piece.

    ``path``: a byte-level BPE file of the tokenizers library, or one that ``encoding`` reads; its ids of the whole text are
    cut, with ``end_id`` after them if given. piece: the piece's ids, little-endian unsigned 32-bit, left out unless ``ids``, so that no id leaves
    the worker; ids_crc32: their unsigned CRC-32. A null text counts as empty, and gives no piece where there is no
    ``end_id``. Columns of the input that have these names are dropped. Repeated rows stay; an empty table stays empty.
    """
    ship(df.sparkSession)
    kept = without(df, [*(f.name for f in PIECE), "piece"])
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = StructType([*fields, *PIECE, *([StructField("piece", BinaryType())] if ids else [])])
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode
        for batch in batches:
            rows: list[tuple[int, int, bytes, int]] = []

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at, start, piece, whole = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
                rows.clear()
                same = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
                made = [pa.array(x, pa.int64()) for x in (start, [len(x) // 4 for x in piece], whole, map(zlib.crc32, piece))]
                return pa.RecordBatch.from_arrays([*same, *made, *([pa.array(piece, pa.binary())] if ids else [])], schema.names)

            for i, one in enumerate(batch.columns[-1].to_pylist()):
                stream = encode(one or "") + end
                for at in range(0, len(stream), 4 * capacity):
                    rows.append((i, at // 4, stream[at : at + 4 * capacity], len(stream) // 4))
                    if len(rows) >= 1_000:
                        yield out()
            yield out()

    source = kept.select(*[quoted(f.name) for f in fields], quoted(text).cast("string").alias("_text"))
    return source.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns [(count, lengths)] that use every length of ``histogram`` as often as it occurs.

    Lengths are placed longest first, each into the shortest open packs (those with most room) that it fits, or new ones.
    Packs that are alike are one pattern with a count, so the work is bounded by ``capacity``, not by the rows.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    heap: list[int] = []  # rooms, most room first; stale entries are skipped

    def put(count: int, pattern: tuple[int, ...], left: int) -> None:
        if not room[left]:
            heapq.heappush(heap, -left)
        room[left].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        need = histogram[length]
        while need > 0:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            if not heap or -heap[0] < length:
                # of the rest, each goes into the pack that the one before opened, until that is full
                each = capacity // length
                if full := need // each:
                    put(full, (length,) * each, capacity - length * each)
                if rest := need % each:
                    put(1, (length,) * rest, capacity - length * rest)
                break
            left = -heap[0]
            count, pattern = room[left].pop()
            if not room[left]:
                heapq.heappop(heap)
            used = min(count, need)
            if count > used:
                put(count - used, pattern, left)
            put(used, (*pattern, length), left - length)
            need -= used
    return [p for left in sorted(room) for p in room[left]]


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length", plan: Callable = shortest_pack_first) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, so that no sequence has more than ``capacity`` ids and none has a gap.

    The histogram has ``capacity`` rows at most whatever the input; ``plan`` makes patterns from it on the driver, and each
    piece finds its place by its rank among those of its length. Ranks are dealt over hashed buckets, so a length that
    a third of all pieces have is no hot group. ``pieces`` is read more than once: give a stored table. Lengths outside
    1 to ``capacity`` fail. An empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = without(pieces, ["sequence_id", "offset"])
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    sequences, taken, places = 0, defaultdict(int), []
    for count, pattern in plan(counts, capacity):
        at = 0
        for n in pattern:
            places.append((n, taken[n], taken[n] + count, sequences, at))
            taken[n] += count
            at += n
        sequences += count
    rank, size, low, high, first, at = unused(pieces, "_rank", "_length", "_low", "_high", "_first", "_at")
    slots = spark.createDataFrame(places, f"{size} long, {low} long, {high} long, {first} long, {at} long")
    held = ranked(pieces, [length], order, bucket_count(spark, sum(counts.values())), rank)
    placed = held.join(F.broadcast(slots), (F.col(length) == F.col(size)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    return placed.withColumn("sequence_id", F.col(first) + F.col(rank) - F.col(low)).withColumn("offset", F.col(at)).drop(rank, size, low, high, first, at)


def padding(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: sequences, ids, share of padding."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("ids")).withColumn("padding", 1 - F.col("ids") / (F.col("sequences") * capacity))
